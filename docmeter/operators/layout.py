"""Text lines from recognised boxes. The band of a row grows with its boxes, so each page is walked in order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOXES = ("left", "top", "right", "bottom", "text")


def rows_of_boxes(boxes: DataFrame, keys: tuple[str, str] = ("doc_id", "page"), slack: float = 0.25) -> DataFrame:
    """(doc_id, page, row, text): a box joins the current row if its centre lies in the row's band, widened by a share of
    its own height. A page is one group; its boxes fit in memory. Boxes without a place or a text are left out."""
    doc, page = keys
    placed = boxes.where(F.col("left").isNotNull() & F.col("top").isNotNull() & (F.trim("text") != "")).select(
        F.col(doc).cast("long").alias("doc_id"), F.col(page).cast("int").alias("page"), *BOXES
    )

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(centre=(pdf["top"] + pdf["bottom"]) / 2).sort_values(["centre", "left"], kind="stable")
        number, top, bottom, out = -1, 0.0, 0.0, []
        for b in pdf.itertuples():
            room = slack * max(b.bottom - b.top, 1e-6)
            if number >= 0 and top - room <= b.centre <= bottom + room:
                top, bottom = min(top, b.top), max(bottom, b.bottom)
            else:
                number, top, bottom = number + 1, b.top, b.bottom
            out.append(number)
        lines = pdf.assign(row=out).sort_values(["row", "left"], kind="stable").groupby("row")["text"].agg(" ".join).reset_index()
        return lines.assign(doc_id=pdf["doc_id"].iloc[0], page=pdf["page"].iloc[0])[["doc_id", "page", "row", "text"]]

    return placed.groupBy("doc_id", "page").applyInPandas(walk, "doc_id long, page int, row int, text string")


def line_bands(boxes: DataFrame, share: float = 0.6) -> DataFrame:
    """The simpler grouping: rows by the distance of centres to the row's first box, in median heights; by windows only
    where the first box is known, hence per page as above."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(centre=(pdf["top"] + pdf["bottom"]) / 2).sort_values(["centre", "left"], kind="stable")
        limit = share * (pdf["bottom"] - pdf["top"]).median()
        number, start, out = -1, 0.0, []
        for c in pdf["centre"]:
            if number < 0 or abs(c - start) > limit:
                number, start = number + 1, c
            out.append(number)
        lines = pdf.assign(row=out).sort_values(["row", "left"], kind="stable").groupby("row")["text"].agg(" ".join).reset_index()
        return lines.assign(doc_id=pdf["doc_id"].iloc[0], page=pdf["page"].iloc[0])[["doc_id", "page", "row", "text"]]

    rows = boxes.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("int").alias("page"), *BOXES)
    return rows.groupBy("doc_id", "page").applyInPandas(walk, "doc_id long, page int, row int, text string")
