"""Readers and writers: tables, manifests, answers, raw texts, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from docmeter.functions.text import strip_front_matter

CORRUPT = "_corrupt_record"


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def spread(rows: DataFrame, most: int = 4096) -> DataFrame:
    """Rows dealt over partitions of about ``most``, for work that is heavy by row: a small file of many rows is one partition else."""
    parts = rows.count() // most + 1
    return rows.repartition(parts) if parts > 1 else rows


def fixed(rows: DataFrame, **named: Column) -> DataFrame:
    """Values as columns of their own that Catalyst does not copy into each place of use.

    They are computed in a projection, which is compiled; the generator behind it, which keeps projections apart, would interpret them.
    """
    last = next(reversed(named))
    return rows.withColumns(named).withColumn(last, F.explode(F.array(F.col(last))))


def _lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines with the file and the line's byte order, malformed ones in a column; blank lines are left out."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    placed = raw.select("value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_order"))
    with_bad = StructType([*schema, StructField(CORRUPT, StringType())])
    row = F.from_json("value", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return placed.withColumn("row", row)


def _last_wins(rows: DataFrame, key: str) -> DataFrame:
    same = W.partitionBy(key)
    ranked = rows.withColumns({"_last": F.row_number().over(same.orderBy(F.desc("_order"))), "first_seen": F.min("_order").over(same)})
    return ranked.where("_last = 1").drop("_last", "_order", "_file")


def read_manifest(spark: SparkSession, path: str, schema: StructType, key: str = "sample_id") -> DataFrame:
    """Rows by key, the last one of a key; ``first_seen`` gives their order. Malformed lines and null keys fail the read."""
    rows = _lines(spark, path, schema)
    bad = F.col(f"row.{CORRUPT}").isNotNull() | F.col(f"row.{key}").isNull()
    checked = rows.withColumn("row", F.when(bad, F.raise_error(F.concat(F.lit("bad manifest line: "), F.col("value")))).otherwise(F.col("row")))
    return _last_wins(checked.select("row.*", "_order", "_file").drop(CORRUPT), key)


def read_answers(spark: SparkSession, path: str, schema: StructType, key: str = "sample_id") -> DataFrame:
    """As ``read_manifest``, but malformed lines are left out."""
    rows = _lines(spark, path, schema).where(F.col(f"row.{CORRUPT}").isNull() & F.col(f"row.{key}").isNotNull())
    return _last_wins(rows.select("row.*", "_order", "_file").drop(CORRUPT), key)


def read_batch(spark: SparkSession, path: str, schema: StructType, key: str = "sample_id") -> DataFrame:
    """Every line that isn't blank; a malformed one has a made-up key (line_N) and the text in ``rejected``."""
    rows = _lines(spark, path, schema)
    number = F.row_number().over(W.partitionBy("_file").orderBy("_order"))
    rows = rows.withColumn("_n", number).select("row.*", "_n", "value")
    bad = F.col(CORRUPT).isNotNull() | F.col(key).isNull()
    named = F.when(bad, F.concat(F.lit("line_"), F.col("_n").cast("string"))).otherwise(F.col(key))
    return rows.withColumns({key: named, "rejected": F.when(bad, F.col("value"))}).drop(CORRUPT, "_n", "value")


def read_raw_text(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path and text without front matter."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), strip_front_matter(F.col("value")).alias("text"))


def file_kind(content: Column) -> Column:
    """Kind by signature; null when it is none of them."""
    head = F.hex(F.substring(content, 1, 8))
    return (
        F.when(head.startswith("255044462D"), "application/pdf")
        .when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("89504E470D0A1A0A"), "image/png")
    )


def read_files(spark: SparkSession, path: str, most_bytes: int) -> DataFrame:
    """Binary files with size, digest, kind and the reason for a refusal."""
    rows = spark.read.format("binaryFile").load(path)
    kind = file_kind(F.col("content"))
    active = F.decode(F.col("content"), "ISO-8859-1").rlike(r"/(JavaScript|JS|Launch|EmbeddedFile)\b")
    refused = F.when(F.col("length") > most_bytes, "too large").when(kind.isNull(), "unknown kind").when((kind == "application/pdf") & active, "active content")
    return rows.select("path", "length", F.sha2("content", 256).alias("sha256"), kind.alias("kind"), refused.alias("refused"))


def merge_manifest(old: DataFrame, new: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """New rows replace old ones of their key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new).orderBy(*order)


def next_free_index(rows: DataFrame, index: str) -> DataFrame:
    return rows.agg((F.coalesce(F.max(index), F.lit(-1)) + 1).alias("next_index"))


def write_csv(rows: DataFrame, path: str, order: Sequence[str], most: int | None = None) -> None:
    """Ordered and quoted; a report is small, so one file."""
    rows = rows.orderBy(*order)
    rows = rows.limit(most) if most is not None else rows
    rows.coalesce(1).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_json(rows: DataFrame, path: str, order: Sequence[str]) -> None:
    rows.orderBy(*order).coalesce(1).write.option("ignoreNullFields", False).json(path)


def truncated(**limits: int) -> list[Column]:
    """Columns cut to their lengths, for audit rows."""
    return [F.left(F.col(c), F.lit(n)).alias(c) for c, n in limits.items()]


def text_report(fields: Sequence[tuple[str, str]]) -> Column:
    """'label: value' lines of the values that are there."""
    lines = [F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.concat(F.lit(f"{label}: "), F.col(c).cast("string"))) for label, c in fields]
    return F.concat_ws("\n", *lines)
