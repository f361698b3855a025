"""Plane geometry on array and struct columns: 3 x 3 matrices as array<array<double>>, boxes as struct x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matmul(a: Column, b: Column) -> Column:
    """Row by column, first b and then a is applied."""
    column = lambda j: F.transform(b, lambda r: F.get(r, F.lit(j)))
    dot = lambda r, j: F.aggregate(F.zip_with(r, column(j), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.transform(a, lambda r: F.array(*[dot(r, j) for j in range(3)]))


def apply(m: Column, x: Column, y: Column) -> Column:
    """Struct x, y of a point under a homography."""
    row = lambda i: F.get(F.get(m, F.lit(i)), F.lit(0)) * x + F.get(F.get(m, F.lit(i)), F.lit(1)) * y + F.get(F.get(m, F.lit(i)), F.lit(2))
    return F.struct((row(0) / row(2)).alias("x"), (row(1) / row(2)).alias("y"))


def project(m: Column, box: Column) -> Column:
    """The four corners (top left, top right, bottom right, bottom left) of a box."""
    corners = ((box["x0"], box["y0"]), (box["x1"], box["y0"]), (box["x1"], box["y1"]), (box["x0"], box["y1"]))
    return F.array(*[apply(m, x, y) for x, y in corners])


def envelope(quad: Column) -> Column:
    xs, ys = F.transform(quad, lambda p: p["x"]), F.transform(quad, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def projected(fields: DataFrame, log: DataFrame, keys: tuple[str, ...] = ("sample_id", "page_index")) -> DataFrame:
    """Fields (keys, box) with quad and box in the transformed image; ``log`` has keys and matrix, a row per page."""
    out = fields.join(log.select(*keys, "matrix"), list(keys))
    out = out.withColumn("quad", project(F.col("matrix"), F.col("box")))
    return out.withColumn("box_px", envelope(F.col("quad"))).drop("matrix")
