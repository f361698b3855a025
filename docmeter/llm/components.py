"""Connected components of a distributed graph: union-find by alternating star operations.

Each round links every node's larger neighbours to the smallest one it knows (large star),
then every node and its smaller neighbours to the smallest of them (small star), until
nothing changes: a number of rounds that grows with the logarithm of the longest path.
The minimum of a hot node's neighbours is formed before the shuffle, and a hot node's
edges are joined by a join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (the smallest node of the component) for each node that has an edge to another node, roots excepted.

    Nulls are no nodes; loops and repeated edges add nothing; without edges the result is empty.
    """
    with scratch(edges.sparkSession):
        e = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"), F.col(a).alias("_a"), F.col(b).alias("_b"))
        e = materialize(e.where("_a IS NOT NULL AND _b IS NOT NULL AND hi <> lo").select("hi", "lo").distinct(), "components")
        state = _state(e)
        while state[0]:
            both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("m"))
            large = both.join(least, F.col("u") == F.col("node")).where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
            large = materialize(large, "components-large")
            least = large.groupBy("hi").agg(F.min("lo").alias("m"))
            moved = large.join(least.withColumnRenamed("hi", "node"), F.col("hi") == F.col("node")).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            e = materialize(moved.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct(), "components-small")
            before, state = state, _state(e)
            if state == before:
                break
        return materialize(e.select(F.col("hi").alias("node"), F.col("lo").alias("root")), "components-roots", keep=True)
