"""Mixing sources to target weights by systematic sampling.

Within each source the documents' expected copies are summed up in an order by size,
one random offset is added, and a document is emitted once for each integer that its
part of the running sum crosses. The order by size spreads the extra copies evenly over
short and long documents, so that the words taken come near the target.

Positions within a source come from a range partitioning of narrow rows: counts of each
partition, prefix sums over the partitions, then positions inside. A source with a third
of all rows is thus spread over as many tasks as its share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ASCII_WORD, col, fresh, materialize

WEIGHTS, SHARE, CAP, SEED = (3, 1, 2), 1.5, 2.0, 17


def word_count(text: str | Column = "text") -> Column:
    body = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(body, F.lit(ASCII_WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, source: str, size: str, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP
) -> DataFrame:
    """One row per source: its size and its target.

    Sources in code point order, null last, take ``weights`` in turn and share ``share`` times all sizes. A target stops
    at ``cap`` times its source's size; what is over goes to the others by weight until none is above. The sources that
    stop are the first ones by size over weight, so prefix sums in that order give the level in one go. The table has
    one row per source; only that passes through a single task.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("_i"))
    order = W.orderBy(F.col(source).asc_nulls_last())
    by_source = sizes.groupBy(source).agg(F.sum(size).alias("source_size"))
    by_source = by_source.withColumn("_i", (F.row_number().over(order) - 1) % len(weights) + 1).withColumn("_w", w)
    ranked = W.orderBy(F.col("source_size") / F.col("_w"), F.col(source).asc_nulls_last())
    before = ranked.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    level = by_source.withColumns(
        {
            "_left": F.lit(share) * F.sum("source_size").over(everything)
            - F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0)),
            "_weight": F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)),
        }
    )
    capped = F.lit(cap) * F.col("source_size")
    level = level.withColumn("_free", F.col("_w") * F.col("_left") / F.col("_weight") < capped)
    first = W.partitionBy()
    left = F.max(F.when(F.col("_free"), F.struct("_weight", "_left"))).over(first)
    free = F.col("_w") * left["_left"] / left["_weight"]
    return level.select(source, "source_size", F.coalesce(F.least(free, capped), capped).alias("target"))


def expected_copies(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    size: str = "size",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    seed: int = SEED,
) -> DataFrame:
    """``key``, ``source`` and ``size`` of each row, with source_size, target and copies (how often the mix takes the row).

    * Null sources are a source of their own, the last. Null keys and repeated rows are rows like any other. Rows of
      size 0 take part with nothing to give; a source without words has target 0 and no copies.
    * ``copies`` is at most ``cap`` rounded up. An empty table gives an empty table. Other columns are left out.
    """
    spark = docs.sparkSession
    narrow = docs.select(col(key).alias("_key"), col(source).alias("_source"), col(size).alias("_size"))
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_key").cast("string"), F.lit(""))))
    narrow = narrow.withColumn("_draw", draw)
    order = ["_size", "_draw", "_key"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = narrow.repartitionByRange(parts, F.col("_source").asc_nulls_last(), *order)
    dealt = materialize(dealt.withColumn("_part", F.spark_partition_id()), "mixing")

    counts = dealt.groupBy("_part", "_source").agg(F.count(F.lit(1)).alias("_n"))
    ahead = W.partitionBy("_source").orderBy("_part")
    counts = counts.select("_part", "_source", (F.sum("_n").over(ahead) - F.col("_n")).alias("_before"))
    targets = source_targets(dealt, "_source", "_size", weights, share, cap)

    place = W.partitionBy("_part", "_source").orderBy(*order)
    placed = dealt.withColumn("_pos", F.row_number().over(place))
    bits = F.substring(F.md5(F.concat(F.lit(f"{seed}:source:"), F.coalesce(F.col("_source"), F.lit("")))), 1, 13)
    offset = F.conv(bits, 16, 10).cast("double") / F.lit(float(2**52))
    same = counts.withColumnsRenamed({"_part": "_p", "_source": "_s"})
    goal = targets.withColumnRenamed("_source", "_t")
    index = same.join(goal, F.col("_s").eqNullSafe(F.col("_t"))).drop("_t")
    rows = placed.join(index, (F.col("_part") == F.col("_p")) & F.col("_source").eqNullSafe(F.col("_s")))
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    last = F.col("_before") + F.col("_pos")
    copies = F.floor(offset + rate * last) - F.floor(offset + rate * (last - 1))
    return rows.select(
        F.col("_key").alias(key), F.col("_source").alias(source), F.col("_size").alias(size), "source_size", "target", copies.cast("int").alias("copies")
    )


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The mixed documents: each row of ``docs`` as often as the mix takes it, all columns kept.

    Texts move once, by key. Repeated rows (same key, source and size) are numbered on both sides, so each keeps its own
    copies. Nulls, empty tables and rows of size 0 are treated as in ``expected_copies``.
    """
    words, k, s, w, copies, nth, rank, again = fresh(docs, "words", "k", "s", "w", "copies", "nth", "rank", "again")
    sized = docs.withColumn(words, word_count(col(text)))
    taken = expected_copies(sized, key, source, words, **options)
    taken = taken.select(col(key).alias(k), col(source).alias(s), F.col(words).alias(w), F.col("copies").alias(copies))
    taken = taken.withColumn(nth, F.row_number().over(W.partitionBy(k, s, w).orderBy(F.desc(copies))))
    place = W.partitionBy(col(key), col(source), words).orderBy(F.crc32(F.coalesce(col(text), F.lit(""))))
    sized = sized.withColumn(rank, F.row_number().over(place))
    same = col(key).eqNullSafe(F.col(k)) & col(source).eqNullSafe(F.col(s)) & (F.col(words) == F.col(w)) & (F.col(rank) == F.col(nth))
    joined = sized.join(taken.where(F.col(copies) > 0), same)
    return joined.withColumn(again, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[col(c) for c in docs.columns])
