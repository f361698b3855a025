"""Upkeep and summaries of tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docmeter.sources.scratch import written


def only_one(rows: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str) -> DataFrame:
    """``flag`` is true for the last row of each key by ``order`` (nulls first, so never last but alone) and false for its siblings."""
    last = W.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order])
    return rows.withColumn(flag, F.row_number().over(last) == 1)


def retained(rows: DataFrame, ts: str, kind: str, days: Mapping[str, int], otherwise: int) -> DataFrame:
    """Rows not older than their kind's days before the newest row; rows without a time go, a null kind is one of the others."""
    newest = rows.agg(F.max(F.col(ts).cast("timestamp")).alias("_newest"))  # one row
    limit = F.lit(otherwise)
    for name, n in days.items():
        limit = F.when(F.col(kind) == name, n).otherwise(limit)
    joined = rows.crossJoin(F.broadcast(newest))
    old = F.unix_micros("_newest") - F.unix_micros(F.col(ts).cast("timestamp"))
    return joined.where(old <= limit.cast("long") * 86_400_000_000).drop("_newest")


def drain(rows: DataFrame, key: str, name: str = "place") -> DataFrame:
    """Rows numbered by ``key``: range partitions are numbered each and their counts summed up, so no task holds all rows.

    The partitioned rows are written once, as counting and numbering them must see the same partitions: computed twice, they
    could be cut at other places or merged by their size.
    """
    ranged = written(rows.repartitionByRange(F.col(key)).withColumn("_part", F.spark_partition_id()), "drain")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a partition
    placed = ranged.withColumn("_pos", F.row_number().over(W.partitionBy("_part").orderBy(key)))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_pos")).drop("_part", "_pos", "_before")


def page(rows: DataFrame, order: Sequence[Column], number: int, size: int, total: str = "total") -> DataFrame:
    """The rows of a page (from 1) and the number of all rows; ``order`` should end with a unique column."""
    counted = rows.agg(F.count(F.lit(1)).alias(total))  # one row
    return rows.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(counted))


def throughput(rows: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Rows (n) and rows an hour between a key's first and last one; null where no time passed."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    spans = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.max(us) - F.min(us)).alias("us"))
    return spans.select(*keys, "n", F.when(F.col("us") > 0, F.col("n") * F.lit(3.6e9) / F.col("us")).alias("per_hour"))


def most_frequent(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The value that most rows of a key have, and how many; ties go to the smallest value. Null values don't count."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b"))
    return best.select(*keys, F.col("b.v").alias(value), (-F.col("b.m")).alias("n"))


def ordinal(rows: DataFrame, column: str, known: Sequence[str], last: int = 999) -> DataFrame:
    """The place of the column's value in ``known``, ``last`` for others and null."""
    place = F.array_position(F.array(*[F.lit(k) for k in known]), F.col(column))
    return rows.withColumn("ordinal", F.when(place > 0, place).otherwise(last).cast("int"))


def map_rows(rows: DataFrame, key: str, fields: str, allowed: Sequence[str] | None = None) -> DataFrame:
    """A row (key, field, value) for each entry of a map that is neither null nor empty, of the allowed names only."""
    kept = F.map_filter(fields, lambda k, v: v.isNotNull() & (v != "") & (k.isin(*allowed) if allowed is not None else F.lit(True)))
    return rows.select(key, F.explode(kept).alias("field", "value"))


def patched(rows: DataFrame, changes: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Partial update: columns take the new value (null clears) where they were sent and stay elsewhere."""
    return rows.withColumns({c: F.when(F.coalesce(sent, F.lit(False)), value).otherwise(F.col(c)) for c, (sent, value) in changes.items()})


def orphans(rows: DataFrame, key: str, owners: DataFrame, owner: str, relation: str) -> DataFrame:
    """(relation, id, n): keys of ``rows`` that no owner has, with their rows; null keys refer to nothing and are left out."""
    lost = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    have = owners.select(F.col(owner).cast("long").alias("id")).distinct()
    return lost.join(have, "id", "left_anti").select(F.lit(relation).alias("relation"), "id", "n")


def expected_actual(expected: DataFrame, actual: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Both sides' values by key, and where the key stands: both, missing (expected only) or extra (actual only)."""
    e = expected.select(*keys, F.col(value).alias("expected"), F.lit(True).alias("_e"))
    a = actual.select(*keys, F.col(value).alias("actual"), F.lit(True).alias("_a"))
    side = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "extra").otherwise("both")
    return e.join(a, list(keys), "full").select(*keys, "expected", "actual", side.alias("side"))


def distinct_in_order(rows: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """(key, value, place): a key's values once each, by their first row."""
    first = rows.groupBy(key, value).agg(F.min(F.struct(*order)).alias("_at"))
    return first.select(key, value, F.row_number().over(W.partitionBy(key).orderBy("_at")).alias("place"))
