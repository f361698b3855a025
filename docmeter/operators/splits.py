"""Deterministic assignment: splits, buckets, samples and resumable sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docmeter.functions.codes import hash_bucket, hash_unit


def split_of(group: Column, seed: int, shares: Sequence[float] = (0.6, 0.2, 0.2), names: Sequence[str] = ("dev", "val", "test")) -> Column:
    """The split of a group by its hash alone: no group is in two."""
    if min(shares) < 0 or sum(shares) <= 0:
        raise ValueError("shares must not be negative and must not add up to 0")
    u = hash_unit(F.concat(F.lit(f"split:{seed}:"), group))
    out, upto = None, 0.0
    for share, name in list(zip(shares, names, strict=True))[:-1]:
        upto += share
        test = u < upto / sum(shares)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(names[-1])


def leaks(rows: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that are in more than one split."""
    return rows.groupBy(group).agg(F.countDistinct(split).alias("splits")).where("splits > 1")


def weighted_choice(key: Column, weights: dict[str, int]) -> Column:
    """One of the names by the hash of the key, with odds by weight, in the order given."""
    bucket = hash_bucket(key, sum(weights.values()))
    out, upto = None, 0
    for name, weight in weights.items():
        upto += weight
        out = F.when(bucket < upto, name) if out is None else out.when(bucket < upto, name)
    return out


def evenly(index: Column, times: int, of: int) -> Column:
    """True for ``times`` of each ``of`` indexes, evenly spread."""
    return F.floor((index + 1) * times / of) > F.floor(index * times / of)


def round_robin(rows: DataFrame, stratum: str, kind: str, kinds: Sequence[str] | None, key: str, n: int) -> DataFrame:
    """``n`` rows of each stratum, taking kinds in turn, each by key. Without ``kinds`` the table's own, null last: every row may be taken."""
    if kinds is None:
        own = rows.select(F.col(kind).alias("_kind")).distinct()
        own = own.withColumn("_turn", F.row_number().over(W.orderBy(F.asc_nulls_last("_kind"))))
        rows = rows.join(own, F.col(kind).eqNullSafe(F.col("_kind"))).drop("_kind")
    else:
        rows = rows.where(F.col(kind).isin(*kinds)).withColumn("_turn", F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col(kind)))
    ranked = rows.withColumn("_nth", F.row_number().over(W.partitionBy(stratum, kind).orderBy(key)))
    # Of each kind the first n are enough: later rows can't be taken.
    ranked = ranked.where(F.col("_nth") <= n)
    taken = ranked.withColumn("taken", F.row_number().over(W.partitionBy(stratum).orderBy("_nth", "_turn")))
    return taken.where(F.col("taken") <= n).drop("_nth", "_turn")


def pending(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is still to do: not answered, or failed in a way worth another try. ``done``: key, status, retryable."""
    final = done.where((F.col("status") == "ok") | ~F.coalesce("retryable", F.lit(False)))
    return wanted.join(final, key, "left_anti")


def with_default(wanted: DataFrame, answers: DataFrame, key: str, default: str = "NO_ANSWER") -> DataFrame:
    """All wanted rows; without an answer the status is error and the code the default."""
    joined = wanted.join(answers.withColumn("_found", F.lit(True)), key, "left")
    return joined.withColumns({"status": F.coalesce("status", F.lit("error")), "code": F.when(F.col("_found").isNull(), default).otherwise(F.col("code"))}).drop("_found")


def first_of_repeated(rows: DataFrame, sample: str, value: str, order: str, most: int = 2) -> DataFrame:
    """Values that more than ``most`` fields of a sample share are kept in the first field only."""
    same = W.partitionBy(sample, value)
    counted = rows.withColumns({"_n": F.count(F.lit(1)).over(same), "_at": F.row_number().over(same.orderBy(order))})
    return counted.withColumn("kept", (F.col("_n") <= most) | (F.col("_at") == 1)).drop("_n", "_at")
