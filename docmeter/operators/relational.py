"""Operational reports: activity series, listings, alerts, logs and table upkeep.

All functions take and return DataFrames. Dates of reference are parameters, never the clock.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def daily_series(spine: DataFrame, events: DataFrame, ts: str, user: str, measures: dict[str, Column], amount: Column) -> DataFrame:
    """One row per day of the spine (``day``): counts of conditions, active users and a sum; days without events are 0."""
    per_day = events.groupBy(F.to_date(ts).alias("day")).agg(
        *[F.count_if(c).alias(n) for n, c in measures.items()], F.countDistinct(user).alias("active_users"), F.sum(amount).alias("amount")
    )
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in [*measures, "active_users"]]
    return spine.join(per_day, "day", "left").select("day", *zero, F.coalesce("amount", F.lit(0)).alias("amount"))


def one_row(*aggregates: DataFrame) -> DataFrame:
    """Independent one-row aggregates side by side."""
    out = aggregates[0]
    for a in aggregates[1:]:
        out = out.join(a, F.lit(True))
    return out


def newest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, rank: str = "_rank") -> DataFrame:
    """The first ``n`` rows of each key; null keys are one key."""
    ranked = rows.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(rank) <= n).drop(rank)


def top_one(left: DataFrame, right: DataFrame, on: str, value: Column, order: Column, name: str) -> DataFrame:
    """Left lateral join to the last value of each key, as one aggregation before the join."""
    return left.join(right.groupBy(on).agg(F.max_by(value, order).alias(name)), on, "left")


def in_days(ts: str | Column, first: str, last: str) -> Column:
    """Half-open, so that it is pushed down to the scan: from the first day on, before the day after the last."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return (c >= F.lit(first).cast("timestamp_ntz")) & (c < (F.date_add(F.lit(last).cast("date"), 1)).cast("timestamp_ntz"))


def trailing(ts: str, as_of: str, days: int) -> Column:
    return F.col(ts) > F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")


def page(rows: DataFrame, order: Sequence[Column], size: int, number: int) -> DataFrame:
    """Page ``number`` (from 1); the order needs a unique last column."""
    return rows.orderBy(*order).offset(size * (number - 1)).limit(size)


def search(rows: DataFrame, text: str | None = None, over: Sequence[str] = (), **equal) -> DataFrame:
    """Conjunction of the given conditions: a case-insensitive substring over columns joined by spaces, and equalities."""
    if text:
        joined = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in over]))
        rows = rows.where(F.contains(joined, F.lit(text.lower())))
    for name, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows


def browser(agent: Column) -> Column:
    """The first of edge, firefox, chrome and safari that the agent names."""
    out = F.when(agent.rlike("(?i)edg/"), " · Edge")
    for name in ("Firefox", "Chrome", "Safari"):
        out = out.when(agent.rlike(f"(?i){name}"), f" · {name}")
    return out.otherwise("")


def expiry_alerts(items: DataFrame, sent: DataFrame, as_of: str, thresholds: Sequence[int] = (90, 30, 7, 0)) -> DataFrame:
    """(item, threshold): due within the threshold and not alerted at that or a nearer one.

    ``items`` has id and expires; ``sent`` has id and threshold. An item that is first seen shortly before it expires is
    due at several thresholds at once; expired items are due too.
    """
    steps = F.explode(F.array(*[F.lit(t) for t in thresholds]))
    due = items.withColumn("threshold", steps).where(F.datediff(F.col("expires"), F.lit(as_of).cast("date")) <= F.col("threshold"))
    done = sent.select(F.col("id").alias("_id"), F.col("threshold").alias("_t"))
    return due.join(done, (F.col("id") == F.col("_id")) & (F.col("_t") <= F.col("threshold")), "left_anti")


def add_counts(table: DataFrame, changes: DataFrame, keys: Sequence[str], total: str) -> DataFrame:
    """Additive upsert: totals of equal keys add up."""
    return table.unionByName(changes).groupBy(*keys).agg(F.sum(total).alias(total))


def insert_missing(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return table.unionByName(rows.join(table.select(key), key, "left_anti").select(*table.columns))


def merge_keep(old: DataFrame, new: DataFrame, key: str, new_first: Sequence[str] = (), either: Sequence[str] = ()) -> DataFrame:
    """Full merge: existing values stay, gaps are filled; ``new_first`` columns prefer the new value, ``either`` are or-ed."""

    def value(c: str) -> Column:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in either:
            return (F.coalesce(o, F.lit(False)) | F.coalesce(n, F.lit(False))).alias(c)
        return (F.coalesce(n, o) if c in new_first else F.coalesce(o, n)).alias(c)

    joined = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    return joined.select(*[value(c) for c in old.columns])


def change_log(before: DataFrame, after: DataFrame, key: Sequence[str], field: str, value: str) -> DataFrame:
    """Long-form log of what differs, nulls being values; rows that only one side has differ from null."""
    b = before.withColumnRenamed(value, "old")
    a = after.withColumnRenamed(value, "new")
    return b.join(a, [*key, field], "full").where(~F.col("old").eqNullSafe(F.col("new")))


def next_number(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], start: DataFrame | None, name: str) -> DataFrame:
    """Numbers rows of each key after the highest that ``start`` (keys, name) has given out."""
    numbered = rows.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    if start is None:
        return numbered
    high = start.groupBy(*keys).agg(F.max(name).alias("_high"))
    return numbered.join(high, list(keys), "left").withColumn(name, F.col(name) + F.coalesce("_high", F.lit(0))).drop("_high")


def guarded_update(rows: DataFrame, guard: Column, **changes: Column) -> DataFrame:
    """State transition: columns change only where the guard holds."""
    return rows.withColumns({c: F.when(guard, v).otherwise(F.col(c)) for c, v in changes.items()})


def rate_window(rows: DataFrame, keys: Sequence[str], ts: str, seconds: int, name: str = "recent") -> DataFrame:
    """How many rows of the key came within the last seconds, the row itself included."""
    when = F.unix_micros(F.col(ts).cast("timestamp"))
    return rows.withColumn(name, F.count(F.lit(1)).over(W.partitionBy(*keys).orderBy(when).rangeBetween(-seconds * 1_000_000, 0)))
