"""Sharding by a two-pass external shuffle.

Pass one scatters whole records uniformly into memory-sized buckets by a seeded
hash of their key; pass two permutes each bucket with Spark's ``shuffle``
function, which is a Fisher-Yates shuffle, and cuts the resulting global order
into shards whose row counts differ by one at most.

Each bucket is exactly one shuffle partition (``repartitionById``) and is sorted
before it is permuted, and the generator of ``shuffle`` is seeded by the seed and
the partition number. A bucket that is computed again after a lost executor
therefore comes out the same, and so does a second run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, drop_outputs, fresh

BUCKET_BYTES = 64 << 20
#: Prefix sums over buckets are taken within groups of so many, then over the groups.
GROUP = 1024
#: Offsets (24 bytes a bucket) are broadcast up to so many buckets, 64 TB of text; beyond that they are joined by a shuffle.
BROADCAST_BUCKETS = 1 << 20


def shard_rows(
    docs: DataFrame,
    num_shards: int,
    key: str = "doc_id",
    text: str = "text",
    seed: int = 17,
    bucket_bytes: int = BUCKET_BYTES,
    shard_col: str = "shard",
    slot_col: str = "slot",
) -> DataFrame:
    """All columns of ``docs`` plus shard (0 to ``num_shards`` - 1) and slot (gapless from 0 in each shard).

    Law ``rows``: the shards' counts differ by one at most, whatever the keys and sizes are.

    * Rows are never dropped: null keys, null texts and repeated rows each take a slot of their own. Rows with the
      same key and text share a bucket; keys alone and texts alone may repeat at will.
    * An empty table gives an empty table. Columns named as an output are replaced by it.
    * A bucket holds about ``bucket_bytes`` of text; one longer text makes its bucket as much larger.
    """
    if num_shards < 1:
        raise ValueError("num_shards must be positive")
    docs = drop_outputs(docs, shard_col, slot_col)
    total = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 1).alias("b")).first()["b"] or 0
    buckets = max(1, -(-int(total) // bucket_bytes))
    # Rows of one key are told apart by their texts, so a hot key is spread as well.
    scatter = F.xxhash64(F.lit(seed), col(key), col(text))
    bucket = F.pmod(scatter, F.lit(buckets)).cast("int")

    counts = docs.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    part = (F.col("_bucket") / GROUP).cast("int")
    within = W.partitionBy("_part").orderBy("_bucket")
    counts = counts.withColumn("_part", part).withColumn("_below", F.sum("_n").over(within) - F.col("_n"))
    groups = counts.groupBy("_part").agg(F.sum("_n").alias("_n"))
    groups = groups.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    offsets = counts.join(groups, "_part").select("_bucket", (F.col("_below") + F.col("_before")).alias("_offset"))

    if buckets <= BROADCAST_BUCKETS:
        offsets = F.broadcast(offsets)

    columns = [col(c) for c in docs.columns]
    at, by = fresh(docs, "bucket", "order")
    dealt = (
        docs.withColumn(at, bucket)
        .withColumn(by, scatter)
        .repartitionById(buckets, at)
        .sortWithinPartitions(at, by, col(key), F.crc32(F.coalesce(col(text), F.lit(""))))
    )
    shuffled = (
        dealt.groupBy(F.col(at).alias("_bucket"))
        .agg(F.collect_list(F.struct(*columns)).alias("_rows"))
        .select("_bucket", F.posexplode(F.shuffle("_rows", F.lit(seed))).alias("_pos", "_row"))
    )
    place = F.col("_offset") + F.col("_pos")
    return shuffled.join(offsets, "_bucket").select(
        "_row.*", (place % num_shards).cast("int").alias(shard_col), F.floor(place / num_shards).cast("long").alias(slot_col)
    )


def write_shards(sharded: DataFrame, path: str, shard_col: str = "shard", slot_col: str = "slot", files_per_shard: int = 1) -> None:
    """Write the shards as one Parquet folder each, rows in slot order (in ranges of slots if several files a shard)."""
    shards = sharded.repartitionByRange(max(1, files_per_shard) * 8, shard_col, slot_col)
    shards.sortWithinPartitions(shard_col, slot_col).write.partitionBy(shard_col).parquet(path)
