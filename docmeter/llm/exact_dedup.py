"""Exact deduplication as a stateful stream.

Each text is reduced to the SHA-256 of its normalised form. A streaming aggregation
keeps, for each digest and for ever, the stable identifier of the row that stays, its
content locator (file and row) and the number of rows seen; the state lives in RocksDB
on disk and has neither watermark nor time-out. Digests that were hit more than once
are then checked on full bytes: texts of one digest that differ are told apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import ASCII_SPACE, scratch_path, settings

#: Least number of state stores, and the bytes of input above which there is another one. A store takes 5 MB of disk even
#: when it is nearly empty, and their number is fixed for the life of a stream, whatever batch queries shuffle by.
STATE_STORES, STORE_BYTES = 48, 256 << 20

#: So many digests with several rows (a number each, 32 MB at most) are broadcast to find the rows whose bytes are compared.
BROADCAST_HITS = 1 << 21

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "spark.sql.streaming"


def normalised(text: str | Column = "text") -> Column:
    """Null counts as empty; each run of ASCII white space becomes one space."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(col, F.lit("")), ASCII_SPACE, " ")


def _digested(source: DataFrame, id_col: str, text: str, *more: Column) -> DataFrame:
    body = normalised(text)
    return source.select(
        F.col(id_col).alias("doc_id"),
        F.sha2(body, 256).alias("digest"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
        *more,
    )


def _keep() -> Column:
    """The smallest of these stays: null ids come last, and a repeated id is told apart by its place."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")).alias("keep")


def keeper_state(
    spark: SparkSession, path: str, schema: StructType, id_col: str, text: str, files_per_batch: int | None = None
) -> DataFrame:
    """Run the stream over ``path`` until all its files are read; one row per digest: keep (struct) and n."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    path = path.rstrip("/")
    # As a pattern that matches just this path, it may be a single file too.
    rows = _digested(reader.parquet(f"{path[:-1]}[{path[-1]}]"), id_col, text)
    state = rows.groupBy("digest").agg(_keep(), F.count(F.lit(1)).alias("n"))
    out = scratch_path(spark, "exact-dedup")

    def emit(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/changes/epoch={epoch}")

    stores = max(STATE_STORES, _bytes(spark, path) // STORE_BYTES)
    with settings(spark, {f"{_STATE}.stateStore.providerClass": ROCKSDB, f"{_STATE}.internal.stateStore.partitions": str(stores)}):
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{out}/stream")
            .trigger(availableNow=True)
            .foreachBatch(emit)
            .start()
        )
        query.awaitTermination()
    shape = state.schema
    if not _exists(spark, f"{out}/changes"):
        return spark.createDataFrame([], shape)
    changes = spark.read.schema(StructType([*shape, StructField("epoch", LongType())])).parquet(f"{out}/changes")
    return changes.groupBy("digest").agg(F.max_by("keep", "epoch").alias("keep"), F.max("n").alias("n"))


def _bytes(spark: SparkSession, path: str) -> int:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def exact_dedup(
    spark: SparkSession, path: str, id_col: str = "doc_id", text: str = "text", files_per_batch: int | None = None
) -> DataFrame:
    """One row per row of the Parquet table at ``path``: doc_id, keep_id, group_size, kept, text_sha256, file, row.

    * Null texts and empty texts are one group. Of equal texts the smallest id stays; null ids come last. Of rows that
      repeat an id and a text, the one that comes first by file and place is kept.
    * Texts of any length are digested and compared whole. An empty table gives an empty table. Other columns of the
      table are not read, so their names and nulls don't matter; file and row locate the whole record.
    * A hot text is counted before the shuffle, in the state as in the check on full bytes.
    """
    table = spark.read.parquet(path)
    state = keeper_state(spark, path, table.schema, id_col, text, files_per_batch)
    rows = _digested(table, id_col, text)

    # Hits are compared byte by byte. Copies meet in the map side already, so a hot text is not gathered in one task.
    hits = state.where("n > 1").select(F.xxhash64("digest").alias("hit"))
    hits = F.broadcast(hits) if hits.count() <= BROADCAST_HITS else hits
    bodies = table.select(normalised(text).alias("body")).withColumn("digest", F.sha2("body", 256))
    bodies = bodies.join(hits, F.xxhash64("digest") == F.col("hit"), "left_semi")
    checked = bodies.groupBy("digest").agg(F.min("body").alias("a"), F.max("body").alias("b"))
    if checked.where("a <> b").select("digest").isEmpty():
        return _decide(rows, state)
    return by_full_text(table, id_col, text)


def _decide(rows: DataFrame, state: DataFrame, on: str = "digest") -> DataFrame:
    return rows.join(state, on).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        ((F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
        "file",
        "row",
    )


def by_full_text(table: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The way for colliding digests: equal bytes decide, not digests."""
    rows = _digested(table, id_col, text, normalised(text).alias("body"))
    state = rows.groupBy("body").agg(_keep(), F.count(F.lit(1)).alias("n"))
    return _decide(rows, state, "body")
