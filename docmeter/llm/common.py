"""Helpers shared by the operators: shared scratch tables, column checks, weak hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch while a table is written: whole texts and what is made of them are held at once.
BATCH_ROWS = 2_000
ASCII_SPACE = r"[\x20\x09-\x0D]+"
ASCII_WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Only a local master may do without; it gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _local_dir()


@cache
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-docmeter-")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/docmeter/{name}-{uuid.uuid4().hex}"


#: Paths written in each scope that is open, the innermost last.
_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialized inside are deleted at the end, but for those that are kept: they belong to the scope around."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        for path in made:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings of the session that hold inside only."""
    old = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Cut lineage: write ``df`` once as Parquet in the shared folder and read it back.

    A lost executor then costs only the tasks it ran, never the steps before. See ``scratch`` for when the table goes;
    what no scope holds goes when the driver ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    # What was shuffled for the table is not needed once it is written.
    rows = int(spark.conf.get(ARROW_ROWS))
    with settings(spark, {SHUFFLE_CLEANUP: "true", ARROW_ROWS: str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS)}):
        df.write.option("compression", "zstd").parquet(path)
    scope = _SCOPES[-1 - keep] if len(_SCOPES) > keep else None
    if scope is not None:
        scope.append(path)
    else:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch, rows: int = 500) -> Iterator:
    """A record batch in parts, so that what is made of whole texts stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def drop_outputs(df: DataFrame, *names: str) -> DataFrame:
    """An input column that has the name of an output gives way to the output (case-insensitive, as Spark resolves names)."""
    low = {n.lower() for n in names}
    return df.select(*[col(c) for c in df.columns if c.lower() not in low])


def map_arrow(df: DataFrame, run, added: dict[str, DataType]) -> DataFrame:
    """``run`` over the record batches of ``df``; it returns them with columns appended. Columns meet it by place, so that their names may hold dots."""
    numbered = df.select(*[col(c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    schema = StructType([*numbered.schema.fields, *[StructField(f"c{i}", t) for i, t in enumerate(added.values(), len(df.columns))]])
    return numbered.mapInArrow(run, schema).toDF(*df.columns, *added)


def appended(batch, columns: list):
    """A record batch with further columns, named by place."""
    arrays = [*batch.columns, *columns]
    return type(batch).from_arrays(arrays, [f"c{i}" for i in range(len(arrays))])


def text_or_empty(name: str | Column = "text") -> Column:
    return F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit(""))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
