"""Tables that a step writes for the next one, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a master on one machine may do without."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not found and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return found.rstrip("/") if found else _local_dir()


@cache
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-docmeter-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/docmeter/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows, computed once: what depends on how they were dealt to tasks stays the same however often they are read."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
