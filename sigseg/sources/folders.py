"""A folder that driver and executors share, for files on their way from a writer to a reader and for tables that many jobs read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, gone when the driver ends; with local executors only, a temporary one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sigseg-")
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


@contextmanager
def held(rows: DataFrame, name: str) -> Iterator[DataFrame]:
    """``rows`` for many jobs, written once and deleted behind the block.

    Each job has as many tasks as the written table needs; on a persisted one it
    would have one for each partition of the plan that made it, empty ones too.
    """
    spark = rows.sparkSession
    folder = scratch_folder(spark, name)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    try:
        rows.write.parquet(folder)
        yield spark.read.schema(rows.schema).parquet(folder)
    finally:
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
