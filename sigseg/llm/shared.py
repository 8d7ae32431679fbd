"""Tables written to the folder that driver and executors share.

They cut the lineage between steps: if an executor is lost, its part of a step
is read again from the written table instead of being computed from the start.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table of a few short columns up to which it is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 200_000
#: The same where a plan broadcasts several such tables, or a loop one after another: the driver builds each and holds them until it collects its garbage.
FEW_ROWS = 10_000
#: Tasks over which a join beyond that spreads a key.
SALTS = 16
#: Rows from which a counted key is salted, and such keys at most; if there are more, the rows are raised.
HOT_ROWS = 50_000
HOT_KEYS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a session with local executors gets a folder of its own; a cluster has none that all see, so that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sigseg-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """A folder of its own in the shared folder, for one call of an operator.

    Tables that nothing reads any more are dropped on the way; what the
    returned DataFrame still reads goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        path = self._path(self.folder)
        self._files(path).deleteOnExit(path)

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def _files(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """``df``, written as Parquet and read again."""
        schema = df.schema
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            path = self._path(self.path(name))
            self._files(path).delete(path, True)


def small(df: DataFrame, rows: int, limit: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are within the limit."""
    return F.broadcast(df) if rows <= (BROADCAST_ROWS if limit is None else min(limit, BROADCAST_ROWS)) else df


def lookup(big: DataFrame, table: DataFrame, rows: int, keys: list[str], spread: str, how: str = "left", count: str | None = None, limit: int | None = None) -> DataFrame:
    """``big`` joined with ``table``, which has each key once and ``rows`` rows.

    Within the limit ``table`` is broadcast. Beyond, both sides are shuffled by the
    keys and a salt from the column ``spread`` of ``big``, so that a key that a
    third of all rows hold meets SALTS tasks; each row of ``table`` is copied that
    often. ``count`` names a column of ``table`` with the rows of ``big`` that hold
    a key: then only keys of more than HOT_ROWS are salted and copied. ``limit``
    is of a table whose rows are not short, or one of several (0: never broadcast).
    """
    if rows <= (BROADCAST_ROWS if limit is None else min(limit, BROADCAST_ROWS)):
        return big.join(F.broadcast(table), keys, how)
    salt, copies = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"), F.sequence(F.lit(0), F.lit(SALTS - 1))
    if count is None:
        return big.withColumn("__salt", salt).join(table.withColumn("__salt", F.explode(copies)), [*keys, "__salt"], how).drop("__salt")
    least = HOT_ROWS
    while table.filter(F.col(count) > least).count() > HOT_KEYS:
        least *= 8
    hot = table.filter(F.col(count) > least).select(*keys, F.lit(True).alias("__hot"))
    flagged = big.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.when(F.col("__hot"), salt).otherwise(0)).drop("__hot")
    parts = table.withColumn("__salt", F.explode(F.when(F.col(count) > least, copies).otherwise(F.array(F.lit(0)))))
    return flagged.join(parts, [*keys, "__salt"], how).drop("__salt")
