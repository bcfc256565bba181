"""Intermediate tables in the folder all executors share.

Long or iterative jobs cut their lineage by writing a parquet table and reading
it back: unlike a cached block the files survive the loss of an executor.  The
folder is the one the session names in `spark.checkpoint.dir`.  Only a session
in local mode (one process, as in tests) may do without the setting.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """URI of the shared folder; raises ValueError on a cluster that names none."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        set_already = context._jsc.sc().getCheckpointDir()
        if set_already.isDefined():
            named = set_already.get()
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="recollex-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", f"file://{named}")
        named = f"file://{named}"
    return named.rstrip("/")


#: With it Spark deletes the shuffle files of a statement when that ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes in this block leave no shuffle files: what they wrote is read from then on."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


class Scratch:
    """Tables written by one run of one operator."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/recollex-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, frame: DataFrame) -> DataFrame:
        """Write `frame` and return it read back, with no lineage behind it."""
        path = self._next()
        with shuffles_dropped(self.spark):
            frame.write.parquet(path)
        kept = self._read(frame.schema, path)
        kept._recollex_path = path
        return kept

    def keep_bucketed(self, frame: DataFrame, key: str, buckets: int) -> DataFrame:
        """As `keep`, hash-bucketed by `key`: later joins and aggregates on `key`
        over as many partitions read it without a shuffle."""
        path = self._next()
        name = f"recollex_{uuid.uuid4().hex}"
        with shuffles_dropped(self.spark):
            frame.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).saveAsTable(name)
        kept = self.spark.table(name)
        kept._recollex_path = path
        kept._recollex_table = name
        return kept

    def drop(self, kept: DataFrame) -> None:
        """Delete a table that no later plan reads."""
        if name := getattr(kept, "_recollex_table", None):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(kept._recollex_path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _next(self) -> str:
        self.count += 1
        return f"{self.root}/{self.count}"

    def _read(self, schema: StructType, path: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that operators keep in the shared folder.  Results that were not written out yet read
    them, so write those first; with `spark.cleaner` checkpoints are not affected."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in system.globStatus(jvm.org.apache.hadoop.fs.Path(folder, "recollex-*")) or ():
        system.delete(found.getPath(), True)


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
