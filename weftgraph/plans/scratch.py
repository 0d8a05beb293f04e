"""Tables written to the cluster's shared folder to cut lineage.

A written Parquet table is computed once, survives the loss of any executor
and keeps column pruning for its readers.  (``checkpoint()`` computes its plan
a second time and stores whole rows.)
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: Removes a query's shuffle files when it ends; else they stay until the driver's JVM happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: str | None = None
_roots: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent and all work is done on this machine (tests,
    a laptop) a temporary folder is made and removed at exit; a cluster's executors
    could not share it, so there the setting is required.
    """
    global _own
    named = spark.conf.get(SETTING, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {SETTING} to a folder that all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="weftgraph-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return _own


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Remove all tables that operators of this process wrote; DataFrames that read them are lost.

    Results are lazy, so no operator can know when its last table is read; a long
    session calls this between jobs.
    """
    while _roots:
        _delete(spark, _roots.pop())


class Scratch:
    """Names and removes the intermediate tables of one operator call."""

    def __init__(self, spark: SparkSession, label: str = "scratch"):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: list[tuple[DataFrame, str]] = []

    def save(self, df: DataFrame, compression: str = "zstd") -> DataFrame:
        """Write ``df`` and return a DataFrame that reads the written table."""
        self._n += 1
        path = f"{self.root}/t{self._n}"
        if self._n == 1:
            _roots.append(self.root)
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", compression).parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before) if before else self.spark.conf.unset(CLEANUP)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths.append((out, path))
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Remove tables that no later plan reads."""
        for frame, path in [x for x in self._paths if any(x[0] is f for f in frames)]:
            _delete(self.spark, path)
            self._paths = [x for x in self._paths if x[0] is not frame]
