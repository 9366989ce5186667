"""Cut lineage: tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine's own only where it is unset in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = getattr(shared_dir, "own", None) or "file://" + tempfile.mkdtemp(prefix="emberline-graph-")
        shared_dir.own = base
    return base.rstrip("/")


def place(spark: SparkSession, what: str) -> str:
    """A fresh place in the shared folder. It is deleted when the driver exits, or before by drop."""
    path = f"{shared_dir(spark)}/emberline/{what}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def drop(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _made:
        try:
            drop(spark, path)
        except Exception:  # the JVM may have gone first
            return


def cut(df: DataFrame, what: str) -> DataFrame:
    """df, written and read back: later jobs don't recompute it, and a lost executor loses none of it."""
    path = place(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Steps:
    """A table that grows by steps, each written once to a folder of its own."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.home, self.paths, self.schema = spark, place(spark, what), [], None

    def add(self, df: DataFrame) -> DataFrame:
        path = f"{self.home}/{len(self.paths):05d}"
        df.write.parquet(path)
        self.paths.append(path)
        self.schema = df.schema
        return self.spark.read.schema(self.schema).parquet(path)

    def table(self) -> DataFrame:
        """All steps so far."""
        return self.spark.read.schema(self.schema).parquet(*self.paths)
