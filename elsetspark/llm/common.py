"""Shared plumbing of the training-data operators: tables, shared storage, batch sizes."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of one Arrow batch sent to a Python worker; a batch is the unit of memory there.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir; a temporary one where that is unset, on a local master only (tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = getattr(shared_dir, "local", None) or tempfile.mkdtemp(prefix="elsetspark-")
        shared_dir.local = base
    return f"{base.rstrip('/')}/elsetspark-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables written to the shared folder to cut lineage.

    Every table survives the loss of any executor. drop() removes tables that no later step
    reads; the ones a returned DataFrame still reads go when the session's process ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, shared_dir(spark), 0
        atexit.register(self._end)

    def _end(self) -> None:
        try:
            remove(self.spark, self.root)
        except Exception:  # the JVM may be gone already at exit
            pass

    def write(self, df: DataFrame, compression: str = "snappy") -> DataFrame:
        self.n += 1
        path = f"{self.root}/t{self.n}"
        df.write.option("compression", compression).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            remove(self.spark, df._scratch)


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, whatever the length of a text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver notice unreferenced shuffles, so that their files go before the next step."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
