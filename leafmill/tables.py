"""Where jobs cut their lineage, and how large the batches of Python tasks are."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(df: DataFrame) -> str:
    """The folder of spark.checkpoint.dir; one of its own only on a local master."""
    sc = df.sparkSession.sparkContext
    if not (sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()):
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='leafmill-')}")
    return sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    folder(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """A table written to the shared folder and read again: unlike a checkpoint it has its true size, which plans made in rounds need."""
    path = f"{folder(df).rstrip('/')}/leafmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out (by keys, if any) over all shuffle partitions, for small rows that each take long: files and adaptive plans cut partitions by bytes, so all would be in a few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


class Tables:
    """Tables that a reader writes in rounds; `keep` stores the last one and removes the others."""

    def __init__(self, df: DataFrame):
        self.paths: list[str] = []
        self.root = folder(df).rstrip("/")

    def stored(self, df: DataFrame, *parts: str) -> DataFrame:
        """df written, in folders by `parts`, and read again."""
        path = f"{self.root}/leafmill-{uuid.uuid4().hex}"
        df.write.partitionBy(*parts).parquet(path)
        self.paths.append(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def keep(self, df: DataFrame) -> DataFrame:
        kept = stored(df)
        for path in self.paths:
            remove(df.sparkSession, path)
        self.paths.clear()
        return kept


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def bounded_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Has Spark send Python batches of about `size` bytes, so that long texts do not make them large.

    Frames are lazy, so this stays set in the session; a size that the session has set itself is kept.
    """
    name, unset = "spark.sql.execution.arrow.maxBytesPerBatch", "7"
    if spark.conf.get(name, unset) == unset:
        spark.conf.set(name, str(size))


def give_back() -> None:
    """Returns memory that a Python worker has freed to the system, since workers live on for later tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def task(f):
    """`f` over a partition's batches; freed memory is given back after it."""

    def run(batches):
        yield from f(batches)
        give_back()

    return run
