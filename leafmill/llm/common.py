"""Helpers that several corpus operators share: the shared folder, written tables, global order."""

from __future__ import annotations

import tempfile
import uuid
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.tables import bounded_batches, give_back, task  # noqa: F401

#: Words as the contracts define them: runs without ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: Words of letters and digits, after A-Z has been lower-cased.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only on a local master."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='leafmill-')}"
        sc.setCheckpointDir(found)
    return found.rstrip("/")


class Written:
    """Tables written to the shared folder to cut lineage; `drop` removes those no longer read."""

    all: ClassVar[list[Written]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.names = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", set()
        Written.all.append(self)

    def table(self, df: DataFrame, name: str, *parts: str) -> DataFrame:
        """Writes df, in folders by the columns `parts`, and reads it again."""
        path = f"{self.root}/{name}"
        self.names.add(name)
        df.write.mode("overwrite").partitionBy(*parts).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self.names.discard(name)
            self._delete(f"{self.root}/{name}")

    def drop_others(self, *names: str) -> None:
        """Removes all tables but those named."""
        self.drop(*(self.names - set(names)))

    def _delete(self, path: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    @classmethod
    def written_so_far(cls) -> int:
        return len(cls.all)

    @classmethod
    def remove_since(cls, mark: int) -> None:
        """Removes the tables of all operators that began after `written_so_far` was `mark`, once their results are stored."""
        for w in cls.all[mark:]:
            w._delete(w.root)
        del cls.all[mark:]


def free_shuffles(spark: SparkSession) -> None:
    """Ask for the removal of shuffle files whose tables are gone, before the next large step.

    Spark's scheduler holds on to the last job, so a small one goes first.
    """
    import gc

    spark.range(1).count()
    gc.collect()
    spark._jvm.System.gc()


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def small(df: DataFrame, rows: int) -> DataFrame:
    """A hint to broadcast `df`, only after a count has shown that it has no more than `rows` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def in_order(df: DataFrame, keys: list[Column], written: Written, name: str) -> DataFrame:
    """`df` range-partitioned and sorted by `keys`, written once, with its place in that order.

    Adds `_part` (ordinal of the range) and `_at` (increasing in the global order). The table is
    written before the places are used, so a lost executor cannot change them.
    """
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    return written.table(placed, name).withColumn("_part", F.shiftright("_at", 33).cast("int"))


def with_offsets(placed: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds to rows of `in_order`: `name`_before, the sum of `value` over all earlier ranges, and `name`_all.

    One row for each range is summed up and broadcast: their number is that of the shuffle
    partitions, whatever the input.
    """
    parts = placed.groupBy("_part").agg(F.sum(value).alias("_sum"))
    order = Window.orderBy("_part")
    parts = parts.select(
        "_part",
        F.coalesce(F.sum("_sum").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"{name}_before"),
        F.sum("_sum").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(f"{name}_all"),
    )
    return placed.join(F.broadcast(parts), "_part")


def running_total(placed: DataFrame, value: str, name: str) -> DataFrame:
    """Adds `name`: the sum of `value` up to and with this row in the global order of `in_order`."""
    within = F.sum(value).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    out = with_offsets(placed, F.col(value), f"_{name}")
    return out.withColumn(name, within + F.col(f"_{name}_before")).drop(f"_{name}_before", f"_{name}_all")


#: For bytes.translate: A-Z lower-cased and everything that is no letter, digit or part of a non-ASCII character a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def alnum_words(text: bytes) -> list[bytes]:
    """The words of letters and digits of a text in UTF-8, with A-Z lower-cased."""
    return text.translate(WORD_BYTES).split()


def text_bytes(column) -> list[bytes]:
    """An Arrow column of strings as UTF-8 bytes; null is empty."""
    import pyarrow as pa

    return [b if b is not None else b"" for b in column.cast(pa.large_binary()).to_pylist()]
