"""What the operators of this subpackage share: the scratch area and distributed running sums."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanframe.session import BATCH_BYTES, bound_batches  # noqa: F401  the operators take both from here


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only where the session names none (local tests) a folder of this machine is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"gleanframe-{os.getuid()}")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def slices(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Runs (from, to) of rows that take at most ``limit`` bytes together, or are a single longer row."""
    lo, hi, held = 0, 0, 0
    for size in sizes:
        if hi > lo and held + size > limit:
            yield lo, hi
            lo, held = hi, 0
        hi += 1
        held += size
    if hi > lo:
        yield lo, hi


def text_slices(texts: Sequence[str | None], limit: int) -> Iterator[tuple[int, int]]:
    return slices((4 * len(t or "") if t and not t.isascii() else len(t or "") for t in texts), limit)


class Scratch:
    """Tables written to the shared folder, so that later steps never recompute earlier ones.

    A table in the shared folder survives the loss of any executor. ``keep_only`` removes what no
    later step reads; what the returned frame still reads has to stay.
    """

    def __init__(self, spark: SparkSession, name: str):
        bound_batches(spark)
        self.spark, self.names = spark, set()
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str, df: DataFrame, codec: str = "zstd") -> DataFrame:
        df.write.mode("overwrite").option("compression", codec).parquet(self.path(name))
        self.names.add(name)
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def keep_only(self, *names: str) -> None:
        self.drop(*(self.names - {*names}))

    def drop(self, *names: str) -> None:
        self.names -= {*names}
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(self.path(name))
            at.getFileSystem(conf).delete(at, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def running_start(scratch: Scratch, name: str, df: DataFrame, order: Sequence[Column | str], amount: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``amount`` over all rows before it in ``order``.

    Rows are range-partitioned, summed within each range, and only the ranges' totals (one row
    for each partition) meet in one task. ``order`` must be total up to equal rows. The sorted
    table is written first: the numbers of its ranges stay the same if an executor is lost.
    """
    spark = scratch.spark
    ranged = df.repartitionByRange(shuffle_parts(spark), *order).withColumn("__range", F.spark_partition_id())
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = scratch.table(name, ranged.withColumn("__upto", F.sum(amount).over(inside)))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = summed.groupBy("__range").agg(F.sum(amount).alias("__total"))
    base = totals.select("__range", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__base"))
    # One row for each shuffle partition: bounded by a setting, not by the data.
    return summed.join(F.broadcast(base), "__range").withColumn(out, F.col("__base") + F.col("__upto") - F.col(amount)).drop("__range", "__upto", "__base")
