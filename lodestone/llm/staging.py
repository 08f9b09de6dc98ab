"""Tables written once to the shared folder, so lineage ends there and lost executors cost a re-read."""

from __future__ import annotations

import contextlib
import math
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: The most a side that is broadcast may hold.
BROADCAST_BYTES = 16 << 20
#: The most of a table that a Python worker gets at once, unless one row is larger.
BATCH_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a folder of this machine where none is set in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def in_small_batches(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """df.mapInArrow(run, schema) with batches bounded by bytes, not rows alone, as one text may be as long as thousands.

    The bound is a setting of the session that is read when the result is used, so it stays set.
    """
    df.sparkSession.conf.set(_ARROW_BYTES, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


@contextlib.contextmanager
def _shuffles_freed(spark: SparkSession):
    """Shuffle files of what runs inside go when it ends; the written table replaces them."""
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE_SHUFFLES)
        else:
            spark.conf.set(_FREE_SHUFFLES, before)


class Staged:
    """A table in the shared folder: `df` reads it, `drop` deletes it; what isn't dropped goes when the session's JVM ends."""

    def __init__(self, df: DataFrame, partition_by: str | None = None):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/lodestone/{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        with _shuffles_freed(self.spark):
            writer.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        files, path = self._place()
        files.deleteOnExit(path)

    def _place(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def rows(self) -> int:
        return self.df.count()

    def row_bytes(self) -> int:
        """About what a row holds, as JSON text; a pass over the table."""
        return math.ceil(self.df.agg(F.avg(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 1)

    def drop(self) -> None:
        files, path = self._place()
        files.delete(path, True)
        files.cancelDeleteOnExit(path)

    def for_join(self, row_bytes: int) -> DataFrame:
        """With a broadcast hint if its counted rows fit BROADCAST_BYTES; else Spark picks, and splits skew."""
        return F.broadcast(self.df) if self.rows() * row_bytes <= BROADCAST_BYTES else self.df


def without_repeats(docs: DataFrame, keys: list[str]) -> DataFrame:
    """docs with each combination of keys once: the row of the least hash over all columns. Shuffles whole rows only if some repeat."""
    if docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return docs
    first = W.partitionBy(*keys).orderBy(F.xxhash64(*docs.columns))
    return docs.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, even where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)
