"""Changes to stored tables that are whole or not at all: rows of documents replaced, flagged, and deleted from several tables in order.

A table is a folder of Parquet dealt into buckets by its key. A change writes the new state of
the buckets it touches aside, then a journal entry that names them, then swaps them in by
renaming. What fails before the entry leaves the old rows; what stops after it is finished by
`recover`, however often it is run. One writer at a time changes a table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

BUCKETS = 32
#: Called with a name after each step; tests stop there.
Hook = Callable[[str], None]


def _none(_: str) -> None:
    pass


class Folder:
    """Files under a path, in any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name))) if self.exists(name) else []

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def move(self, old: str, new: str) -> None:
        self._fs.mkdirs(self._at(new).getParent())
        if not self._fs.rename(self._at(old), self._at(new)):
            raise OSError(f"{old} could not be renamed to {new} in {self.path}")

    def write(self, name: str, content: dict) -> None:
        """All of the file or nothing: written under another name and renamed."""
        draft = f"_drafts/{uuid.uuid4().hex}"
        self._fs.mkdirs(self._at("_drafts"))
        out = self._fs.create(self._at(draft))
        out.write(json.dumps(content).encode())
        out.close()
        self.delete(name)
        self.move(draft, name)

    def read(self, name: str) -> dict:
        source = self._fs.open(self._at(name))
        content = bytes(source.readAllBytes())
        source.close()
        return json.loads(content)


class Table:
    """Rows known by `key`, of which several may share one."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS):
        self.spark, self.key, self.buckets, self.files = spark, key, buckets, Folder(spark, path)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets))

    def _dealt(self, rows: DataFrame, under: str) -> None:
        """Written by bucket, large buckets in several files."""
        rows.withColumn("bucket", self.bucket()).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.files.path}{under}")

    def create(self, rows: DataFrame) -> None:
        self.files.delete("")
        self._dealt(rows, "")
        self.files.write("_schema", {"schema": rows.schema.jsonValue()})

    def read(self) -> DataFrame:
        """The rows, after what a writer left half done is finished."""
        self.recover()
        schema = StructType.fromJson(self.files.read("_schema")["schema"])
        return self.spark.read.schema(schema.add("bucket", LongType())).parquet(self.files.path)

    def rows(self) -> DataFrame:
        return self.read().drop("bucket")

    def change(self, keys: DataFrame, changed: Callable[[DataFrame], DataFrame], after: Hook = _none) -> None:
        """Puts changed(rows of the keys) in the place of the rows of `keys`; null keys name nothing."""
        named = keys.select(self.key).filter(F.col(self.key).isNotNull()).distinct()
        touched = [r[0] for r in named.select(self.bucket().alias("b")).distinct().collect()]
        if not touched:
            return
        job = uuid.uuid4().hex
        current = self.read().filter(F.col("bucket").isin(touched))
        own = named.withColumn("bucket", self.bucket())
        stays = current.join(own, [self.key, "bucket"], "left_anti").drop("bucket")
        fresh = changed(current.join(own, [self.key, "bucket"], "left_semi").drop("bucket")).select(stays.columns)
        self._dealt(stays.unionByName(fresh), f"/_aside/{job}")
        after("aside")
        self.files.write(f"_journal/{job}", {"buckets": sorted(touched)})
        after("journal")
        self._finish(job, after)

    def _finish(self, job: str, after: Hook = _none) -> None:
        for bucket in (f"bucket={b}" for b in self.files.read(f"_journal/{job}")["buckets"]):
            if not self.files.exists(f"_old/{job}/{bucket}") and self.files.exists(bucket):
                self.files.move(bucket, f"_old/{job}/{bucket}")
            after(f"out {bucket}")
            if self.files.exists(f"_aside/{job}/{bucket}"):
                self.files.move(f"_aside/{job}/{bucket}", bucket)
            after(f"in {bucket}")
        self.files.delete(f"_journal/{job}")
        for part in ("_old", "_aside"):
            self.files.delete(f"{part}/{job}")

    def recover(self) -> None:
        """Finishes what has a journal entry and takes back what has none."""
        entries = self.files.names("_journal")
        for job in entries:
            self._finish(job)
        for job in self.files.names("_aside"):
            self.files.delete(f"_aside/{job}")

    def replace(self, rows: DataFrame, documents: DataFrame | None = None, size: int | None = None, vector: str = "vector", after: Hook = _none) -> None:
        """All rows of the documents (those of `rows`, unless others are named) make way for `rows`; without rows they are deleted.

        With a size every row's vector must have it, without nulls; a fault is raised before
        anything is written. rows must belong to the documents.
        """
        faults = [("no key", F.col(self.key).isNull())]
        if size is not None:
            faults += [("no vector", F.col(vector).isNull()), ("vector of another size", F.size(vector) != size), ("null in a vector", F.exists(vector, lambda v: v.isNull()))]
        counted = rows.agg(*[F.coalesce(F.count_if(F.coalesce(wrong, F.lit(False))), F.lit(0)).alias(name) for name, wrong in faults]).first().asDict()
        if any(counted.values()):
            raise ValueError(f"nothing was written: {', '.join(f'{n} rows with {name}' for name, n in counted.items() if n)}")
        if documents is not None and not rows.join(documents, self.key, "left_anti").isEmpty():
            raise ValueError("nothing was written: rows of other documents")
        self.change(documents if documents is not None else rows, lambda old: rows, after)

    def flag(self, ids: DataFrame, column: str, value: Column) -> None:
        """Sets a column of the rows of the ids."""
        self.change(ids, lambda old: old.withColumn(column, value.cast(old.schema[column].dataType)))


class Cascade:
    """Documents deleted from several tables in the order given, the table of documents last, so that a run that stops can be told and resumed."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Table]):
        self.spark, self.files, self.tables = spark, Folder(spark, path), tables

    def delete(self, ids: DataFrame, after: Hook = _none) -> str:
        job = uuid.uuid4().hex
        ids.distinct().write.parquet(f"{self.files.path}/ids/{job}")
        self.files.write(f"jobs/{job}", {"done": []})
        after("started")
        self.resume(after)
        return job

    def resume(self, after: Hook = _none) -> None:
        """Carries on every job that isn't done; a step that was done stays done if it is run again."""
        for job in self.files.names("jobs"):
            done = self.files.read(f"jobs/{job}")["done"]
            ids = self.spark.read.parquet(f"{self.files.path}/ids/{job}")
            for name, table in self.tables.items():
                if name in done:
                    continue
                table.change(ids, lambda old: old.limit(0))
                after(f"deleted {name}")
                done = [*done, name]
                self.files.write(f"jobs/{job}", {"done": done})
                after(f"noted {name}")
            self.files.delete(f"jobs/{job}")
            self.files.delete(f"ids/{job}")

    def open_jobs(self) -> dict[str, list[str]]:
        """The tables that each unfinished job is done with."""
        return {job: self.files.read(f"jobs/{job}")["done"] for job in self.files.names("jobs")}
