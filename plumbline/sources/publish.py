"""Publication of tables: staged, audited, then swapped by a manifest; and books of days, overwritten a day at a time.

All files are reached through the Hadoop file system of their path, so any store that Spark writes to will do.
"""

from __future__ import annotations

import datetime as dt
import json
import tempfile
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import state


class NotPublished(Exception):
    """The gates that failed are its arguments; what was published before is untouched."""


def work_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a temporary one on a local master only."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="work-")
    return known


class Store:
    """A folder in whatever file system its path names."""

    def __init__(self, spark: SparkSession, root: str):
        jvm, self._path = spark.sparkContext._jvm, spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.root = root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._charset = jvm.java.nio.charset.StandardCharsets.UTF_8
        self._io = jvm.org.apache.commons.io.IOUtils

    def _at(self, name: str):
        return self._path(f"{self.root}/{name}" if name else self.root)

    def names(self, name: str = "") -> list[str]:
        at = self._at(name)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._io.toString(stream, self._charset)
        finally:
            stream.close()

    def write_once(self, name: str, text: str) -> bool:
        """Creates the file whole, or not at all if there is one of that name."""
        part = self._at(f"{name}.part")
        stream = self._fs.create(part, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        made = not self._fs.exists(self._at(name)) and self._fs.rename(part, self._at(name))
        if not made:
            self._fs.delete(part, False)
        return made

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


# --- write, audit, publish -------------------------------------------------------------------------------------------


def manifest(spark: SparkSession, root: str) -> dict | None:
    """What is published: version, number, rows; None before the first publication."""
    store = Store(spark, root)
    numbers = [n for n in store.names("manifests") if n.endswith(".json")]
    return json.loads(store.read(f"manifests/{numbers[-1]}")) if numbers else None


def published(spark: SparkSession, root: str) -> DataFrame:
    """The published table. [SNK09]"""
    now = manifest(spark, root)
    if now is None:
        raise NotPublished("nothing was published yet")
    return spark.read.parquet(f"{root}/versions/{now['version']}")


def publish(df: DataFrame, root: str, version: str, ratio: float = 0.6, measures: Mapping[str, Column] | None = None, rules: Mapping[str, Column] | None = None, keep: int = 2, force: bool = False) -> dict:
    """Writes the table beside the published one, judges what was written, and only then points the manifest at it. [SNK09, SNK13]

    The written version must have at least ``ratio`` of the rows it would replace, and hold to ``rules`` over ``measures``
    (aggregates of the written rows, beside new_rows and old_rows); unknown fails. Failure raises NotPublished with the
    rules' names, and readers go on with the old version, whose files nobody touches. ``version`` names the attempt: the one
    published already is left as it is, so a job that runs again after success changes nothing, and after a failure
    it overwrites only its own files. Two writers with the same next number: the second finds the manifest taken and fails. Of old
    versions the last ``keep`` stay for readers that still read them. ``force`` leaves the ratio out.
    """
    spark = df.sparkSession
    before = manifest(spark, root)
    if before and before["version"] == version:
        return before
    df.write.mode("overwrite").parquet(f"{root}/versions/{version}")
    written = spark.read.parquet(f"{root}/versions/{version}")
    old_rows = before["rows"] if before else 0
    row = written.agg(F.count("*").alias("new_rows"), *[c.alias(n) for n, c in (measures or {}).items()]).withColumn("old_rows", F.lit(old_rows).cast("long"))
    every = dict(rules or {}) if force else {"enough rows": state.publishable(F.col("new_rows"), F.col("old_rows"), ratio), **(rules or {})}
    judged = row.select("new_rows", F.array(*[F.when(F.coalesce(c, F.lit(False)), None).otherwise(F.lit(n)) for n, c in every.items()]).cast("array<string>").alias("failed")).first()
    failed = sorted(x for x in judged.failed if x)
    if failed:
        raise NotPublished(*failed)
    now = {"number": (before["number"] if before else 0) + 1, "version": version, "rows": judged.new_rows, "before": ([before["version"], *before["before"]] if before else [])[:keep]}
    store = Store(spark, root)
    if not store.write_once(f"manifests/{now['number']:012d}.json", json.dumps(now)):
        raise NotPublished("another version was published meanwhile")
    for old in ([before["version"], *before["before"]] if before else [])[keep:]:
        store.delete(f"versions/{old}")
    return now


# --- books of days ---------------------------------------------------------------------------------------------------


def recorded_days(spark: SparkSession, root: str, day: str = "day") -> list[dt.date]:
    """The days that a book holds, from the names of its partitions."""
    return sorted(dt.date.fromisoformat(n.split("=", 1)[1]) for n in Store(spark, root).names() if n.startswith(f"{day}=") and n[-10:-9].isdigit())


def append_days(rows: DataFrame, root: str, day: str = "day", keep: int = 10) -> list[dt.date]:
    """Writes each day of the rows over that day of the book, and drops days beyond ``keep`` days before the newest recorded. [SNK07, SNK12, INC07]

    Days that the rows don't hold stay as they are, so writing a day again changes nothing, and a day read anew replaces its
    old reading. The newest day is the book's own, not the clock's. Rows without a day are refused. Days are few, so they are
    told by their partitions' names; the days that stay are returned.
    """
    spark = rows.sparkSession
    stated = F.when(F.col(day).isNull(), F.raise_error(F.lit(f"a row without {day}")).cast("date")).otherwise(F.col(day).cast("date"))
    rows.withColumn(day, stated).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(root)
    held = recorded_days(spark, root, day)
    store = Store(spark, root)
    first = held[-1] - dt.timedelta(keep - 1) if held else None
    for x in held:
        if x < first:
            store.delete(f"{day}={x.isoformat()}")
    return [x for x in held if x >= first]


def book(spark: SparkSession, root: str, schema: str, day: str = "day") -> DataFrame:
    """The rows of a book; an empty one before its first day. A condition on the day prunes partitions. [SNK07]"""
    if not recorded_days(spark, root, day):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(root)
