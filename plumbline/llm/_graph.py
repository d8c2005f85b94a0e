"""Lineage cuts in the shared folder, look-ups by keys of any frequency, and connected components by alternating stars."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset a temporary one serves on a single machine only."""
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not known:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        known = context.getCheckpointDir()
    return known


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder. A join with a cut side is one that adaptive execution can split where a key is frequent."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint()


_kept_until: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes, at its end, the tables that ``stored`` wrote within and whatever paths were added to its list.

    To be put around a query and the writing of its result; a result read later still needs its cuts. What ``cut`` wrote is
    deleted by Spark itself once it is out of use, where spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    paths: list[str] = []
    _kept_until.append(paths)
    try:
        yield paths
    finally:
        _kept_until.remove(paths)
        for path in paths:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame) -> DataFrame:
    """The same cut as a Parquet table in the shared folder: a third of the bytes for many small rows, and slower for few."""
    path = f"{folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    if _kept_until:
        _kept_until[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key is frequent if it has more than one in so many rows; so at most so many keys are, whatever the data.
FREQUENT = 2048


def looked_up(rows: DataFrame, facts: DataFrame, keys: list[str], spread: str, times: str = "times", total: int | None = None) -> DataFrame:
    """rows joined with facts (one row per key, cut, with the number of rows of the key as ``times``) on the keys.

    The join is an inner one without a hot task: the frequent keys, FREQUENT at most, are broadcast, and their rows are dealt by
    the column ``spread``; all others are shuffled by key, where no key has more than one in FREQUENT rows. No key may be null.
    ``total``, where the caller knows it, is the number of rows or more.
    """
    if total is None:
        total = facts.agg(F.sum(times)).first()[0]
    values = [c for c in facts.columns if c not in keys]
    frequent = facts.where(F.col(times) * FREQUENT > F.lit(total or 0)).select(*keys, F.struct(*values).alias("_frequent"))
    marked = rows.join(F.broadcast(frequent), keys, "left")
    first = F.when(F.col("_frequent").isNull(), F.col(keys[0])).otherwise(F.xxhash64(spread, keys[0]))
    marked = marked.withColumn("_key", first)
    others = facts.select(F.col(keys[0]).alias("_key"), *keys[1:], F.struct(*values).alias("_other"))
    joined = marked.join(others, ["_key", *keys[1:]], "left").withColumn("_found", F.coalesce("_frequent", "_other")).where("_found IS NOT NULL")
    return joined.select(*rows.columns, *[F.col("_found")[c].alias(c) for c in values])


def components(links: DataFrame) -> DataFrame:
    """(node, component): of each node of the links (a, b), the least node that it reaches.

    Each round points every node's larger neighbours to its least one (large star), then its smaller ones and itself
    (small star); edges stay as many or fewer, and rounds grow with the logarithm of the longest path. Stops when a
    round changes nothing. A center that a large part of all edges share is a frequent key of the look-up, so its edges
    are dealt over all tasks and nothing is copied for it.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    sums = F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    mark, now = None, edges.agg(*sums).first()
    while now != mark:
        mark = now
        back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = edges.unionByName(back).groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("times")).where("times > 0")
        least = least.select("u", F.least("u", "m").alias("m"), "times")
        large = looked_up(back, least, ["u"], "v", total=mark[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("times"))
        small = looked_up(large, least, ["u"], "v", total=mark[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(*sums).first()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
