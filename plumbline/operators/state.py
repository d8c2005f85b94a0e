"""Incremental state as idempotent merges, publication gates, and integrity expectations.

State tables are DataFrames in and out; the caller writes them with overwrite of the partitions touched, so running a
day twice gives the same table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import aggregates


def carry_unread(previous: DataFrame, new: DataFrame, unread: DataFrame, key: str, today: Column, days: int = 14) -> DataFrame:
    """New rows, and of unread keys previous rows not older than so many days, their own read date kept. [INC01, INC10]"""
    old = previous.join(unread.select(key).distinct(), key, "left_semi").where(F.datediff(today, F.col("read_day")).between(0, days))
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"))


def skip_list(state: DataFrame, today: Column, ttl: int = 7, recheck: bool = False) -> DataFrame:
    """Keys to leave out: checked within the last ``ttl`` days; none on a recheck, which leaves the state as it is. [INC02]"""
    return state.where(F.datediff(today, F.col("checked")).between(0, ttl - 1)).where(F.lit(not recheck)).select("key")


def update_skip_list(state: DataFrame, visited: DataFrame, selling: DataFrame, today: Column, expire: int = 14) -> DataFrame:
    """Visited without sales: stamped today. Visited with sales: out. Others stay until they expire. One full join. [INC03]"""
    v = visited.select("key").distinct().withColumn("_visited", F.lit(True))
    s = selling.select("key").distinct().withColumn("_selling", F.lit(True))
    joined = state.join(v, "key", "full_outer").join(s, "key", "left")
    checked = F.when(F.col("_visited") & F.col("_selling").isNull(), today).when(F.col("_visited"), None).otherwise(F.col("checked"))
    return joined.select("key", checked.alias("checked")).where(F.datediff(today, F.col("checked")).between(0, expire))


def skippable(skips: DataFrame, specials: DataFrame, live: DataFrame) -> DataFrame:
    """Of the skip list, keys without a special that aren't live elsewhere. [INC04]"""
    return skips.join(specials.select("key"), "key", "left_anti").join(live.select("key"), "key", "left_anti")


def known(*sources: DataFrame) -> DataFrame:
    """Distinct keys of several tables. [INC05, INC06, SET01]"""
    out = sources[0].select("key")
    for s in sources[1:]:
        out = out.unionByName(s.select("key"))
    return out.distinct()


def merge_latest(state: DataFrame, changes: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Upsert: per key the newest row, of equals the change's; idempotent. [SET10, SNK11, INC07]"""
    both = state.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return aggregates.kept(both, keys, [order, "_new"], last=True).drop("_new")


def keep_days(book: DataFrame, day: str, days: int) -> DataFrame:
    """Rows of the last so many days before the newest recorded one (not the clock). [SNK07, SNK08, INC07]"""
    newest = book.agg(F.max(day).alias("_newest"))
    return book.join(F.broadcast(newest)).where(F.col(day) > F.date_sub("_newest", days)).drop("_newest")  # one row


def replay(bronze: DataFrame, parse: Column, out: str) -> DataFrame:
    """Facts derived again from stored raw text by a newer parser; rows whose result changed are marked. [INC08]"""
    return bronze.withColumn("_fresh", parse).withColumn("changed", ~F.col(out).eqNullSafe(F.col("_fresh"))).withColumn(out, F.col("_fresh")).drop("_fresh")


def changes_over_time(snapshots: DataFrame, keys: Sequence[str], day: str, fields: Sequence[str]) -> DataFrame:
    """A change row per key and day on which a field differs from the key's snapshot before. [INC09]"""
    w = Window.partitionBy(*keys).orderBy(day)
    was = F.lag(F.struct(*fields)).over(w)
    return snapshots.withColumn("was", was).where("was IS NOT NULL").where(~F.col("was").eqNullSafe(F.struct(*fields)))


# --- gates -----------------------------------------------------------------------------------------------------------


def gate(measures: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One row per rule over a one-row table of measures: name and whether it holds; unknown fails. [SNK09, SNK13-SNK16]"""
    tests = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(c, F.lit(False)).alias("holds")) for n, c in rules.items()])
    return measures.select(F.explode(tests).alias("x")).select("x.*")


def publishable(new_rows: Column, old_rows: Column, ratio: float = 0.6) -> Column:
    """Refuse a result with fewer than the ratio of the rows it would replace. [SNK09, SNK13]"""
    return (old_rows == 0) | (new_rows >= ratio * old_rows)


def enforce(df: DataFrame, gates: DataFrame) -> DataFrame:
    """The rows, if no gate failed; else an error that names the failed ones. [SNK09, SNK14, SNK15]"""
    failed = gates.where("NOT holds").agg(F.array_join(F.array_sort(F.collect_list("rule")), ", ").alias("_failed")).withColumn("_k", F.lit(1))
    joined = df.withColumn("_k", F.lit(1)).join(F.broadcast(failed), "_k")  # one row
    stop = F.raise_error(F.concat(F.lit("not published: "), F.col("_failed"))).cast("boolean")
    return joined.where(F.when(F.col("_failed") == "", F.lit(True)).otherwise(stop)).drop("_k", "_failed")


def expectations(tables: Mapping[str, DataFrame], unique: Mapping[str, Sequence[str]], references: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """(expectation, violations): duplicate keys, and foreign keys without a target. [Q01]"""
    out = None
    for name, keys in unique.items():
        rows = tables[name].groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
        one = rows.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations")).select(F.lit(f"unique {name}").alias("expectation"), "violations")
        out = one if out is None else out.unionByName(one)
    for child, column, parent, target in references:
        lost = tables[child].where(F.col(column).isNotNull()).join(tables[parent].select(F.col(target).alias(column)), column, "left_anti")
        one = lost.agg(F.count("*").alias("violations")).select(F.lit(f"{child}.{column} in {parent}").alias("expectation"), "violations")
        out = one if out is None else out.unionByName(one)
    return out
