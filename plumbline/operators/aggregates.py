"""Aggregations with stated tie rules and null rules: votes, strict sums, spreads, contingency tables.

All are one partial and one final aggregate (Spark combines before the shuffle), or a window where every row keeps its
place. Unknown is null and stays so: a strict sum with one null is null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import slices
from plumbline.operators.joins import looked_up


def kept(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """The first (or last) whole row of each key: one partial and one final aggregate, no sort of a key's rows. Nulls come first in the order. [SRC14]"""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def vote(df: DataFrame, keys: Sequence[str], value: str, out: str, largest: bool = False) -> DataFrame:
    """Most frequent non-null value of each key; of equals the smallest, or the largest. [AGG02, AGG03]"""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    if largest:
        return counts.groupBy(*keys).agg(F.max_by(value, F.struct("_n", value)).alias(out))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(out))


def settle_spelling(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Spellings that differ in case only: each row gets its most frequent one, of equals the first in order. [AGG04]"""
    n = F.count("*").over(Window.partitionBy(*keys, value))
    best = F.min_by(value, F.struct(-F.col("_n"), F.col(value))).over(Window.partitionBy(*keys, F.lower(value)))
    return df.withColumn("_n", n).withColumn(out, best).drop("_n")


def strict_sum(c: Column) -> Column:
    """Sum that is null if any value is. [AGG07]"""
    return F.when(F.count_if(c.isNull()) == 0, F.sum(c))


def markup(total: Column, base: Column) -> Column:
    """Surcharge in percent of the base; 0 where the base is 0 or less. [AGG06]"""
    return F.when(base > 0, 100 * (total - base).cast("double") / base.cast("double")).otherwise(F.lit(0.0))


def at_minimum(df: DataFrame, keys: Sequence[str], price: str, places: str) -> DataFrame:
    """Least price of each key, how many rows have it, and the places on them (strict). [AGG08, AGG07]"""
    least = F.min(price).over(Window.partitionBy(*keys))
    rows = df.withColumn("_least", least).where(F.col(price) == F.col("_least"))
    return rows.groupBy(*keys).agg(F.min("_least").alias("least"), F.count("*").alias("n_rows"), strict_sum(F.col(places)).alias("places"))


def first_stated(values: Sequence[Column]) -> Column:
    """First non-null in the sellers' order. [AGG09, SAL10]"""
    return F.coalesce(*values)


def tally(df: DataFrame, value: Column, out: str = "value") -> DataFrame:
    """Counts of a value, or of the items of an array. Order, where wanted: count falling, then value. [AGG11, AGG31]"""
    rows = df.select(value.alias(out))
    if dict(rows.dtypes)[out].startswith("array"):
        # Outer: else the array is made twice, to test that it isn't empty first.
        rows = rows.select(F.explode_outer(out).alias(out))
    return rows.where(F.col(out).isNotNull()).groupBy(out).agg(F.count("*").alias("n"))


def combinations(df: DataFrame, items: Column, order: Sequence[str]) -> DataFrame:
    """Counts of combinations "a+b" of an array's items, each in the given order, with their arity. [AGG14]"""
    ranked = F.array_sort(F.transform(items, lambda x: F.struct(F.array_position(F.array(*[F.lit(o) for o in order]), x).alias("p"), x.alias("x"))))
    label = F.array_join(F.transform(ranked, lambda s: s["x"]), "+")
    return df.select(label.alias("combination"), F.size(items).alias("arity")).groupBy("combination", "arity").agg(F.count("*").alias("n"))


def shown(df: DataFrame, *distinct: str) -> DataFrame:
    """One row: number of rows, and of distinct values of each column. [AGG15]"""
    return df.agg(F.count("*").alias("rows"), *[F.count_distinct(c).alias(f"n_{c}") for c in distinct])


def last_state(df: DataFrame, keys: Sequence[str], state: str, order: Sequence[str]) -> DataFrame:
    """State of the last row of each key. [AGG16]"""
    return df.groupBy(*keys).agg(F.max_by(state, F.struct(*order)).alias(state))


#: Share of the values on either side of the middle that is ranked, and the accuracy of the bracket's ends (1 / ACCURACY of the rows).
BRACKET, ACCURACY = 0.0002, 20_000


def medians(df: DataFrame, keys: Sequence[str], value: str, out: str = "middle", count: str | None = None, split: int = 0) -> DataFrame:
    """Exact median of the non-null values per key, without a key's values in one task; with ``count`` also their number. [NUM14]

    A mergeable sketch brackets the middle; one partial aggregate counts what lies below the bracket and the distinct
    values within it (a few in ten thousand), and only these are ranked. Rows meet their bracket in a join whose frequent keys
    adaptive execution splits. With ``split`` the brackets of frequent keys are cut into so many slices, ranked
    apart: for keys of more than some billion distinct values.
    """
    keys = list(keys)
    by = keys or ["_all_rows"]
    rows = df.select(*(keys or [F.lit(0).alias("_all_rows")]), F.col(value).alias("_v")).where("_v IS NOT NULL")
    ends = F.percentile_approx("_v", [0.5 - BRACKET, 0.5 + BRACKET], ACCURACY)
    bracket = rows.groupBy(*by).agg(ends.alias("_ends"), F.count("*").alias("_all"))
    placed = looked_up(rows, bracket, by) if keys else rows.join(F.broadcast(bracket), by)  # without keys one row
    inside = F.col("_v").between(F.col("_ends")[0], F.col("_ends")[1])
    ranked = placed.groupBy(*by, F.when(inside, F.col("_v")).alias("_slot")).agg(F.count_if(inside | (F.col("_v") < F.col("_ends")[0])).alias("_n"), F.first("_all").alias("_all"))
    # The row without a slot holds what is below the bracket; nulls come first.
    order = F.col("_slot").asc_nulls_first()
    if split:
        ranked = slices.sliced(ranked, by, "_slot", split)
        before = slices.inherited(ranked.groupBy(*by, "_slice").agg(F.sum("_n").alias("_state")), by, F.sum("_state").over(slices.before(by)), "_carried")
        upto = F.sum("_n").over(Window.partitionBy(*by, "_slice").orderBy(order)) + F.coalesce("_carried", F.lit(0))
        ranked = ranked.join(F.broadcast(before), [*by, "_slice"], "left").withColumn("_upto", upto)
    else:
        ranked = ranked.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*by).orderBy(order)))
    held = lambda at: F.max(F.when((F.col("_upto") > at) & (F.col("_upto") - F.col("_n") <= at), F.col("_slot")))
    two = ranked.groupBy(*by).agg(F.first("_all").alias("_all"), held(F.floor((F.col("_all") - 1) / 2)).alias("_a"), held(F.floor(F.col("_all") / 2)).alias("_b"))
    return two.select(*keys, ((F.col("_a") + F.col("_b")) / 2).cast("double").alias(out), *([F.col("_all").alias(count)] if count else []))


def spread(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, least, most and median of the non-null values. [AGG17, AGG20, NUM14]"""
    ends = df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))
    return ends.join(medians(df, keys, value), list(keys), "left")


def thirds(df: DataFrame, keys: Sequence[str], order: Sequence[str], share: Column) -> DataFrame:
    """Median of a share in the first and the last third (n div 3 rows each) of each key's rows in order. [AGG18]"""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_total"))
    rows = looked_up(slices.numbered(df.withColumn("_share", share), keys, order, "_nth"), sizes, keys)
    size = F.floor(F.col("_total") / 3)
    ends = rows.withColumn("_first", F.when(F.col("_nth") <= size, F.col("_share"))).withColumn("_last", F.when(F.col("_nth") > F.col("_total") - size, F.col("_share")))
    out = sizes.select(*keys)
    for column, name in (("_first", "first_third"), ("_last", "last_third")):
        out = out.join(medians(ends, keys, column, name), list(keys), "left")
    return out


def gaps(df: DataFrame, a: str, b: str, least: float = 5.0) -> DataFrame:
    """One row: comparable pairs, those apart by ``least`` or more, widest and median distance. [AGG21, AGG22]"""
    rows = df.select(F.abs(F.col(a) - F.col(b)).alias("_apart"))
    apart = F.col("_apart")
    one = rows.agg(F.count(apart).alias("pairs"), F.count_if(apart >= least).alias("apart"), F.max(apart).alias("widest"))
    return one.join(F.broadcast(medians(rows, [], "_apart")))  # one row each


def agreement(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """One row: how often two sellers state a thing alike, differently, one alone, neither. [AGG24, AGG25]"""
    both = a.isNotNull() & b.isNotNull()
    return df.agg(F.count_if(both & (a == b)).alias("alike"), F.count_if(both & (a != b)).alias("different"), F.count_if(a.isNotNull() != b.isNotNull()).alias("one"), F.count_if(a.isNull() & b.isNull()).alias("neither"))


def contingency(df: DataFrame, keys: Sequence[str], row: str, column: str, columns: Sequence[str]) -> DataFrame:
    """Counts of a fixed list of outcomes as columns, and all as n; without pivot's extra pass over the data. [AGG27]"""
    return df.groupBy(*keys, row).agg(F.count("*").alias("n"), *[F.count_if(F.col(column) == c).alias(c) for c in columns])


def rate(hits: Column, n: Column) -> Column:
    """hits / n, null without rows. [AGG28]"""
    return F.try_divide(hits.cast("double"), n.cast("double"))


def first_copy(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key. [AGG30, SRC17, SRC18, SRC19, EXT31]"""
    return kept(df, keys, order)


def check_table(bills: DataFrame, keys: Sequence[str], start: str) -> DataFrame:
    """Per key the first bill by start (then id), its base, total and markup; unknown totals stay null. [AGG29]"""
    first = bills.groupBy(*keys).agg(F.min_by(F.struct("id", start, "base", "total"), F.struct(start, "id")).alias("b"))
    return first.select(*keys, F.col("b.id").alias("id"), F.col("b.base").alias("base"), F.col("b.total").alias("total"), F.when(F.col("b.total").isNotNull(), markup(F.col("b.total"), F.col("b.base"))).alias("markup"))


def without_children(parents: DataFrame, children: DataFrame, key: str, group: str) -> DataFrame:
    """Per group, parents that have no child. [AGG32, AGG26]"""
    return parents.join(children.select(key), key, "left_anti").groupBy(group).agg(F.count("*").alias("n"))


def sailing_counts(vessels: DataFrame, sailings: DataFrame, key: str, day: str, price: str, first_day: str, last_day: str) -> DataFrame:
    """Why a vessel shows no sailing: per vessel how many were read, dated, in season, priced in season and unpriced, with the first and last day. [AGG26]

    A vessel of which nothing was read has zeros and no days; a price of 0 or less is none.
    """
    dated, priced = F.col(day).isNotNull(), F.coalesce(F.col(price) > 0, F.lit(False))
    inside = dated & F.col(day).between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date"))
    counts = sailings.groupBy(key).agg(
        F.count("*").alias("read"), F.count_if(dated).alias("dated"), F.count_if(inside).alias("in_season"), F.count_if(inside & priced).alias("priced"), F.count_if(dated & ~priced).alias("unpriced"), F.min(day).alias("first"), F.max(day).alias("last"),
    )
    out = vessels.select(key).distinct().join(counts, key, "left")
    return out.na.fill(0, ["read", "dated", "in_season", "priced", "unpriced"])
