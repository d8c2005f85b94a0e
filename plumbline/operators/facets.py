"""Faceted filtering: composable predicates, counts that skip their own facet, named sorts, pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filters:
    """What a user picked; empty parts don't filter. ``any_of`` is OR within a facet, ``all_of`` AND over an array column."""

    any_of: Mapping[str, Sequence] = field(default_factory=dict)
    all_of: Mapping[str, Sequence] = field(default_factory=dict)
    #: column -> (low, high); null values pass unless hide_unstated, open ends are None.
    ranges: Mapping[str, tuple] = field(default_factory=dict)
    #: column -> most; null values always pass.
    budget: Mapping[str, float] = field(default_factory=dict)
    flags: Sequence[str] = ()
    hide_unstated: bool = False


def passes(f: Filters, skip: str | None = None) -> Column:
    """The conjunction of all facets, but for the one to skip. [FLT03]"""
    out = F.lit(True)
    for column, picked in f.any_of.items():
        if picked and column != skip:
            out = out & F.coalesce(F.col(column).isin(*picked), F.lit(False))
    for column, picked in f.all_of.items():
        for value in picked:
            if column != skip:
                out = out & F.coalesce(F.array_contains(column, value), F.lit(False))
    for column, (low, high) in f.ranges.items():
        if column != skip:
            inside = (F.lit(True) if low is None else F.col(column) >= low) & (F.lit(True) if high is None else F.col(column) <= high)
            out = out & (F.coalesce(inside, F.lit(not f.hide_unstated)))
    for column, most in f.budget.items():
        if column != skip:
            out = out & F.coalesce(F.col(column) <= most, F.lit(True))
    for column in f.flags:
        if column != skip:
            out = out & F.coalesce(F.col(column), F.lit(False))
    return out


def facet_counts(df: DataFrame, f: Filters, facets: Sequence[str]) -> DataFrame:
    """(facet, value, n) of each facet under all other facets' filters; AND facets keep their own. One pass for all. [AGG11, AGG12, AGG13]

    Each row is spread to one (facet, value, admitted) struct per facet, filtered, and counted in one aggregate, so the
    table is read once however many facets there are.
    """

    def spread_of(facet: str) -> Column:
        own = passes(f, None if facet in f.all_of else facet)
        values = F.col(facet) if dict(df.dtypes)[facet].startswith("array") else F.array(F.col(facet))
        return F.when(own, F.transform(values.cast("array<string>"), lambda v: F.struct(F.lit(facet).alias("facet"), v.alias("value"))))

    spread = [spread_of(facet) for facet in facets]
    rows = df.select(F.explode(F.flatten(F.array_compact(F.array(*spread)))).alias("x")).select("x.*").where("value IS NOT NULL")
    return rows.groupBy("facet", "value").agg(F.count("*").alias("n"))


def chips(counts: DataFrame, picked: Sequence[str], n: int) -> DataFrame:
    """The first n values of each facet: picked ones first, then by count falling, then by value. [SRT10]"""
    order = Window.partitionBy("facet").orderBy(F.col("value").isin(*picked).desc() if picked else F.lit(0), F.desc("n"), F.asc("value"))
    return counts.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)


def in_window(df: DataFrame, start: str, low: Column, high: Column, id_col: str) -> DataFrame:
    """Rows of a date window in order of start and id. [FLT01]"""
    return df.where(F.col(start).between(low, high)).orderBy(start, id_col)


def plausible(df: DataFrame, test: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, rows that don't); null counts as failing. Rejects are a result, never lost. [FLT02]"""
    ok = F.coalesce(test, F.lit(False))
    return df.where(ok), df.where(~ok)


def bookable(availability: Column) -> Column:
    """All but sold out; unknown is bookable. [FLT04]"""
    return F.coalesce(availability != "sold_out", F.lit(True))


def fresh(df: DataFrame, read: Column, today: Column, days: int = 14) -> DataFrame:
    """Rows read within so many days; a date that can't be read is not fresh. [FLT07, FLT08]"""
    return df.where(F.datediff(today, read).between(0, days))


def worth_reading(df: DataFrame, id_col: str, month: Column, months: Sequence[str]) -> DataFrame:
    """Rows with an id whose month is wanted. [FLT09]"""
    return df.where(F.col(id_col).isNotNull() & month.isin(*months))


def read_empty(checked: DataFrame, held_back: DataFrame, key: str, day: Column) -> DataFrame:
    """Keys checked on the day and not held back. [FLT10]"""
    return checked.where(F.col("checked") == day).join(held_back.select(key), key, "left_anti").select(key)


def sellers_of_row(flags: Sequence[tuple[str, Column]]) -> Column:
    """Sellers of a row, in the given order, whose flag holds. [FLT11]"""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in flags]))


def used_only(dim: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Dimension rows that a fact refers to. [FLT13]"""
    return dim.join(facts.select(key).distinct(), key, "left_semi")


#: Registry of sorts: name -> (column, sentinel for unknown, numeric). Unknown sorts last either way. [SRT02]
SORTS = {"name": ("name", None, False), "price": ("price", None, True), "start": ("start", None, True), "count": ("n", None, True), "rank": ("rank", -1, True)}


def sorted_by(df: DataFrame, column: str, ascending: bool, tie: str, sentinel: float | None = None) -> DataFrame:
    """By one column, unknown last (or as the sentinel), ties by a unique column. [SRT01, SRT08, SRT09]"""
    c = F.col(column) if sentinel is None else F.coalesce(F.col(column), F.lit(sentinel))
    return df.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last(), F.col(tie).asc())


def page(df: DataFrame, order: Sequence[Column], number: int, first: int = 120, more: int = 20) -> DataFrame:
    """Page 0 holds the first rows, later ones so many more; rows of one page only leave the executors. [SRT04]"""
    start, size = (0, first) if number == 0 else (first + (number - 1) * more, more)
    return df.orderBy(*order).offset(start).limit(size)
