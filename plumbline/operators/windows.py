"""Ordered sequences: runs, steps between readings, verdicts against a group's median, best and worst whole rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.aggregates import medians
from plumbline.operators.joins import looked_up


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str) -> DataFrame:
    """Gaps and islands: the rows where the flag holds, with the number of their run within the key's own order. [WIN01]

    The breaks up to a row number its run; null counts as not holding.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    holds = F.coalesce(F.col(flag), F.lit(False))
    return df.withColumn("run", F.sum(F.when(holds, 0).otherwise(1)).over(w)).where(holds)


def run_summary(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str, start: str, pct: str, seller: str, read: str, book_day: str) -> DataFrame:
    """Per run: n, first and last start, sellers, least and most percent, and the stalest reading, its own day or else the book's. [WIN02, WIN03]"""
    return runs(df, keys, order, flag).groupBy(*keys, "run").agg(
        F.count("*").alias("n"), F.min(start).alias("first"), F.max(start).alias("last"), F.array_sort(F.collect_set(seller)).alias("sellers"),
        F.min(pct).alias("pct_min"), F.max(pct).alias("pct_max"), F.min(F.coalesce(read, book_day)).alias("stalest"),
    )


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "number") -> DataFrame:
    """Stable row number from 0 within the keys. [WIN04]"""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def collapse_repeats(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Of consecutive rows with the same value, the last. [WIN06]"""
    following = F.lead(F.struct(value)).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_next", following).where(F.col("_next").isNull() | ~F.col("_next")[value].eqNullSafe(F.col(value))).drop("_next")


def steps(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """Consecutive readings of each key as rows (was_*, now_*). [WIN05]"""
    w = Window.partitionBy(*keys).orderBy(order)
    cols = [order, *values]
    was = F.lag(F.struct(*cols)).over(w)
    out = df.withColumn("_was", was).where("_was IS NOT NULL")
    return out.select(*keys, *[F.col("_was")[c].alias(f"was_{c}") for c in cols], *[F.col(c).alias(f"now_{c}") for c in cols])


def fare_verdicts(moves: DataFrame, group: Sequence[str], least_siblings: int = 3, tolerance: float = 0.01) -> DataFrame:
    """Verdict on each step's price against the median ratio of its group's steps. [WIN07]

    moves has was_amount, now_amount, was_currency, now_currency, was_pct, now_pct. In this order: currency changed,
    unpriced, markdown began or changed, same, too few siblings, the whole group moved alike, rose, fell.
    """
    ratio = F.when(F.col("was_currency") == F.col("now_currency"), F.try_divide("now_amount", "was_amount"))
    rated = moves.withColumn("ratio", ratio)
    df = looked_up(rated, medians(rated, group, "ratio", "_middle", count="_n"), group, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    beyond = F.col("ratio") / F.col("_middle") - 1
    verdict = (
        F.when(F.col("was_currency") != F.col("now_currency"), "currency").when(F.col("was_amount").isNull() | F.col("now_amount").isNull(), "unpriced")
        .when(~F.col("was_pct").eqNullSafe(F.col("now_pct")), "markdown").when(F.col("was_amount") == F.col("now_amount"), "same")
        .when(F.col("_n") < least_siblings, "too few").when(F.abs(beyond) <= tolerance, "group-wide").when(beyond > 0, "rose").otherwise("fell")
    )
    return df.withColumn("verdict", verdict).drop("_middle", "_n")


def this_or_next(df: DataFrame, keys: Sequence[str], order: str, verdict: str, outcome: str) -> DataFrame:
    """Did the outcome come in this step or the next? [WIN08]"""
    following = F.lead(verdict).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn(outcome, (F.col(verdict) == outcome) | F.coalesce(following == outcome, F.lit(False)))


def places_verdict(was: Column, now: Column) -> Column:
    """What a step did to the places left: unknown, filled, grew or held. [WIN09]"""
    return F.when(was.isNull() | now.isNull(), "unknown").when(now < was, "filled").when(now > was, "grew").otherwise("held")


def sold_through(was: Column, now: Column) -> Column:
    """Have the cheapest rooms of a ladder (structs name, price, places) sold out while dearer ones are left? [WIN10]"""
    least = F.array_min(F.transform(F.filter(was, lambda r: r["places"] > 0), lambda r: r["price"]))
    cheap = F.transform(F.filter(was, lambda r: (r["price"] == least) & (r["places"] > 0)), lambda r: r["name"])
    gone = F.forall(cheap, lambda n: ~F.exists(now, lambda r: (r["name"] == n) & (r["places"] > 0)))
    left = F.exists(now, lambda r: (r["price"] > least) & (r["places"] > 0))
    return F.coalesce(least.isNotNull() & gone & left, F.lit(False))


def best_and_worst(df: DataFrame, keys: Sequence[str], low: str, high: str, order: str, collapse: float = 5.0) -> DataFrame:
    """Cheapest and dearest whole row of each key and the one of highest top; ends are never mixed from parts. [WIN11]

    Rows without a total take no part; ties go to the first in ``order``; ``spread`` is null where the ends are closer
    than ``collapse``.
    """
    row = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    agg = df.where(F.col(low).isNotNull()).groupBy(*keys).agg(F.min_by(row, F.struct(low, order)).alias("best"), F.max_by(row, F.struct(F.col(low), -F.col(order))).alias("worst"), F.max_by(row, F.struct(F.coalesce(high, low), -F.col(order))).alias("top"))
    apart = F.col("worst")[low] - F.col("best")[low]
    return agg.withColumn("spread", F.when(apart >= collapse, apart))


def newest_days(df: DataFrame, day: str, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of the n newest days (of each key). Days are few, so they are ranked apart and joined back. [WIN12, SNK12]"""
    days = df.select(*keys, day).distinct()
    rank = F.dense_rank().over((Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))).orderBy(F.desc(day)))
    wanted = days.withColumn("_nth", rank).where(F.col("_nth") <= n).drop("_nth")
    return df.join(wanted, [*keys, day], "left_semi")


def due(df: DataFrame, today: Column, moved: Column, last_read: str, id_col: str, stale: int = 7, overdue: int = 14, turns: int = 3) -> DataFrame:
    """Why a thing is read today: it moved, is stale, is overdue, or has its turn by id; else null. [WIN13]"""
    age = F.datediff(today, F.col(last_read))
    turn = F.pmod(F.col(id_col), F.lit(turns)) == F.pmod(F.datediff(today, F.lit("1970-01-01").cast("date")), F.lit(turns))
    why = F.when(F.col(last_read).isNull() | (age >= overdue), "overdue").when(moved, "moved").when(age >= stale, "stale").when(turn, "turn")
    return df.withColumn("due", why)


def top_of_section(df: DataFrame, section: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each section, with how many more there are. [SRT05, SNK05, SNK06]"""
    w = Window.partitionBy(section).orderBy(*order)
    top = df.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)
    sizes = df.groupBy(section).agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))
    return top.join(sizes, section)
