"""Ordered scans of keys of any size: as-of reads, runs and steps in slices of a key, with the state carried between them.

A window over a key sorts all its rows in one task. Here the keys that hold more than one in FREQUENT rows are cut into slices of near equal
numbers by quantiles of the order; a window runs in each slice, each slice leaves a small state, the states of a key are
combined in order, and what a slice inherits is added to its rows. Rows of equal order share a slice. The frequent keys, the
cuts and what is inherited are few by construction (FREQUENT keys, SLICES each), so these are broadcast; all other keys are
one slice, and cost what the window costs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.joins import FREQUENT, measure, whole_number

SLICES = 64


def sliced(df: DataFrame, keys: Sequence[str], order: str, slices: int = SLICES, frequent: int = FREQUENT) -> DataFrame:
    """The rows with ``_slice``, rising with the order within each key. Null orders come first; no key may be null."""
    keys = list(keys)
    x = measure(df, order)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = df.agg(F.count("*").alias("_total"))
    large = sizes.crossJoin(F.broadcast(total)).where(F.col("_n") * frequent > F.col("_total")).select(*keys)
    fractions = [i / slices for i in range(1, slices)]
    cuts = df.withColumn("_x", x).join(F.broadcast(large), keys).groupBy(*keys).agg(F.array_distinct(F.percentile_approx("_x", fractions, 10_000)).alias("_cuts"))
    value = F.col("_x")
    number = F.when(value.isNull(), 0).otherwise(F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda c: c <= value)))
    return df.withColumn("_x", x).join(F.broadcast(cuts), keys, "left").withColumn("_slice", number).drop("_cuts", "_x")


def inherited(states: DataFrame, keys: Sequence[str], value: Column, out: str) -> DataFrame:
    """(keys, _slice, out): of each slice but a key's first what the slices before it leave; few rows, see above."""
    return states.withColumn(out, value).where(F.col(out).isNotNull() & (F.col("_slice") > 0)).select(*keys, "_slice", out)


def before(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)


def as_of(rows: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], prefix: str = "prev_", tie: Sequence[str] = (), slices: int = SLICES, frequent: int = FREQUENT) -> DataFrame:
    """As ``joins.as_of``: each row beside its own newest strictly earlier row of the same keys; a null order has none. [JOI18, WIN05]"""
    keys = list(keys)
    cut = sliced(rows, keys, order, slices, frequent).withColumn("_at", whole_number(rows, order))
    best = F.max_by(F.struct(*[F.col(v) for v in values], F.col(order).alias("_when")), F.struct("_at", *tie))
    w = Window.partitionBy(*keys, "_slice").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    states = cut.where("_at IS NOT NULL").groupBy(*keys, "_slice").agg(best.alias("_state"))
    carried = inherited(states, keys, F.last("_state", ignorenulls=True).over(before(keys)), "_carried")
    out = cut.withColumn("_own", best.over(w)).join(F.broadcast(carried), [*keys, "_slice"], "left").withColumn("_best", F.when(F.col("_at").isNotNull(), F.coalesce("_own", "_carried")))
    for v in values:
        out = out.withColumn(prefix + v, F.col("_best")[v])
    return out.withColumn(prefix + order, F.col("_best")["_when"]).drop("_at", "_own", "_carried", "_best", "_slice")


def lagged(rows: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], prefix: str = "prev_", tie: Sequence[str] = (), slices: int = SLICES, frequent: int = FREQUENT) -> DataFrame:
    """Each row beside the row just before it by (order, tie) of the same keys, of equal order too; null orders come last. [JOI18, WIN05]"""
    keys = list(keys)
    last = F.col(order).isNull()
    cut = sliced(rows, keys, order, slices, frequent).withColumn("_slice", F.when(last, slices).otherwise(F.col("_slice")))
    row = F.struct(*values, F.col(order).alias("_when"))
    states = cut.groupBy(*keys, "_slice").agg(F.max_by(row, F.struct(order, *tie)).alias("_state"))
    carried = inherited(states, keys, F.last("_state", ignorenulls=True).over(before(keys)), "_carried")
    w = Window.partitionBy(*keys, "_slice").orderBy(order, *tie)
    out = cut.withColumn("_own", F.lag(row).over(w)).join(F.broadcast(carried), [*keys, "_slice"], "left").withColumn("_best", F.coalesce("_own", "_carried"))
    return out.select(*rows.columns, *[F.col("_best")[v].alias(prefix + v) for v in values], F.col("_best")["_when"].alias(prefix + order))


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str, slices: int = SLICES, frequent: int = FREQUENT) -> DataFrame:
    """As ``windows.runs``: the rows where the flag holds, numbered by the breaks up to them. [WIN01]"""
    keys = list(keys)
    breaks = F.when(F.coalesce(F.col(flag), F.lit(False)), 0).otherwise(1)
    cut = sliced(df, keys, order[0], slices, frequent)
    states = cut.groupBy(*keys, "_slice").agg(F.sum(breaks).alias("_state"))
    carried = inherited(states, keys, F.sum("_state").over(before(keys)), "_carried")
    w = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.withColumn("_own", F.sum(breaks).over(w)).join(F.broadcast(carried), [*keys, "_slice"], "left")
    return out.withColumn("run", F.col("_own") + F.coalesce("_carried", F.lit(0))).where(F.coalesce(F.col(flag), F.lit(False))).drop("_own", "_carried", "_slice")


def steps(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], tie: Sequence[str] = (), slices: int = SLICES, frequent: int = FREQUENT) -> DataFrame:
    """As ``windows.steps``: consecutive readings of each key as rows (was_*, now_*); equal orders by ``tie``. [WIN05]"""
    keys, cols = list(keys), [order, *values]
    cut = sliced(df, keys, order, slices, frequent)
    states = cut.groupBy(*keys, "_slice").agg(F.max_by(F.struct(*cols), F.struct(order, *tie)).alias("_state"))
    carried = inherited(states, keys, F.last("_state", ignorenulls=True).over(before(keys)), "_carried")
    w = Window.partitionBy(*keys, "_slice").orderBy(order, *tie)
    out = cut.withColumn("_own", F.lag(F.struct(*cols)).over(w)).join(F.broadcast(carried), [*keys, "_slice"], "left")
    out = out.withColumn("_was", F.coalesce("_own", "_carried")).where("_was IS NOT NULL")
    return out.select(*keys, *[F.col("_was")[c].alias(f"was_{c}") for c in cols], *[F.col(c).alias(f"now_{c}") for c in cols])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "number", slices: int = SLICES, frequent: int = FREQUENT) -> DataFrame:
    """As ``windows.numbered``, from 1: the row's place in its key's order. [WIN04]"""
    keys = list(keys)
    cut = sliced(df, keys, order[0], slices, frequent)
    states = cut.groupBy(*keys, "_slice").agg(F.count("*").alias("_state"))
    carried = inherited(states, keys, F.sum("_state").over(before(keys)), "_carried")
    w = Window.partitionBy(*keys, "_slice").orderBy(*order)
    return cut.withColumn("_own", F.row_number().over(w)).join(F.broadcast(carried), [*keys, "_slice"], "left").withColumn(out, F.col("_own") + F.coalesce("_carried", F.lit(0))).drop("_own", "_carried", "_slice")
