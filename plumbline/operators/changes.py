"""Snapshot diffs that suppress false positives: what vanished, moved, was relisted, or merely wasn't read.

Two snapshots are joined once, on the id, in full; every rule is an expression or an aggregate over that one result or a
join by entity. Coverage (what was read this time) is a table, so that a page not read never looks like an absence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import pair_unique


def diff(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One row per id with was_* and now_* of each field and a bucket: added, withdrawn, changed or same. [SET02, CHG04]"""
    b = before.select(key, *[F.col(f).alias(f"was_{f}") for f in fields], F.lit(True).alias("_b"))
    a = after.select(key, *[F.col(f).alias(f"now_{f}") for f in fields], F.lit(True).alias("_a"))
    joined = b.join(a, key, "full_outer")
    differ = F.lit(False)
    for f in fields:
        differ = differ | ~F.col(f"was_{f}").eqNullSafe(F.col(f"now_{f}"))
    bucket = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "withdrawn").when(differ, "changed").otherwise("same")
    return joined.withColumn("bucket", bucket).drop("_a", "_b")


def vanished(before: DataFrame, after: DataFrame, entity: Sequence[str], least: int = 3, read_empty: DataFrame | None = None) -> DataFrame:
    """Entities that lost all of at least ``least`` rows: one row each, not one per row. [CHG01, CHG02, CHG03]

    ``how`` is emptied where every seller that listed it was read empty (read_empty: entity columns and seller), else
    gone. With (entity, month) as entity this tells which months emptied.
    """
    counts = before.groupBy(*entity).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("seller")).alias("sellers")).where(F.col("n") >= least)
    out = counts.join(after.select(*entity).distinct(), list(entity), "left_anti")
    if read_empty is None:
        return out.withColumn("how", F.lit("gone"))
    read = read_empty.groupBy(*entity).agg(F.array_sort(F.collect_set("seller")).alias("_read"))
    emptied = F.size(F.array_except("sellers", F.coalesce("_read", F.array().cast("array<string>")))) == 0
    return out.join(read, list(entity), "left").withColumn("how", F.when(emptied, "emptied").otherwise("gone")).drop("_read")


def added_and_withdrawn(rows: DataFrame, gone: DataFrame, entity: Sequence[str]) -> DataFrame:
    """Added and withdrawn rows of a diff, less those of vanished entities. [CHG04]"""
    return rows.where("bucket IN ('added', 'withdrawn')").join(gone.select(*entity), list(entity), "left_anti")


def relisted(rows: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """Pairs of an added and a withdrawn row of one key, each alone on its side. [CHG05, JOI16]"""
    return pair_unique(rows.where("bucket = 'added'"), rows.where("bucket = 'withdrawn'"), keys, id_col)


def newly_read(before: DataFrame, after: DataFrame, field: str) -> DataFrame:
    """One row: is the field read for the first time, with no value in any old row and some in the new? [CHG06]"""
    b = before.agg(F.coalesce(F.bool_or(F.col(field).isNotNull()), F.lit(False)).alias("old"))
    a = after.agg(F.coalesce(F.bool_or(F.col(field).isNotNull()), F.lit(False)).alias("new"))
    return b.join(F.broadcast(a)).select(  # one row each
        (~F.col("old") & F.col("new")).alias("newly_read")
    )


def transition(was: Column, now: Column, state: str) -> Column:
    """entered, left or null for one state; an unknown state on either side is no transition. [CHG07]"""
    return F.when((was != state) & (now == state), "entered").when((was == state) & (now != state), "left")


def price_move(was: Column, now: Column, was_currency: Column, now_currency: Column, least: float = 5.0) -> Column:
    """currency where that changed, rounding below ``least``, else rose or fell; null where unchanged or unknown. [CHG08]"""
    delta = now - was
    return F.when(was_currency != now_currency, "currency").when(was.isNull() | now.isNull() | (delta == 0), None).when(F.abs(delta) < least, "rounding").when(delta > 0, "rose").otherwise("fell")


def fee_moves(before: DataFrame, after: DataFrame) -> DataFrame:
    """(boat, code, was, now) of summaries that differ; boats without earlier lines are left out. [CHG09]"""
    b, a = before.select("boat", "code", F.col("summary").alias("was")), after.select("boat", "code", F.col("summary").alias("now"))
    both = b.join(a, ["boat", "code"], "full_outer").where(~F.col("was").eqNullSafe(F.col("now")))
    return both.join(before.select("boat").distinct(), "boat", "left_semi")


def fee_summary(amount: Column, amount_max: Column, currency: Column, basis: Column, included: Column) -> Column:
    """A fee as text that compares: included, unpriced, "90 EUR per_trip" or "90-120 EUR per_trip". [CHG10, SET07]"""
    plain = lambda c: F.regexp_replace(F.regexp_replace(c.cast("decimal(18,4)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    figure = F.concat(plain(amount), F.when(amount_max != amount, F.concat(F.lit("-"), plain(amount_max))).otherwise(""), F.lit(" "), currency, F.lit(" "), F.coalesce(basis, F.lit("unit unstated")))
    return F.when(F.coalesce(included, F.lit(False)), "included").when(amount.isNull(), "unpriced").otherwise(figure)


def rate_moves(before: DataFrame, after: DataFrame, used: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Rates that moved, of the currencies in use. [CHG11]"""
    b, a = before.select("currency", F.col("rate").alias("was")), after.select("currency", F.col("rate").alias("now"))
    moved = F.abs(F.col("now").cast("double") - F.col("was").cast("double")) > tolerance
    return b.join(a, "currency").where(moved).join(used.select("currency").distinct(), "currency", "left_semi")


def is_quiet(rows: DataFrame) -> DataFrame:
    """One row: did nothing change, and was all that changed renumbered? rows has a kind. [CHG12]"""
    kind = F.col("kind")
    return rows.agg((F.count_if(kind.isNotNull()) == 0).alias("quiet"), F.coalesce(F.every(F.when(kind.isNotNull(), kind == "renumbered")), F.lit(False)).alias("only_renumbered"))


def sellers_of(*provenance: Column) -> Column:
    """Distinct sellers in order. [FLT12, CHG13]"""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*provenance))))


def new_and_withdrawn(before: DataFrame, after: DataFrame, keys: Sequence[str], partial: bool) -> DataFrame:
    """Keys on one side only, with the kind; nothing if either reading was cut short. [SET03]"""
    gone = before.select(*keys).distinct().join(after.select(*keys), list(keys), "left_anti").withColumn("kind", F.lit("withdrawn"))
    new = after.select(*keys).distinct().join(before.select(*keys), list(keys), "left_anti").withColumn("kind", F.lit("new"))
    return new.unionByName(gone).where(F.lit(not partial))


def changed_fields(pairs: Sequence[tuple[str, Column, Column]], both_stated: Sequence[str] = ()) -> Column:
    """Names of the fields that differ; those in ``both_stated`` only where neither side is null. [SET04]"""
    tests = [F.when(((a.isNotNull() & b.isNotNull()) if name in both_stated else F.lit(True)) & ~a.eqNullSafe(b), F.lit(name)) for name, a, b in pairs]
    return F.array_compact(F.array(*tests))


def discount_events(before: DataFrame, after: DataFrame, keys: Sequence[str], group: str) -> DataFrame:
    """Over keys on both sides: discounts that began, ended or changed, counted by group and kind. [SET05]"""
    joined = before.select(*keys, group, F.col("pct").alias("was")).join(after.select(*keys, F.col("pct").alias("now")), list(keys))
    kind = F.when(F.col("was").isNull() & F.col("now").isNotNull(), "began").when(F.col("was").isNotNull() & F.col("now").isNull(), "ended").when(F.col("was") != F.col("now"), "changed")
    return joined.withColumn("kind", kind).where("kind IS NOT NULL").groupBy(group, "kind").agg(F.count("*").alias("n"), F.min("now").alias("pct_min"), F.max("now").alias("pct_max"))


def drift(committed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with the side. [SET06, SET08, SNK10]"""
    cols = committed.columns
    gone = committed.exceptAll(fresh.select(cols)).withColumn("side", F.lit("gone"))
    return gone.unionByName(fresh.select(cols).exceptAll(committed).withColumn("side", F.lit("new")))


def headline(rows: DataFrame, priority: Sequence[str]) -> DataFrame:
    """The first three kinds by fixed priority, each with its count and its biggest move. [SRT06, SRT07]"""
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("kind"))
    agg = rows.where(rank > 0).groupBy("kind").agg(F.count("*").alias("n"), F.max_by("id", F.struct(F.abs("delta"), F.col("id"))).alias("biggest"))
    return agg.orderBy(rank).limit(3)
