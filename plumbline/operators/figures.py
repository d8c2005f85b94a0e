"""Figures that a report states about a dataset, and trips grouped out of departures.

A figure that nothing stands behind is null, never 0: "none publishes a price" is a claim. Each is a partial aggregate;
together they are joined as one-row tables of a name and a value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import money, text


def trips(departures: DataFrame, boat: str = "boat", name: str = "name", start: str = "start", end: str = "end", season: tuple[str, str] | None = None, unnamed: str = "Unnamed itinerary") -> tuple[DataFrame, DataFrame]:
    """(one row per boat and cleaned title, departures without a boat or with implausible dates and why). [AGG01]

    A trip's nights are those that most of its departures take, of equals the fewest; departures out of season don't count.
    """
    rows = departures.withColumn("nights", money.nights(F.col(start), F.col(end)))
    why = F.when(F.nullif(F.trim(boat), F.lit("")).isNull(), "no boat").when(F.col("nights").isNull(), "implausible dates")
    marked = rows.withColumn("skipped", why)
    kept = marked.where("skipped IS NULL")
    if season:
        kept = kept.where(F.col(start).between(*[F.lit(d).cast("date") for d in season]))
    title = F.coalesce(F.nullif(text.split_title(F.col(name))["trip"], F.lit("")), F.lit(unnamed))
    counts = kept.groupBy(boat, title.alias("trip"), "nights").agg(F.count("*").alias("n"), F.min(start).alias("first"), F.max(start).alias("last"))
    out = counts.groupBy(boat, "trip").agg(F.min_by("nights", F.struct(-F.col("n"), F.col("nights"))).alias("nights"), F.sum("n").alias("departures"), F.min("first").alias("first"), F.max("last").alias("last"))
    return out, marked.where("skipped IS NOT NULL").select(*departures.columns, "skipped")


def estimate_reach(lines: DataFrame, boat: str = "boat", trip: str = "trip") -> DataFrame:
    """One row: on how many vessels and trips an estimate stands, null where it stands nowhere. [AGG19]"""
    on = lines.where(F.coalesce("estimated", F.lit(False))).select(boat, trip).distinct()
    n = on.agg(F.count_distinct(boat).alias("vessels"), F.count("*").alias("trips"))
    return n.select(F.nullif("vessels", F.lit(0)).alias("vessels"), F.nullif("trips", F.lit(0)).alias("trips"))


def stated_figures(views: Mapping[str, DataFrame]) -> DataFrame:
    """(figure, value) of one-row views: each column becomes "view.column"; a view without rows states nothing. [AGG23]"""
    out = None
    for view, df in views.items():
        named = F.array(*[F.struct(F.lit(f"{view}.{c}").alias("figure"), F.col(c).cast("double").alias("value")) for c in df.columns])
        one = df.select(F.explode(named).alias("x")).select("x.*")
        out = one if out is None else out.unionByName(one)
    return out


def optional_lines(entries: DataFrame, rules: Sequence[tuple[str, str]], tail: str, components: Sequence[str], combined: str, optional_codes: Sequence[str] = (), gratuity_codes: Sequence[str] = ()) -> DataFrame:
    """Charges that may be declined, as fee lines in list order. [EXT30]

    Entries have bill_id, position, title, paid_per, amount, currency, contents. Brackets leave the title before it is
    classified; an entry without a code or a unit is dropped, one without an amount stays; the note keeps the contents.
    """
    title = text.collapsed(F.col("title"))
    code = text.classify_label(F.trim(F.regexp_replace(title, r"\([^)]*\)", "")), rules, tail, components, combined)
    unit = F.regexp_replace(F.lower(text.collapsed(F.col("paid_per"))), r"^per\s+", "")
    note = F.concat_ws(": ", title, F.nullif(F.trim("contents"), F.lit("")))
    lines = entries.select("bill_id", "position", code.alias("code"), money.basis_for(unit).alias("basis"), "amount", "currency", note.alias("note"))
    kept = lines.where("code IS NOT NULL AND basis IS NOT NULL")
    return kept.withColumn("tier", text.tier_for(F.col("code"), F.lit(False), optional_codes, gratuity_codes))


def sites_of_trip(days: Column, blurb: Column, hints: Sequence[tuple[str, str]]) -> Column:
    """Places named in a trip's day texts, each once and in order; the blurb answers only where those name none. [EXT54]"""
    by_day = F.array_distinct(F.flatten(F.transform(F.coalesce(days, F.array().cast("array<string>")), lambda d: text.vocabulary_matches(text.visible_text(F.coalesce(d, F.lit(""))), hints))))
    return F.when(F.size(by_day) > 0, by_day).otherwise(text.vocabulary_matches(text.visible_text(F.coalesce(blurb, F.lit(""))), hints))
