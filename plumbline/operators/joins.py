"""Join semantics: precedence merges, keys that must be unambiguous, as-of and range joins.

Every join here has an equality key, so Spark plans a hash or sort-merge join and adaptive execution can split skewed
keys. Nothing is broadcast by hand; Spark does so where statistics show a side to be small. A loose key matches only
where it names one row: ambiguous keys are refused before the join, by an aggregate, so joins never fan out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: A key is frequent if it has more than one in so many rows; so no more than so many keys are, whatever the data.
FREQUENT = 2048


def measure(df: DataFrame, column: str) -> Column:
    """A date (days), time (microseconds) or number as a double, in the same order."""
    kind, c = dict(df.dtypes)[column], F.col(column)
    if kind == "date":
        return F.unix_date(c).cast("double")
    if kind.startswith("timestamp"):
        return F.unix_micros(c if kind == "timestamp" else c.cast("timestamp")).cast("double")
    return c.cast("double")


def whole_number(df: DataFrame, column: str) -> Column:
    """A date, time (microseconds) or whole number as a long."""
    kind = dict(df.dtypes)[column]
    return F.unix_micros(column) if kind == "timestamp" else F.unix_micros(F.col(column).cast("timestamp")) if kind.startswith(("date", "timestamp")) else F.col(column).cast("long")


def looked_up(rows: DataFrame, facts: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """rows joined with facts, an aggregate with a row a key, so that a frequent key is no hot task.

    Adaptive execution splits a join's skewed side only where both sides are plain shuffles. An aggregate by the join's own
    keys is none, as it already lies by key; by the struct of the keys it is shuffled again, a row a key, and is one.
    """
    keys = list(keys)
    values = [c for c in facts.columns if c not in keys]
    key = F.struct(*[F.coalesce(c).alias(c) for c in keys]).alias("_key")
    return rows.select("*", key).join(facts.select(key, *values), "_key", how).drop("_key")


def must_join(facts: DataFrame, dim: DataFrame, key: str, dim_key: str) -> DataFrame:
    """Foreign-key lookup that must succeed: a row without its dimension is an error when read. [JOI01]"""
    marked = dim.withColumn("_found", F.lit(True))
    joined = facts.join(marked, facts[key] == marked[dim_key], "left")
    missing = F.raise_error(F.concat(F.lit(f"no {dim_key} for {key} "), F.col(key).cast("string")))
    return joined.where(F.when(F.col("_found"), F.lit(True)).otherwise(missing.cast("boolean"))).drop("_found")


def merge_sellers(sources: Sequence[tuple[str, DataFrame]], keys: Sequence[str]) -> DataFrame:
    """Rows of the first source, then of each later one those whose key no earlier source has; ``seller`` says whose.

    Sources have the same columns. One shuffle: the earliest source of a key wins. [JOI02, JOI03, JOI04]
    """
    every = None
    for rank, (name, df) in enumerate(sources):
        one = df.withColumn("seller", F.lit(name)).withColumn("_rank", F.lit(rank))
        every = one if every is None else every.unionByName(one)
    first = F.min("_rank").over(Window.partitionBy(*keys))
    return every.withColumn("_first", first).where("_rank = _first").drop("_rank", "_first")


def attach_prices(rows: DataFrame, seller: str, quotes: DataFrame, keys: Sequence[str], price: str, out: str) -> DataFrame:
    """Another seller's price beside each row, never where the row is that seller's own. quotes has a row a key at most. [JOI05]"""
    one = quotes.select(*keys, F.col(price).alias(out))
    joined = rows.join(one, list(keys), "left")
    return joined.withColumn(out, F.when(F.col("seller") != seller, F.col(out)))


def alias_join(rows: DataFrame, aliases: DataFrame, key: str, target: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their target id, counts of unmapped keys); aliases has columns alias and target. [JOI06, JOI14, JOI24]"""
    mapped = rows.join(aliases.select(F.col("alias").alias(key), F.col("target").alias(target)), key)
    unmapped = rows.join(aliases.select(F.col("alias").alias(key)), key, "left_anti").groupBy(key).agg(F.count("*").alias("n"))
    return mapped, unmapped


def unambiguous(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value) of the keys that name exactly one distinct value. [JOI08, JOI09, JOI11, JOI19]"""
    return df.groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("_most")).where(F.col(value) == F.col("_most")).drop("_most")


def exact_then_loose(rows: DataFrame, book: DataFrame, exact: str, loose: str, value: str) -> DataFrame:
    """The value by exact key, else by a loose key that names one value only; null without either. [JOI07]"""
    by_exact = unambiguous(book, [exact], value).withColumnRenamed(value, "_exact")
    by_loose = unambiguous(book, [loose], value).withColumnRenamed(value, "_loose")
    joined = rows.join(by_exact, exact, "left").join(by_loose, loose, "left")
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_loose").isNotNull(), "loose")
    return joined.withColumn(value, F.coalesce("_exact", "_loose")).withColumn("match", how).drop("_exact", "_loose")


def through_shared_keys(left: DataFrame, right: DataFrame, shared: Sequence[str], left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id) where all shared keys of a left id that have a right row lead to one right id. [JOI09, BIL17]"""
    pairs = left.select(left_id, *shared).join(right.select(right_id, *shared), list(shared)).select(left_id, right_id)
    return unambiguous(pairs, [left_id], right_id)


def borrow_units(lines: DataFrame, lenders: DataFrame, without: Sequence[str] = ()) -> DataFrame:
    """Units of lines that state none, from lines of the same code, amount to the cent and currency that state one.

    Pairs that lead to several units are refused, and sources in ``without`` don't lend. Lines have bill_id, code,
    amount, currency, basis, unit_unstated, source; amount, tier and code never change. [JOI10, JOI11]
    """
    lend = lenders.where(~F.coalesce("unit_unstated", F.lit(False)) & F.col("basis").isNotNull() & F.col("amount").isNotNull())
    if without:
        lend = lend.where(~F.col("source").isin(*without))
    key = [F.col("code"), F.round("amount", 2).alias("_cents"), F.col("currency")]
    units = unambiguous(lend.select(*key, F.col("basis").alias("_unit")), ["code", "_cents", "currency"], "_unit")
    joined = lines.withColumn("_cents", F.round("amount", 2)).join(units, ["code", "_cents", "currency"], "left")
    lent = F.coalesce("unit_unstated", F.lit(False)) & F.col("_unit").isNotNull()
    out = joined.withColumn("unit_lent", lent)
    lent = F.col("unit_lent")
    out = out.withColumn("basis", F.when(lent, F.col("_unit")).otherwise(F.col("basis"))).withColumn("unit_unstated", F.coalesce("unit_unstated", F.lit(False)) & ~lent)
    return out.select(*lines.columns, "unit_lent")


def completed(lines: DataFrame, declined: DataFrame) -> DataFrame:
    """bill_id, complete: every owed line has an amount and a unit, and nobody declined to state one. [JOI12, EXT29]"""
    owed = (F.col("tier") == "mandatory") & ~F.coalesce("included", F.lit(False))
    stated = F.col("amount").isNotNull() & ~F.coalesce("unit_unstated", F.lit(False))
    bills = lines.groupBy("bill_id").agg(F.every(~owed | stated).alias("_all"))
    said = declined.select("bill_id").distinct().withColumn("_declined", F.lit(True))
    return bills.join(said, "bill_id", "left").select("bill_id", (F.col("_all") & F.col("_declined").isNull()).alias("complete"))


def prefer_unless_fresher(hand: DataFrame, scraped: DataFrame, keys: Sequence[str], value: str, day: str) -> DataFrame:
    """Hand-read values win per key, unless the scraped one is fresher and has a value; ``superseded`` marks those. [JOI13]"""
    h = hand.select(*keys, F.col(value).alias("_h"), F.col(day).alias("_hd"))
    s = scraped.select(*keys, F.col(value).alias("_s"), F.col(day).alias("_sd"))
    fresher = F.col("_s").isNotNull() & (F.col("_hd").isNull() & F.col("_h").isNull() | (F.col("_sd") > F.col("_hd")))
    joined = h.join(s, list(keys), "full_outer")
    return joined.select(*keys, F.when(fresher, F.col("_s")).otherwise(F.coalesce("_h", "_s")).alias(value), (F.coalesce(fresher, F.lit(False)) & F.col("_h").isNotNull()).alias("superseded"))


def range_join(offers: DataFrame, runs: DataFrame, key: str, point: str, low: str, high: str, extra: Column | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Each offer with the first run of its key whose [low, high] holds the point; unmatched offers have nulls. [JOI15]

    The equality on the key makes it a hash or sort-merge join with a residual condition, never a nested loop. Offers meet all
    runs of their key: where one key has very many of both, ``intervals.first_interval`` spreads it over bins.
    """
    o = offers.withColumn("_offer", F.monotonically_increasing_id())
    test = (o[key] == runs[key]) & o[point].between(runs[low], runs[high])
    joined = o.join(runs, test if extra is None else test & extra, "left").drop(runs[key])
    first = Window.partitionBy("_offer").orderBy(*[F.col(c).asc_nulls_last() for c in (order or (low, high))])
    return joined.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth", "_offer")


def as_of(rows: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], prefix: str = "prev_", tie: Sequence[str] = ()) -> DataFrame:
    """Each row beside its own newest strictly earlier row of the same keys: one window, no self join. [JOI18, WIN05]

    ``order`` is a timestamp, a date or a whole number. Rows of equal ``order`` see the same earlier row, the last of the order before by ``tie``.
    """
    number = whole_number(rows, order)
    w = Window.partitionBy(*keys).orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    best = F.max_by(F.struct(*[F.col(v) for v in values], F.col(order).alias("_when")), F.struct("_at", *tie)).over(w)
    out = rows.withColumn("_at", number).withColumn("_best", best)
    for v in values:
        out = out.withColumn(prefix + v, F.col("_best")[v])
    return out.withColumn(prefix + order, F.col("_best")["_when"]).drop("_at", "_best")


def pair_unique(added: DataFrame, gone: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Added and gone rows of one key, each alone on its side: (keys, value_added, value_gone). [JOI16, CHG05]"""

    def alone(df: DataFrame, out: str) -> DataFrame:
        n = F.count("*").over(Window.partitionBy(*keys))
        return df.withColumn("_n", n).where("_n = 1").select(*keys, F.col(value).alias(out))

    return alone(added, f"{value}_added").join(alone(gone, f"{value}_gone"), list(keys))


def banded_error(pairs: DataFrame, a: str, b: str, bands: Sequence[tuple[float, str]], beyond: str) -> DataFrame:
    """Counts of pairs by how far b lies from a, relative to a; bands are (upper bound, label) in rising order. [JOI20]"""
    error = F.abs(F.try_divide(F.col(b) - F.col(a), F.col(a)))
    band = F.lit(beyond)
    for bound, label in reversed(bands):
        band = F.when(error <= bound, label).otherwise(band)
    return pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(band.alias("band")).agg(F.count("*").alias("n"))


def backfill(rows: DataFrame, archive: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Missing fields from the archive's row of the same key (a row a key at most). [JOI21]"""
    old = archive.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields])
    joined = rows.join(old, list(keys), "left")
    return joined.select(*[F.coalesce(c, f"_{c}").alias(c) if c in fields else F.col(c) for c in rows.columns])


def carry(previous: DataFrame, new: DataFrame, unread: DataFrame, key: str, id_col: str) -> DataFrame:
    """New rows, and previous rows of keys that weren't read this time whose id is not new. ``carried`` tells. [JOI22, JOI23]"""
    kept = previous.join(unread.select(key).distinct(), key, "left_semi").join(new.select(id_col), id_col, "left_anti")
    return new.withColumn("carried", F.lit(False)).unionByName(kept.withColumn("carried", F.lit(True)))
