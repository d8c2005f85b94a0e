"""Money, units, dates and rounding. Amounts are decimals until the last step; unknown is null, never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,4)"
RATE = "decimal(18,6)"


def parse_money(c: Column, default: str = "EUR") -> Column:
    """struct(amount, currency) of a number or "120 EUR" text. [NUM01]"""
    words = F.split(F.trim(c.cast("string")), r"\s+")
    amount = F.get(words, 0).try_cast(MONEY)
    return F.when(amount.isNotNull(), F.struct(amount.alias("amount"), F.coalesce(F.get(words, 1), F.lit(default)).alias("currency")))


def add(a: Column, b: Column) -> Column:
    """Sum of two amounts of one currency; of two currencies, an error. [NUM02]"""
    wrong = F.raise_error(F.concat(F.lit("currencies differ: "), a["currency"], F.lit(", "), b["currency"]))
    return F.struct((a["amount"] + b["amount"]).cast(MONEY).alias("amount"), F.when(a["currency"] == b["currency"], a["currency"]).otherwise(wrong.cast("string")).alias("currency"))


def times(a: Column, factor: Column) -> Column:
    """An amount of money times a number. [NUM03]"""
    return F.struct((a["amount"] * factor).cast(MONEY).alias("amount"), a["currency"].alias("currency"))


def cents(c: Column) -> Column:
    """Rounded half up to cents. [NUM04]"""
    return F.round(c, 2)


def converted(df: DataFrame, rates: DataFrame, amount: str, currency: str, out: str = "display", display: str = "EUR") -> DataFrame:
    """Adds the amount in the display currency; a currency without a rate is an error, the display currency needs none. [NUM05]"""
    one = rates.select(F.col("currency").alias("_currency"), F.col("rate").cast(RATE).alias("_rate"))
    joined = df.join(one, df[currency] == F.col("_currency"), "left")  # a small sheet is broadcast by its size, which Spark knows
    rate = F.when(F.col(currency) == display, F.lit(1).cast(RATE)).when(F.col("_rate").isNotNull(), F.col("_rate"))
    missing = F.raise_error(F.concat(F.lit("no rate for "), F.col(currency))).cast("decimal(38,10)")
    value = F.when(F.col(amount).isNull() | F.col(currency).isNull(), None).when(rate.isNull(), missing).otherwise(F.col(amount).cast(MONEY) * rate)
    return joined.withColumn(out, value.cast("decimal(28,10)")).drop("_currency", "_rate")


def is_stale(as_of: Column, today: Column, days: int = 7) -> Column:
    """Older than so many days at a supplied date. [NUM06]"""
    return F.datediff(today, as_of) > days


def is_sourced(source: Column) -> Column:
    """A rate with a source that isn't a placeholder. [NUM07]"""
    return F.coalesce(source.isNotNull() & ~F.rlike(F.lower(source), F.lit("placeholder|seed|estimate|^$")), F.lit(False))


def whole(c: Column) -> Column:
    """Display integer, half to even. [NUM08]"""
    return F.bround(c, 0).cast("long")


def cut_pct(price: Column, was: Column) -> Column:
    """Discount in whole percent, half to even; 0 or without an earlier price, null. [NUM09, NUM24, SAL13]"""
    pct = F.bround(100 * (1 - F.try_divide(price.cast("double"), was.cast("double"))), 0).cast("int")
    return F.when(was > price, F.nullif(pct, F.lit(0)))


def nights(start: Column, end: Column, most: int = 30) -> Column:
    """Nights between two dates if 1 to ``most``, else null. [NUM10, NUM11]"""
    n = F.datediff(end, start)
    return F.when(n.between(1, most), n)


def count_for_length(stated: Column, for_nights: Column, n: Column) -> Column:
    """A count that holds for the length it was stated for only; unknown is 0. [NUM12]"""
    return F.when(stated.isNotNull() & (for_nights.isNull() | (for_nights == n)), stated).otherwise(F.lit(0))


def moved(was: Column, now: Column) -> Column:
    """struct(delta, pct) of a price move. [NUM13]"""
    return F.struct((now - was).alias("delta"), (100 * F.try_divide((now - was).cast("double"), was.cast("double"))).alias("pct"))


def amount_key(amount: Column, currency: Column) -> Column:
    """What two stated amounts are compared by. [NUM15]"""
    return F.when(amount.isNotNull(), F.struct(F.round(amount.cast(MONEY), 2).alias("amount"), currency.alias("currency")))


#: The units that charges are stated in.
BASES = ("per_trip", "per_night", "per_day", "per_diving_day", "per_person_day", "per_dive", "per_week")
BASIS_WORDS = {"trip": "per_trip", "night": "per_night", "day": "per_day", "diving day": "per_diving_day", "person per day": "per_person_day", "dive": "per_dive", "week": "per_week"}


def basis_for(words: Column) -> Column:
    """The unit that a seller's words stand for, null if unknown. [NUM16]"""
    return F.try_element_at(F.create_map(*[F.lit(v) for pair in BASIS_WORDS.items() for v in pair]), F.lower(F.trim(words)))


def factor(basis: Column, n: Column, dives: Column) -> Column:
    """How often a charge of that unit falls due on a trip; an unknown unit is an error, per dive without dives null. [BIL02]"""
    return (
        F.when(basis == "per_trip", 1).when(basis.isin("per_night", "per_diving_day"), n).when(basis.isin("per_day", "per_person_day"), n + 1)
        .when(basis == "per_dive", F.nullif(dives, F.lit(0))).when(basis == "per_week", F.greatest(F.lit(1), F.ceil(n / 7).cast("int")))
        .otherwise(F.raise_error(F.concat(F.lit("unknown unit "), basis)).cast("int"))
    )


def in_season(valid_from: Column, valid_to: Column, start: Column, end: Column) -> Column:
    """Does a validity, open where null, overlap the season? [NUM17]"""
    return F.coalesce(valid_from <= end, F.lit(True)) & F.coalesce(valid_to >= start, F.lit(True))


def season_months(start: Column, end: Column) -> Column:
    """First days of the months of a season. [NUM18]"""
    return F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))


def date_span(start: Column, end: Column) -> Column:
    """"3 - 10 Jan 2027", months and years once where they agree. [NUM19]"""
    same_month = F.trunc(start, "month") == F.trunc(end, "month")
    head = F.when(same_month, F.date_format(start, "d")).when(F.year(start) == F.year(end), F.date_format(start, "d MMM")).otherwise(F.date_format(start, "d MMM yyyy"))
    return F.concat(head, F.lit(" - "), F.date_format(end, "d MMM yyyy"))


def entry_count(stated: Column, implied: Column) -> Column:
    """The stricter of two minimum counts. [NUM20]"""
    return F.greatest(F.coalesce(stated, F.lit(0)), F.coalesce(implied, F.lit(0)))


def entry_rank(level_rank: Column, count: Column) -> Column:
    """Sortable bar: level, then count; -1 if unknown. [NUM21]"""
    return F.coalesce(level_rank * 1000 + F.coalesce(count, F.lit(0)), F.lit(-1))


def per_unit(total: Column, n: Column) -> Column:
    """Total by dive or night; null where that is 0 or unknown. [NUM22]"""
    return F.try_divide(total.cast("double"), n.cast("double"))


def single_price(price: Column, supplement_pct: Column) -> Column:
    """Price for one in a double room. [NUM23]"""
    return price * (1 + supplement_pct / 100)
