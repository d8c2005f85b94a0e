"""Golden vectors of text and money functions."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plumbline.functions import money, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("given, key", [("Sha'ab", "shaab"), ("Sha’ab", "shaab"), ("St. John's", "st johns"), ("St. John´s", "st johns"), ("Brothers & Daedalus", "brothers and daedalus"), ("Ñandú", "nandu"), ("", ""), (None, None)])
def test_keys(spark, given, key):
    assert one(spark, given, text.norm_key) == key
    assert one(spark, given, text.latin_key) == key


def test_slug_and_space(spark):
    assert one(spark, "Brothers, Daedalus & Elphinstone (Hurghada - Hurghada)", text.slugify) == "brothers-daedalus-elphinstone-hurghada-hurghada"
    assert one(spark, "  a \n b ", text.collapsed) == "a b"
    assert one(spark, None, text.collapsed) is None


def test_split_title(spark):
    got = one(spark, "North & Brothers (Hurghada - Port Ghalib), 20% off", lambda c: text.split_title(c))
    assert (got.trip, got.port_from, got.port_to) == ("North & Brothers", "Hurghada", "Port Ghalib") and "20% off" in got.promotion
    got = one(spark, "Best of (Brothers - Daedalus)", lambda c: text.split_title(c, ["brothers"]))
    assert got.port_from is None and "(Brothers - Daedalus)" in got.trip


def test_lists(spark):
    vocabulary = ["brothers", "daedalus", "rocky"]
    assert one(spark, "Brothers, Daedalus and Rocky", lambda c: text.is_vocabulary_list(c, vocabulary)) is True
    assert one(spark, "Brothers", lambda c: text.is_vocabulary_list(c, vocabulary)) is False
    assert one(spark, "Brothers,Daedalus and Rocky", lambda c: text.display_title(c, vocabulary=vocabulary)) == "Brothers, Daedalus & Rocky"
    assert one(spark, ["a", None, "b"], lambda c: text.joined_list(c, " and "), "array<string>") == "a and b"
    assert one(spark, [], text.joined_list, "array<string>") == ""
    assert one(spark, ["Sha'ab", "X"], lambda c: text.ordered_union(c, F.array(F.lit("shaab"), F.lit("Y"))), "array<string>") == ["Sha'ab", "X", "Y"]


def test_vocabulary_and_rules(spark):
    f = lambda c: text.vocabulary_matches(c, [("st johns", "St. John's")], [("rocky", "Rocky Island")])
    assert one(spark, "From Rocky to St. John's reef", f) == ["St. John's", "Rocky Island"]
    assert one(spark, "Rockynut", f) == []
    rules = [("(?i)nitrox", "nitrox"), ("(?i)tax|fee", "fee")]
    classify = lambda c: text.classify_label(c, rules, r"(?i)\bfees?$", ["(?i)park", "(?i)port", "(?i)fuel"], "combined")
    assert one(spark, "Park and port fees", classify) == "combined"
    assert one(spark, "Nitrox fee", classify) == "nitrox"
    assert one(spark, "x" * 80, classify) is None


def test_numbers_and_dates(spark):
    assert one(spark, "1,234.50.", text.number) == 1234.5
    assert one(spark, "none", text.first_integer) == 0
    assert one(spark, "sleeps 24 guests", lambda c: text.bounded_number(c, ["sleeps ([0-9]+)"], 1, 20)) is None
    assert one(spark, "2027-02-30T00:00", text.iso_day) is None
    assert one(spark, "2027-02-03T00:00", text.iso_day) == dt.date(2027, 2, 3)
    got = one(spark, "from €1,200.50 pp", text.money_text)
    assert (got.amount, got.currency) == (1200.5, "EUR")
    assert one(spark, "https://x/SoldOut/", lambda c: text.last_segment(c, {"soldout": "sold_out"})) == "sold_out"
    assert one(spark, "boat/blue-horizon-123", text.split_slug) == ("blue-horizon", "123")
    assert one(spark, "mv-blue-boat", lambda c: text.without_noise(c, ["mv", "boat"])) == "blue"
    assert one(spark, "```text\nbody\n```", text.strip_fence) == "body"
    assert one(spark, "old [unit x as stated by y]", lambda c: text.noted_unit(c, F.lit("per_trip"), F.lit("b"))) == "old [unit per_trip as stated by b]"


def test_money(spark):
    assert one(spark, "120 USD", money.parse_money) == (Decimal("120.0000"), "USD")
    assert one(spark, "n/a", money.parse_money) is None
    for given, want in ((0.5, 0), (1.5, 2), (2.5, 2), (1560.5, 1560)):
        assert one(spark, given, money.whole, "double") == want
    cut = lambda a, b: spark.createDataFrame([(float(a), float(b))], "a double, b double").select(money.cut_pct(F.col("a"), F.col("b")).alias("y")).first().y
    assert (cut(1588, 2371), cut(67.5, 100), cut(996, 1000), cut(10, 5)) == (33, 32, None, None)
    rates = spark.createDataFrame([("USD", "0.858738")], "currency string, rate string")
    rows = spark.createDataFrame([(Decimal("1631"), "USD"), (Decimal("5"), "EUR"), (None, "XXX")], "amount decimal(18,4), currency string")
    got = [r.display for r in money.converted(rows, rates, "amount", "currency").collect()]
    assert got[0] == Decimal("1400.6016780000") and got[1] == Decimal("5") and got[2] is None
    bad = spark.createDataFrame([(Decimal("1"), "GBP")], "amount decimal(18,4), currency string")
    with pytest.raises(Exception, match="no rate for GBP"):
        money.converted(bad, rates, "amount", "currency").collect()


@pytest.mark.parametrize("basis, nights, dives, want", [("per_week", 3, 0, 1), ("per_week", 7, 0, 1), ("per_week", 8, 0, 2), ("per_week", 14, 0, 2), ("per_week", 15, 0, 3), ("per_day", 7, 0, 8), ("per_diving_day", 7, 0, 7), ("per_dive", 7, 0, None), ("per_dive", 7, 18, 18), ("per_trip", 7, 0, 1)])
def test_factor(spark, basis, nights, dives, want):
    row = spark.createDataFrame([(basis, nights, dives)], "b string, n int, d int")
    assert row.select(money.factor(F.col("b"), F.col("n"), F.col("d")).alias("y")).first().y == want


def test_unknown_unit_is_an_error(spark):
    with pytest.raises(Exception, match="unknown unit"):
        spark.createDataFrame([("per_moon", 1, 1)], "b string, n int, d int").select(money.factor(F.col("b"), F.col("n"), F.col("d"))).collect()
