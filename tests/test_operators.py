"""Rules of joins, windows, bills, sales, changes, facets and state on small domain fixtures."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plumbline.operators import aggregates, bills, changes, facets, figures, joins, sales, state, windows


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_merge_and_own_price(spark):
    a = spark.createDataFrame([("b1", 1, 10.0)], "boat string, day int, price double")
    b = spark.createDataFrame([("b1", 1, 9.0), ("b1", 2, 8.0)], a.schema)
    got = joins.merge_sellers([("one", a), ("two", b)], ["boat", "day"])
    assert rows(got, "day") == [("b1", 1, 10.0, "one"), ("b1", 2, 8.0, "two")]
    priced = joins.attach_prices(got, "two", b, ["boat", "day"], "price", "two_price")
    assert [r.two_price for r in priced.orderBy("day").collect()] == [9.0, None]


def test_missing_dimension_is_an_error(spark):
    f = spark.createDataFrame([(1,), (2,)], "k int")
    d = spark.createDataFrame([(1, "x")], "id int, name string")
    with pytest.raises(Exception, match="no id for k 2"):
        joins.must_join(f, d, "k", "id").collect()


def test_ambiguous_keys_are_refused(spark):
    book = spark.createDataFrame([("a b", "ab", 1), ("a-b", "ab", 2), ("c d", "cd", 3)], "exact string, loose string, id int")
    q = spark.createDataFrame([("a b", "ab"), ("ab", "ab"), ("cd", "cd")], "exact string, loose string")
    assert rows(joins.exact_then_loose(q, book, "exact", "loose", "id").select("exact", "id", "match"), "exact") == [("a b", 1, "exact"), ("ab", None, None), ("cd", 3, "loose")]


def test_units_are_borrowed_only_where_clear(spark):
    schema = "bill_id string, code string, amount double, currency string, basis string, unit_unstated boolean, source string"
    lines = spark.createDataFrame([("b", "park", 90.0, "EUR", None, True, "x"), ("b", "port", 50.0, "EUR", None, True, "x")], schema)
    lend = spark.createDataFrame([("o", "park", 90.001, "EUR", "per_week", False, "y"), ("o", "port", 50.0, "EUR", "per_trip", False, "y"), ("p", "port", 50.0, "EUR", "per_day", False, "y")], schema)
    assert rows(joins.borrow_units(lines, lend).select("code", "basis", "unit_unstated", "unit_lent"), "code") == [("park", "per_week", False, True), ("port", None, True, False)]
    assert [r.unit_lent for r in joins.borrow_units(lines, lend, without=["y"]).collect()] == [False, False]


def test_as_of_is_strictly_earlier(spark):
    d = spark.createDataFrame([("a", dt.date(2027, 1, d), v) for d, v in ((1, 10), (1, 11), (3, 12))] + [("b", dt.date(2027, 1, 2), 5)], "k string, day date, v int")
    assert rows(joins.as_of(d, ["k"], "day", ["v"], tie=["v"]).select("k", "v", "prev_v"), "k", "v") == [("a", 10, None), ("a", 11, None), ("a", 12, 11), ("b", 5, None)]


def test_runs_and_their_summary(spark):
    d = spark.createDataFrame([("b", i, s) for i, s in enumerate([True, True, False, True], 1)] + [("b", 5, None)], "boat string, start int, sale boolean")
    got = windows.runs(d, ["boat"], ["start"], "sale").groupBy("run").agg(F.min("start").alias("a"), F.max("start").alias("z"))
    assert rows(got, "a") == [(0, 1, 2), (1, 4, 4)]


def test_best_and_worst_are_whole_rows(spark):
    d = spark.createDataFrame([("s", 1, 100.0, 150.0), ("s", 2, 90.0, 200.0), ("s", 3, None, 10.0)], "sailing string, seller int, low double, high double")
    r = windows.best_and_worst(d, ["sailing"], "low", "high", "seller").first()
    assert (r.best.seller, r.worst.seller, r.top.seller, r.spread) == (2, 1, 2, 10.0)


def test_sold_through(spark):
    t = "array<struct<name:string,price:double,places:int>>"
    d = spark.createDataFrame([([("a", 1.0, 2), ("b", 2.0, 1)], [("a", 1.0, 0), ("b", 2.0, 1)]), ([("a", 1.0, 2)], [("a", 1.0, 1)])], f"was {t}, now {t}")
    assert [r[0] for r in d.select(windows.sold_through(F.col("was"), F.col("now"))).collect()] == [True, False]


LINE = "bill_id string, code string, tier string, amount decimal(18,4), amount_max decimal(18,4), currency string, basis string, included boolean, unit_unstated boolean, note string, level int, position int, nights int, dives int"


def line(code, tier, amount, basis="per_trip", high=None, included=False, unstated=False, note=None, level=0, position=0, currency="EUR"):
    d = lambda x: None if x is None else Decimal(x)
    return ("b", code, tier, d(amount), d(high), currency, basis, included, unstated, note, level, position, 7, 0)


def bill(spark, lines, toggles=None, words=None):
    priced = bills.bill_lines(spark.createDataFrame(lines, LINE), spark.createDataFrame([("USD", "0.5")], "currency string, rate string"), toggles, words=words)
    base = spark.createDataFrame([("b", Decimal(1000))], "bill_id string, base decimal(28,10)")
    return priced, bills.totals(base, priced).first()


def test_bill_counts_units_ranges_and_toggles(spark):
    lines = [line("park", "mandatory", 10, "per_night", high=20), line("tips", "customary", 50), line("nitrox", "optional", 100, currency="USD"), line("fuel", "mandatory", 30, unstated=True), line("food", "mandatory", 5, included=True)]
    priced, t = bill(spark, lines)
    assert (t.total, t.total_max, t.required, t.unpriced) == (1120, 1190, 1070, ["fuel"]) and t.mandatory_known
    assert bill(spark, lines, {"nitrox": True, "tips": False})[1].total == 1120
    assert bills.disclosure(F.lit(True), F.array(F.lit("fuel"))) is not None


def test_bill_resolves_estimates_and_subsumes(spark):
    assert bill(spark, [line("park", "mandatory", 10), line("park", "mandatory", 25, level=1)])[1].total == 1025
    t = bill(spark, [line("gear", "optional", None)], {"gear": True})[1]
    assert (t.total, t.estimated) == (1180, True)
    both = [line("bundle", "mandatory", 100, note="park and port fees", position=0), line("park", "mandatory", 40, position=1)]
    priced, t = bill(spark, both, words={"park": "park", "port": "port"})
    assert t.total == 1100 and {r.code: r.subsumed_by for r in priced.collect()} == {"bundle": None, "park": "bundle"}


def test_seller_bill_needs_to_be_complete(spark):
    own = spark.createDataFrame([("b", "nitrox", "optional"), ("b", "park", "mandatory")], "bill_id string, code string, tier string")
    theirs = spark.createDataFrame([("b", "port", "mandatory")], own.schema)
    done = lambda v: spark.createDataFrame([("b", v)], "bill_id string, complete boolean")
    assert rows(bills.seller_bill(own, theirs, done(True)), "code") == [("b", "nitrox", "optional"), ("b", "port", "mandatory")]
    assert rows(bills.seller_bill(own, theirs, done(False))) == []


def test_sales(spark):
    readings = spark.createDataFrame([("s", "a", 90.0, 100.0), ("s", "b", 80.0, 80.0)], "sailing string, seller string, price double, was double")
    prices = sales.list_prices(readings)
    assert rows(prices, "seller") == [("s", "a", 90.0, 100.0), ("s", "b", 80.0, None)]
    own = spark.createDataFrame([("s", "b")], "sailing string, seller string")
    assert tuple(sales.sale(prices, own).first()) == ("s", ["a"], None, None)
    rungs = spark.createDataFrame([("s", "a", 103.1), ("t", "a", 102.9)], "sailing string, seller string, price double")
    refs = spark.createDataFrame([("s", "a", None, 100.0), ("t", "a", None, 100.0)], "sailing string, seller string, own_price double, row_price double")
    assert [r.sailing for r in sales.stale_ladders(rungs, refs).collect()] == ["s"]


def test_vanished_not_withdrawn(spark):
    before = spark.createDataFrame([("x", i, "a") for i in range(3)] + [("y", i, "a") for i in (10, 11)], "boat string, id int, seller string")
    after = spark.createDataFrame([("z", 20, "a")], before.schema)
    gone = changes.vanished(before, after, ["boat"])
    assert rows(gone.select("boat", "n", "how")) == [("x", 3, "gone")]
    d = changes.diff(before, after, "id", ["boat"]).withColumn("boat", F.coalesce("was_boat", "now_boat"))
    left = changes.added_and_withdrawn(d, gone, ["boat"])
    assert rows(left.groupBy("boat", "bucket").count(), "boat") == [("y", "withdrawn", 2), ("z", "added", 1)]
    empty = spark.createDataFrame([("x", "a")], "boat string, seller string")
    assert changes.vanished(before, after, ["boat"], read_empty=empty).first().how == "emptied"


@pytest.mark.parametrize("was, now, a, b, want", [(100.0, 104.99, "EUR", "EUR", "rounding"), (100.0, 105.0, "EUR", "EUR", "rose"), (100.0, 90.0, "EUR", "EUR", "fell"), (100.0, 90.0, "USD", "EUR", "currency"), (None, 1.0, "EUR", "EUR", None), (5.0, 5.0, "EUR", "EUR", None)])
def test_price_move(spark, was, now, a, b, want):
    d = spark.createDataFrame([(was, now, a, b)], "w double, n double, a string, b string")
    assert d.select(changes.price_move(F.col("w"), F.col("n"), F.col("a"), F.col("b"))).first()[0] == want


def test_facets_skip_their_own_selection(spark):
    d = spark.createDataFrame([(1, "a", ["p"], None), (2, "b", ["p", "q"], 10), (3, "b", ["q"], 99)], "id int, port string, sites array<string>, guests int")
    f = facets.Filters(any_of={"port": ["a"]}, all_of={"sites": ["p"]}, ranges={"guests": (0, 50)})
    assert {(r.facet, r.value): r.n for r in facets.facet_counts(d, f, ["port", "sites"]).collect()} == {("port", "a"): 1, ("port", "b"): 1, ("sites", "p"): 1}
    assert [r.id for r in d.where(facets.passes(f)).collect()] == [1]
    assert d.where(facets.passes(facets.Filters(ranges={"guests": (0, 50)}, hide_unstated=True))).count() == 1


def test_state(spark):
    day = lambda d: dt.date(2027, 1, d)
    today = F.lit(day(20)).cast("date")
    old = spark.createDataFrame([("a", day(10)), ("b", day(1)), ("c", day(19))], "key string, read_day date")
    new = spark.createDataFrame([("c", day(20))], old.schema)
    unread = spark.createDataFrame([("a",), ("b",)], "key string")
    assert rows(state.carry_unread(old, new, unread, "key", today), "key") == [("a", day(10)), ("c", day(20))]
    skips = spark.createDataFrame([("a", day(15)), ("b", day(1)), ("d", day(18))], "key string, checked date")
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    assert rows(state.update_skip_list(skips, keys("a", "e"), keys("a"), today), "key") == [("d", day(18)), ("e", day(20))]
    assert rows(state.skip_list(skips, today), "key") == [("a", day(15)) [:1], ("d",)]
    assert state.skip_list(skips, today, recheck=True).count() == 0
    once = state.merge_latest(old, new, ["key"], "read_day")
    assert rows(state.merge_latest(once, new, ["key"], "read_day"), "key") == rows(once, "key")


def test_gate_stops_publication(spark):
    m = spark.createDataFrame([(50, 100)], "new int, old int")
    gates = state.gate(m, {"rows": state.publishable(F.col("new"), F.col("old"))})
    with pytest.raises(Exception, match="not published: rows"):
        state.enforce(m, gates).collect()
    assert state.enforce(m, state.gate(m, {"rows": F.lit(True)})).count() == 1


def test_votes_and_strict_sums(spark):
    d = spark.createDataFrame([("k", 2), ("k", 1), ("k", None)], "k string, v int")
    assert aggregates.vote(d, ["k"], "v", "m").first().m == 1 and aggregates.vote(d, ["k"], "v", "m", largest=True).first().m == 2
    assert d.agg(aggregates.strict_sum(F.col("v")).alias("s")).first().s is None


def test_trips_are_grouped_by_cleaned_title(spark):
    d = lambda n: dt.date(2027, 1, n)
    data = [("b", "Reefs (North - South), 20% off", d(1), d(8)), ("b", "Reefs (North - South)", d(8), d(15)), ("b", "Reefs", d(16), d(20)), ("b", " ", d(1), d(3)), (None, "Reefs", d(1), d(8)), ("c", "Reefs", d(8), d(8))]
    trips, skipped = figures.trips(spark.createDataFrame(data, "boat string, name string, start date, end date"))
    assert rows(trips.select("boat", "trip", "nights", "departures"), "trip") == [("b", "Reefs", 7, 3), ("b", "Unnamed itinerary", 2, 1)]
    assert rows(skipped.select("boat", "skipped"), "skipped") == [("c", "implausible dates"), (None, "no boat")]


def test_figures_without_rows_are_unknown(spark):
    none = spark.createDataFrame([("b", 1, None)], "boat string, trip int, estimated boolean")
    got = figures.stated_figures({"estimate": figures.estimate_reach(none), "rows": none.agg(F.count("*").alias("n"))})
    assert rows(got, "figure") == [("estimate.trips", None), ("estimate.vessels", None), ("rows.n", 1.0)]


def test_optional_lines_and_sites(spark):
    e = spark.createDataFrame([("b", 0, "Gear set (full)", "per trip", 90.0, "EUR", "mask, fins"), ("b", 1, "Gear set", "per course", 1.0, "EUR", None), ("b", 2, "Espresso", "per trip", 2.0, "EUR", None), ("b", 3, "Nitrox", "Per Dive", None, None, "")], "bill_id string, position int, title string, paid_per string, amount double, currency string, contents string")
    got = figures.optional_lines(e, [("(?i)gear", "gear"), ("(?i)nitrox", "nitrox")], "(?i)package", ["(?i)park", "(?i)port"], "combined")
    assert rows(got.select("position", "code", "basis", "amount", "note", "tier"), "position") == [(0, "gear", "per_trip", 90.0, "Gear set (full): mask, fins", "optional"), (3, "nitrox", "per_dive", None, "Nitrox", "optional")]
    hints = [("far reef", "Far Reef"), ("near reef", "Near Reef")]
    d = spark.createDataFrame([(["at sea", "<p>Near Reef</p>"], "Far Reef"), ([], "Far Reef"), (None, None)], "days array<string>, blurb string")
    assert [r[0] for r in d.select(figures.sites_of_trip(F.col("days"), F.col("blurb"), hints)).collect()] == [["Near Reef"], ["Far Reef"], []]


def test_lines_that_lie_by_bill_are_not_shuffled_again(spark):
    lines = spark.createDataFrame([("b", "all", "mandatory", None, None, "EUR", "per_trip", False, False, "park", 0, 0, 7, 0)], "bill_id string, code string, tier string, amount decimal(18,4), amount_max decimal(18,4), currency string, basis string, included boolean, unit_unstated boolean, note string, level int, position int, nights int, dives int")
    rates = spark.range(1).select(F.lit("USD").alias("currency"), F.lit("0.5").alias("rate"))  # of a known size, so it is broadcast
    out = bills.bill_lines(lines.repartition(4, "bill_id"), rates, words={"park": "park", "visa": "visa"})
    assert out._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(bill_id") == 1
