"""Extraction and sources on re-created minimal fixtures; streaming against the batch plan."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from plumbline.sources import extract, readers
from plumbline.streaming import events as streams

PAGE = """<html><script>var x=1;</script><p>One &amp; two</p><p>Three</p><a href="/boat/a-1">x</a><a href="/boat/a-1">y</a>
<script type="application/ld+json">{"@type": "Product", "event": [{"@type": ["Event"], "name": "Trip", "startDate": "2027-05-01T10:00", "organizer": {"name": " Blue  Co "},
"location": {"address": {"addressRegion": "Red Sea"}}, "offers": [{"price": "900.50", "priceCurrency": "EUR", "availability": "http://x/SoldOut"}]}, {"@type": "Event", "name": "undated"}]}</script>
<script type="application/ld+json">{broken</script></html>"""


def test_linked_data(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "<p>none</p>"), (3, None)], "page int, html string")
    events = extract.nodes(pages, "html", ("Event",)).drop("html")
    assert events.count() == 2
    r = extract.departures(events).first()
    assert (r.page, r.name, r.start, float(r.price), r.availability, r.operator, r.location) == (1, "Trip", dt.date(2027, 5, 1), 900.5, "sold_out", "Blue Co", "Red Sea")
    assert {(x.what, x.value): x.n for x in extract.structure(pages, "html").collect()}[("link", "/boat/a-#")] == 2


def test_text_of_pages(spark):
    one = lambda html, f: spark.createDataFrame([(html,)], "h string").select(f(F.col("h"))).first()[0]
    assert one("<p>One &amp; two</p><div>Three</div><style>x</style>", lambda c: extract.text.visible_text(c)) == "One & two, Three"
    assert one(PAGE, lambda c: extract.links(c, r'href="(/boat/[^"]*)"')) == ["/boat/a-1"]
    assert one("<p>a</p><p> </p><p>b</p>", extract.paragraphs) == ["a", "b"]
    assert one("<table><tr><th>Length</th><td>40 m</td></tr><tr><th>Length</th><td>41 m</td></tr></table>", extract.spec_table) == {"Length": "40 m"}
    got = one("Intro<strong>Day 1</strong>Dive Rocky<strong>Food</strong>Good", extract.sections)
    assert [(s.heading, s.body) for s in got] == [(None, "Intro"), ("Day 1", "Dive Rocky"), ("Food", "Good")]
    assert one("North (A - B) 7 Nights", extract.title_nights) == ("North", "A - B", 7)
    assert one("North 7 nights / 8 nights", extract.title_nights).nights is None


def test_fee_lines(spark):
    body = "Included in the price: nitrox, food. Required: Park fees (€10-15 per night), Fuel 1,200 EUR, Visa. Optional: Nitrox, Gear 20 per day."
    got = spark.sql("SELECT 1 AS k").select(F.lit(body).alias("b")).lateralJoin(extract.ParseFees(F.col("b").outer(), F.lit("EUR"))).drop("b").collect()
    by = {r.label.lower(): r for r in got}
    assert (by["park fees"].amount, by["park fees"].amount_max, by["park fees"].basis, by["park fees"].currency) == (10.0, 15.0, "per_night", "EUR")
    assert (by["fuel"].amount, by["fuel"].unit_unstated) == (1200.0, True)
    assert by["nitrox"].block == "included" and by["gear"].basis == "per_day" and by["visa"].amount is None


def test_trip_fragment(spark):
    html = """<h2 class=x>Deep &amp; South</h2><h3>Key regions</h3><ol class=y><li title=Daedalus>D<li title="Abu Dabab">A<li title="Red Sea">R<li title=Daedalus>D</ol>
    <dt>Dives <dd>Approximately 18 dives in total<dt>Group Size <dd>Up to 20 guests<strong>Experience</strong> <span>Advanced - 50 minimum logged dives</span>
    <h3>What to expect</h3><figure>map</figure><div class="prose z">We <b>sail</b>.<p><strong>Sample</strong><strong>Day 1:</strong><ul><li>Board<li>Sleep</ul></div><strong>Else</strong>no"""
    d = spark.createDataFrame([(1, html), (2, None), (3, "<dt>Dives <dd>400 dives")], "k int, h string").select("k", extract.trip(F.col("h")).alias("t"), extract.regions(F.col("h")).alias("r"))
    a, b, c = (x for x in d.orderBy("k").collect())
    assert (a.t.name, a.t.regions, a.t.dives, a.t.guests, a.t.experience, a.t.intro) == ("Deep & South", ["Daedalus", "Abu Dabab"], 18, 20, "Advanced - 50 minimum logged dives", "We sail .")
    assert [(s.heading, s.body) for s in a.t.sections] == [("Day 1:", "Board Sleep")] and a.r == a.t.regions
    assert (b.t.name, b.t.regions, b.t.dives, b.t.sections, c.t.dives) == (None, [], None, [], None)


def test_fee_excerpts(spark):
    body = "Included: VAT, Nitrox.\nRequired Extras: Tax\n(€45)\nFuel " + "x" * 2000 + "\nOptional Extras: Gear"
    got = spark.createDataFrame([(body,), (None,)], "b string").select(extract.fee_excerpts(F.col("b"))).collect()
    assert got[0][0]["included"].startswith("VAT, Nitrox.") and got[0][0]["required"].startswith("Tax (€45), Fuel xx") and len(got[0][0]["required"]) == 1500 and got[0][0]["optional"] == "Gear" and got[1][0] == {}


def test_gear_line(spark):
    row = lambda a, b: f"<li><strong>{a}</strong> <span>{b}</span></li>"
    title, single, full = "Rental Gear Prices ", row("BCD", "€83 / week") + row("Nitrox tank", "Included"), "Full equipment rent "
    texts = [title + single + full + row("Set", "€40-60 / item"), title + single + full + row("Set", "$40"), title + single, title + row("Mask", "ask"), title, "Else " + single, None]
    d = extract.gear_line(extract.gear_items(spark.createDataFrame(list(enumerate(texts)), "k int, h string"), "k", "h", F.lit("EUR")), "k")
    got = {r.k: r for r in d.collect()}
    assert sorted(got) == [0, 1, 2, 3] and all((r.code, r.tier, r.included) == ("gear_rental", "optional", False) for r in got.values())
    assert tuple(got[0])[4:] == (40.0, 60.0, "EUR", "per_trip", False, "Set €40-60 / item")
    assert tuple(got[1])[4:] == (40.0, None, "USD", "per_trip", True, "Set $40")
    assert tuple(got[2])[4:] == (None, None, None, "per_week", False, "BCD €83 / week; Nitrox tank Included")
    assert (got[3].basis, got[3].note) == ("per_trip", "Mask ask")


def test_schedule_walk(spark):
    e = lambda *ids, day="2027-05-01": [(i, day) for i in ids]
    rows = [("fresh", 1, e("a", "b"), None), ("fresh", 2, e("b", "a"), None), ("fresh", 3, e("c"), None), ("total", 1, e("a"), 2), ("total", 2, e("a", "b"), 2), ("total", 3, e("c"), 2),
            ("season", 1, e("a", day="2027-12-01"), None), ("season", 2, e("b"), None), ("unread", 1, e("a"), None), ("unread", 2, None, None), ("gap", 1, e("a"), None), ("gap", 3, e("b"), None), ("open", 1, e("a"), 9), ("none", 1, [], 0)]
    found, states = readers.schedule_walk(spark.createDataFrame(rows, "key string, page int, entries array<struct<id:string,start:string>>, total int"), "2027-10-31")
    assert sorted((r.key, r.page, r.entry.id) for r in found.collect()) == [("fresh", 1, "a"), ("fresh", 1, "b"), ("open", 1, "a"), ("season", 1, "a"), ("total", 1, "a"), ("total", 2, "b")]
    assert {r.key: r.state for r in states.collect()} == {"fresh": "read", "total": "read", "season": "read", "unread": "unread", "gap": "unread", "open": "unfinished", "none": "read"}


def test_cabins(spark):
    """A page as served: attributes quoted only where they must be, entities, dialogs after the listings, surcharges by id."""
    room = lambda i, title, mark, now, rest: f"<li><button type=button aria-controls=help-content-cabin-details-{i} title={title}>x</button><ol><li><span>2 People</span></li><li><span class=b title=Beds>1 Double &amp; 1 Twin</span></li></ol>{rest}<em class=c>{mark}</em><span class=n translate=no>{now}</span>"
    html = (
        room(71, '"Lower &amp; Twin"', "&#x20AC;", "1,080", "<del>€1,350</del><p>only 3 spaces left</p><select id=s name=input-cabin-guests-71 data-allocation=3><option value=1>1 person</select>")
        + "<div id=private-cabin-help-text-71>a <b>60%</b> surcharge applies</div>" + room(7, "Suite", "$", "2,000.50", "<span>FULL</span>") + "<div id=privacy-optional-help-text-7>for an additional 80% surcharge</div>"
        + room(8, "Deck", "£", "900", '<select name="input-cabin-guests-8" data-allocation="0"></select>') + room(9, "Untitled", "", "", "<select name=input-cabin-guests-9>")
        + "<div id=help-content-cabin-details-71><button aria-controls=help-content-cabin-details-71 aria-label='Close dialog'></div>"
    )
    a, b, c = extract.cabins(spark.createDataFrame([("p", html), ("empty", ""), ("none", None)], "page string, h string"), "h", F.lit("EUR")).orderBy("position").collect()
    assert (a.cabin_id, a.name, a.sleeps, a.beds, a.price, a.list_price, a.berths, a.spaces_left, a.sold_out, a.supplement, a.shown) == ("71", "Lower & Twin", 2, "1 Double & 1 Twin", 1080.0, 1350.0, 3, 3, False, 60, None)
    assert (b.cabin_id, b.name, b.price, b.list_price, b.berths, b.sold_out, b.supplement, b.shown) == ("7", "Suite", 2000.5, None, 0, True, 80, None)
    assert (c.name, c.berths, c.sold_out, c.supplement, c.shown) == ("Deck", 0, False, None, "GBP")


def test_streamed_objects(spark):
    """Text rows by byte length: over line breaks, beside what looks like a row, at the head of a chunk, in other scripts."""
    text = "Day 1\nwreck – é\n3d:T5,no row"
    body = f"0:[]\n3f:T{len(text.encode()):x},{text}3e:T2,ok\n5:" + json.dumps({"a": {"details": {"text": "$3f", "list": ["$3e", "$7", "$x"]}}})
    half = len(body) // 2
    html = "".join(f"self.__next_f.push([1,{json.dumps(part)}])" for part in (body[:half], body[half:])) + 'push([1,"\\x"])'
    r = spark.createDataFrame([(html,), (None,), ("",)], "h string").lateralJoin(extract.StreamedObjects(F.col("h").outer(), F.lit("details"))).collect()
    assert len(r) == 1 and r[0].undecoded == 1
    assert json.loads(r[0].node)["details"] == {"text": text, "list": ["ok", "$7", "$x"]}
    assert extract.text_rows(body) == {"3f": text, "3e": "ok"}


def test_schedule(spark):
    body = json.dumps([{"name": "A", "nights": 7, "departureDate": {"date": "2027-05-01"}, "price": {"current": "900", "oldPrice": "800"}, "availability": 3, "boatTripId": "t"}, {"name": "B", "nights": 3, "departureDate": {"date": "2027-06-01"}, "price": {"current": "5"}, "charterOnly": True}])
    a, b = extract.schedule(spark.createDataFrame([("x", body)], "boat string, j string"), "j", F.lit("EUR")).orderBy("start").collect()
    assert (a.end, float(a.price), a.was) == (dt.date(2027, 5, 8), 900.0, None) and b.price is None


def test_rates(spark):
    xml = "<Cube time='2027-01-05'><Cube currency='USD' rate='1.0990'/><Cube currency='GBP' rate='0.85'/></Cube>"
    got = {r.currency: str(r.rate) for r in readers.rates_from_xml(spark.createDataFrame([(xml,)], "x string"), "x").collect()}
    assert got["USD"] == "0.909918"
    with pytest.raises(Exception, match="rate sheet"):
        readers.rates_from_xml(spark.createDataFrame([("<Cube/>",)], "x string"), "x").collect()


def test_dataset_document_and_optional_book(spark, tmp_path):
    doc = {"operators": [{"id": "o", "name": "O"}], "boats": [], "itineraries": [], "departures": [{"id": "d", "itinerary_id": "i", "start": "2027-01-02", "end": "2027-01-09", "price": {"amount": 1000.10, "currency": "USD"}}]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    d = readers.dataset(spark, str(tmp_path / "d.json"))["departures"].first()
    assert (str(d.price_amount), d.start) == ("1000.1000", dt.date(2027, 1, 2))
    assert readers.optional(spark, str(tmp_path / "absent.json"), "a string").count() == 0 and readers.optional(spark, None, "a string").count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", None), ("a", 1.5)], "k string, m double")
    readers.export_csv(df, str(tmp_path / "csv"), ["k"], ["m"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("part-*")))
    assert text.splitlines() == ["k,m", "a,1.50", "b,"]
    assert [r.json for r in readers.payload(df).collect()] == ['{"k":"b"}', '{"k":"a","m":1.5}']


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1, i % 5, 10), i % 3, "v", float(i), "{}") for i in range(40)]
    df = spark.createDataFrame(rows, streams.EVENTS)
    df.repartition(3).write.parquet(str(tmp_path / "events"))
    q = streams.windowed(streams.read_events(spark, str(tmp_path / "events")), late="1 day").writeStream.outputMode("complete").format("memory").queryName("got").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("got").collect())) == sorted(map(tuple, streams.windowed(df).collect()))
