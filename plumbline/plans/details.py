"""More registered queries: scalar functions, extraction, bills beyond the plain path, change and state rules.

Each reads whole driver tables; what the reference reads from pages and books is built from their columns, so every function runs on
all rows and its SQL states the same rows from the columns themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import money, text
from plumbline.operators import aggregates, bills, changes, facets, sales, state, windows
from plumbline.plans.queries import Tables, query, spread
from plumbline.sources import extract, readers
from plumbline.streaming import events as streams

_cat = F.concat


def _lit(x: str) -> F.Column:
    return F.lit(x)


# --- text ------------------------------------------------------------------------------------------------------------


@query(r"""
SELECT p_partkey, trim(regexp_replace('  ' || p_name || chr(9) || ' ' || p_type || ' ', '\s+', ' ', 'g')) AS collapsed, replace(replace(p_name, 'ring', 'loop'), 'oo', 'o') AS folded,
  regexp_replace(regexp_replace(lower('Se & ' || p_name || ' and ' || p_brand), '\band\b', '', 'g'), '[^a-z0-9]', '', 'g') AS loose, CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) AS first_number,
  replace(p_name, ' ', '-') AS slug, CAST(p_partkey AS VARCHAR) AS slug_id, CAST(1000 + p_size AS DOUBLE) AS number, TRY_CAST('2024-01-' || lpad(CAST(p_size AS VARCHAR), 2, '0') AS DATE) AS day,
  CASE p_size % 3 WHEN 0 THEN 'available' WHEN 1 THEN 'sold_out' END AS availability, array_to_string(list_filter(string_split(p_name, ' '), lambda x: x <> 'ring'), '-') AS bare,
  CASE WHEN p_type = 'ECONOMY' THEN 'Basic' ELSE p_type END AS port, CASE WHEN p_size % 2 = 0 THEN p_name || ', ' ELSE '' END || p_brand || ' & ' || p_type AS listed
FROM part
""", dates=("day",))
def text_scalars(t: Tables) -> DataFrame:
    """White space, folds, loose keys, numbers, slugs, days, availability, aliases and lists. [STR03, STR06, STR07, STR22, STR21, STR19, STR32, STR25, STR23, STR24, STR20, STR31, STR11, STR09, STR34]"""
    dashed = F.replace("p_name", _lit(" "), _lit("-"))
    path = text.split_slug(_cat(_lit("/boats/"), dashed, _lit("-"), F.col("p_partkey").cast("string")))
    size2 = F.lpad(F.col("p_size").cast("string"), 2, "0")
    url = _cat(_lit("https://schema.org/"), F.when(F.col("p_size") % 3 == 0, "InStock").when(F.col("p_size") % 3 == 1, "SoldOut").otherwise("Other"))
    return t.part.select(
        "p_partkey", text.collapsed(_cat(_lit("  "), "p_name", _lit("\t "), "p_type", _lit(" "))).alias("collapsed"), text.fold(F.col("p_name"), (("ring", "loop"), ("oo", "o"))).alias("folded"),
        text.loose_key(_cat(_lit("Sé & "), "p_name", _lit(" and "), "p_brand")).alias("loose"), text.first_integer(F.col("p_brand")).alias("first_number"), path["slug"].alias("slug"), path["id"].alias("slug_id"),
        text.number(_cat(_lit(" 1,"), F.lpad(F.col("p_size").cast("string"), 3, "0"), _lit("."))).alias("number"), text.iso_day(_cat(_lit("2024-01-"), size2, _lit("T10:00:00"))).alias("day"),
        text.last_segment(url, extract.AVAILABILITY).alias("availability"), text.without_noise(_cat(_lit("the-"), dashed), ("the", "ring")).alias("bare"), text.aliased(F.col("p_type"), {"economy": "Basic"}, "Unknown").alias("port"),
        text.joined_list(F.array(F.when(F.col("p_size") % 2 == 0, F.col("p_name")), F.col("p_brand"), F.col("p_type"))).alias("listed"),
    )


@query("""
SELECT p_partkey, p_name || CASE WHEN p_type IN ('PROMO', 'STANDARD') THEN ' (Port A - ' || p_type || ')' ELSE '' END AS trip, '20% off' AS promotion, CASE WHEN p_type NOT IN ('PROMO', 'STANDARD') THEN 'Port A' END AS port_from, CASE WHEN p_type NOT IN ('PROMO', 'STANDARD') THEN p_type END AS port_to,
  p_name AS name, 'A - ' || p_type AS ports, CASE WHEN p_size % 2 = 0 THEN 7 END AS nights, p_type || ' & Reef' AS title, p_type IN ('ECONOMY', 'STANDARD') AS places_only,
  'Reef+' || CASE WHEN lower(p_type) = 'reef' THEN '' ELSE p_type END AS joined, CASE WHEN p_type = 'ECONOMY' THEN 'Basic Reef' ELSE '' END AS listed, CASE WHEN p_type = 'ECONOMY' THEN 'Blue Hole+Eco' ELSE 'Blue Hole' END AS found
FROM part
""")
def text_titles(t: Tables) -> DataFrame:
    """Titles split, mended and read for places and sites. [STR04, STR05, STR08, STR10, STR13-STR15, EXT26, EXT27]"""
    split = text.split_title(_cat("p_name", _lit(" (Port A - "), "p_type", _lit("), 20% off")), places=("promo", "standard"))
    stay = extract.title_nights(_cat("p_name", _lit(" (A - "), "p_type", _lit(") "), F.when(F.col("p_size") % 2 == 0, "7 Nights").otherwise("7 Nights 10 Nights")))
    hints = (("blue hole", "Blue Hole"), ("economy", "Eco"))
    sections = F.array(F.struct(_lit("Day 1").alias("heading"), F.col("p_type").alias("body")), F.struct(_lit("Food").alias("heading"), _lit("economy").alias("body")))
    return t.part.select(
        "p_partkey", split["trip"].alias("trip"), split["promotion"].alias("promotion"), split["port_from"].alias("port_from"), split["port_to"].alias("port_to"),
        stay["name"].alias("name"), stay["ports"].alias("ports"), stay["nights"].alias("nights"), text.display_title(_cat("p_type", _lit(" and  Reeef ,")), (("Reeef", "Reef"),), ((" and +", " & "),)).alias("title"),
        text.is_vocabulary_list(_cat("p_type", _lit(" & Reef, Wall")), ("economy", "standard", "reef", "wall")).alias("places_only"),
        F.array_join(text.ordered_union(F.array(_lit("Reef")), F.array(F.col("p_type"), _lit("REEF"))), "+").alias("joined"),
        F.array_join(text.matches_of_list(F.array(F.col("p_type")), {"economy": "Basic Reef"}, (("no such reef", "None"),)), "+").alias("listed"),
        F.array_join(text.matches_of_sections(_lit("to the Blue Hole"), sections, hints), "+").alias("found"),
    )


@query("""
SELECT p_partkey, 'body ' || p_name AS entry, 'ask [unit per_night as stated by ' || p_brand || ']' AS note, CAST(p_size + 0.5 AS DOUBLE) AS amount, CASE p_size % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'GBP' ELSE 'CHF' END AS currency,
  p_size AS guests, CASE WHEN p_size > 20 THEN 'mandatory' ELSE 'optional' END AS tier, CASE WHEN p_size % 2 = 0 THEN 'combined' WHEN p_type = 'ECONOMY' THEN 'eco' END AS code,
  CASE WHEN p_size % 2 = 0 THEN 'charter' WHEN p_size % 3 = 0 THEN 'sold out' ELSE 'unexplained' END AS why, CASE WHEN p_type = 'ECONOMY' THEN 'advanced' END AS level, p_size AS dives
FROM part
""")
def text_prose(t: Tables) -> DataFrame:
    """Entries, notes, money, guests, tiers, labels, entry bars and reasons in prose. [STR18, STR26, STR28-STR30, STR33, STR35, STR36, EXT32, EXT33, EXT51]"""
    size = F.col("p_size").cast("string")
    paid = text.money_text(_cat(_lit("pay "), F.when(F.col("p_size") % 3 == 0, _lit("€")).when(F.col("p_size") % 3 == 1, _lit("£")).otherwise(_lit("CHF ")), size, _lit(".50 now")))
    label = F.when(F.col("p_size") % 2 == 0, "port and park fees").otherwise(F.lower("p_type"))
    code = text.classify_label(label, (("economy", "eco"),), r"\bfees\b", (r"\bport\b", r"\bpark\b"), "combined")
    bar = extract.requirements(_cat("p_type", _lit(" needs at least "), size, _lit(" logged dives")), (("(?i)economy", "advanced"),))
    availability = F.when(F.col("p_size") % 3 == 0, "sold_out").otherwise("available")
    return t.part.select(
        "p_partkey", text.strip_fence(_cat(_lit("head\n```text\nbody "), "p_name", _lit("\n```\ntail"))).alias("entry"), text.noted_unit(_lit("ask [unit per_trip as stated by x]"), _lit("per_night"), F.col("p_brand")).alias("note"),
        paid["amount"].alias("amount"), paid["currency"].alias("currency"), text.bounded_number(_cat(_lit("room for "), size, _lit(" guests")), (r"(\d+) divers", r"(\d+) guests"), 1, 60).alias("guests"),
        text.tier_for(_lit("fee"), F.col("p_size") > 20, ("gear",), ("tips",)).alias("tier"), code.alias("code"),
        extract.why_unpriced(F.when(F.col("p_size") % 2 == 0, "Full charter").otherwise("Reef"), availability).alias("why"), bar["level"].alias("level"), bar["dives"].alias("dives"),
    )


@query("""
SELECT p_partkey, trim(regexp_replace(replace(lower(p_name), 'ring', 'rincon'), '[^a-z0-9]+', ' ', 'g')) || ' and ' || lower(p_type) || ' brand ' || regexp_extract(p_brand, '[0-9]+') AS key FROM part
""")
def text_norm_key(t: Tables) -> DataFrame:
    """Comparable key by canonical decomposition, accents of any script stripped. [STR01]"""
    return t.part.select("p_partkey", text.norm_key(_cat(F.replace("p_name", _lit("ring"), _lit("Rin\u0327c\u00f3n")), _lit(" & "), "p_type", _lit("' \u1e02rand #"), F.regexp_extract("p_brand", "[0-9]+", 0))).alias("key"))


# --- money and dates -------------------------------------------------------------------------------------------------


@query("""
WITH o AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,4)) AS p, CAST(o_orderdate AS DATE) AS d, o_orderstatus AS s, CAST(o_orderkey % 40 AS INTEGER) AS k FROM orders)
SELECT o_orderkey, CAST(p AS DOUBLE) AS amount, 'USD' AS currency, CAST(p + 10 AS DOUBLE) AS added, CAST(p * 2 AS DOUBLE) AS doubled, date_diff('day', d, DATE '1998-01-01') > 7 AS stale, s = 'F' AS sourced,
  CASE WHEN k BETWEEN 1 AND 30 THEN k END AS nights, CASE WHEN k = 7 THEN 20 ELSE 0 END AS dives, CAST(-p / 4 AS DOUBLE) AS delta, CASE WHEN p > 0 THEN CAST(-25 AS DOUBLE) END AS pct, CAST(round(p, 2) AS DOUBLE) AS amount_key,
  CASE s WHEN 'F' THEN 'per_night' WHEN 'O' THEN 'per_trip' END AS basis, d <= DATE '1998-06-30' AND d + 30 >= DATE '1998-03-01' AS in_season, greatest(k, 10) AS entry, CASE WHEN s = 'F' THEN 2000 + k ELSE -1 END AS bar, CAST(p AS DOUBLE) * (1 + k / 100.0) AS single, CASE WHEN k > 0 THEN k END AS cut
FROM o
""")
def money_scalars(t: Tables) -> DataFrame:
    """Money parsed, added, scaled, compared; nights, seasons and bars. [NUM01-NUM03, NUM06, NUM07, NUM09, NUM11-NUM13, NUM15-NUM17, NUM20, NUM21, NUM23, NUM24]"""
    p, k, d, s = F.col("o_totalprice").cast("decimal(18,4)"), (F.col("o_orderkey") % 40).cast("int"), F.to_date("o_orderdate"), F.col("o_orderstatus")
    m = money.parse_money(_cat(p.cast("string"), _lit(" USD")))
    ten = F.struct(F.lit(10).cast("decimal(18,4)").alias("amount"), _lit("USD").alias("currency"))
    n = money.nights(d, F.date_add(d, k))
    move = money.moved(p, p * F.lit(0.75).cast("decimal(3,2)"))
    return t.orders.select(
        "o_orderkey", m["amount"].cast("double").alias("amount"), m["currency"].alias("currency"), money.add(m, ten)["amount"].cast("double").alias("added"), money.times(m, F.lit(2))["amount"].cast("double").alias("doubled"),
        money.is_stale(d, F.lit("1998-01-01").cast("date")).alias("stale"), money.is_sourced(F.when(s == "F", "bank").when(s == "O", "a placeholder")).alias("sourced"), n.alias("nights"),
        money.count_for_length(F.lit(20), F.lit(7), n).alias("dives"), move["delta"].cast("double").alias("delta"), F.when(p > 0, F.round(move["pct"], 6)).alias("pct"), money.amount_key(p, _lit("USD"))["amount"].cast("double").alias("amount_key"),
        money.basis_for(F.when(s == "F", " Night").when(s == "O", "trip").otherwise("month")).alias("basis"), money.in_season(d, F.date_add(d, 30), F.lit("1998-03-01").cast("date"), F.lit("1998-06-30").cast("date")).alias("in_season"),
        money.entry_count(k, F.lit(10)).alias("entry"), money.entry_rank(F.when(s == "F", 2), k).alias("bar"), money.single_price(p.cast("double"), k).alias("single"), money.cut_pct(F.lit(100.0) - k, F.lit(100.0)).alias("cut"),
    )


@query("""
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INTEGER) AS b FROM orders)
SELECT o_orderkey, CAST((year(b) - year(a)) * 12 + month(b) - month(a) + 1 AS INTEGER) AS months,
  CASE WHEN year(a) = year(b) AND month(a) = month(b) THEN strftime(a, '%-d') WHEN year(a) = year(b) THEN strftime(a, '%-d %b') ELSE strftime(a, '%-d %b %Y') END || ' - ' || strftime(b, '%-d %b %Y') AS label FROM o
""")
def money_dates(t: Tables) -> DataFrame:
    """Months of a season and labels of date spans. [NUM18, NUM19]"""
    a = F.to_date("o_orderdate")
    b = F.date_add(a, (F.col("o_orderkey") % 40).cast("int"))
    return t.orders.select("o_orderkey", F.size(money.season_months(a, b)).alias("months"), money.date_span(a, b).alias("label"))


# --- extraction ------------------------------------------------------------------------------------------------------


def _event_pages(t: Tables) -> DataFrame:
    """A page of linked data for each order: an event whose offers are an object or a list, beside a script that is broken."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    offer = _cat(_lit('{"price":"'), price, _lit('","priceCurrency":"USD","availability":"https://schema.org/'), F.when(F.col("o_orderstatus") == "F", "SoldOut").otherwise("InStock"), _lit('"}'))
    offers = F.when(F.col("o_orderstatus") == "P", "").when(F.col("o_orderkey") % 2 == 0, _cat(_lit(',"offers":'), offer)).otherwise(_cat(_lit(',"offers":['), offer, _lit(',{"price":"1"}]')))
    event = _cat(_lit('{"@type":["Event","Trip"],"name":"T '), F.col("o_orderkey").cast("string"), _lit('","startDate":"'), day, _lit('T08:00"'), offers, _lit(',"organizer":[{"name":" Op   '), F.col("o_custkey").cast("string"), _lit(' "}],"location":{"address":{"addressLocality":" ","addressRegion":"'), "o_orderpriority", _lit('"}}}'))
    html = _cat(_lit('<html><script type="application/ld+json">{"@graph":['), event, _lit(']}</script><script type="application/ld+json">{broken</script></html>'))
    return t.orders.select("o_orderkey", html.alias("html"))


@query("""
SELECT o_orderkey, 'T ' || o_orderkey AS name, CAST(o_orderdate AS DATE) AS start, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS price, 'USD' AS currency, CASE WHEN o_orderstatus = 'F' THEN 'sold_out' ELSE 'available' END AS availability,
  'Op ' || o_custkey AS operator, o_orderpriority AS location FROM orders WHERE o_orderstatus <> 'P'
""", dates=("start",))
def extract_departures(t: Tables) -> DataFrame:
    """Events of linked data in pages, with their first offer, organizer and place. [EXT01-EXT08, EXT37, SRC19]"""
    found = extract.departures(extract.nodes(_event_pages(t), "html", ("Event",)).drop("html"))
    return found.select("o_orderkey", "name", "start", F.col("price").cast("double").alias("price"), "currency", "availability", "operator", "location")


@query("SELECT 'type' AS what, value, count(*) AS n FROM orders, (VALUES ('event'), ('trip')) AS v(value) GROUP BY ALL")
def extract_structure(t: Tables) -> DataFrame:
    """What the pages hold. [EXT53]"""
    return extract.structure(_event_pages(t), "html")


@query("""
SELECT o_orderkey, 'S' || o_orderkey AS trip, CAST(o_orderdate AS DATE) AS start, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 + 1 AS INTEGER) AS until, CASE WHEN o_orderstatus <> 'F' THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS price,
  CASE WHEN o_orderstatus <> 'F' AND o_orderkey % 3 = 0 AND o_totalprice > 0 THEN CAST(CAST(o_totalprice * 2 AS DECIMAL(18,2)) AS DOUBLE) END AS was, CAST(o_orderkey % 12 AS INTEGER) AS places FROM orders
""", dates=("start", "until"))
def extract_schedule(t: Tables) -> DataFrame:
    """Schedules in JSON: ends follow from nights, charters are unpriced, old prices count above the price only. [EXT39]"""
    two = lambda c: c.cast("decimal(18,2)").cast("string")
    entry = F.struct(
        _cat(_lit("S"), F.col("o_orderkey").cast("string")).alias("boatTripId"), _lit("Reef").alias("name"), (F.col("o_orderkey") % 9 + 1).cast("int").alias("nights"), F.struct(F.date_format("o_orderdate", "yyyy-MM-dd' 00:00:00'").alias("date")).alias("departureDate"),
        F.struct(two(F.col("o_totalprice")).alias("current"), F.when(F.col("o_orderkey") % 3 == 0, two(F.col("o_totalprice") * 2)).otherwise(two(F.col("o_totalprice") / 2)).alias("oldPrice")).alias("price"),
        (F.col("o_orderkey") % 12).cast("int").alias("availability"), (F.col("o_orderstatus") == "F").alias("charterOnly"),
    )
    bodies = t.orders.select("o_orderkey", F.to_json(F.array(entry)).alias("body"))
    out = extract.schedule(bodies, "body", _lit("EUR"))
    return out.select("o_orderkey", "trip", "start", F.col("end").alias("until"), F.col("price").cast("double").alias("price"), F.col("was").cast("double").alias("was"), "places")


@query("""
WITH e AS (SELECT o_custkey AS boat, CAST(o_orderdate AS DATE) AS start, min(o_totalprice) AS p FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY ALL),
s AS (SELECT o_custkey AS boat, CAST(o_orderdate AS DATE) AS start, min(o_totalprice) AS p FROM orders WHERE o_orderpriority LIKE '2%' GROUP BY ALL)
SELECT boat, start, coalesce(s.p, e.p) AS price, CASE WHEN s.p IS NOT NULL THEN 'EUR' ELSE 'USD' END AS currency, CASE WHEN e.p IS NOT NULL THEN 'u' || boat END AS url FROM s FULL JOIN e USING (boat, start)
""", dates=("start",))
def extract_schedule_and_events(t: Tables) -> DataFrame:
    """Schedule and page events of one boat: the schedule's price wins, events fill the rest. [EXT38, EXT40]"""
    side = lambda p: t.orders.where(F.col("o_orderpriority").startswith(p)).groupBy(F.col("o_custkey").alias("boat"), F.to_date("o_orderdate").alias("start")).agg(F.min("o_totalprice").alias("price"))
    events = side("1").withColumn("currency", _lit("USD")).withColumn("url", _cat(_lit("u"), F.col("boat").cast("string")))
    return extract.schedule_and_events(events, side("2").withColumn("currency", _lit("EUR"))).select("boat", "start", "price", "currency", "url")


@query("""
SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS id, p_name AS title, CAST(p_size AS DOUBLE) AS price, CAST(p_size * 2 AS DOUBLE) AS was, 'EUR' AS currency, DATE '2024-01-01' + p_size AS valid_from FROM part WHERE p_size % 2 = 0 AND p_size > 0 AND p_type <> 'PROMO'
""", dates=("valid_from",))
def extract_offers(t: Tables) -> DataFrame:
    """Offers in promotion JSON; without a price or a currency there is none. [EXT28, EXT34]"""
    body = F.to_json(F.struct(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("on request").alias("price"), (F.col("p_size") * 2).cast("string").alias("old_price"),
        F.when(F.col("p_type") == "PROMO", "euros").otherwise("eur").alias("currency"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")).cast("string").alias("valid_from"),
    ))
    out = extract.offers(t.part.select("p_partkey", body.alias("body")), "body")
    return out.select("p_partkey", "id", "title", F.col("price").cast("double").alias("price"), F.col("was").cast("double").alias("was"), "currency", "valid_from")


@query("""
SELECT p_partkey, p_name AS name, p_type || '+Wall' AS regions, CAST(p_size AS INTEGER) AS dives, CASE WHEN p_size <= 30 THEN p_size * 2 END AS guests, p_brand AS experience, 'First ' || p_name || ' & more.' AS intro, 'Day 1=' || p_type AS sections,
  'First ' || p_name || ' & more.|' || p_type AS paragraphs, CAST(p_size AS VARCHAR) AS length, p_brand AS brand
FROM part
""")
def extract_trip(t: Tables) -> DataFrame:
    """Itinerary fragments: fields, regions, prose and specification tables. [EXT19-EXT25, EXT35, EXT36, EXT52]"""
    size = F.col("p_size").cast("string")
    html = _cat(
        _lit("<h2 class=x>"), "p_name", _lit("</h2><h3>Key regions</h3><ol><li title='"), "p_type", _lit("'>a</li><li title=\"Red Sea\">b</li><li title=Wall>c</li></ol><dl><dt>Dives</dt><dd>Up to "), size, _lit(" dives</dd><dt>Group Size</dt><dd>"), (F.col("p_size") * 2).cast("string"),
        _lit(" guests</dd><dt>Experience</dt><dd>"), "p_brand", _lit("</dd></dl><h3>What to expect</h3><div class=prose><p>First "), "p_name", _lit(" &amp; more.</p><strong>Day 1</strong><p>"), "p_type", _lit("</p></div>"),
    )
    trip = extract.trip(html)
    spec = extract.spec_table(_cat(_lit("<table><tr><th>Length:</th><td>"), size, _lit("</td></tr><tr><td><b>Year</b></td><td>2001</td></tr></table>")))
    brand = extract.organizer(F.to_json(F.struct(F.struct(F.col("p_brand").alias("name")).alias("brand"))))
    return spread(t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size")).select(
        "p_partkey", trip["name"].alias("name"), F.array_join(trip["regions"], "+").alias("regions"), trip["dives"].alias("dives"), trip["guests"].alias("guests"), trip["experience"].alias("experience"), trip["intro"].alias("intro"),
        F.array_join(F.transform(trip["sections"], lambda s: _cat(s["heading"], _lit("="), s["body"])), "+").alias("sections"), F.array_join(extract.paragraphs(html), "|").alias("paragraphs_"), spec["Length"].alias("length"), brand.alias("brand"),
    ).withColumn("paragraphs", F.regexp_replace("paragraphs_", r"^(a\|b\|c\|)", "")).drop("paragraphs_")


@query("""
SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS cabin_id, p_name || ' & more' AS name, 2 AS sleeps, p_brand AS beds, CAST(1000 + p_size AS DOUBLE) AS price, CASE WHEN p_size % 3 = 0 THEN CAST(1500 AS DOUBLE) END AS list_price,
  CASE WHEN p_type = 'ECONOMY' THEN 0 ELSE p_size END AS berths, p_type = 'ECONOMY' AS sold_out, CASE WHEN p_size % 2 = 0 THEN 60 ELSE 80 END AS supplement, CASE WHEN p_size % 4 = 0 THEN 'GBP' END AS shown FROM part
""")
def extract_cabins(t: Tables) -> DataFrame:
    """Rooms of booking pages: prices, places, beds, surcharges by id, and marks of another currency. [EXT11-EXT13, EXT49]"""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    mark = F.when(F.col("p_size") % 4 == 0, "&pound;").when(F.col("p_size") % 4 == 1, "$").otherwise("&#x20AC;")
    choice = F.when(F.col("p_type") == "ECONOMY", "<b>FULL</b>").otherwise(_cat(_lit("<select name=input-cabin-guests-"), key, _lit(" data-allocation="), size, _lit("><option>1</select>")))
    html = _cat(
        _lit("<button aria-controls=help-content-cabin-details-"), key, _lit(' title="'), "p_name", _lit(' &amp; more">x</button><ol><li><span>2 People</span><li><span title=Beds>'), "p_brand", _lit("</span></ol>"), choice,
        F.when(F.col("p_size") % 3 == 0, "<del>€1,500</del>").otherwise(""), _lit("<em>"), mark, _lit("</em> <span translate=no>1,0"), F.lpad(size, 2, "0"), _lit("</span><button aria-controls=help-content-cabin-details-"), key, _lit(" aria-label='Close dialog'></button><div id="),
        F.when(F.col("p_size") % 2 == 0, "private-cabin-help-text-").otherwise("privacy-optional-help-text-"), key, _lit(">a <b>"), F.when(F.col("p_size") % 2 == 0, "60").otherwise("80"), _lit("%</b> surcharge applies</div>"),
    )
    out = extract.cabins(spread(t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size")).select("p_partkey", html.alias("html")), "html", _lit("EUR"))
    return out.select("p_partkey", "cabin_id", "name", "sleeps", "beds", "price", "list_price", "berths", "sold_out", "supplement", "shown")


@query(r"SELECT p_partkey, p_name || chr(10) || '5:T2,é' AS plan, p_size AS size, 1 AS undecoded FROM part")
def extract_streamed(t: Tables) -> DataFrame:
    """Objects of streamed chunks, with text rows by byte length in place of their labels. [EXT41-EXT45]"""
    plan = _cat("p_name", _lit("\n5:T2,é"))
    row = _cat(_lit("0:[]\n3f:T"), F.lower(F.hex(F.octet_length(plan))), _lit(","), plan, _lit('7:{"a":{"details":{"text":"$3f","size":'), F.col("p_size").cast("string"), _lit("}}}"))
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    html = _cat(_lit("push([1,"), quoted(F.substring(row, 1, 9)), _lit("])push([1,"), quoted(F.substr(row, F.lit(10))), _lit('])push([1,"\\x"])'))
    found = t.part.select("p_partkey", html.alias("html")).lateralJoin(extract.StreamedObjects(F.col("html").outer(), _lit("details")))
    return found.select("p_partkey", F.get_json_object("node", "$.details.text").alias("plan"), F.get_json_object("node", "$.details.size").cast("int").alias("size"), "undecoded")


@query("""
SELECT p_partkey, 'required' AS block, 'Park fees' AS label, CAST(p_size AS DOUBLE) AS amount, CAST(100 AS DOUBLE) AS amount_max, 'USD' AS currency, 'per_day' AS basis, false AS unit_unstated FROM part
UNION ALL SELECT p_partkey, 'required', p_type, CAST(1000 + p_size AS DOUBLE), NULL, 'EUR', NULL, true FROM part UNION ALL SELECT p_partkey, 'included', 'Nitrox', NULL, NULL, 'EUR', NULL, false FROM part
UNION ALL SELECT p_partkey, 'optional', 'Wine', NULL, NULL, 'EUR', NULL, false FROM part
""")
def extract_fees(t: Tables) -> DataFrame:
    """Fee lines of disclosures: blocks, ranges, currencies, units; an inclusion replaces an optional line without a price. [EXT14, EXT15, EXT46, EXT47]"""
    size = F.col("p_size").cast("string")
    body = _cat(_lit("Required Extras: Park fees $"), size, _lit("-100 per day,\n"), "p_type", _lit(" €1,0"), F.lpad(size, 2, "0"), _lit(".\nOptional Extras: Wine, Nitrox.\nIncluded: Nitrox."))
    found = t.part.select("p_partkey", body.alias("body")).lateralJoin(extract.ParseFees(F.col("body").outer(), _lit("EUR")))
    return found.select("p_partkey", "block", "label", "amount", "amount_max", "currency", "basis", "unit_unstated")


@query("SELECT p_partkey, 'included' AS block, p_name || ', meals' AS excerpt FROM part UNION ALL SELECT p_partkey, 'optional', 'Wine ' || p_brand FROM part")
def extract_fee_excerpts(t: Tables) -> DataFrame:
    """The stored beginning of each block of a disclosure. [EXT16]"""
    body = _cat(_lit("Included: "), "p_name", _lit(",  meals Optional Extras: Wine "), "p_brand")
    return t.part.select("p_partkey", F.explode(extract.fee_excerpts(body)).alias("block", "excerpt")).withColumn("excerpt", F.regexp_replace("excerpt", r"[\s,]+$", ""))


@query("""
SELECT p_partkey, 'gear_rental' AS code, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS amount, CASE WHEN p_size % 2 = 0 THEN 'EUR' END AS currency, CASE WHEN p_size % 2 = 0 AND p_size % 3 > 0 THEN 'per_trip' ELSE 'per_week' END AS basis, p_size % 2 = 0 AND p_size % 3 > 0 AS unit_unstated FROM part
""")
def extract_gear(t: Tables) -> DataFrame:
    """The one fee line of a gear dialog: a set with its unit, a set without one, or items alone. [EXT17, EXT18]"""
    size = F.col("p_size").cast("string")
    item = lambda label, value: _cat(_lit(f"<li><strong>{label}</strong><span>"), value, _lit("</span></li>"))
    full = _cat(_lit("Full equipment rent"), item("Set", _cat(_lit("€"), size, F.when(F.col("p_size") % 3 == 0, " / week").otherwise(""))))
    html = _cat(_lit("<h3>Rental Gear Prices</h3>"), item("Mask", _lit("€5 / week")), F.when(F.col("p_size") % 2 == 0, full).otherwise(""))
    found = extract.gear_line(extract.gear_items(t.part.select("p_partkey", html.alias("html")), "p_partkey", "html", _lit("EUR")), "p_partkey")
    return found.select("p_partkey", "code", "amount", "currency", "basis", "unit_unstated")


# --- bills -----------------------------------------------------------------------------------------------------------

_BILL = """
WITH l AS (
  SELECT l_orderkey * 10 + l_linenumber AS bill_id, l_partkey, l_suppkey, l_returnflag AS f, CAST(l_tax * 100 AS INTEGER) AS cents, CAST(l_quantity AS INTEGER) AS q FROM lineitem),
b AS (SELECT bill_id, min((l_partkey, l_suppkey, f, cents, q)) AS x FROM l GROUP BY bill_id),
one AS (SELECT bill_id, x[4] AS cents, x[5] AS q, x[3] AS f FROM b)"""


def _bill_rows(t: Tables) -> DataFrame:
    """Four lines a bill: a range per night in dollars, gear without a price, a bundle whose note names two codes, one of these codes alone."""
    cents, q = (F.col("l_tax") * 100).cast("decimal(18,0)").cast("int"), F.col("l_quantity").cast("int")
    first = t.lineitem.groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("bill_id")).agg(F.min(F.struct("l_partkey", "l_suppkey", F.col("l_returnflag").alias("f"), cents.alias("cents"), q.alias("q"))).alias("x"))
    one = first.select("bill_id", "x.cents", "x.q", "x.f")
    amount = F.col("cents").cast("decimal(18,4)")
    none = F.lit(None)

    def line(position, code, tier, low, high, currency, basis, included=False, unstated=False, note=None):
        fields = {"code": _lit(code), "tier": _lit(tier), "amount": low.cast("decimal(18,4)"), "amount_max": high.cast("decimal(18,4)"), "currency": _lit(currency), "basis": _lit(basis), "included": F.lit(included), "unit_unstated": F.lit(unstated) if isinstance(unstated, bool) else unstated, "note": F.lit(note).cast("string"), "level": F.lit(0), "position": F.lit(position)}
        return F.struct(*[c.alias(n) for n, c in fields.items()])

    lines = F.array(
        line(0, "park", "mandatory", amount, amount + F.col("q"), "USD", "per_night"), line(1, "gear", "optional", none, none, "EUR", "per_trip"), line(2, "combined", "mandatory", F.lit(30), none, "EUR", "per_trip", note="covers port and visa"),
        line(3, "port", "mandatory", F.lit(5), none, "EUR", "per_trip"), line(4, "fuel", "conditional", F.lit(7), none, "EUR", "per_dive", unstated=F.col("f") == "R"), line(5, "wine", "optional", none, none, "EUR", "per_trip", included=True),
    )
    return one.select("bill_id", (F.col("q") % 7 + 1).alias("nights"), (F.col("q") % 3).alias("dives"), F.explode(lines).alias("x")).select("bill_id", "nights", "dives", "x.*")


def _usd(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([("USD", "0.500000")], "currency string, rate string").withColumn("rate", F.col("rate").cast(money.RATE))


@query(_BILL + """
SELECT bill_id, code, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, counted, bundle AS subsumed_by, estimated FROM (
  SELECT bill_id, 'park' AS code, cents * (q % 7 + 1) * 0.5 AS low, (cents + q) * (q % 7 + 1) * 0.5 AS high, true AS counted, CAST(NULL AS VARCHAR) AS bundle, false AS estimated FROM one
  UNION ALL SELECT bill_id, 'gear', 180, 180, true, NULL, true FROM one UNION ALL SELECT bill_id, 'combined', 30, 30, true, NULL, false FROM one UNION ALL SELECT bill_id, 'port', 5, 5, false, 'combined', false FROM one
  UNION ALL SELECT bill_id, 'fuel', CASE WHEN f <> 'R' AND q % 3 > 0 THEN 7 * (q % 3) END, CASE WHEN f <> 'R' AND q % 3 > 0 THEN 7 * (q % 3) END, false, NULL, false FROM one
  UNION ALL SELECT bill_id, 'wine', NULL, NULL, false, NULL, false FROM one)
""")
def bill_details(t: Tables) -> DataFrame:
    """Every line of a bill: ranges, a second currency, charges per dive, gear taken at an estimate, a bundle that subsumes a charge. [BIL03, BIL06-BIL10, BIL14, FLT05]"""
    lines = bills.bill_lines(_bill_rows(t), _usd(t), {"gear": True}, words={r"\bport\b": "port", r"\bvisa\b": "visa"})
    return bills.sorted_lines(lines).select("bill_id", "code", F.col("display").cast("double").alias("low"), F.col("display_max").cast("double").alias("high"), "counted", "subsumed_by", "estimated")


@query(_BILL + """
, s AS (SELECT bill_id, cents * (q % 7 + 1) * 0.5 AS park, (cents + q) * (q % 7 + 1) * 0.5 AS park_max FROM one)
SELECT bill_id, CAST(1000 + park + 210 AS DOUBLE) AS total, CAST(1000 + park_max + 210 AS DOUBLE) AS total_max, CAST(1000 + park + 30 AS DOUBLE) AS required, CAST(park + 210 AS DOUBLE) AS surcharge, CAST((park + 210) / 10 AS DOUBLE) AS markup_pct, '' AS unpriced, true AS mandatory_known, true AS estimated, 'full' AS disclosure FROM s
""")
def bill_flags(t: Tables) -> DataFrame:
    """Totals of such bills with their flags and how fully they are disclosed. [AGG06, BIL04, BIL15, FLT06, SRT03]"""
    lines = bills.bill_lines(_bill_rows(t), _usd(t), {"gear": True}, words={r"\bport\b": "port", r"\bvisa\b": "visa"})
    base = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("bill_id")).distinct().withColumn("base", F.lit(1000).cast("decimal(18,4)"))
    out = bills.totals(base, lines)
    money_columns = {c: F.col(c).cast("double") for c in ("total", "total_max", "required", "surcharge")}
    return out.withColumns(money_columns).withColumn("disclosure", bills.disclosure(F.col("mandatory_known"), F.col("unpriced"))).withColumn("unpriced", F.array_join("unpriced", "+")).withColumn("markup_pct", F.round("markup_pct", 6)).drop("base")


@query("""
WITH s AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'A'), o AS (SELECT DISTINCT l_orderkey FROM lineitem),
u AS (SELECT l_orderkey AS bill_id, 'nitrox' AS code, false AS included FROM s UNION ALL SELECT o_orderkey, 'nitrox', true FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM s) UNION ALL SELECT l_orderkey, 'park', false FROM o)
SELECT bill_id, code, included FROM u
""")
def bill_inferred(t: Tables) -> DataFrame:
    """A charge that a vessel's specification includes, where no line prices it. [BIL18]"""
    priced = t.lineitem.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("bill_id")).distinct().withColumn("code", _lit("nitrox"))
    park = t.lineitem.select(F.col("l_orderkey").alias("bill_id")).distinct().withColumn("code", _lit("park"))
    lines = priced.unionByName(park).select("bill_id", "code", _lit("optional").alias("tier"), F.lit(5).cast("decimal(18,4)").alias("amount"), F.lit(False).alias("included"), F.lit(0).alias("level"), F.lit(1).alias("position"))
    vessels = t.orders.select(F.col("o_orderkey").alias("bill_id"), (F.col("o_orderstatus") == "F").alias("includes"))
    return bills.inferred_inclusion(lines, vessels, "nitrox").select("bill_id", "code", "included")


@query("""
SELECT p_partkey, 'park' AS code, CAST(p_size AS DOUBLE) AS amount, CASE WHEN p_size <> 20 THEN CAST(20 AS DOUBLE) END AS amount_max, CASE WHEN p_size % 3 = 0 THEN 'b' WHEN p_size > 20 THEN 'a' ELSE 'b' END AS level, CASE WHEN p_size % 3 = 0 THEN 30 ELSE greatest(p_size, 30) END AS dives, CASE WHEN p_size % 3 <> 0 THEN 'a / b' END AS note FROM part
""")
def bill_bars(t: Tables) -> DataFrame:
    """Fee records, and the stricter of two entry bars with both claims. [BIL19-BIL22]"""
    n = F.col("p_size")
    fee = bills.fee_record(_lit("park"), n.cast("decimal(18,4)"), F.lit(20).cast("decimal(18,4)"), _lit("EUR"), _lit("per_trip"))
    a = F.when(n % 3 != 0, F.struct(n.alias("rank"), n.alias("dives"), _lit("a").alias("level")))
    bar = bills.strictest(a, F.struct(F.lit(20).alias("rank"), F.lit(30).alias("dives"), _lit("b").alias("level")))
    return t.part.select("p_partkey", fee["code"].alias("code"), fee["amount"].cast("double").alias("amount"), fee["amount_max"].cast("double").alias("amount_max"), bar["level"].alias("level"), bar["dives"].alias("dives"), bar["note"].alias("note"))


# --- facets, changes, state -------------------------------------------------------------------------------------------


@query("""
SELECT o_orderkey, (o_totalprice BETWEEN 1000 AND 200000) AS passes, o_orderstatus <> 'F' AS bookable, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01') BETWEEN 0 AND 14 AS fresh,
  o_orderstatus = 'O' AND month(o_orderdate) IN (3, 4) AS worth, array_to_string(list_filter(['a', CASE WHEN o_orderstatus = 'F' THEN 'b' END], lambda x: x IS NOT NULL), '+') AS sellers,
  array_to_string(list_sort(list_distinct([substr(o_orderpriority, 1, 1), CASE WHEN o_orderstatus = 'F' THEN '0' ELSE '1' END])), '+') AS provenance FROM orders
""")
def facet_predicates(t: Tables) -> DataFrame:
    """Plausible rows and rejects, bookable, fresh, worth a reading, and the sellers of a row. [FLT02, FLT04, FLT07-FLT09, FLT11, FLT12, CHG13]"""
    good, bad = facets.plausible(t.orders, F.col("o_totalprice").between(1000, 200000))
    rows = good.withColumn("passes", F.lit(True)).unionByName(bad.withColumn("passes", F.lit(False)))
    key = ["o_orderkey"]
    fresh = facets.fresh(t.orders, F.to_date("o_orderdate"), F.lit("1998-01-01").cast("date")).select(*key, F.lit(True).alias("fresh"))
    worth = facets.worth_reading(t.orders.withColumn("id", F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey"))), "id", F.date_format("o_orderdate", "MM"), ("03", "04")).select(*key, F.lit(True).alias("worth"))
    joined = rows.join(fresh, key, "left").join(worth, key, "left")
    flags = facets.sellers_of_row((("a", F.lit(True)), ("b", F.col("o_orderstatus") == "F"), ("c", F.lit(None).cast("boolean"))))
    provenance = changes.sellers_of(F.substring("o_orderpriority", 1, 1), F.when(F.col("o_orderstatus") == "F", "0").otherwise("1"), F.lit(None).cast("string"))
    return joined.select(
        "o_orderkey", "passes", facets.bookable(F.when(F.col("o_orderstatus") == "F", "sold_out").when(F.col("o_orderstatus") == "O", "available")).alias("bookable"), F.coalesce("fresh", F.lit(False)).alias("fresh"), F.coalesce("worth", F.lit(False)).alias("worth"),
        F.array_join(flags, "+").alias("sellers"), F.array_join(provenance, "+").alias("provenance"),
    )


@query("""
WITH c AS (SELECT o_custkey AS key, max(CAST(o_orderdate AS DATE)) AS checked FROM orders GROUP BY ALL)
SELECT key FROM c WHERE checked = (SELECT max(checked) FROM c) AND key NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
""")
def facet_read_empty(t: Tables) -> DataFrame:
    """Keys checked on the last day and not held back. [FLT10]"""
    checked = t.orders.groupBy(F.col("o_custkey").alias("key")).agg(F.max(F.to_date("o_orderdate")).alias("checked"))
    last = checked.agg(F.max("checked").alias("day"))
    held = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("key"))
    return facets.read_empty(checked.join(F.broadcast(last)), held, "key", F.col("day"))  # one row


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part", longs=("p_size",))
def sort_registered(t: Tables) -> DataFrame:
    """Rows by a registered sort, unknown last, ties by id. [SRT01, SRT02, SRT08, SRT09]"""
    rows = t.part.select("p_partkey", "p_name", F.col("p_size").cast("long").alias("p_size"), "p_retailprice").withColumn("price", F.nullif(F.col("p_retailprice"), F.lit(900.0)))
    column, sentinel, _ = facets.SORTS["price"]
    return facets.sorted_by(rows, column, False, "p_partkey", sentinel).drop("price")


@query("""
WITH f AS (SELECT p_type AS value, count(*) AS n FROM part GROUP BY ALL)
SELECT value, n, CAST(row_number() OVER (ORDER BY value <> 'ECONOMY', n DESC, value) AS INTEGER) AS place FROM f
""")
def sort_chips(t: Tables) -> DataFrame:
    """Facet values: picked first, then by count, then by value. [SRT10, AGG31]"""
    from pyspark.sql import Window

    counts = aggregates.tally(t.part, F.col("p_type"))
    order = (F.when(F.col("value") == "ECONOMY", 0).otherwise(1), F.desc("n"), F.col("value"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))  # a handful of values


def _two_days(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Readings of customers before and after: orders of high and of low priority."""
    one = lambda test: t.orders.where(test).groupBy(F.col("o_custkey").alias("boat")).agg(F.max("o_totalprice").alias("price"), F.min("o_orderstatus").alias("status"))
    return one("o_orderpriority < '3'"), one("o_orderpriority >= '3'")


_TWO = """
WITH b AS (SELECT o_custkey AS boat, max(o_totalprice) AS price, min(o_orderstatus) AS status FROM orders WHERE o_orderpriority < '3' GROUP BY ALL),
a AS (SELECT o_custkey AS boat, max(o_totalprice) AS price, min(o_orderstatus) AS status FROM orders WHERE o_orderpriority >= '3' GROUP BY ALL)"""


@query(_TWO + """
SELECT boat, CASE WHEN b.boat IS NULL THEN 'new' WHEN a.boat IS NULL THEN 'withdrawn' ELSE 'both' END AS kind,
  CASE WHEN a.boat IS NULL OR b.boat IS NULL THEN '' ELSE CASE WHEN a.price <> b.price THEN 'price' ELSE '' END || CASE WHEN a.price <> b.price AND a.status <> b.status THEN '+' ELSE '' END || CASE WHEN a.status <> b.status THEN 'status' ELSE '' END END AS changed
FROM b FULL JOIN a USING (boat)
""")
def change_fields(t: Tables) -> DataFrame:
    """Keys on one side only, and the fields that differ on both. [SET03, SET04]"""
    before, after = _two_days(t)
    alone = changes.new_and_withdrawn(before, after, ["boat"], False).withColumn("changed", _lit(""))
    both = before.select("boat", F.struct("price", "status").alias("b")).join(after.select("boat", F.struct("price", "status").alias("a")), "boat")
    fields = changes.changed_fields((("price", F.col("b.price"), F.col("a.price")), ("status", F.col("b.status"), F.col("a.status"))), ("price",))
    return alone.select("boat", "kind", "changed").unionByName(both.select("boat", _lit("both").alias("kind"), F.array_join(fields, "+").alias("changed")))


@query(_TWO + """
, m AS (SELECT boat AS id, CASE WHEN a.price > b.price THEN 'rose' WHEN a.price < b.price THEN 'fell' END AS kind, a.price - b.price AS delta FROM b JOIN a USING (boat))
SELECT kind, count(*) AS n, arg_max(id, (abs(delta), id)) AS biggest FROM m WHERE kind IS NOT NULL GROUP BY kind
""")
def change_headline(t: Tables) -> DataFrame:
    """The first kinds of change by priority, each with its biggest move. [SRT06, SRT07]"""
    before, after = _two_days(t)
    both = before.select("boat", F.col("price").alias("was")).join(after.select("boat", F.col("price").alias("now")), "boat").withColumn("delta", F.col("now") - F.col("was"))
    moves = both.select(F.col("boat").alias("id"), F.when(F.col("delta") > 0, "rose").when(F.col("delta") < 0, "fell").alias("kind"), "delta").where("kind IS NOT NULL")
    return changes.headline(moves, ("rose", "fell", "relisted"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'A' THEN 'included' WHEN l_returnflag = 'N' THEN 'unpriced' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || CASE WHEN l_quantity <> 20 THEN '-20' ELSE '' END || ' EUR ' || CASE WHEN l_linestatus = 'O' THEN 'per_trip' ELSE 'unit unstated' END END AS summary FROM lineitem
""")
def change_fee_summaries(t: Tables) -> DataFrame:
    """Fees as text that compares. [CHG10, SET07]"""
    q = F.col("l_quantity").cast("decimal(18,4)")
    s = changes.fee_summary(F.when(F.col("l_returnflag") != "N", q), F.lit(20).cast("decimal(18,4)"), _lit("EUR"), F.when(F.col("l_linestatus") == "O", "per_trip"), F.col("l_returnflag") == "A")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", s.alias("summary"))


@query("""
WITH w AS (SELECT c_mktsegment AS currency, round(avg(c_acctbal), 4) AS was FROM customer GROUP BY ALL),
n AS (SELECT c_mktsegment AS currency, round(avg(CASE WHEN c_mktsegment < 'F' THEN c_acctbal ELSE c_acctbal + 1 END), 4) AS now FROM customer GROUP BY ALL)
SELECT 'rate' AS rule, currency AS value FROM w JOIN n USING (currency) WHERE abs(now - was) > 0.5 AND currency <> 'MACHINERY'
UNION ALL SELECT 'newly read', CAST(true AS VARCHAR) UNION ALL SELECT 'quiet', 'false' UNION ALL SELECT 'only renumbered', 'true'
""")
def change_rules(t: Tables) -> DataFrame:
    """Rates that moved of currencies in use, a field read for the first time, and whether a day was quiet. [CHG06, CHG11, CHG12]"""
    was = t.customer.groupBy(F.col("c_mktsegment").alias("currency")).agg(F.round(F.avg("c_acctbal"), 4).alias("rate"))
    now = t.customer.groupBy(F.col("c_mktsegment").alias("currency")).agg(F.round(F.avg(F.when(F.col("c_mktsegment") < "F", F.col("c_acctbal")).otherwise(F.col("c_acctbal") + 1)), 4).alias("rate"))
    used = t.customer.select(F.col("c_mktsegment").alias("currency")).where("currency <> 'MACHINERY'")
    rates = changes.rate_moves(was, now, used, 0.5).select(_lit("rate").alias("rule"), F.col("currency").alias("value"))
    new = changes.newly_read(t.orders.select(F.lit(None).cast("string").alias("bar")), t.orders.select(F.col("o_orderstatus").alias("bar")), "bar").select(_lit("newly read").alias("rule"), F.col("newly_read").cast("string").alias("value"))
    quiet = changes.is_quiet(t.orders.select(F.when(F.col("o_orderstatus") == "F", "renumbered").alias("kind")))
    told = quiet.select(F.explode(F.create_map(_lit("quiet"), F.col("quiet").cast("string"), _lit("only renumbered"), F.col("only_renumbered").cast("string"))).alias("rule", "value"))
    return rates.unionByName(new).unionByName(told)


@query("""
WITH p AS (SELECT o_custkey AS key, o_orderkey AS id, CAST(o_orderdate AS DATE) AS read_day FROM orders), last AS (SELECT max(read_day) AS d FROM p),
new AS (SELECT * FROM p WHERE read_day = (SELECT d FROM last)), unread AS (SELECT c_custkey AS key FROM customer WHERE c_acctbal > 0)
SELECT key, id, read_day FROM new UNION ALL SELECT key, id, read_day FROM p WHERE key IN (SELECT key FROM unread) AND key NOT IN (SELECT key FROM new) AND read_day >= (SELECT d FROM last) - 14
""", dates=("read_day",))
def state_carry_unread(t: Tables) -> DataFrame:
    """Unread keys keep their previous rows, not older than two weeks, with their own read date. [INC01, INC10]"""
    rows = t.orders.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("read_day"))
    last = F.broadcast(rows.agg(F.max("read_day").alias("_last")))  # one row
    dated = rows.join(last)
    new = dated.where("read_day = _last").drop("_last")
    return state.carry_unread(dated, new.join(last), t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("key")), "key", F.col("_last")).drop("_last")


@query("""
SELECT c_custkey AS key, c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%') AS skippable FROM customer
UNION SELECT o_custkey, o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%') AND o_custkey IN (SELECT c_custkey FROM customer) FROM orders
""")
def state_known(t: Tables) -> DataFrame:
    """Known keys of several tables, and those that may be skipped. [INC04-INC06, SET01]"""
    keys = lambda df, c: df.select(F.col(c).alias("key"))
    every = state.known(keys(t.customer, "c_custkey"), keys(t.orders, "o_custkey"))
    skip = state.skippable(keys(t.customer, "c_custkey"), keys(t.orders.where("o_orderstatus = 'P'"), "o_custkey"), keys(t.orders.where("o_orderpriority LIKE '1%'"), "o_custkey"))
    return every.join(skip.withColumn("skippable", F.lit(True)), "key", "left").withColumn("skippable", F.coalesce("skippable", F.lit(False)))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(json_extract_string(props, '$.k') AS INTEGER) <> 69 AS changed FROM events")
def state_replay(t: Tables) -> DataFrame:
    """Facts derived again from stored raw text by a newer parser. [INC08]"""
    bronze = t.events.select("event_id", "props", F.lit(69).alias("k"))
    return state.replay(bronze, F.get_json_object("props", "$.k").cast("int"), "k").select("event_id", "k", "changed")


# --- sales and sellers ------------------------------------------------------------------------------------------------


@query("""
WITH r AS (SELECT o_custkey AS sailing, substr(o_orderpriority, 1, 1) AS seller, min(o_totalprice) AS price FROM orders WHERE o_totalprice > 1 GROUP BY ALL),
p AS (SELECT sailing, seller, price, CASE WHEN seller <> '2' THEN price * 1.25 END AS was FROM r)
SELECT sailing, array_to_string(list_sort(list(seller)), '+') AS sellers, max(CASE WHEN seller = '1' THEN 20 END) AS pct, max(CASE WHEN seller = '1' THEN round(was, 4) END) AS was FROM p WHERE was IS NOT NULL GROUP BY sailing
""")
def sale_rows(t: Tables) -> DataFrame:
    """Sellers with a list price; percent and earlier price only of the seller whose fare is shown. [SAL02]"""
    r = t.orders.where("o_totalprice > 1").groupBy(F.col("o_custkey").alias("sailing"), F.substring("o_orderpriority", 1, 1).alias("seller")).agg(F.min("o_totalprice").alias("price"))
    prices = sales.list_prices(r.withColumn("was", F.when(F.col("seller") != "2", F.col("price") * 1.25)))
    out = sales.sale(prices, r.select("sailing").distinct().withColumn("seller", _lit("1")))
    return out.select("sailing", F.array_join("sellers", "+").alias("sellers"), "pct", F.round("was", 4).alias("was"))


@query("""
WITH o AS (SELECT p_partkey AS slug, CAST(p_size AS DECIMAL(18,4)) AS price, CAST(25 AS DECIMAL(18,4)) AS was FROM part)
SELECT slug, CASE WHEN slug % 2 = 0 THEN slug END AS target, CAST(round_even(price / 2, 0) AS BIGINT) AS price_display, CAST(12 AS BIGINT) AS was_display, CASE WHEN 12 > round_even(price / 2, 0) THEN CAST(12 - round_even(price / 2, 0) AS BIGINT) END AS saving
FROM o WHERE price < was AND slug IN (SELECT s_suppkey FROM supplier)
""")
def sale_offers(t: Tables) -> DataFrame:
    """Specials below their earlier price, matched to suppliers, in whole display units. [SAL07, SAL08, SAL13, EXT50]"""
    offers = t.part.select(F.col("p_partkey").alias("slug"), F.col("p_size").cast("decimal(18,4)").alias("price"), F.lit(25).cast("decimal(18,4)").alias("was"), _lit("USD").alias("currency"))
    matched, _ = sales.specials(offers, t.supplier.select(F.col("s_suppkey").alias("slug"), F.col("s_suppkey").alias("target")))
    out = sales.offers_displayed(matched, _usd(t))
    return out.select("slug", F.when(F.col("slug") % 2 == 0, F.col("target")).alias("target"), "price_display", "was_display", F.col("saving").cast("long").alias("saving"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'a' WHEN p_size % 3 = 0 THEN 'b' END AS seller, CASE WHEN p_size % 2 = 0 THEN p_size WHEN p_size % 3 = 0 THEN 7 END AS spots, CASE WHEN p_size % 2 = 0 THEN p_size WHEN p_size % 3 = 0 THEN 7 END AS stated,
  CASE WHEN p_size % 4 = 0 THEN 20 ELSE 10 END AS cheapest, p_size % 4 = 0 AS sold_through FROM part
""", longs=("cheapest",))
def sale_ladders(t: Tables) -> DataFrame:
    """Spots of the first seller that states them, cheapest rung on sale, and whether the cheapest rooms sold through. [AGG09, SAL10-SAL12, WIN10]"""
    n = F.col("p_size")
    first = sales.first_stating((("a", F.when(n % 2 == 0, n)), ("b", F.when(n % 3 == 0, F.lit(7)))))
    rung = lambda name, price, places: F.struct(_lit(name).alias("name"), F.lit(price).alias("price"), places.cast("int").alias("places"))
    was = F.array(rung("lower", 10, F.lit(4)), rung("upper", 20, F.lit(4)))
    now = F.array(rung("lower", 10, F.when(n % 4 == 0, 0).otherwise(2)), rung("upper", 20, F.lit(4)))
    return t.part.select("p_partkey", first["seller"].alias("seller"), first["value"].alias("spots"), aggregates.first_stated((F.when(n % 2 == 0, n), F.when(n % 3 == 0, F.lit(7)))).alias("stated"), sales.cheapest_on_sale(now).cast("long").alias("cheapest"), windows.sold_through(was, now).alias("sold_through"))


# --- readers, sinks and streams over tables -----------------------------------------------------------------------------


@query("""
WITH k AS (SELECT DISTINCT key FROM (SELECT c_custkey AS key FROM customer UNION ALL SELECT o_custkey FROM orders)), m AS (SELECT DATE '2024-01-01' AS month UNION ALL SELECT DATE '2024-02-01')
SELECT key, month FROM k, m WHERE key NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) ORDER BY key, month LIMIT 500
""", dates=("month",))
def source_to_visit(t: Tables) -> DataFrame:
    """Pages of a run: listed and known keys less the skip list, a row per month, capped by name as a run is. [SRC07-SRC09]"""
    keys = lambda df, c: df.select(F.col(c).alias("key"))
    months = money.season_months(F.lit("2024-01-15").cast("date"), F.lit("2024-02-10").cast("date"))
    return readers.to_visit(keys(t.customer, "c_custkey"), keys(t.orders, "o_custkey"), months, keys(t.customer.where("c_acctbal < 0"), "c_custkey"), 500)


@query("""
SELECT o_custkey AS run, CAST(max(year(o_orderdate)) AS INTEGER) AS pages, count(DISTINCT o_orderkey) AS records, count(DISTINCT o_orderkey) < 12 AS truncated FROM orders GROUP BY o_custkey
""")
def source_pages_read(t: Tables) -> DataFrame:
    """Paged readings: pages, distinct records, and whether the reading was cut short. [SRC11]"""
    pages = t.orders.select(F.col("o_custkey").alias("run"), F.year("o_orderdate").alias("page"), F.col("o_orderkey").alias("id"), F.lit(12).alias("total"))
    return readers.pages_read(pages, "run", ["id"])[1].select("run", "pages", "records", "truncated")


@query("""
SELECT DATE '2024-01-01' + CAST(n_nationkey AS INTEGER) AS as_of, unnest(['USD', 'GBP']) AS currency, unnest([0.5, CAST(round(CAST(1 AS DECIMAL(38,18)) / (n_nationkey + 1), 6) AS DOUBLE)]) AS rate FROM nation
""", dates=("as_of",))
def source_rates(t: Tables) -> DataFrame:
    """Reference-rate sheets in XML, inverted to six places. [SRC13]"""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("n_nationkey").cast("int")).cast("string")
    xml = _cat(_lit("<Cube time='"), day, _lit("'><Cube currency='USD' rate='2.0'/><Cube currency='GBP' rate='"), (F.col("n_nationkey") + 1).cast("string"), _lit("'/></Cube>"))
    return readers.rates_from_xml(t.nation.select(xml.alias("xml")), "xml").withColumn("rate", F.col("rate").cast("double"))


@query("""SELECT '{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '"' || CASE WHEN p_size % 2 = 0 THEN ',"size":' || p_size ELSE '' END || '}' AS json FROM part""")
def sink_payload(t: Tables) -> DataFrame:
    """Rows as JSON objects, nulls left out. [SNK02, SNK04]"""
    return readers.payload(t.part.select("p_partkey", "p_name", F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("size")))


@query("""
WITH s AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM s)
SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM r GROUP BY user_id, run
""")
def stream_sessions(t: Tables) -> DataFrame:
    """Sessions of users: events closer than half an hour."""
    return streams.sessions(t.events).select("user_id", "start", "n", F.round("total", 4).alias("total"))
