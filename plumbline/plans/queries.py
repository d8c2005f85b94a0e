"""Registered queries: each operator family applied to whole driver tables, with the SQL that states the same rows.

``QUERIES`` maps a name to (spark, sf_dir) -> DataFrame, ``ORACLES`` to SQL over views of the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import money, text
from plumbline.operators import aggregates, bills, changes, facets, figures, joins, sales, state, windows
from plumbline.sources import extract, readers
from plumbline.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy tables of a directory: t.orders reads orders.parquet."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt over all shuffle partitions: for work that is heavy by row on a table of few bytes, which is read by few tasks.

    The number is stated, as adaptive execution would join partitions of few bytes again.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def query(sql: str | None = None, dates: tuple[str, ...] = (), longs: tuple[str, ...] = ()) -> Callable:
    """Registers a query. ``dates`` are returned as text on both sides; ``longs`` are wider in the other engine and cast."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable:
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir)).withColumns({c: F.col(c).cast("string") for c in dates})
        if sql is not None:
            casts = [f"CAST({c} AS {kind}) AS {c}" for kind, columns in (("VARCHAR", dates), ("BIGINT", longs)) for c in columns]
            ORACLES[name] = f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql})" if casts else sql
        return f

    return register


# Rates by segment: a fixed sheet of a handful of rows, as any rate sheet is.
_RATES = (("AUTOMOBILE", "1.085000"), ("BUILDING", "0.858738"), ("FURNITURE", "0.274000"), ("MACHINERY", "1.000000"), ("HOUSEHOLD", "0.910000"))
_RATES_SQL = ", ".join(f"('{c}', CAST({r} AS DECIMAL(18,6)))" for c, r in _RATES)


def _rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(_RATES), "currency string, rate string").withColumn("rate", F.col("rate").cast(money.RATE))


# --- joins -----------------------------------------------------------------------------------------------------------


@query(f"""
WITH rates(currency, rate) AS (VALUES {_RATES_SQL}),
priced AS (
  SELECT o_orderkey, o_custkey, n_name, CAST(CAST(o_totalprice AS DECIMAL(18,4)) * rate AS DOUBLE) AS total
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN rates ON c_mktsegment = currency)
SELECT n_name, count(*) AS n_quotes, round(min(total), 2) AS cheapest, arg_min(o_orderkey, (total, o_orderkey)) AS cheapest_order FROM priced GROUP BY n_name
""")
def join_quote_ranking(t: Tables) -> DataFrame:
    """Cheapest converted quote per nation: foreign keys, currency conversion, whole-row minimum. [JOI01, NUM05, AGG05]"""
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    total = money.converted(rows.select("o_orderkey", "n_name", "o_totalprice", "c_mktsegment"), _rates(t.spark), "o_totalprice", "c_mktsegment", "total", "none").withColumn("total", F.col("total").cast("double"))
    return total.groupBy("n_name").agg(F.count("*").alias("n_quotes"), F.round(F.min("total"), 2).alias("cheapest"), F.min_by("o_orderkey", F.struct("total", "o_orderkey")).alias("cheapest_order"))


def _sellers(t: Tables) -> list[tuple[str, DataFrame]]:
    o = t.orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice", "o_orderpriority")
    return [(str(i), o.where(F.col("o_orderpriority").startswith(str(i))).drop("o_orderpriority")) for i in (1, 2, 3)]


@query("""
WITH s AS (SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice, substr(o_orderpriority, 1, 1) AS seller FROM orders WHERE substr(o_orderpriority, 1, 1) IN ('1', '2', '3'))
SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice, seller FROM (SELECT *, min(seller) OVER (PARTITION BY o_custkey, o_orderdate) AS least FROM s) WHERE seller = least
""")
def join_merge_sellers(t: Tables) -> DataFrame:
    """Three sellers by precedence on (customer, date). [JOI02-JOI04]"""
    return joins.merge_sellers(_sellers(t), ["o_custkey", "o_orderdate"])


@query("""
WITH q AS (SELECT o_custkey, min(o_totalprice) AS other_price FROM orders WHERE o_orderpriority LIKE '2%' GROUP BY o_custkey),
r AS (SELECT o_orderkey, o_custkey, substr(o_orderpriority, 1, 1) AS seller FROM orders)
SELECT o_orderkey, seller, CASE WHEN seller <> '2' THEN other_price END AS other_price FROM r LEFT JOIN q USING (o_custkey)
""")
def join_attach_prices(t: Tables) -> DataFrame:
    """A second seller's price beside rows that aren't its own. [JOI05]"""
    rows = t.orders.select("o_orderkey", "o_custkey", F.substring("o_orderpriority", 1, 1).alias("seller"))
    quotes = t.orders.where("o_orderpriority LIKE '2%'").groupBy("o_custkey").agg(F.min("o_totalprice").alias("price"))
    return joins.attach_prices(rows, "2", quotes, ["o_custkey"], "price", "other_price").select("o_orderkey", "seller", "other_price")


@query("""
WITH aliases AS (SELECT c_name AS alias, c_custkey AS target FROM customer WHERE c_acctbal > 0),
named AS (SELECT o_orderkey, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT name, count(*) AS n FROM named WHERE name NOT IN (SELECT alias FROM aliases) GROUP BY name
""")
def join_alias_unmapped(t: Tables) -> DataFrame:
    """Orders whose customer name has no alias, counted. [JOI06, JOI24]"""
    aliases = t.customer.where("c_acctbal > 0").select(F.col("c_name").alias("alias"), F.col("c_custkey").alias("target"))
    named = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_name").alias("name"))
    return joins.alias_join(named, aliases, "name", "id")[1]


@query("""
WITH book AS (SELECT p_partkey, p_name AS exact, upper(split_part(p_name, ' ', 1)) AS loose FROM part WHERE p_size <= 40),
e AS (SELECT exact, min(p_partkey) AS k FROM book GROUP BY exact HAVING count(DISTINCT p_partkey) = 1),
l AS (SELECT loose, min(p_partkey) AS k FROM book GROUP BY loose HAVING count(DISTINCT p_partkey) = 1)
SELECT p.p_partkey AS id, coalesce(e.k, l.k) AS target, CASE WHEN e.k IS NOT NULL THEN 'exact' WHEN l.k IS NOT NULL THEN 'loose' END AS match
FROM part p LEFT JOIN e ON p_name = exact LEFT JOIN l ON upper(split_part(p_name, ' ', 1)) = loose
""")
def join_exact_then_loose(t: Tables) -> DataFrame:
    """Exact name, else a loose key that names one part. [JOI07, JOI08, JOI19]"""
    loose = F.upper(F.split("p_name", " ")[0])
    book = t.part.where("p_size <= 40").select(F.col("p_partkey").alias("target"), F.col("p_name").alias("exact"), loose.alias("loose"))
    rows = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("exact"), loose.alias("loose"))
    return joins.exact_then_loose(rows, book, "exact", "loose", "target").select("id", "target", "match")


@query("""
WITH pairs AS (SELECT DISTINCT o_custkey, l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity >= 45)
SELECT o_custkey, min(l_suppkey) AS l_suppkey FROM pairs GROUP BY o_custkey HAVING count(*) = 1
""")
def join_through_shared_keys(t: Tables) -> DataFrame:
    """Customers whose large lines lead to one supplier only. [JOI09]"""
    left = t.orders.select("o_custkey", F.col("o_orderkey").alias("k"))
    right = t.lineitem.where("l_quantity >= 45").select("l_suppkey", F.col("l_orderkey").alias("k"))
    return joins.through_shared_keys(left, right, ["k"], "o_custkey", "l_suppkey")


_LINES = "SELECT l_orderkey AS bill_id, l_returnflag AS code, CAST(l_tax * 100 AS INTEGER) AS cents, l_linestatus AS currency, l_discount >= 0.08 AS unstated, CASE WHEN l_discount < 0.08 THEN CASE WHEN l_suppkey % 50 = 0 THEN 'per_week' ELSE 'per_night' END END AS basis, l_suppkey FROM lineitem"


@query(f"""
WITH lines AS ({_LINES}), lend AS (SELECT * FROM lines WHERE NOT unstated AND l_suppkey % 50 = cents * 5 % 50),
units AS (SELECT code, cents, currency, min(basis) AS unit FROM lend GROUP BY ALL HAVING count(DISTINCT basis) = 1)
SELECT code, currency, cents, count(*) AS n, count_if(unstated AND unit IS NOT NULL) AS lent FROM lines LEFT JOIN units USING (code, cents, currency) GROUP BY ALL
""", longs=("lent",))
def join_borrow_units(t: Tables) -> DataFrame:
    """Lines without a unit take it from lines of the same code, amount and currency, unless those disagree. [JOI10, JOI11]"""
    cents = (F.col("l_tax") * 100).cast("decimal(18,0)").cast("int")
    unstated = F.col("l_discount") >= 0.08
    lines = t.lineitem.select(
        F.col("l_orderkey").alias("bill_id"), F.col("l_returnflag").alias("code"), cents.alias("amount"), F.col("l_linestatus").alias("currency"), unstated.alias("unit_unstated"),
        F.when(~unstated, F.when(F.col("l_suppkey") % 50 == 0, "per_week").otherwise("per_night")).alias("basis"), (F.col("l_suppkey") % 50).alias("source"),
    )
    out = joins.borrow_units(lines, lines.where(F.col("source") == F.col("amount") * 5 % 50))
    return out.groupBy("code", "currency", F.col("amount").alias("cents")).agg(F.count("*").alias("n"), F.count_if("unit_lent").alias("lent"))


@query("""
WITH h AS (SELECT p_partkey AS k, p_size AS v, DATE '2024-01-01' + CAST(p_partkey % 7 AS INTEGER) AS d FROM part WHERE p_size <= 30),
s AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 <> 0 THEN p_size + 1 END AS v, DATE '2024-01-04' AS d FROM part WHERE p_size >= 20),
j AS (SELECT coalesce(h.k, s.k) AS k, h.v AS hv, h.d AS hd, s.v AS sv, s.d AS sd FROM h FULL JOIN s ON h.k = s.k)
SELECT k, CASE WHEN sv IS NOT NULL AND (hv IS NULL OR sd > hd) THEN sv ELSE coalesce(hv, sv) END AS v, coalesce(sv IS NOT NULL AND hv IS NOT NULL AND sd > hd, false) AS superseded FROM j
""")
def join_prefer_unless_fresher(t: Tables) -> DataFrame:
    """Hand-read values against scraped ones that may be fresher. [JOI13]"""
    k = F.col("p_partkey")
    h = t.part.where("p_size <= 30").select(k.alias("k"), F.col("p_size").alias("v"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 7).cast("int")).alias("d"))
    s = t.part.where("p_size >= 20").select(k.alias("k"), F.when(k % 5 != 0, F.col("p_size") + 1).alias("v"), F.lit("2024-01-04").cast("date").alias("d"))
    return joins.prefer_unless_fresher(h, s, ["k"], "v", "d")


@query("""
WITH runs AS (SELECT p_brand, p_type, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY ALL),
first AS (SELECT p.p_partkey, r.p_type AS run, row_number() OVER (PARTITION BY p.p_partkey ORDER BY r.lo, r.hi, r.p_type) AS nth
  FROM part p LEFT JOIN runs r ON p.p_brand = r.p_brand AND p.p_size BETWEEN r.lo AND r.hi)
SELECT p_partkey, run FROM first WHERE nth = 1
""")
def join_range(t: Tables) -> DataFrame:
    """Each part with the first size range of its brand that holds it: an equality and a residual range. [JOI15]"""
    runs = t.part.groupBy("p_brand", "p_type").agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi")).withColumnRenamed("p_type", "run")
    return joins.range_join(t.part.select("p_partkey", "p_brand", "p_size"), runs, "p_brand", "p_size", "lo", "hi", order=["lo", "hi", "run"]).select("p_partkey", "run")


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders),
n AS (SELECT a.o_orderkey, arg_max(b.o_totalprice, (b.o_orderdate, b.o_orderkey)) AS prev_o_totalprice, max(b.o_orderdate) AS prev_o_orderdate
  FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND b.o_orderdate < a.o_orderdate GROUP BY a.o_orderkey)
SELECT o_orderkey, prev_o_totalprice, prev_o_orderdate FROM o LEFT JOIN n USING (o_orderkey)
""")
def join_as_of(t: Tables) -> DataFrame:
    """Each order beside its customer's newest earlier order. [JOI18]"""
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return joins.as_of(rows, ["o_custkey"], "o_orderdate", ["o_totalprice"], tie=["o_orderkey"]).select("o_orderkey", "prev_o_totalprice", "prev_o_orderdate")


@query("""
WITH a AS (SELECT o_custkey, o_orderstatus, min(o_orderkey) AS id FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY ALL HAVING count(*) = 1),
g AS (SELECT o_custkey, o_orderstatus, min(o_orderkey) AS id FROM orders WHERE o_orderpriority LIKE '5%' GROUP BY ALL HAVING count(*) = 1)
SELECT a.o_custkey, a.o_orderstatus, a.id AS id_added, g.id AS id_gone FROM a JOIN g USING (o_custkey, o_orderstatus)
""")
def join_pair_unique(t: Tables) -> DataFrame:
    """Pairs of rows that are each alone under their key. [JOI16, CHG05]"""
    o = t.orders.select("o_custkey", "o_orderstatus", F.col("o_orderkey").alias("id"), "o_orderpriority")
    return joins.pair_unique(o.where("o_orderpriority LIKE '1%'"), o.where("o_orderpriority LIKE '5%'"), ["o_custkey", "o_orderstatus"], "id")


@query("""
WITH p AS (SELECT l_partkey, min(l_extendedprice / l_quantity) AS a, max(l_extendedprice / l_quantity) AS b FROM lineitem GROUP BY l_partkey),
e AS (SELECT abs((b - a) / a) AS e FROM p)
SELECT CASE WHEN e <= 0.0 THEN 'same' WHEN e <= 0.5 THEN 'near' WHEN e <= 5.0 THEN 'off' ELSE 'far' END AS band, count(*) AS n FROM e GROUP BY ALL
""")
def join_banded_error(t: Tables) -> DataFrame:
    """How far two prices of a part lie apart, in bands. [JOI20]"""
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    pairs = t.lineitem.groupBy("l_partkey").agg(F.min(unit).alias("a"), F.max(unit).alias("b"))
    return joins.banded_error(pairs, "a", "b", [(0.0, "same"), (0.5, "near"), (5.0, "off")], "far")


@query("""
SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END, c_acctbal) AS o_totalprice FROM orders LEFT JOIN (SELECT c_custkey AS o_custkey, c_acctbal FROM customer) USING (o_custkey)
""")
def join_backfill(t: Tables) -> DataFrame:
    """Missing values from an archive of the same key. [JOI21]"""
    rows = t.orders.select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("o_totalprice"))
    archive = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("o_totalprice"))
    return joins.backfill(rows, archive, ["o_custkey"], ["o_totalprice"]).select("o_orderkey", "o_totalprice")


@query("""
WITH new AS (SELECT o_orderkey AS id, o_custkey AS key FROM orders WHERE o_orderstatus = 'O'), prev AS (SELECT o_orderkey AS id, o_custkey AS key FROM orders),
unread AS (SELECT c_custkey AS key FROM customer WHERE c_acctbal < 0)
SELECT id, key, false AS carried FROM new UNION ALL
SELECT id, key, true FROM prev WHERE key IN (SELECT key FROM unread) AND id NOT IN (SELECT id FROM new)
""")
def join_carry(t: Tables) -> DataFrame:
    """Previous rows of pages that weren't read this time. [JOI22, JOI23]"""
    prev = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), "o_orderstatus")
    return joins.carry(prev.drop("o_orderstatus"), prev.where("o_orderstatus = 'O'").drop("o_orderstatus"), t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("key")), "key", "id").select("id", "key", "carried")


# --- aggregates ------------------------------------------------------------------------------------------------------


@query("""
WITH c AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL)
SELECT p_brand, arg_min(p_size, (-n, p_size)) AS smallest, arg_max(p_size, (n, p_size)) AS largest FROM c GROUP BY p_brand
""")
def agg_vote(t: Tables) -> DataFrame:
    """Most frequent size of a brand, ties to the smallest and to the largest. [AGG02, AGG03]"""
    return aggregates.vote(t.part, ["p_brand"], "p_size", "smallest").join(aggregates.vote(t.part, ["p_brand"], "p_size", "largest", largest=True), "p_brand")


@query("""
WITH d AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(p_type) ELSE p_type END AS v, p_brand FROM part),
n AS (SELECT p_brand, v, count(*) AS n FROM d GROUP BY ALL), best AS (SELECT p_brand, lower(v) AS k, arg_min(v, (-n, v)) AS settled FROM n GROUP BY ALL)
SELECT p_partkey, settled FROM d JOIN best ON d.p_brand = best.p_brand AND lower(v) = k
""")
def agg_settle_spelling(t: Tables) -> DataFrame:
    """Spellings that differ in case only. [AGG04]"""
    d = t.part.select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 3 == 0, F.upper("p_type")).otherwise(F.col("p_type")).alias("v"))
    return aggregates.settle_spelling(d, ["p_brand"], "v", "settled").select("p_partkey", "settled")


@query("""
SELECT l_orderkey, CASE WHEN count(*) = count(nullif(l_discount, 0)) THEN round(sum(nullif(l_discount, 0)), 6) END AS strict, count(*) AS n FROM lineitem GROUP BY l_orderkey
""")
def agg_strict_sum(t: Tables) -> DataFrame:
    """A sum that one unknown makes unknown. [AGG07]"""
    v = F.nullif(F.col("l_discount"), F.lit(0.0))
    return t.lineitem.groupBy("l_orderkey").agg(F.round(aggregates.strict_sum(v), 6).alias("strict"), F.count("*").alias("n"))


@query("""
WITH m AS (SELECT l_orderkey, min(l_quantity) AS least FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, least, count(*) AS n_rows, CASE WHEN count(*) = count(nullif(l_linenumber, 3)) THEN sum(nullif(l_linenumber, 3)) END AS places FROM lineitem JOIN m USING (l_orderkey) WHERE l_quantity = least GROUP BY ALL
""", longs=("places",))
def agg_at_minimum(t: Tables) -> DataFrame:
    """Rows at the least price, and the places on them. [AGG08]"""
    rows = t.lineitem.select("l_orderkey", "l_quantity", F.nullif(F.col("l_linenumber"), F.lit(3)).cast("long").alias("places"))
    return aggregates.at_minimum(rows, ["l_orderkey"], "l_quantity", "places")


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY event_type")
def agg_tally(t: Tables) -> DataFrame:
    """Facet tally. [AGG11]"""
    return aggregates.tally(t.events, F.col("event_type"))


@query("""
WITH s AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS f FROM lineitem GROUP BY l_orderkey)
SELECT array_to_string(f, '+') AS combination, CAST(len(f) AS INTEGER) AS arity, count(*) AS n FROM s GROUP BY ALL
""")
def agg_combinations(t: Tables) -> DataFrame:
    """Combinations of flags of an order, in fixed order. [AGG14]"""
    sets = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("f"))
    return aggregates.combinations(sets, F.col("f"), ["A", "N", "R"])


@query("SELECT count(*) AS rows, count(DISTINCT l_orderkey) AS n_l_orderkey, count(DISTINCT l_partkey) AS n_l_partkey FROM lineitem WHERE l_discount > 0.05")
def agg_shown(t: Tables) -> DataFrame:
    """Rows and distinct entities shown under a filter. [AGG15]"""
    return aggregates.shown(t.lineitem.where("l_discount > 0.05"), "l_orderkey", "l_partkey")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def agg_last_state(t: Tables) -> DataFrame:
    """Last state of each user. [AGG16]"""
    return aggregates.last_state(t.events, ["user_id"], "event_type", ["ts", "event_id"])


@query("SELECT p_brand, count(p_retailprice) AS n, min(p_retailprice) AS least, max(p_retailprice) AS most, median(p_retailprice) AS middle FROM part GROUP BY p_brand")
def agg_spread(t: Tables) -> DataFrame:
    """Count, ends and median. [AGG17, AGG20, NUM14]"""
    return aggregates.spread(t.part, ["p_brand"], "p_retailprice")


@query("""
WITH r AS (SELECT p_brand, p_size, row_number() OVER w AS nth, count(*) OVER (PARTITION BY p_brand) AS n FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey))
SELECT p_brand, median(CASE WHEN nth <= n // 3 THEN p_size END) AS first_third, median(CASE WHEN nth > n - n // 3 THEN p_size END) AS last_third FROM r GROUP BY p_brand
""")
def agg_thirds(t: Tables) -> DataFrame:
    """Median size in the cheapest and the dearest third of a brand. [AGG18]"""
    return aggregates.thirds(t.part, ["p_brand"], ["p_retailprice", "p_partkey"], F.col("p_size").cast("double"))


@query("""
WITH s AS (SELECT o_custkey, max(CASE WHEN o_orderpriority LIKE '1%' THEN o_totalprice END) AS a, max(CASE WHEN o_orderpriority LIKE '2%' THEN o_totalprice END) AS b FROM orders GROUP BY o_custkey)
SELECT count(abs(a - b)) AS pairs, count_if(abs(a - b) >= 1000) AS apart, max(abs(a - b)) AS widest, median(abs(a - b)) AS middle FROM s
""", longs=("apart",))
def agg_seller_gap(t: Tables) -> DataFrame:
    """How far two sellers lie apart. [AGG21, AGG22]"""
    one = lambda p: F.max(F.when(F.col("o_orderpriority").startswith(p), F.col("o_totalprice")))
    return aggregates.gaps(t.orders.groupBy("o_custkey").agg(one("1").alias("a"), one("2").alias("b")), "a", "b", 1000.0)


@query("""
WITH s AS (SELECT o_custkey, max(CASE WHEN o_orderpriority LIKE '1%' THEN o_orderstatus END) AS a, max(CASE WHEN o_orderpriority LIKE '2%' THEN o_orderstatus END) AS b FROM orders GROUP BY o_custkey)
SELECT count_if(a = b) AS alike, count_if(a <> b) AS different, count_if((a IS NULL) <> (b IS NULL)) AS one, count_if(a IS NULL AND b IS NULL) AS neither FROM s
""", longs=("alike", "different", "one", "neither"))
def agg_agreement(t: Tables) -> DataFrame:
    """How often two sellers agree. [AGG24, AGG25]"""
    one = lambda p: F.max(F.when(F.col("o_orderpriority").startswith(p), F.col("o_orderstatus")))
    return aggregates.agreement(t.orders.groupBy("o_custkey").agg(one("1").alias("a"), one("2").alias("b")), F.col("a"), F.col("b"))


@query("""
SELECT o_orderstatus, o_orderpriority, count(*) AS n, count_if(c_mktsegment = 'BUILDING') AS "BUILDING", count_if(c_mktsegment = 'MACHINERY') AS "MACHINERY",
  CASE WHEN count(*) > 0 THEN count_if(c_mktsegment = 'BUILDING') / count(*) END AS rate FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL
""", longs=("BUILDING", "MACHINERY"))
def agg_contingency(t: Tables) -> DataFrame:
    """Contingency table with a rate. [AGG27, AGG28]"""
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderstatus", "o_orderpriority", "c_mktsegment")
    table = aggregates.contingency(rows, ["o_orderstatus"], "o_orderpriority", "c_mktsegment", ["BUILDING", "MACHINERY"])
    return table.withColumn("rate", aggregates.rate(F.col("BUILDING"), F.col("n")))


@query("SELECT l_orderkey, l_returnflag, arg_min(l_partkey, (l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS l_partkey FROM lineitem GROUP BY l_orderkey, l_returnflag")
def agg_first_copy(t: Tables) -> DataFrame:
    """First line of each flag of an order. [AGG30]"""
    return aggregates.first_copy(t.lineitem, ["l_orderkey", "l_returnflag"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]).select("l_orderkey", "l_returnflag", "l_partkey")


@query("""
WITH b AS (SELECT l_orderkey AS id, l_suppkey, l_shipdate AS start, l_extendedprice AS base, CASE WHEN l_discount > 0 THEN l_extendedprice * (1 + l_tax) END AS total, l_quantity, l_partkey, l_linenumber FROM lineitem),
f AS (SELECT l_suppkey, id, start, min(base) AS base, min(total) AS total FROM b GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY start, id) AS nth FROM f)
SELECT l_suppkey, id, round(base, 4) AS base, round(total, 4) AS total, CASE WHEN base > 0 THEN round(100 * (total - base) / base, 6) END AS markup FROM r WHERE nth = 1
""")
def agg_check_table(t: Tables) -> DataFrame:
    """First bill of each supplier with its base, total and markup. [AGG29]"""
    b = t.lineitem.select(F.col("l_orderkey").alias("id"), "l_suppkey", F.col("l_shipdate").alias("start"), F.col("l_extendedprice").alias("base"), F.when(F.col("l_discount") > 0, F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("total"))
    one = b.groupBy("l_suppkey", "id", "start").agg(F.min("base").alias("base"), F.min("total").alias("total"))
    out = aggregates.check_table(one, ["l_suppkey"], "start")
    return out.select("l_suppkey", "id", F.round("base", 4).alias("base"), F.round("total", 4).alias("total"), F.round("markup", 6).alias("markup"))


@query("SELECT c_nationkey, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) GROUP BY c_nationkey")
def agg_without_children(t: Tables) -> DataFrame:
    """Customers without orders by nation. [AGG32]"""
    return aggregates.without_children(t.customer, t.orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "c_nationkey")


@query("""
WITH d AS (SELECT l_suppkey AS boat, l_returnflag AS trip, CAST(o_orderdate AS DATE) AS a, CAST(l_shipdate AS DATE) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
n AS (SELECT boat, trip, b - a AS nights, count(*) AS n, min(a) AS first, max(a) AS last FROM d WHERE b - a BETWEEN 1 AND 30 GROUP BY ALL)
SELECT boat, trip, CAST(arg_min(nights, (-n, nights)) AS INTEGER) AS nights, sum(n) AS departures, min(first) AS first, max(last) AS last FROM n GROUP BY boat, trip
""", dates=("first", "last"), longs=("departures",))
def agg_trips(t: Tables) -> DataFrame:
    """Departures with plausible dates grouped into trips by boat and title, each with its usual length. [AGG01]"""
    d = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey").alias("boat"), F.col("l_returnflag").alias("name"), F.to_date("o_orderdate").alias("start"), F.to_date("l_shipdate").alias("end"))
    return figures.trips(d)[0]


@query("""
WITH e AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem WHERE l_discount > 0.09), n AS (SELECT count(DISTINCT l_suppkey) AS v, count(*) AS t FROM e),
o AS (SELECT count(*) AS n, min(o_totalprice) AS least, max(CASE WHEN o_totalprice < 0 THEN 1 END) AS refunded FROM orders)
SELECT 'estimate.vessels' AS figure, CAST(nullif(v, 0) AS DOUBLE) AS value FROM n UNION ALL SELECT 'estimate.trips', nullif(t, 0) FROM n
UNION ALL SELECT 'orders.n', n FROM o UNION ALL SELECT 'orders.least', least FROM o UNION ALL SELECT 'orders.refunded', refunded FROM o
""")
def agg_stated_figures(t: Tables) -> DataFrame:
    """Named figures of a report, unknown ones null; among them how far an estimate reaches. [AGG19, AGG23]"""
    lines = t.lineitem.select(F.col("l_suppkey").alias("boat"), F.col("l_orderkey").alias("trip"), (F.col("l_discount") > 0.09).alias("estimated"))
    totals = t.orders.agg(F.count("*").alias("n"), F.min("o_totalprice").alias("least"), F.max(F.when(F.col("o_totalprice") < 0, 1)).alias("refunded"))
    return figures.stated_figures({"estimate": figures.estimate_reach(lines), "orders": totals})


# --- windows ---------------------------------------------------------------------------------------------------------

_DAYS = "SELECT l_partkey, CAST(l_shipdate AS DATE) AS day, max(CAST(l_discount * 100 AS INTEGER)) AS pct, min(l_suppkey) AS seller FROM lineitem GROUP BY ALL"


def _days(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_partkey", F.to_date("l_shipdate").alias("day")).agg(F.max((F.col("l_discount") * 100).cast("decimal(18,0)").cast("int")).alias("pct"), F.min("l_suppkey").alias("seller"))


@query(f"""
WITH d AS ({_DAYS}), f AS (SELECT *, pct >= 5 AS sale FROM d),
r AS (SELECT *, sum(CASE WHEN sale THEN 0 ELSE 1 END) OVER (PARTITION BY l_partkey ORDER BY day) AS run FROM f)
SELECT l_partkey, CAST(run AS BIGINT) AS run, count(*) AS n, min(day) AS first, max(day) AS last, min(pct) AS pct_min, max(pct) AS pct_max FROM r WHERE sale GROUP BY ALL
""", dates=("first", "last"))
def win_runs(t: Tables) -> DataFrame:
    """Runs of discounted days of a part. [WIN01-WIN03]"""
    d = _days(t).withColumn("sale", F.col("pct") >= 5).withColumn("read", F.col("day"))
    s = windows.run_summary(d, ["l_partkey"], ["day"], "sale", "day", "pct", "seller", "read", "day")
    return s.select("l_partkey", F.col("run").cast("long").alias("run"), "n", "first", "last", "pct_min", "pct_max")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS number FROM events")
def win_numbered(t: Tables) -> DataFrame:
    """Stable row numbers. [WIN04]"""
    return windows.numbered(t.events, ["user_id"], ["ts", "event_id"]).select("event_id", F.col("number").cast("long").alias("number"))


@query("""
WITH n AS (SELECT event_id, user_id, event_type, ts, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ni FROM events)
SELECT event_id, user_id, event_type FROM n WHERE ni IS NULL OR nx IS DISTINCT FROM event_type
""")
def win_collapse_repeats(t: Tables) -> DataFrame:
    """The last of consecutive events of one type. [WIN06]"""
    rows = t.events.withColumn("o", F.struct("ts", "event_id"))
    return windows.collapse_repeats(rows, ["user_id"], "o", "event_type").select("event_id", "user_id", "event_type")


@query("""
WITH s AS (SELECT user_id, event_id, ts, value, event_type, lag(value) OVER w AS was, lag(event_id) OVER w AS was_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, CASE WHEN was <> 0 THEN value / was END AS ratio FROM s WHERE was_id IS NOT NULL),
m AS (SELECT *, median(ratio) OVER (PARTITION BY event_type) AS middle, count(ratio) OVER (PARTITION BY event_type) AS n FROM r)
SELECT event_id AS now_event_id, CASE WHEN was IS NULL OR value IS NULL THEN 'unpriced' WHEN was = value THEN 'same' WHEN n < 3 THEN 'too few' WHEN abs(ratio / middle - 1) <= 0.01 THEN 'group-wide' WHEN ratio / middle - 1 > 0 THEN 'rose' ELSE 'fell' END AS verdict FROM m
""")
def win_fare_verdicts(t: Tables) -> DataFrame:
    """Steps of a user's values against the median ratio of their type. [WIN05, WIN07]"""
    rows = t.events.select("user_id", F.struct("ts", "event_id").alias("o"), "event_id", F.col("value").alias("amount"), F.lit("EUR").alias("currency"), F.lit(None).cast("int").alias("pct"), "event_type")
    moves = windows.steps(rows, ["user_id"], "o", ["event_id", "amount", "currency", "pct", "event_type"])
    return windows.fare_verdicts(moves, ["now_event_type"]).select("now_event_id", "verdict")


@query("""
WITH v AS (SELECT event_id, user_id, ts, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events)
SELECT event_id, event_type = 'purchase' OR coalesce(nx = 'purchase', false) AS purchase FROM v
""")
def win_this_or_next(t: Tables) -> DataFrame:
    """An outcome in this step or the next. [WIN08]"""
    return windows.this_or_next(t.events.withColumn("o", F.struct("ts", "event_id")), ["user_id"], "o", "event_type", "purchase").select("event_id", "purchase")


@query("""
WITH s AS (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events)
SELECT CASE WHEN was IS NULL OR value IS NULL THEN 'unknown' WHEN value < was THEN 'filled' WHEN value > was THEN 'grew' ELSE 'held' END AS verdict, count(*) AS n FROM s GROUP BY ALL
""")
def win_places_verdict(t: Tables) -> DataFrame:
    """What each step did to a count. [WIN09]"""
    from pyspark.sql import Window

    was = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.select(windows.places_verdict(was, F.col("value")).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


@query("""
WITH q AS (SELECT l_partkey, l_suppkey, min(l_extendedprice / l_quantity) AS low, max(l_extendedprice / l_quantity) AS high FROM lineitem GROUP BY ALL)
SELECT l_partkey, arg_min(l_suppkey, (low, l_suppkey)) AS best, arg_max(l_suppkey, (low, -l_suppkey)) AS worst, arg_max(l_suppkey, (high, -l_suppkey)) AS top,
  CASE WHEN max(low) - min(low) >= 5 THEN max(low) - min(low) END AS spread FROM q GROUP BY l_partkey
""")
def win_best_and_worst(t: Tables) -> DataFrame:
    """Cheapest and dearest whole seller row of a part. [WIN11]"""
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    q = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.min(unit).alias("low"), F.max(unit).alias("high"))
    b = windows.best_and_worst(q, ["l_partkey"], "low", "high", "l_suppkey")
    return b.select("l_partkey", F.col("best.l_suppkey").alias("best"), F.col("worst.l_suppkey").alias("worst"), F.col("top.l_suppkey").alias("top"), "spread")


@query("""
WITH d AS (SELECT DISTINCT event_type, CAST(ts AS DATE) AS day FROM events), n AS (SELECT *, dense_rank() OVER (PARTITION BY event_type ORDER BY day DESC) AS nth FROM d)
SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE (event_type, CAST(ts AS DATE)) IN (SELECT (event_type, day) FROM n WHERE nth <= 2) GROUP BY ALL
""", dates=("day",))
def win_newest_days(t: Tables) -> DataFrame:
    """Events of the two newest days of each type. [WIN12, SNK12]"""
    return windows.newest_days(t.events.withColumn("day", F.to_date("ts")), "day", 2, ["event_type"]).groupBy("event_type", "day").agg(F.count("*").alias("n"))


@query("""
WITH d AS (SELECT o_custkey, CAST(max(o_orderdate) AS DATE) AS last, count(*) > 12 AS moved FROM orders GROUP BY o_custkey), y AS (SELECT CAST(max(o_orderdate) AS DATE) AS today FROM orders)
SELECT o_custkey, CASE WHEN today - last >= 14 THEN 'overdue' WHEN moved THEN 'moved' WHEN today - last >= 7 THEN 'stale' WHEN o_custkey % 3 = (today - DATE '1970-01-01') % 3 THEN 'turn' END AS due FROM d CROSS JOIN y
""")
def win_due(t: Tables) -> DataFrame:
    """Why a customer is read today. [WIN13]"""
    d = t.orders.groupBy("o_custkey").agg(F.to_date(F.max("o_orderdate")).alias("last"), (F.count("*") > 12).alias("moved")).withColumn("k", F.lit(1))
    today = t.orders.agg(F.to_date(F.max("o_orderdate")).alias("today")).withColumn("k", F.lit(1))
    return windows.due(d.join(F.broadcast(today), "k"), F.col("today"), F.col("moved"), "last", "o_custkey").select("o_custkey", "due")


@query("""
WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS nth, greatest(count(*) OVER (PARTITION BY p_brand) - 5, 0) AS more FROM part)
SELECT p_brand, p_partkey, nth, more FROM r WHERE nth <= 5
""")
def sort_top_of_section(t: Tables) -> DataFrame:
    """The first five of each section and how many more there are. [SRT05, SNK05, SNK06]"""
    return windows.top_of_section(t.part, "p_brand", [F.desc("p_retailprice"), F.asc("p_partkey")], 5).select("p_brand", "p_partkey", F.col("nth").cast("long").alias("nth"), "more")


# --- bills -----------------------------------------------------------------------------------------------------------

_BILL_LINES = """
SELECT l_orderkey AS bill_id, l_returnflag AS code, CASE l_linestatus WHEN 'O' THEN 'mandatory' ELSE 'optional' END AS tier, CAST(l_quantity AS DECIMAL(18,4)) AS amount,
  l_linenumber AS level, l_partkey * 1000 + l_suppkey AS position, CASE l_linenumber % 4 WHEN 0 THEN 'per_trip' WHEN 1 THEN 'per_night' WHEN 2 THEN 'per_day' ELSE 'per_week' END AS basis,
  l_suppkey % 7 + 3 AS nights, l_discount > 0.09 AS unit_unstated, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber DESC, l_partkey * 1000 + l_suppkey, l_quantity, l_discount, l_linestatus) AS nth FROM lineitem
"""


@query(f"""
WITH l AS (SELECT * FROM ({_BILL_LINES}) WHERE nth = 1),
s AS (SELECT *, CASE WHEN NOT unit_unstated THEN amount * CASE basis WHEN 'per_trip' THEN 1 WHEN 'per_night' THEN nights WHEN 'per_day' THEN nights + 1 ELSE greatest(1, CAST(ceil(nights / 7) AS BIGINT)) END END AS low FROM l)
SELECT bill_id, CAST(coalesce(sum(CASE WHEN tier = 'mandatory' OR code = 'R' THEN low END), 0) AS DOUBLE) AS surcharge, count_if((tier = 'mandatory' OR code = 'R') AND low IS NULL) AS n_unpriced, bool_or(tier = 'mandatory') AS mandatory_known FROM s GROUP BY bill_id
""", longs=("n_unpriced",))
def bill_totals(t: Tables) -> DataFrame:
    """Lines resolved by level, scaled by unit and nights, counted under a toggle, summed; unstated units unpriced. [BIL01-BIL05, BIL09, BIL14, AGG05, AGG10]"""
    n = F.col("l_linenumber")
    position = F.col("l_partkey") * 1000 + F.col("l_suppkey")
    lines = t.lineitem.select(
        F.col("l_orderkey").alias("bill_id"), F.col("l_returnflag").alias("code"), F.when(F.col("l_linestatus") == "O", "mandatory").otherwise("optional").alias("tier"),
        F.col("l_quantity").cast(money.MONEY).alias("amount"), F.lit(None).cast(money.MONEY).alias("amount_max"), F.lit("EUR").alias("currency"),
        F.when(n % 4 == 0, "per_trip").when(n % 4 == 1, "per_night").when(n % 4 == 2, "per_day").otherwise("per_week").alias("basis"), F.lit(False).alias("included"),
        (F.col("l_discount") > 0.09).alias("unit_unstated"), F.lit(None).cast("string").alias("note"), n.alias("level"), F.struct(position.alias("p"), "l_quantity", "l_discount", "l_linestatus").alias("position"),
        (F.col("l_suppkey") % 7 + 3).alias("nights"), F.lit(0).alias("dives"),
    )
    priced = bills.bill_lines(lines, t.spark.createDataFrame([("USD", "0.9")], "currency string, rate string"), {"R": True})
    total = bills.totals(priced.select("bill_id").distinct().withColumn("base", F.lit(0).cast("decimal(28,10)")), priced)
    return total.select("bill_id", F.col("surcharge").cast("double").alias("surcharge"), F.size("unpriced").cast("long").alias("n_unpriced"), "mandatory_known")


@query("""
WITH own AS (SELECT DISTINCT l_orderkey AS bill_id, l_returnflag AS code, l_linestatus AS tier FROM lineitem WHERE l_linenumber <= 3),
theirs AS (SELECT DISTINCT l_orderkey AS bill_id, l_returnflag AS code, l_linestatus AS tier FROM lineitem WHERE l_linenumber > 3), c AS (SELECT o_orderkey AS bill_id FROM orders WHERE o_orderstatus = 'F'),
t AS (SELECT * FROM theirs WHERE bill_id IN (SELECT bill_id FROM c))
SELECT bill_id, code, tier FROM t WHERE tier = 'O' UNION ALL
SELECT bill_id, code, tier FROM own WHERE tier <> 'O' AND bill_id IN (SELECT bill_id FROM c) AND NOT EXISTS (SELECT 1 FROM t WHERE t.bill_id = own.bill_id AND t.code = own.code)
""")
def bill_of_seller(t: Tables) -> DataFrame:
    """Another seller's complete bills: its mandatory lines, and others whose code it doesn't state. [BIL11, BIL12]"""
    tier = F.when(F.col("l_linestatus") == "O", "mandatory").otherwise("other")
    lines = lambda test: t.lineitem.where(test).select(F.col("l_orderkey").alias("bill_id"), F.col("l_returnflag").alias("code"), tier.alias("tier")).distinct()
    complete = t.orders.select(F.col("o_orderkey").alias("bill_id"), (F.col("o_orderstatus") == "F").alias("complete"))
    out = bills.seller_bill(lines("l_linenumber <= 3"), lines("l_linenumber > 3"), complete)
    return out.withColumn("tier", F.when(F.col("tier") == "mandatory", "O").otherwise("F"))


# --- sales -----------------------------------------------------------------------------------------------------------


@query("""
WITH r AS (SELECT l_orderkey AS sailing, l_suppkey AS seller, l_extendedprice * (1 - l_discount) AS price, l_extendedprice AS was FROM lineitem),
m AS (SELECT sailing, seller, arg_min(struct_pack(p := price, w := was), (price, was)) AS r FROM r GROUP BY ALL)
SELECT sailing, seller, r.p AS price, CASE WHEN r.w > r.p THEN r.w END AS was FROM m
""")
def sale_list_prices(t: Tables) -> DataFrame:
    """Least price of each seller and sailing, the earlier price only above it. [SAL01]"""
    r = t.lineitem.select(F.col("l_orderkey").alias("sailing"), F.col("l_suppkey").alias("seller"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("price"), F.col("l_extendedprice").alias("was"))
    return sales.list_prices(r)


@query("""
WITH l AS (SELECT l_orderkey AS sailing, l_suppkey AS seller, min(l_extendedprice) AS least FROM lineitem GROUP BY ALL)
SELECT sailing, seller, least, o_totalprice AS reference FROM l JOIN orders ON sailing = o_orderkey WHERE abs(least - o_totalprice) / o_totalprice > 0.5
""")
def sale_stale_ladders(t: Tables) -> DataFrame:
    """Ladders whose cheapest rung is far off its reference. [SAL03]"""
    rungs = t.lineitem.select(F.col("l_orderkey").alias("sailing"), F.col("l_suppkey").alias("seller"), F.col("l_extendedprice").alias("price"))
    refs = rungs.select("sailing", "seller").distinct().join(t.orders, F.col("sailing") == F.col("o_orderkey")).select("sailing", "seller", F.lit(None).cast("double").alias("own_price"), F.col("o_totalprice").alias("row_price"))
    return sales.stale_ladders(rungs, refs, 0.5)


@query("""
WITH m AS (SELECT *, min(l_extendedprice) OVER (PARTITION BY l_orderkey, l_suppkey) AS least, nullif(l_linenumber, 7) AS p FROM lineitem)
SELECT l_orderkey AS sailing, l_suppkey AS seller, min(least) AS least, CASE WHEN count_if(l_extendedprice = least AND p IS NULL) = 0 THEN sum(CASE WHEN l_extendedprice = least THEN p END) END AS at_price,
  CASE WHEN count(*) = count(p) THEN sum(p) END AS aboard FROM m GROUP BY ALL
""", longs=("at_price", "aboard"))
def sale_berth_blocks(t: Tables) -> DataFrame:
    """Places at the least price and aboard, unknown if any room's count is. [SAL04-SAL06]"""
    rooms = t.lineitem.select(F.col("l_orderkey").alias("sailing"), F.col("l_suppkey").alias("seller"), F.col("l_partkey").cast("string").alias("name"), F.col("l_extendedprice").alias("price"), F.nullif(F.col("l_linenumber"), F.lit(7)).cast("long").alias("places"))
    return sales.berth_blocks(rooms).drop("ladder")


@query("""
SELECT l_partkey AS sailing, arg_min(l_extendedprice, (l_extendedprice, l_orderkey)) AS price, arg_min(l_suppkey, (l_extendedprice, l_orderkey, l_suppkey)) AS was FROM lineitem WHERE CAST(l_shipdate AS DATE) = (SELECT max(CAST(l_shipdate AS DATE)) - 30 FROM lineitem) GROUP BY l_partkey
""")
def sale_census(t: Tables) -> DataFrame:
    """Cheapest priced rung of each sailing read on one day. [SAL09]"""
    day = t.lineitem.agg(F.date_sub(F.max(F.to_date("l_shipdate")), 30).alias("d")).withColumn("k", F.lit(1))
    ladders = t.lineitem.withColumn("k", F.lit(1)).join(F.broadcast(day), "k").select(F.col("l_partkey").alias("sailing"), F.to_date("l_shipdate").alias("read_day"), F.col("l_extendedprice").alias("price"), F.col("l_suppkey").alias("was"), F.lit("EUR").alias("currency"), F.struct("l_orderkey", "l_suppkey").alias("name"), "d")
    return sales.census(ladders, F.col("d")).select("sailing", "price", "was")


# --- changes ---------------------------------------------------------------------------------------------------------

_SNAPSHOTS = """before AS (SELECT o_orderkey AS id, o_custkey AS boat, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderdate < TIMESTAMP '2000-12-01'),
after AS (SELECT o_orderkey AS id, o_custkey AS boat, CASE WHEN o_orderkey % 7 = 0 THEN 'P' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice + o_orderkey % 13 - 4 ELSE o_totalprice END AS price FROM orders WHERE o_orderdate >= TIMESTAMP '1998-05-01')"""


def _snapshots(t: Tables) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    base = t.orders.select(k.alias("id"), F.col("o_custkey").alias("boat"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), "o_orderdate")
    before, after = base.where("o_orderdate < '2000-12-01'").drop("o_orderdate"), base.where("o_orderdate >= '1998-05-01'").drop("o_orderdate")
    after = after.withColumn("status", F.when(F.col("id") % 7 == 0, "P").otherwise(F.col("status"))).withColumn("price", F.when(F.col("id") % 11 == 0, F.col("price") + F.col("id") % 13 - 4).otherwise(F.col("price")))
    return before, after


@query(f"""
WITH {_SNAPSHOTS}, j AS (SELECT b.id AS bi, a.id AS ai, b.status AS bs, a.status AS s, b.price AS bp, a.price AS p FROM before b FULL JOIN after a ON b.id = a.id)
SELECT CASE WHEN bi IS NULL THEN 'added' WHEN ai IS NULL THEN 'withdrawn' WHEN bs IS DISTINCT FROM s OR bp IS DISTINCT FROM p THEN 'changed' ELSE 'same' END AS bucket, count(*) AS n FROM j GROUP BY ALL
""")
def change_diff(t: Tables) -> DataFrame:
    """Snapshot diff in buckets. [SET02, CHG04]"""
    return changes.diff(*_snapshots(t), "id", ["status", "price"]).groupBy("bucket").agg(F.count("*").alias("n"))


@query(f"""
WITH {_SNAPSHOTS} SELECT boat, count(*) AS n, 'gone' AS how FROM before WHERE boat NOT IN (SELECT boat FROM after) GROUP BY boat HAVING count(*) >= 3
""")
def change_vanished(t: Tables) -> DataFrame:
    """Entities that lost all of three rows or more. [CHG01-CHG03]"""
    before, after = _snapshots(t)
    return changes.vanished(before.withColumn("seller", F.lit("a")), after, ["boat"]).select("boat", "n", "how")


@query(f"""
WITH {_SNAPSHOTS}, j AS (SELECT b.id, b.status AS bs, a.status AS s, b.price AS bp, a.price AS p FROM before b JOIN after a ON b.id = a.id)
SELECT id, CASE WHEN p - bp = 0 THEN NULL WHEN abs(p - bp) < 5 THEN 'rounding' WHEN p > bp THEN 'rose' ELSE 'fell' END AS move, CASE WHEN bs <> 'P' AND s = 'P' THEN 'entered' WHEN bs = 'P' AND s <> 'P' THEN 'left' END AS transition FROM j
""")
def change_moves(t: Tables) -> DataFrame:
    """Price moves and state transitions of rows on both sides. [CHG07, CHG08]"""
    d = changes.diff(*_snapshots(t), "id", ["status", "price"]).where("bucket IN ('changed', 'same')")
    eur = F.lit("EUR")
    return d.select("id", changes.price_move(F.col("was_price"), F.col("now_price"), eur, eur).alias("move"), changes.transition(F.col("was_status"), F.col("now_status"), "P").alias("transition"))


@query(f"""
WITH {_SNAPSHOTS}, b AS (SELECT boat, status AS code, CAST(count(*) AS VARCHAR) AS s FROM before GROUP BY ALL), a AS (SELECT boat, status AS code, CAST(count(*) AS VARCHAR) AS s FROM after GROUP BY ALL)
SELECT coalesce(b.boat, a.boat) AS boat, coalesce(b.code, a.code) AS code, b.s AS was, a.s AS now FROM b FULL JOIN a ON b.boat = a.boat AND b.code = a.code WHERE b.s IS DISTINCT FROM a.s AND coalesce(b.boat, a.boat) IN (SELECT boat FROM before)
""")
def change_fee_moves(t: Tables) -> DataFrame:
    """Moves of summaries per boat and code. [CHG09]"""
    sums = lambda df: df.groupBy("boat", F.col("status").alias("code")).agg(F.count("*").cast("string").alias("summary"))
    before, after = _snapshots(t)
    return changes.fee_moves(sums(before), sums(after))


@query(f"""
WITH {_SNAPSHOTS}, j AS (SELECT b.boat, CASE WHEN b.status = 'F' THEN NULL ELSE CAST(floor(b.price) AS BIGINT) % 5 END AS w, CASE WHEN a.status = 'P' THEN NULL ELSE CAST(floor(a.price) AS BIGINT) % 5 END AS n FROM before b JOIN after a ON b.id = a.id),
k AS (SELECT boat, n, CASE WHEN w IS NULL AND n IS NOT NULL THEN 'began' WHEN w IS NOT NULL AND n IS NULL THEN 'ended' WHEN w <> n THEN 'changed' END AS kind FROM j)
SELECT boat, kind, count(*) AS n, min(n) AS pct_min, max(n) AS pct_max FROM k WHERE kind IS NOT NULL GROUP BY ALL
""")
def change_discount_events(t: Tables) -> DataFrame:
    """Discounts that began, ended or changed, by boat. [SET05]"""
    pct = lambda df, s: df.select("id", "boat", F.when(F.col("status") != s, F.floor("price") % 5).alias("pct"))
    before, after = _snapshots(t)
    return changes.discount_events(pct(before, "F"), pct(after, "P"), ["id"], "boat")


@query(f"""
WITH {_SNAPSHOTS} SELECT status, price, 'gone' AS side FROM (SELECT status, price FROM before EXCEPT ALL SELECT status, price FROM after)
UNION ALL SELECT status, price, 'new' FROM (SELECT status, price FROM after EXCEPT ALL SELECT status, price FROM before)
""")
def change_drift(t: Tables) -> DataFrame:
    """Rows that one side has more often. [SET06, SET08, SNK10]"""
    before, after = _snapshots(t)
    return changes.drift(before.select("status", "price"), after.select("status", "price"))


# --- facets, sorts ---------------------------------------------------------------------------------------------------


@query("""
WITH d AS (SELECT c_mktsegment, c_nationkey, c_acctbal FROM customer)
SELECT 'c_mktsegment' AS facet, c_mktsegment AS value, count(*) AS n FROM d WHERE c_nationkey IN (1, 2, 3, 4, 5) AND c_acctbal BETWEEN 0 AND 5000 GROUP BY ALL
UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR), count(*) FROM d WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal BETWEEN 0 AND 5000 GROUP BY ALL
""")
def facet_counts(t: Tables) -> DataFrame:
    """Counts of each facet under the others' filters, in one pass. [FLT03, AGG12, AGG13]"""
    f = facets.Filters(any_of={"c_mktsegment": ["BUILDING", "MACHINERY"], "c_nationkey": [1, 2, 3, 4, 5]}, ranges={"c_acctbal": (0, 5000)}, hide_unstated=True)
    return facets.facet_counts(t.customer, f, ["c_mktsegment", "c_nationkey"])


@query("""
WITH s AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS flags, max(l_quantity) AS q FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, q FROM s WHERE list_contains(flags, 'A') AND list_contains(flags, 'R') AND (q <= 45 OR q IS NULL)
""")
def facet_all_of(t: Tables) -> DataFrame:
    """A facet that asks for all picked values, and a budget that unknowns pass. [FLT03]"""
    s = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"), F.max("l_quantity").alias("q"))
    return s.where(facets.passes(facets.Filters(all_of={"flags": ["A", "R"]}, budget={"q": 45.0}))).select("l_orderkey", "q")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN (SELECT min(o_orderdate) FROM orders) AND TIMESTAMP '1995-06-30'")
def facet_in_window(t: Tables) -> DataFrame:
    """A date window in order. [FLT01]"""
    return facets.in_window(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", F.lit("1900-01-01").cast("timestamp"), F.lit("1995-06-30").cast("timestamp"), "o_orderkey")


@query("SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END DESC NULLS LAST, c_custkey) AS r FROM customer) WHERE r BETWEEN 121 AND 140")
def sort_page(t: Tables) -> DataFrame:
    """The second page of a sort with unknowns last: a top-k, not a full sort to one place. [SRT01, SRT04]"""
    rows = t.customer.select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("b"))
    return facets.page(rows, [F.col("b").desc_nulls_last(), F.col("c_custkey").asc()], 1).select("c_custkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)")
def facet_used_only(t: Tables) -> DataFrame:
    """Dimension rows in use. [FLT13]"""
    return facets.used_only(t.nation.withColumnRenamed("n_nationkey", "k"), t.supplier.withColumnRenamed("s_nationkey", "k"), "k").select(F.col("k").alias("n_nationkey"), "n_name")


# --- state, gates ----------------------------------------------------------------------------------------------------


@query("""
WITH s AS (SELECT c_custkey AS key, DATE '2024-01-20' - CAST(c_custkey % 20 AS INTEGER) AS checked FROM customer WHERE c_acctbal < 6000),
v AS (SELECT c_custkey AS key FROM customer WHERE c_acctbal > 3000), l AS (SELECT DISTINCT o_custkey AS key FROM orders),
j AS (SELECT coalesce(s.key, v.key) AS key, checked, v.key IS NOT NULL AS visited FROM s FULL JOIN v ON s.key = v.key)
SELECT key, CASE WHEN visited THEN DATE '2024-01-20' ELSE checked END AS checked FROM j WHERE NOT (visited AND key IN (SELECT key FROM l)) AND (visited OR DATE '2024-01-20' - checked BETWEEN 0 AND 14)
""", dates=("checked",))
def state_skip_list(t: Tables) -> DataFrame:
    """A skip list after a day's visits: stamped, removed, expired. [INC02, INC03]"""
    today = F.lit("2024-01-20").cast("date")
    k = F.col("c_custkey")
    s = t.customer.where("c_acctbal < 6000").select(k.alias("key"), F.date_sub(today, (k % 20).cast("int")).alias("checked"))
    return state.update_skip_list(s, t.customer.where("c_acctbal > 3000").select(k.alias("key")), t.orders.select(F.col("o_custkey").alias("key")), today)


@query("""
WITH b AS (SELECT o_custkey AS key, CAST(o_orderdate AS DATE) AS day, o_totalprice AS price, o_orderkey AS id FROM orders)
SELECT key, max(day) AS day, arg_max(price, (day, id)) AS price FROM b GROUP BY key
""", dates=("day",))
def state_merge_latest(t: Tables) -> DataFrame:
    """Upsert that keeps the newest row of a key. [SET10, SNK11, INC07]"""
    b = t.orders.select(F.col("o_custkey").alias("key"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("price"), F.struct(F.to_date("o_orderdate").alias("d"), F.col("o_orderkey").alias("id")).alias("o"))
    return state.merge_latest(b.where("price < 200000"), b.where("price >= 200000"), ["key"], "o").drop("o")


@query("SELECT event_id, CAST(ts AS DATE) AS day FROM events WHERE CAST(ts AS DATE) > (SELECT max(CAST(ts AS DATE)) FROM events) - 7", dates=("day",))
def state_keep_days(t: Tables) -> DataFrame:
    """The last seven recorded days of a book. [SNK07, SNK08]"""
    return state.keep_days(t.events.select("event_id", F.to_date("ts").alias("day")), "day", 7)


@query("""
WITH s AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS wi FROM events)
SELECT event_id, event_type, was FROM s WHERE wi IS NOT NULL AND was IS DISTINCT FROM event_type
""")
def state_changes_over_time(t: Tables) -> DataFrame:
    """Changes between a key's consecutive snapshots. [INC09]"""
    rows = t.events.withColumn("o", F.struct("ts", "event_id"))
    return state.changes_over_time(rows, ["user_id"], "o", ["event_type"]).select("event_id", "event_type", F.col("was.event_type").alias("was"))


@query("""
SELECT 'unique lines' AS expectation, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS violations FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'unique orders', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey HAVING count(*) > 1)
UNION ALL SELECT 'orders.o_custkey in customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
""")
def quality_expectations(t: Tables) -> DataFrame:
    """Duplicate keys and lost references. [Q01, SNK09]"""
    return state.expectations({"lines": t.lineitem, "orders": t.orders, "customer": t.customer}, {"lines": ["l_orderkey", "l_linenumber"], "orders": ["o_orderkey"]}, [("orders", "o_custkey", "customer", "c_custkey")])


@query("""
WITH m AS (SELECT count(*) AS n, count_if(o_orderstatus = 'O') AS o FROM orders)
SELECT 'keeps enough rows' AS rule, o >= 0.6 * n OR n = 0 AS holds FROM m UNION ALL SELECT 'has rows', n > 0 FROM m
""")
def quality_gate(t: Tables) -> DataFrame:
    """Publication gates over a run's measures. [SNK09, SNK13-SNK16]"""
    m = t.orders.agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("o"))
    return state.gate(m, {"keeps enough rows": state.publishable(F.col("o"), F.col("n")), "has rows": F.col("n") > 0})


# --- text, extraction ------------------------------------------------------------------------------------------------


@query(r"""
SELECT doc_id, trim(regexp_replace(replace(translate(translate(lower(translate(text, '''’‘ʼ`´′', '')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), 'ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ', 'aaaaaaceeeeiiiinooooouuuuy'), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents
""")
def text_key(t: Tables) -> DataFrame:
    """Comparable key of every whole text, in generated code. [STR01]"""
    return t.documents.select("doc_id", text.latin_key(F.col("text")).alias("key"))


@query(r"SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def text_slug(t: Tables) -> DataFrame:
    """Slugs. [STR02]"""
    return t.part.select("p_partkey", text.slugify(F.col("p_name")).alias("slug"))


@query("""
WITH w(k, v) AS (VALUES ('the', 'THE'), ('and', 'AND'), ('une', 'UNE'), ('der', 'DER')),
d AS (SELECT doc_id, ' ' || trim(regexp_replace(replace(translate(translate(lower(translate(text, '''’‘ʼ`´′', '')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), 'ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ', 'aaaaaaceeeeiiiinooooouuuuy'), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM documents)
SELECT v, count(*) AS n FROM d JOIN w ON contains(t, ' ' || k || ' ') GROUP BY v
""")
def text_vocabulary(t: Tables) -> DataFrame:
    """Documents that hold each word of a vocabulary as a whole word. [STR12, JOI17]"""
    found = text.vocabulary_matches(F.col("text"), [("the", "THE"), ("and", "AND"), ("une", "UNE"), ("der", "DER")])
    return aggregates.tally(t.documents, found, "v")


@query(r"""
SELECT source, count(*) AS n, count_if(regexp_matches(text, '(?i)password|secret|token')) AS secret, count_if(NOT regexp_matches(text, '(?i)password|secret|token') AND regexp_matches(text, '@')) AS contact FROM documents GROUP BY source
""", longs=("secret", "contact"))
def text_first_rule(t: Tables) -> DataFrame:
    """First matching rule of an ordered list, by source. [STR16, STR27]"""
    rule = text.first_rule(F.col("text"), [("(?i)password|secret|token", "secret"), ("@", "contact")])
    return t.documents.select("source", rule.alias("r")).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("r") == "secret").alias("secret"), F.count_if(F.col("r") == "contact").alias("contact"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def extract_json(t: Tables) -> DataFrame:
    """A field of nested JSON."""
    return t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query(r"""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages) SELECT DISTINCT page_id, link FROM l WHERE link <> '/the'
""")
def extract_links(t: Tables) -> DataFrame:
    """Distinct links of each page. [EXT10, SET09]"""
    return t.pages.select("page_id", F.explode(extract.links(F.col("html"), 'href="([^"]*)"', ("/the",))).alias("link"))


@query(r"""
WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<(?:script\b.*?</script\s*|style\b.*?</style\s*)>', ' ', 'g') AS x FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(x, '(?i)</(p|div|li|tr|h[1-6]|td|th)\s*>|<br\s*/?>', ', ', 'g'), '(?s)<[^>]*>', '', 'g') AS x FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS x FROM b)
SELECT page_id, regexp_replace(regexp_replace(trim(regexp_replace(x, '\s+', ' ', 'g')), '(?:\s*,)+', ',', 'g'), '^[, ]+|[, ]+$', '', 'g') AS visible FROM c
""")
def extract_visible_text(t: Tables) -> DataFrame:
    """Visible text of each page. [EXT09]"""
    return t.pages.select("page_id", text.visible_text(F.col("html")).alias("visible"))


@query("SELECT url, substr(sha256(url), 1, 16) AS url_hash, sha256(html) AS digest, CAST(length(html) AS BIGINT) AS n_chars FROM pages")
def source_page_index(t: Tables) -> DataFrame:
    """Index of raw pages by hash. [SRC22]"""
    return readers.page_index(t.pages, "url", "html")


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS nth FROM events) SELECT CAST(ts AS DATE) AS day, event_id FROM r WHERE nth = 1
""", dates=("day",))
def source_last_of_day(t: Tables) -> DataFrame:
    """The last snapshot of each day. [SRC14-SRC16]"""
    rows = t.events.select("event_id", F.to_date("ts").alias("day"), F.struct("ts", "event_id").alias("o"))
    return readers.last_of_day(rows, "day", "o").select("day", "event_id")


@query("""
WITH e AS (SELECT min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders), d AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM e)
SELECT day FROM d WHERE dayofweek(day) = 6
""", dates=("day",))
def source_weekdays(t: Tables) -> DataFrame:
    """Saturdays of the season that the orders span. [SRC20, SRC21]"""
    ends = t.orders.agg(F.to_date(F.min("o_orderdate")).cast("string").alias("a"), F.to_date(F.max("o_orderdate")).cast("string").alias("b")).first()
    return readers.weekdays(t.spark, ends.a, ends.b)


# --- money -----------------------------------------------------------------------------------------------------------


@query("""
SELECT o_orderkey, round(CAST(o_totalprice AS DECIMAL(18,4)), 2)::DOUBLE AS cents, CAST(round_even(CAST(o_totalprice AS DOUBLE), 0) AS BIGINT) AS whole FROM orders
""")
def money_rounding(t: Tables) -> DataFrame:
    """Half up to cents, half to even to whole units. [NUM04, NUM08]"""
    return t.orders.select("o_orderkey", money.cents(F.col("o_totalprice").cast(money.MONEY)).cast("double").alias("cents"), money.whole(F.col("o_totalprice")).alias("whole"))


@query("""
WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(max(l_shipdate) AS DATE) AS b, any_value(o_totalprice) AS total FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT o_orderkey, CASE WHEN b - a BETWEEN 1 AND 30 THEN CAST(b - a AS INTEGER) END AS nights, CASE WHEN b - a BETWEEN 1 AND 30 THEN total / (b - a) END AS per_night FROM d
""")
def money_per_night(t: Tables) -> DataFrame:
    """Nights between plausible dates, and the total by night. [NUM10, NUM22]"""
    d = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey", F.to_date("o_orderdate").alias("a")).agg(F.to_date(F.max("l_shipdate")).alias("b"), F.any_value("o_totalprice").alias("total"))
    n = money.nights(F.col("a"), F.col("b"))
    return d.select("o_orderkey", n.alias("nights"), money.per_unit(F.col("total"), n).alias("per_night"))


# --- extensions ------------------------------------------------------------------------------------------------------


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def stream_windowed(t: Tables) -> DataFrame:
    """Hourly windows; the same plan as over a stream."""
    return streams.windowed(t.events)


from plumbline.plans import depth, details  # noqa: E402,F401  (they register their queries here)
