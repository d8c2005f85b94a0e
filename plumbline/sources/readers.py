"""Sources: nested JSON documents, optional books, rate sheets, snapshots by day, calendars; and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import money
from plumbline.operators import aggregates

MONEY_STRUCT = "struct<amount:string,currency:string>"
#: One dataset document: dimensions and facts nested under their names; amounts are read as text, never through doubles.
DATASET = (
    "operators array<struct<id:string,name:string,website:string>>, boats array<struct<id:string,name:string,operator_id:string,cabins:int,guests:int,length_m:double,year_built:int>>, "
    "itineraries array<struct<id:string,name:string,operator_id:string,boat_id:string,nights:int,dives:int,port_from:string,port_to:string,dive_sites:array<string>>>, "
    f"departures array<struct<id:string,itinerary_id:string,start:string,end:string,price:{MONEY_STRUCT},availability:string>>"
)


def dataset(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a dataset document (or a folder of them); a record that doesn't fit the schema is an error. [SRC01, SRC02]"""
    doc = spark.read.schema(DATASET).option("multiLine", True).option("mode", "FAILFAST").json(path)
    out = {name: doc.select(F.explode(name).alias("x")).select("x.*") for name in doc.columns}
    d = out["departures"]
    out["departures"] = d.select("id", "itinerary_id", F.to_date("start").alias("start"), F.to_date("end").alias("end"), F.col("price.amount").cast(money.MONEY).alias("price_amount"), F.coalesce("price.currency", F.lit("EUR")).alias("price_currency"), "availability")
    return out


def optional(spark: SparkSession, path: str | None, schema: str, file_format: str = "json") -> DataFrame:
    """A book that may be absent: no path or no file gives an empty table of the schema. [SRC03]"""
    empty = spark.createDataFrame([], schema)
    if path is None:
        return empty
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # the store's own file system, whatever its scheme
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return empty
    return spark.read.schema(schema).format(file_format).load(path)


def rates_from_xml(xml: DataFrame, column: str, required: str = "USD") -> DataFrame:
    """(as_of, currency, rate) of a reference-rate sheet, inverted to 6 places; a sheet without a date or the required currency is an error. [SRC13]"""
    day = F.try_to_date(F.regexp_extract(column, r"time=['\"]([0-9-]+)['\"]", 1))
    pairs = F.regexp_extract_all(column, F.lit(r"currency=['\"][A-Z]{3}['\"]\s+rate=['\"][0-9.]+['\"]"), F.lit(0))
    stop = F.raise_error(F.lit("rate sheet without a date or the required currency")).cast("boolean")
    rows = xml.select(day.alias("as_of"), pairs.alias("p")).where(F.when(F.col("as_of").isNotNull() & F.exists("p", lambda x: F.contains(x, F.lit(required))), F.lit(True)).otherwise(stop))
    one = rows.select("as_of", F.explode("p").alias("x"))
    quoted = F.regexp_extract("x", r"rate=['\"]([0-9.]+)['\"]", 1).cast("decimal(18,8)")
    return one.select("as_of", F.regexp_extract("x", r"currency=['\"]([A-Z]{3})['\"]", 1).alias("currency"), F.round(F.lit(1).cast("decimal(18,8)") / quoted, 6).cast(money.RATE).alias("rate"))


def last_of_day(snapshots: DataFrame, day: str, order: str) -> DataFrame:
    """The last snapshot taken on each day. [SRC14, SRC15, SRC16]"""
    return aggregates.kept(snapshots, [day], [order], last=True)


def calendar(spark: SparkSession, start: str, end: str, days: int = 7) -> DataFrame:
    """Every so many days from start to end. [SRC20, SRC21]"""
    return spark.range(1).select(F.explode(F.expr(f"sequence(date'{start}', date'{end}', interval {days} days)")).alias("day"))


def weekdays(spark: SparkSession, start: str, end: str, name: str = "Sat") -> DataFrame:
    """The days of one name within a window. [SRC21]"""
    first = F.next_day(F.date_sub(F.lit(start).cast("date"), 1), name)
    days = F.when(first <= F.lit(end).cast("date"), F.sequence(first, F.lit(end).cast("date"), F.expr("interval 7 days")))
    return spark.range(1).select(F.explode(days).alias("day"))


def to_visit(listings: DataFrame, known: DataFrame, months: Column, skips: DataFrame, cap: int) -> DataFrame:
    """(key, month) pages to read: listed and known keys less the skip list, one row per month of the season, capped per run by name. [SRC07, SRC08, SRC09]"""
    keys = listings.select("key").unionByName(known.select("key")).distinct().join(skips.select("key"), "key", "left_anti")
    return keys.select("key", F.explode(months).alias("month")).orderBy("key", "month").limit(cap)


def schedule_walk(pages: DataFrame, last_day: str) -> tuple[DataFrame, DataFrame]:
    """Of the numbered pages of each key, read in turn: (key, page, entry) of the fresh ids up to where the walk stops, and (key, state). [SRC10]

    pages has key, page (from 1), entries (array of structs with id and start; null if unread) and total (or null). The
    walk stops at a page without a fresh id, when the total is reached, or when the last start is past the last day. A key
    with an unread or missing page before that is "unread" and has no entries; one that never stops is "unfinished".
    """
    each = pages.select("key", "page", F.explode("entries").alias("entry"))
    first = each.groupBy("key", F.col("entry.id").alias("id")).agg(F.min_by("entry", "page").alias("entry"), F.min("page").alias("page"))
    fresh = first.groupBy("key", "page").agg(F.count("*").alias("fresh"))
    last = F.array_max(F.transform("entries", lambda e: e["start"].cast("date")))
    w = Window.partitionBy("key").orderBy("page")
    told = pages.select("key", "page", "total", last.alias("last"), F.col("entries").isNull().alias("unread")).join(fresh, ["key", "page"], "left").withColumn("fresh", F.coalesce("fresh", F.lit(0)))
    told = told.withColumn("gap", F.col("unread") | (F.row_number().over(w) != F.col("page")))
    stop = ~F.col("gap") & ((F.col("fresh") == 0) | F.coalesce(F.sum("fresh").over(w) >= F.col("total"), F.lit(False)) | F.coalesce(F.col("last") > F.lit(last_day).cast("date"), F.lit(False)))
    ends = told.withColumn("stop", stop).groupBy("key").agg(F.min(F.when(F.col("stop"), F.col("page"))).alias("end"), F.min(F.when(F.col("gap"), F.col("page"))).alias("gap"))
    ends = ends.select("key", "end", F.when(F.col("gap") < F.coalesce("end", F.lit(2**31 - 1)), "unread").when(F.col("end").isNull(), "unfinished").otherwise("read").alias("state"))
    found = first.join(ends.where("state <> 'unread'"), "key").where("end IS NULL OR page <= end").select("key", "page", "entry")
    return found, ends.select("key", "state")


def query_urls(base: str, parameters: Sequence[tuple[str, Column]]) -> Column:
    """An address with its query: names and values encoded, an array as its name repeated, null and empty values left out. [SRC12]"""
    encoded = lambda name, c: F.concat(F.lit(f"{name}="), F.url_encode(c.cast("string")))

    def repeated(name: str, c: Column) -> Column:
        values = F.array_compact(F.coalesce(c.cast("array<string>"), F.array().cast("array<string>")))
        return F.transform(F.filter(values, lambda x: x != ""), lambda x: encoded(name, x))

    query = F.array_join(F.concat(*[repeated(name, c) for name, c in parameters]), "&")
    return F.concat(F.lit(base), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def pages_read(pages: DataFrame, run: str, identity: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(distinct records of a paged reading, one row per run: pages, records, whether it was cut short). [SRC11]"""
    meta = pages.groupBy(run).agg(F.max("page").alias("pages"), F.count_distinct(*identity).alias("records"), F.max("total").alias("total"))
    return pages.dropDuplicates([run, *identity]), meta.withColumn("truncated", F.col("records") < F.col("total"))


def page_index(pages: DataFrame, url: str, body: str) -> DataFrame:
    """Index of raw snapshots: url, its hash, the body's digest and size. [SRC22]"""
    return pages.select(F.col(url).alias("url"), F.substring(F.sha2(F.col(url), 256), 1, 16).alias("url_hash"), F.sha2(F.col(body), 256).alias("digest"), F.length(body).cast("long").alias("n_chars"))


# --- sinks -----------------------------------------------------------------------------------------------------------


def export_csv(df: DataFrame, path: str, order: Sequence[str], money_columns: Sequence[str] = ()) -> None:
    """Sorted CSV with a header; unknown is blank, never 0; money has two places. [SNK01]"""
    cols = [F.when(F.col(c).isNotNull(), F.format_string("%.2f", F.col(c).cast("double"))).alias(c) if c in money_columns else F.col(c) for c in df.columns]
    df.orderBy(*order).select(*cols).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def payload(df: DataFrame) -> DataFrame:
    """One JSON object per row, nulls left out. [SNK02, SNK04]"""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"}).alias("json"))
