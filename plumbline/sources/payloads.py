"""A seller's payload of charges: arrays of entries whose place says who pays, as fee lines and a verdict on the bill."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import money, text

ENTRY = "struct<id:string,title:string,price:string,extraValue:string,payedPer:string,validFrom:string,validTo:string,contents:string>"
MANDATORY, OPTIONAL, INCLUDED = "mandatory", "optional", "included"


def entries(payloads: DataFrame, id_col: str, column: str, arrays: Sequence[tuple[str, str]], first_day: str, last_day: str) -> DataFrame:
    """(id, origin, array, place, entry): the entries of all arrays of the payloads in order, those dated out of the season left out.

    arrays is (name of the array, origin). An entry without dates is always in season.
    """
    schema = "struct<" + ",".join(f"{name}:array<{ENTRY}>" for name, _ in arrays) + ">"
    parsed = payloads.select(id_col, F.from_json(column, schema).alias("p"))

    def tagged(n: int, name: str, origin: str) -> Column:
        items = F.coalesce(F.col("p")[name], F.array().cast(f"array<{ENTRY}>"))
        return F.transform(items, lambda e, i: F.struct(F.lit(origin).alias("origin"), F.lit(n).alias("array"), i.alias("place"), e.alias("entry")))

    rows = parsed.select(id_col, F.explode(F.concat(*[tagged(n, *a) for n, a in enumerate(arrays)])).alias("t")).select(id_col, "t.*").where("entry IS NOT NULL")
    begins, ends = text.iso_day(F.col("entry.validFrom")), text.iso_day(F.col("entry.validTo"))
    return rows.where(F.coalesce(begins, F.lit("0001-01-01").cast("date")) <= F.lit(last_day).cast("date")).where(F.coalesce(ends, F.lit("9999-12-31").cast("date")) >= F.lit(first_day).cast("date"))


def fee_lines(found: DataFrame, id_col: str, rules: Sequence[tuple[str, str]], units: Mapping[str, str], on_purchases: str, not_owed: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(lines, bills) of ``entries``. [EXT29, EXT30, EXT31]

    lines has id, code, tier, basis, amount, included, note. A mandatory entry gives a line each, of tier optional if its code is in
    ``not_owed``. An optional entry gives one if its code and unit are known, the first of a code that no line has yet. An included
    one gives a line without an amount, the first of its code: it is left out where a mandatory or a priced line has the code,
    and takes the place of an unpriced optional one. Titles of optional and included entries are read without what stands in
    brackets. The amount is the price, or else the other value; 0 or less is none.

    bills has id, complete, unreadable, on_purchases: complete if every mandatory entry names a known charge in a known unit
    and every owed line is priced. Entries about purchases on board (pattern ``on_purchases``) are told and belong to no bill. Every id
    that has an entry has a bill.
    """
    judged, line, verdict = _judged(found, id_col, rules, units, on_purchases, not_owed)
    return judged.where("stays").select(id_col, *line), judged.groupBy(id_col).agg(*verdict)


def bills_with_lines(found: DataFrame, id_col: str, rules: Sequence[tuple[str, str]], units: Mapping[str, str], on_purchases: str, not_owed: Sequence[str] = ()) -> DataFrame:
    """The bills of ``fee_lines`` with their lines as a sorted list ``lines``, in one pass: the payloads are read once and not for lines and bills each. [BIL16]"""
    judged, line, verdict = _judged(found, id_col, rules, units, on_purchases, not_owed)
    return judged.groupBy(id_col).agg(F.array_sort(F.collect_list(F.when(F.col("stays"), F.struct(*line)))).alias("lines"), *verdict)


def _judged(found: DataFrame, id_col: str, rules: Sequence[tuple[str, str]], units: Mapping[str, str], on_purchases: str, not_owed: Sequence[str]) -> tuple[DataFrame, list[Column], list[Column]]:
    """Every entry with ``stays``, whether it gives a line; the columns of a line, and the aggregates of a bill over its entries."""
    e = F.col("entry")
    unit = F.try_element_at(F.create_map(*[F.lit(v) for pair in units.items() for v in pair]), e["payedPer"])
    amount = F.coalesce(*[F.when(v.try_cast(money.MONEY) > 0, v.try_cast(money.MONEY)) for v in (e["price"], e["extraValue"])])
    # A column each for what is read again and again, and no condition on it before the windows: it would be written out once more
    # for each use, and the JVM never compiles a method that long.
    read = found.withColumn("title", text.collapsed(F.coalesce(e["title"], F.lit(""))))
    read = read.withColumn("_wording", F.when(F.col("origin") == MANDATORY, F.col("title")).otherwise(text.collapsed(F.regexp_replace("title", r"\([^()]*\)", ""))))
    read = read.select(
        id_col, "origin", "array", "place", "title", text.first_rule(F.col("_wording"), rules).alias("code"), unit.alias("unit"), amount.alias("amount"),
        F.when((F.col("origin") == MANDATORY) & F.rlike("title", F.lit(on_purchases)), True).otherwise(False).alias("purchases"), F.nullif(text.collapsed(e["contents"]), F.lit("")).alias("contents"), e["id"].alias("entry_id"),
    )
    owed = (F.col("origin") == MANDATORY) & ~F.col("purchases")
    known = F.col("code").isNotNull() & (F.col("unit").isNotNull() | (F.col("origin") == INCLUDED))
    judged = read.withColumn("lost", owed & ~known).withColumn("unpriced", owed & known & ~F.col("code").isin(*not_owed) & F.col("amount").isNull()).withColumn("code", F.when(known & ~F.col("purchases"), F.col("code")))
    # Which lines a code has, and which of them are priced, is told by windows over one bill's entries of one code.
    code = Window.partitionBy(id_col, "code")
    nth = F.row_number().over(Window.partitionBy(id_col, "code", "origin").orderBy("array", "place"))
    judged = judged.withColumn("nth", nth).withColumn("owed_lines", F.count_if(F.col("origin") == MANDATORY).over(code)).withColumn("included_lines", F.count_if(F.col("origin") == INCLUDED).over(code))
    first_priced = F.bool_or((F.col("origin") == OPTIONAL) & (F.col("nth") == 1) & F.col("amount").isNotNull()).over(code)
    judged = judged.withColumn("priced_option", F.coalesce(first_priced, F.lit(False)))
    stays = (
        F.when(F.col("code").isNull(), False).when(F.col("origin") == MANDATORY, True).when((F.col("owed_lines") > 0) | (F.col("nth") > 1), False)
        .when(F.col("origin") == OPTIONAL, F.col("amount").isNotNull() | (F.col("included_lines") == 0)).otherwise(~F.col("priced_option"))
    )
    included = F.col("origin") == INCLUDED
    line = [
        F.col("code"), F.when((F.col("origin") == MANDATORY) & ~F.col("code").isin(*not_owed), "mandatory").otherwise("optional").alias("tier"), F.when(included, "per_trip").otherwise(F.col("unit")).alias("basis"),
        F.when(~included, F.col("amount")).alias("amount"), included.alias("included"), F.when(F.col("contents").isNotNull() & (F.col("origin") == OPTIONAL), F.concat("title", F.lit(": "), "contents")).otherwise(F.col("title")).alias("note"),
    ]
    unnamed = F.when(F.col("title") == "", F.concat(F.lit("<untitled "), F.coalesce("entry_id", F.lit("")), F.lit(">"))).otherwise(F.col("title"))
    verdict = [
        (F.count_if(F.col("lost") | F.col("unpriced")) == 0).alias("complete"), F.array_sort(F.collect_set(F.when(F.col("lost"), unnamed))).alias("unreadable"),
        F.array_sort(F.collect_set(F.when(F.col("purchases"), F.col("title")))).alias("on_purchases"),
    ]
    return judged.withColumn("stays", stays), line, verdict


def records(read: DataFrame, lines: DataFrame, bills: DataFrame, id_col: str) -> DataFrame:
    """(id, lines, complete) of every id that was read: an id without lines has an empty list, and is complete if its bill is or it has none. [BIL16, BIL17]

    An id that wasn't read has no row: that says nothing, where an empty list says that there is nothing to pay.
    """
    columns = [c for c in lines.columns if c != id_col]
    listed = lines.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("lines"))
    return listed_records(read, bills.select(id_col, "complete").join(listed, id_col, "full"), id_col)


def listed_records(read: DataFrame, bills: DataFrame, id_col: str) -> DataFrame:
    """The same of ``bills_with_lines``. [BIL16, BIL17]"""
    out = read.select(id_col).distinct().join(bills.select(id_col, "complete", "lines"), id_col, "left")
    return out.select(id_col, F.coalesce("lines", F.array().cast(bills.schema["lines"].dataType)).alias("lines"), F.coalesce("complete", F.lit(True)).alias("complete"))


def attached_panels(sold: DataFrame, panels: DataFrame, boat: str, trip: str, shape: str) -> DataFrame:
    """The panels of each page, with what becomes of them: attached, repeated, conflicting or unsold. [EXT48]

    sold has the trips that each boat sells, panels one row per panel with its ``shape``, whatever tells two apart. A panel of
    a trip that isn't sold is unsold. Of panels of one trip that differ none is taken; of equal ones the first stays, by ``place``.
    """
    trips = sold.select(boat, trip).distinct().withColumn("_sold", F.lit(True))
    same = panels.groupBy(boat, trip).agg(F.min(shape).alias("_least"), F.max(shape).alias("_most"), F.min("place").alias("_first"))
    fate = F.when(F.col("_sold").isNull(), "unsold").when(~F.col("_least").eqNullSafe(F.col("_most")), "conflicting").when(F.col("place") > F.col("_first"), "repeated").otherwise("attached")
    return panels.join(same, [boat, trip]).join(trips, [boat, trip], "left").withColumn("fate", fate).drop("_least", "_most", "_first", "_sold")
