"""Discounts and places left: list prices, cuts, stale ladders, berth blocks, censuses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import money


def list_prices(readings: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """(sailing, seller, price, was): list prices of sellers that were read, was only if above the price; rejected readings are left out. [SAL01]"""
    kept = readings if rejected is None else readings.join(rejected.select("sailing", "seller").distinct(), ["sailing", "seller"], "left_anti")
    least = kept.where(F.col("price").isNotNull()).groupBy("sailing", "seller").agg(F.min_by(F.struct("price", "was"), F.struct("price", F.coalesce("was", F.lit(0)))).alias("r"))
    return least.select("sailing", "seller", F.col("r.price").alias("price"), F.when(F.col("r.was") > F.col("r.price"), F.col("r.was")).alias("was"))


def sale(prices: DataFrame, rows: DataFrame) -> DataFrame:
    """Per sailing the sellers with a list price; percent and was only of the seller whose fare the row prints, a cut of 0 left out. [SAL02]"""
    own = F.col("seller") == F.col("own")
    joined = prices.where("was IS NOT NULL").join(rows.select("sailing", F.col("seller").alias("own")), "sailing")
    return joined.groupBy("sailing").agg(F.array_sort(F.collect_set("seller")).alias("sellers"), F.max(F.when(own, money.cut_pct(F.col("price"), F.col("was")))).alias("pct"), F.max(F.when(own & money.cut_pct(F.col("price"), F.col("was")).isNotNull(), F.col("was"))).alias("was"))


def stale_ladders(rungs: DataFrame, references: DataFrame, tolerance: float = 0.03) -> DataFrame:
    """(sailing, seller) whose cheapest rung lies more than the tolerance off its reference: its own fare, else the row's price. [SAL03]"""
    least = rungs.groupBy("sailing", "seller").agg(F.min("price").alias("least"))
    joined = least.join(references, ["sailing", "seller"]).withColumn("reference", F.coalesce("own_price", "row_price"))
    return joined.where(F.abs(F.col("least") - F.col("reference")) / F.col("reference") > tolerance).select("sailing", "seller", "least", "reference")


def berth_blocks(rooms: DataFrame) -> DataFrame:
    """Per sailing and seller: least price, places at it and aboard (each null if any room's count is), and the ladder. [SAL04, SAL05, SAL06]"""
    # Windows over one sort: an aggregate after it would hold every group of a task in memory beside the sorted rows.
    block = Window.partitionBy("sailing", "seller")
    rows = rooms.withColumn("least", F.min("price").over(block))
    rung = F.struct(F.col("name"), money.whole(F.col("price")).alias("price"), F.col("places"))
    cheap = F.col("price") == F.col("least")
    at = F.when(F.count_if(cheap & F.col("places").isNull()).over(block) == 0, F.sum(F.when(cheap, F.col("places"))).over(block))
    aboard = F.when(F.count_if(F.col("places").isNull()).over(block) == 0, F.sum("places").over(block))
    ladder = F.array_sort(F.collect_list(rung).over(block), lambda a, b: F.when(a["price"] < b["price"], -1).when(a["price"] > b["price"], 1).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))
    nth = F.row_number().over(block.orderBy("price"))
    return rows.select("sailing", "seller", "least", at.alias("at_price"), aboard.alias("aboard"), ladder.alias("ladder"), nth.alias("_nth")).where("_nth = 1").drop("_nth")


def specials(offers: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(offers with their entity and a price below was, number of unmatched offers). [SAL07, EXT50]"""
    good = offers.where(F.col("price") < F.col("was"))
    joined = good.join(aliases, "slug", "left")
    return joined.where("target IS NOT NULL").withColumn("pct", money.cut_pct(F.col("price"), F.col("was"))), joined.where("target IS NULL").agg(F.count("*").alias("unmatched"))


def offers_displayed(offers: DataFrame, rates: DataFrame, display: str = "EUR") -> DataFrame:
    """Offers with price and was in whole display units. [SAL08, SAL13]"""
    out = offers
    for column in ("price", "was"):
        out = money.converted(out, rates, column, "currency", f"_{column}", display).withColumn(f"{column}_display", money.whole(F.col(f"_{column}"))).drop(f"_{column}")
    return out.withColumn("saving", F.when(F.col("was_display") > F.col("price_display"), F.col("was_display") - F.col("price_display")))


def census(ladders: DataFrame, day: Column) -> DataFrame:
    """Per sailing read on the day: price, was and currency of its cheapest priced rung. [SAL09, SNK11]"""
    rows = ladders.where((F.col("read_day") == day) & F.col("price").isNotNull())
    return rows.groupBy("sailing").agg(F.min_by(F.struct("price", "was", "currency"), F.struct("price", "name")).alias("r")).select("sailing", "r.*")


def first_stating(values: Sequence[tuple[str, Column]]) -> Column:
    """struct(seller, value) of the first seller in order that states a value. [SAL10, SAL11]"""
    return F.coalesce(*[F.when(v.isNotNull(), F.struct(F.lit(name).alias("seller"), v.alias("value"))) for name, v in values])


def cheapest_on_sale(ladder: Column) -> Column:
    """Least price of the rungs with places left. [SAL12]"""
    return F.array_min(F.transform(F.filter(ladder, lambda r: r["places"] != 0), lambda r: r["price"]))
