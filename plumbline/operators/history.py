"""The history of things over many snapshots, where a thing not seen may just not have been read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def readings(snapshots: DataFrame, coverage: DataFrame, page: str, day: str) -> DataFrame:
    """(page, day, nth, next_day): the days on which each page was read, numbered; a page with rows on a day was read then."""
    read = coverage.select(page, day).unionByName(snapshots.select(page, day)).distinct()
    w = Window.partitionBy(page).orderBy(day)
    return read.withColumn("nth", F.row_number().over(w)).withColumn("next_day", F.lead(day).over(w))


def events(snapshots: DataFrame, coverage: DataFrame, key: str, page: str, day: str, fields: Sequence[str]) -> DataFrame:
    """(key, page, day, event, was, now): added, withdrawn, returned and changed over all snapshots. [INC09, INC10, CHG04]

    snapshots has a row per key and day on which it was seen, coverage a row per page and day on which the page was read.
    A thing is withdrawn on the first day after its last sight on which its page was read without it, and then returned
    when it is seen again; days on which its page wasn't read tell nothing. ``changed`` compares two sights with no withdrawal
    between them. Only sights and read days are held, no grid of all keys and days; a key's sights are read in order of
    their days.
    """
    read = readings(snapshots, coverage, page, day)
    seen = snapshots.select(key, page, day, F.struct(*fields).alias("now")).join(read, [page, day])
    w = Window.partitionBy(key, page).orderBy(day)
    seen = seen.withColumn("last", F.lag(F.struct("now", "nth")).over(w)).withColumn("following", F.lead("nth").over(w))
    gone = F.col("next_day").isNotNull() & (F.coalesce("following", F.lit(2**31 - 1)) > F.col("nth") + 1)
    none = F.lit(None).cast(seen.schema["now"].dataType)
    event = lambda day, name, was, now: F.struct(day.alias("day"), F.lit(name).alias("event"), was.alias("was"), now.alias("now"))
    now, last = F.col("now"), F.col("last")
    here = F.when(last.isNull(), event(F.col(day), "added", none, now)).when(last["nth"] < F.col("nth") - 1, event(F.col(day), "returned", last["now"], now)).when(~last["now"].eqNullSafe(now), event(F.col(day), "changed", last["now"], now))
    told = F.array_compact(F.array(here, F.when(gone, event(F.col("next_day"), "withdrawn", now, none))))
    out = seen.select(key, page, F.explode(told).alias("e"))
    return out.select(key, page, F.col("e.day").alias(day), "e.event", "e.was", "e.now")


def states(snapshots: DataFrame, coverage: DataFrame, key: str, page: str, day: str, today: str) -> DataFrame:
    """(key, page, last_seen, state) as of a day: seen, absent, or unread where the page wasn't read since the last sight. [INC10]"""
    upto = F.lit(today).cast("date")
    last = snapshots.where(F.col(day) <= upto).groupBy(key, page).agg(F.max(day).alias("last_seen"))
    read = coverage.where(F.col(day) <= upto).groupBy(page).agg(F.max(day).alias("_read"))
    state = F.when(F.coalesce("_read", "last_seen") > F.col("last_seen"), "absent").when(F.col("last_seen") < upto, "unread").otherwise("seen")
    return last.join(read, page, "left").select(key, page, "last_seen", state.alias("state"))
