"""Points in intervals by bins, without a hot task where one key or one stretch holds many points or intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import slices
from plumbline.operators.joins import FREQUENT, looked_up, measure

#: Widths of bins are powers of 2**STEP; intervals go to the narrowest width that is no less than their length.
STEP, LEAST, MOST = 2, -20, 1022


def _bin(x: Column, level: Column) -> Column:
    return F.floor(x / F.pow(F.lit(2.0), level.cast("double"))).cast("long")


def _first_by_pairs(points: DataFrame, runs: DataFrame, id_col: str, keys: Sequence[str], point: str, low: str, high: str, order: Sequence[str], extra: Column | None = None) -> DataFrame:
    """As ``first_interval``, every point beside every interval of its bin: for what no running least can tell.

    An interval goes to a level by its length and to the one or two bins there that it touches; a point
    goes to its one bin at each level in use. So candidates meet by (keys, level, bin), and a key that holds most of all points
    is spread over its bins. A bin that alone holds more than one in FREQUENT points is dealt over as many parts as that takes, its
    intervals copied to each. The best interval of each point is a partial aggregate, so many matches cost no shuffle of rows.
    """
    keys = list(keys)
    rest = [c for c in runs.columns if c not in keys]
    a, b = measure(runs, low), measure(runs, high)
    length = F.greatest(b - a, F.lit(2.0**LEAST))
    level = F.least(F.greatest((F.ceil(F.ceil(F.log2(length)) / STEP) * STEP).cast("int"), F.lit(LEAST)), F.lit(MOST))
    placed = runs.where(F.col(low) <= F.col(high)).withColumns({"_a": a, "_b": b}).withColumn("_level", F.when(F.col("_b") - F.col("_a") < float("inf"), level).otherwise(F.lit(MOST)))
    ends = F.array_distinct(F.array(_bin(F.col("_a"), F.col("_level")), _bin(F.col("_b"), F.col("_level"))))
    # At the widest level everything finite and infinite is in the bins -1 and 0.
    ends = F.when(F.col("_level") == MOST, F.array(F.lit(-1), F.lit(0)).cast("array<long>")).otherwise(ends)
    # The width is no less than the length, give or take a rounding, so the bins between the two ends are none or one.
    binned = placed.withColumn("_bin", F.explode(F.sequence(F.array_min(ends), F.array_max(ends))))
    levels = [r[0] for r in placed.select("_level").distinct().collect()]  # some dozens of numbers
    if not levels:
        return points.select("*", *[F.lit(None).cast(runs.schema[c].dataType).alias(c) for c in rest])
    x = measure(points, point)
    asked = points.where(F.col(point).isNotNull()).select(id_col, *keys, F.col(point).alias("_point"), x.alias("_x"), F.explode(F.array(*[F.lit(v) for v in levels])).alias("_level"))
    wide = F.when(F.col("_x") < 0, -1).otherwise(0).cast("long")
    asked = asked.withColumn("_bin", F.when(F.col("_level") == MOST, wide).otherwise(_bin(F.col("_x"), F.col("_level"))))
    cell = [*keys, "_level", "_bin"]
    counts = asked.groupBy(*cell).agg(F.count("*").alias("_n"))
    total = points.agg(F.count("*").alias("_total"))
    # At most FREQUENT bins of each level, some dozens of levels: small by construction.
    full = counts.crossJoin(F.broadcast(total)).where(F.col("_n") * FREQUENT > F.col("_total")).select(*cell, F.ceil(F.col("_n") * FREQUENT / F.col("_total")).cast("int").alias("_parts"))
    asked = asked.join(F.broadcast(full), cell, "left").withColumn("_part", F.pmod(F.xxhash64(id_col), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    held = binned.join(F.broadcast(full), cell, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts", "_a", "_b")
    met = asked.drop("_x").join(held, [*cell, "_part"]).where(F.col("_point").between(F.col(low), F.col(high)))
    if extra is not None:
        met = met.where(extra)
    ranks = F.struct(*[e for c in order for e in (F.col(c).isNull().alias(f"null_{c}"), F.col(c))])
    best = met.groupBy(id_col).agg(F.min_by(F.struct(*rest), ranks).alias("_best"))
    return points.join(best, id_col, "left").select(*points.columns, *[F.col("_best")[c].alias(c) for c in rest])


def first_interval(points: DataFrame, runs: DataFrame, id_col: str, keys: Sequence[str], point: str, low: str, high: str, order: Sequence[str], extra: Column | None = None) -> DataFrame:
    """Each point with the first interval of its keys, by ``order``, whose [low, high] holds it; nulls where none does. [JOI15]

    ``id_col`` is unique among the points; the columns of runs other than the keys must have names of their own, and ``order``
    names some of them. An interval goes to the level whose bins are the widest (a power of 2**STEP) that it can't lie in whole,
    so it begins in one bin, ends in a later one, and fills the few between. A point goes to its one bin at each level in use. In
    a bin the first of the intervals begun by a place is a running least, and so, backwards, is that of those not yet ended: points
    and intervals are sorted together and no pair of them is made, however many intervals hold a point. Equal places of
    a bin are one row; a bin of more than one in FREQUENT rows is read in slices. Intervals of no length meet the points by equality.

    Where ``extra`` tests pairs of a point and an interval, or an interval's ends are infinite or too near to be told apart as
    doubles, pairs are made after all.
    """
    if extra is not None:
        return _first_by_pairs(points, runs, id_col, keys, point, low, high, order, extra)
    keys = list(keys)
    rest = [c for c in runs.columns if c not in keys]
    known = lambda names: " AND ".join(f"`{c}` IS NOT NULL" for c in names)
    ranks = F.struct(*[e for c in order for e in (F.col(c).isNull().alias(f"null_{c}"), F.col(c))])
    first = lambda c: F.min_by(c, F.col(c)["rank"])
    a, b = measure(runs, low), measure(runs, high)
    placed = runs.where(F.col(low) <= F.col(high)).where(known([*keys, low])).withColumns({"_a": a, "_b": b})
    length = F.col("_b") - F.col("_a")
    finite = (F.abs("_a") < 2.0**MOST) & (F.abs("_b") < 2.0**MOST) & (length >= 2.0**LEAST)
    level = F.when(finite, (F.floor(F.log2(length) / STEP) * STEP).cast("int"))
    placed = placed.withColumn("_level", level)
    # A rounding can make a level too wide by one; the next is narrow enough, unless the ends are too near for doubles.
    fits = lambda c: (_bin(F.col("_a"), c) < _bin(F.col("_b"), c)) & (F.abs(_bin(F.col("_a"), c)) < 2**52) & (F.abs(_bin(F.col("_b"), c)) < 2**52)
    placed = placed.withColumn("_level", F.when(fits(F.col("_level")), F.col("_level")).when(fits(F.col("_level") - STEP), F.col("_level") - STEP))
    kinds = [tuple(r) for r in placed.select("_level", (F.col(low) == F.col(high)).alias("instant")).distinct().collect()]  # some dozens
    levels = sorted({n for n, _ in kinds if n is not None})
    best = F.struct(ranks.alias("rank"), F.struct(*rest).alias("row")).alias("_best")
    found = placed.where(F.col(low) == F.col(high)).groupBy(*keys, F.col(low).alias("_at")).agg(F.min_by(best, ranks).alias("_best"))
    cell = [*keys, "_level", "_bin"]
    asked = points.where(known([*keys, point]))
    if levels:
        from_bin, to_bin = _bin(F.col("_a"), F.col("_level")), _bin(F.col("_b"), F.col("_level"))
        pieces = placed.where("_level IS NOT NULL").select(*keys, "_level", F.col(low).alias("_lo"), F.col(high).alias("_hi"), best, from_bin.alias("_first"), to_bin.alias("_last"), F.explode(F.sequence(from_bin, to_bin)).alias("_bin"))
        ends = F.col("_bin") == F.col("_last")
        # From _at on, or all of the bin if that is null, and up to _at.
        pieces = pieces.select(
            *cell, F.when(F.col("_bin") == F.col("_first"), F.col("_lo")).when(ends, F.col("_hi")).alias("_at"), F.when(~ends, F.col("_best")).alias("_since"), F.when(ends, F.col("_best")).alias("_until"), F.lit(False).alias("_asked"),
        )
        kind = pieces.schema["_since"].dataType
        x = measure(points, point)
        places = asked.select(*keys, F.col(point).alias("_at"), F.explode(F.array(*[F.lit(v) for v in levels])).alias("_level"), x.alias("_x"))
        places = places.select(*cell[:-1], _bin(F.col("_x"), F.col("_level")).alias("_bin"), "_at", F.lit(None).cast(kind).alias("_since"), F.lit(None).cast(kind).alias("_until"), F.lit(True).alias("_asked"))
        line = pieces.unionByName(places).groupBy(*cell, "_at").agg(first("_since").alias("_since"), first("_until").alias("_until"), F.max("_asked").alias("_asked"))
        line = slices.sliced(line, cell, "_at")
        states = line.groupBy(*cell, "_slice").agg(first("_since").alias("_since"), first("_until").alias("_until"))
        over = lambda c, way: first(c).over(Window.partitionBy(*cell).orderBy(way).rowsBetween(Window.unboundedPreceding, -1))
        carried = states.select(*cell, "_slice", over("_since", F.asc("_slice")).alias("_before"), over("_until", F.desc("_slice")).alias("_after")).where("_before IS NOT NULL OR _after IS NOT NULL")
        running = lambda c, way: first(c).over(Window.partitionBy(*cell, "_slice").orderBy(way).rowsBetween(Window.unboundedPreceding, 0))
        line = line.withColumn("_since", running("_since", F.asc_nulls_first("_at"))).withColumn("_until", running("_until", F.desc_nulls_last("_at"))).where("_asked")
        # Slices beyond the first are of few bins by construction.
        line = line.join(F.broadcast(carried), [*cell, "_slice"], "left")
        met = line.select(*keys, "_at", F.explode(F.array_compact(F.array("_since", "_until", "_before", "_after"))).alias("_best"))
        found = found.unionByName(met)
    found = found.groupBy(*keys, "_at").agg(first("_best").alias("_best")).withColumnRenamed("_at", point)
    out = looked_up(points, found, [*keys, point], "left")
    odd = (None, False) in kinds
    if odd:  # what is left is met by pairs, and the better of the two stays
        left = placed.where(F.col("_level").isNull() & (F.col(low) < F.col(high))).select(runs.columns)
        pairs = _first_by_pairs(points, left, id_col, keys, point, low, high, order).where(F.col(low).isNotNull()).select(id_col, best.alias("_other"))
        out = out.join(pairs, id_col, "left")
        other = F.col("_other").isNotNull() & (F.col("_best").isNull() | (F.col("_other")["rank"] < F.col("_best")["rank"]))
        out = out.withColumn("_best", F.when(other, F.col("_other")).otherwise(F.col("_best")))
    return out.select(*points.columns, *[F.col("_best")["row"][c].alias(c) for c in rest])
