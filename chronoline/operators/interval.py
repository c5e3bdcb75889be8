"""Interval joins and interval windows.

Range conditions become equi-joins on time buckets: each interval is replicated to the buckets
that it touches, so a plan has a hash or merge join on (keys, bucket), never a nested loop. Intervals
longer than a bucket belong to coarser levels, of buckets of twice the width each, where they touch two at most; one with
an absurd end is so a few rows, not one a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _level(start: str, end: str, width: int) -> Column:
    """The level whose buckets are as wide as the interval is long, or wider."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col(end) - F.col(start), F.lit(1)) / F.lit(float(width))))).cast("int")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: int, l_start: str = "start", l_end: str = "end", r_start: str = "r_start", r_end: str = "r_end") -> DataFrame:
    """Pairs of left and right intervals of equal keys that share more than a point; each pair
    once, in the first bucket that both touch of the coarser one's level. Intervals with a null or reversed bound match nothing.
    One small job asks which levels there are; where all are level 0, buckets have no levels."""
    l, r = left.where(F.col(l_start) <= F.col(l_end)), right.where(F.col(r_start) <= F.col(r_end))
    l, r = l.withColumn("_l_level", _level(l_start, l_end, width)), r.withColumn("_r_level", _level(r_start, r_end, width))
    levels = sorted(x[0] for x in l.select("_l_level").union(r.select("_r_level")).distinct().collect())
    span = F.lit(width)
    if levels and levels[-1]:
        at = lambda own: F.explode(F.filter(F.array(*map(F.lit, levels)), lambda k: k >= F.col(own)))
        l, r = l.withColumn("_level", at("_l_level")), r.withColumn("_level", at("_r_level"))
        span = F.lit(width) * F.pow(F.lit(2.0), "_level")
        keys = [*keys, "_level"]
    buckets = lambda start, end: F.explode(F.sequence(F.floor(F.col(start) / span).cast("bigint"), F.floor(F.col(end) / span).cast("bigint")))
    l, r = l.withColumn("_b", buckets(l_start, l_end)), r.withColumn("_b", buckets(r_start, r_end))
    pairs = l.join(r, [*keys, "_b"]).where((F.col(l_start) < F.col(r_end)) & (F.col(r_start) < F.col(l_end)) & (F.col("_b") == F.floor(F.greatest(l_start, r_start) / span)))
    if levels and levels[-1]:
        pairs = pairs.where(F.col("_level") == F.greatest("_l_level", "_r_level")).drop("_level")
    return pairs.drop("_b", "_l_level", "_r_level")


def best_overlap(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_order: str, width: int, least: int = 0) -> DataFrame:
    """Left intervals (start, end) with the right interval (r_start, r_end) that overlaps most, by
    more than ``least``; of equal overlaps the first by ``right_order``. Without one, nulls."""
    pairs = overlap_join(left.select(*keys, left_id, "start", "end"), right, keys, width)
    pairs = pairs.withColumn("overlap", F.least("end", "r_end") - F.greatest("start", "r_start")).where(F.col("overlap") > least)
    best = Window.partitionBy(*keys, left_id).orderBy(F.desc("overlap"), right_order)
    top = pairs.withColumn("_n", F.row_number().over(best)).where("_n = 1").select(*keys, left_id, *[c for c in right.columns if c not in keys], "overlap")
    return left.join(top, [*keys, left_id], "left")


def earliest_in_range(points: DataFrame, others: DataFrame, keys: list[str], at: str, other_at: str, before: int, after: int, name: str = "earliest") -> DataFrame:
    """Each point with the smallest other time in [at - before, at + after]: one range window, no join."""
    extra = [c for c in points.columns if c not in (*keys, at)]
    p = points.select(*keys, F.col(at).alias("_t"), F.struct(*extra).alias("_p"), F.lit(None).cast("long").alias("_o"))
    o = others.select(*keys, F.col(other_at).alias("_t"), F.lit(None).cast(p.schema["_p"].dataType).alias("_p"), F.col(other_at).cast("long").alias("_o"))
    w = Window.partitionBy(*keys).orderBy("_t").rangeBetween(-before, after)
    both = p.unionByName(o).withColumn(name, F.min("_o").over(w)).where("_p IS NOT NULL")
    return both.select(*keys, F.col("_t").alias(at), *[F.col(f"_p.{c}").alias(c) for c in extra], name)


def nullify_overlaps(rows: DataFrame, keys: list[str], order: list[str], column: str, start: str = "start", end: str = "end") -> DataFrame:
    """``column`` becomes null for intervals that overlap another of their keys. ``order`` starts with
    the start; an overlap shows as an earlier interval's end past the start, or the next start before the end."""
    w = Window.partitionBy(*keys).orderBy(*order)
    past = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    hit = (F.col(start) < F.coalesce(past, F.col(start))) | (F.coalesce(F.lead(start).over(w), F.col(end)) < F.col(end))
    return rows.withColumn(column, F.when(~hit, F.col(column)))


def active_flags(intervals: DataFrame, keys: list[str], lane: str, lanes: int, start: str = "start", end: str = "end") -> DataFrame:
    """(keys, tick, flags) at every tick where a half-open interval begins or ends: the bits of the
    lanes that are active from there. A sweep: ends and begins are counted, no pairs are formed."""
    one = [F.sum(F.when(F.col(lane) == k, F.col("_d"))).alias(f"_{k}") for k in range(lanes)]
    steps = intervals.where(F.col(start) < F.col(end)).select(*keys, lane, F.explode(F.array(F.struct(F.col(start).alias("tick"), F.lit(1).alias("d")), F.struct(F.col(end).alias("tick"), F.lit(-1).alias("d")))).alias("_e"))
    steps = steps.select(*keys, lane, F.col("_e.tick").alias("tick"), F.col("_e.d").alias("_d")).groupBy(*keys, "tick").agg(*one)
    w = Window.partitionBy(*keys).orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    flags = sum((F.when(F.sum(F.coalesce(f"_{k}", F.lit(0))).over(w) > 0, 1 << k).otherwise(0) for k in range(1, lanes)), F.when(F.sum(F.coalesce("_0", F.lit(0))).over(w) > 0, 1).otherwise(0))
    return steps.select(*keys, "tick", flags.cast("long").alias("flags"))
