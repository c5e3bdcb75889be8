"""Windows over ordered sequences: neighbours, gaps, phrases, measures, runs.

All are one shuffle on the keys and one sort. Orders should end in a unique column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _w(keys, order):
    return Window.partitionBy(*keys).orderBy(*order)


def clip_to_next(rows: DataFrame, keys, order, start: str = "start", end: str = "end", least: int = 0) -> DataFrame:
    """End at the next start at the latest, but never closer than ``least`` to the own start."""
    following = F.lead(start).over(_w(keys, order))
    return rows.withColumn(end, F.greatest(F.least(F.col(end), F.coalesce(following, F.col(end))), F.col(start) + least))


def until_next(rows: DataFrame, keys, order, start: str, name: str, last) -> DataFrame:
    """``name`` is the next row's start, for the last row ``last``."""
    return rows.withColumn(name, F.coalesce(F.lead(start).over(_w(keys, order)), last))


def to_deltas(rows: DataFrame, keys, order, at: str, name: str = "delta") -> DataFrame:
    return rows.withColumn(name, F.col(at) - F.lag(at, 1, 0).over(_w(keys, order)))


def from_deltas(rows: DataFrame, keys, order, delta: str, name: str = "at") -> DataFrame:
    return rows.withColumn(name, F.sum(delta).over(_w(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def clamped_positions(rows: DataFrame, keys, order, at: str, name: str = "clamped") -> DataFrame:
    """Positions after steps that can't be negative: a step back counts 0, and the next starts from there."""
    w = _w(keys, order)
    return from_deltas(rows.withColumn("_d", F.greatest(F.lit(0), F.col(at) - F.lag(at, 1, 0).over(w))), keys, order, "_d", name).drop("_d")


def gaps(rows: DataFrame, keys, order, least: int, wide: int, pad: int, wide_pad: int, start: str = "start", end: str = "end") -> DataFrame:
    """(keys, gap_start, gap_end): silences longer than ``least`` between one row's end and the next
    start, padded on both sides by ``pad``, or ``wide_pad`` where longer than ``wide``."""
    prev = F.lag(end).over(_w(keys, order))
    g = rows.withColumn("_p", prev).where(F.col("_p").isNotNull() & (F.col(start) - F.col("_p") > least))
    p = F.when(F.col(start) - F.col("_p") > wide, wide_pad).otherwise(pad)
    return g.select(*keys, (F.col("_p") + p).alias("gap_start"), (F.col(start) - p).alias("gap_end"))


def phrases(rows: DataFrame, keys, width: int, start: str = "start", end: str = "end") -> DataFrame:
    """Tumbling windows of ``width``: from the first start to the last end of the rows that start in each."""
    return rows.groupBy(*keys, F.floor(F.col(start) / width).alias("phrase")).agg(F.min(start).alias("phrase_start"), F.max(end).alias("phrase_end"), F.count("*").alias("n"))


def measure_means(rows: DataFrame, keys, at: str, beats: int = 4) -> DataFrame:
    """(keys, measure, start, mean): mean beat length of each group of ``beats`` intervals; the last
    group uses the intervals that it has. Neighbouring groups share their boundary beat."""
    w = _w(keys, [at])
    every = Window.partitionBy(*keys)
    i = rows.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count("*").over(every)).withColumn("_last", F.max(at).over(every))
    i = i.withColumn("_next", F.lead(at, beats).over(w))
    i = i.where(((F.col("_i") - 1) % beats == 0) & (F.col("_i") < F.col("_n")))
    span = F.coalesce("_next", "_last") - F.col(at)
    return i.select(*keys, ((F.col("_i") - 1) / beats).cast("long").alias("measure"), F.col(at).alias("start"), (span / F.least(F.lit(beats), F.col("_n") - F.col("_i"))).alias("mean"))


def suppress_runs(rows: DataFrame, keys, order, value: str, at: str, spacing: int) -> DataFrame:
    """Rows whose value differs from the row before and that come at least ``spacing`` after it."""
    w = _w(keys, order)
    first = F.lag(at).over(w).isNull()
    r = rows.withColumn("_keep", first | ((F.lag(value).over(w) != F.col(value)) & (F.col(at) - F.lag(at).over(w) >= spacing)))
    return r.where("_keep").drop("_keep")


def pair_on_off(rows: DataFrame, keys, order, on, at: str) -> DataFrame:
    """(keys, note, on_at, off_at): an off closes the latest on; the last off before the next on wins.
    Offs before any on are left out; a note without off has a null ``off_at``."""
    w = _w(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    r = rows.withColumn("_on", on).withColumn("note", F.sum(F.col("_on").cast("long")).over(w)).where("note > 0")
    return r.groupBy(*keys, "note").agg(F.min(F.when(F.col("_on"), F.col(at))).alias("on_at"), F.max(F.when(~F.col("_on"), F.col(at))).alias("off_at"))


def last_in_group(rows: DataFrame, keys, order, name: str = "is_last") -> DataFrame:
    return rows.withColumn(name, F.lead(F.lit(1)).over(_w(keys, order)).isNull())


def first_codes(rows: DataFrame, keys, value: str, order: str, name: str = "code") -> DataFrame:
    """(keys, value, code): dense codes by first appearance."""
    first = rows.groupBy(*keys, value).agg(F.min(order).alias("_f"))
    return first.withColumn(name, F.row_number().over(_w(keys, ["_f", value])) - 1).drop("_f")


def peaks(rows: DataFrame, keys, order, value: str) -> DataFrame:
    """Rows above both neighbours; the first and last are none."""
    w = _w(keys, order)
    r = rows.withColumn("_p", (F.col(value) > F.lag(value).over(w)) & (F.col(value) > F.lead(value).over(w)))
    return r.where(F.coalesce("_p", F.lit(False))).drop("_p")


def rising(rows: DataFrame, keys, order, value: str, name: str = "rise") -> DataFrame:
    """The smaller of the increases over one and two rows, at least 0; 0 for the first two rows."""
    w = _w(keys, order)
    d = F.least(F.col(value) - F.lag(value, 1).over(w), F.col(value) - F.lag(value, 2).over(w))
    return rows.withColumn(name, F.when(F.lag(value, 2).over(w).isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), d)))


def interpolate(rows: DataFrame, keys, order, at: str, value: str, name: str = "filled") -> DataFrame:
    """Null values filled linearly between their known neighbours, constant outside them."""
    back = _w(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    fore = _w(keys, order).rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(at).cast("double").alias("t"), F.col(value).cast("double").alias("v")))
    r = rows.withColumn("_b", F.last(known, True).over(back)).withColumn("_f", F.first(known, True).over(fore))
    line = F.col("_b.v") + (F.col("_f.v") - F.col("_b.v")) * (F.col(at) - F.col("_b.t")) / (F.col("_f.t") - F.col("_b.t"))
    out = F.when(F.col(value).isNotNull(), F.col(value).cast("double")).when(F.col("_b").isNull(), F.col("_f.v")).when(F.col("_f").isNull() | (F.col("_f.t") == F.col("_b.t")), F.col("_b.v")).otherwise(line)
    return r.withColumn(name, out).drop("_b", "_f")
