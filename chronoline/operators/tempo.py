"""Tempo, signature, measure and beat tables of songs.

Ticks become milliseconds by a piecewise-linear integral of the tempo; measures are counted from signature to signature by
running sums, and unfolded only into their own rows. A song without a tempo or signature at tick 0 has the default there.

Defined results: rows with null ticks are left out; of two changes at one tick one must be given; a final tick of 0 or
null has the first measure only; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoline.operators.asof import asof

TPQN = 480
DEFAULT_US, DEFAULT_SIGNATURE = 500_000, (4, 4)
SONG = ["song"]


def _from_start(changes: DataFrame, songs: DataFrame, **values: int) -> DataFrame:
    """``changes`` with a row at tick 0 for the songs that have none there."""
    changes = changes.where("tick IS NOT NULL")
    lacking = songs.join(changes.where("tick = 0").select("song"), "song", "left_anti")
    return changes.unionByName(lacking.select("song", F.lit(0).cast("bigint").alias("tick"), *(F.lit(v).alias(k) for k, v in values.items())))


def with_default_signature(signatures: DataFrame, songs: DataFrame) -> DataFrame:
    return _from_start(signatures, songs, num=DEFAULT_SIGNATURE[0], den=DEFAULT_SIGNATURE[1])


def with_millis(tempos: DataFrame) -> DataFrame:
    """Tempos (song, tick, us) with the milliseconds at which each begins."""
    w = Window.partitionBy("song").orderBy("tick")
    span = (F.lead("tick").over(w) - F.col("tick")) * F.col("us") / F.lit(TPQN * 1000.0)
    before = F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return tempos.withColumn("_d", span).withColumn("ms", F.coalesce(before, F.lit(0.0))).drop("_d")


def at_millis(rows: DataFrame, timed: DataFrame) -> DataFrame:
    """``rows`` (song, tick, ...) with ``ms``: the last tempo's, and from there on at its rate."""
    t = timed.select("song", F.col("tick").alias("_tick"), F.col("us").alias("_us"), F.col("ms").alias("_ms"))
    out = asof(rows, t, SONG, "tick", "_tick", "backward", prefix="")
    return out.withColumn("ms", F.col("_ms") + (F.col("tick") - F.col("_tick")) * F.col("_us") / F.lit(TPQN * 1000.0)).drop("_tick", "_us", "_ms")


def measures(signatures: DataFrame, finals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signatures (song, tick, num, den) with the number of the measure in which they begin, and measures (song, i, tick).

    A signature holds as many whole measures as fit before the next, by whole ticks a beat. Measure 0 begins at tick 0, and each
    other one a measure of its signature after the one before, so a signature within a measure doesn't restart it."""
    w = Window.partitionBy("song").orderBy("tick")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    s = signatures.withColumn("_next", F.lead("tick").over(w))
    s = s.withColumns({"_len": F.expr(f"{TPQN * 4} * num div den"), "_n": F.expr(f"(_next - tick) div ({TPQN * 4} div den) div num")})
    s = s.withColumn("measure", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    s = s.withColumns({"_a": F.greatest("measure", F.lit(1)), "_z": F.when(F.col("_n").isNotNull(), F.greatest(F.col("measure") + F.col("_n"), F.lit(1)))})
    s = s.withColumn("_base", F.coalesce(F.sum((F.col("_z") - F.col("_a")) * F.col("_len")).over(before), F.lit(0)))
    j = s.join(finals, "song", "left")
    count = F.coalesce(F.col("_z") - F.col("_a"), F.greatest(F.lit(0), F.expr("(final - 1 - _base) div _len")), F.lit(0))
    each = j.withColumn("_count", count).where("_count > 0").withColumn("_j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_count") - 1)))
    rows = each.select("song", (F.col("_a") + F.col("_j")).alias("i"), (F.col("_base") + (F.col("_j") + 1) * F.col("_len")).alias("tick"))
    zero = signatures.select("song").distinct().select("song", F.lit(0).cast("bigint").alias("i"), F.lit(0).cast("bigint").alias("tick"))
    return s.select("song", "tick", "num", "den", "measure"), zero.unionByName(rows)


def tables(tempos: DataFrame, signatures: DataFrame, beats: DataFrame, finals: DataFrame) -> DataFrame:
    """(song, kind, i, tick, ms, us, num, den, measure, down) of all four tables. ``finals``: (song, final tick)."""
    songs = finals.select("song")
    timed = with_millis(_from_start(tempos, songs, us=DEFAULT_US))
    signed, bars = measures(with_default_signature(signatures, songs), finals)
    numbered = lambda df, *order: df.withColumn("i", (F.row_number().over(Window.partitionBy("song").orderBy(*order)) - 1).cast("bigint"))
    rows = numbered(signed, "tick").withColumn("kind", F.lit("signature"))
    rows = rows.unionByName(bars.withColumn("kind", F.lit("measure")), allowMissingColumns=True)
    rows = rows.unionByName(numbered(beats.where("tick IS NOT NULL"), "tick", "seq").drop("seq").withColumn("kind", F.lit("beat")), allowMissingColumns=True)
    rows = at_millis(rows, timed).unionByName(numbered(timed, "tick").withColumn("kind", F.lit("tempo")), allowMissingColumns=True)
    return rows.select("song", "kind", "i", "tick", "ms", "us", "num", "den", "measure", "down")
