"""Pitches of timed words: what is heard in each, and what stands in where that can't be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoline.operators.interval import overlap_join
from chronoline.operators.stats import median_mode

LOW, HIGH, DEFAULT = 48, 84, 60.0


def trusted_pitch(words: DataFrame, frames: DataFrame, keys: list[str], word: str, prob: float, least: int, agree: float, short: int, instead: int, width: int) -> DataFrame:
    """Words (start, end) with n, median, mode and trusted of the frames (at, midi, voiced, prob) in them that
    are voiced and more probable than ``prob``. A word lasts until the next one begins at most; what is
    then under ``short`` is taken as ``instead``. Null midis are unvoiced; words without frames have n 0."""
    w = Window.partitionBy(*keys).orderBy("start", word)
    end = F.least("end", F.coalesce(F.lead("start").over(w), F.col("end")))
    span = words.select(*keys, word, "start", end.alias("end"))
    span = span.withColumn("end", F.when(F.col("end") - F.col("start") < short, F.col("start") + instead).otherwise(F.col("end")))
    heard = frames.where(F.col("voiced") & (F.col("prob") > prob) & F.col("midi").isNotNull() & ~F.isnan(F.col("midi").cast("double")))
    heard = heard.select(*keys, F.col("at").alias("r_start"), (F.col("at") + 1).alias("r_end"), "midi")
    stats = median_mode(overlap_join(span, heard, keys, width), [*keys, word], "midi", least, agree)
    out = words.join(stats, [*keys, word], "left")
    return out.withColumns({"n": F.coalesce("n", F.lit(0)), "trusted": F.coalesce("trusted", F.lit(False))})


def cascade(heard: Column, note: Column, contour: Column, near: float = 3.0) -> Column:
    """The pitch heard, or else the note in the octave nearest the contour if that is within ``near``, or else
    the contour; rounded half to even, between LOW and HIGH."""
    octaves = F.filter(F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda o: note + 12 * o), lambda p: (p >= LOW) & (p <= HIGH))
    best = F.array_min(F.transform(octaves, lambda p: F.struct(F.abs(p - contour).alias("d"), p.alias("p"))))
    held = F.greatest(F.lit(float(LOW)), F.least(F.lit(float(HIGH)), F.coalesce(contour, F.lit(DEFAULT))))
    pick = F.when(heard.isNotNull(), F.bround(heard)).when(best["d"] <= near, best["p"].cast("double")).otherwise(F.bround(held))
    return F.greatest(F.lit(LOW), F.least(F.lit(HIGH), pick.cast("long"))).cast("long")
