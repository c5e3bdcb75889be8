"""Grouped statistics: weighted histograms against profiles, gates, bands, normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Strength of the 12 scale degrees in a major and a minor key (Krumhansl and Kessler, 1982).
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)


def detect_keys(notes: DataFrame, keys: list[str], pitch: str, weight: str) -> DataFrame:
    """(keys, tonic, tonality, score): the rotation of a profile most like the duration histogram of
    pitch classes by cosine; tonality 0 is major. Durations that aren't positive weigh 1."""
    w = F.when(F.col(weight) <= 0, F.lit(1.0)).otherwise(F.col(weight).cast("double"))
    bins = notes.where(F.col(pitch) >= 0).groupBy(*keys, F.pmod(F.col(pitch), F.lit(12)).alias("pc")).agg(F.sum(w).alias("h"))
    profile = F.explode(F.array(*[F.struct(F.lit(t).alias("tonic"), F.lit(m).alias("tonality"), F.array(*[F.lit(p[(k - t) % 12]) for k in range(12)]).alias("p")) for t in range(12) for m, p in enumerate((MAJOR, MINOR))]))
    hist = bins.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("pc", "h"))).alias("h"))
    full = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.coalesce(F.try_element_at("h", k), F.lit(0.0)))
    r = hist.select(*keys, full.alias("h")).select(*keys, "h", profile.alias("c"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    r = r.select(*keys, "c.tonic", "c.tonality", (dot("h", "c.p") / F.sqrt(dot("h", "h") * dot("c.p", "c.p"))).alias("score"))
    best = Window.partitionBy(*keys).orderBy(F.desc(F.round("score", 9)), "tonic", "tonality")
    return r.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def median_mode(rows: DataFrame, keys: list[str], value: str, least: int = 2, agree: float = 1.0) -> DataFrame:
    """(keys, n, median, mode, trusted): mode of the values rounded half to even, lowest on ties;
    trusted if there are ``least`` values and both are within ``agree``."""
    g = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.median(value).alias("median"), F.mode(F.bround(value).cast("long"), True).alias("mode"))
    return g.withColumn("trusted", F.coalesce((F.col("n") >= least) & (F.abs(F.col("median") - F.col("mode")) <= agree), F.lit(False)))


def banded(value: Column, bands: list[tuple[float, int]], default: int) -> Column:
    """The level of the first threshold, from the highest, that the value reaches."""
    out = None
    for least, level in sorted(bands, reverse=True):
        out = F.when(value >= least, level) if out is None else out.when(value >= least, level)
    return out.otherwise(default)


def _beside(rows: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """``rows`` with aggregates of their key. A join, so that a frequent key's rows are combined before the
    shuffle and AQE can split them; null keys are one key."""
    s = rows.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(*(c.alias(n) for n, c in aggregates.items()))
    on = [rows[k].eqNullSafe(s[f"_k{i}"]) for i, k in enumerate(keys)]
    return rows.join(s, on).drop(*(f"_k{i}" for i in range(len(keys))))


def peak_normalized(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values over the largest magnitude of their key, where that is over 1."""
    top = _beside(rows, keys, _m=F.max(F.abs(value)))
    return top.withColumn(value, F.when(F.col("_m") > 1, F.col(value) / F.col("_m")).otherwise(F.col(value))).drop("_m")


def standardized(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(value - mean) / sample standard deviation of the key; null where that is 0 or unknown."""
    s = _beside(rows, keys, _a=F.avg(value), _s=F.stddev_samp(value))
    return s.withColumn(value, F.when(F.col("_s") > 0, (F.col(value) - F.col("_a")) / F.col("_s"))).drop("_a", "_s")
