"""As-of lookups: union both sides, then carry the last or first match along a window.

No join and no range condition: one shuffle on the keys and one sort, linear in the input.
Both sides share the partition of their keys. Rows with a null time match nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _stack(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str) -> tuple[DataFrame, list[str]]:
    extra = [c for c in left.columns if c not in keys]
    l = left.select(*keys, F.col(at).alias("_t"), F.struct(*extra).alias("_l"), F.lit(None).cast(right.select(F.struct("*")).schema[0].dataType).alias("_r"))
    r = right.select(*keys, F.col(right_at).alias("_t"), F.lit(None).cast(left.select(F.struct(*extra)).schema[0].dataType).alias("_l"), F.struct(*right.columns).alias("_r"))
    return l.unionByName(r), extra


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, direction: str = "backward", tie: str | None = None, prefix: str = "r_") -> DataFrame:
    """Left rows with the matching right row's columns as ``prefix`` + name (null: no match).

    direction: backward (latest right <= left), forward (earliest right >= left) or nearest
    (smallest distance, earlier side on equal distance). ``tie`` orders right rows of equal
    time; its smallest value wins."""
    both, extra = _stack(left, right, keys, at, right_at)
    tie_key = F.col(f"_r.{tie}") if tie else F.lit(0)
    side = F.col("_l").isNotNull().cast("int")
    back_w = Window.partitionBy(*keys).orderBy(F.col("_t"), side, tie_key.desc()).rowsBetween(Window.unboundedPreceding, 0)
    # from the end backwards: a frame that ends with the partition would be scanned anew for every row
    fore_w = Window.partitionBy(*keys).orderBy(F.col("_t").desc(), side, tie_key.desc()).rowsBetween(Window.unboundedPreceding, 0)
    valid = F.when(F.col("_t").isNotNull(), F.col("_r"))
    back, fore = F.last(valid, True).over(back_w), F.last(valid, True).over(fore_w)
    if direction == "backward":
        both = both.withColumn("_m", back)
    elif direction == "forward":
        both = both.withColumn("_m", fore)
    else:
        both = both.withColumn("_b", back).withColumn("_f", fore)
        near = F.when(F.col("_f").isNull(), F.col("_b")).when(F.col("_b").isNull(), F.col("_f"))
        near = near.when(F.col("_t") - F.col(f"_b.{right_at}") <= F.col(f"_f.{right_at}") - F.col("_t"), F.col("_b")).otherwise(F.col("_f"))
        both = both.withColumn("_m", near)
    out = both.where(F.col("_l").isNotNull())
    match = F.when(F.col("_t").isNotNull(), F.col("_m"))
    return out.select(*keys, *[F.col(f"_l.{c}").alias(c) for c in extra], *[match[c].alias(prefix + c) for c in right.columns if c not in keys])
