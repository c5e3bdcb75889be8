"""Structural comparison of tables and rule reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def table_diff(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, column, left_value, right_value) of every difference; a row of one side only is a
    difference of column ``<row>``."""
    l = left.select(*keys, F.struct(*columns).alias("_l"))
    r = right.select(*keys, F.struct(*columns).alias("_r"))
    j = l.join(r, keys, "full")
    one = F.struct(F.lit("<row>").alias("column"), F.when(F.col("_l").isNotNull(), "present").alias("left_value"), F.when(F.col("_r").isNotNull(), "present").alias("right_value"))
    each = F.array(*[F.when(~F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")), F.struct(F.lit(c).alias("column"), F.col(f"_l.{c}").cast("string").alias("left_value"), F.col(f"_r.{c}").cast("string").alias("right_value"))) for c in columns])
    found = F.when(F.col("_l").isNull() | F.col("_r").isNull(), F.array(one)).otherwise(F.filter(each, lambda x: x.isNotNull()))
    return j.select(*keys, F.explode(found).alias("d")).select(*keys, "d.*")


def first_difference(diff: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Of each key the first differing column, in the order of ``columns``."""
    place = F.array_position(F.array(*map(F.lit, ["<row>", *columns])), F.col("column"))
    w = Window.partitionBy(*keys).orderBy(place)
    return diff.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def report(rows: DataFrame, checks: dict[str, Column], examples: str) -> DataFrame:
    """(check, failed, status, first): how many rows break each rule, and the smallest ``examples`` among them.
    One pass: every rule is an aggregate."""
    aggs = reduce(list.__add__, [[F.sum(F.when(~F.coalesce(ok, F.lit(False)), 1).otherwise(0)).cast("long").alias(f"n{k}"), F.min(F.when(~F.coalesce(ok, F.lit(False)), F.col(examples))).alias(f"f{k}")] for k, ok in enumerate(checks.values())])
    one = rows.agg(*aggs)
    each = F.array(*[F.struct(F.lit(name).alias("check"), F.coalesce(F.col(f"n{k}"), F.lit(0)).alias("failed"), F.when(F.coalesce(F.col(f"n{k}"), F.lit(0)) == 0, "ok").otherwise("failed").alias("status"), F.col(f"f{k}").alias("first")) for k, name in enumerate(checks)])
    return one.select(F.explode(each).alias("r")).select("r.*")
