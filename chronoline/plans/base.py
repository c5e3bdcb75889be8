"""The registry of queries and readers of the shared tables."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Query(NamedTuple):
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


ALL: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame with the SQL it must agree with."""

    def keep(build):
        ALL[name] = Query(build, sql)
        return build

    return keep


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def micros(column: str = "ts"):
    return F.unix_micros(F.col(column).cast("timestamp"))


def events(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    """Events as a timeline: (user_id, event_id, kind, t, value, k), t in microseconds."""
    e = read(spark, sf_dir, "events")
    if kind:
        e = e.where(F.col("event_type") == kind)
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select("user_id", "event_id", F.col("event_type").alias("kind"), micros().alias("t"), "value", k.alias("k"))


#: the same timeline in SQL
EVENTS = "e AS (SELECT user_id, event_id, event_type AS kind, epoch_us(ts) AS t, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"
