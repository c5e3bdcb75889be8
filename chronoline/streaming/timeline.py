"""Structured Streaming forms of timeline operators, for event streams with a watermark.

Results equal the batch operators for events that arrive within the watermark, however they are
dealt to triggers; later rows are dropped by Spark and never change a result that has been given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def phrase_windows(stream: DataFrame, keys: list[str], at: str, width: str, late: str) -> DataFrame:
    """Tumbling windows: first and last event and the count of each key."""
    s = stream.withWatermark(at, late)
    g = s.groupBy(F.window(at, width), *keys).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("n"))
    return g.select(*keys, F.col("window.start").alias("window_start"), "first_at", "last_at", "n")


def hop_windows(stream: DataFrame, keys: list[str], at: str, width: str, hop: str, late: str) -> DataFrame:
    s = stream.withWatermark(at, late)
    return s.groupBy(F.window(at, width, hop), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("window.start").alias("window_start"), "n")


def sessions(stream: DataFrame, keys: list[str], at: str, gap: str, late: str) -> DataFrame:
    """Sessions that a silence of ``gap`` ends."""
    s = stream.withWatermark(at, late)
    g = s.groupBy(F.session_window(at, gap), *keys).agg(F.count("*").alias("n"))
    return g.select(*keys, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def distinct_events(stream: DataFrame, ids: list[str], at: str, late: str) -> DataFrame:
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(ids)


def in_order(stream: DataFrame, key: str, at: str, value: str, late: str, step: Callable, result: str) -> DataFrame:
    """Keyed folds in event time, whatever the triggers: a key's events wait in its state until the watermark has
    passed them, then ``step(state, at_us, value)`` takes them in order and returns (row or None, next state).
    ``state`` and ``value`` are longs or None; a row is a tuple as ``result`` (DDL after the key) names it.
    What waits is bounded by the events within ``late``; events later than that are dropped by Spark."""
    rows = stream.withWatermark(at, late).select(F.col(key).alias("key"), F.col(at).alias("at"), F.unix_micros(F.col(at).cast("timestamp")).alias("at_us"), F.col(value).cast("long").alias("value"))
    names = [f.name for f in StructType.fromDDL(result).fields]

    def run(group, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, times, values = state.get if state.exists else (None, [], [])
        waiting = list(zip(times, values, strict=True))
        for b in batches:
            waiting.extend((int(t), None if v != v else int(v)) for t, v in zip(b["at_us"], b["value"], strict=True))
        passed = state.getCurrentWatermarkMs() * 1000
        waiting.sort(key=lambda x: (x[0], x[1] is not None, x[1] or 0))
        out = []
        for t, v in waiting:
            if t <= passed:
                row, held = step(held, t, v)
                if row is not None:
                    out.append((*group, *row))
        waiting = [x for x in waiting if x[0] > passed]
        if held is None and not waiting:
            state.remove()
        else:
            state.update((held, [t for t, _ in waiting], [v for _, v in waiting]))
            if waiting:
                state.setTimeoutTimestamp(max(waiting[0][0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", *names])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.groupBy("key").applyInPandasWithState(run, f"key {kind}, {result}", "held bigint, times array<bigint>, vals array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def throttled(stream: DataFrame, key: str, at: str, spacing_us: int, late: str) -> DataFrame:
    """(key, at_us): events at least ``spacing_us`` after the last accepted one, as the batch operator has them."""

    def step(last, t, _):
        keep = last is None or t - last >= spacing_us
        return ((t,), t) if keep else (None, last)

    return in_order(stream.withColumn("_none", F.lit(None).cast("long")), key, at, "_none", late, step, "at_us bigint")


def paired_notes(stream: DataFrame, key: str, at: str, on: str, late: str) -> DataFrame:
    """(key, start_us, end_us): each end (``on`` = 0) with the last begin (``on`` = 1) of its key that is still open;
    ends come before begins of the same time, and a begin while another is open takes its place."""

    def step(start, t, on):
        if on:
            return None, t
        return (None if start is None else (start, t)), None

    return in_order(stream, key, at, on, late, step, "start_us bigint, end_us bigint")
