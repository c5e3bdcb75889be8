"""Ordered folds: operators whose next step depends on the last row that was *accepted*.

No window expresses these. Rows are dealt by key and sorted by Spark (spilling as needed), then
stream through a task in Arrow batches with only the current key's state in hand, so a key of
any length needs constant memory. Where a gap restarts the fold, the key is split there first.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


#: rows that a task sorts, where their number is asked for first
ROWS_A_TASK = 100_000


def parts_for(rows: DataFrame) -> int:
    """As many partitions as the number of rows asks for. Spark merges shuffle partitions by their compressed bytes unless their
    number is given, and what a task holds then grows with the input where it sorts them more than once."""
    return max(1, -(-rows.count() // ROWS_A_TASK))


def fold_rows(rows: DataFrame, keys: list[str], order: list[str], inputs: list[str], step: Callable, result: str, kind: str, parts: int | None = None) -> DataFrame:
    """``rows`` with ``result``: ``step(state, *inputs)`` returns (result, next state); the state starts
    as None for each key. ``order`` should be unique within a key. Null keys are one key; null inputs
    come as None. Rows are dealt to ``parts`` partitions, or to as many as Spark makes."""
    dealt = (rows.repartition(parts, *keys) if parts else rows.repartition(*keys)).sortWithinPartitions(*keys, *order)
    schema = StructType([*rows.schema.fields, *StructType.fromDDL(f"`{result}` {kind}").fields])
    names, kind = rows.columns, to_arrow_type(schema[result].dataType)
    at_keys, at_inputs = [names.index(k) for k in keys], [names.index(c) for c in inputs]

    def run(batches):
        key, state = None, None
        for b in batches:
            out = []
            now = list(zip(*(b.column(i).to_pylist() for i in at_keys), strict=True))
            for k, values in zip(now, zip(*(b.column(i).to_pylist() for i in at_inputs), strict=True), strict=True):
                if k != key:
                    key, state = k, None
                value, state = step(state, *values)
                out.append(value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind)], [*names, result])

    return dealt.mapInArrow(run, schema)


def dead_band(rows: DataFrame, keys: list[str], order: list[str], value: str, band: float) -> DataFrame:
    """Rows whose value is more than ``band`` away from the last kept row's; the first is kept. Null and
    NaN values are never kept and change nothing."""

    def step(kept, v):
        keep = v is not None and v == v and (kept is None or abs(v - kept) > band)
        return keep, v if keep else kept

    return fold_rows(rows, keys, order, [value], step, "_keep", "boolean").where("_keep").drop("_keep")


def anchor_groups(rows: DataFrame, keys: list[str], order: list[str], at: str, width: int, name: str = "group_start") -> DataFrame:
    """Rows with the start of their group; a group holds what is less than ``width`` after its first row.
    A gap of ``width`` always begins a group, so keys are split at gaps and the parts fold apart.
    Rows without a time stand in no group: their group's start is null."""
    w = Window.partitionBy(*keys).orderBy(*order)
    fresh = F.coalesce((F.col(at) - F.lag(at).over(w) >= width).cast("long"), F.lit(1))
    parts = rows.withColumn("_f", fresh).withColumn("_part", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_f")

    return fold_runs(parts, [*keys, "_part"], order, at, lambda begins, t, start: _anchors(begins, t, start, width), name).drop("_part")


def _anchors(begins: np.ndarray, t: np.ndarray, start: int | None, width: int) -> tuple[np.ndarray, int | None]:
    """The start of the group of each of the sorted times, in runs that begin at ``begins``; ``start`` is the group that the first
    run is in already. All runs go from group to group at once, by binary search."""
    n = len(t)
    run = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, n)))
    since = t - t[begins][run]
    span = int(since.max(initial=0)) + width + 1
    if span * len(begins) < 1 << 62:  # one sorted line of all runs
        line = run * span + since
        follows = np.searchsorted(line, line + width)
    else:
        follows = np.concatenate([a + np.searchsorted(t[a:z], t[a:z] + width) for a, z in zip(begins, np.append(begins[1:], n), strict=True)])
    first = begins.copy()
    if start is not None:
        first[0] = np.searchsorted(t[: begins[1] if len(begins) > 1 else n], start + width)
    marked, ends = np.full(n, -1), np.append(begins[1:], n)
    at, of = first, np.arange(len(begins))
    while len(at := at[inside := at < ends[of]]):
        of = of[inside]
        marked[at] = at
        at = follows[at]
    group = np.maximum.accumulate(marked)
    out = np.where(group >= 0, t[group], 0 if start is None else start)
    return out, int(out[-1]) if n else start


def fold_runs(rows: DataFrame, keys: list[str], order: list[str], at: str, step: Callable, result: str) -> DataFrame:
    """``rows`` with ``result``, a long, null where ``at`` is: as ``fold_rows``, but a batch at a time. ``step(begins, values, state)`` gets
    where runs of a key begin among a batch's values and the first run's state, which is None for a new key, and returns
    a result for each value and the last run's state."""
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    names = rows.columns
    at_keys, at_value = [names.index(k) for k in keys], names.index(at)
    schema = StructType([*rows.schema.fields, *StructType.fromDDL(f"`{result}` bigint").fields])

    def run(batches):
        key, state = None, None
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, bool)
            for i in at_keys:
                code = b.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= code[1:] != code[:-1]
            first, last = (tuple(b.column(i)[k].as_py() for i in at_keys) for k in (0, b.num_rows - 1))
            known = np.flatnonzero(b.column(at_value).is_valid().to_numpy(zero_copy_only=False))
            out = np.zeros(b.num_rows, np.int64)
            if len(known):
                of = np.cumsum(new)[known]
                begins = np.flatnonzero(np.diff(of, prepend=-1))
                carried = state if first == key and of[0] == 0 else None
                out[known], state = step(begins, b.column(at_value).cast(pa.int64()).fill_null(0).to_numpy()[known], carried)
                if of[-1] != new.sum():
                    state = None  # the last key has no value yet
            elif first != key or new.any():
                state = None
            key = last
            mask = np.ones(b.num_rows, bool)
            mask[known] = False
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64(), mask=mask)], [*names, result])

    return dealt.mapInArrow(run, schema)


def throttle(rows: DataFrame, keys: list[str], order: list[str], at: str, spacing: int) -> DataFrame:
    """Rows at least ``spacing`` after the last accepted one. Rows of equal time as an accepted one
    are not accepted again, and rows without a time never."""
    w = Window.partitionBy(*keys, "_g").orderBy(*order)
    out = anchor_groups(rows, keys, order, at, spacing, "_g")
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1 AND _g IS NOT NULL").drop("_g", "_n")


def note_runs(notes: DataFrame, keys: list[str]) -> DataFrame:
    """Notes (start, end) as (keys, at, b, reach, run_end): runs of notes each of which begins before the latest end so
    far, which is ``reach``; reversed notes are left out."""
    w = Window.partitionBy(*keys).orderBy("at", "b")
    n = notes.where(F.col("start") <= F.col("end")).select(*keys, F.col("start").cast("long").alias("at"), F.col("end").cast("long").alias("b"))
    n = n.withColumn("reach", F.max("b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = n.withColumn("run", F.sum(F.coalesce((F.col("at") >= F.lag("reach").over(w)).cast("long"), F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return n.withColumn("run_end", F.max("b").over(Window.partitionBy(*keys, "run")))


def refine_timing(words: DataFrame, onsets: DataFrame, notes: DataFrame, keys: list[str], before: int, after: int, slack: int, late: int) -> DataFrame:
    """Words (word_id, start, end) moved to sung onsets: the earliest onset in [start - before,
    start + after] that is no earlier than the end sung so far less ``slack``, if the word is at
    least ``late`` behind it. The end then grows over notes (start, end) that overlap the word,
    in order of their start. The end sung so far is the largest end of the words before.

    Onsets come from a bucketed range join, so the fold sees only a word's own. Notes are merged into
    runs, in which each begins before the latest end so far: in order of start, an end inside a run
    grows note by note to the end of the run, and an end outside of all runs stays."""
    from chronoline.operators.interval import overlap_join

    width = 4 * max(before, after, 1)
    near = words.select(*keys, "word_id", (F.col("start") - before).alias("start"), (F.col("start") + after + 1).alias("end"))
    o = onsets.select(*keys, F.col("t").alias("r_start"), (F.col("t") + 1).alias("r_end"))
    o = overlap_join(near, o, keys, width).groupBy(*keys, "word_id").agg(F.sort_array(F.collect_set("r_start")).alias("onsets"))
    n = note_runs(notes, keys)
    # the last note that begins before a word's end, its run's reach until there and its run's end
    n = n.select(*keys, "at", F.lit(1).alias("side"), F.lit(None).cast(words.schema["word_id"].dataType).alias("word_id"), F.struct("reach", "run_end").alias("note"))
    both = n.unionByName(words.select(*keys, F.col("end").cast("long").alias("at"), F.lit(0).alias("side"), "word_id"), allowMissingColumns=True)
    last = F.last("note", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("at", "side", "note.reach").rowsBetween(Window.unboundedPreceding, 0))
    n = both.withColumn("note", last).where("side = 0 AND note IS NOT NULL").select(*keys, "word_id", "note.reach", "note.run_end")
    rows = words.join(o, [*keys, "word_id"], "left").join(n, [*keys, "word_id"], "left")
    rows = rows.withColumns({"reach": F.coalesce("reach", "end"), "run_end": F.coalesce("run_end", "end")})

    def step(sung, start, end, onsets, reach, run_end):
        floor = None if sung is None else sung - slack
        ok = [x for x in (onsets if onsets is not None else []) if floor is None or x >= floor]
        if ok and start - ok[0] >= late:
            start = int(ok[0])
        if reach > end and reach > start:
            end = int(run_end)
        return {"start": int(start), "end": int(end)}, int(end) if sung is None else max(sung, int(end))

    out = fold_rows(rows, keys, ["start", "word_id"], ["start", "end", "onsets", "reach", "run_end"], step, "moved", "struct<start:bigint,end:bigint>")
    return out.select(*keys, "word_id", F.col("start").alias("start_before"), "moved.start", "moved.end")


def refine_by_notes(words: DataFrame, notes: DataFrame, keys: list[str], order: list[str], before: int, after: int, slack: int, most: int) -> DataFrame:
    """Words (word_id, start, end) moved to notes (start, end) where there are no onsets: the note list is read in its
    own ``order``, whatever the times, up to the first note that begins after start + after. Of the notes that
    begin in [start - before, start + after] and no earlier than the end sung so far less ``slack``, each that is
    nearer than the ones before, and nearer than ``most``, takes the word and grows its end. Then the end grows
    over every note, again in list order, that begins before it and ends past the start.

    Where a word stops reading is a running minimum and an as-of, a word's own notes a bucketed range join; how far an end
    can grow is bounded by the run of notes it lies in, so the fold sees a word's own notes only."""
    from chronoline.operators.asof import asof
    from chronoline.operators.interval import overlap_join

    listed = notes.where(F.col("start") <= F.col("end")).withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    late = listed.select(*keys, F.col("start").alias("at"), F.min("_i").over(Window.partitionBy(*keys).orderBy(F.col("start").desc())).alias("stop"))
    own = words.select(*keys, "word_id", "start", "end", (F.col("start") + after + 1).alias("past"))
    own = asof(own, late, keys, "past", "at", "forward", tie="stop", prefix="").drop("past", "at")
    spans = listed.select(*keys, "_i", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    width = 4 * max(before, after, 1)
    points = spans.select(*keys, "_i", "r_start", (F.col("r_start") + 1).alias("r_stop"), "r_end")
    near = own.select(*keys, "word_id", "stop", (F.col("start") - before).alias("start"), (F.col("start") + after + 1).alias("end"))
    near = overlap_join(near, points, keys, width, r_end="r_stop").where(F.col("stop").isNull() | (F.col("_i") < F.col("stop")))
    as_list = lambda name: F.array_sort(F.collect_list(F.struct("_i", F.col("r_start").alias("s"), F.col("r_end").alias("e")))).alias(name)
    near = near.groupBy(*keys, "word_id").agg(as_list("near"))
    own = own.join(near, [*keys, "word_id"], "left").withColumn("reach", F.greatest("end", F.array_max(F.transform("near", lambda x: x["e"]))))
    runs = note_runs(notes, keys).select(*keys, "at", "run_end").groupBy(*keys, "at").agg(F.max("run_end").alias("run_end"))
    own = asof(own.withColumn("last", F.col("reach") - 1), runs, keys, "last", "at", "backward", prefix="").withColumn("reach", F.greatest("reach", "run_end"))
    grow = own.select(*keys, "word_id", (F.col("start") - before).alias("start"), F.col("reach").alias("end"))
    grow = overlap_join(grow, spans, keys, width).groupBy(*keys, "word_id").agg(as_list("grow"))
    rows = own.select(*keys, "word_id", "start", "end", "near").join(grow, [*keys, "word_id"], "left")

    def step(sung, start, end, near, grow):
        floor = None if sung is None else sung - slack
        at, least = start, most
        for x in near if near is not None else ():
            gap = abs(x["s"] - start)
            if gap < least and (floor is None or x["s"] >= floor):
                at, least = x["s"], gap
                if x["e"] > x["s"]:
                    end = max(end, x["e"])
        for x in grow if grow is not None else ():
            if x["s"] < end and x["e"] > at:
                end = max(end, x["e"])
        return {"start": int(at), "end": int(end)}, int(end) if sung is None else max(sung, int(end))

    out = fold_rows(rows, keys, ["start", "word_id"], ["start", "end", "near", "grow"], step, "moved", "struct<start:bigint,end:bigint>")
    return out.select(*keys, "word_id", F.col("start").alias("start_before"), "moved.start", "moved.end")
