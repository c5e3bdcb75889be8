"""Notes from activation matrices: a row a frame, an array of bins in it.

Finding notes is a greedy suppression: notes that start at onsets take their frames and the bins beside
them, from the last onset back; then the highest value left is taken again and again, until
none is above the threshold. What a note takes decides what is left for the next, but a stretch
of at least ``tolerance`` frames without a loud bin stops every walk, so a clip is split there
and each part is one Arrow group. A part without such a stretch is in one task; its matrix is held in memory.

Defined results: null and NaN values are silent; frames that are missing are silent, and frames are
counted from 0; arrays may differ in length, the longest is a part's width, so bins beyond a frame's array are silent;
of equal values the earlier frame, then the lower bin, comes first; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: values that the published model's frames are aligned by: hop and rate in samples, frames and samples of a window
HOP, RATE, WINDOW_FRAMES, WINDOW_SAMPLES = 256, 22050, 172, 43844
SHIFT = HOP / RATE * (WINDOW_FRAMES - WINDOW_SAMPLES / HOP) + 0.0018


def frame_seconds(frame: Column) -> Column:
    """Seconds of a frame; each window before it was ``SHIFT`` seconds too long."""
    return frame * HOP / F.lit(float(RATE)) - F.floor(frame / WINDOW_FRAMES) * SHIFT


def with_rises(frames: DataFrame, clip: str, frame: str, values: str, onsets: str, back: int = 2) -> DataFrame:
    """``frames`` with ``onsets`` raised to the rises of ``values`` over 1 to ``back`` frames, scaled to the
    clip's largest onset; the first ``back`` frames have none."""
    order = Window.partitionBy(clip).orderBy(frame)
    steps = [F.zip_with(values, F.lag(values, k).over(order), lambda a, b: a - b) for k in range(1, back + 1)]
    rise = steps[0]
    for s in steps[1:]:
        rise = F.zip_with(rise, s, lambda a, b: F.least(a, b))
    rise = F.when(F.lag(values, back).over(order).isNull(), F.transform(values, lambda v: F.lit(0.0))).otherwise(F.transform(rise, lambda r: F.greatest(r, F.lit(0.0))))
    every = Window.partitionBy(clip)
    out = frames.withColumn("__rise", rise)
    out = out.withColumns({"__most": F.max(F.array_max("__rise")).over(every), "__top": F.max(F.array_max(onsets)).over(every)})
    scaled = F.zip_with(onsets, "__rise", lambda o, r: F.greatest(o, F.when(F.col("__most") > 0, F.col("__top") * r / F.col("__most")).otherwise(F.lit(0.0))))
    return out.withColumn(onsets, scaled).drop("__rise", "__most", "__top")


def parts(frames: DataFrame, clip: str, frame: str, values: str, onsets: str, onset_from: float, loud_from: float, tolerance: int) -> DataFrame:
    """(clip, part, frame, n_frames, v, starts): starts are the bins with an onset; quiet frames go with the loud ones that follow."""
    order = Window.partitionBy("clip").orderBy("frame")
    f = frames.select(F.col(clip).alias("clip"), F.col(frame).cast("bigint").alias("frame"), F.col(values).cast("array<double>").alias("v"), F.col(onsets).cast("array<double>").alias("o"))
    f = f.withColumns({"before": F.lag("o").over(order), "after": F.lead("o").over(order)})
    higher = lambda x, i, other: F.coalesce(x > F.get(other, i), F.lit(False))
    peak = F.transform("o", lambda x, i: F.when((x >= onset_from) & ~F.isnan(x) & higher(x, i, F.col("before")) & higher(x, i, F.col("after")), i))
    loud = F.coalesce(F.exists("v", lambda x: (x >= loud_from) & ~F.isnan(x)), F.lit(False))
    f = f.select("clip", "frame", "v", F.array_compact(peak).alias("starts"), loud.alias("loud"))
    last = F.last(F.when(F.col("loud"), F.col("frame")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.col("loud") & F.coalesce(F.col("frame") - F.col("last") > tolerance, F.lit(True))
    f = f.withColumn("last", last).withColumn("count", F.sum(begins.cast("bigint")).over(order))
    back = Window.partitionBy("clip").orderBy(F.col("frame").desc())
    follows = F.last(F.when(F.col("loud"), F.col("count")), ignorenulls=True).over(back)
    return f.select("clip", F.coalesce(follows, F.col("count")).alias("part"), "frame", F.max("frame").over(Window.partitionBy("clip")).alias("last_frame"), "v", "starts")


def reach(loud: np.ndarray, at: int, stop: int, step: int, tolerance: int) -> int:
    """The last loud frame on the way from ``at`` to before ``stop`` with at most ``tolerance`` frames from each
    loud one to the next. A block at a time, so a short walk in a long column is short."""
    last, pos = at, at + step
    while (stop - pos) * step > 0 and (pos - last) * step <= tolerance:
        end = pos + step * min(256, (stop - pos) * step)
        block = loud[pos:end] if step > 0 else loud[end + 1 : pos + 1][::-1]
        found = pos + step * np.flatnonzero(block)
        far = np.flatnonzero(np.diff(found * step, prepend=last * step) > tolerance)
        if len(far):
            return int(found[far[0] - 1]) if far[0] else last
        last, pos = int(found[-1]) if len(found) else last, end
    return last


def notes_in(v: np.ndarray, starts: list[tuple[int, int]], first: int, last_frame: int, loud_from: float, shortest: int, tolerance: int, rest: bool) -> list[tuple]:
    """(start, end, bin, amplitude, phase, rank, mid) of a part whose matrix begins at frame ``first``. The walk never
    enters a clip's first frame from behind nor its last frame from before."""
    left, n = v.copy(), len(v)
    stop, floor = min(n, last_frame - first), max(-1, -first)
    out = []

    def take(a, b, at):
        left[max(0, a) : max(0, b), max(0, at - 1) : at + 2] = 0

    for start, at in sorted(starts, reverse=True):
        if start + first >= last_frame:
            continue
        end = reach(left[:, at] >= loud_from, start, stop, 1, tolerance) + 1
        if end - start > shortest:
            take(start, end, at)
            out.append((start + first, end + first, at, float(v[start:end, at].mean()), 0, float(-start - first), -at))
    if rest:
        flat = np.flatnonzero(left.ravel() > loud_from)
        for k in flat[np.argsort(-left.ravel()[flat], kind="stable")]:
            mid, at = divmod(int(k), v.shape[1])
            value = left[mid, at]
            if not value > loud_from:
                continue  # taken by a note before it
            left[mid, at] = 0
            loud = left[:, at] >= loud_from
            end, start = reach(loud, mid, stop, 1, tolerance), reach(loud, mid, floor, -1, tolerance)
            take(mid + 1, min(end + tolerance + 1, stop), at)
            take(max(start - tolerance, floor + 1), mid, at)
            if end - start > shortest:
                out.append((start + first, end + first, at, float(v[start:end, at].mean()), 1, float(-value), k + first * v.shape[1]))
    return out


def notes(frames: DataFrame, clip: str, frame: str, values: str, onsets: str, onset_from: float = 0.5, loud_from: float = 0.3, shortest: int = 11, tolerance: int = 11, rest: bool = True, lowest: int = 21) -> DataFrame:
    """(clip, note, start_frame, end_frame, pitch, amplitude): notes of more than ``shortest`` frames. ``note`` numbers
    a clip's notes in the order found: those from onsets from the last back, then, with ``rest``, those from what is left by height."""
    kind = dict(frames.dtypes)[clip]

    def found(t: pa.Table) -> pa.Table:
        at = t.column("frame").to_numpy()
        order = np.argsort(at, kind="stable")
        first = int(at.min())
        rows = t.column("v").to_pylist()
        width = max((len(r) for r in rows if r), default=0)
        v = np.zeros((int(at.max()) - first + 1, max(width, 1)))
        for k in order:
            if rows[k]:
                v[at[k] - first, : len(rows[k])] = np.array(rows[k], float)
        v = np.nan_to_num(v, nan=0.0, posinf=np.inf, neginf=-np.inf)
        starts = [(int(at[k]) - first, b) for k, bins in enumerate(t.column("starts").to_pylist()) for b in bins or () if b < v.shape[1]]
        got = notes_in(v, starts, first, t.column("last_frame")[0].as_py(), loud_from, shortest, tolerance, rest)
        names = ("start_frame", "end_frame", "bin", "amplitude", "phase", "rank", "mid")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.int64())
        clips = t.column("clip")[:1].combine_chunks().take(pa.array(np.zeros(len(got), np.int64)))
        return pa.table([clips, *(pa.array([g[i] for g in got], k) for i, k in enumerate(kinds))], ["clip", *names])

    split = parts(frames, clip, frame, values, onsets, onset_from, loud_from, tolerance)
    out = split.groupBy("clip", "part").applyInArrow(found, f"clip {kind}, start_frame bigint, end_frame bigint, bin bigint, amplitude double, phase int, rank double, mid bigint")
    order = Window.partitionBy("clip").orderBy("phase", "rank", "mid")
    return out.select(F.col("clip").alias(clip), (F.row_number().over(order) - 1).cast("bigint").alias("note"), "start_frame", "end_frame", (F.col("bin") + lowest).alias("pitch"), "amplitude")


def bent(found: DataFrame, frames: DataFrame, clip: str, frame: str, contour: str, per_semitone: int = 3, reach_bins: int = 25, width: float = 5.0, lowest: int = 21) -> DataFrame:
    """``found`` with ``bends``: for each frame of a note where its contour under a bell around the note's own bin is
    highest, in bins from there; frames without a contour bin there have none. Notes meet their frames in an equi-join."""
    bell = [float(np.exp(-0.5 * ((k - reach_bins) / width) ** 2)) for k in range(2 * reach_bins + 1)]
    each = found.where("end_frame > start_frame").withColumn("__frame", F.explode(F.sequence(F.col("start_frame"), F.col("end_frame") - 1)))
    rows = frames.select(F.col(clip).alias("__clip"), F.col(frame).cast("bigint").alias("__frame"), F.col(contour).cast("array<double>").alias("__c"))
    own = (F.col("pitch") - lowest) * per_semitone
    a = F.greatest(own - reach_bins, F.lit(0)).cast("int")
    j = each.join(rows, (each[clip] == rows["__clip"]) & (each["__frame"] == rows["__frame"])).drop(rows["__frame"])
    c = F.slice("__c", a + 1, F.greatest(F.lit(0), (own + reach_bins + 1 - a)).cast("int"))
    p = F.zip_with(c, F.slice(F.array(*map(F.lit, bell)), (a - own + reach_bins + 1).cast("int"), F.greatest(F.lit(0), F.size(c))), lambda x, y: x * y)
    j = j.select(clip, "note", "__frame", (F.array_position(p, F.array_max(p)).cast("int") - 1 + a - own).cast("int").alias("__bend"))
    by = j.groupBy(clip, "note").agg(F.transform(F.array_sort(F.collect_list(F.struct("__frame", "__bend"))), lambda x: x["__bend"]).alias("bends"))
    return found.join(by, [clip, "note"], "left")


def alone(found: DataFrame, clip: str) -> Column:
    """Whether a note overlaps no other of its clip: only such keep their bends on a single track."""
    order = Window.partitionBy(clip).orderBy("start_frame", "end_frame", "pitch", "note")
    before = F.max("end_frame").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return ~(F.coalesce(before > F.col("start_frame"), F.lit(False)) | F.coalesce(F.lead("start_frame").over(order) < F.col("end_frame"), F.lit(False)))
