"""Removal of byte strings repeated from earlier documents, by depth-limited radix passes.

Suffixes are ordered only through the threshold depth (``WIDTH`` = 50 bytes) by passes from
the most significant digit on; groups that stay equal through the last pass are exactly the
repeated windows. So that a pass needn't move a row per byte, suffixes travel in *segments*:
the run of consecutive windows that share their smallest 16-byte string (the anchor). A
window's anchor depends on its own bytes alone, so equal windows always have equal anchors.

1. First digit: segments are dealt to buckets by anchor. A segment equal to one of a smaller
   document is repeated as a whole. An anchor without company drops out.
2. Second digit: of segments with a common anchor but different ends, those stay whose next
   17 bytes to the left or to the right agree (by a byte of hash) with another's; a shared
   window of 50 bytes has 17 more bytes on one side of its anchor.
3. Last digit: the windows of what is left are dealt to buckets by all 50 bytes (two 64-bit
   hashes, 96 bits kept); every window that a smaller document has too is repeated.

Rows that agree are combined within parts of ``PART`` bytes before a shuffle, so an anchor or
a window that a third of all documents hold sends one row per part; anchors with over
``MANY`` different segments in a part go to pass 3 directly. Buckets hold about
``PER_BUCKET`` bytes of text whatever the size of the input, and besides, of an anchor that all
parts hold, up to ``MANY`` rows a part. Identity is by 64 + 48 bits of hash for segments and 96 bits for
windows: of 10**13 windows (10 TB) two different ones count as equal with odds of under one in 10**3.

Defined results: null text counts as empty and, like any text under 50 bytes, loses nothing;
a null doc_id never removes or loses anything; equal doc_ids count as one document; an empty
table gives an empty result; columns other than the named ones are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoline.llm.common import columns, small_batches
from chronoline.llm.textcols import GOLD, M1, M2, buffers, mix, slabs

WIDTH, ANCHOR, SIDE = 50, 16, 17
SPAN = WIDTH - ANCHOR + 1
MANY, STEP, PART, PER_BUCKET, SEGMENT_BITS = 64, 1 << 18, 8 << 20, 16 << 20, np.uint64((1 << 48) - 1)
REPEATED, LEFT, RIGHT, SINGLE = 0, 1, 2, 3
OUT = "doc_id bigint, kind int, data binary"


def _loads(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as integers; zeros follow the end."""
    padded = np.concatenate([raw, np.zeros(WIDTH + 16, np.uint8)])
    return np.ndarray((len(raw) + WIDTH + 8,), "<u8", padded, 0, (1,)).copy()


def _fold(w: np.ndarray, p: np.ndarray, at: tuple[int, ...], seed: int) -> np.ndarray:
    x = np.full(len(p), seed, np.uint64)
    for k in at:
        x = (x ^ (x >> np.uint64(29)) ^ w[p + k]) * M1
        x = x ^ (x >> np.uint64(32))
    return mix(x)


class Segments:
    """The segments of a slab: doc (row), anchor, tag (48 bits), lo and last window start,
    side (a byte of hash for each side of the anchor)."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, sides: bool = True):
        n = len(raw)
        self.w = w = _loads(raw)
        x = w[:n] * M1
        x = (x ^ (x >> np.uint64(32)) ^ w[8 : n + 8]) * M2
        x = (x ^ (x >> np.uint64(29))) * M1
        low = x ^ (x >> np.uint64(31))
        place = np.arange(n, dtype=np.int32)
        size = 1
        while size < SPAN and len(low):  # leftmost minimum over SPAN anchors, by doubling
            step = min(size, SPAN - size)
            if len(low) <= step:
                low, place = low[:0], place[:0]
                break
            a, b = low[:-step], low[step:]
            right = b < a
            low, place = np.where(right, b, a), np.where(right, place[step:], place[:-step])
            size += step
        count = np.maximum(np.diff(at) - WIDTH + 1, 0)
        mark = np.zeros(n + 1, np.int32)
        np.add.at(mark, at[:-1], (count > 0).astype(np.int32))
        np.add.at(mark, at[:-1] + count, -(count > 0).astype(np.int32))
        valid = np.cumsum(mark[:-1])[: len(low)] > 0
        begins = np.zeros(len(low), bool)
        if len(low):
            begins[0] = True
            begins[1:] = (place[1:] != place[:-1]) | ~valid[:-1]
            begins[at[:-1][at[:-1] < len(low)]] = True
            begins &= valid
        self.lo = lo = np.flatnonzero(begins)
        self.doc = np.searchsorted(at, lo, "right") - 1
        after = np.append(lo[1:], n)
        self.last = np.minimum(after, (at[:-1] + count)[self.doc]) - 1
        self.anchor = low[lo]
        self.p = p = place[lo].astype(np.int64)
        ends = _fold(w, lo, (0, 8, 16, 24, 32, 40, 42), 1) * GOLD + _fold(w, self.last, (0, 8, 16, 24, 32, 40, 42), 2)
        self.tag = mix(ends + (self.last - lo).astype(np.uint64)) & SEGMENT_BITS
        if sides:
            begin, end = at[self.doc], at[self.doc + 1]
            alone = mix(self.tag + self.doc.astype(np.uint64) * GOLD)  # nothing to agree with at a document's edge
            left = np.where(p - SIDE >= begin, _fold(w, np.maximum(p - SIDE, 0), (0, 8, 9), 3), alone)
            right = np.where(p + ANCHOR + SIDE <= end, _fold(w, p + ANCHOR, (0, 8, 9), 4), alone)
            self.side = ((left & np.uint64(0xFF)) | (right & np.uint64(0xFF)) << np.uint64(8)).astype(np.uint16)

    def windows(self, pick: np.ndarray, side: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(segment, start, two hashes) of the windows of the picked segments; with a side, of
        those that hold at least ``SIDE`` bytes on that side of the anchor."""
        first, last = self.lo[pick], self.last[pick]
        if side == LEFT:
            last = np.minimum(last, self.p[pick] - SIDE)
        if side == RIGHT:
            first = np.maximum(first, self.p[pick] - SIDE)
        n = np.maximum(last - first + 1, 0)
        seg = np.repeat(pick, n)
        start = np.repeat(first, n) + (np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n))
        at = (0, 8, 16, 24, 32, 40, 42)
        return seg, start, _fold(self.w, start, at, 5), (_fold(self.w, start, at, 6) >> np.uint64(32)).astype(np.uint32)


def _pack(doc: np.ndarray, *columns: np.ndarray) -> bytes:
    """Columns end to end, after the ascending documents as steps of two bytes, or 65,535 and a long."""
    step = np.diff(doc, prepend=doc[:1])
    far = step >= 0xFFFF
    head = np.array([len(doc), far.sum(), doc[0]], "<i8")
    return b"".join(np.ascontiguousarray(c).tobytes() for c in (head, np.where(far, 0xFFFF, step).astype("<u2"), step[far].astype("<i8"), *columns))


def _unpack(blobs: list[bytes], kinds: list[str]) -> list[np.ndarray]:
    """The columns of all blobs, documents last."""
    parts = [[np.zeros(0, k)] for k in [*kinds, "<i8"]]
    for b in blobs:
        n, n_far, doc = (int(x) for x in np.frombuffer(b, "<i8", 3))
        step, at = np.frombuffer(b, "<u2", n, 24).astype(np.int64), 24 + 2 * n
        step[step == 0xFFFF] = np.frombuffer(b, "<i8", n_far, at)
        parts[-1].append(doc + np.cumsum(step))
        at += 8 * n_far
        for part, k in zip(parts, kinds, strict=False):
            part.append(np.frombuffer(b, k, n, at))
            at += n * np.dtype(k).itemsize
    return [np.concatenate(p) for p in parts]


def _by_doc(doc: np.ndarray, kind: int, value: np.ndarray) -> tuple[list, list, list]:
    """A row for each document: its values, packed."""
    order = np.argsort(doc, kind="stable")
    doc, value = doc[order], value[order]
    cuts = np.flatnonzero(np.diff(doc)) + 1
    return [int(doc[i]) for i in np.concatenate([[0], cuts])] if len(doc) else [], [kind] * (len(cuts) + 1 if len(doc) else 0), [p.tobytes() for p in np.split(value, cuts)] if len(doc) else []


def _dealt(bucket: np.ndarray, doc: np.ndarray, *columns: np.ndarray) -> tuple[list, list]:
    order = np.lexsort((doc, bucket))
    bucket = bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    if not len(bucket):
        return [], []
    parts = zip(*[np.split(c[order], cuts) for c in (doc, *columns)], strict=True)
    return [int(bucket[i]) for i in np.concatenate([[0], cuts])], [_pack(*p) for p in parts]


def _new(*columns: np.ndarray) -> np.ndarray:
    """True where a sorted row differs from the one before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


#: anchor, tag (low 32, high 16 bits), sides, shared; the documents follow, packed
ROW = ["<u8", "<u4", "<u2", "<u2", "<u1"]
#: a window's two hashes, the second cut to 32 bits; the documents follow
WINDOW = ["<u8", "<u4"]


def _first_digit(buckets: int):
    """Documents -> rows (bucket, doc_id, kind, data): packed segments for a bucket, or results known already."""

    def parts(batches):
        """Segments of about ``PART`` bytes of text at a time."""
        got, held = [[], [], [], []], 0
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, raw, at in slabs(b.column(1), STEP):
                s = Segments(raw, at)
                for part, v in zip(got, (s.anchor, s.tag, s.side, ids[i + s.doc]), strict=True):
                    part.append(v)
                held += len(raw)
                if held >= PART:
                    yield got
                    got, held = [[], [], [], []], 0
        if got[0]:
            yield got

    def run(batches):
        for n_batch, got in enumerate(parts(batches)):
            anchor, tag, side, doc = (np.concatenate(g) for g in got)
            order = np.lexsort((doc, tag, anchor))
            anchor, tag, side, doc = anchor[order], tag[order], side[order], doc[order]
            new_seg, new_anchor = _new(anchor, tag), _new(anchor)
            leader = doc[np.maximum.accumulate(np.where(new_seg, np.arange(len(doc)), 0))]
            later = ~new_seg & (doc != leader)
            later &= _new(anchor, tag, doc)
            rows = [*_by_doc(doc[later], REPEATED, tag[later])]
            pick = np.flatnonzero(new_seg)
            group = np.cumsum(new_anchor[pick]) - 1
            many = np.bincount(group)[group] > MANY
            far = pick[many]
            for side_of in (LEFT, RIGHT):
                rows = [x + y for x, y in zip(rows, _by_doc(doc[far], side_of, tag[far]), strict=True)]
            first = np.zeros(len(pick), bool)
            if len(pick):
                first[np.unique(group, return_index=True)[1]] = True
            send = ~many | first
            at, shared = pick[send], many[send].astype(np.uint8)
            t = tag[at]
            where, blobs = _dealt((anchor[at] % np.uint64(buckets)).astype(np.int32), doc[at], anchor[at], (t & np.uint64(0xFFFFFFFF)).astype("<u4"), (t >> np.uint64(32)).astype("<u2"), side[at], shared)
            known = [(n_batch + k) % buckets for k in range(len(rows[0]))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(known + where, pa.int32()), pa.array(rows[0] + [None] * len(where), pa.int64()), pa.array(rows[1] + [None] * len(where), pa.int32()), pa.array(rows[2] + blobs, pa.binary())],
                ["bucket", "doc_id", "kind", "data"],
            )

    return run


def _second_digit(table: pa.Table) -> pa.Table:
    """One bucket: which segments are repeated, and whose windows need a look."""
    known = table.filter(pa.compute.is_valid(table["doc_id"])).select(["doc_id", "kind", "data"])
    blobs = table.filter(pa.compute.is_null(table["doc_id"]))["data"].to_pylist()
    anchor, t0, t1, side, shared, doc = _unpack(blobs, ROW)
    tag = t0.astype(np.uint64) | (t1.astype(np.uint64) << np.uint64(32))
    order = np.lexsort((doc, tag, anchor))
    anchor, tag, side, shared, doc = anchor[order], tag[order], side[order], shared[order], doc[order]
    new_seg, new_anchor = _new(anchor, tag), _new(anchor)
    leader = doc[np.maximum.accumulate(np.where(new_seg, np.arange(len(doc)), 0))] if len(doc) else doc
    later = ~new_seg & (doc != leader)
    rows = _by_doc(doc[later], REPEATED, tag[later])
    pick = np.flatnonzero(new_seg)
    group = np.cumsum(new_anchor[pick]) - 1 if len(pick) else pick
    # a second segment with the same byte on the same side
    shared = _shared(shared, new_anchor)[group] if len(pick) else np.zeros(0, bool)
    for side_of, k in ((LEFT, 0), (RIGHT, 8)):
        key = (group.astype(np.int64) << 8) | ((side[pick].astype(np.int64) >> k) & 0xFF)
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        far = pick[shared | (count[inverse] > 1)]
        rows = [x + y for x, y in zip(rows, _by_doc(doc[far], side_of, tag[far]), strict=True)]
    mine = pa.table([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.binary())], ["doc_id", "kind", "data"])
    return pa.concat_tables([known.cast(mine.schema), mine])


def _merged(batches):
    """Rows of a document and kind that come close together as one, before they are dealt by document."""
    held, size = [], 0

    def merged():
        t = pa.Table.from_batches(held)
        kind, blobs = t["kind"].to_numpy(), t["data"].to_pylist()
        n = np.array([len(b) // 8 for b in blobs])
        value, doc, kinds = np.frombuffer(b"".join(blobs), np.uint64), np.repeat(t["doc_id"].to_numpy(), n), np.repeat(kind, n)
        rows = [[], [], []]
        for k in np.unique(kinds):
            rows = [x + y for x, y in zip(rows, _by_doc(doc[kinds == k], int(k), value[kinds == k]), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.binary())], ["doc_id", "kind", "data"])

    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
        if size >= PART:
            yield merged()
            held.clear()
            size = 0
    if held:
        yield merged()


def _shared(shared: np.ndarray, new_anchor: np.ndarray) -> np.ndarray:
    """For each anchor, whether a batch has found it in many segments."""
    return np.logical_or.reduceat(shared.astype(bool), np.flatnonzero(new_anchor))


def _squeeze(batches):
    """(doc_id, text) -> (doc_id, size, zstd frame): texts are dealt to their documents' results in this form."""
    codec = pa.Codec("zstd")
    for b in batches:
        for r, raw, at in slabs(b.column(1)):
            frames = [codec.compress(raw[i:j].tobytes(), asbytes=True) for i, j in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(r, len(frames)), pa.array(np.diff(at), pa.int64()), pa.array(frames, pa.binary())], ["doc_id", "size", "frame"])


def _texts(size: pa.Array, frame: pa.Array, limit: int = STEP):
    """As ``slabs``, from compressed texts."""
    codec, sizes, i = pa.Codec("zstd"), size.to_numpy(zero_copy_only=False), 0
    frames = frame.to_pylist()
    while i < len(sizes):
        j = max(i + 1, i + int(np.searchsorted(np.cumsum(sizes[i:]), limit, "right")))
        parts = [codec.decompress(f, int(n), asbytes=True) if n else b"" for f, n in zip(frames[i:j], sizes[i:j], strict=True)]
        yield i, np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum(sizes[i:j])])
        i = j


def _listed(docs: np.ndarray, column: pa.Array) -> np.ndarray:
    """Keys (row, value) of the packed values of a list<binary> column, for membership tests."""
    rows, values = [], []
    for r, blobs in zip(docs, column.to_pylist(), strict=True):
        for blob in blobs or ():
            v = np.frombuffer(blob, np.uint64)
            values.append(v)
            rows.append(np.full(len(v), r, np.uint64))
    if not values:
        return np.zeros(0, np.uint64)
    return np.unique(_key(np.concatenate(rows), np.concatenate(values)))


def _key(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    return mix(value + mix(row.astype(np.uint64) + GOLD))


def _within(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys


def _last_digit(buckets: int):
    """(doc_id, compressed text, lists to check) -> windows of those segments, dealt by all their bytes."""

    def parts(batches):
        got, held = [[], [], []], 0
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            wanted = [(side, _listed(np.arange(len(ids)), b.column(c))) for side, c in ((LEFT, 3), (RIGHT, 4))]
            for i, raw, at in _texts(b.column(1), b.column(2)):
                s = Segments(raw, at, sides=False)
                keys = _key(i + s.doc, s.tag)
                for side, table in wanted:
                    seg, _, w1, w2 = s.windows(np.flatnonzero(_within(keys, table)), side)
                    for part, v in zip(got, (w1, w2, ids[i + s.doc[seg]]), strict=True):
                        part.append(v)
                    held += len(w1)
                if held >= PART // 8:
                    yield got
                    got, held = [[], [], []], 0
        if got[0]:
            yield got

    def run(batches):
        for n_batch, got in enumerate(parts(batches)):
            w1, w2, doc = (np.concatenate(g) for g in got)
            order = np.lexsort((doc, w2, w1))
            w1, w2, doc = w1[order], w2[order], doc[order]
            new = _new(w1, w2)
            leader = doc[np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))] if len(doc) else doc
            later = ~new & (doc != leader) & _new(w1, w2, doc)
            rows = _by_doc(doc[later], SINGLE, w1[later])
            where, blobs = _dealt((w1[new] % np.uint64(buckets)).astype(np.int32), doc[new], w1[new], w2[new])
            known = [(n_batch + k) % buckets for k in range(len(rows[0]))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(known + where, pa.int32()), pa.array(rows[0] + [None] * len(where), pa.int64()), pa.array(rows[1] + [None] * len(where), pa.int32()), pa.array(rows[2] + blobs, pa.binary())],
                ["bucket", "doc_id", "kind", "data"],
            )

    return run


def _equal_windows(table: pa.Table) -> pa.Table:
    """One bucket of windows: each that a smaller document has too."""
    known = table.filter(pa.compute.is_valid(table["doc_id"])).select(["doc_id", "kind", "data"])
    w1, w2, doc = _unpack(table.filter(pa.compute.is_null(table["doc_id"]))["data"].to_pylist(), WINDOW)
    order = np.lexsort((doc, w2, w1))
    w1, w2, doc = w1[order], w2[order], doc[order]
    new = _new(w1, w2)
    leader = doc[np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))] if len(doc) else doc
    later = ~new & (doc != leader)
    rows = _by_doc(doc[later], SINGLE, w1[later])
    mine = pa.table([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.binary())], ["doc_id", "kind", "data"])
    return pa.concat_tables([known.cast(mine.schema), mine])


def _cover(batches):
    """(doc_id, compressed text, repeated segments, checked segments, repeated windows) -> spans and kept bytes."""
    for b in batches:
        every = np.arange(b.num_rows)
        whole, left, right, single = (_listed(every, b.column(c)) for c in (3, 4, 5, 6))
        checked = np.union1d(left, right)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for i, raw, at in _texts(b.column(1), b.column(2)):
            s = Segments(raw, at, sides=False)
            edge = np.zeros(len(raw) + 1, np.int32)
            keys = _key(i + s.doc, s.tag)
            full = _within(keys, whole)
            np.add.at(edge, s.lo[full], 1)
            np.add.at(edge, s.last[full] + WIDTH, -1)
            seg, start, w1, _ = s.windows(np.flatnonzero(_within(keys, checked) & ~full))
            hit = _within(_key(i + s.doc[seg], w1), single)
            np.add.at(edge, start[hit], 1)
            np.add.at(edge, start[hit] + WIDTH, -1)
            gone = np.cumsum(edge[:-1]) > 0
            sizes, spans, kept = np.diff(at), [], []
            for d in range(len(at) - 1):
                g = gone[at[d] : at[d + 1]]
                step = np.diff(np.concatenate([[0], g.astype(np.int8), [0]]))
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)])
                kept.append(raw[at[d] : at[d + 1]][~g].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(kept)), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans: array of (start, end) in bytes, kept: binary), a row per document."""
    docs = columns(docs, doc_id=(doc, "bigint"), text=(text, "string"))
    small_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(256, size // PER_BUCKET)
    named = docs.where("doc_id IS NOT NULL")
    dealt = "bucket int, " + OUT
    segments = named.mapInArrow(_first_digit(buckets), dealt).groupBy("bucket").applyInArrow(_second_digit, OUT).mapInArrow(_merged, OUT)
    lists = {REPEATED: "whole", LEFT: "at_left", RIGHT: "at_right", SINGLE: "single"}
    of = lambda k: F.collect_list(F.when(F.col("kind") == k, F.col("data"))).alias(lists[k])
    check = segments.where(F.col("kind").isin(LEFT, RIGHT)).groupBy("doc_id").agg(of(LEFT), of(RIGHT))
    frames = "doc_id bigint, size bigint, frame binary"
    packed = named.mapInArrow(_squeeze, frames).where("doc_id IS NOT NULL")  # the join's own condition, so that both uses share an exchange
    windows = packed.join(check, "doc_id").select("doc_id", "size", "frame", "at_left", "at_right").mapInArrow(_last_digit(buckets), dealt)
    single = windows.groupBy("bucket").applyInArrow(_equal_windows, OUT).mapInArrow(_merged, OUT)
    known = segments.unionByName(single).groupBy("doc_id").agg(*map(of, lists))
    rows = packed.join(known, "doc_id", "left").select("doc_id", "size", "frame", *lists.values())
    nameless = docs.where("doc_id IS NULL").mapInArrow(_squeeze, frames).select("doc_id", "size", "frame", *[F.lit(None).cast("array<binary>").alias(c) for c in lists.values()])
    return rows.unionByName(nameless).mapInArrow(_cover, "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")


def query(spark, sf_dir):
    from chronoline.llm.common import table

    kept = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return kept.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: The same by all strings of 50 bytes, as hex.
SQL = """
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
g AS (SELECT doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s),
r AS (SELECT g.doc_id, g.i, lag(g.i) OVER (PARTITION BY g.doc_id ORDER BY g.i) AS before FROM g JOIN f ON f.s = g.s WHERE f.first < g.doc_id),
k AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
span AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM k GROUP BY doc_id, run),
cuts AS (SELECT doc_id, a, z FROM span UNION ALL SELECT doc_id, length(h) // 2, length(h) // 2 FROM d),
kept AS (SELECT c.doc_id, c.a, substr(d.h, CAST(2 * coalesce(lag(c.z) OVER p, 0) + 1 AS BIGINT), CAST(2 * (c.a - coalesce(lag(c.z) OVER p, 0)) AS BIGINT)) AS piece FROM cuts c JOIN d ON d.doc_id = c.doc_id WINDOW p AS (PARTITION BY c.doc_id ORDER BY c.a, c.z))
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(s.removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(s.n, 0) AS BIGINT) AS n_spans, sha256(unhex(p.bytes)) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, sum(z - a) AS removed, count(*) AS n FROM span GROUP BY doc_id) s ON s.doc_id = d.doc_id JOIN (SELECT doc_id, string_agg(piece, '' ORDER BY a) AS bytes FROM kept GROUP BY doc_id) p ON p.doc_id = d.doc_id
"""
