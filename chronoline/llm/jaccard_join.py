"""Exact Jaccard similarity join of word-shingle sets in a metric space, with pivots.

Jaccard distance d = 1 - |a & b| / |a | b| is a metric. In shingle space nearly all pairs of
documents are at distance 1, so fixed pivots alone can't part the documents; a document's
*regions* are therefore named by its first shingles in one global order (frequent shingles
last, else by hash). Enough of them are taken that two sets within the threshold have at
least ``SHARE`` = 3 regions in common (fewer for tiny sets).

* Equal sets are one class from the start; everything below works on classes.
* Regions of up to ``SMALL`` classes list their pairs; pairs found in 3 regions are candidates.
* Larger regions elect a pivot (the class with the fewest rare shingles). All regions of one
  pivot together are its cell, and every class's distance to its pivots is measured. Classes
  within the threshold r link to the pivot and leave the region. By the triangle inequality a
  class farther than 2r from a pivot can't link with what left with that pivot, so only those in
  the window (r, 2r] are replicated against it. The rest of each region elects its next pivot,
  and so on until no region is large or a round keeps nearly all (over ``SHRINK``) of its rows.
* What the cells hold then is compared in blocks, each block pair a group of its own, within a
  size window and by parity sketch: first each class with its ``FEW`` nearest, then, without any
  limit, all pairs that the links so far leave in different components.

Candidates are checked first by a parity sketch of two bits or more a shingle, whose differing
bits never exceed the symmetric difference, then by their whole sets; pairs that other links
have joined already need no second check. Links join into components.
Shingles are compared by 48 bits of hash, sets by 64: two sets of 10**4 shingles seem to share one
that they don't with odds of 4 in 10**7, and of 10**9 different sets two count as equal with odds of about
3 % (of 10**10, about 2.7 pairs are expected to). Up to that the result is exact. No partner, candidate or row is ever
capped: the frequent-shingle table (at most ``MOST_HOT``) only decides the order, and that
the regions of those shingles count as large.

Defined results: null text counts as empty; texts without words have an empty set and link
with nothing; a text of fewer than ``n`` words has its whole word sequence as one shingle;
equal texts link; equal doc_ids give a row each; a null doc_id gives a row with its own
group's component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoline.llm.common import columns, components, cut, joined, sized
from chronoline.llm.textcols import GOLD, Words, grams, mix, ragged, signed, slabs

SHARE, SMALL, SHRINK, BLOCK, BITS, MOST_HOT, HOT, MOST_SENT, FEW = 3, 48, 0.8, 1024, 1024, 1 << 18, 40, 400_000, 2
#: bytes of texts whose shingles are held at once
PIECE = 1 << 19
SHORT, SALTS = 64, 64


def shingle_sets(raw: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document row, shingle) without repeats, sorted by both; shingles have 48 bits."""
    w = Words(raw, at, "space")
    g = grams(w.h, n)
    inside = w.doc[: len(g)] == w.doc[n - 1 :] if len(g) else np.zeros(0, bool)
    doc, value = w.doc[: len(g)][inside], g[inside]
    count = np.diff(w.first)
    for size in range(1, n):
        few = np.flatnonzero(count == size)
        if len(few):
            h = w.h[w.first[few][:, None] + np.arange(size)]
            x = h[:, 0].copy()
            for k in range(1, size):
                x = mix(x + GOLD) ^ (h[:, k] * np.uint64(0x94D049BB133111EB))
            doc, value = np.concatenate([doc, few]), np.concatenate([value, mix(x + np.uint64(size))])
    value = value >> np.uint64(16)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[keep], value[keep]


def _signatures(doc: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first index, size, 64-bit identity of the set) for each document row."""
    first = np.searchsorted(doc, np.arange(rows + 1))
    size = np.diff(first)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(value + GOLD), dtype=np.uint64)])
    return first, size, mix(total[first[1:]] - total[first[:-1]] + size.astype(np.uint64) * GOLD)


def _need(size, percent: int):
    """The least intersection with a set of ``size``: ceil(threshold * size), in integers."""
    return (size * percent + 99) // 100


def _parities(doc: np.ndarray, hashed: np.ndarray, size: np.ndarray) -> list[bytes]:
    """A bit per hash value, set where an odd number of the set's shingles has it; from ``BITS`` bits on
    the next power of two above twice the size."""
    width = np.maximum(BITS, 1 << np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64))
    out: list[bytes] = [b""] * len(size)
    for w in np.unique(width):
        mine = np.flatnonzero(width == w)
        row = np.full(len(size), -1)
        row[mine] = np.arange(len(mine))
        keep = row[doc] >= 0
        bits = np.zeros((len(mine), w), np.uint8)
        np.bitwise_xor.at(bits, (row[doc[keep]], (hashed[keep] % np.uint64(w)).astype(np.int64)), 1)
        for r, p in zip(mine, np.packbits(bits, axis=1, bitorder="little"), strict=True):
            out[r] = p.tobytes()
    return out


def _folded(parities: list[bytes], width: int) -> np.ndarray:
    """Sketches of equal length, folded to ``width`` bits; hash values agree modulo any power of two."""
    x = np.frombuffer(b"".join(parities), np.uint64).reshape(len(parities), -1, width // 64)
    return np.bitwise_xor.reduce(x, axis=1)


def _profile(n: int):
    def run(batches):
        for b in batches:
            sizes, sigs, parities = [], [], []
            for _, raw, at in slabs(b.column(1), PIECE):
                rows = len(at) - 1
                doc, value = shingle_sets(raw, at, n)
                _, size, sig = _signatures(doc, value, rows)
                parities.extend(_parities(doc, mix(value), size))
                sizes.append(size)
                sigs.append(sig)
            got = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (sizes, sigs)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got[0], pa.int64()), pa.array(signed(got[1].astype(np.uint64))), pa.array(parities, pa.binary())], ["doc_id", "size", "sig", "parity"])

    return run


def _distinct_sets(batches, n: int):
    """Sets of a batch, one for each distinct set: yields (doc, value, first, size, sig, pick)."""
    for b in batches:
        seen = np.zeros(0, np.uint64)
        for _, raw, at in slabs(b.column(0), PIECE):
            doc, value = shingle_sets(raw, at, n)
            first, size, sig = _signatures(doc, value, len(at) - 1)
            _, one = np.unique(sig, return_index=True)
            one = one[(size[one] > 0) & ~np.isin(sig[one], seen)]
            seen = np.concatenate([seen, sig[one]])
            keep = np.zeros(len(size), bool)
            keep[one] = True
            k = keep[doc]
            doc, value = doc[k], value[k]
            yield b.num_rows, doc, value, size, sig


def _frequent(n: int):
    """Shingles that several sets of a batch hold, of those that can come early in the order: small
    hash values, or any of a set of under ``SHORT`` shingles."""

    def run(batches):
        for b in batches:
            parts = [v[(v < np.uint64(int(0.45 * (1 << 48)))) | (size[d] < SHORT)] for _, d, v, size, _ in _distinct_sets([b], n)]
            value, count = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
            keep = count >= max(2, min(3, b.num_rows // 500))
            yield pa.RecordBatch.from_arrays([pa.array(value[keep].astype(np.int64)), pa.array(count[keep], pa.int64())], ["token", "n"])

    return run


def _prefixes(n: int, percent: int, hot):
    """Distinct sets -> (token, sig, about): their regions. ``about`` is the set's size plus 2**32 times
    the number of its rare shingles, negative where the token is a frequent one."""

    def run(batches):
        table = hot.value
        for rows, doc, value, size, sig in _distinct_sets(batches, n):
            if not len(doc):
                continue
            at = np.minimum(np.searchsorted(table, value), max(len(table) - 1, 0))
            frequent = table[at] == value if len(table) else np.zeros(len(value), bool)
            order = np.lexsort((value, frequent, doc))
            doc, value, frequent = doc[order], value[order], frequent[order]
            new = np.ones(len(doc), bool)
            new[1:] = doc[1:] != doc[:-1]
            begin = np.flatnonzero(new)
            place = ragged(np.diff(np.append(begin, len(doc))))
            need = _need(size, percent)
            length = np.minimum(size, size - need + np.minimum(SHARE, need))
            rare = np.bincount(doc, ~frequent, minlength=len(size)).astype(np.int64)
            keep = place < length[doc]
            d = doc[keep]
            about = (size[d].astype(np.int64) + (rare[d] << 32)) * np.where(frequent[keep], -1, 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(value[keep].astype(np.int64)), pa.array(signed(sig[d])), pa.array(about)],
                ["token", "sig", "about"],
            )

    return run


def _regions(percent: int):
    """Rows sorted by (token, sig) -> pairs of small regions (a, b, need); members of large ones, and of
    those of frequent tokens, (token, sig, size, rare)."""
    names = ["a", "b", "need", "token", "sig", "size", "rare"]

    def flush(token, sig, size, rare, hot):
        """Whole regions, sorted: all pairs by offset within small ones."""
        new = np.ones(len(token), bool)
        new[1:] = token[1:] != token[:-1]
        begin = np.flatnonzero(new)
        n = np.diff(np.append(begin, len(token)))
        group = np.repeat(np.arange(len(n)), n)
        a, b, need = [], [], []
        small = (n[group] <= SMALL) & ~hot
        for k in range(1, SMALL):
            i = np.flatnonzero(small[: len(token) - k] & (group[: len(token) - k] == group[k:])) if len(token) > k else np.zeros(0, np.int64)
            if not len(i):
                break
            lo, hi = np.minimum(size[i], size[i + k]), np.maximum(size[i], size[i + k])
            i, lo, hi = (x[lo * 100 >= hi * percent] for x in (i, lo, hi))
            a.append(sig[i])
            b.append(sig[i + k])
            need.append(np.minimum(SHARE, _need(lo, percent)))
        big = np.flatnonzero(~small)
        p = sum(map(len, a))
        none = lambda k: pa.nulls(k, pa.int64())
        cat = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        left = [pa.concat_arrays([pa.array(cat(c)), none(len(big))]) for c in (a, b, need)]
        right = [pa.concat_arrays([none(p), pa.array(c[big].astype(np.int64))]) for c in (token, sig, size, rare)]
        return pa.RecordBatch.from_arrays([*left, *right], names)

    def run(batches):
        held = [*[np.zeros(0, np.int64)] * 4, np.zeros(0, bool)]
        streaming = None  # the token of a region that has proved large and is passed on as it comes
        for b in batches:
            token, sig, about = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            cols = [np.concatenate(c) for c in zip(held, (token, sig, np.abs(about) & 0xFFFFFFFF, np.abs(about) >> 32, about < 0), strict=True)]
            token = cols[0]
            if not len(token):
                continue
            # copies of a class from different batches are neighbours
            keep = np.ones(len(token), bool)
            keep[1:] = (token[1:] != token[:-1]) | (cols[1][1:] != cols[1][:-1])
            cols = [c[keep] for c in cols]
            token = cols[0]
            last = np.searchsorted(token, token[-1], "left") if len(token) else 0
            if len(token) - last > 4 * SMALL or streaming == token[-1]:  # large for sure: pass on what is here, but for the last row
                out, held = [c[:-1] for c in cols], [c[-1:] for c in cols]
                mine = out[0] == token[-1]
                if streaming is not None:  # what is left of the region that was passed on before
                    mine |= out[0] == streaming
                streaming = token[-1]
                if mine.any():
                    none = pa.nulls(int(mine.sum()), pa.int64())
                    yield pa.RecordBatch.from_arrays([none, none, none, *[pa.array(c[mine]) for c in out[:4]]], names)
                out = [c[~mine] for c in out]
            else:
                out, held = [c[:last] for c in cols], [c[last:] for c in cols]
            if len(out[0]):
                if len(out[0]) and held[0].size and streaming is not None and (out[0] == streaming).any():
                    mine = out[0] == streaming
                    none = pa.nulls(int(mine.sum()), pa.int64())
                    yield pa.RecordBatch.from_arrays([none, none, none, *[pa.array(c[mine]) for c in out[:4]]], names)
                    out = [c[~mine] for c in out]
                if len(out[0]):
                    yield flush(*out)
        if len(held[0]):
            if streaming == held[0][-1]:
                mine = held[0] == streaming
                none = pa.nulls(int(mine.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, *[pa.array(c[mine]) for c in held[:4]]], names)
                held = [c[~mine] for c in held]
            if len(held[0]):
                yield flush(*held)

    return run


def _sketched(percent: int, reach: int):
    """(a, b, sizes, parities) -> pairs whose parity allows a distance of ``reach`` percent."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            pa_, pb = (np.array(c.to_pylist(), object) for c in (b.column(4), b.column(5)))
            sa, sb = (b.column(c).to_numpy().astype(np.int64) for c in (2, 3))
            la, lb = (np.array(list(map(len, p))) for p in (pa_, pb))
            apart = np.zeros(len(sa), np.int64)
            for k in np.unique(la * (1 << 32) + lb):
                mine = np.flatnonzero(la * (1 << 32) + lb == k)
                width = 8 * int(min(la[mine[0]], lb[mine[0]]))
                apart[mine] = np.bitwise_count(_folded(list(pa_[mine]), width) ^ _folded(list(pb[mine]), width)).sum(1)
            keep = apart <= _slack(sa, sb, reach)
            keep &= np.minimum(sa, sb) * 100 >= np.maximum(sa, sb) * (100 - reach)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in b.columns[:2]], ["a", "b"])

    return run


def _slack(sa, sb, reach: int):
    """The largest symmetric difference of sets within a distance of ``reach`` percent."""
    # |a & b| >= j / (1 + j) (|a| + |b|), j = 1 - reach / 100
    return (sa + sb) - 2 * (((sa + sb) * (100 - reach) + (200 - reach) - 1) // (200 - reach))


class _Space:
    """What measures pairs of classes: their sizes, sketches and representatives' texts."""

    def __init__(self, docs: DataFrame, profile: DataFrame, n: int, percent: int):
        self.docs, self.n, self.percent = docs, n, percent
        self.classes = profile.where("size > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("parity").alias("parity"))
        self.classes = cut(self.classes)

    def near(self, pairs: DataFrame, reach: int) -> tuple[DataFrame, dict]:
        """The distinct pairs whose sizes and sketches allow a distance of ``reach`` percent, as ``sized``."""
        pairs, seen = sized(pairs.select("a", "b").distinct())
        keys = pairs.select(F.explode(F.array("a", "b")).alias("sig"))
        c, some = self.of(keys, seen["n"], self.classes.select("sig", "size", "parity"), F.length("parity"))
        one = seen["one"] and some["one"]
        x = joined(joined(pairs, c.toDF("a", "size_a", "parity_a"), "a", one), c.toDF("b", "size_b", "parity_b"), "b", one)
        return sized(x.select("a", "b", "size_a", "size_b", "parity_a", "parity_b").mapInArrow(_sketched(self.percent, reach), "a bigint, b bigint"))

    def of(self, keys: DataFrame, n: int, rows: DataFrame, weight) -> tuple[DataFrame, dict]:
        """The rows whose sig is one of ``n`` keys; at most ``MOST_SENT`` keys of 8 bytes are broadcast."""
        keys = keys.distinct()
        return sized(rows.join(F.broadcast(keys) if n <= MOST_SENT else keys, "sig", "left_semi"), weight)

    def measured(self, near: tuple[DataFrame, dict]) -> DataFrame:
        """(a, b, common, both) of pairs, from their whole sets; common and both are the sizes of
        intersection and union."""
        n = self.n
        near, pairs = near
        keys = near.select(F.explode(F.array("a", "b")).alias("sig"))
        reps, seen = sized(self.classes.select("sig", F.col("rep").alias("doc_id")).join(F.broadcast(keys.distinct()) if pairs["n"] <= MOST_SENT else keys.distinct(), "sig", "left_semi"), unnamed=F.count_if(F.col("doc_id").isNull()))
        known = "sig bigint, members binary"

        def sets(batches):
            for b in batches:
                out, sigs = [], [np.zeros(0, np.int64)]
                for _, raw, at in slabs(b.column(1), PIECE):
                    doc, value = shingle_sets(raw, at, n)
                    first, _, sig = _signatures(doc, value, len(at) - 1)
                    six = np.ascontiguousarray(value.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6]
                    out.extend(six[i:j].tobytes() for i, j in zip(first, first[1:], strict=False))
                    sigs.append(signed(sig))
                sig = pa.array(np.concatenate(sigs), pa.int64())
                # other texts may have the representative's doc_id
                yield pa.RecordBatch.from_arrays([sig, pa.array(out, pa.binary())], ["sig", "members"]).filter(pc.equal(pc.coalesce(b.column(0), sig), sig))

        texts = self.docs.join(F.broadcast(reps) if seen["n"] <= MOST_SENT else reps, "doc_id").select("sig", "text")
        members = texts.mapInArrow(sets, known)
        # classes of null doc_ids only are found by their sets
        if seen["unnamed"]:
            rows = self.docs.where("doc_id IS NULL").select(F.lit(None).cast("bigint").alias("sig"), "text")
            members = members.unionByName(rows.mapInArrow(sets, known).join(reps.where("doc_id IS NULL").select("sig"), "sig", "left_semi"))
        members, some = sized(members, F.length("members"))
        members, one = members.dropDuplicates(["sig"]), pairs["one"] and some["one"]

        def overlap(batches):
            for b in batches:
                common, both = [], []
                for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    xs, ys = (np.pad(np.frombuffer(v, np.uint8).reshape(-1, 6), ((0, 0), (0, 2))).view("<u8")[:, 0] for v in (x, y))
                    k = len(np.intersect1d(xs, ys, assume_unique=True))
                    common.append(k)
                    both.append(len(xs) + len(ys) - k)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(common, pa.int64()), pa.array(both, pa.int64())], ["a", "b", "common", "both"])

        y = joined(joined(near, members.toDF("a", "x"), "a", one), members.toDF("b", "y"), "b", one).select("a", "b", "x", "y")
        return sized(y.mapInArrow(overlap, "a bigint, b bigint, common bigint, both bigint"))[0]

    def linked(self):
        return F.col("common") * 100 >= F.col("both") * self.percent


def _pair(x: str, y: str):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _large(space: _Space, large: DataFrame, percent: int) -> tuple[list[DataFrame], DataFrame, dict]:
    """Large regions by pivots, windows and recursion: links found with pivots, and the rows (pivot,
    round, sig, size, side) that are left to compare in blocks, as ``sized``.

    In each round every region elects its pivot, and the regions of one pivot become one cell, so that
    a class stands once in a cell however many regions it shares with the pivot. The recursion ends
    when no region is large any more or a round keeps over ``SHRINK`` of the rows."""
    links, left, cells, k, one = [], large, [], 0, False
    reach, rows = min(99, 2 * (100 - percent)), None
    while True:
        pivots = left.groupBy("token").agg(F.min(F.struct("rare", "sig")).alias("p"), F.count("*").alias("n")).where("n > 1")
        at, seen = sized(joined(left, pivots.select("token", F.col("p.sig").alias("pivot"), "n"), "token", one), most=F.max("n"))
        now, most, one = seen["n"], seen["most"], seen["one"]
        cell = at.groupBy("pivot", "sig").agg(F.first("size").alias("size"))
        if not now or most <= SMALL or (rows is not None and now > SHRINK * rows):
            cells.append(cell.select("pivot", F.lit(k).alias("round"), "sig", "size", F.lit(2).alias("side")))
            break
        rows = now
        d = space.measured(space.near(cell.where("sig != pivot").select(*_pair("sig", "pivot")), reach))
        links.append(d.where(space.linked()).select("a", "b"))
        both = d.select(F.explode(F.array(F.struct(F.col("a").alias("pivot"), F.col("b").alias("sig")), F.struct(F.col("b").alias("pivot"), F.col("a").alias("sig")))).alias("x"), F.when(space.linked(), 1).otherwise(2).alias("zone"))
        zones = both.select("x.pivot", "x.sig", "zone")
        # the window: classes between r and 2r of the pivot, against those that leave with it
        placed = cell.join(zones, ["pivot", "sig"], "left").select("pivot", "sig", "size", F.when(F.col("sig") == F.col("pivot"), 1).otherwise(F.coalesce("zone", F.lit(3))).alias("zone"))
        placed = sized(placed)[0]
        inner = placed.where("zone = 1").join(placed.where("zone = 2").select("pivot").distinct(), "pivot", "left_semi")
        for side, those in ((1, placed.where("zone = 2")), (0, inner)):
            cells.append(those.select("pivot", F.lit(k).alias("round"), "sig", "size", F.lit(side).alias("side")))
        left = at.select("token", "sig", "size", "rare", "pivot").join(placed.where("zone = 1").select("pivot", "sig"), ["pivot", "sig"], "left_anti").drop("pivot")
        k += 1
    out = cells[0]
    for more in cells[1:]:
        out = out.unionByName(more)
    return links, *sized(out)


def _blocks(space: _Space, rows: DataFrame, seen: dict, few: int = 0) -> DataFrame:
    """Pairs within regions that size and sketch allow, compared block by block; of sides 0 and 1
    only pairs across, of side 2 all. With ``few``, only each class's nearest by sketch; without,
    all pairs whose ``comp`` differs. ``seen`` is what ``sized`` says of the rows."""
    percent, n, one = space.percent, seen["n"], seen["one"]
    where = ["pivot", "round"]
    sizes = rows.groupBy(*where).agg(F.count("*").alias("n"))
    rows = joined(rows, sizes, where, one).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.hash("sig"), F.col("blocks")))
    parity, some = space.of(rows.select("sig"), n, space.classes.select("sig", "parity"), F.length("parity"))
    rows = joined(rows, parity, "sig", one and some["one"])
    # each block meets every other: replicated along one row and one column of the block grid
    grid = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    rows = rows.withColumn("g", F.explode(grid)).select(*where, F.col("g.i").alias("i"), F.col("g.j").alias("j"), "block", "side", "sig", "size", "parity", "comp")

    def compare(t: pa.Table) -> pa.Table:
        block, side, sig, size, comp = (t.column(k).to_numpy() for k in ("block", "side", "sig", "size", "comp"))
        i, j = int(t.column("i")[0].as_py()), int(t.column("j")[0].as_py())
        parities = np.array(t.column("parity").to_pylist(), object)
        width = np.array([8 * len(p) for p in parities])
        size = size.astype(np.int64)
        # sketches of each width, and of all wider ones folded to it
        bits = {int(w): (np.cumsum(width >= w) - 1, np.concatenate([_folded([p], int(w)) for p in parities[width >= w]])) for w in np.unique(width)}
        ys = np.flatnonzero(block == j)
        a, b = [], []
        for x in np.flatnonzero(block == i):
            near = ys[sig[ys] > sig[x]] if i == j else ys
            near = near[(side[near] != side[x]) | (side[x] == 2)]
            near = near[comp[near] != comp[x]]
            near = near[(np.minimum(size[near], size[x]) * 100 >= np.maximum(size[near], size[x]) * percent)]
            apart = np.zeros(len(near), np.int64)
            for w in np.unique(width[near]):
                at, table = bits[int(min(w, width[x]))]
                mine = width[near] == w
                apart[mine] = np.bitwise_count(table[at[near[mine]]] ^ table[at[x]]).sum(1)
            fits = apart <= _slack(size[near], size[x], 100 - percent)
            ok = near[fits]
            if few and len(ok) > few:
                ok = ok[np.argsort(apart[fits], kind="stable")[:few]]
            a.append(np.minimum(sig[ok], sig[x]))
            b.append(np.maximum(sig[ok], sig[x]))
        cat = lambda v: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64)
        return pa.table([cat(a), cat(b)], ["a", "b"])

    return rows.repartition(*where, "i", "j").groupBy(*where, "i", "j").applyInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 75, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document; links are exact."""
    docs = columns(docs, doc_id=(doc, "bigint"), text=(text, "string"))
    profile = cut(docs.mapInArrow(_profile(n), "doc_id bigint, size bigint, sig bigint, parity binary"))
    space = _Space(docs, profile, n, percent)
    texts = docs.select("text")
    often = texts.mapInArrow(_frequent(n), "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT)
    tokens = np.sort(often.orderBy(F.desc("n"), "token").limit(MOST_HOT).select("token").toArrow()["token"].to_numpy()).astype(np.uint64)
    hot = docs.sparkSession.sparkContext.broadcast(tokens)  # at most MOST_HOT values of 8 bytes
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    # a frequent token's classes are dealt by class too; its region is a large one in any case
    salt = F.when(F.col("about") < 0, F.pmod("sig", F.lit(SALTS))).otherwise(F.lit(0))
    index = texts.mapInArrow(_prefixes(n, percent, hot), "token bigint, sig bigint, about bigint").repartition(parts, "token", salt).sortWithinPartitions("token", "sig")
    listed, members = "a bigint, b bigint, need bigint", "token bigint, sig bigint, size bigint, rare bigint"
    found, seen = sized(index.mapInArrow(_regions(percent), f"{listed}, {members}"), large=F.count("token"))
    pairs = found.where("a IS NOT NULL").select(*_pair("a", "b"), "need").groupBy("a", "b").agg(F.count("*").alias("n"), F.min("need").alias("need")).where("n >= need")
    pairs = pairs.select("a", "b")
    more, held = [], None
    if seen["large"]:
        more, held, rows = _large(space, found.where("token IS NOT NULL").select("token", "sig", "size", "rare"), percent)
        pairs = pairs.unionByName(_blocks(space, held.withColumn("comp", F.col("sig")), rows, FEW))
    # first one pair for each class, then of the others those that these links leave apart
    near = space.near(pairs, 100 - percent)[0]
    first, seen = sized(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    links = space.measured((first, seen)).where(space.linked()).select("a", "b")
    for m in more:
        links = links.unionByName(m)
    sofar = sized(components(links))[0]
    rest = near
    if held is not None:
        apart = held.join(sofar.toDF("sig", "comp"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
        # a cell whose classes are all joined by now has no pair left
        many = apart.groupBy("pivot", "round").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("pivot", "round")
        apart, seen = sized(apart.join(many, ["pivot", "round"], "left_semi"))
        rest = rest.unionByName(space.near(_blocks(space, apart, seen), 100 - percent)[0]).distinct()
    rest = rest.join(first, ["a", "b"], "left_anti")
    for side in "ab":
        rest = rest.join(sofar.toDF(side, f"c{side}"), side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
    rest, seen = sized(rest.where("ca != cb"))
    classes = space.classes.select("sig", "rep").join(sofar.toDF("sig", "comp"), "sig", "left").select("sig", F.coalesce("comp", "sig").alias("comp"), "rep")
    if seen["n"]:
        late = space.measured((rest.select("a", "b"), seen)).where(space.linked()).select("a", "b")
        top = components(rest.join(late, ["a", "b"]), "ca", "cb")  # links between whole components
        classes = classes.join(top.toDF("comp", "upper"), "comp", "left").select("sig", F.coalesce("upper", "comp").alias("comp"), "rep")
    smallest = classes.groupBy("comp").agg(F.min("rep").alias("component_id"))
    final = classes.join(smallest, "comp").select("sig", "component_id")
    out = profile.select("doc_id", "size", "sig").join(final, "sig", "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


#: The same by brute force.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 75 * (x.c + y.c - k)),
e AS (SELECT a AS u, b AS v FROM l UNION SELECT b, a FROM l),
r(d, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.d, e.v FROM r JOIN e ON r.c = e.u),
m AS (SELECT d, min(c) AS c FROM r GROUP BY d)
SELECT w.doc_id, coalesce(n.c, 0) AS n_shingles, m.c AS component_id FROM w JOIN m ON m.d = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""


def query(spark, sf_dir):
    from chronoline.llm.common import table

    return near_duplicates(table(spark, sf_dir, "documents"))
