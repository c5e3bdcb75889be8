"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words; positions with 0 are ignored, so a seed still
matches where those words were replaced. Seeds of the benchmark's items and of all whole
documents meet in a Spark join on their hash. Around each joined pair the document and the item
are laid on one diagonal; the longest stretch there is found in which at least ``agreement`` of the
words are equal. A document is contaminated by an item if such a stretch covers at least
``min_words`` words, or the whole of a shorter item; ``share`` can ask for more of the item.

The masks together hit every stretch of 13 words with two of them replaced, wherever these stand.

Words are lower-cased (A-Z) runs of digits, letters and non-ASCII characters. If the benchmark
has at most ``most_seeds`` seeds, they are broadcast for the join, and a Bloom filter of them
keeps seeds that can't join from leaving the task that reads the text; beyond that both sides
are joined by shuffle, without a filter. Only documents with a seed left carry their text on.
Copies of items share their seeds; each is reported. A seed is one row of a document or item with all its
places there, so a repeated word or phrase joins once, and its diagonals are found by subtraction or, where
that would be long, by a correlation; documents then stream past with one item at a time beside them.

Defined results: null or empty texts and items match nothing; items with a null id are no items;
items shorter than the masks are matched as a whole by their own words; texts of any length are
read whole; equal doc_ids give a row each; an empty table gives an empty result; columns other
than the named ones are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoline.llm.common import columns, cut
from chronoline.llm.textcols import GOLD, Sieve, Words, mix, signed, slabs

MASKS = ("1111101", "10110111", "11010111", "11100111")


def _seeds(h: np.ndarray, mask: str, which: int) -> np.ndarray:
    """Hash of each placement of the mask."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, which + 1, np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out = mix(out * GOLD ^ h[k : k + n])
    return out


def _item_seeds(w: np.ndarray, masks) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(hashes, positions, length) of one item: each mask's, or for short items one seed of all its words."""
    short = min(map(len, masks))
    if 0 < len(w) < short:
        return [(_seeds(w, "1" * len(w), 1000 + len(w)), np.zeros(1, np.int64), len(w))]
    return [(s := _seeds(w, m, k), np.arange(len(s)), 0) for k, m in enumerate(masks)]


def stretch(equal: np.ndarray, agreement: float) -> tuple[int, int]:
    """The longest [i, j) with at least ``agreement`` of its values true and true ends."""
    equal = np.asarray(equal, bool)
    score = np.concatenate([[0.0], np.cumsum(equal - agreement)])
    low = np.minimum.accumulate(np.where(np.append(equal, False), score, np.inf))  # a stretch begins at
    high = np.maximum.accumulate(np.where(np.append(False, equal), score, -np.inf)[::-1])[::-1]  # and ends after an equal word
    best, i, j = (0, 0), 0, 1
    while j < len(score):  # the classic two-pointer scan for the widest rising pair
        if low[i] <= high[j] + 1e-9:
            if j - i > best[1] - best[0]:
                best = (i, j)
            j += 1
        else:
            i += 1
            j = max(j, i + 1)
    return best


def _all_seeds(w: Words, masks, short) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first words) of every seed within a document: each mask's, and those of short items' lengths."""
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for m, k in [*((m, k) for k, m in enumerate(masks)), *(("1" * n, 1000 + n) for n in short)]:
        g = _seeds(w.h, m, k)
        at = np.flatnonzero(w.doc[: len(g)] == w.doc[len(m) - 1 :][: len(g)]) if len(g) else places[0]
        hashes.append(g[at])
        places.append(at)
    return np.concatenate(hashes), np.concatenate(places)


def _item_rows(masks):
    """Items -> (item, seed, item_at, short): short is the number of words of an item that is shorter than the masks, else 0."""

    def run(batches):
        for b in batches:
            out = [[], [], [], []]
            for i, raw, at in slabs(b.column(1)):
                w = Words(raw, at, "alnum")
                for d in range(len(at) - 1):
                    h = w.h[w.first[d] : w.first[d + 1]]
                    for s, p, short in _item_seeds(h, masks) if len(h) else ():
                        for part, v in zip(out, (np.full(len(s), i + d), s, p, np.full(len(s), short)), strict=True):
                            part.append(v)
            if out[0]:
                r, g, p, n = (np.concatenate(o) for o in out)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r)), pa.array(signed(g)), pa.array(p, pa.int64()), pa.array(n, pa.int32())], ["item", "seed", "item_at", "short"])

    return run


def overlaps(docs: DataFrame, items: DataFrame, masks=MASKS, agreement: float = 0.8, min_words: int = 13, share: float = 0.0, most_seeds: int = 2_000_000, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, hits: array of (item, start, end, words)): for each document the items
    that contaminate it, with the span in words and how many of its words are equal."""
    items = items.select(F.col(item).cast("long").alias("item"), F.col(item_text).cast("string").alias("item_text")).where("item IS NOT NULL")
    docs = columns(docs, doc_id=(doc, "bigint"), text=(text, "string")).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    seeds = items.mapInArrow(_item_rows(masks), "item bigint, seed bigint, item_at bigint, short int")
    seeds = cut(seeds.groupBy("item", "seed").agg(F.array_sort(F.collect_set("item_at")).alias("item_at"), F.max("short").alias("short")))
    few = seeds.count() <= most_seeds
    table = seeds.select("seed").distinct().toArrow()["seed"].to_numpy() if few else None  # at most most_seeds values of 8 bytes
    sent = docs.sparkSession.sparkContext.broadcast(Sieve(table.view(np.uint64))) if few else None
    short = sorted(r["short"] for r in seeds.where("short > 0").select("short").distinct().collect())  # a row for each length below the masks'

    def sift(batches):
        for b in batches:
            n_words, offsets, parts, some = [], [np.zeros(1, np.int64)], [], []
            for _, raw, at in slabs(b.column(2)):
                w = Words(raw, at, "alnum")
                n_words.append(np.diff(w.first))
                g, p = _all_seeds(w, masks, short)
                pick = sent.value.pick(g) if few else np.arange(len(g))
                pick = pick[np.lexsort((p[pick], g[pick], w.doc[p[pick]]))]
                d, g, p = w.doc[p[pick]], g[pick], p[pick]
                new = np.ones(len(pick), bool)
                new[1:] = (d[1:] != d[:-1]) | (g[1:] != g[:-1])
                first = np.flatnonzero(new)
                places = pa.ListArray.from_arrays(pa.array(np.append(first, len(pick)), pa.int32()), pa.array(p - w.first[d]))
                parts.append(pa.StructArray.from_arrays([pa.array(signed(g[first])), places], ["seed", "doc_at"]))
                n = np.bincount(d[first], minlength=len(at) - 1)
                some.append(n > 0)
                offsets.append(offsets[-1][-1] + np.cumsum(n))
            if n_words:
                texts = pc.if_else(pa.array(np.concatenate(some)), b.column(2), pa.scalar(None, b.column(2).type))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(offsets), pa.int32()), pa.concat_arrays(parts))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(n_words), pa.int64()), texts, lists], ["row", "doc_id", "n_words", "text", "seeds"])

    kept = cut(docs.mapInArrow(sift, "row bigint, doc_id bigint, n_words bigint, text string, seeds array<struct<seed:bigint,doc_at:array<bigint>>>"))
    hits = kept.select("row", F.explode("seeds").alias("s")).select("row", "s.*").join(F.broadcast(seeds) if few else seeds, "seed")
    mine = hits.groupBy("row", "item").agg(F.collect_list(F.struct("doc_at", "item_at")).alias("places")).join(F.broadcast(items) if few else items, "item")
    # a document's text, and after it a row for each of its items
    none = lambda kind: F.lit(None).cast(kind)
    both = kept.where("text IS NOT NULL").select("row", "text", none("bigint").alias("item"), none("string").alias("item_text"), none(PLACES).alias("places"))
    both = both.unionByName(mine.select("row", none("string").alias("text"), "item", "item_text", "places"))
    both = both.repartition("row").sortWithinPartitions("row", F.col("item").asc_nulls_first())

    def verify(batches):
        w = None
        for b in batches:
            out = [[], [], [], [], []]
            for k, (row, item) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if item is None:
                    raw = np.frombuffer(b.column(1)[k].as_buffer(), np.uint8)
                    w = Words(raw, np.array([0, len(raw)]), "alnum")
                    continue
                raw = np.frombuffer((b.column(3)[k].as_py() or "").encode(), np.uint8)
                h, best = Words(raw, np.array([0, len(raw)]), "alnum").h, None
                for x in diagonals(b.column(4)[k]):
                    for _, start, end, n in _verify(w, h, int(x), agreement, min_words, share):
                        if best is None or (n, -start) > (best[2], -best[0]):
                            best = start, end, n
                    if best and best[2] == len(h):
                        break  # the whole item, at its first place
                if best:
                    for part, v in zip(out, (row, item, *best), strict=True):
                        part.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], ["row", "item", "start", "end", "words"])

    found = both.mapInArrow(verify, "row bigint, item bigint, start bigint, end bigint, words bigint")
    # of an item's repeated rows the best place
    found = found.groupBy("row", "item").agg(F.max(F.struct("words", (-F.col("start")).alias("less"), "end")).alias("x"))
    hit = F.struct("item", (-F.col("x.less")).alias("start"), F.col("x.end").alias("end"), F.col("x.words").alias("words"))
    found = found.groupBy("row").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    kind = "array<struct<item:bigint,start:bigint,end:bigint,words:bigint>>"
    return kept.select("row", "doc_id", "n_words").join(found, "row", "left").select("doc_id", "n_words", F.coalesce("hits", F.array().cast(kind)).alias("hits"))


PLACES = "array<struct<doc_at:array<bigint>,item_at:array<bigint>>>"
#: places of a seed in a document times those in an item up to which they are simply subtracted
SUBTRACTED = 1 << 22


def diagonals(places) -> np.ndarray:
    """Where an item would begin in a document for each pair of places of a common seed, each once, from the first."""
    parts = []
    for x in places:
        a, b = (x[c].values.to_numpy() for c in ("doc_at", "item_at"))
        if len(a) * len(b) <= SUBTRACTED:
            parts.append(np.unique(np.subtract.outer(a, b)))
            continue
        left, right = np.zeros(int(a.max() - a.min()) + 1), np.zeros(int(b.max() - b.min()) + 1)
        left[a - a.min()], right[b.max() - b] = 1, 1
        n = len(left) + len(right) - 1
        both = np.fft.irfft(np.fft.rfft(left, n) * np.fft.rfft(right, n), n)
        parts.append(np.flatnonzero(both > 0.5) + a.min() - b.max())
    return np.unique(np.concatenate(parts))


def _verify(w: Words, item: np.ndarray, diagonal: int, agreement: float, min_words: int, share: float):
    """(document, start, end, equal words) of the overlaps of an item laid at word ``diagonal``
    of the slab, in each document that it touches there."""
    lo, hi = max(0, diagonal), min(len(w), diagonal + len(item))
    for d in np.unique(w.doc[lo:hi]):
        a, z = max(lo, w.first[d]), min(hi, w.first[d + 1])
        equal = w.h[a:z] == item[a - diagonal : z - diagonal]
        i, j = stretch(equal, agreement)
        if j - i >= min(min_words, len(item)) and j - i >= share * len(item):
            yield int(d), int(a + i - w.first[d]), int(a + j - w.first[d]), int(equal[i:j].sum())


def query(spark, sf_dir):
    from chronoline.llm.common import table

    found = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        (F.size("hits") > 0).alias("contaminated"),
        F.size("hits").cast("long").alias("n_items"),
        F.transform("hits", lambda h: h["item"]).alias("items"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["words"])), F.lit(0)).cast("long").alias("most_words"),
    )
