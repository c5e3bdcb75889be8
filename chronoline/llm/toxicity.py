"""Toxic spans by a linear-chain conditional random field; documents by its marginals.

1. Token labels come from document labels: for every word and every five-byte word beginning
   the labelled training documents that hold it are counted by label; a token of a toxic
   document is labelled toxic where such a feature belongs to toxic documents almost only.
2. The field has two states per word, hashed features (the word, its beginnings and end, the
   words beside it) and a transition matrix. It is trained in numpy on a bounded sample of
   word windows (``windows`` of each kind) by its exact gradient, from forward-backward.
3. Every word of every whole text gets its marginal from forward-backward over the whole
   document; words of 0.5 or more make the spans. The largest marginal, the expected number of
   toxic words and the length give the document's score by a logistic fit on a bounded sample
   (``calibration`` documents) of the training rows.

At most about ``most_labels`` labelled rows, chosen by hash, are used for learning; they are the
only data that is broadcast. A feature labels tokens if it is in 4 toxic documents and in 0.5 % of them at least, and
if ``purity`` of its labelled documents are toxic; of these at most ``most_cues``, those of the most toxic documents, are kept. Labels, lang, source and doc_id are not inputs of a score.

Defined results: null and empty texts have no words and get the score of that; null labels
and labels without a document are ignored, of several labels of a document the largest
counts; a null doc_id is scored and never learnt from; equal rows score equally; without any
labelled row of both kinds every score is 0; an empty table gives an empty result. Texts of any
length are scored whole, a document at a time at most. ``score`` replaces columns named score,
predicted or spans.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chronoline.llm.common import columns
from chronoline.llm.textcols import GOLD, Words, mix, slabs

BUCKETS = 1 << 16
SLOTS = 7
LENGTH = 48
BIG = 1 << 20


def features(w: Words) -> np.ndarray:
    """(words, SLOTS) rows of the weight table: the word, its first 4 and 5 bytes, its last 3, and the words beside it."""
    n = len(w)
    ones = [w.h, w.part(w.start, np.minimum(w.start + 4, w.end)), w.part(w.start, np.minimum(w.start + 5, w.end)), w.part(np.maximum(w.end - 3, w.start), w.end)]
    edge = np.uint64(7)
    before, after = np.full(n, edge), np.full(n, edge)
    if n > 1:
        same = w.doc[1:] == w.doc[:-1]
        before[1:][same] = w.h[:-1][same]
        after[:-1][same] = w.h[1:][same]
    cols = [*ones, before, after]
    out = np.empty((n, SLOTS), np.int32)
    for k, c in enumerate(cols):
        out[:, k] = (mix(c + np.uint64((k + 1) * int(GOLD) & 0xFFFFFFFFFFFFFFFF)) % np.uint64(BUCKETS - 1)).astype(np.int32)
    out[:, SLOTS - 1] = BUCKETS - 1  # bias
    return out


def _cues(w: Words) -> list[np.ndarray]:
    """Features by which tokens are labelled: the word and its first five bytes."""
    return [w.h, mix(w.part(w.start, np.minimum(w.start + 5, w.end)) + GOLD)]


def messages(e: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log odds of every word of sequences laid end to end; e: score of toxic over clean.
    All sequences step together, the longest first, so a step is one vector operation."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    begin, size = first[:-1][order], n[order]
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(steps), "left")  # sequences longer than t
    t = np.exp(trans)
    fwd, bwd = np.empty(len(e)), np.zeros(len(e))
    r = np.zeros(0)
    for k in range(steps):
        a = active[k]
        at = begin[:a] + k
        if k:
            x = np.exp(np.clip(r[:a], -30, 30))
            r = e[at] + np.log((t[0, 1] + t[1, 1] * x) / (t[0, 0] + t[1, 0] * x))
        else:
            r = e[at]
        fwd[at] = r
    s = np.zeros(len(size))
    for k in range(steps - 2, -1, -1):
        a = active[k + 1]
        at = begin[:a] + k
        x = np.exp(np.clip(e[at + 1] + s[:a], -30, 30))
        s[:a] = np.log((t[1, 0] + t[1, 1] * x) / (t[0, 0] + t[0, 1] * x))
        bwd[at] = s[:a]
    return fwd, bwd


def marginals(e: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(toxic) of every word."""
    fwd, bwd = messages(e, first, trans)
    return 1 / (1 + np.exp(-np.clip(fwd + bwd, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, valid: np.ndarray, rounds: int = 40, rate: float = 0.3, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions from windows: features (B, T, SLOTS), labels and which words exist (B, T)."""
    weights, trans = np.zeros(BUCKETS), np.zeros((2, 2))
    gw, gt = np.full(BUCKETS, 1e-6), np.full((2, 2), 1e-6)
    rows = np.flatnonzero(valid.ravel())
    length = valid.sum(1)
    first = np.concatenate([[0], np.cumsum(length)])
    f = x.reshape(-1, SLOTS)[rows]
    label = y.ravel()[rows].astype(float)
    inner = np.ones(len(rows), bool)
    inner[first[:-1][length > 0]] = False  # words with one before them
    nxt = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[nxt - 1].astype(int), label[nxt].astype(int)), 1)
    for _ in range(rounds):
        e = weights[f].sum(1)
        p, pair = _pairs(e, first, trans, nxt)
        g = np.bincount(f.ravel(), np.repeat(p - label, SLOTS), BUCKETS) / len(rows) * 100 + decay * weights
        gw += g * g
        weights -= rate * g / np.sqrt(gw)
        h = (pair - seen) / max(1, len(nxt)) * 100 + decay * trans
        gt += h * h
        trans -= rate * h / np.sqrt(gt)
    return weights, trans


def _pairs(e, first, trans, nxt):
    """Marginals of words, and the expected number of each transition, from the messages."""
    fwd, bwd = messages(e, first, trans)
    p = 1 / (1 + np.exp(-np.clip(fwd + bwd, -30, 30)))
    if not len(nxt):
        return p, np.zeros((2, 2))
    t = np.exp(trans)
    left, right = np.exp(np.clip(fwd[nxt - 1], -30, 30)), np.exp(np.clip(e[nxt] + bwd[nxt], -30, 30))
    m = np.stack([np.full(len(nxt), t[0, 0]), t[0, 1] * right, t[1, 0] * left, t[1, 1] * left * right], 1)
    return p, (m / m.sum(1, keepdims=True)).sum(0).reshape(2, 2)


def _summary(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per document: largest marginal as odds, expected toxic words, length; (n, 3)."""
    n = np.diff(first)
    if not len(p):
        return np.stack([np.full(len(n), -8.0), np.zeros(len(n)), np.zeros(len(n))], 1)
    top = np.where(n > 0, np.maximum.reduceat(np.append(p, 0.0), np.minimum(first[:-1], len(p))), 0.0)
    total = np.concatenate([[0.0], np.cumsum(p)])
    top = np.clip(top, 1e-4, 1 - 1e-4)
    return np.stack([np.log(top / (1 - top)), np.log1p(total[first[1:]] - total[first[:-1]]), np.log1p(n)], 1)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Newton's method with a small ridge."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-2 * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (p - y) + 1e-2 * b)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return b


def held_out_part(column, parts: int):
    """crc32 of the id as text, modulo ``parts``."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def fit(docs: DataFrame, labels: DataFrame, most_labels: int = 200_000, windows: int = 3000, calibration: int = 20_000, purity: float = 0.9, most_cues: int = 50_000, label: str = "toxic", held_out: bool = True):
    """The model (weights, transitions, calibration), or None without labels of both kinds."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    if held_out:
        known = known.where(held_out_part(F.col("doc_id"), 4) != 2)
    n = known.count()
    wide = 1 << 53  # so that the share of any number of labels is some hashes at least
    part = F.pmod(F.xxhash64("doc_id"), F.lit(wide))
    bound = wide * min(1.0, most_labels / max(n, 1))
    known = known.where(part < int(bound)).select("doc_id", "y")
    rows = docs.join(F.broadcast(known), "doc_id").select("doc_id", "text", "y")  # at most about most_labels rows of 12 bytes

    def count(batches):
        for b in batches:
            y_all = b.column(2).to_numpy(zero_copy_only=False)
            cue, toxic, pos, docs_seen = [], [], np.zeros(2, np.int64), np.zeros(0, np.uint64)
            for i, raw, at in slabs(b.column(1)):
                w = Words(raw, at, "alnum")
                y = y_all[i : i + len(at) - 1]
                total = np.concatenate([[np.uint64(0)], np.cumsum(w.h, dtype=np.uint64)])
                sig = total[w.first[1:]] - total[w.first[:-1]]
                _, one = np.unique(sig, return_index=True)  # copies count once in a batch
                fresh = np.zeros(len(sig), bool)
                fresh[one[~np.isin(sig[one], docs_seen)]] = True
                docs_seen = np.concatenate([docs_seen, sig[one]])
                pos += np.bincount(y[fresh], minlength=2)[:2]
                keep = fresh[w.doc]
                for c in _cues(w):
                    pair = np.unique(np.stack([w.doc[keep].astype(np.uint64), c[keep]], 1), axis=0) if keep.any() else np.zeros((0, 2), np.uint64)
                    cue.append(pair[:, 1])
                    toxic.append(y[pair[:, 0].astype(np.int64)])
            if cue:
                value, inverse = np.unique(np.concatenate(cue), return_inverse=True)
                t = np.bincount(inverse, np.concatenate(toxic), len(value)).astype(np.int64)
                every = np.bincount(inverse, minlength=len(value))
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(t, pa.int64()), pa.array(every, pa.int64()), pa.nulls(len(value), pa.int64())], ["cue", "toxic", "n", "docs"])
            yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int64()), pa.nulls(2, pa.int64()), pa.nulls(2, pa.int64()), pa.array(pos, pa.int64())], ["cue", "toxic", "n", "docs"])

    sums = rows.mapInArrow(count, "cue bigint, toxic bigint, n bigint, docs bigint").groupBy("cue", F.col("docs").isNotNull().alias("of_docs")).agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # cues of less support than one toxic document in 200 don't label; so few remain
    sums = sums.where("of_docs OR toxic >= 4")
    sums = sums.where(F.col("of_docs") | (F.col("toxic") >= purity * F.col("n"))).orderBy(F.desc("of_docs"), F.desc("toxic"), "cue").limit(most_cues + 2).collect()
    per = {int(r["cue"]): int(r["docs"]) for r in sums if r["of_docs"]}
    n_toxic, n_clean = per.get(1, 0), per.get(0, 0)
    if not n_toxic or not n_clean:
        return None
    cues = np.sort(np.array([r["cue"] for r in sums if not r["of_docs"] and r["toxic"] >= max(4, 0.005 * n_toxic)], np.int64).view(np.uint64))
    share = {1: min(1.0, windows / n_toxic), 0: min(1.0, windows / n_clean)}

    def sample(batches):
        for b in batches:
            y_all, ids = b.column(2).to_numpy(zero_copy_only=False), b.column(0).to_numpy(zero_copy_only=False)
            xs, ys, vs = [], [], []
            for i, raw, at in slabs(b.column(1)):
                w = Words(raw, at, "alnum")
                y = y_all[i : i + len(at) - 1]
                luck = (mix(ids[i : i + len(y)].astype(np.int64).view(np.uint64) + GOLD) >> np.uint64(11)).astype(float) / (1 << 53)
                mark = np.zeros(len(w), bool)
                for c in _cues(w):
                    if len(cues):
                        mark |= cues[np.minimum(np.searchsorted(cues, c), len(cues) - 1)] == c
                mark &= y[w.doc] == 1
                f = None
                for d in np.flatnonzero((luck < np.where(y == 1, share[1], share[0])) & (np.diff(w.first) > 0)):
                    a, z = w.first[d], w.first[d + 1]
                    where = np.flatnonzero(mark[a:z])
                    if y[d] == 1 and not len(where):
                        continue  # nothing tells which of its words are toxic
                    middle = where[int(luck[d] * 1e6) % len(where)] if len(where) else int(luck[d] * 1e6) % (z - a)
                    lo = a + max(0, min(middle - LENGTH // 2, z - a - LENGTH))
                    hi = min(z, lo + LENGTH)
                    f = features(w) if f is None else f
                    x = np.zeros((LENGTH, SLOTS), np.int32)
                    x[: hi - lo] = f[lo:hi]
                    v = np.zeros(LENGTH, np.int8)
                    v[: hi - lo] = 1
                    v[: hi - lo] += mark[lo:hi]
                    xs.append(x.tobytes())
                    vs.append(v.tobytes())
            if xs:
                yield pa.RecordBatch.from_arrays([pa.array(xs, pa.binary()), pa.array(vs, pa.binary())], ["x", "v"])

    got = rows.mapInArrow(sample, "x binary, v binary").toPandas()  # about 2 * windows of LENGTH words
    if not len(got):
        return None
    got = got.sort_values(["x", "v"])
    x = np.frombuffer(b"".join(got["x"]), np.int32).reshape(-1, LENGTH, SLOTS)
    v = np.frombuffer(b"".join(got["v"]), np.int8).reshape(-1, LENGTH)
    weights, trans = train(x, v == 2, v > 0)
    sent = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), trans))

    def measure(batches):
        for b in batches:
            out = [_summary(*_marked(raw, at, sent.value)[:2]) for _, raw, at in slabs(b.column(0), BIG)]
            if out:
                s = np.concatenate(out)
                yield pa.RecordBatch.from_arrays([*(pa.array(s[:, k]) for k in range(3)), b.column(1)], ["top", "sum", "len", "y"])

    few = rows.where(part < int(bound * min(1.0, calibration / max(1, min(n, most_labels))))).select("text", "y")
    c = few.mapInArrow(measure, "top double, sum double, len double, y int").toPandas().sort_values(["top", "sum", "len", "y"])
    return weights.astype(np.float32), trans, _logistic(c[["top", "sum", "len"]].to_numpy(), c["y"].to_numpy(float))


def _marked(raw, at, model):
    w = Words(raw, at, "alnum")
    e = model[0][features(w)].sum(1).astype(float)
    return marginals(e, w.first, model[1]), w.first, w


def score(docs: DataFrame, model, threshold: float = 0.3) -> DataFrame:
    """``docs`` with score, predicted and spans (start, end in bytes) from its column text."""
    docs = docs.drop("score", "predicted", "spans")
    if model is None:
        return docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0), "spans": F.array().cast("array<struct<start:bigint,end:bigint>>")})
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at_text = docs.columns.index("text")
    spans_kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        weights, trans, fitted = sent.value
        for b in batches:
            scores, spans = [], []
            for _, raw, at in slabs(b.column(at_text), BIG):
                p, first, w = _marked(raw, at, (weights, trans))
                s = _summary(p, first)
                scores.append(1 / (1 + np.exp(-np.clip(s @ fitted[:-1] + fitted[-1], -30, 30))))
                hot = np.flatnonzero(p >= 0.5)
                cuts = np.searchsorted(hot, first)
                for d in range(len(at) - 1):
                    found = []
                    for k in hot[cuts[d] : cuts[d + 1]]:
                        if found and found[-1][2] == k - 1:
                            found[-1] = (found[-1][0], int(w.end[k] - at[d]), k)
                        else:
                            found.append((int(w.start[k] - at[d]), int(w.end[k] - at[d]), k))
                    spans.append([{"start": a, "end": z} for a, z, _ in found])
            s = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(spans, spans_kind)], [*b.schema.names, "score", "predicted", "spans"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *StructType.fromDDL("score double, predicted int, spans array<struct<start:bigint,end:bigint>>").fields]))


def query(spark, sf_dir):
    from chronoline.llm.common import table

    docs = columns(table(spark, sf_dir, "documents"), doc_id=("doc_id", "bigint"), text=("text", "string"))
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = score(docs, model)
    return out.select("doc_id", (held_out_part(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted", "spans")
