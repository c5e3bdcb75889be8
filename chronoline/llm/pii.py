"""Personal data by fixed patterns and a character BiLSTM with CRF transitions.

The patterns give the base spans (email, ip, card, phone). They also label a bounded sample of
documents, at most about ``sample`` of them and ``most_windows`` windows of their whole texts, on
which a bidirectional LSTM over characters with a linear-chain CRF on top is trained in numpy. Each labelled
span is also trained in disguises that the patterns miss: other separators, a missing plus, spelled or
bracketed marks, spaces. Texts are cut into overlapping windows; each
window is decoded by Viterbi, every character takes the tag of the window in whose middle it
is nearest (so each window decides its middle), and runs of a tag over the whole text are the method's spans. Base spans stay;
the method's spans are added where they touch no base span, are trimmed of surrounding space and punctuation, and
hold what their kind asks for: a card 14 to 19 digits that pass Luhn, a phone 10 to 15 digits, an ip four numbers up to
255, an email letters on both sides of a mark (an ``@`` or "at") and a dot or "dot".

What a kind asks for always holds a *mark*: a digit, an ``@`` or the word "at". A run of tags without a mark can't become a span, so
decoding starts with the windows that decide a mark, and goes on with the next window wherever a run reaches the edge of what
is decoded: every run with a mark is decoded in whole, whatever its length, and the spans are those of all windows of
the whole text decoded. Positions are code points.

Defined results: null text counts as empty and has no spans; a null doc_id is handled like any
other; equal rows give equal rows; texts of any length are cut into windows whole; without any
labelled span only base spans are returned; an empty table gives an empty result. ``find`` replaces
columns named base or spans; ``redact`` keeps every column, whatever its name.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chronoline.llm.common import columns, packed, unpacked

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DISGUISES = 3  # of each labelled span
WIDE = 1 << 53  # so many hashes that the share of any number of texts is some of them
WINDOW, STRIDE, EMBED, HIDDEN, TAGS, CHARS = 64, 32, 8, 20, 5, 98


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:  # a match holds one @, after as many local characters as are free before it
        begin = at
        while begin > free and text[begin - 1] in LOCAL:
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        free = m.end() if m else at + 1
        if m:
            out.append((begin, 0, m.end()))
        at = text.find("@", free)
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


EMAIL_LIKE = re.compile(r"[A-Za-z0-9]\W*(?:@|\bat\b)\W*[A-Za-z0-9].*?(?:\.|\bdot\b).*[A-Za-z]", re.I | re.S)
TRIM = " \t\r\n.,;:!?\"'"


def holds(kind: int, text: str) -> bool:
    """Whether a span that the tagger found has what its kind asks for."""
    digits = re.sub("[^0-9]", "", text)
    if kind == 0:
        return bool(EMAIL_LIKE.search(text))
    if kind == 1:
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(int(p) <= 255 for p in parts if len(p) < 9) and max(map(len, parts)) < 9
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 10 <= len(digits) <= 15


def trimmed(text: str, start: int, kind: int, end: int) -> tuple[int, int, int]:
    """A span without space and punctuation around it."""
    inner = text[start:end]
    return start + len(inner) - len(inner.lstrip(TRIM)), kind, start + len(inner.rstrip(TRIM))


def disguises(kind: int, text: str, r: np.random.Generator) -> str:
    """A span as the patterns don't know it."""
    pick = lambda *options: options[int(r.integers(len(options)))]
    if kind == 0:
        at, dot = pick((" (at) ", " (dot) "), (" [at] ", "."), (" at ", " dot "), (" @ ", "."), ("(at)", "."), (" AT ", " DOT "), (" @ ", " . "))
        local, _, host = text.partition("@")
        return local + at + host.replace(".", dot)
    if kind == 1:
        return text.replace(".", pick(" . ", "[.]", "-", ",", "(.)", ". ", ":", " dot "))
    digits = re.sub("[^0-9]", "", text)
    if kind == 2:
        gap = pick(".", "/", "_", " - ", "  ", ":", ",")
        return gap.join(digits[k : k + 4] for k in range(0, len(digits), 4))
    if len(digits) < 10:
        return text
    head, a, b, c = digits[:-10], digits[-10:-7], digits[-7:-4], digits[-4:]
    return pick(f"{head} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"00{head} {a} {b} {c}", f"{head}-{a}-{b}-{c}", f"{a}/{b}-{c}", f"tel {a}{b}{c}"[4:])


def _ids(text: str) -> np.ndarray:
    """Character ids: printable ASCII, then one for all else; 0 is padding."""
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    return np.where((code >= 32) & (code < 127), code - 31, CHARS - 1).astype(np.int32)


AT = re.compile(r"\bat\b", re.I)


def _marks(text: str, ids: np.ndarray) -> np.ndarray:
    """Which characters are a digit, an @ or in the word "at": a span that ``holds`` has one of them."""
    mark = ((ids >= 17) & (ids <= 26)) | (ids == 33)
    for m in AT.finditer(text):
        mark[m.start() : m.end()] = True
    return mark


def _starts(n: int) -> np.ndarray:
    """Starts of all windows of a text of n characters."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE) if n else np.zeros(0, np.int64)


def _deciding(at: np.ndarray, n: int) -> np.ndarray:
    """The windows, by number, in whose middle the characters are nearest."""
    return np.clip((at - (WINDOW - STRIDE) // 2) // STRIDE, 0, len(_starts(n)) - 1)


def _windows(ids: np.ndarray, text: str | None = None) -> np.ndarray:
    """Starts of the windows that hold a mark (in ``ids`` alone: a digit or an @)."""
    mark = _marks(text or "", ids)
    n = len(ids)
    starts = _starts(n)
    total = np.concatenate([[0], np.cumsum(mark)])
    return starts[total[np.minimum(starts + WINDOW, n)] > total[starts]]


class Tagger:
    """Embedding, two LSTMs, an output layer and CRF transitions; all in numpy."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "E": r.normal(0, 0.3, (CHARS, EMBED)),
            "F": r.normal(0, 0.25, (EMBED + HIDDEN + 1, 4 * HIDDEN)),
            "B": r.normal(0, 0.25, (EMBED + HIDDEN + 1, 4 * HIDDEN)),
            "O": r.normal(0, 0.25, (2 * HIDDEN + 1, TAGS)),
            "T": np.zeros((TAGS, TAGS)),
        }
        for k in "FB":
            self.p[k][-1, HIDDEN : 2 * HIDDEN] = 1.0  # remember at first
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _lstm(self, e, w, keep=False):
        n, length, _ = e.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, tape = np.empty((n, length, HIDDEN), np.float32), []
        one = np.ones((n, 1), np.float32)
        for t in range(length):
            x = np.concatenate([e[:, t], h, one], 1)
            z = x @ w
            s = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -20, 20)))
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            before = c
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[:, t] = h
            if keep:
                tape.append((x, i, f, o, g, before, tc))
        return out, tape

    def _lstm_back(self, d, tape, w):
        n, length, _ = d.shape
        gw, ge = np.zeros_like(w), np.empty((n, length, EMBED), np.float32)
        dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        for t in range(length - 1, -1, -1):
            x, i, f, o, g, before, tc = tape[t]
            dh = dh + d[:, t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
            gw += x.T @ dz
            dx = dz @ w.T
            ge[:, t], dh, dc = dx[:, :EMBED], dx[:, EMBED : EMBED + HIDDEN], dc * f
        return gw, ge

    def emissions(self, x, keep=False):
        e = self.p["E"][x]
        fwd, tf = self._lstm(e, self.p["F"], keep)
        bwd, tb = self._lstm(e[:, ::-1], self.p["B"], keep)
        h = np.concatenate([fwd, bwd[:, ::-1], np.ones((*x.shape, 1), np.float32)], 2)
        return h @ self.p["O"], (h, tf, tb)

    def gradient(self, x, y, size):
        """Mean negative log likelihood of the tags under the CRF, and its gradient."""
        n, length = x.shape
        s, (h, tf, tb) = self.emissions(x, True)
        s, t = s.astype(float), self.p["T"].astype(float)
        inside = np.arange(length)[None, :] < size[:, None]
        a, b = np.zeros((n, length, TAGS)), np.zeros((n, length, TAGS))
        a[:, 0] = s[:, 0]
        for k in range(1, length):
            z = a[:, k - 1][:, :, None] + t
            m = z.max(1)
            a[:, k] = np.where(inside[:, k, None], m + np.log(np.exp(z - m[:, None]).sum(1)) + s[:, k], a[:, k - 1])
        m = a[:, -1].max(1)
        log_z = m + np.log(np.exp(a[:, -1] - m[:, None]).sum(1))
        for k in range(length - 2, -1, -1):
            z = t[None] + (s[:, k + 1] + b[:, k + 1])[:, None, :]
            m = z.max(2)
            b[:, k] = np.where(inside[:, k + 1, None], m + np.log(np.exp(z - m[:, :, None]).sum(2)), b[:, k + 1])
        p = np.exp(np.clip(a + b - log_z[:, None, None], -50, 0)) * inside[:, :, None]
        pair = a[:, :-1, :, None] + t + (s[:, 1:] + b[:, 1:])[:, :, None, :] - log_z[:, None, None, None]
        gt = (np.exp(np.clip(pair, -50, 0)) * inside[:, 1:, None, None]).sum((0, 1))
        np.add.at(gt, (y[:, :-1][inside[:, 1:]], y[:, 1:][inside[:, 1:]]), -1.0)
        ds = p
        ds[np.arange(n)[:, None], np.arange(length)[None], y] -= inside
        ds = (ds / n).astype(np.float32)
        g = {"T": (gt / n).astype(np.float32), "O": h.reshape(-1, h.shape[2]).T @ ds.reshape(-1, TAGS)}
        dh = ds @ self.p["O"].T
        g["F"], e1 = self._lstm_back(dh[:, :, :HIDDEN], tf, self.p["F"])
        g["B"], e2 = self._lstm_back(dh[:, ::-1, HIDDEN : 2 * HIDDEN], tb, self.p["B"])
        g["E"] = np.zeros_like(self.p["E"])
        np.add.at(g["E"], x, e1 + e2[:, ::-1])
        return g

    def fit(self, x, y, size, steps: int = 700, batch: int = 64, rate: float = 0.015):
        """Adam on shuffled batches, for whole passes of ``steps`` batches in all at least."""
        r = np.random.default_rng(11)
        epochs = -(-steps // -(-len(x) // batch))
        m, v, step = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), batch):
                at = order[i : i + batch]
                g = self.gradient(x[at], y[at], size[at])
                step += 1
                for k in self.p:
                    d = np.clip(g[k], -5, 5)
                    m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.99 * v[k] + 0.01 * d * d
                    self.p[k] = self.p[k] - (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self

    def decode(self, x, size):
        """Viterbi tags of windows; beyond ``size`` they mean nothing."""
        s, _ = self.emissions(x)
        n, length = x.shape
        best, back = s[:, 0], np.zeros((n, length, TAGS), np.int8)
        for k in range(1, length):
            z = best[:, :, None] + self.p["T"]
            back[:, k] = z.argmax(1)
            best = np.where((k < size)[:, None], z.max(1) + s[:, k], best)
            back[:, k] = np.where((k < size)[:, None], back[:, k], np.arange(TAGS))
        tags = np.empty((n, length), np.int8)
        tags[:, -1] = best.argmax(1)
        for k in range(length - 1, 0, -1):
            tags[:, k - 1] = back[np.arange(n), k, tags[:, k]]
        return tags


def _cut(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((len(starts), WINDOW), np.int32)
    size = np.minimum(len(ids) - starts, WINDOW)
    at = starts[:, None] + np.arange(WINDOW)
    ok = at < len(ids)
    x[ok] = ids[at[ok]]
    return x, size


def _spans_of(tags: np.ndarray, starts: np.ndarray, sizes: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """Runs of a tag over the whole text, from the windows' tags: the most central window decides."""
    whole, near = np.zeros(n, np.int8), np.full(n, WINDOW, np.int32)
    for t, s, z in zip(tags, starts, sizes, strict=True):
        gap = np.abs(2 * np.arange(z) - (WINDOW - 1))
        better = gap < near[s : s + z]
        whole[s : s + z][better] = t[:z][better]
        near[s : s + z][better] = gap[better]
    step = np.flatnonzero(np.diff(np.concatenate([[0], whole, [0]])))
    return [(int(i), int(whole[i]) - 1, int(j)) for i, j in zip(step, step[1:], strict=False) if whole[i]]


def _runs(tags: np.ndarray) -> np.ndarray:
    """(start, tag, end) of the runs of equal tags other than 0."""
    step = np.flatnonzero(np.diff(np.concatenate([[0], tags, [0]])))
    runs = np.stack([step[:-1], tags[step[:-1]], step[1:]], 1) if len(step) else np.zeros((0, 3), np.int64)
    return runs[runs[:, 1] > 0]


def tagged(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of the runs of a tag that hold a mark, as if all windows of the texts were decoded. A window that isn't decoded
    yet tags its middle -1; where a run with a mark meets one, windows from there on are decoded next, each time twice as many."""
    ids = [_ids(t) for t in texts]
    marks = [_marks(t, i) for t, i in zip(texts, ids, strict=True)]
    tags = [np.full(len(i), -1, np.int8) for i in ids]
    need = [np.unique(_deciding(np.flatnonzero(m), len(m))) if len(m) else np.zeros(0, np.int64) for m in marks]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    going = [k for k, w in enumerate(need) if len(w)]
    grow = 1
    while going:
        pieces = [_cut(ids[k], need[k] * STRIDE) for k in going]
        x, size = (np.concatenate(p) for p in zip(*pieces, strict=True))
        got = np.concatenate([tagger.decode(x[i : i + 4096], size[i : i + 4096]) for i in range(0, len(x), 4096)])
        at, further = 0, []
        for k in going:
            n, last = len(ids[k]), len(_starts(len(ids[k]))) - 1
            for w in need[k]:
                s = w * STRIDE
                a, z = (s + (WINDOW - STRIDE) // 2 if w else 0), (s + (WINDOW + STRIDE) // 2 if w < last else n)
                tags[k][a:z] = got[at, a - s : z - s]
                at += 1
            total = np.concatenate([[0], np.cumsum(marks[k])])
            runs = _runs(tags[k])
            runs = runs[total[runs[:, 2]] > total[runs[:, 0]]]
            left, right = (e[(e >= 0) & (e < n)] for e in (runs[:, 0] - 1, runs[:, 2]))
            left, right = (_deciding(e[tags[k][e] < 0], n)[:, None] for e in (left, right))
            more = np.unique(np.concatenate([(left - np.arange(grow)).ravel(), (right + np.arange(grow)).ravel()]))
            more = more[(more >= 0) & (more <= last)]
            middle = np.minimum(more * STRIDE + WINDOW // 2, n - 1)
            need[k] = more[tags[k][np.where(more, middle, 0)] < 0]
            if len(need[k]):
                further.append(k)
            else:
                out[k] = [(int(i), int(t) - 1, int(j)) for i, t, j in runs]
        going, grow = further, 2 * grow
    return out


def hash_bound(sample: int, n: int) -> int:
    """Below it lie the hashes, modulo ``WIDE``, of about ``sample`` of ``n`` texts."""
    return int(WIDE * min(1.0, sample / max(n, 1)))


def fit(docs: DataFrame, sample: int = 3000, most_windows: int = 8000) -> Tagger | None:
    """A tagger trained on the base spans of at most about ``sample`` different texts, chosen by hash: on
    all windows with a mark of their whole texts and of disguised spans, or by hash ``most_windows`` of these where there are more."""
    marked = docs.where(F.col("text").rlike("[0-9@]")).select("text")  # no other text has a base span
    chosen = marked.where(F.pmod(F.xxhash64("text"), F.lit(WIDE)) < hash_bound(sample, marked.count())).distinct()  # copies have one hash: all or none

    def label(batches):
        for b in batches:
            out = [[], [], []]
            for text in b.column(0).to_pylist():
                ids = _ids(text)
                tag = np.zeros(len(ids), np.int8)
                for start, kind, end in reversed(base_spans(text)):
                    tag[start:end] = kind + 1
                pieces = [(text, ids, tag)]
                r = np.random.default_rng(zlib.crc32(text.encode("utf-8", "replace")))
                for start, kind, end in base_spans(text):
                    for _ in range(DISGUISES):
                        new = disguises(kind, text[start:end], r)
                        a, z = max(0, start - int(r.integers(20, WINDOW))), end + int(r.integers(20, WINDOW))
                        piece = text[a:start] + new + text[end:z]
                        pieces.append((piece, _ids(piece), np.concatenate([tag[a:start], np.full(len(new), kind + 1, np.int8), tag[end:z]])))
                for piece, ids, tag in pieces:
                    starts = _windows(ids, piece)
                    x, size = _cut(ids, starts)
                    y, _ = _cut(tag, starts)
                    for part, v in zip(out, (x, y.astype(np.int8), size), strict=True):
                        part.extend(row.tobytes() if part is not out[2] else int(row) for row in v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())], ["x", "y", "size"])

    got = chosen.mapInArrow(label, "x binary, y binary, size bigint").orderBy(F.xxhash64("x", "y"), "x").limit(most_windows).toPandas()
    if not len(got):
        return None
    x, y = np.frombuffer(b"".join(got["x"]), np.int32).reshape(-1, WINDOW), np.frombuffer(b"".join(got["y"]), np.int8).reshape(-1, WINDOW).astype(np.int64)
    return Tagger().fit(x, y, got["size"].to_numpy()) if y.any() else None


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def find(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """``docs`` with base and spans (kind, start, end) from its column text."""
    docs = docs.drop("base", "spans")
    at_text = docs.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(model.p if model else None)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        tagger = Tagger() if sent.value else None
        if tagger:
            tagger.p = sent.value
        for b in batches:
            base, every = [[] for _ in range(b.num_rows)], [[] for _ in range(b.num_rows)]
            for i in range(0, b.num_rows, 256):
                texts = [t or "" for t in b.column(at_text).slice(i, 256).to_pylist()]
                runs = tagged(tagger, texts) if tagger else [[] for _ in texts]
                for r, text, found in zip(range(i, i + len(texts)), texts, runs, strict=True):
                    base[r] = base_spans(text)
                    taken = np.zeros(len(text) + 1, np.int64)
                    for s, _, e in base[r]:
                        taken[s:e] = 1
                    new = [x for x in (trimmed(text, *f) for f in found) if not taken[x[0] : x[2]].any() and holds(x[1], text[x[0] : x[2]])]
                    every[r] = sorted(base[r] + new)
            named = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(map(named, base), kind), pa.array(map(named, every), kind)], [*b.schema.names, "base", "spans"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *StructType.fromDDL(f"base {SPANS}, spans {SPANS}").fields]))


def redact(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """``docs`` with each span of its column text replaced by its kind in angle brackets."""
    found = find(packed(docs), model)
    pieces = F.transform(
        "spans",
        lambda s, i: F.concat(
            F.substring(F.col("text"), F.when(i == 0, 1).otherwise(F.get("spans", i - 1)["end"] + 1).cast("int"), F.greatest(F.lit(0), s["start"] - F.when(i == 0, 0).otherwise(F.get("spans", i - 1)["end"])).cast("int")),
            F.lit("<"),
            s["kind"],
            F.lit(">"),
        ),
    )
    rest = F.substring(F.col("text"), (F.element_at("spans", -1)["end"] + 1).cast("int"), F.length("text"))
    text = F.when(F.size("spans") > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col("text"))
    return unpacked(found, docs, text)


def query(spark, sf_dir):
    from chronoline.llm.common import table

    docs = columns(table(spark, sf_dir, "documents"), doc_id=("doc_id", "bigint"), text=("text", "string"))
    found = find(docs, fit(docs))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *map(n, KINDS), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
