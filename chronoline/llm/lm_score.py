"""Language-model scores from a hashed maximum-entropy model with class-factored softmax.

A text's tokens are its lower-cased words and one end. P(word | past) = P(class | past) *
P(word | class, past). A word's class is its last two bytes, where they are among the most frequent
endings of the training words; the rest share a class and the end has its own. Of each class the
31 most frequent words have names; the others are the class's rest.

Both factors are softmaxes over hashed features. P(class | past): the word before (by itself for the
32 most frequent words, else by its class), the classes two and three before, their n-grams and
skips. P(name | class, past), where one name stands for the rest: the class, the class before,
the named word before, and the class two before (the seven most frequent endings, or another), their n-grams and skips, each
within the class.

Words without a name are told apart by a tree: within its class, a word is found by three digits of 32, which are its third byte from the
end, its first byte and five bits of its hash. P(digit | class, digits before, past) is a softmax again, so every word of any
vocabulary is an outcome that answers to the past. A leaf of the tree is nearly always one word of the training texts; where
it holds several, they have add-one counts, with one unknown word per leaf, so all probabilities of a step sum to 1.

Every word, named or not, is a feature by its own hash: of the class, of the name within the class, and of each digit at its node,
the last two beside the class before. These weights, ``SPREAD`` rows in all, start from the two factors above, and in the tree from
the leaves' counts, and are learnt in one pass over all training texts, token by token, since contexts of two words would move several times the
text: a partition takes gradient steps by itself, and a weight is the partitions' mean, each counted by how often it met the row.

Counts of words, endings and of (context, outcome) cover all training documents; each is combined
within a task (words beyond ``KEPT`` by every ``WAIT`` of their tokens), then by a shuffle over all reducers. The weights are fitted by
gradient steps that run over the partitions of the context counts, each packed into one row of arrays; a step sends one gradient per partition (one for
``PER_PART`` rows, at most ``PARTS``, of 2 MB each). The weights, 2 MB for each factor at any size of the corpus, go to the tasks, which work out
the probabilities of the contexts that they meet; so do the weights of words, 8 MB, and the tree's counts, 4 MB. Texts are scored in numpy batches. The most frequent words, at most ``head`` of
them, go to the tasks as a table; all other words' counts are joined by shuffle, a row per
document and word, so a vocabulary of any size is scored exactly.

Also returned: base_score, the add-one unigram log10 probability over the same counts.

Defined results: null text counts as empty and scores its end; a null doc_id is its own empty
text in the fold rule; equal rows score equally; texts of any length are scored whole, a slab at
a time; without training documents the classes and digits are uniform; an empty table gives an empty result;
columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoline.llm.common import columns, cut, sized
from chronoline.llm.textcols import GOLD, Words, mix, slabs

CLASSES, OTHER, END = 32, 30, 31
NAMES, REST, TOP = 32, 31, 32
ROWS, PARTS, PER_PART, CHUNK = 1 << 14, 8, 400_000, 1 << 14
#: contexts of the two factors: (word or class before, classes two and three before);
#: (class, class and name before, one of ``TWO`` classes two before)
TWO = 8
#: weight rows of all words, leaves of a class, tokens worked on at once and in a gradient step, tokens of a learner
SPREAD, LEAVES, PIECE, STEP, PER_LEARNER = 1 << 16, 1 << 15, 1 << 17, 1 << 11, 4_000_000
#: words that a task counts in place, and tokens of other words that wait
KEPT, WAIT = 1 << 20, 1 << 19
PAST, INSIDE = (TOP + CLASSES) * CLASSES * CLASSES, CLASSES * CLASSES * NAMES * TWO


def _ending(w: Words) -> np.ndarray:
    return w.low[w.end - 1].astype(np.int64) + 256 * w.low[np.maximum(w.end - 2, w.start)].astype(np.int64)


def _leaf(w: Words) -> np.ndarray:
    """The three digits by which words are found within their class."""
    return (w.low[np.maximum(w.end - 3, w.start)] & 31).astype(np.int64) << 10 | (w.low[w.start] & 31).astype(np.int64) << 5 | (w.h >> np.uint64(59)).astype(np.int64)


def _hashed(parts: list[np.ndarray]) -> np.ndarray:
    """(contexts, features): the weight row of each feature, by hash."""
    return np.stack([(mix(p.astype(np.uint64) + np.uint64((k + 1) * int(GOLD) & 0xFFFFFFFFFFFFFFFF)) % np.uint64(ROWS)).astype(np.int64) for k, p in enumerate(parts)], 1)


def _features(at: np.ndarray, inside: bool) -> np.ndarray:
    """The weight rows of contexts of a factor."""
    if inside:
        c, c1, s1, c2 = at // (INSIDE // CLASSES), at // (NAMES * TWO) % CLASSES, at // TWO % NAMES, at % TWO
        word = (c * CLASSES + c1) * NAMES + s1
        return _hashed([c, c * CLASSES + c1, word, at, c * TWO + c2])
    s1, c2, c3 = at // (CLASSES * CLASSES), at // CLASSES % CLASSES, at % CLASSES
    return _hashed([s1, s1 * CLASSES + c2, at, c2, c3, s1 * CLASSES + c3])


class Places:
    """Where 64-bit hashes are among sorted ones, found by their first bits."""

    def __init__(self, h: np.ndarray):
        self.h, self.shift = h, np.uint64(64 - max(1, len(h) * 4 - 1).bit_length())
        self.first = np.append(np.searchsorted(h, np.arange(1 << 64 - int(self.shift), dtype=np.uint64) << self.shift), len(h)).astype(np.int32)

    def of(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash; -1: none."""
        b = (h >> self.shift).astype(np.intp)
        at, end, out = np.take(self.first, b), np.take(self.first, b + 1), np.full(len(h), -1)
        left = np.flatnonzero(at < end)
        while len(left):
            hit = self.h[at[left]] == h[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


class Names:
    """Class and name of words: the named words' hashes (sorted), their names and their overall rank (``TOP``
    and over: none), and the class of every ending."""

    def __init__(self, classes: np.ndarray, h: np.ndarray, name: np.ndarray, rank: np.ndarray):
        order = np.argsort(h)
        self.classes, self.h, self.name, self.rank = classes, h[order], np.append(name[order], REST), np.append(rank[order], TOP)  # -1: none
        self.places = Places(self.h)

    def of(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, name, symbol) of each word; a symbol is a word of the ``TOP`` or a class."""
        c = self.classes[_ending(w)].astype(np.int64)
        if not len(self.h):
            return c, np.full(len(w), REST), c + TOP
        at = self.places.of(w.h)
        rank = self.rank[at]
        return c, self.name[at], np.where(rank < TOP, rank, c + TOP)

    def contexts(self, w: Words):
        """Of the words and one end per document, in order: class, name, past and inside; documents; where the words are; the
        word before (by hash) and its class; the digits (0 for ends)."""
        n = len(w.first) - 1
        size = np.diff(w.first) + 1
        total = len(w) + n
        is_word = np.ones(total, bool)
        is_word[np.cumsum(size) - 1] = False
        c, s, y = np.full(total, END), np.full(total, REST), np.full(total, END + TOP)
        c[is_word], s[is_word], y[is_word] = self.of(w)
        doc = np.repeat(np.arange(n), size)

        def before(v, k, edge):
            out = np.full(total, edge)
            if total > k:
                same = doc[k:] == doc[:-k]
                out[k:][same] = v[:-k][same]
            return out

        c2 = before(c, 2, END)
        past = (before(y, 1, END + TOP) * CLASSES + c2) * CLASSES + before(c, 3, END)
        inside = ((c * CLASSES + before(c, 1, END)) * NAMES + before(s, 1, REST)) * TWO + np.minimum(c2, TWO - 1)
        h, leaf = np.full(total, GOLD), np.zeros(total, np.int64)
        h[is_word], leaf[is_word] = w.h, _leaf(w)
        return c, s, past, inside, doc, is_word, before(h, 1, GOLD), before(c, 1, END), leaf


class Counts:
    """How often hashes occurred, and a code of each. Up to ``KEPT`` hashes are found by their place and counted there; the tokens of others wait,
    ``WAIT`` at most, to be sorted and then kept too or, where no more can be, given out."""

    def __init__(self):
        self.h, self.code, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.places, self.waiting, self.size = Places(self.h), [], 0

    def add(self, h: np.ndarray, code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for i in range(0, len(h), WAIT):
            at = self.places.of(h[i : i + WAIT])
            np.add.at(self.n, at, 1)  # -1, the last: another
            other = i + np.flatnonzero(at < 0)
            self.waiting.append((h[other], code[other]))
            self.size += len(other)
            if self.size > WAIT:
                yield from self.sort()

    def sort(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        h, code = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        order = np.argsort(h)
        h = h[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]) if len(h) else h)
        h, code, n = h[first], code[order[first]], np.diff(np.append(first, len(h)))
        self.waiting, self.size = [], 0
        if len(self.h) + len(h) > KEPT:
            yield h, code, n
        else:
            h, code, n = np.append(self.h, h), np.append(self.code, code), np.append(self.n[:-1], n)
            order = np.argsort(h)
            self.h, self.code, self.n = h[order], code[order], np.append(n[order], 0)
            self.places = Places(self.h)

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if self.waiting:
            yield from self.sort()
        yield self.h, self.code, self.n[:-1]


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, ending, n) over all whole texts; ending holds the digits too, above its 16 bits."""

    def run(batches):
        counts = Counts()

        def found():
            for b in batches:
                for _, raw, at in slabs(b.column(0)):
                    w = Words(raw, at, "space")
                    yield from counts.add(w.h, (_ending(w) | _leaf(w) << 16).astype(np.int32))
            yield from counts.rest()

        for h, code, n in found():
            for i in range(0, len(h), PIECE):
                k = slice(i, i + PIECE)
                yield pa.RecordBatch.from_arrays([pa.array(h[k].view(np.int64)), pa.array(code[k]), pa.array(n[k])], ["h", "ending", "n"])

    return texts.mapInArrow(run, "h bigint, ending int, n bigint").groupBy("h").agg(F.first("ending").alias("ending"), F.sum("n").alias("n"))


def context_counts(texts: DataFrame, names) -> DataFrame:
    """(inside, context, y, n): how often an outcome followed a context, in either factor; ``names`` is a broadcast. All outcomes of a
    context are in one partition, so that a gradient works out its probabilities once."""

    def run(batches):
        counts = np.zeros(PAST * CLASSES, np.int64), np.zeros(INSIDE * NAMES, np.int64)  # a row of a task for each key, however many texts it reads
        for b in batches:
            for _, raw, at in slabs(b.column(0)):
                c, s, past, inside, _, is_word, *_ = names.value.contexts(Words(raw, at, "space"))
                np.add.at(counts[0], past * CLASSES + c, 1)
                np.add.at(counts[1], (inside * NAMES + s)[is_word], 1)
        for k, n in enumerate(counts):
            keys = np.flatnonzero(n)
            for i in range(0, len(keys), PIECE):
                key = keys[i : i + PIECE]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), k == 1)), pa.array((key // 32).astype(np.int32)), pa.array((key % 32).astype(np.int32)), pa.array(n[key])], ["inside", "context", "y", "n"])

    return texts.mapInArrow(run, "inside boolean, context int, y int, n bigint").repartition("inside", "context").groupBy("inside", "context", "y").agg(F.sum("n").alias("n"))


def _log_odds(weights: np.ndarray, contexts: np.ndarray, inside: bool, valid: np.ndarray, features: np.ndarray | None = None) -> np.ndarray:
    """log P(y | context) for each context, (contexts, 32). ``valid`` says which names a class has; others have no probability."""
    z = np.zeros((len(contexts), 32), weights.dtype)
    for rows in (_features(contexts, inside) if features is None else features).T:
        z += weights[rows]
    if inside:
        z += np.where(valid, 0.0, -np.inf).astype(z.dtype)[contexts // (INSIDE // CLASSES)]
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def log_odds(weights: np.ndarray, contexts: np.ndarray, y: np.ndarray, inside: bool, valid: np.ndarray) -> np.ndarray:
    """log10 P(y | context) of tokens; a context is worked out once, ``CHUNK`` of them at a time."""
    out = np.empty(len(contexts))
    order = np.argsort(contexts, kind="stable")
    known, first = np.unique(contexts[order], return_index=True)
    first = np.append(first, len(order))
    for i in range(0, len(known), CHUNK):
        mine = order[first[i] : first[min(i + CHUNK, len(known))]]
        p = _log_odds(weights, known[i : i + CHUNK], inside, valid)
        out[mine] = p[np.searchsorted(known[i : i + CHUNK], contexts[mine]), y[mine]]
    return out / np.log(10)


def fit(seen: DataFrame, inside: bool, valid: np.ndarray, steps: int = 15, rate: float = 0.7) -> np.ndarray:
    """The weights of a factor, (ROWS, 32), from counts (context, y, n)."""
    weights, squares = np.zeros((ROWS, 32)), np.full((ROWS, 32), 1e-8)
    total = seen.agg(F.sum("n")).first()[0] or 0

    def pack(batches):
        cols = [np.concatenate(c) for c in zip(*[[b.column(k).to_numpy() for k in range(3)] for b in batches], strict=True)]
        if cols:
            order = np.argsort(cols[0], kind="stable")
            yield pa.RecordBatch.from_arrays([pa.array([c[order].astype(kind).tobytes()], pa.binary()) for c, kind in zip(cols, (np.int32, np.int8, np.int64), strict=True)], ["context", "y", "n"])

    # a row of arrays for each partition, sorted once; the steps read no rows of counts
    packed = cut(seen.select("context", "y", "n").mapInArrow(pack, "context binary, y binary, n binary")) if total else None
    for _ in range(steps if total else 0):
        sent = seen.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

        def gradient(batches, sent=sent):
            for context, y, n in (r for b in batches for r in zip(*b.columns, strict=True)):
                context, y, n = (np.frombuffer(c.as_buffer(), kind) for c, kind in zip((context, y, n), (np.int32, np.int8, np.int64), strict=True))
                first = np.flatnonzero(np.diff(context, prepend=-1))
                known, first = context[first], np.append(first, len(context))
                g = np.zeros(ROWS * 32)
                for i in range(0, len(known), CHUNK):
                    some = known[i : i + CHUNK].astype(np.int64)
                    a, z = first[i], first[min(i + CHUNK, len(known))]
                    d = -np.bincount(np.searchsorted(some, context[a:z]) * 32 + y[a:z], n[a:z], len(some) * 32).reshape(-1, 32)
                    features = _features(some, inside)
                    d -= np.exp(_log_odds(sent.value, some, inside, valid, features)) * d.sum(1, keepdims=True)
                    for f in features.T:
                        g += np.bincount((f[:, None] * 32 + np.arange(32)).ravel(), d.ravel(), ROWS * 32)
                yield pa.RecordBatch.from_arrays([pa.array([g.astype(np.float32).tobytes()], pa.binary())], ["g"])

        g = np.zeros((ROWS, 32))
        for r in packed.mapInArrow(gradient, "g binary").toLocalIterator():  # PARTS rows of fixed size, one at a time
            g += np.frombuffer(r["g"], np.float32).reshape(ROWS, 32)
        g = g / total * 1000 + 1e-3 * weights
        squares += g * g
        weights -= rate * g / np.sqrt(squares)
        sent.destroy()
    return weights.astype(np.float32)


def leaf_counts(counts: DataFrame, classes: np.ndarray) -> DataFrame:
    """(leaf, n, v): tokens and words of each class and digits."""

    def run(batches):
        for b in batches:
            code, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            leaf, at, v = np.unique(classes[code & 0xFFFF].astype(np.int64) * LEAVES + (code >> 16), return_inverse=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), pa.array(np.bincount(at, n, len(leaf)).astype(np.int64)), pa.array(v, pa.int64())], ["leaf", "n", "v"])

    return counts.select("ending", "n").mapInArrow(run, "leaf int, n bigint, v bigint").groupBy("leaf").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))


class Tree:
    """The logarithms of what the leaves of all classes weigh, and of each digit's share at each node."""

    def __init__(self, weight: np.ndarray):
        self.leaves = np.log10(weight).astype(np.float32)
        under = [weight.reshape(CLASSES * 32**k, 32, -1).sum(2) for k in range(3)]
        self.levels = [np.log(u / u.sum(1, keepdims=True)).astype(np.float32) for u in under]

    def shares(self) -> Tree:
        """The tree with shares for their logarithms."""
        out = copy(self)
        out.levels = [np.exp(x) for x in self.levels]
        return out


def _spread(part: np.ndarray, h: np.ndarray | int = 0) -> np.ndarray:
    """The hash of a feature with one part more."""
    return mix(np.uint64(3) * np.asarray(h, np.uint64) + GOLD + part.astype(np.uint64))


def _row(h: np.ndarray) -> np.ndarray:
    """The row among ``SPREAD`` of each feature."""
    return (h >> np.uint64(48)).astype(np.int64)


class Odds:
    """The log-odds of a factor's contexts, or their exponentials (``shares``), each worked out when a task first meets it: PAST or INSIDE
    rows of 128 bytes at most."""

    def __init__(self, weights: np.ndarray, inside: bool, valid: np.ndarray, shares: bool = False):
        self.weights, self.inside, self.valid, self.shares = weights, inside, valid, shares
        self.table = np.empty((INSIDE if inside else PAST, 32), np.float32)
        self.met = np.zeros(len(self.table), bool)

    def of(self, contexts: np.ndarray) -> np.ndarray:
        """A table with rows for these contexts."""
        new = np.unique(contexts[~self.met[contexts]])
        for i in range(0, len(new), CHUNK):
            z = _log_odds(self.weights, new[i : i + CHUNK], self.inside, self.valid)
            self.table[new[i : i + CHUNK]] = np.exp(z) if self.shares else z
        self.met[new] = True
        return self.table


def both(outer: np.ndarray, within: np.ndarray, valid: np.ndarray, shares: bool = False) -> tuple[Odds, Odds]:
    return Odds(outer, False, valid, shares), Odds(within, True, valid, shares)


def factors(tokens: tuple, outer: np.ndarray, within: np.ndarray, tree: Tree, valid: np.ndarray, odds: tuple[Odds, Odds] | None = None):
    """Of tokens in order, ``PIECE`` of them at a time: (tokens, log-odds without the words' weights, a function of a slice; the
    words' rows; outcomes) of each factor: class, name, and the three digits of words without a name. ``odds``, from ``both``,
    keeps what it worked out for the next tokens."""
    c, s, past, inside, _, is_word, word, c1, leaf = tokens
    first, second = odds or both(outer, within, valid)
    of_c1 = _spread(np.arange(CLASSES))
    for i in range(0, len(c), PIECE):
        every = np.arange(i, min(i + PIECE, len(c)))
        named = every[is_word[every]]
        rest = named[s[named] == REST]
        hashed = _spread(word[i : i + PIECE])
        for at, known, context, y in ((every, first, past, c), (named, second, inside, s)):
            of = context[at]
            table = known.of(of)
            rows = hashed if known is first else _spread(c[at] + 1, hashed[at - i])
            yield at, (lambda x, table=table, of=of: np.take(table, of[x], axis=0)), _row(rows)[:, None], y[at]
        path, own, beside = c[rest] * LEAVES + leaf[rest], hashed[rest - i], of_c1[c1[rest]]
        for k, counts in enumerate(tree.levels):
            node = path >> (15 - 5 * k)
            tag = node * 8 + (k + 2)
            rows = np.stack([_row(_spread(tag, own)), _row(_spread(tag + (1 << 40), beside))]).T
            yield rest, (lambda x, counts=counts, node=node: np.take(counts, node[x], axis=0)), rows, path >> (10 - 5 * k) & 31


def _with_words(z: np.ndarray, words: np.ndarray, rows: np.ndarray, more: np.ndarray | None = None) -> np.ndarray:
    """Log-odds, to which the words' weights are added in place. They start as logarithms of shares, and a weight stops growing where its outcome is
    certain, so their exponentials stay in range."""
    for f in rows.T:
        z += np.take(words, f, axis=0, out=more, mode="clip")
    return z


def word_weights(learnt: DataFrame, names, model, learners: int, rate: float = 1.0) -> np.ndarray:
    """The weights of words, (SPREAD, 32); ``model``, a broadcast, holds what ``factors`` takes after the tokens."""

    def run(batches):
        words, squares, met = np.zeros((SPREAD, 32), np.float32), np.ones(SPREAD), np.zeros(SPREAD, np.int64)
        pairs, flat, of_row, ones = words.view(np.complex64).reshape(-1), words.reshape(-1), np.arange(16), np.ones(32, np.float32)  # two weights are added at once
        more, places, begin, times = np.empty((STEP, 32), np.float32), np.empty((STEP, 16), np.intp), np.arange(STEP) * 32, np.zeros(SPREAD)
        outer, within, _, valid = model.value
        tables = both(outer, within, valid)
        for b in batches:
            for _, raw, at in slabs(b.column(0), 1 << 18):  # what a step reads stays in the processor's cache
                for _, odds, rows, y in factors(names.value.contexts(Words(raw, at, "space")), *model.value, tables):
                    met += np.bincount(rows.ravel(), minlength=SPREAD)
                    for i in range(0, len(y), STEP):
                        d = odds(slice(i, i + STEP))
                        n = len(d)
                        np.exp(_with_words(d, words, rows[i : i + STEP], more[:n]), out=d)
                        own, sums = y[i : i + STEP], d @ ones
                        if sums.max() > 1e15:  # their squares would leave the range
                            d /= sums[:, None]
                            sums = d @ ones
                        # shares are d / sums; a token's gradient is its shares less one for its outcome
                        length = np.maximum(np.multiply(d, d, out=more[:n]) @ ones / sums**2 - 2 * d.reshape(-1)[begin[:n] + own] / sums + 1, 0)
                        for f in rows[i : i + STEP].T:
                            np.add.at(times, f, 1.0)
                            np.add.at(squares, f, length * times[f])  # no less than the square of the row's summed gradient
                            times[f] = 0
                            pace = rate / np.sqrt(squares[f])
                            np.add.at(flat, f * 32 + own, pace.astype(np.float32))
                            np.multiply(d, (-pace / sums).astype(np.float32)[:, None], out=more[:n])
                            np.add((f * 16)[:, None], of_row, out=places[:n])
                            np.add.at(pairs, places[:n].reshape(-1), more[:n].view(np.complex64).reshape(-1))
        words *= met[:, None].astype(np.float32)
        for k in range(0, SPREAD, 1024):
            some = slice(k, k + 1024)
            if met[some].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([words[some].tobytes()], pa.binary()), pa.array([met[some].astype(np.float32).tobytes()], pa.binary())], ["k", "words", "met"])

    def mean(batches):
        sums = {}
        for b in batches:
            for k, words, met in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got = sums.setdefault(k, [np.zeros((1024, 32)), np.zeros(1024)])
                got[0] += np.frombuffer(words, np.float32).reshape(-1, 32)
                got[1] += np.frombuffer(met, np.float32)
        for k, (words, met) in sums.items():
            out = (words / np.maximum(met, 1)[:, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["k", "words"])

    out = np.zeros((SPREAD, 32), np.float32)
    sums = learnt.coalesce(learners).mapInArrow(run, "k int, words binary, met binary").repartition("k").mapInArrow(mean, "k int, words binary")
    for r in sums.toLocalIterator():  # 64 rows of fixed size
        out[r["k"] : r["k"] + 1024] = np.frombuffer(r["words"], np.float32).reshape(-1, 32)
    return out


def scored(batches, known: tuple[Places, np.ndarray], words: np.ndarray, names: Names, model: tuple):
    """Of (row, doc_id, text, held_out): tokens, those in the head, the sum of their logarithms, the rest of the score, and the words outside the head;
    ``known`` has the head's words and logarithms, with 0 at the end for others, ``words`` the exponentials of the words' weights."""
    places, logs = known
    outer, within, tree, valid = model
    of_model = outer, within, tree.shares(), valid, both(outer, within, valid, True)
    more, begin, ones = np.empty((STEP, 32), np.float32), np.arange(STEP) * 32, np.ones(32, np.float32)
    for b in batches:
        got = [[] for _ in range(6)]
        for _, raw, at in slabs(b.column(2)):
            w = Words(raw, at, "space")
            tokens = names.contexts(w)
            _, s, _, _, doc, is_word, *_ = tokens
            n = len(at) - 1
            at_head = places.of(w.h)
            found, value = at_head >= 0, logs[at_head]
            sum_logs = np.bincount(w.doc, value, n)
            cls = np.zeros(len(s))
            for mine, shares, rows, y in factors(tokens, *of_model):
                chosen, every = np.empty(len(y), np.float32), np.empty(len(y), np.float32)
                for i in range(0, len(y), STEP):
                    p = shares(slice(i, i + STEP))  # and the words' exponentials: none is worked out for a token
                    for f in rows[i : i + STEP].T:
                        p *= np.take(words, f, axis=0, out=more[: len(p)], mode="clip")
                    chosen[i : i + STEP] = p.reshape(-1)[begin[: len(p)] + y[i : i + STEP]]
                    np.matmul(p, ones, out=every[i : i + STEP])
                cls[mine] += np.log10(np.maximum(chosen, 1e-37) / every)
            rest = is_word & (s == REST)
            cls[rest] -= tree.leaves[tokens[0][rest] * LEAVES + tokens[-1][rest]]
            # a named word's own count is part of logs; it isn't in its probability
            cls[is_word & ~rest] -= value[(s != REST)[is_word]]
            tail = np.flatnonzero(~found)
            order = np.lexsort((w.h[tail], w.doc[tail]))
            d, t = w.doc[tail][order], w.h[tail][order]
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1])
            runs = np.flatnonzero(new)
            tf = np.diff(np.append(runs, len(d)))
            cuts = np.searchsorted(d[runs], np.arange(n + 1))
            got[0].append(np.diff(w.first) + 1)
            got[1].append(np.bincount(w.doc, found, n).astype(np.int64))
            got[2].append(sum_logs)
            got[3].append(np.bincount(doc, cls, n))
            kind = pa.struct([("h", pa.int64()), ("tf", pa.int64())])
            rows = pa.StructArray.from_arrays([pa.array(t[runs].view(np.int64)), pa.array(tf, pa.int64())], fields=list(kind))
            got[4].append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), rows))
        if got[0]:
            n_tokens, n_known, logs_head, cls = (np.concatenate(g) for g in got[:4])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(n_tokens, pa.int64()), pa.array(n_known), pa.array(logs_head), pa.array(cls), pa.concat_arrays(got[4])], ["row", "doc_id", "held_out", "n_tokens", "n_head", "logs", "cls", "tail"])


def scores(docs: DataFrame, fold: int = 7, held: int = 2, head: int = 1 << 18, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document,
    learnt from those whose crc32(doc_id as text) modulo ``fold`` is not ``held``."""
    docs = columns(docs, doc_id=(doc, "bigint"), text=(text, "string"))
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(fold)) == held
    learnt = docs.where(~held_out).select("text")
    n_docs = docs.where(~held_out).select("doc_id").count()
    counts = cut(word_counts(learnt))
    ends = counts.groupBy(F.col("ending").bitwiseAND(0xFFFF).alias("ending")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()  # 65,536 endings at most
    ends.sort(key=lambda r: (-r["n"], r["ending"]))
    classes = np.full(1 << 16, OTHER, np.int16)
    for k, r in enumerate(ends[:OTHER]):
        classes[r["ending"]] = k
    total, vocabulary = sum(r["n"] for r in ends) + n_docs, sum(r["v"] for r in ends) + (n_docs > 0)
    # the head: all words of at least this count, at most ``head`` of them
    spread = counts.groupBy(F.least(F.col("n"), F.lit(1_000_000)).alias("n")).agg(F.count("*").alias("v")).orderBy(F.desc("n")).collect()
    least, sofar = None, 0
    for r in spread:
        if sofar + r["v"] > head:
            break
        least, sofar = r["n"], sofar + r["v"]
    top = (counts.where(F.col("n") >= least) if least is not None else counts.limit(0)).select("h", "ending", "n").toArrow()
    h, n, code = top["h"].to_numpy().view(np.uint64), top["n"].to_numpy(), top["ending"].to_numpy()
    c = classes[code & 0xFFFF].astype(np.int64)
    order = np.argsort(h)
    known = Places(h[order]), np.append(np.log10(n[order] + 1.0), 0.0)
    # names: the most frequent words of each class
    order = np.lexsort((h, -n, c))
    place = np.arange(len(order)) - np.searchsorted(c[order], c[order])
    named = order[place < REST]
    rank = np.full(len(h), TOP)
    rank[np.lexsort((h, -n))[:TOP]] = np.arange(min(TOP, len(h)))
    leaves, valid = np.ones(CLASSES * LEAVES), np.zeros((CLASSES, NAMES), bool)  # a leaf weighs its words' counts, each with one, and one unknown
    got = leaf_counts(counts, classes).toArrow()  # CLASSES * LEAVES rows at most
    leaves[got["leaf"].to_numpy()] += got["n"].to_numpy() + got["v"].to_numpy()
    np.subtract.at(leaves, c[named] * LEAVES + (code[named] >> 16), n[named] + 1)
    valid[:, REST] = True
    valid[c[named], place[place < REST]] = True
    names = docs.sparkSession.sparkContext.broadcast(Names(classes, h[named], place[place < REST], rank[named]))
    del top, h, n, c, code, order, place, got
    seen, got = sized(context_counts(learnt, names))  # at most (PAST + INSIDE) * 32 rows; parts of a context add up
    seen = seen.coalesce(max(1, min(PARTS, got["n"] // PER_PART)))
    outer = fit(seen.where("NOT inside").drop("inside"), False, valid)
    within = fit(seen.where("inside").drop("inside"), True, valid)
    tree = Tree(leaves)  # P(word | leaf) has c + 1 over the leaf's weight
    model = docs.sparkSession.sparkContext.broadcast((outer, within, tree, valid))
    sent = docs.sparkSession.sparkContext.broadcast((known, np.exp(word_weights(learnt, names, model, max(1, -(-total // PER_LEARNER))))))
    base_of, end_base = np.log10(total + vocabulary + 1.0), np.log10(n_docs + 1.0)

    def run(batches):
        known, words = sent.value
        return scored(batches, known, words, names.value, model.value)

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", held_out.alias("held_out"))
    part = numbered.mapInArrow(run, "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_head bigint, logs double, cls double, tail array<struct<h:bigint,tf:bigint>>")
    part = cut(part)
    rest = part.select("row", F.explode("tail").alias("t")).select("row", "t.h", "t.tf").join(counts.select("h", "n"), "h")
    rest = rest.groupBy("row").agg(F.sum("tf").alias("n_tail"), F.sum(F.col("tf") * F.log10(F.col("n") + 1.0)).alias("logs_tail"))
    out = part.drop("tail").join(rest, "row", "left")
    logs = F.col("logs") + F.coalesce("logs_tail", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_tail", F.lit(0)) + F.lit(1 if n_docs else 0)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (logs + F.lit(float(end_base)) - F.col("n_tokens") * F.lit(float(base_of))).alias("base_score"),
        (logs + F.col("cls")).alias("score"),
    )


def query(spark, sf_dir):
    from chronoline.llm.common import table

    return scores(table(spark, sf_dir, "documents"))
