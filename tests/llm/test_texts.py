"""Licenses, benchmark passages, personal data, toxicity, language model, chats and mixing."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoline.llm import chat_format, decontaminate, licenses, lm_score, mixing, pii, toxicity
from chronoline.llm.textcols import Words, word_hash

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def test_words_match_regex(lower):
    texts = ["Ab1 é-x  ", "", "a", "b", "\tÀ.b\n", "x" * 70, "snow☃man 3"]
    raw = [t.encode() for t in texts]
    at = np.cumsum([0, *map(len, raw)])
    buf = np.frombuffer(b"".join(raw), np.uint8)
    for kind, pattern in (("space", r"[^\x20\x09-\x0D]+"), ("alnum", WORD)):
        w = Words(buf, at, kind)
        want = [re.findall(pattern, lower(t)) for t in texts]
        assert list(np.diff(w.first)) == [len(x) for x in want]
        assert [int(h) for h in w.h] == [word_hash(x) for ws in want for x in ws]


@pytest.mark.parametrize("shuffle", [False, True])
def test_licenses(docs_of, lower, shuffle):
    r = random.Random(2)
    parts = [*licenses.PHRASES.values(), "Under the MIT", "license", "cc by", "nc", "apache license Version 2", "noise", "é"]
    pairs = [(k, " ".join(r.choice(parts) for _ in range(r.randrange(12)))) for k in range(60)] + [(90, None), (91, ""), (92, "cc--by, (NC)"), (93, licenses.TEMPLATES["bsd"].replace("binary", "both binary")), (93, "cc by nc")]
    got = licenses.scan(docs_of(pairs), shuffle=shuffle).collect()
    seen = sorted((x["doc_id"], x["n_words"], sorted((p["label"], p["start"]) for p in x["places"])) for x in got)
    want = []
    for d, t in pairs:
        w = re.findall(WORD, lower(t))
        want.append((d, len(w), sorted((label, i) for label, p in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())))
    assert seen == sorted(want)
    bsd = [x for x in got if x["doc_id"] == 93 and x["n_words"] > 10][0]["regions"]
    assert [x["label"] for x in bsd] == ["bsd"] and bsd[0]["score"] > 0.8
    # regions by brute force: neighbouring diagonals of a template, with the share of its word triples
    for x, (_, t) in zip(sorted(got, key=lambda x: (x["doc_id"], x["n_words"])), sorted(pairs, key=lambda p: (p[0], len(re.findall(WORD, lower(p[1]))))), strict=True):
        w, regions = re.findall(WORD, lower(t)), []
        for label, text in licenses.TEMPLATES.items():
            h = text.split()
            votes = sorted((i - p, p, i) for i in range(len(w) - 2) for p in range(len(h) - 2) if w[i : i + 3] == h[p : p + 3])
            groups = []
            for v in votes:
                if groups and v[0] - groups[-1][-1][0] <= 5:
                    groups[-1].append(v)
                else:
                    groups.append([v])
            for g in groups:
                score = len({p for _, p, _ in g}) / (len(h) - 2)
                if score >= 0.5:
                    regions.append((min(i for *_, i in g), label, max(i for *_, i in g) + 3, round(score, 9)))
        assert [(r["start"], r["label"], r["end"], round(r["score"], 9)) for r in x["regions"]] == sorted(regions)


def test_decontamination(docs_of, spark, prose, monkeypatch):
    r = random.Random(6)
    item = " ".join(f"w{k}" for k in range(30))
    items = spark.createDataFrame([(1, item), (2, item.upper()), (3, "tiny one"), (4, None), (5, ""), (6, prose(r, 25))], "item_id long, text string")
    changed = item.split()
    changed[9] = changed[19] = "other"
    pairs = [(0, prose(r, 50)), (1, prose(r, 20) + " " + item + " " + prose(r, 20)), (2, prose(r, 9) + " " + " ".join(changed)), (3, " ".join(item.split()[:10])), (4, "x tiny one y"), (5, None), (6, ""), (6, item), (7, " ".join(item.split()[8:]))]
    want = {(0, ()), (1, (1, 2)), (2, (1, 2)), (3, ()), (4, (3,)), (5, ()), (6, ()), (6, (1, 2)), (7, (1, 2))}
    few = decontaminate.overlaps(docs_of(pairs), items)
    assert {(x["doc_id"], tuple(h["item"] for h in x["hits"])) for x in few.collect()} == want
    many = decontaminate.overlaps(docs_of(pairs), items, most_seeds=0)  # by shuffle
    key = lambda df: sorted((x["doc_id"], x["n_words"], sorted((h["item"], h["start"], h["end"], h["words"]) for h in x["hits"])) for x in df.collect())
    assert key(few) == key(many)
    assert decontaminate.overlaps(docs_of(pairs), items.limit(0)).where("size(hits) > 0").count() == 0


def test_masks_hit_thirteen_words_with_two_replaced():
    for i in range(13):
        for j in range(i):
            assert any(all(m[k] == "0" or at + k not in (i, j) for k in range(len(m))) for m in decontaminate.MASKS for at in range(14 - len(m)))


def plain_overlaps(text, items, lower):
    """Every item that an alignment of at least 13 words (or all of a shorter item) with 80 % equal words meets."""
    w, out = re.findall(WORD, lower(text)), {}
    for k, t in items:
        h = re.findall(WORD, lower(t))
        need = min(13, len(h))
        for diagonal in range(-len(h), len(w)):
            e = [w[diagonal + p] == h[p] if 0 <= diagonal + p < len(w) else None for p in range(len(h))]
            for i in range(len(h)):
                for j in range(i + need, len(h) + 1):
                    if need and e[i] and e[j - 1] and None not in e[i:j] and sum(e[i:j]) >= 0.8 * (j - i) - 1e-9:
                        out[k] = True
    return sorted(out)


def test_decontamination_by_brute_force(docs_of, spark, lower):
    r = random.Random(21)
    words = [f"v{k}" for k in range(400)]
    items = [(k, " ".join(r.choice(words) for _ in range(n))) for k, n in enumerate((40, 30, 25, 14, 13, 60))]
    pairs = []
    for d in range(60):
        t = [r.choice(words) for _ in range(30)]
        if d % 3:
            own = r.choice(items)[1].split()
            n = r.randrange(10, 20)
            at = r.randrange(max(1, len(own) - n))
            piece = own[at : at + n]
            for _ in range(r.randrange(3)):
                piece[r.randrange(len(piece))] = "other"
            t[7:7] = piece
        pairs.append((d, " ".join(t)))
    got = {x["doc_id"]: [h["item"] for h in x["hits"]] for x in decontaminate.overlaps(docs_of(pairs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {d: plain_overlaps(t, items, lower) for d, t in pairs}
    assert sum(map(bool, got.values())) > 20


def test_longest_stretch():
    r = random.Random(1)
    for _ in range(200):
        e = np.array([r.random() < 0.6 for _ in range(r.randrange(1, 30))])
        best = max((j - i for i in range(len(e)) for j in range(i + 1, len(e) + 1) if e[i] and e[j - 1] and e[i:j].mean() >= 0.8 - 1e-9), default=0)
        i, j = decontaminate.stretch(e, 0.8)
        assert j - i == best and (not best or (e[i] and e[j - 1] and e[i:j].mean() >= 0.8 - 1e-9))


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(t):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, t):
            g = re.sub("[^0-9]", "", m[0])
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 14 <= len(g) <= 19 and pii.luhn(g) or k == 3 and 10 <= len(g) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans():
    r = random.Random(12)
    tokens = ["a", "b.", "@", "x-y", ".com", "1", "23", "255", "256", ".", " ", "-", "+", "(", ")", "é", "4111111111111111", "192.168.0.1", "+1 (555) 123-4567", "me@ex.org", "00001"]
    for _ in range(3000):
        t = "".join(r.choice(tokens) for _ in range(r.randrange(14)))
        assert pii.base_spans(t) == plain_spans(t), t
    assert pii.base_spans("a" * 200_000 + "1" * 200_000) == []
    assert pii.base_spans("0" * 5000 + ".1.1.1") == [(0, 1, 5006)] and pii.base_spans("9" * 5000 + ".1.1.1") == []


def test_pii_model_and_redaction(docs_of):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8)))
    pairs = [(k, f"é {word()} {word()} mail {word()}@{word()}.org {word()} 4111111111111111 ok" if k % 2 else f"{word()} {word()} nothing") for k in range(120)] + [(900, None), (901, ""), (902, "call +1 (555) 123-4567 now, ip 10.0.0.1")]
    docs = docs_of(pairs)
    model = pii.fit(docs)
    found = {x["doc_id"]: x for x in pii.find(docs, model).collect()}
    for d, t in pairs:
        base = [(s["start"], pii.KINDS.index(s["kind"]), s["end"]) for s in found[d]["base"]]
        assert base == plain_spans(t or "")
        assert {tuple(s) for s in found[d]["base"]} <= {tuple(s) for s in found[d]["spans"]}
    clean = {x["doc_id"]: x["text"] for x in pii.redact(docs, None).collect()}
    assert clean[902] == "call <phone> now, ip <ip>" and clean[900] is None and clean[901] == ""
    assert "@" not in clean[1] and clean[1].startswith("é ") and clean[1].endswith("<card> ok") and clean[0] == pairs[0][1]
    assert pii.find(docs_of([(1, "no marks")]), pii.fit(docs_of([(1, "no marks")]))).first()["spans"] == []
    # learned spans find the addresses of texts that were not in the sample
    ids = [pii._ids(f"é {word()} {word()} mail {word()}@{word()}.org {word()} 4111111111111111 ok") for k in range(40)]
    hits = sum(any(k == 0 for _, k, _ in pii._spans_of(model.decode(*pii._cut(i, pii._windows(i))), pii._windows(i), pii._cut(i, pii._windows(i))[1], len(i))) for i in ids)
    assert hits >= 30


def test_tagger_gradient():
    """Backpropagation through both LSTMs and the CRF equals finite differences."""
    r = np.random.default_rng(0)
    t = pii.Tagger()
    t.p = {k: v.astype(float) for k, v in t.p.items()}
    t.p["T"] = r.normal(size=(pii.TAGS, pii.TAGS)) * 0.3
    x, size, y = r.integers(1, 98, (3, 6)), np.array([6, 4, 1]), r.integers(0, pii.TAGS, (3, 6))
    for i, n in enumerate(size):
        x[i, n:] = y[i, n:] = 0

    def loss():
        s, _ = t.emissions(x)
        total = 0.0
        for i, n in enumerate(size):
            a, gold = s[i, 0].astype(float), s[i, 0, y[i, 0]]
            for k in range(1, n):
                a = np.log(np.exp(a[:, None] + t.p["T"]).sum(0)) + s[i, k]
                gold += t.p["T"][y[i, k - 1], y[i, k]] + s[i, k, y[i, k]]
            total += np.log(np.exp(a).sum()) - gold
        return total / 3

    g = t.gradient(x, y, size)
    for k in t.p:
        at = tuple(r.integers(0, n) for n in t.p[k].shape) if k != "E" else (x[0, 2], 3)
        old, h = t.p[k][at], 1e-3
        t.p[k][at] = old + h
        up = loss()
        t.p[k][at] = old - h
        down = loss()
        t.p[k][at] = old
        assert abs((up - down) / (2 * h) - g[k][at]) < 1e-4


def test_pii_and_toxicity_keep_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "mail a@b.org", "p", "s", "x", "y"), (2, None, "p", "s", "x", "y")], "doc_id long, text string, predicted string, spans string, base string, `sco.re` string")
    out = pii.redact(docs, None)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["text"], r["predicted"], r["spans"], r["base"]) for r in out.collect()) == [(1, "mail <email>", "p", "s", "x"), (2, None, "p", "s", "x")]
    scored = toxicity.score(docs, None)
    assert {r["predicted"] for r in scored.collect()} == {0} and {r["spans"][0] if r["spans"] else None for r in scored.collect()} == {None}


def test_pii_sample_of_a_huge_corpus(docs_of):
    """A share far below one in a million still takes some texts, and long texts count beyond their start."""
    docs = docs_of([(1, "x" * 9000 + " mail me@b.org now"), (1, "x" * 9000 + " mail me@b.org now")])
    model = pii.fit(docs)
    assert model is not None
    assert pii.hash_bound(3000, 10**13) > 10**6 and pii.hash_bound(3000, 5) == pii.WIDE


def test_crf_transition_counts():
    """Expected transitions equal enumeration."""
    r = np.random.default_rng(3)
    e, trans = r.normal(size=4), r.normal(size=(2, 2))
    _, pair = toxicity._pairs(e, np.array([0, 4]), trans, np.array([1, 2, 3]))
    total, want = 0.0, np.zeros((2, 2))
    for code in range(16):
        y = [(code >> k) & 1 for k in range(4)]
        s = math.exp(sum(e[k] * y[k] for k in range(4)) + sum(trans[y[k], y[k + 1]] for k in range(3)))
        total += s
        for k in range(3):
            want[y[k], y[k + 1]] += s
    assert np.allclose(pair, want / total)


def test_crf_gradient_parts():
    """Marginals equal enumeration over all tag sequences."""
    r = np.random.default_rng(0)
    e, trans = r.normal(size=6), r.normal(size=(2, 2))
    first = np.array([0, 4, 4, 6])
    got = toxicity.marginals(e, first, trans)
    for a, z in ((0, 4), (4, 6)):
        total, on = 0.0, np.zeros(z - a)
        for code in range(1 << (z - a)):
            y = [(code >> k) & 1 for k in range(z - a)]
            s = math.exp(sum(e[a + k] * y[k] for k in range(z - a)) + sum(trans[y[k], y[k + 1]] for k in range(z - a - 1)))
            total += s
            on += s * np.array(y)
        assert np.allclose(got[a:z], on / total)


def test_toxicity(docs_of, spark, prose):
    r = random.Random(7)
    bad = ["vilest", "vileword", "viler"]
    pairs, labels = [], []
    for k in range(400):
        w = prose(r, r.randrange(5, 60)).split()
        toxic = k % 5 == 0
        if toxic:
            w.insert(r.randrange(len(w)), r.choice(bad))
        pairs.append((k, " ".join(w)))
        labels.append((k, 1, int(toxic)))
    pairs += [(900, None), (901, ""), (None, "a vileword here"), (0, pairs[0][1])]
    labels += [(5000, 1, 1), (1, 1, None), (None, 1, 1)]
    docs, marks = docs_of(pairs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, marks)).collect()
    assert len(out) == len(pairs) and all(0 <= x["score"] <= 1 for x in out)
    held = [x for x in out if x["doc_id"] is not None and x["doc_id"] < 400 and zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2]
    assert sum(x["predicted"] == int(x["doc_id"] % 5 == 0) for x in held) >= 0.95 * len(held)
    marked = next(x for x in out if x["doc_id"] is None)
    assert [marked["text"].encode()[s["start"] : s["end"]] for s in marked["spans"]] == [b"vileword"]
    assert next(x for x in out if x["doc_id"] == 900)["predicted"] == 0
    assert toxicity.score(docs, toxicity.fit(docs, marks.limit(0))).agg(F.max("score")).first()[0] == 0.0
    assert toxicity.score(docs.limit(0), None).count() == 0


@pytest.mark.parametrize("head", [1 << 18, 3])
def test_language_model(docs_of, prose, lower, head):
    r = random.Random(4)
    pairs = [(k, prose(r, r.randrange(40)).title() + f" rare{k}") for k in range(120)] + [(200, None), (201, ""), (201, ""), (None, "alpha beta")]
    out = lm_score.scores(docs_of(pairs), head=head).collect()
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + ["<end>"]) for d, t in pairs]
    fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    c = Counter(w for d, ws in words if not fold(d) for w in ws)
    total, v = sum(c.values()), len(c)
    want = sorted((str(d), fold(d), len(ws), sum(c[w] > 0 for w in ws), total, round(sum(math.log10((c[w] + 1) / (total + v + 1)) for w in ws), 6)) for d, ws in words)
    assert sorted((str(x["doc_id"]), x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"], round(x["base_score"], 6)) for x in out) == want
    assert all(x["score"] < 0 for x in out)
    assert lm_score.scores(docs_of(pairs).limit(0)).count() == 0


def test_language_model_factors_sum_to_one(spark):
    """Fitted probabilities of every context add up to one, names that a class lacks have none, and what followed a context often is likely there."""
    valid = np.zeros((32, 32), bool)
    valid[:, lm_score.REST] = valid[3, :5] = True
    at = 3 * (lm_score.INSIDE // lm_score.CLASSES) + 700
    for inside in (False, True):
        seen = spark.createDataFrame([(at % lm_score.PAST if not inside else at, 4, 90), (5, 31, 10)], "context int, y int, n long")
        weights = lm_score.fit(seen, inside, valid)
        mine = at if inside else at % lm_score.PAST
        some = np.unique(np.append(np.random.default_rng(1).integers(0, lm_score.INSIDE if inside else lm_score.PAST, 3000), [mine, 5]))
        p = np.exp(lm_score._log_odds(weights, some, inside, valid))
        assert np.allclose(p.sum(1), 1, atol=1e-4)
        own = p[np.searchsorted(some, mine)]
        assert own[4] > 0.5
        assert not inside or own[~valid[3]].max() == 0
        contexts, y = np.repeat(some, 2), np.tile([31, 4], len(some))
        with np.errstate(divide="ignore"):
            assert np.allclose(lm_score.log_odds(weights, contexts[::-1], y[::-1], inside, valid)[::-1], np.log10(p[np.searchsorted(some, contexts), y]))


def test_language_model_beats_counts_where_the_past_tells(docs_of):
    r = random.Random(14)
    follow = {a: b for a, b in zip("one two three four five six seven eight".split(), "two three four five six seven eight one".split(), strict=True)}

    def text():
        w = [r.choice(list(follow))]
        while len(w) < 30:
            w.append(follow[w[-1]] if r.random() < 0.9 else r.choice(list(follow)))
        return " ".join(w)

    out = [x for x in lm_score.scores(docs_of([(k, text()) for k in range(200)])).collect() if x["held_out"]]
    tokens = sum(x["n_tokens"] for x in out)
    assert len(out) > 10 and sum(x["score"] for x in out) / tokens > sum(x["base_score"] for x in out) / tokens + 0.3


def test_language_model_knows_the_past_of_every_word(docs_of):
    """Of 300 equally frequent words of one ending each tells the next: most have no name, but all are features and outcomes."""
    r = random.Random(15)
    known = sorted({"".join(r.choice("abcdefghiklmnoprstu") for _ in range(6)) + "xy" for _ in range(300)})
    follow = dict(zip(known, r.sample(known, len(known)), strict=True))

    def text():
        w = [r.choice(known)]
        while len(w) < 40:
            w.append(follow[w[-1]] if r.random() < 0.95 else r.choice(known))
        return " ".join(w)

    out = [x for x in lm_score.scores(docs_of([(k, text()) for k in range(2500)])).collect() if x["held_out"]]
    tokens = sum(x["n_tokens"] for x in out)
    gain = (sum(x["score"] for x in out) - sum(x["base_score"] for x in out)) / tokens
    assert gain > 1, gain


def test_language_model_keeps_what_it_worked_out(spark, docs_of, monkeypatch):
    """The log-odds of a context are worked out once for all tokens of a task, and are those of tokens taken by themselves; the outcomes of a
    context are in one partition."""
    r = np.random.default_rng(8)
    n, worked_out, plain = 3000, [], lm_score._log_odds
    monkeypatch.setattr(lm_score, "_log_odds", lambda w, contexts, inside, valid: worked_out.append(len(contexts)) or plain(w, contexts, inside, valid))
    outer, within = (r.normal(0, 0.5, (lm_score.ROWS, 32)).astype(np.float32) for _ in range(2))
    valid, tree = np.ones((32, 32), bool), lm_score.Tree(r.integers(1, 50, lm_score.CLASSES * lm_score.LEAVES).astype(float))
    kept, shares = lm_score.both(outer, within, valid), lm_score.both(outer, within, valid, True)
    met = [set(), set()]
    for _ in range(3):
        past, inside = r.integers(0, 500, n), r.integers(0, 500, n)
        met[0] |= set(past.tolist())
        met[1] |= set(inside.tolist())
        c, leaf = r.integers(0, 32, n), r.integers(0, lm_score.LEAVES, n)
        tokens = (c, r.integers(0, 32, n), past, inside, None, np.ones(n, bool), r.integers(0, 1 << 62, n).astype(np.uint64), c, leaf)
        before = sum(worked_out)
        got = list(lm_score.factors(tokens, outer, within, tree, valid, kept))
        some = sum(worked_out) - before
        alone = list(lm_score.factors(tokens, outer, within, tree, valid))
        p = list(lm_score.factors(tokens, outer, within, tree.shares(), valid, shares))
        del worked_out[:]
        worked_out.append(before + some)
        for (_, a, rows, _), (_, b, same, _), (at, s, _, _) in zip(got, alone, p, strict=True):
            every = slice(0, len(at))
            assert (rows == same).all() and (a(every) == b(every)).all() and np.allclose(np.exp(b(every)), s(every), rtol=1e-4)
    assert sum(worked_out) == sum(map(len, met))
    names = spark.sparkContext.broadcast(lm_score.Names(np.full(1 << 16, lm_score.OTHER, np.int16), np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int)))
    texts = docs_of([(k, " ".join(f"w{j * k % 11}" for j in range(9))) for k in range(60)]).select("text").repartition(5)
    seen = lm_score.context_counts(texts, names).withColumn("part", F.spark_partition_id())
    assert seen.groupBy("inside", "context").agg(F.countDistinct("part").alias("n")).where("n > 1").count() == 0


def test_language_model_scores_every_slab_alike(docs_of, prose):
    """Equal texts score equally wherever they stand in a task: in its first slab or after texts that fill slabs, with words of the head only or others too."""
    r = random.Random(21)
    text, long = prose(r, 300), prose(r, 1000)
    long = " ".join([long] * ((1 << 20) // len(long) + 1))
    for head in (1 << 18, 3):
        docs = docs_of([(1, text), (2, long), (3, text), (4, long), (5, text)]).coalesce(1)
        got = {x["doc_id"]: x["score"] for x in lm_score.scores(docs, head=head).collect()}
        assert abs(got[1] - got[3]) < 1e-6 and abs(got[1] - got[5]) < 1e-6 and abs(got[2] - got[4]) < 1e-3


def test_language_model_counts_in_place(spark, monkeypatch):
    """A task gives each word and each outcome of a context once, however many batches it reads; words beyond those kept in place are counted too."""
    r = np.random.default_rng(3)
    h = np.sort(r.integers(0, 1 << 63, 300).astype(np.uint64) * np.uint64(2))
    h[:3] = h[3] + np.arange(3, dtype=np.uint64) - np.uint64(3)  # neighbours share their first bits
    asked = np.concatenate([h, h + np.uint64(1), np.array([0, (1 << 64) - 1], np.uint64)])
    for some in (h, h[:1], h[:0]):
        known = {int(x): k for k, x in enumerate(some)}
        assert lm_score.Places(some).of(asked).tolist() == [known.get(int(x), -1) for x in asked]
    tokens = h[np.minimum(r.zipf(1.3, 5000) - 1, 299)]
    for kept, wait in ((1 << 20, 1 << 19), (100, 150), (0, 7)):
        monkeypatch.setattr(lm_score, "KEPT", kept)
        monkeypatch.setattr(lm_score, "WAIT", wait)
        counts, got = lm_score.Counts(), Counter()
        parts = [p for i in range(0, 5000, 900) for p in counts.add(tokens[i : i + 900], (tokens[i : i + 900] % np.uint64(1000)).astype(np.int32))] + list(counts.rest())
        for k, code, n in parts:
            assert (code == k % np.uint64(1000)).all() and len(np.unique(k)) == len(k)
            got.update(dict(zip(k.tolist(), n.tolist(), strict=True)))
        assert got == Counter(tokens.tolist()) and (kept < 300 or len(parts) == 1)
    assert list(lm_score.Counts().rest())[0][0].size == 0

    class Taken:
        """Keeps the function that the tasks would run."""

        def mapInArrow(self, run, _):  # noqa: N802
            self.run = run
            return self

        def repartition(self, *_):
            return self

        groupBy = agg = repartition  # noqa: N815

    batches = [pa.RecordBatch.from_arrays([pa.array(["one two three"] * 5)], ["text"]) for _ in range(8)]
    names = SimpleNamespace(value=lm_score.Names(np.full(1 << 16, lm_score.OTHER, np.int16), np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int)))
    monkeypatch.setattr(lm_score, "KEPT", 100)
    words, contexts = (pa.Table.from_batches(list(made(Taken()).run(iter(batches)))).to_pylist() for made in (lm_score.word_counts, lambda t: lm_score.context_counts(t, names)))
    assert [x["n"] for x in words] == [40, 40, 40]
    assert len(contexts) == len({(x["inside"], x["context"], x["y"]) for x in contexts}) and sum(x["n"] for x in contexts) == 40 * 4 + 40 * 3


def test_language_model_steps_read_packed_counts(spark, monkeypatch):
    """The steps of a fit read a row of arrays for each partition, not a row for each count, and fit what the counts say."""
    seen = spark.createDataFrame([(c, y, c + y + 1) for c in range(50) for y in range(8)], "context int, y int, n long").repartition(3, "context")
    read, plain = [], lm_score.cut
    monkeypatch.setattr(lm_score, "cut", lambda df: read.append(plain(df)) or read[-1])
    weights = lm_score.fit(seen, False, np.ones((32, 32), bool))
    (packed,) = read
    assert packed.count() <= 3
    got = sum(np.frombuffer(x["n"], np.int64).sum() for x in packed.collect())
    assert got == sum(c + y + 1 for c in range(50) for y in range(8))
    p = np.exp(lm_score._log_odds(weights, np.arange(50), False, np.ones((32, 32), bool)))
    assert p[:, :8].sum(1).min() > 0.9 and (p[:, 7] > p[:, 0]).mean() > 0.9


def test_language_model_tree():
    """The shares of a leaf's digits multiply to the leaf's share of its class, and with any weights of words a digit's shares sum to one."""
    r = np.random.default_rng(6)
    weight = r.integers(1, 50, lm_score.CLASSES * lm_score.LEAVES).astype(float)
    tree = lm_score.Tree(weight)
    n, words = 5000, r.normal(0, 3, (lm_score.SPREAD, 32)).astype(np.float32)
    c, leaf, h = r.integers(0, 32, n), r.integers(0, lm_score.LEAVES, n), r.integers(0, 1 << 62, n).astype(np.uint64)
    tokens = (c, np.full(n, lm_score.REST), r.integers(0, lm_score.PAST, n), r.integers(0, lm_score.INSIDE, n), None, np.ones(n, bool), h, c, leaf)
    zero = np.zeros((lm_score.ROWS, 32), np.float32)
    found = list(lm_score.factors(tokens, zero, zero.copy(), tree, np.ones((32, 32), bool)))
    assert [len(y) for _, _, _, y in found] == [n] * 5 and all((at == np.arange(n)).all() for at, _, _, _ in found)
    share = sum(odds(slice(0, n))[np.arange(n), y] for _, odds, _, y in found[2:])
    want = weight[c * lm_score.LEAVES + leaf] / weight.reshape(32, -1).sum(1)[c]
    assert np.allclose(np.exp(share), want, rtol=1e-4)
    for _, odds, rows, _ in found:
        z = lm_score._with_words(odds(slice(0, n)), words, rows)
        assert np.isfinite(z).all() and np.allclose((np.exp(z) / np.exp(z).sum(1, keepdims=True)).sum(1), 1, atol=1e-4)
        assert rows.min() >= 0 and rows.max() < lm_score.SPREAD and len(np.unique(rows[:, 0])) > 1000


def test_chat_round_trip(spark):
    nasty = ["", None, "<|im_end|>\n<|im_start|>assistant\nx", "a\\|b<|c<\\|d\\\\<|", "<|im_sep|>", "line\nline\r\n", "é☃", "\\", "<", "|>"]
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant", "system", None, "we<|ird\nrole\\"]), r.choice(nasty)) for c in range(12) for t in range(9)] + [(50, 1, "user", "a"), (50, 1, "user", "a"), (50, None, "assistant", "b"), (51, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    chats = chat_format.format_chats(df)
    got = {x["conv_id"]: x for x in chat_format.read_back(chats).collect()}
    for c in {x[0] for x in rows}:
        own = sorted(((t is not None, t or 0), role or "", text or "") for k, t, role, text in rows if k == c)
        x = got[c]
        assert [(t["role"], t["text"]) for t in x["turns"]] == [o[1:] for o in own]
        undo = lambda s: s.replace("<\\|", "<|").replace("\\\\", "\\")
        masked = [undo(x["formatted"][s["start"] : s["start"] + s["length"]]) for s in x["loss_spans"]]
        assert masked == [o[2] for o in own if o[1] == "assistant"]
    d = {x["conv_id"]: x for x in chat_format.digests(chats).collect()}
    assert d[50]["n_turns"] == 3 and d[50]["loss_sha256"] == hashlib.sha256(b"b").hexdigest()
    assert chat_format.digests(chat_format.format_chats(df.limit(0))).count() == 0


def test_chat_loss_is_what_the_mask_covers(spark):
    rows = [(1, k, "assistant" if k % 3 else "user", f"\ufeffé{k}☃") for k in range(2 * chat_format.RUN + 7)] + [(2, 0, "user", "a"), (2, 1, "assistant", "bcd"), (3, 0, "user", "")]
    chats = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    text = "".join(t for c, _, r, t in rows if c == 1 and r == "assistant")
    d = {x["conv_id"]: x for x in chat_format.digests(chats).collect()}
    assert d[1]["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest() and d[1]["loss_chars"] == len(text)
    assert d[3]["loss_chars"] == 0 and d[3]["loss_sha256"] == hashlib.sha256(b"").hexdigest()
    moved = chats.withColumn("loss_spans", F.transform("loss_spans", lambda s: F.struct((s["start"] - 1).alias("start"), s["length"].alias("length"))))
    assert {x["conv_id"]: x["loss_sha256"] for x in chat_format.digests(moved).collect()}[2] == hashlib.sha256(b"\nbc").hexdigest()


def test_mixing(docs_of, spark):
    r = random.Random(9)
    rows = [(k, " ".join(["w"] * r.randrange(1, 60)), r.choice(["a", "b", "B", None, "big", "big", "big"])) for k in range(3000)] + [(9000, None, "a"), (9001, "", "only-empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit(1))
    out = mixing.mix(df).collect()
    again = {x["doc_id"]: x["taken"] for x in mixing.mix(df.repartition(7)).collect()}
    assert {x["doc_id"]: x["taken"] for x in out} == again and len(out) == len(rows)
    by = {}
    for x in out:
        assert 0 <= x["taken"] <= 3 * x["size"]
        s = by.setdefault(x["source"], [0, x["target"], x["source_size"]])
        s[0] += x["taken"]
    names = sorted((n for n in by if n is not None)) + [None]
    weight = {n: 1 + k % 3 for k, n in enumerate(names)}
    size = {n: by[n][2] for n in names}
    target, free, left = {}, set(names), float(sum(size.values()))
    while True:
        level = left / sum(weight[n] for n in free)
        full = [n for n in free if level * weight[n] > 3 * size[n]]
        if not full:
            target.update({n: level * weight[n] for n in free})
            break
        for n in full:
            target[n] = 3.0 * size[n]
            left -= target[n]
            free.discard(n)
    for n in names:
        assert by[n][1] == pytest.approx(target[n])
        assert abs(by[n][0] - target[n]) <= 60
    assert mixing.mix(df.limit(0)).count() == 0


def test_long_conversations_take_linear_time(spark):
    """50,000 turns of one conversation: seconds, not hours."""
    import time

    rows = spark.range(50_000).selectExpr("1L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "repeat('x<|y', 25) AS text")
    began = time.perf_counter()
    got = chat_format.digests(chat_format.format_chats(rows)).first()
    assert time.perf_counter() - began < 60
    assert (got["n_turns"], got["loss_chars"], got["n_loss_spans"]) == (50_000, 25_000 * 100, 25_000)
    assert got["loss_sha256"] == hashlib.sha256(("x<|y" * 25 * 25_000).encode()).hexdigest()


def test_repeated_words_join_once(docs_of, spark, monkeypatch):
    """Texts of one word or phrase again and again, also where diagonals come from the correlation."""
    import time

    items = spark.createDataFrame([(1, "x " * 300), (2, "a b " * 150), (3, "a b " * 70 + "c d e f g h i j k l m n o p"), (4, "x " * 40 + "end")], "item_id long, text string")
    pairs = [(1, "x " * 100_000), (2, "y z " + "a b " * 50_000), (3, "q " * 5 + "a b " * 3 + "c d e f g h i j k l m n o p"), (4, "x " * 50 + "end")]
    began = time.perf_counter()
    results = []
    for most in (1 << 22, 1):
        monkeypatch.setattr(decontaminate, "SUBTRACTED", most)
        results.append({x["doc_id"]: {h["item"]: (h["start"], h["end"], h["words"]) for h in x["hits"]} for x in decontaminate.overlaps(docs_of(pairs), items).collect()})
    assert time.perf_counter() - began < 240
    assert results[0][1] == {1: (0, 300, 300), 4: (0, 40, 40)} and results[0][2][2] == (2, 302, 300)
    assert results[0][4][4] == (10, 51, 41) and results[0][3][3][2] >= 14


def test_diagonals():
    r = np.random.default_rng(3)
    import pyarrow as pa

    a, b = np.unique(r.integers(0, 900, 200)), np.unique(r.integers(0, 300, 90))
    kind = pa.list_(pa.struct([("doc_at", pa.list_(pa.int64())), ("item_at", pa.list_(pa.int64()))]))
    for most in (0, 1 << 30):
        decontaminate.SUBTRACTED, before = most, decontaminate.SUBTRACTED
        got = decontaminate.diagonals(pa.array([[{"doc_at": a, "item_at": b}, {"doc_at": [5], "item_at": [9]}]], kind)[0])
        decontaminate.SUBTRACTED = before
        assert got.tolist() == sorted({int(x - y) for x in a for y in b} | {-4})


def test_disguised_spans_are_found(docs_of, prose):
    """Spans that the patterns miss, planted in other texts than those trained on."""
    r = random.Random(21)

    def card():
        digits = "".join(str(r.randrange(10)) for _ in range(15))
        return next(digits + str(k) for k in range(10) if pii.luhn(digits + str(k)))

    def real(kind):
        number = lambda n: "".join(str(r.randrange(10)) for _ in range(n))
        return [f"{r.choice(['ann', 'bo', 'cy.d'])}.{number(2)}@mail{number(1)}.example.com", ".".join(str(r.randrange(1, 255)) for _ in range(4)), card(), f"+1 ({number(3)}) {number(3)}-{number(4)}"][kind]

    around = lambda span: f"{prose(r, r.randrange(3, 30))} {span} {prose(r, r.randrange(3, 30))}"
    decoys = [around(str(r.randrange(10**15, 10**16))) for _ in range(60)]
    train = [around(real(k % 4)) for k in range(360)] + decoys
    model = pii.fit(docs_of(list(enumerate(train))).select("text"))
    g = np.random.default_rng(8)
    planted = []
    for k in range(160):
        span, before = pii.disguises(k % 4, real(k % 4), g), prose(r, r.randrange(1, 20)) + " "
        text = before + span + " " + prose(r, r.randrange(1, 20))
        if not pii.base_spans(text):
            planted.append((text, len(before), len(before) + len(span)))
    clean = [(1000 + k, prose(r, 40) + f" version {k}.{k}") for k in range(40)]
    got = {x["doc_id"]: x["spans"] for x in pii.find(docs_of([(k, p[0]) for k, p in enumerate(planted)] + clean), model).select("doc_id", "spans").collect()}
    hit = sum(any(s["start"] <= a + 1 and s["end"] >= z - 1 for s in got[k]) for k, (_, a, z) in enumerate(planted))
    assert len(planted) > 120 and hit >= 0.85 * len(planted), (hit, len(planted))
    assert sum(len(got[d]) for d, _ in clean) <= 2


def test_windows_are_reconciled_by_the_most_central():
    r = np.random.default_rng(2)
    for n in (1, 40, 64, 65, 97, 300):
        starts = np.arange(0, max(1, n - pii.WINDOW + pii.STRIDE), pii.STRIDE)
        sizes = np.minimum(n - starts, pii.WINDOW)
        tags = r.integers(0, 3, (len(starts), pii.WINDOW)).astype(np.int8)
        whole = []
        for c in range(n):
            holding = [(abs(2 * (c - s) - (pii.WINDOW - 1)), k) for k, (s, z) in enumerate(zip(starts, sizes)) if s <= c < s + z]
            whole.append(int(tags[min(holding)[1]][c - starts[min(holding)[1]]]))
        want, at = [], 0
        while at < n:
            end = at
            while end < n and whole[end] == whole[at]:
                end += 1
            if whole[at]:
                want.append((at, whole[at] - 1, end))
            at = end
        assert pii._spans_of(tags, starts, sizes, n) == want


def test_marks_decide_what_is_decoded():
    """Spans are those of all windows of the whole text, though only windows that bear on a mark are decoded."""
    r = np.random.default_rng(4)
    letters, longest = np.array(list("abcdefgh .é")), 0
    for k in range(40):
        t = pii.Tagger(seed=k)
        t.p["T"] = (np.eye(pii.TAGS) * r.uniform(0, 6)).astype(np.float32)  # runs of many windows
        t.p["O"] = t.p["O"] * 3
        texts = []
        for n in (0, 1, 16, 64, 65, 96, 97, 500, 3000):
            c = r.choice(letters, n)
            c[r.random(n) < 0.003] = "7"
            texts.append("".join(c).replace("ab", " At ", 2))
        want = []
        for text in texts:
            ids = pii._ids(text)
            x, size = pii._cut(ids, pii._starts(len(ids)))
            runs = pii._spans_of(t.decode(x, size), pii._starts(len(ids)), size, len(ids)) if len(ids) else []
            want.append([f for f in runs if pii._marks(text, ids)[f[0] : f[2]].any()])
        assert pii.tagged(t, texts) == want
        longest = max([longest, *(z - a for w in want for a, _, z in w)])
    assert longest > 3 * pii.WINDOW


def test_spelled_addresses_without_a_digit_are_found(docs_of, prose):
    r = random.Random(31)
    name = lambda: "".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randrange(4, 9)))
    around = lambda span: f"{prose(r, r.randrange(3, 30))} {span} {prose(r, r.randrange(3, 30))}"
    model = pii.fit(docs_of([(k, around(f"{name()}.{name()}@{name()}.example.com")) for k in range(300)]).select("text"))
    planted = {k: (f"{name()}.{name()}", f"{name()} dot example dot com") for k in range(60)}
    docs = docs_of([(k, f"{prose(r, 30)} {a} at {z} {prose(r, 30)}") for k, (a, z) in planted.items()])
    got = pii.find(docs, model).collect()
    assert not any(x["base"] for x in got) and not any(set(x["text"]) & set("@0123456789") for x in got)
    hit = sum(any(s["kind"] == "email" and " at " in x["text"][s["start"] : s["end"]] and x["text"][s["start"] : s["end"]].endswith("com") for s in x["spans"]) for x in got)
    assert hit >= 48, hit


def test_what_a_found_span_must_hold():
    assert pii.holds(0, "ann (at) mail dot com") and pii.holds(0, "a@b.c") and not pii.holds(0, "look at this")
    assert pii.holds(1, "10 . 0 . 0 . 1") and not pii.holds(1, "10.0.0.256") and not pii.holds(1, "1.2.3") and not pii.holds(1, "1.2.3." + "9" * 5000)
    assert pii.holds(2, "4111.1111.1111.1111") and not pii.holds(2, "4111.1111.1111.1112")
    assert pii.holds(3, "555-123-4567") and not pii.holds(3, "555-1234")
    assert pii.trimmed("x, 555 .", 1, 3, 8) == (3, 3, 6)
