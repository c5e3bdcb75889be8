"""Spelling variants, shards and whitening against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from chronoline.llm import sharding, spelling, whitening


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelled(pairs, slips=97):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = Counter()
    for d, t in pairs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % slips == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize(("most", "longest", "shard"), [(20_000, 48, 40_000), (3, 48, 30), (20_000, 3, 40_000), (2, 2, 5)])
def test_spelling(docs_of, monkeypatch, most, longest, shard):
    """Also where nearly all halves count as hot or long, so that rests are split down to the last code point."""
    monkeypatch.setattr(spelling, "PER_SHARD", shard)
    monkeypatch.setattr(spelling, "SLICE", 40)
    r = random.Random(5)
    base = ["".join(r.choice("abÀé÷") for _ in range(r.randrange(5, 9))) for _ in range(12)] + ["aaaaa", "aaaaaa", "ababab", "abababab", "x" * 90, "synthetic", "A" * 7]
    seen = []
    for w in base:
        for _ in range(8):
            v, at = list(w), r.randrange(len(w))
            v[at : at + r.randrange(2)] = r.choice(["", "a", "b", "é"])
            seen += ["".join(v)] * r.choice([1, 2, 3, 4, 9])
        seen += [w] * r.choice([3, 8, 20])
    seen += ["syntho" + "".join(r.choice("abcd") for _ in range(r.randrange(2, 5))) for _ in range(600)]
    r.shuffle(seen)
    pairs = [(k, " ".join(seen[k::40]) + "€ABCDE-abcdeĀ") for k in range(40)] + [(50, None), (51, ""), (None, "abcde fghij"), (3, "abcde"), (3, "abcde")]
    got = {tuple(x[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for x in spelling.variants(docs_of(pairs), most=most, longest=longest).collect()}
    want = spelled(pairs)
    assert got == want and len(got) > 100


def test_spelling_of_nothing(docs_of):
    assert spelling.variants(docs_of([(1, None), (2, "one two")])).count() == 0
    assert spelling.variants(docs_of([(1, "a")]).limit(0)).count() == 0
    alone = spelling.variants(docs_of([(1, "lonely lonely lonely")])).collect()
    assert [(x["word"], x["form"], x["root"], x["n"], x["n_near"]) for x in alone] == [("lonely", None, "lonely", 3, 0)]


def shards_of(pairs, shards=8, share=100, few=10_000):
    """The law by one sort: large documents to the emptiest shard, all others in order up to where each shard ends."""
    rows = [(zlib_md5(t), d, len((t or "").encode()) + 1) for d, t in pairs]
    key = lambda x: (x[0], -1 if x[1] is None else x[1])
    total, parts = sum(x[2] for x in rows), shards * share
    weight, count = Counter(), Counter()
    for h, _, s in rows:
        weight[h] += s
        count[h] += 1
    hot = {h for h in weight if weight[h] * parts > total or count[h] > few and count[h] * parts > len(rows)}
    loads, out = [0] * shards, defaultdict(list)
    for x in sorted((x for x in rows if x[2] * parts > total), key=lambda x: (-x[2], *key(x))):
        at = loads.index(min(loads))
        loads[at] += x[2]
        out[at].append(x)
    for at in out:
        out[at].sort(key=key)
    rest = sorted((x for x in rows if x[2] * parts <= total), key=key)
    cuts, units, at = sharding.ends(loads, total - sum(loads)), [], 0
    for x in rest:
        if units and units[-1][0][0] == x[0] and x[0] not in hot:
            units[-1].append(x)
        else:
            units.append([x])
    for u in units:
        size = sum(x[2] for x in u)
        out[sum(c <= at + size / 2 for c in cuts)] += u
        at += size
    return Counter((x[1], x[2], s, k) for s, rows in out.items() for k, x in enumerate(rows))


def zlib_md5(t):
    import hashlib

    return hashlib.md5((t or "").encode()).hexdigest()


@pytest.mark.parametrize(("most", "few"), [(1_000_000, 10_000), (20, 3), (1, 1)])
def test_shards(docs_of, prose, most, few):
    """Also where every range is overfull until it has a row or a unit."""
    r = random.Random(9)
    pairs = [(k, prose(r, int(r.expovariate(1 / 40)) + 1)) for k in range(400)]
    pairs += [(1000 + k, pairs[3][1]) for k in range(200)] + [(2000 + k, "") for k in range(90)] + [(3000, None), (None, "x"), (None, None), (7, pairs[7][1]), (7, pairs[7][1]), (4000, prose(r, 2000)), (4001, prose(r, 9000)), (4002, "é" * 500)]
    df = docs_of(pairs)
    got = sharding.assign(df, most=most, few=few).collect()
    assert Counter((x["doc_id"], x["size"], x["shard"], x["slot"]) for x in got) == shards_of(pairs, few=few)
    crcs = {d: zlib.crc32((t or "").encode()) for d, t in pairs if d is not None}
    assert all(x["text_crc32"] == crcs[x["doc_id"]] for x in got if x["doc_id"] is not None)
    for s in {x["shard"] for x in got}:
        assert sorted(x["slot"] for x in got if x["shard"] == s) == list(range(sum(x["shard"] == s for x in got)))


def test_shards_are_near_equal_and_keep_groups(docs_of, prose):
    r = random.Random(2)
    pairs = [(k, prose(r, r.randrange(5, 30))) for k in range(4000)]
    pairs += [(5000 + k, pairs[k // 3][1]) for k in range(300)] + [(6000 + k, "one hot text of a third of all rows") for k in range(2000)]
    got = sharding.assign(docs_of(pairs)).collect()
    by = Counter()
    for x in got:
        by[x["shard"]] += x["size"]
    assert len(by) == 8 and max(by.values()) <= 1.01 * sum(by.values()) / 8 and min(by.values()) >= 0.99 * sum(by.values()) / 8
    where, weight = defaultdict(set), Counter()
    for x in got:
        where[x["text_crc32"]].add(x["shard"])
        weight[x["text_crc32"]] += x["size"]
    assert all(len(s) == 1 or weight[c] * 800 > sum(by.values()) for c, s in where.items())


def test_shards_of_empty_and_tiny_tables(docs_of):
    assert sharding.assign(docs_of([(1, "a")]).limit(0)).count() == 0
    got = sharding.assign(docs_of([(1, "a"), (2, None)])).collect()
    assert sorted((x["doc_id"], x["size"], x["slot"]) for x in got) == [(1, 2, 0), (2, 1, 0)]


def test_ends():
    assert sharding.ends([0] * 4, 40) == [10, 20, 30]
    assert sharding.ends([100, 0, 0, 0], 30) == [0, 10, 20]
    assert sharding.ends([5, 9, 0, 0], 0) == [0, 0, 0]


def test_written_shards(spark, docs_of, tmp_path):
    pairs = [(k, f"text {k % 40}") for k in range(100)]
    docs = docs_of(pairs).selectExpr("*", "doc_id % 2 AS shard")
    sharding.write(docs, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(back.columns) == sorted([*docs.columns, "_shard"]) and back.count() == 100
    assert {x["_shard"] for x in back.collect()} == {0, 1, 2, 3}
    assert back.select(docs.columns).exceptAll(docs).count() == 0


def whitened(rows, k=4):
    """(components, explained, rows of x) by one eigendecomposition."""
    x = {i: np.floor(256 * np.array(v, float)) for i, v in rows}
    fit = np.unique(np.array(list(x.values())), axis=0)
    mean = fit.mean(0)
    e, v = np.linalg.eigh((fit - mean).T @ (fit - mean) / len(fit))
    e, v = e[::-1], v[:, ::-1]
    return fit, {i: (y - mean) @ v[:, :k] / np.sqrt(e[:k]) for i, y in x.items()}, e[:k] / e.sum()


def held(df, rows, k=4):
    fit, want, explained = whitened(rows, k)
    got = df.collect()
    by = defaultdict(dict)
    for g in got:
        by[g["vec_id"]][g["component"]] = g
    assert set(by) == set(want)
    for c in range(1, k + 1):
        a, b = np.array([by[i][c]["whitened"] for i in want]), np.array([want[i][c - 1] for i in want])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-7
        assert abs(got[0]["n"] - len(fit)) == 0 and all(abs(by[i][c]["explained"] / explained[c - 1] - 1) < 1e-9 for i in want)
    total = [int(s) for s in fit.sum(0)]
    for i, v in rows:
        x = [int(np.floor(256 * float(c))) for c in v]
        assert by[i][1]["deviation"] == sum((len(fit) * a - s) ** 2 for a, s in zip(x, total))
    assert all(g["identity_error"] < 1e-9 for g in got)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<double>, n long, x string, component int")


def test_whitening_expands_to_full_dimension(spark):
    r = np.random.default_rng(1)
    rows = [(k, v.tolist()) for k, v in enumerate(r.standard_normal((300, 40)) * np.linspace(2, 1, 40))]
    rows += [(1000 + k, rows[5][1]) for k in range(200)]  # a hot vector counts once
    df = vectors(spark, rows)
    held(whitening.whiten(df), rows)
    x, width = whitening.whole(df)
    assert whitening.fit(x.select("x").distinct(), width).full


def test_whitening_by_the_block_alone(spark):
    """A few strong directions: the block's residuals reach rounding and nothing is expanded."""
    r = np.random.default_rng(2)
    rows = [(k, v.tolist()) for k, v in enumerate(r.standard_normal((500, 6)) * [900, 500, 300, 200, 100, 60] @ np.linalg.qr(r.standard_normal((48, 48)))[0][:6] + r.standard_normal((500, 48)) * 0.01)]
    df = vectors(spark, rows)
    x, width = whitening.whole(df)
    found = whitening.fit(x.select("x").distinct(), width)
    assert not found.full and 1 < found.passes <= 6
    held(whitening.whiten(df), rows)


def test_whitening_of_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (6, [0.5]), (7, []), (None, [3.0, 1.0]), (1, [1.0, 2.0])]
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert sorted(str(g["vec_id"]) for g in got) == sorted(["1", "1", "6", "7", "None"] * 2)
    assert all(g["n"] == 4 for g in got)  # [0.5] and [] are padded with zeros
    assert whitening.whiten(vectors(spark, rows).limit(0)).count() == 0
    assert whitening.whiten(vectors(spark, [(1, []), (2, None)])).count() == 0
    same = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(same) == 4 and all(g["whitened"] is None and g["explained"] == 0 and g["deviation"] == 0 and g["identity_error"] == 0 for g in same)
    line = whitening.whiten(vectors(spark, [(k, [k / 8, 0.0, 1.0]) for k in range(5)])).collect()
    assert {g["component"]: g["whitened"] is None for g in line} == {1: False, 2: True, 3: True}
    huge = whitening.whiten(vectors(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 0.0])])).collect()
    assert len(huge) == 6 and any(g["deviation"] is None for g in huge)


def test_deviations_beyond_a_product_of_longs():
    x = np.array([[3_000_000_000, 0], [1, 1]])
    assert whitening.deviations(x, 2, [7, 1]) == [None, 26]
    assert whitening.deviations(np.array([[2_000_000_000]]), 1, [0]) == [4 * 10**18]
