"""Repeat removal, the Jaccard join and embedding links against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from chronoline.llm import common, embedding_dedup, jaccard_join, suffix_dedup


def removed(pairs, width=50):
    seen, out = {}, []
    for d, t in sorted(pairs, key=lambda p: p[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen.get(b[i : i + width], d) < d:
                gone[i : i + width] = b"\1" * width
        for i in range(len(b) - width + 1):
            seen.setdefault(b[i : i + width], d)
        out.append((d, len(b), bytes(c for c, g in zip(b, gone) if not g)))
    return out


def test_repeats(docs_of):
    r = random.Random(1)
    letters = lambda n, a="abcdé ": "".join(r.choice(a) for _ in range(n))
    passage, other = letters(70), letters(49)
    pairs = [(0, letters(300)), (1, letters(40) + passage + letters(90)), (2, passage), (3, letters(10) + passage[5:60] + letters(80)), (4, other + "x"), (5, other + "y"), (6, None), (7, ""), (8, "a" * 400), (9, "a" * 120 + letters(60)), (12, "ab" * 90), (13, "b" + "ab" * 60)]
    pairs += [(20 + k, pairs[0][1]) for k in range(5)] + [(40 + k, letters(20) + passage + letters(20)) for k in range(80)]
    got = {x["doc_id"]: (x["n_bytes"], bytes(x["kept"])) for x in suffix_dedup.remove_repeats(docs_of(pairs)).collect()}
    assert got == {d: (n, k) for d, n, k in removed(pairs)}


def test_repeats_many_segments_and_nulls(docs_of, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MANY", 2)  # sends frequent anchors straight to the last pass
    r = random.Random(4)
    letters = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    line = letters(45)
    pairs = [(k, letters(30) + line + letters(6) * (k % 3) + letters(30)) for k in range(30)]
    out = suffix_dedup.remove_repeats(docs_of([*pairs, (None, pairs[0][1]), (3, pairs[3][1])]))
    got = {x["doc_id"]: bytes(x["kept"]) for x in out.collect()}
    assert got.pop(None) == pairs[0][1].encode()
    assert got == {d: k for d, _, k in removed(pairs)}
    assert suffix_dedup.remove_repeats(docs_of(pairs).limit(0)).count() == 0


def shingles(text, lower):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def groups(pairs, lower):
    sets = [(d, shingles(t, lower)) for d, t in pairs]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {d: (len(s), root(d)) for d, s in sets}


@pytest.mark.parametrize("small", [False, True])
def test_jaccard(docs_of, prose, lower, monkeypatch, small):
    if small:  # nearly all regions count as large, so pivots, windows and blocks do the work
        for name, value in (("SMALL", 2), ("HOT", 2), ("BLOCK", 4)):
            monkeypatch.setattr(jaccard_join, name, value)
    r = random.Random(8)
    pairs = [(k, prose(r, r.randrange(3, 80))) for k in range(40)]
    for k in range(40, 90):
        w = pairs[r.randrange(40)][1].split() if k < 60 else pairs[7][1].split()
        for _ in range(r.randrange(3)):
            w[r.randrange(len(w))] = f"new{r.randrange(50)}"
        pairs.append((k, " ".join(w)))
    pairs += [(100, None), (101, ""), (102, " \t"), (103, "One two"), (104, "one TWO"), (105, "one two three four five"), (106, "one two three four five"), (107, "É é"), (108, "é é")]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_join.near_duplicates(docs_of(pairs)).collect()}
    assert got == groups(pairs, lower)


def test_jaccard_empty(docs_of):
    assert jaccard_join.near_duplicates(docs_of([(1, "a")]).limit(0)).count() == 0
    assert {tuple(x) for x in jaccard_join.near_duplicates(docs_of([(1, None), (1, None)])).collect()} == {(1, 0, 1)}


@pytest.mark.parametrize("rows", [1, 7, 90, 205, 220, 260, 2000])
def test_regions_across_batches(rows):
    sizes = {1: 230, 2: 230, 3: 2, 4: 400, 5: 48, 6: 49, 7: 250, 8: 1, 9: 300}
    index = [(t, t * 1000 + k) for t, n in sizes.items() for k in range(n)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (*zip(*index[i : i + rows], strict=True), [10 + (10 << 32)] * len(index[i : i + rows]))], ["token", "sig", "about"]) for i in range(0, len(index), rows)]
    large, pairs = [], []
    for b in jaccard_join._regions(75)(batches):
        for x in b.to_pylist():
            (large if x["token"] is not None else pairs).append((x["token"], x["sig"]) if x["token"] is not None else (x["a"], x["b"]))
    assert sorted(large) == [(t, s) for t, s in index if sizes[t] > jaccard_join.SMALL]
    assert sorted(pairs) == sorted((t * 1000 + i, t * 1000 + j) for t, n in sizes.items() if n <= jaccard_join.SMALL for i in range(n) for j in range(i + 1, n))


def test_jaccard_of_repeated_and_null_ids(docs_of, prose):
    r = random.Random(12)
    x, y, z = (prose(r, 60) for _ in range(3))
    near = lambda t: t.rsplit(" ", 1)[0] + " last"
    pairs = [(1, x), (1, y), (1, z), (5, near(x)), (6, near(y)), (None, near(z)), (None, "one two three"), (7, None)]
    got = sorted((str(g["doc_id"]), str(g["component_id"])) for g in jaccard_join.near_duplicates(docs_of(pairs)).collect())
    assert got == [("1", "1")] * 3 + [("5", "1"), ("6", "1"), ("7", "7"), ("None", "1"), ("None", "None")]


def test_embeddings(spark):
    r = random.Random(3)
    base = [[r.gauss(0, 1) for _ in range(16)] for _ in range(60)]
    rows = [(k, v, k % 3) for k, v in enumerate(base)]
    for k in range(60, 160):
        v = base[k % 20]
        rows.append((k, [x + r.gauss(0, 0.08) for x in v], k % 20 % 3))
    rows += [(200 + k, base[0], 0) for k in range(30)] + [(300, None, 0), (301, [0.0] * 16, 0), (302, [1.0, None] * 8, 0), (303, [float("nan")] * 16, 0), (304, base[1], None), (305, [1e300] * 16, 1), (306, [2e300] * 16, 1), (307, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    ok = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    unit = {}
    for i, v, label in rows:
        if ok(v) and label is not None:
            top = max(map(abs, v))
            n = math.sqrt(sum((x / top) ** 2 for x in v))
            unit[i] = (label, [x / top / n for x in v])
    near = {i: [j for j in unit if j != i and unit[i][0] == unit[j][0] and sum(a * b for a, b in zip(unit[i][1], unit[j][1])) >= 0.98] for i in unit}
    got = {x["vec_id"]: x for x in embedding_dedup.near_duplicates(df, leaf=8).collect()}
    assert len(got) == len(rows)
    found = sum(got[i]["n_links"] for i in unit)
    assert 0.97 * sum(map(len, near.values())) <= found <= sum(map(len, near.values()))
    assert all(got[i]["n_links"] <= len(near[i]) for i in unit)
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (300, 301, 302, 303, 304, 307))
    assert {got[200 + k]["component_id"] for k in range(30)} == {0}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_forest_of_depth_ten_finds_links(spark):
    """Recall against all pairs where no leaf holds a label, and copies per vector stay few."""
    r = np.random.default_rng(5)
    x = r.standard_normal((9000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x[:3000] + r.standard_normal((3000, 64)) * 0.2 / 8 * r.uniform(0.5, 1.05, (3000, 1))  # cosines about 0.98 and over
    both = np.concatenate([x, y / np.linalg.norm(y, axis=1, keepdims=True)])
    cos = both @ both.T
    np.fill_diagonal(cos, 0)
    want = (cos >= 0.98).sum(1)
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(both)], "vec_id long, embedding array<double>, label int")
    got = {g["vec_id"]: g["n_links"] for g in embedding_dedup.near_duplicates(df, leaf=10).collect()}  # depth 11
    assert all(got[k] <= want[k] for k in got)
    assert sum(got.values()) >= 0.97 * want.sum() > 2000
    splits, middle = embedding_dedup.fit_splits(x, 4, 11), np.median(x @ embedding_dedup._pool(64), axis=0)
    assert len(embedding_dedup.leaves(x, splits, middle, 11, 0.08 / 8)[0]) <= 12 * len(x)


def test_links_of_a_large_near_group_are_counted_not_listed(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    r = np.random.default_rng(6)
    base = r.standard_normal(32)
    v = base + r.standard_normal((150, 32)) * 0.1
    v = np.concatenate([v, v[:20]])  # and exact copies
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    cos = u @ u.T
    np.fill_diagonal(cos, 0)
    df = spark.createDataFrame([(k, x.tolist(), 1) for k, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = {g["vec_id"]: g["n_links"] for g in embedding_dedup.near_duplicates(df, leaf=20).collect()}
    want = (cos >= 0.98).sum(1)
    assert all(got[k] <= want[k] for k in got) and sum(got.values()) >= 0.97 * want.sum()
    classes = df.limit(150).selectExpr("vec_id AS cid", "label", "embedding AS vector", "1L AS m")
    monkeypatch.setattr(embedding_dedup, "BLOCK", 512)
    assert embedding_dedup.link_classes(classes, leaf=40).count() < 150 * 40  # pairs: nearly 11,175


def test_digest_is_of_kept_bytes(docs_of):
    text = "é" * 60
    kept = suffix_dedup.remove_repeats(docs_of([(1, text)])).first()
    assert hashlib.sha256(bytes(kept["kept"])).hexdigest() == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("rows", [1, 4 << 20])
def test_components_of_chains_hubs_and_random_links(spark, monkeypatch, rows):
    """Against union-find, with tables of one partition and of many."""
    monkeypatch.setattr(common, "PER_TASK", rows)
    r = random.Random(2)
    links = [(k, k + 1) for k in range(100, 140)] + [(500, k) for k in range(501, 560)] + [(r.randrange(1000, 1100), r.randrange(1000, 1100)) for _ in range(60)] + [(7, 7), (None, 3), (9, 8), (8, 9)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    got = {x["node"]: x["component"] for x in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(parent)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embedding_labels_as_they_are_and_any_magnitude(spark):
    links = lambda rows, kind: {x["vec_id"]: x["n_links"] for x in embedding_dedup.near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}")).collect()}
    v, w = [1.0, 2.0], [1.0, 2.01]
    assert links([(1, v, 1.0), (2, w, 1.5), (3, w, 1.0), (4, v, -0.0), (5, w, 0.0), (6, v, float("nan")), (7, w, float("nan"))], "double") == {1: 1, 2: 0, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1}
    assert links([(1, v, "a"), (2, w, "A"), (3, w, "a"), (4, v, None), (5, v, None), (6, v, "")], "string") == {1: 1, 2: 0, 3: 1, 4: 0, 5: 0, 6: 0}
    assert links([(1, v, 1 << 40), (2, w, (1 << 40) + 1), (3, w, 1 << 40)], "long") == {1: 1, 2: 0, 3: 1}
    assert links([(1, v, ["a, b"]), (2, w, ["a", "b"]), (3, w, ["a, b"])], "array<string>") == {1: 1, 2: 0, 3: 1}
    far = [(1, [1e200, 0.0], 1), (2, [1e200, 1e190], 1), (3, [1e-200, 0.0], 2), (4, [1e-200, 1e-210], 2), (5, [5e-324, 0.0], 2), (6, [1e308, 1e308], 1)]
    assert links(far, "int") == {1: 1, 2: 1, 3: 2, 4: 2, 5: 2, 6: 0}
