"""Operators on hand-made and random inputs, against plain loops."""

import os
import random

import pytest
from pyspark.sql import functions as F

from chronoline import catalog
from chronoline.functions import scalar
from chronoline.operators import diff, fold, interval, sequence, stats, tree
from chronoline.operators.asof import asof

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def timeline(spark):
    r = random.Random(5)
    left = [(k, i, r.randrange(100)) for k in range(4) for i in range(30)]
    right = [(k, 100 + i, r.randrange(100)) for k in range(3) for i in range(12)]
    return left, right, spark.createDataFrame(left, "k int, id int, t int"), spark.createDataFrame(right, "k int, rid int, rt int")


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
def test_asof_matches_loop(timeline, direction):
    left, right, l, r = timeline
    got = {(x["k"], x["id"]): x["r_rid"] for x in asof(l, r, ["k"], "t", "rt", direction, tie="rid").collect()}
    for k, i, t in left:
        own = [(rt, rid) for kk, rid, rt in right if kk == k]
        if direction == "backward":
            best = min([(-rt, rid) for rt, rid in own if rt <= t], default=None)
        elif direction == "forward":
            best = min([(rt, rid) for rt, rid in own if rt >= t], default=None)
        else:
            best = min([(abs(rt - t), rt, rid) for rt, rid in own], default=None)
        assert got[k, i] == (best[-1] if best else None)


def test_asof_nulls_and_empty(spark, timeline):
    _, _, l, r = timeline
    l2 = spark.createDataFrame([(0, 1, None)], "k int, id int, t int")
    assert asof(l2, r, ["k"], "t", "rt").collect()[0]["r_rid"] is None
    assert asof(l, r.limit(0), ["k"], "t", "rt", "nearest").where("r_rid IS NOT NULL").count() == 0
    assert asof(l.limit(0), r, ["k"], "t", "rt").count() == 0


def test_overlap_join_once_and_without_nested_loop(spark):
    r = random.Random(9)
    a = [(k, i, s := r.randrange(200), s + r.randrange(60)) for k in range(3) for i in range(20)]
    b = [(k, i, s := r.randrange(200), s + r.randrange(60)) for k in range(3) for i in range(20)]
    l, q = spark.createDataFrame(a, "k int, i int, start int, end int"), spark.createDataFrame(b, "k int, j int, r_start int, r_end int")
    out = interval.overlap_join(l, q, ["k"], 25)
    want = sorted((x[0], x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and y[2] < x[3])
    assert rows(out, "k", "i", "j") == want
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_best_overlap_ties_to_first(spark):
    l = spark.createDataFrame([(1, 1, 105, 165)], "k int, w int, start int, end int")
    n = spark.createDataFrame([(1, 0, 100, 160, 60), (1, 1, 110, 165, 62), (1, 2, 200, 280, 64)], "k int, n int, r_start int, r_end int, pitch int")
    assert interval.best_overlap(l, n, ["k"], "w", "n", 50, 2).first()["pitch"] == 60


@pytest.mark.parametrize(("word", "sung", "onsets", "want"), [(160, None, [40, 90, 135], 135), (102, None, [50, 100], 102), (160, 150, [110, 135, 155], 155), (155, 160, [], 155)])
def test_refine_timing(spark, word, sung, onsets, want):
    words = [(1, 9, word, word + 10)] + ([(1, 1, sung - 50, sung)] if sung else [])
    w = spark.createDataFrame(words, "k int, word_id int, start long, end long")
    o = spark.createDataFrame([(1, t) for t in onsets], "k int, t long")
    n = spark.createDataFrame([], "k int, start long, end long")
    got = {r["word_id"]: r["start"] for r in fold.refine_timing(w, o, n, ["k"], 45, 5, 2, 3).collect()}
    assert got[9] == want


def test_refine_timing_grows_over_notes(spark):
    w = spark.createDataFrame([(1, 1, 205, 235)], "k int, word_id int, start long, end long")
    o = spark.createDataFrame([(1, 200)], "k int, t long")
    n = spark.createDataFrame([(1, 200, 280)], "k int, start long, end long")
    r = fold.refine_timing(w, o, n, ["k"], 45, 5, 2, 3).first()
    assert (r["start"], r["end"]) == (200, 280)


def test_refine_timing_matches_the_scan_over_chained_notes(spark):
    r = random.Random(6)
    words = [(0, 1, 0, 30), (0, 2, 70, 75)] + [(k, i, t, t + r.randrange(0, 30)) for k in (1, 2, 3) for i, t in enumerate(r.sample(range(900), 25))]
    notes = [(0, 20, 50), (0, 45, 80)] + [(k, t, t + r.randrange(0, 9 * k)) for k in (1, 2, 3) for t in r.sample(range(900), 120)]
    onsets = [(k, t) for k in (1, 2, 3) for t in r.sample(range(900), 60)]
    want, grown = [], 0
    for k in range(4):
        sung = None
        for start, i, end in sorted((s, i, e) for j, i, s, e in words if j == k):
            moved, late = end, [t for j, t in onsets if j == k and start - 45 <= t <= start + 5 and (sung is None or t >= sung - 2)]
            begin = min(late) if late and start - min(late) >= 3 else start
            for a, b in sorted((a, b) for j, a, b in notes if j == k):
                if a < moved and b > begin:
                    grown += moved > end and b > moved
                    moved = max(moved, b)
            sung = moved if sung is None else max(sung, moved)
            want.append((k, i, begin, moved))
    frames = spark.createDataFrame(words, "k int, word_id int, start long, end long"), spark.createDataFrame(onsets, "k int, t long"), spark.createDataFrame(notes, "k int, start long, end long")
    assert (0, 1, 0, 80) in want and grown > 10
    assert rows(fold.refine_timing(*frames, ["k"], 45, 5, 2, 3), "k", "word_id", "start", "end") == sorted(want)


def test_folds_match_loops(spark):
    r = random.Random(2)
    data = [(k, i, sum(r.randrange(9) for _ in range(i)), r.random() * 100) for k in range(5) for i in range(40)]
    df = spark.createDataFrame(data, "k int, i int, t long, v double")
    anchors, kept, passed = {}, [], []
    for k in range(5):
        start = band = last = None
        for _, i, t, v in sorted((x for x in data if x[0] == k), key=lambda x: (x[2], x[1])):
            start = t if start is None or t - start >= 20 else start
            anchors[k, i] = start
            if band is None or abs(v - band) > 30:
                band = v
                kept.append((k, i))
            if last is None or t - last >= 20:
                last = t
                passed.append((k, i))
    got = {(x["k"], x["i"]): x["group_start"] for x in fold.anchor_groups(df, ["k"], ["t", "i"], "t", 20).collect()}
    assert got == anchors
    assert rows(fold.dead_band(df, ["k"], ["t", "i"], "v", 30.0), "k", "i") == sorted(kept)
    assert rows(fold.throttle(df, ["k"], ["t", "i"], "t", 20), "k", "i") == sorted(passed)
    assert fold.dead_band(df.limit(0), ["k"], ["t", "i"], "v", 30.0).count() == 0


def test_interpolate(spark):
    df = spark.createDataFrame([(1, 0, 60.0), (1, 1, None), (1, 2, 67.0), (1, -1, None), (1, 3, None), (2, 0, None)], "k int, t int, v double")
    assert rows(sequence.interpolate(df, ["k"], ["t"], "t", "v").where("k = 1"), "t", "filled") == [(-1, 60.0), (0, 60.0), (1, 63.5), (2, 67.0), (3, 67.0)]
    assert sequence.interpolate(df, ["k"], ["t"], "t", "v").where("k = 2").first()["filled"] is None


def test_nullify_overlaps_matches_pairs(spark):
    r = random.Random(3)
    data = [(1, i, s := r.randrange(300), s + 1 + r.randrange(20), i) for i in range(40)]
    df = spark.createDataFrame(data, "k int, i int, start int, end int, p int")
    want = sorted((a[1], None if any(a[1] != b[1] and a[2] < b[3] and b[2] < a[3] for b in data) else a[4]) for a in data)
    assert sorted(((x["i"], x["p"]) for x in interval.nullify_overlaps(df, ["k"], ["start", "i"], "p").collect())) == want


def test_keys_and_gate(spark):
    c_major = [(1, p, 1.0) for p in (60, 62, 64, 65, 67, 69, 71, 72, 67, 64, 60)]
    a_minor = [(2, p, 1.0) for p in (57, 59, 60, 62, 64, 65, 67, 69, 64, 60, 57)]
    out = stats.detect_keys(spark.createDataFrame(c_major + a_minor, "k int, pitch int, w double"), ["k"], "pitch", "w")
    assert rows(out, "k", "tonic", "tonality") == [(1, 0, 0), (2, 9, 1)]
    v = spark.createDataFrame([(1, 69.0), (1, 69.0), (2, 57.0), (2, 69.0), (3, 60.0)], "k int, v double")
    assert rows(stats.median_mode(v, ["k"], "v"), "k", "trusted") == [(1, True), (2, False), (3, False)]


def test_tree_paths_and_cycles(spark):
    t = spark.createDataFrame([(0, None, "a"), (1, 0, "b"), (2, 1, "c"), (3, 2, "d"), (7, 99, "x"), (8, 9, "p"), (9, 8, "q")], "id int, parent int, name string")
    assert rows(tree.paths(t, "id", "parent", "name"), "id", "path") == [(0, "/a"), (1, "/a/b"), (2, "/a/b/c"), (3, "/a/b/c/d"), (7, "/x")]


def test_extents(spark):
    f = spark.createDataFrame([(i, (i * 37) % 9000) for i in range(200)], "id long, size long")
    at = 0
    got = {r["id"]: (r["blocks"], r["start_block"]) for r in tree.extents(f, ["id"], "size", 4096).collect()}
    for i in range(200):
        n = -(-((i * 37) % 9000) // 4096)
        assert got[i] == (n, at)
        at += n
    assert tree.extents(f.limit(0), ["id"], "size", 4096).count() == 0


def test_diff_and_report(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", None), (3, "z", 3)], "k int, s string, n int")
    b = spark.createDataFrame([(1, "x", 2), (2, "y", None), (4, "z", 3)], "k int, s string, n int")
    d = diff.table_diff(a, b, ["k"], ["s", "n"])
    assert rows(d, "k", "column") == [(1, "n"), (3, "<row>"), (4, "<row>")]
    r = diff.report(a, {"n known": F.col("n").isNotNull(), "s known": F.col("s").isNotNull()}, "k")
    assert rows(r, "check", "failed", "status") == [("n known", 1, "failed"), ("s known", 0, "ok")]


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(scalar.half_even(F.lit(2.5))) == 2
    assert value(scalar.hz_to_midi(F.lit(440.0))) == 69
    assert value(scalar.u32(F.lit(-1))) == 4294967295
    assert [value(scalar.varlen_hex(F.lit(n))) for n in (0, 127, 128, 16383, 16384, 2097152, -5)] == ["00", "7F", "8100", "FF7F", "818000", "81808000", "00"]
    assert value(scalar.snake(F.lit("camelCaseName"))) == "camel_case_name"
    assert value(scalar.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_chains_of_every_head(spark):
    r = random.Random(3)
    data = [(i, i + 1 if i < 40 else -1) for i in range(41)] + [(100, 101), (101, 102), (102, 100), (103, 101), (104, 104), (105, 101), (None, 7)]
    data += [(i, r.choice([i * 2, i + 7, None])) for i in range(200, 500)]
    following = {n: t for n, t in data if n is not None}
    heads = set(following) - {t for n, t in following.items() if t != n}
    want = []
    for head in heads:
        at, seen = head, set()
        while at in following and at not in seen:
            want.append((head, at, len(seen)))
            seen.add(at)
            at = following[at]
    got = tree.chains(spark.createDataFrame(data + data[:3], "id long, next long"), "id", "next")
    assert rows(got, "head", "block", "step") == sorted(want)
    assert max(w[2] for w in want) == 40
    assert got.limit(0).count() == 0 and tree.chains(spark.createDataFrame([], "id long, next long"), "id", "next").count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_block_chains_walk_from_every_head(spark):
    keys = {r[0] for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey").collect()}
    want = []
    for head in keys:
        if head % 2 or head // 2 not in keys - {head}:  # 0 is its own next and no other's
            at, step = head, 0
            while at in keys and (at or not step):
                want.append((head, at, step))
                at, step = at * 2, step + 1
    assert max(w[0] for w in want) > 100
    assert rows(catalog.queries()["block_chains"](spark, SF), "head", "block", "step") == sorted(want)


def test_null_keys_and_values_in_folds(spark):
    df = spark.createDataFrame([(None, 1, 1.0), (None, 2, 1.5), (None, 3, 9.0), ("a", 1, None), ("a", 2, 1.0), ("a", 3, float("nan")), ("a", 4, 1.1), ("a", 5, 3.0)], "k string, i long, v double")
    assert sorted((str(r["k"]), r["i"]) for r in fold.dead_band(df, ["k"], ["i"], "v", 1.0).collect()) == [("None", 1), ("None", 3), ("a", 2), ("a", 5)]
    t = spark.createDataFrame([(None, 1, 0), (None, 2, 5), (None, 3, 30), ("a", 4, None), ("a", 5, 7)], "k string, i long, t long")
    assert sorted((r["i"], r["g"]) for r in fold.anchor_groups(t, ["k"], ["t", "i"], "t", 10, "g").collect()) == [(1, 0), (2, 0), (3, 30), (4, None), (5, 7)]
    assert sorted(r["i"] for r in fold.throttle(t, ["k"], ["t", "i"], "t", 10).collect()) == [1, 3, 5]


def test_null_keys_in_normalisation(spark):
    df = spark.createDataFrame([(None, None, 2.0), (None, None, 4.0), ("a", None, 8.0), ("a", "b", None)], "k string, l string, v double")
    assert sorted(r["v"] for r in stats.peak_normalized(df, ["k", "l"], "v").collect() if r["v"] is not None) == [0.5, 1.0, 1.0]
    got = [r["v"] for r in stats.standardized(df, ["k", "l"], "v").collect()]
    assert len(got) == 4 and sorted(round(v, 6) for v in got if v is not None) == [-0.707107, 0.707107]


def test_extents_in_many_ranges_with_nulls(spark):
    r = random.Random(3)
    data = [(r.choice([None, *range(12)]), k, r.choice([None, 0, 1, 4096, 9000])) for k in range(300)]
    got = {x["k"]: (x["blocks"], x["start_block"]) for x in tree.extents(spark.createDataFrame(data, "o long, k long, size long"), ["o", "k"], "size", 4096, per_range=20).collect()}
    at = 0
    for o, k, size in sorted(data, key=lambda d: (d[0] is not None, d[0] or 0, d[1])):
        n = -(-(size or 0) // 4096)
        assert got[k] == (n, at)
        at += n


def test_paths_beside_a_long_cycle(spark):
    data = [(k, (k + 1) % 300, "c") for k in range(300)] + [(1000, 5, "into"), (2000, None, "a"), (2001, 2000, "b"), (2001, 2000, "b"), (2002, 9999, "lost")]
    got = tree.paths(spark.createDataFrame(data, "id long, parent long, name string"), "id", "parent", "name").collect()
    assert sorted((r["id"], r["path"], r["depth"]) for r in got) == [(2000, "/a", 1), (2001, "/a/b", 2), (2002, "/lost", 1)]
