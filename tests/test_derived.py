"""Derivations against plain loops: notes from activations, charts, venue, word timing, positions, tempo, hashes, data sources."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoline.functions import hashes
from chronoline.operators import activations, fold, gems, interval, metadata, positions, tempo, tree, venue, vocals
from chronoline.operators.asof import asof
from chronoline.sources import tables


# --- notes from activations -----------------------------------------------------------------


def found_by_loops(v, o, onset_from, loud_from, shortest, tolerance):
    """(start, end, bin, mean) in the order found: one matrix, one step at a time."""
    n, width = v.shape
    left, out = v.copy(), []
    peaks = [(t, b) for t in range(1, n - 1) for b in range(width) if o[t, b] >= onset_from and o[t, b] > o[t - 1, b] and o[t, b] > o[t + 1, b]]
    for t, b in sorted(peaks, reverse=True):
        last = t
        for f in range(t + 1, n - 1):
            if f - last > tolerance:
                break
            if left[f, b] >= loud_from:
                last = f
        if last + 1 - t > shortest:
            left[t : last + 1, max(0, b - 1) : b + 2] = 0
            out.append((t, last + 1, b, v[t : last + 1, b].mean()))
    while left.max(initial=0) > loud_from:
        t, b = divmod(int(left.argmax()), width)
        left[t, b] = 0
        ends = []
        for way, stop in ((1, n - 1), (-1, 0)):
            last, f = t, t + way
            while f != stop and (stop - f) * way > 0 and abs(f - last) <= tolerance:
                if left[f, b] >= loud_from:
                    last = f
                left[f, max(0, b - 1) : b + 2] = 0
                f += way
            ends.append(last)
        if ends[0] - ends[1] > shortest:
            out.append((ends[1], ends[0], b, v[ends[1] : ends[0], b].mean()))
    return out


@pytest.mark.parametrize(("tolerance", "shortest"), [(3, 2), (2, 0), (11, 4)])
def test_notes_of_activations(spark, tolerance, shortest):
    r = np.random.default_rng(tolerance)
    clips = {}
    for clip in range(6):
        v = np.round(r.random((int(r.integers(1, 160)), 7)) ** 3, 2)  # many ties
        for _ in range(3):  # silent stretches, where clips are split
            a = int(r.integers(0, len(v)))
            v[a : a + int(r.integers(0, 4 * tolerance))] *= 0.1
        clips[clip] = (v, np.round(r.random(v.shape), 2))
    rows = [(c, f, v[f].tolist(), o[f].tolist(), 1) for c, (v, o) in clips.items() for f in range(len(v))]
    df = spark.createDataFrame(rows, "clip int, frame int, v array<double>, o array<double>, part int").repartition(5)
    got = activations.notes(df, "clip", "frame", "v", "o", 0.6, 0.4, shortest, tolerance, lowest=0).collect()
    for c, (v, o) in clips.items():
        mine = sorted((x for x in got if x["clip"] == c), key=lambda x: x["note"])
        want = found_by_loops(v, o, 0.6, 0.4, shortest, tolerance)
        assert [(x["start_frame"], x["end_frame"], x["pitch"]) for x in mine] == [w[:3] for w in want]
        assert np.allclose([x["amplitude"] for x in mine], [w[3] for w in want])
    split = activations.parts(df, "clip", "frame", "v", "o", 0.6, 0.4, tolerance)
    assert split.select("clip", "part").distinct().count() > len(clips)


def test_notes_of_odd_activations(spark):
    schema = "clip string, frame long, v array<double>, o array<double>"
    nan = float("nan")
    rows = [("a", 0, None, None), ("a", 2, [nan, 0.1], [0.9, 0.9]), ("a", 3, [0.9, None, 0.9], [nan, None, None]), ("a", 4, [0.9], [0.1]), ("a", 5, [], []), ("a", 40, [0.9, 0.1], [0.0, 0.0]), (None, 0, [0.9], [0.9])]
    df = spark.createDataFrame(rows, schema)
    got = activations.notes(df, "clip", "frame", "v", "o", 0.5, 0.5, 0, 1).collect()
    assert {(x["clip"], x["start_frame"], x["end_frame"], x["pitch"]) for x in got} == {("a", 3, 4, 21)}  # the walk's last loud frame isn't in a note from a peak
    assert activations.notes(df.limit(0), "clip", "frame", "v", "o").count() == 0


def test_rises_and_single_track_bends(spark):
    df = spark.createDataFrame([("a", f, [x, 0.0], [0.5, 0.0]) for f, x in enumerate([0.0, 0.2, 0.9, 0.1, 0.4])], "clip string, frame int, v array<double>, o array<double>")
    got = [x["o"][0] for x in activations.with_rises(df, "clip", "frame", "v", "o").orderBy("frame").collect()]
    assert np.allclose(got, [0.5, 0.5, 0.5, 0.5, 0.5])
    strong = df.withColumn("o", F.transform("o", lambda x: x / 5)).withColumn("o", F.when(F.col("frame") == 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.col("o")))
    got = [x["o"][0] for x in activations.with_rises(strong, "clip", "frame", "v", "o").orderBy("frame").collect()]
    assert np.allclose(got, [1.0, 0.1, 1.0, 0.1, 0.1])  # the one rise over two frames, scaled to the largest onset
    notes = spark.createDataFrame([("a", 0, 0, 4, 30, 0.5), ("a", 1, 4, 6, 30, 0.5), ("a", 2, 5, 7, 31, 0.5), ("b", 0, 0, 9, 30, 0.5)], "clip string, note long, start_frame long, end_frame long, pitch int, amplitude double")
    alone = {(x["clip"], x["note"]): x["alone"] for x in notes.withColumn("alone", activations.alone(notes, "clip")).collect()}
    assert alone == {("a", 0): True, ("a", 1): False, ("a", 2): False, ("b", 0): True}
    frames = spark.createDataFrame([("a", f, [1.0 if b == 27 + f else 0.0 for b in range(60)]) for f in range(4)], "clip string, frame int, c array<double>")
    bent = activations.bent(notes.where("clip = 'a' AND note = 0"), frames, "clip", "frame", "c", per_semitone=3).first()
    assert bent["bends"] == [0, 1, 2, 3]


# --- vocals ---------------------------------------------------------------------------------

ITEM = "song string, track int, seq int, tick long, length long, key int, text string"


def sung(spark, items):
    rows = [("s", track, k, *x) for track, listed in items.items() for k, x in enumerate(listed)]
    out = vocals.derive(spark.createDataFrame(rows, ITEM), spark.createDataFrame([("s", 9999)], "song string, end long"))
    return [sorted((x.asDict() for x in df.collect()), key=str) for df in out]


def test_vocal_phrases_chain_and_are_inherited(spark):
    lead = [(100, 0, None, "la"), (100, 50, 60, None), (1000, 200, 105, None), (1000, 0, None, "#hey"), (1000, 90, 62, None), (1090, 0, None, "+"), (1150, 40, 64, None), (1500, 300, 106, None), (1500, 300, 105, None), (1600, 0, None, "no$"), (1600, 10, 65, None), (1700, 0, 96, None)]
    harmony = [(90, 0, None, "ah"), (95, 5, 70, None), (1550, 20, 71, None), (1600, 0, 97, None)]
    notes, phrases, rests = sung(spark, {1: lead, 2: harmony, 3: [(1810, 0, None, "x"), (1810, 5, 50, None)]})
    one = sorted((x for x in notes if x["track"] == 1), key=lambda x: x["note"])
    assert [(x["tick"], x["length"], x["key"], x["key2"], x["lyric"], x["phrase"], x["last_in_phrase"], x["portamento"]) for x in one] == [
        (100, 50, 60, 60, "la", 0, True, False), (1000, 90, 62, 62, "hey", 1, False, False), (1090, 60, 62, 64, "", 1, False, True), (1150, 40, 64, 64, "", 1, True, True), (1600, 10, 65, 65, "no", 2, True, False)]
    assert [x["unpitched"] for x in one] == [False, True, False, False, False] and [x["shown"] for x in one] == [True, True, True, True, False]
    spans = {(x["track"], x["phrase"]): x for x in phrases}
    assert [(spans[1, p]["start"], spans[1, p]["length"], spans[1, p]["start_note"], spans[1, p]["end_note"], spans[1, p]["flags"]) for p in range(3)] == [(0, 360, -1, 1, 0), (360, 840, 1, 4, 1), (1200, 600, 4, 5, 3)]
    assert [(spans[2, p]["start"], spans[2, p]["start_note"], spans[2, p]["end_note"], spans[2, p]["percussion"]) for p in range(3)] == [(0, -1, 1, False), (360, 0, 0, False), (1200, 1, 2, True)]
    assert spans[1, 2]["percussion"] and (spans[1, 0]["low"], spans[1, 0]["high"], spans[2, 0]["high"]) == (60, 65, 71)
    assert [(x["track"], x["error"]) for x in notes if x["error"]] == [(3, "note without phrase")]
    assert {(x["track"], x["start"], x["end"]) for x in rests} == {(1, 250, 900), (1, 1710, 9999), (2, 200, 1450), (2, 1670, 9999)}


def test_vocal_tracks_that_fail(spark):
    assert [x["error"] for x in sung(spark, {1: [(5, 1, 60, None)]})[0]] == ["note without lyric"]
    assert [x["error"] for x in sung(spark, {1: [(5, 0, None, "+"), (5, 1, 60, None)]})[0]] == ["starts with +"]
    assert [x["error"] for x in sung(spark, {1: [(5, 0, None, "[play]"), (6, 0, None, ""), (7, 1, 105, None)]})[0]] == ["no notes"]


def test_first_phrase_wraps_and_one_at_zero_is_set_again(spark):
    start = [(1, 0, None, "a"), (700, 5, 60, None)]
    wraps = sung(spark, {1: [*start, (600, 100, 105, None)]})[1]
    assert [(x["start"], x["length"]) for x in sorted(wraps, key=lambda x: x["phrase"])] == [(0, (1 << 32) - 40), ((1 << 32) - 40, 740)]
    zero = sung(spark, {1: [*start, (640, 100, 105, None), (2000, 100, 105, None)]})[1]
    assert [(x["start"], x["length"]) for x in sorted(zero, key=lambda x: x["phrase"])] == [(0, 0), (0, 1360), (1360, 740)]


# --- guitar and drums -----------------------------------------------------------------------

GEM = "song string, seq int, tick long, length long, key int"


def test_guitar_forces_and_chords(spark):
    rows = [(0, 50, 96), (100, 130, 97), (200, 300, 97), (300, 10, 98), (302, 10, 99), (400, 100, 101), (450, 10, 96), (452, 10, 97), (500, 50, 102), (520, 10, 98), (560, 150, 96), (700, 40, 84), (710, 20, 89), (715, 10, 84), (720, 10, 60), (724, 10, 61)]
    chords, marks = gems.guitar(spark.createDataFrame([("s", k, *x) for k, x in enumerate(rows)], GEM))
    got = {(x["level"], x["tick"]): x for x in chords.collect()}
    hammers = {k: x["hammer"] for k, x in got.items()}
    # another lane soon after; the same lane; a chord; forced on, chord and all; forced off; after its end; hard forced on the same lane; never on easy
    assert hammers == {(3, 0): False, (3, 100): True, (3, 200): False, (3, 300): False, (3, 450): True, (3, 520): False, (3, 560): True, (2, 700): False, (2, 715): True, (0, 720): False}
    assert (got[3, 300]["lanes"], got[3, 450]["lanes"], got[0, 720]["lanes"]) == (12, 3, 3)
    assert [got[k]["no_tail"] for k in ((3, 0), (3, 100), (3, 200), (3, 560))] == [True, True, False, True]
    assert [got[k]["cymbal"] for k in ((3, 300), (3, 450), (3, 0))] == [True, False, False]
    assert marks.count() == 0


def test_guitar_marks(spark):
    rows = [(0, 100, 126), (10, 5, 96), (50, 5, 98), (120, 5, 99), (200, 50, 127), (300, 50, 127), (310, 5, 97), (400, 50, 127), (410, 5, 97), (420, 5, 97), (430, 5, 99), (500, 9, 127), (600, 7, 45), (601, 7, 116), (602, 7, 103), (603, 7, 120), (5, 0, None), (None, 5, 96)]
    marks = gems.guitar(spark.createDataFrame([("s", k, *x) for k, x in enumerate(rows)], GEM))[1].collect()
    assert {(x["kind"], x["tick"], x["lanes"], x["first"], x["second"], x["position"]) for x in marks} == {
        ("tremolo", 0, 5, None, None, None), ("trill", 300, None, 1, 1, None), ("trill", 400, None, 1, 1, None), ("trill", 500, None, -1, -1, None), ("hand", 600, None, None, None, 5), ("overdrive", 601, None, None, None, None), ("solo", 602, None, None, None, None), ("fill", 603, None, None, None, None)}


def test_drum_cymbals_late_toms_and_rolls(spark):
    rows = [(0, 10, 98), (100, 50, 110), (100, 10, 98), (149, 10, 98), (150, 10, 98), (200, 10, 99), (204, 50, 111), (300, 10, 87), (303, 50, 111), (400, 10, 99), (405, 50, 111), (500, 10, 63), (502, 50, 111), (600, 100, 126), (610, 10, 96), (620, 10, 100), (700, 10, 97)]
    out, marks, toms = gems.drums(spark.createDataFrame([("s", k, *x) for k, x in enumerate(rows)], GEM))
    cymbals = {x["tick"]: x["cymbal"] for x in out.collect()}
    assert cymbals == {0: True, 100: False, 149: False, 150: True, 200: False, 300: False, 400: True, 500: True, 610: False, 620: True, 700: False}
    assert [(x["kind"], x["tick"], x["lanes"]) for x in marks.collect()] == [("roll", 600, 17)]
    assert sorted((x["tick"], x["flags"]) for x in toms.collect())[:4] == [(100, 4), (150, 0), (204, 8), (254, 0)]


# --- venue ----------------------------------------------------------------------------------


def test_venue_rewrite(spark):
    texts = [(0, "[lighting (intro)]"), (10, "[next]"), (100, "[lighting (manual_cool)]"), (200, "[lighting (manual_warm)]"), (210, "[next]"), (230, "[next]"), (321, "[next]"), (300, "[coop_all_near]"), (420, "[coop_g_far]"), (421, "[coop_b_behind]"), (500, "[bloom.pp]"), (600, "[posterize.pp]"), (3000, "[bloom.pp]"), (5000, "[bright.pp]"), (5100, "a [directed_duo_kb] "), (5200, "idle"), (5300, "[other]")]
    rows = [("s", k, t, None, None, x) for k, (t, x) in enumerate(texts)] + [("s", 90, 5400, 41, 96, None), ("s", 91, 5401, 37, 96, None), ("old", 0, 5, None, None, "[lighting (verse)]"), ("old", 1, 6, 41, 1, None)]
    got = venue.rewrite(spark.createDataFrame(rows, "song string, seq long, tick long, key int, velocity int, text string")).collect()
    new = sorted((x for x in got if x["song"] == "s" and x["action"] != "removed"), key=lambda x: x["place"])
    assert [x["place"] for x in new] == list(range(len(new)))
    assert [(x["tick"], x["text"]) for x in new if x["text"]] == [(0, "[verse]"), (0, "[lighting ()]"), (200, "[lighting (manual_warm)]"), (5100, "[do_directed_cut directed_duo_gb]"), (5200, "idle"), (5300, "[other]"), (5641, "end of track")]
    on = [(x["tick"], x["key"]) for x in new if x["velocity"] == 96]
    assert on == [(10, 48), (200, 50), (300, 60), (300, 61), (300, 62), (300, 63), (300, 64), (300, 70), (300, 72), (321, 48), (421, 60), (421, 73), (500, 103), (5000, 104), (5401, 37)]
    assert {(x["tick"], x["text"], x["key"]) for x in got if x["song"] == "s" and x["action"] == "removed"} >= {(100, "[lighting (manual_cool)]", None), (210, "[next]", None), (230, "[next]", None), (420, "[coop_g_far]", None), (600, "[posterize.pp]", None), (5400, None, 41)}
    assert {(x["action"], x["tick"]) for x in got if x["song"] == "old"} == {("kept", 5), ("kept", 6)}


# --- word timing by notes -------------------------------------------------------------------


def timed(spark, words, notes, most=300):
    w = spark.createDataFrame([("a", k, *x) for k, x in enumerate(words)], "u string, word_id int, start long, end long")
    n = spark.createDataFrame([("a", k, *x) for k, x in enumerate(notes)], "u string, i int, start long, end long")
    out = fold.refine_by_notes(w, n, ["u"], ["i"], 450, 50, 30, most)
    return [(x["start"], x["end"]) for x in out.orderBy("word_id").collect()]


def by_loops(words, notes, most=300):
    out, sung = [], None
    for start, end in words:
        at, least = start, most
        for s, e in notes:
            if s < start - 450:
                continue
            if s > start + 50:
                break
            if sung is not None and s < sung - 30:
                continue
            if abs(s - start) < least:
                at, least = s, abs(s - start)
                end = max(end, e) if e > s else end
        for s, e in notes:
            if s < end and e > at:
                end = max(end, e)
        sung = end if sung is None else max(sung, end)
        out.append((at, end))
    return out


def test_words_by_notes(spark):
    notes = [(1000, 1600), (1100, 1350), (2000, 2800)]
    assert timed(spark, [(1020, 1700)], notes) == [(1000, 1700)]
    assert timed(spark, [(3000, 3400)], [(2400, 3000)]) == [(3000, 3400)]
    assert timed(spark, [(1000, 1600), (1550, 1850)], notes) == by_loops([(1000, 1600), (1550, 1850)], notes)
    r = random.Random(3)
    words = sorted((a := r.randrange(0, 9000), a + r.randrange(1, 400)) for _ in range(40))
    notes = [(a := r.randrange(0, 9500), a + r.randrange(0, 300)) for _ in range(60)]  # in no order of time
    assert timed(spark, words, notes) == by_loops(words, notes)
    assert timed(spark, words, []) == words


# --- positions and trees --------------------------------------------------------------------


def test_positions_and_zips(spark):
    r = random.Random(1)
    left = [(r.choice("abc"), r.randrange(1000), k) for k in range(300)] + [(None, 1, 900), ("d", 5, 901)]
    right = [(r.choice("abc"), r.randrange(1000), k) for k in range(200)] + [(None, 1, 800)]
    l = spark.createDataFrame(left, "k string, t int, l int").repartition(7)
    rr = spark.createDataFrame(right, "k string, t2 int, r int").repartition(3)
    got = {(x["k"], x["position"]): (x["l"], x["r"]) for x in positions.zipped(l, rr, ["t", "l"], ["t2", "r"], ["k"], "full").collect()}
    want = {}
    for side, rows in enumerate((left, right)):
        for k in {x[0] for x in rows}:
            for i, x in enumerate(sorted(x[1:] for x in rows if x[0] == k)):
                want.setdefault((k, i), [None, None])[side] = x[1]
    assert got == {k: tuple(v) for k, v in want.items()}
    assert positions.zipped(l, rr, ["t"], ["t2"], ["k"]).count() == sum(None not in v for v in want.values())
    whole = [x["position"] for x in positions.with_position(l, ["l"]).orderBy("l").collect()]
    assert whole == list(range(302))
    assert positions.with_position(l.limit(0), ["l"]).count() == 0


def walked(parents, order):
    kids, out, place = {}, {}, 0
    for n, p in parents.items():
        kids.setdefault(p if p in parents else None, []).append(n)
    stack = [(n, 1, False) for n in sorted(kids.get(None, []), key=order, reverse=True)]
    while stack:
        n, depth, left = stack.pop()
        if left:
            out[n][1] = place
        else:
            out[n] = [place, None, depth]
            stack.append((n, depth, True))
            stack += [(c, depth + 1, False) for c in sorted(kids.get(n, []), key=order, reverse=True)]
        place += 1
    return {n: tuple(v) for n, v in out.items()}


def listed(parents):
    kids = {}
    for n in sorted(parents):
        kids.setdefault(parents[n] if parents[n] in parents else None, []).append(n)

    def below(n):
        return kids.get(n, []) + [x for c in kids.get(n, []) for x in below(c)]

    return {n: k for k, n in enumerate(below(None))}


@pytest.mark.parametrize("shape", ["random", "deep", "wide"])
def test_tours(spark, shape):
    r = random.Random(4)
    if shape == "random":
        parents = {n: r.randrange(n) if n and r.random() < 0.95 else None for n in range(150)} | {900: 901, 901: 902, 902: 900, 903: 900, 777: 5000}
    elif shape == "deep":
        parents = {n: n - 1 if n else None for n in range(400)}
    else:
        parents = {n: 0 if n else None for n in range(500)}
    df = spark.createDataFrame([*parents.items(), (None, 3)], "n long, p long")
    reach = {n: v for n, v in parents.items() if n not in (900, 901, 902, 903)}
    got = {x["n"]: (x["enter"], x["leave"], x["depth"]) for x in positions.tour(df, "n", "p", ["n"]).collect()}
    assert got == walked(reach, lambda n: n)
    if shape != "deep":
        assert {x["n"]: x["place"] for x in positions.listing(df.where("n IS NOT NULL"), "n", "p", ["n"]).collect()} == listed(reach)


@pytest.mark.parametrize("listing", [False, True])
def test_rounds_of_a_tour_follow_the_depth(spark, monkeypatch, listing):
    parents = {n: n // 40 if n else None for n in range(800)} | {900: 901, 901: 900, 902: 901}  # depth 3, and a cycle
    seen, counted = [], positions.counted
    monkeypatch.setattr(positions, "counted", lambda *a: seen.append(1) or counted(*a))
    df = spark.createDataFrame([*parents.items()], "n long, p long")
    got = (positions.listing if listing else positions.tour)(df, "n", "p", ["n"]).collect()
    reach = {n: p for n, p in parents.items() if n < 900}
    if listing:
        assert {x["n"]: (x["place"], x["depth"]) for x in got} == {n: (place, walked(reach, lambda n: n)[n][2]) for n, place in listed(reach).items()}
    else:
        assert {x["n"]: (x["enter"], x["leave"], x["depth"]) for x in got} == walked(reach, lambda n: n)
    assert len(seen) <= 8  # list ranking took a round for each doubling of the walk's length


def test_digests_of_texts_move_no_blocks(spark):
    import hashlib

    r = random.Random(6)
    sha = lambda x: hashlib.sha1(x.encode()).hexdigest()
    texts = {k: "".join(r.choice("abé ") for _ in range(n)) for k, n in enumerate((0, 1, 4, 5, 23, 24, 25, 36, 37, 200))}

    def want(several):  # blocks of 4, three digests a node
        blocks = sorted((i, sha(t[4 * i : 4 * i + 4])) for t in several for i in range(max(1, -(-len(t) // 4))))
        for _ in range(2):
            nodes = {}
            for i, h in blocks:
                nodes.setdefault(i // 3, []).append(h)
            blocks = [(n, sha("".join(hs))) for n, hs in sorted(nodes.items())]
        return blocks

    alone = spark.createDataFrame([*texts.items(), (77, None)], "k int, text string").localCheckpoint()
    out = tree.digest_nodes(alone, "k", "text", 4, 3)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == sorted([(k, *x) for k, t in texts.items() for x in want([t])] + [(77, 0, None)])
    shared = spark.createDataFrame([*texts.items(), (9, "other text"), (3, None), (88, None), (88, None), (None, "abcd"), (None, "xyz")], "k int, text string")
    both = {k: [t] for k, t in texts.items()} | {9: [texts[9], "other text"], None: ["abcd", "xyz"]}
    got = {tuple(x) for x in tree.digest_nodes(shared, "k", "text", 4, 3).collect()}
    assert got == {(k, *x) for k, ts in both.items() for x in want(ts)} | {(88, 0, None)}


def test_records_of_rows_and_of_trees(spark):
    r = random.Random(8)
    keys = sorted(metadata.WANTED)
    rows = [(song, *r.choice(keys), r.choice([None, "1", "x/y", "TRUE", "female", "7"])) for song in range(30) for _ in range(25)]
    entries = spark.createDataFrame(rows, "song int, key string, i int, value string")
    trees = entries.groupBy("song").agg(F.collect_list(F.struct("key", "i", "value")).alias("entries")).localCheckpoint()
    one = metadata.records(trees)
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, one.collect())) == sorted(map(str, metadata.record(entries).collect()))


def test_trees_without_a_checkpoint_folder_given(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c")], "n long, p long, s string")
    assert {x["path"] for x in tree.paths(df, "n", "p", "s").collect()} == {"/a", "/a/b", "/a/b/c"}


def test_forward_asof_of_many_rows_of_a_key(spark):
    """Linear in a key's rows: 200,000 in seconds."""
    import time

    l = spark.range(200_000).selectExpr("1 AS k", "id * 2 AS t")
    began = time.perf_counter()
    got = asof(l, spark.range(100_000).selectExpr("1 AS k", "id * 4 + 1 AS u"), ["k"], "t", "u", "forward", prefix="")
    assert got.where("u - t IN (1, 3)").count() == 199_999
    assert time.perf_counter() - began < 60


# --- tempo ----------------------------------------------------------------------------------


def test_tempo_tables(spark):
    tempos = spark.createDataFrame([("s", 960, 250_000), ("t", 0, 1_000_000)], "song string, tick long, us int")
    signs = spark.createDataFrame([("s", 0, 3, 4), ("s", 3000, 6, 8), ("t", None, 2, 4)], "song string, tick long, num int, den int")
    beats = spark.createDataFrame([("s", 1, 1440, True), ("s", 0, 480, False)], "song string, seq int, tick long, down boolean")
    finals = spark.createDataFrame([("s", 6000), ("t", 1921), ("u", 0)], "song string, final long")
    got = tempo.tables(tempos, signs, beats, finals).collect()
    of = lambda song, kind, *c: [tuple(x[k] for k in c) for x in sorted(got, key=lambda x: x["i"]) if x["song"] == song and x["kind"] == kind]
    assert of("s", "tempo", "tick", "ms", "us") == [(0, 0.0, 500_000), (960, 1000.0, 250_000)]
    assert of("s", "beat", "tick", "ms", "down") == [(480, 500.0, False), (1440, 1250.0, True)]
    assert of("s", "signature", "tick", "num", "measure") == [(0, 3, 0), (3000, 6, 2)]
    # two whole measures of 1440 fit before 3000; then 1440 (six eighths) each, from the last one, up to the final tick
    assert of("s", "measure", "tick") == [(0,), (1440,), (2880,), (4320,), (5760,)]
    assert of("t", "measure", "tick") == [(0,), (1920,)] and of("u", "measure", "tick") == [(0,)]


# --- hashes ---------------------------------------------------------------------------------


def test_murmur3(spark):
    def of(*texts, seed):
        raw = [t.encode() for t in texts]
        at = np.cumsum([0, *map(len, raw)])
        return [int(x) & 0xFFFFFFFF for x in hashes.murmur3_32(np.frombuffer(b"".join(raw), np.uint8), at, seed)]

    assert of("", "test", seed=0) == [0, 0xBA6BD213] and of("", seed=1) == [0x514E28B7]
    assert of("Hello, world!", "aaaa", "aaa", "aa", "a", "test", seed=0x9747B28C) == [0x24884CBA, 0x5A97808A, 0x283E0130, 0x5D211726, 0x7FA09EA6, 0x704B81DC]
    texts = ["", "é", "abc", None, "x" * 1001, "abcd", "abcde"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").repartition(2)
    got = [x["h"] for x in df.withColumn("h", hashes.murmur3("t", 7)).orderBy("k").collect()]
    assert got[3] is None and [x & 0xFFFFFFFF for x in got if x is not None] == of(*(t for t in texts if t is not None), seed=7)


# --- data sources ---------------------------------------------------------------------------


def grid_bytes(header, rows):
    strings, at = b"", {}
    for s in dict.fromkeys([*header, *(c for r in rows for c in r)]):
        at[s] = len(strings)
        strings += s.encode() + b"\0"
    numbers = [len(header), *(at[h] for h in header), len(rows)]
    for r in rows:
        numbers += [len(r), *(at[c] for c in r)]
    return struct.pack("<iibi", 1, 2, 0x2C, len(strings)) + strings + struct.pack(f"<{len(numbers)}i", *numbers)


def block_bytes(entries, wrapped=False):
    keys, values, table = b"", b"", b""
    for key, kind, value, room in entries:
        raw = struct.pack("<i", value) if kind == 0x404 else value.encode() + (b"\0" if kind == 0x204 else b"")
        table += struct.pack("<HHiiI", len(keys), kind, len(raw), room, len(values))
        keys += key.encode() + b"\0"
        values += raw.ljust(room, b"\0")
    head = 20 + len(table)
    return (b"SCEC".ljust(0x800, b"\0") if wrapped else b"") + b"\0PSF" + struct.pack("<iiii", 257, head, head + len(keys), len(entries)) + table + keys + values


def test_string_tables(spark, tmp_path):
    tables.register(spark)
    whole = grid_bytes(["id", "", "ID", "_row"], [["1", "a", "é", "x"], [], ["2"], ["3", "b", "c", "d", "too many"]])
    (tmp_path / "a.bin").write_bytes(whole)
    (tmp_path / "b.bin").write_bytes(grid_bytes(["other", "id"], [["o", "9"]]))
    for k in range(0, len(whole), 7):
        (tmp_path / f"cut{k:03}.bin").write_bytes(whole[:k])
    (tmp_path / "not.txt").write_bytes(b"text")
    df = spark.read.format("string_table").option("bytes_per_task", 200).load(str(tmp_path / "*.bin"))
    assert df.columns == ["_path", "_row", "_error", "id", "column1", "ID_2", "_row_3"] and df.rdd.getNumPartitions() > 2
    rows = df.collect()
    good = {(x["_path"].rpartition("/")[2], x["_row"]): (x["id"], x["column1"], x["ID_2"], x["_row_3"]) for x in rows if x["_error"] is None}
    assert good == {("a.bin", 0): ("1", "a", "é", "x"), ("a.bin", 1): (None,) * 4, ("a.bin", 2): ("2", None, None, None), ("a.bin", 3): ("3", "b", "c", "d"), ("b.bin", 0): ("9", None, None, None)}
    broken = {x["_path"].rpartition("/")[2] for x in rows if x["_error"]}
    assert broken == {f"cut{k:03}.bin" for k in range(0, len(whole), 7)}
    with pytest.raises(Exception, match="cut short"):
        spark.read.format("string_table").option("mode", "FAILFAST").load(str(tmp_path)).collect()


def test_key_values(spark, tmp_path):
    tables.register(spark)
    listed_ = [("TITLE", 0x204, "Größe", 16), ("LEVEL", 0x404, -7, 4), ("ID", 0x4, "AB", 2), ("EMPTY", 0x204, "", 1)]
    (tmp_path / "a.sfo").write_bytes(block_bytes(listed_))
    (tmp_path / "b.sfo").write_bytes(block_bytes(listed_[:1], wrapped=True))
    (tmp_path / "c.sfo").write_bytes(block_bytes(listed_)[:60])
    (tmp_path / "d.sfo").write_bytes(block_bytes([("X", 0x999, "?", 4)]))
    (tmp_path / "e.sfo").write_bytes(b"")
    rows = spark.read.format("key_values").load(str(tmp_path)).collect()
    good = {(x["path"][-5:], x["key"], x["kind"], x["value"], x["size"]) for x in rows if x["error"] is None}
    assert good == {("a.sfo", "TITLE", "text", "Größe", 16), ("a.sfo", "LEVEL", "integer", "-7", 4), ("a.sfo", "ID", "special", "AB", 2), ("a.sfo", "EMPTY", "text", "", 1), ("b.sfo", "TITLE", "text", "Größe", 16)}
    assert {x["path"][-5:] for x in rows if x["error"]} == {"c.sfo", "d.sfo", "e.sfo"}
    assert spark.read.format("key_values").load(str(tmp_path / "a.sfo")).select("value").where("key = 'LEVEL'").first()[0] == "-7"


# --- intervals of all lengths ---------------------------------------------------------------


def test_overlaps_of_intervals_of_any_length(spark):
    r = random.Random(6)
    side = lambda n: [(r.choice("ab"), k, a := r.randrange(-500, 5000), a + r.choice([0, 3, 40, 700, 9000])) for k in range(n)]
    left, right = [*side(60), ("a", 90, 0, 1 << 50), ("a", 91, 5, 4), ("a", 92, None, 9), ("b", 93, -(1 << 40), 1 << 40)], [*side(60), ("a", 90, 100, 1 << 55)]
    l = spark.createDataFrame(left, "k string, i int, start long, end long")
    rr = spark.createDataFrame(right, "k string, j int, r_start long, r_end long")
    want = sorted((i, j) for k, i, a, z in left for q, j, b, y in right if a is not None and a <= z and k == q and a < y and b < z)
    for width in (7, 1000):
        out = interval.overlap_join(l, rr, ["k"], width)
        assert sorted((x["i"], x["j"]) for x in out.collect()) == want
        assert out.columns == ["k", "i", "start", "end", "j", "r_start", "r_end"]


@pytest.mark.parametrize("rows", [1, 3, 10_000])
def test_anchor_groups_batch_by_batch(spark, rows):
    r = random.Random(rows)
    data = [(r.choice(["a", "b", None]), k, r.randrange(0, 60) if k % 9 else None) for k in range(150)] + [("c", 900, 5), ("d", 901, None), ("e", 902, -(1 << 61)), ("e", 903, 1 << 60)]
    df = spark.createDataFrame(data, "k string, i int, t long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    got = {x["i"]: x["g"] for x in fold.anchor_groups(df, ["k"], ["t", "i"], "t", 4, "g").collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for k in {x[0] for x in data}:
        start = None
        for t, i in sorted((t, i) for q, i, t in data if q == k and t is not None):
            start = t if start is None or t - start >= 4 else start
            want[i] = start
    assert got == {i: want.get(i) for _, i, _ in data}


def test_anchors_of_many_groups_and_wide_spans():
    t = np.sort(np.random.default_rng(1).integers(0, 5000, 3000))
    for begins, shift in (([0], 0), ([0, 1000, 1001], 0), ([0, 2999], 1 << 60)):
        parts = np.split(t + np.array([0] * 2999 + [shift]), begins[1:])
        flat = np.concatenate([np.sort(p) for p in parts])
        want = []
        for n, p in enumerate(np.split(flat, begins[1:])):
            start = -3 if n == 0 else None
            for x in p:
                start = x if start is None or x - start >= 7 else start
                want.append(start)
        got, state = fold._anchors(np.array(begins), flat, -3, 7)
        assert got.tolist() == want and state == want[-1]


def test_tempo_grid_sorts_no_more_rows_in_a_task_than_asked(spark, tmp_path, monkeypatch):
    """One fold and no join over the beats, dealt to as many partitions as their number asks for, with the same events."""
    from chronoline.plans import composed

    at = "timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, %s)"
    rows = [(u, k, k * 600 + (k * k * 7919 * (u + 1)) % 40000) for u in range(9) for k in range((0, 1, 2, 3, 5, 40, 41, 42, 300)[u])] + [(20, 0, 5), (20, 1, 90000)]
    e = spark.createDataFrame(rows, "user_id long, event_id long, s long").selectExpr("event_id", at % "s" + " AS ts", "user_id", "'purchase' AS event_type", "1.0D AS value", "'{}' AS props")
    e = e.unionByName(spark.range(12).selectExpr("id + 1000 AS event_id", at % "0" + " AS ts", "id AS user_id", "'view' AS event_type", "1.0D AS value", "'{}' AS props"))
    e.write.parquet(str(tmp_path / "events.parquet"))

    def events_of(times):
        if len(times) < 2:
            return [(0, 500000)]
        t = sorted([0, *times]) if min(times) > 0 else sorted(times)
        n, held = len(t), None
        out = [(0, t[1] - t[0] if t[1] > t[0] else 500000)]
        for i in range(1, n - 1, 4):
            us = (t[min(i + 4, n - 1)] - t[i]) // min(4, n - 1 - i)
            if held is None or abs(us - held) > composed.TOLERANCE:
                held = us
                out.append((i * 480, us))
        return [*out, ((n - 1) * 480, out[0][1] if held is None else held)]

    want = sorted((u, *x) for u in {*range(12), 20} for x in events_of([s * 1_000_000 - (5_000_000 if u == 20 else 0) for v, _, s in rows if v == u]))
    for most in (100_000, 50):
        monkeypatch.setattr(fold, "ROWS_A_TASK", most)
        out = composed.tempo_grid(spark, str(tmp_path))
        assert sorted(map(tuple, out.collect())) == want
        plan, run = (str(p.toString()) for p in (out._jdf.queryExecution().optimizedPlan(), out._jdf.queryExecution().executedPlan()))
        assert plan.count("Join") == 0 and plan.count("MapInArrow") == 1 and (most > len(rows) or f", {-(-len(rows) // most)}), REPARTITION_BY_NUM" in run)
