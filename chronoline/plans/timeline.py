"""Timeline queries over ``events``: words, notes, beats and onsets of each user.

Words are clicks of 30 minutes, notes are views of ``value`` minutes with pitch 21 + k, beats
are purchases and onsets are signups; times are microseconds.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoline.operators import fold, interval, sequence, stats, sync
from chronoline.operators.asof import asof
from chronoline.plans.base import EVENTS, events, query

MIN, HOUR, DAY = 60_000_000, 3_600_000_000, 86_400_000_000
U = ["user_id"]

VIEWS = f"""{EVENTS},
w AS (SELECT user_id, event_id, t AS start, t + 30 * {MIN} AS "end", k FROM e WHERE kind = 'click'),
n AS (SELECT user_id, event_id AS note_id, t AS n_start, t + CAST(floor(value * {MIN} + 0.5) AS BIGINT) AS n_end, 21 + k AS pitch FROM e WHERE kind = 'view'),
b AS (SELECT user_id, event_id AS beat_id, t AS beat_t, k FROM e WHERE kind = 'purchase'),
o AS (SELECT user_id, event_id AS onset_id, t AS onset_t FROM e WHERE kind = 'signup')"""


def words(spark, sf_dir):
    return events(spark, sf_dir, "click").select("user_id", "event_id", F.col("t").alias("start"), (F.col("t") + 30 * MIN).alias("end"), "k")


def notes(spark, sf_dir):
    length = F.floor(F.col("value") * MIN + 0.5).cast("long")
    return events(spark, sf_dir, "view").select("user_id", F.col("event_id").alias("note_id"), F.col("t").alias("n_start"), (F.col("t") + length).alias("n_end"), (F.col("k") + 21).alias("pitch"))


def beats(spark, sf_dir):
    return events(spark, sf_dir, "purchase").select("user_id", F.col("event_id").alias("beat_id"), F.col("t").alias("beat_t"))


@query(
    "asof_nearest_beat",
    f"""
WITH {VIEWS},
j AS (SELECT w.user_id, w.event_id, w.start AS t, b.beat_id, b.beat_t,
             row_number() OVER (PARTITION BY w.event_id ORDER BY abs(b.beat_t - w.start) NULLS LAST, b.beat_t, b.beat_id) AS r
      FROM w LEFT JOIN b ON w.user_id = b.user_id)
SELECT user_id, event_id, t, beat_id, beat_t FROM j WHERE r = 1""",
)
def asof_nearest_beat(spark, sf_dir):
    w = words(spark, sf_dir).select("user_id", "event_id", F.col("start").alias("t"))
    return asof(w, beats(spark, sf_dir), U, "t", "beat_t", "nearest", tie="beat_id", prefix="")


def _side(op, order):
    return f"""
WITH {VIEWS},
j AS (SELECT w.user_id, w.event_id, w.start AS t, b.beat_id, b.beat_t, row_number() OVER (PARTITION BY w.event_id ORDER BY b.beat_t {order} NULLS LAST, b.beat_id) AS r
      FROM w LEFT JOIN b ON w.user_id = b.user_id AND b.beat_t {op} w.start)
SELECT user_id, event_id, t, beat_id, beat_t FROM j WHERE r = 1"""


@query("asof_backward", _side("<=", "DESC"))
def asof_backward(spark, sf_dir):
    w = words(spark, sf_dir).select("user_id", "event_id", F.col("start").alias("t"))
    return asof(w, beats(spark, sf_dir), U, "t", "beat_t", "backward", tie="beat_id", prefix="")


@query("asof_forward", _side(">=", "ASC"))
def asof_forward(spark, sf_dir):
    w = words(spark, sf_dir).select("user_id", "event_id", F.col("start").alias("t"))
    return asof(w, beats(spark, sf_dir), U, "t", "beat_t", "forward", tie="beat_id", prefix="")


@query(
    "asof_takewhile",
    f"""
WITH {VIEWS}, s AS (SELECT user_id, beat_id, max(k) OVER (PARTITION BY user_id ORDER BY beat_t, beat_id) AS top, row_number() OVER (PARTITION BY user_id ORDER BY beat_t, beat_id) AS i FROM b)
SELECT w.user_id, w.event_id, w.k, max(s.i) AS sample FROM w LEFT JOIN s ON w.user_id = s.user_id AND s.top <= w.k GROUP BY ALL""",
)
def asof_takewhile(spark, sf_dir):
    """The last sample before the first that exceeds the word's k: backward as-of on the running maximum."""
    b = events(spark, sf_dir, "purchase")
    order = Window.partitionBy("user_id").orderBy("t", "event_id")
    s = b.select("user_id", F.max("k").over(order).alias("top"), F.row_number().over(order).cast("long").alias("sample"))
    s = s.groupBy("user_id", "top").agg(F.max("sample").alias("sample"))
    out = asof(words(spark, sf_dir).select("user_id", "event_id", "k"), s, U, "k", "top", "backward", prefix="")
    return out.select("user_id", "event_id", "k", "sample")


@query(
    "grid_ticks",
    f"""
WITH {VIEWS},
s AS (SELECT user_id, beat_t AS a, lead(beat_t) OVER p AS z, row_number() OVER p - 1 AS i FROM b WINDOW p AS (PARTITION BY user_id ORDER BY beat_t, beat_id)),
g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS back FROM s WHERE z > a),
j AS (SELECT w.user_id, w.event_id, w.start, g.i, g.a, g.z, row_number() OVER (PARTITION BY w.event_id ORDER BY CASE WHEN w.start <= g.z THEN 0 ELSE 1 END, CASE WHEN w.start <= g.z THEN g.i ELSE -g.i END) AS r
      FROM w JOIN g ON w.user_id = g.user_id)
SELECT user_id, event_id, start, CAST(trunc(480.0::DOUBLE * i + (start - a)::DOUBLE * 480.0::DOUBLE / (z - a)::DOUBLE) AS BIGINT) AS tick FROM j WHERE r = 1""",
)
def grid_ticks(spark, sf_dir):
    """Times to ticks on the user's beat grid, 480 a beat: the first segment that ends at or after the
    time, or the last one, extended."""
    p = Window.partitionBy("user_id").orderBy("beat_t", "beat_id")
    s = beats(spark, sf_dir).select("user_id", F.col("beat_t").alias("a"), F.lead("beat_t").over(p).alias("z"), (F.row_number().over(p) - 1).cast("long").alias("i")).where("z > a")
    last = s.groupBy("user_id").agg(F.max_by(F.struct("a", "z", "i"), "i").alias("last"))
    w = words(spark, sf_dir).select("user_id", "event_id", "start")
    j = asof(w, s, U, "start", "z", "forward", tie="i", prefix="").join(last, "user_id")
    a, z, i = (F.coalesce(c, F.col(f"last.{c}")) for c in ("a", "z", "i"))
    tick = F.lit(480.0) * i + (F.col("start") - a).cast("double") * 480.0 / (z - a).cast("double")
    return j.select("user_id", "event_id", "start", tick.cast("long").alias("tick"))


OVERLAP = """
p AS (SELECT w.user_id, w.event_id, n.note_id, n.pitch, least(w."end", n_end) - greatest(start, n_start) AS overlap FROM w JOIN n ON w.user_id = n.user_id),
q AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY overlap DESC, note_id) AS r FROM p WHERE overlap > 20000)"""


@query("interval_overlap_argmax", f"WITH {VIEWS}, {OVERLAP} SELECT w.user_id, w.event_id, q.note_id, q.pitch, q.overlap FROM w LEFT JOIN q ON w.event_id = q.event_id AND q.r = 1")
def interval_overlap_argmax(spark, sf_dir):
    w = words(spark, sf_dir).select("user_id", "event_id", "start", "end")
    n = notes(spark, sf_dir).withColumnsRenamed({"n_start": "r_start", "n_end": "r_end"})
    return interval.best_overlap(w, n, U, "event_id", "note_id", 6 * HOUR, 20_000).select("user_id", "event_id", "note_id", "pitch", "overlap")


@query("range_earliest_onset", f"WITH {VIEWS} SELECT w.user_id, w.event_id, w.start, min(o.onset_t) AS earliest FROM w LEFT JOIN o ON w.user_id = o.user_id AND o.onset_t BETWEEN w.start - {6 * HOUR} AND w.start + {HOUR} GROUP BY ALL")
def range_earliest_onset(spark, sf_dir):
    o = events(spark, sf_dir, "signup").select("user_id", F.col("t").alias("onset_t"))
    return interval.earliest_in_range(words(spark, sf_dir).select("user_id", "event_id", "start"), o, U, "start", "onset_t", 6 * HOUR, HOUR)


#: words moved to onsets one after another; each word's end grows over the notes in order of their start
REFINED = f"""
ns AS (SELECT user_id, list({{'s': n_start, 'e': n_end}} ORDER BY n_start, n_end) AS ns FROM n WHERE n_start <= n_end GROUP BY user_id),
ws AS (SELECT w.user_id, w.event_id, w.start, w."end", row_number() OVER (PARTITION BY w.user_id ORDER BY w.start, w.event_id) AS i,
              (SELECT list(onset_t ORDER BY onset_t) FROM o WHERE o.user_id = w.user_id AND onset_t BETWEEN w.start - {6 * HOUR} AND w.start + {HOUR}) AS os, ns
       FROM w LEFT JOIN ns ON w.user_id = ns.user_id),
step AS (
  SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS word_id, NULL::BIGINT AS start_before, NULL::BIGINT AS start, NULL::BIGINT AS "end", NULL::BIGINT AS sung FROM ws
  UNION ALL
  SELECT user_id, i, word_id, start_before, a, z, greatest(coalesce(sung, z), z) FROM (
    SELECT *, CAST(coalesce(list_reduce(ns, lambda x, y: CASE WHEN y.s < x.e AND y.e > a THEN {{'s': x.s, 'e': greatest(x.e, y.e)}} ELSE x END, {{'s': a, 'e': z0}}).e, z0) AS BIGINT) AS z FROM (
      SELECT *, CASE WHEN start_before - ok[1] >= {10 * MIN} THEN ok[1] ELSE start_before END AS a FROM (
        SELECT ws.user_id, ws.i, ws.event_id AS word_id, ws.start AS start_before, ws."end" AS z0, ws.ns, step.sung, list_filter(coalesce(ws.os, []), lambda x: step.sung IS NULL OR x >= step.sung - {15 * MIN}) AS ok
        FROM step JOIN ws ON ws.user_id = step.user_id AND ws.i = step.i + 1)))),
refined AS (SELECT user_id, word_id, start_before, start, "end" FROM step WHERE i > 0)"""


@query("word_timing_fold", f"WITH RECURSIVE {VIEWS}, {REFINED} SELECT * FROM refined")
def word_timing_fold(spark, sf_dir):
    w = words(spark, sf_dir).withColumnRenamed("event_id", "word_id").drop("k")
    o = events(spark, sf_dir, "signup").select("user_id", "t")
    n = notes(spark, sf_dir).select("user_id", F.col("n_start").alias("start"), F.col("n_end").alias("end"))
    return fold.refine_timing(w, o, n, U, 6 * HOUR, HOUR, 15 * MIN, 10 * MIN)


#: the same without onsets: notes are read in a list order of their own, here by pitch
BY_NOTES = f"""
ns AS (SELECT user_id, list({{'s': n_start, 'e': n_end, 'best': 0::BIGINT, 'stop': false}} ORDER BY pitch, note_id) AS ns FROM n WHERE n_start <= n_end GROUP BY user_id),
ws AS (SELECT w.user_id, w.event_id, w.start, w."end", row_number() OVER (PARTITION BY w.user_id ORDER BY w.start, w.event_id) AS i, coalesce(ns, []) AS ns FROM w LEFT JOIN ns ON w.user_id = ns.user_id),
step AS (
  SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS word_id, NULL::BIGINT AS start_before, NULL::BIGINT AS start, NULL::BIGINT AS "end", NULL::BIGINT AS sung FROM ws
  UNION ALL
  SELECT user_id, i, word_id, t, a, z, greatest(coalesce(sung, z), z) FROM (
    SELECT *, p.s AS a, list_reduce(ns, lambda x, y: CASE WHEN y.s < x.e AND y.e > p.s THEN {{'s': x.s, 'e': greatest(x.e, y.e), 'best': x.best, 'stop': false}} ELSE x END, p).e AS z FROM (
      SELECT ws.user_id, ws.i, ws.event_id AS word_id, ws.start AS t, step.sung, ws.ns, list_reduce(ws.ns, lambda x, y: CASE
          WHEN x.stop OR y.s < ws.start - {6 * HOUR} THEN x
          WHEN y.s > ws.start + {HOUR} THEN {{'s': x.s, 'e': x.e, 'best': x.best, 'stop': true}}
          WHEN y.s < coalesce(step.sung, -9000000000000000000) - {15 * MIN} THEN x
          WHEN abs(y.s - ws.start) < x.best THEN {{'s': y.s, 'e': CASE WHEN y.e > y.s THEN greatest(x.e, y.e) ELSE x.e END, 'best': abs(y.s - ws.start), 'stop': false}}
          ELSE x END, {{'s': ws.start, 'e': ws."end", 'best': {5 * HOUR}::BIGINT, 'stop': false}}) AS p
      FROM step JOIN ws ON ws.user_id = step.user_id AND ws.i = step.i + 1)))
SELECT user_id, word_id, start_before, start, "end" FROM step WHERE i > 0"""


@query("word_timing_by_notes", f"WITH RECURSIVE {VIEWS}, {BY_NOTES}")
def word_timing_by_notes(spark, sf_dir):
    """The fallback of ``word_timing_fold``: words snap to the nearest note of an unsorted list."""
    w = words(spark, sf_dir).withColumnRenamed("event_id", "word_id").drop("k")
    n = notes(spark, sf_dir).select("user_id", "note_id", "pitch", F.col("n_start").alias("start"), F.col("n_end").alias("end"))
    return fold.refine_by_notes(w, n, U, ["pitch", "note_id"], 6 * HOUR, HOUR, 15 * MIN, 5 * HOUR)


@query(
    "interval_contains_lanes",
    f"""
WITH {VIEWS},
j AS (SELECT w.event_id, w.k, n.user_id, n.note_id, n.n_end, w.start, row_number() OVER (PARTITION BY w.event_id ORDER BY n.n_start DESC, n.note_id) AS r
      FROM w JOIN n ON w.user_id = n.user_id AND n.n_start <= w.start)
SELECT user_id, note_id, count(*) AS gems, bit_or(CAST(1 << (k % 5) AS BIGINT)) AS lanes FROM j WHERE r = 1 AND n_end > start GROUP BY ALL""",
)
def interval_contains_lanes(spark, sf_dir):
    """Each gem belongs to the interval that began last before it, if that is still open."""
    w = words(spark, sf_dir).select("user_id", "event_id", "start", "k")
    at = asof(w, notes(spark, sf_dir), U, "start", "n_start", "backward", tie="note_id", prefix="")
    lanes = F.expr("bit_or(shiftleft(1L, pmod(k, 5)))")
    return at.where("n_end > start").groupBy("user_id", "note_id").agg(F.count("*").alias("gems"), lanes.alias("lanes"))


@query(
    "interval_first_two",
    f"""
WITH {VIEWS},
j AS (SELECT w.event_id, w.k, n.user_id, n.note_id, n.n_end, w.start, row_number() OVER (PARTITION BY w.event_id ORDER BY n.n_start DESC, n.note_id) AS r
      FROM w JOIN n ON w.user_id = n.user_id AND n.n_start <= w.start),
v AS (SELECT user_id, note_id, k, min(start) AS seen FROM j WHERE r = 1 AND n_end > start GROUP BY ALL),
x AS (SELECT *, row_number() OVER (PARTITION BY user_id, note_id ORDER BY seen, k) AS i FROM v)
SELECT user_id, note_id, max(k) FILTER (i = 1) AS first_k, coalesce(max(k) FILTER (i = 2), max(k) FILTER (i = 1)) AS second_k FROM x GROUP BY ALL""",
)
def interval_first_two(spark, sf_dir):
    """First and second distinct k visited in each interval; the first stands twice where there is one."""
    w = words(spark, sf_dir).select("user_id", "event_id", "start", "k")
    at = asof(w, notes(spark, sf_dir), U, "start", "n_start", "backward", tie="note_id", prefix="").where("n_end > start")
    v = at.groupBy("user_id", "note_id", "k").agg(F.min("start").alias("seen"))
    v = v.withColumn("i", F.row_number().over(Window.partitionBy("user_id", "note_id").orderBy("seen", "k")))
    g = v.groupBy("user_id", "note_id").agg(F.max(F.when(F.col("i") == 1, F.col("k"))).alias("first_k"), F.max(F.when(F.col("i") == 2, F.col("k"))).alias("second_k"))
    return g.withColumn("second_k", F.coalesce("second_k", "first_k"))


@query(
    "overlap_nullify",
    f"""
WITH {VIEWS},
p AS (SELECT *, max(n_end) OVER (PARTITION BY user_id ORDER BY n_start, note_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past, lead(n_start) OVER (PARTITION BY user_id ORDER BY n_start, note_id) AS nxt FROM n)
SELECT user_id, note_id, CASE WHEN coalesce(past > n_start, false) OR coalesce(nxt < n_end, false) THEN NULL ELSE pitch END AS pitch FROM p""",
)
def overlap_nullify(spark, sf_dir):
    return interval.nullify_overlaps(notes(spark, sf_dir), U, ["n_start", "note_id"], "pitch", "n_start", "n_end").select("user_id", "note_id", "pitch")


@query(
    "sweep_flags",
    f"""
WITH {VIEWS}, v AS (SELECT * FROM n WHERE n_start < n_end), ticks AS (SELECT user_id, n_start AS tick FROM v UNION SELECT user_id, n_end FROM v)
SELECT ticks.user_id, tick, coalesce(bit_or(CAST(1 << (pitch % 4) AS BIGINT)), 0) AS flags
FROM ticks LEFT JOIN v ON v.user_id = ticks.user_id AND n_start <= tick AND tick < n_end GROUP BY ALL""",
)
def sweep_flags(spark, sf_dir):
    return interval.active_flags(notes(spark, sf_dir).withColumn("lane", F.pmod("pitch", F.lit(4))), U, "lane", 4, "n_start", "n_end")


@query(
    "median_mode_gate",
    f"""
WITH {EVENTS}, r AS (SELECT user_id, kind, value, CAST(round_even(value, 0) AS BIGINT) AS v FROM e),
c AS (SELECT user_id, kind, v, count(*) AS n FROM r GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY n DESC, v) AS i FROM c),
g AS (SELECT user_id, kind, count(*) AS n, median(value) AS median FROM r GROUP BY ALL)
SELECT g.user_id, g.kind, g.n, round(g.median, 6) AS median, m.v AS mode, g.n >= 2 AND abs(g.median - m.v) <= 1 AS trusted FROM g JOIN m ON g.user_id = m.user_id AND g.kind = m.kind AND m.i = 1""",
)
def median_mode_gate(spark, sf_dir):
    return stats.median_mode(events(spark, sf_dir), ["user_id", "kind"], "value").withColumn("median", F.round("median", 6))


CONTOUR = """
c AS (SELECT user_id, event_id, t, CASE WHEN kind = 'view' THEN CAST(k AS DOUBLE) END AS v FROM e),
d AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER b AS bt, last_value(v IGNORE NULLS) OVER b AS bv,
             first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER f AS ft, first_value(v IGNORE NULLS) OVER f AS fv
      FROM c WINDOW b AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT user_id, event_id, t, CASE WHEN v IS NOT NULL THEN v WHEN bt IS NULL THEN fv WHEN ft IS NULL OR ft = bt THEN bv ELSE bv + (fv - bv) * (t - bt) / (ft - bt) END AS contour FROM d)"""


@query("contour_interpolate", f"WITH {EVENTS}, {CONTOUR} SELECT user_id, event_id, t, round(contour, 6) AS contour FROM filled")
def contour_interpolate(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("v", F.when(F.col("kind") == "view", F.col("k")))
    out = sequence.interpolate(e, U, ["t", "event_id"], "t", "v", "contour")
    return out.select("user_id", "event_id", "t", F.round("contour", 6).alias("contour"))


@query(
    "pitch_cascade",
    f"""
WITH {VIEWS}, {OVERLAP}, {CONTOUR},
x AS (SELECT w.user_id, w.event_id, q.pitch, f.contour + 21 AS contour FROM w LEFT JOIN q ON w.event_id = q.event_id AND q.r = 1 JOIN filled f ON f.event_id = w.event_id),
y AS (SELECT x.*, o.o, row_number() OVER (PARTITION BY event_id ORDER BY abs(pitch + 12 * o.o - contour), pitch + 12 * o.o) AS i FROM x CROSS JOIN (SELECT unnest([-2, -1, 0, 1, 2]) AS o) o WHERE pitch + 12 * o.o BETWEEN 0 AND 127 OR pitch IS NULL)
SELECT user_id, event_id, CAST(greatest(48, least(84, CASE WHEN pitch IS NOT NULL AND abs(pitch + 12 * o - contour) <= 3 THEN pitch + 12 * o ELSE CAST(round_even(coalesce(contour, 60), 0) AS BIGINT) END)) AS BIGINT) AS pitch
FROM y WHERE i = 1""",
)
def pitch_cascade(spark, sf_dir):
    """A word's pitch: the overlapping note in the octave nearest the contour, if within 3; else the contour."""
    w = interval_overlap_argmax(spark, sf_dir).select("user_id", "event_id", "pitch")
    e = events(spark, sf_dir).withColumn("v", F.when(F.col("kind") == "view", F.col("k")))
    c = sequence.interpolate(e, U, ["t", "event_id"], "t", "v", "contour").where("kind = 'click'").select("user_id", "event_id", (F.col("contour") + 21).alias("contour"))
    x = w.join(c, ["user_id", "event_id"])
    octaves = F.filter(F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda o: F.col("pitch") + 12 * o), lambda p: (p >= 0) & (p <= 127))
    near = F.array_min(F.transform(octaves, lambda p: F.struct(F.abs(p - F.col("contour")).alias("d"), p.alias("p"))))
    pick = F.when(near["d"] <= 3, near["p"].cast("long")).otherwise(F.bround(F.coalesce("contour", F.lit(60.0))).cast("long"))
    return x.select("user_id", "event_id", F.greatest(F.lit(48), F.least(F.lit(84), pick)).cast("long").alias("pitch"))


#: pitch frames: bursts of 24 frames a quarter of an hour apart, from errors
FRAMES = f"""
f AS (SELECT user_id, t + j * {15 * MIN} AS tick, CAST(45 + k % 40 + 0.25 * ((k * j) % 5) AS DOUBLE) AS midi, (j + k) % 7 <> 0 AS voiced, ((CAST(round(value * 100) AS BIGINT) * 31 + j * 17) % 100) / 100.0 AS prob
      FROM e, (SELECT unnest(range(24)) AS j) WHERE kind = 'error')"""

TRUSTED = f"""
win AS (SELECT *, least("end", coalesce(lead(start) OVER p, "end")) AS z FROM refined WINDOW p AS (PARTITION BY user_id ORDER BY start, word_id)),
inside AS (SELECT win.word_id, midi FROM win JOIN f ON f.user_id = win.user_id AND tick >= start AND tick < CASE WHEN z - start < {5 * MIN} THEN start + {15 * MIN} ELSE z END WHERE voiced AND prob > 0.5),
modes AS (SELECT *, row_number() OVER (PARTITION BY word_id ORDER BY c DESC, m) AS i FROM (SELECT word_id, CAST(round_even(midi, 0) AS BIGINT) AS m, count(*) AS c FROM inside GROUP BY ALL)),
heard AS (SELECT x.word_id, x.n, x.median, m.m AS mode, x.n >= 2 AND abs(x.median - m.m) <= 1 AS trusted FROM (SELECT word_id, count(*) AS n, median(midi) AS median FROM inside GROUP BY ALL) x JOIN modes m ON m.word_id = x.word_id AND m.i = 1)"""


def frames(spark, sf_dir):
    e = events(spark, sf_dir, "error").select("user_id", "t", "k", "value", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("j"))
    prob = F.pmod(F.round(F.col("value") * 100).cast("long") * 31 + F.col("j") * 17, F.lit(100)) / 100.0
    return e.select("user_id", (F.col("t") + F.col("j") * F.lit(15 * MIN).cast("long")).alias("at"), (45 + F.col("k") % 40 + 0.25 * ((F.col("k") * F.col("j")) % 5)).alias("midi"), ((F.col("j") + F.col("k")) % 7 != 0).alias("voiced"), prob.alias("prob"))


@query("trusted_pitch", f"""WITH RECURSIVE {VIEWS}, {REFINED}, {FRAMES}, {TRUSTED} SELECT r.user_id, r.word_id, coalesce(h.n, 0) AS n, round(h.median, 6) AS median, h.mode, coalesce(h.trusted, false) AS trusted FROM refined r LEFT JOIN heard h ON h.word_id = r.word_id""")
def trusted_pitch(spark, sf_dir):
    """Pitch heard in each moved word: median and mode of the voiced, probable frames until the next word."""
    heard = sync.trusted_pitch(word_timing_fold(spark, sf_dir), frames(spark, sf_dir), U, "word_id", 0.5, 2, 1.0, 5 * MIN, 15 * MIN, HOUR)
    return heard.select("user_id", "word_id", "n", F.round("median", 6).alias("median"), "mode", "trusted")


@query(
    "word_sync",
    f"""
WITH RECURSIVE {VIEWS}, {REFINED}, {FRAMES}, {TRUSTED},
c AS (SELECT r.*, CASE WHEN h.trusted THEN h.median END AS med, count(*) FILTER (h.trusted) OVER (PARTITION BY user_id) AS sure FROM refined r LEFT JOIN heard h ON h.word_id = r.word_id),
d AS (SELECT *, last_value(CASE WHEN med IS NOT NULL THEN start END IGNORE NULLS) OVER b AS bt, last_value(med IGNORE NULLS) OVER b AS bv, first_value(CASE WHEN med IS NOT NULL THEN start END IGNORE NULLS) OVER a AS ft, first_value(med IGNORE NULLS) OVER a AS fv
      FROM c WINDOW b AS (PARTITION BY user_id ORDER BY start, word_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY start, word_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
g AS (SELECT *, CASE WHEN sure < 2 THEN 60.0 WHEN med IS NOT NULL THEN med WHEN bt IS NULL THEN fv WHEN ft IS NULL OR ft = bt THEN bv ELSE bv + (fv - bv) * (start - bt) / (ft - bt) END AS contour FROM d),
v AS (SELECT g.word_id, n.pitch, row_number() OVER (PARTITION BY g.word_id ORDER BY least(g."end", n_end) - greatest(g.start, n_start) DESC, n_start, note_id) AS i FROM g JOIN n ON n.user_id = g.user_id AND least(g."end", n_end) - greatest(g.start, n_start) > 20000),
s AS (SELECT g.word_id, v.pitch + 12 * k AS p, row_number() OVER (PARTITION BY g.word_id ORDER BY abs(v.pitch + 12 * k - contour), k) AS i FROM g JOIN v ON v.word_id = g.word_id AND v.i = 1, (SELECT unnest([-2, -1, 0, 1, 2]) AS k) WHERE v.pitch + 12 * k BETWEEN 48 AND 84),
t AS (SELECT g.word_id, b.beat_id, b.beat_t, row_number() OVER (PARTITION BY g.word_id ORDER BY abs(b.beat_t - g.start), b.beat_t, b.beat_id) AS i FROM g JOIN b ON b.user_id = g.user_id)
SELECT g.user_id, g.word_id, g.start, g."end", t.beat_id, t.beat_t, g.med IS NOT NULL AS trusted,
       CAST(greatest(48, least(84, CASE WHEN med IS NOT NULL THEN round_even(med, 0) WHEN abs(s.p - contour) <= 3 THEN s.p ELSE round_even(greatest(48, least(84, contour)), 0) END)) AS BIGINT) AS pitch
FROM g LEFT JOIN t ON t.word_id = g.word_id AND t.i = 1 LEFT JOIN s ON s.word_id = g.word_id AND s.i = 1""",
)
def word_sync(spark, sf_dir):
    """Words moved to onsets, on their nearest beat, with a pitch: the one heard where it is trusted, else
    the overlapping note in the octave next to the contour of the trusted ones, else that contour."""
    w = word_timing_fold(spark, sf_dir).select("user_id", "word_id", "start", "end")
    heard = sync.trusted_pitch(w, frames(spark, sf_dir), U, "word_id", 0.5, 2, 1.0, 5 * MIN, 15 * MIN, HOUR)
    w = heard.select("user_id", "word_id", "start", "end", F.when(F.col("trusted"), F.col("median")).alias("med"))
    w = sequence.interpolate(w, U, ["start", "word_id"], "start", "med", "contour")
    w = w.withColumn("contour", F.when(F.count("med").over(Window.partitionBy("user_id")) < 2, 60.0).otherwise(F.col("contour")))
    n = notes(spark, sf_dir).select("user_id", "note_id", F.col("n_start").alias("r_start"), F.col("n_end").alias("r_end"), "pitch").withColumn("order", F.struct("r_start", "note_id"))
    w = interval.best_overlap(w.select("user_id", "word_id", "start", "end", "med", "contour"), n, U, "word_id", "order", 6 * HOUR, 20_000)
    w = w.select("user_id", "word_id", "start", "end", "med", sync.cascade(F.col("med"), F.col("pitch"), F.col("contour")).alias("pitch"))
    w = asof(w, beats(spark, sf_dir), U, "start", "beat_t", "nearest", tie="beat_id", prefix="")
    return w.select("user_id", "word_id", "start", "end", "beat_id", "beat_t", F.col("med").isNotNull().alias("trusted"), "pitch")


@query("phrase_windows", f"""WITH {VIEWS} SELECT user_id, CAST(start // {DAY} AS BIGINT) AS phrase, min(start) AS phrase_start, max("end") AS phrase_end, count(*) AS n FROM w GROUP BY ALL""")
def phrase_windows(spark, sf_dir):
    return sequence.phrases(words(spark, sf_dir), U, DAY).withColumn("phrase", F.col("phrase").cast("long"))


@query(
    "measure_tempo",
    f"""
WITH {VIEWS}, i AS (SELECT user_id, beat_t, row_number() OVER p AS i, count(*) OVER (PARTITION BY user_id) AS n, max(beat_t) OVER (PARTITION BY user_id) AS z, lead(beat_t, 4) OVER p AS nxt FROM b WINDOW p AS (PARTITION BY user_id ORDER BY beat_t))
SELECT user_id, CAST((i - 1) // 4 AS BIGINT) AS measure, beat_t AS start, round((coalesce(nxt, z) - beat_t)::DOUBLE / least(4, n - i), 3) AS mean FROM i WHERE (i - 1) % 4 = 0 AND i < n""",
)
def measure_tempo(spark, sf_dir):
    return sequence.measure_means(beats(spark, sf_dir), U, "beat_t").withColumn("mean", F.round("mean", 3))


@query(
    "tempo_deadband",
    f"""
WITH RECURSIVE {EVENTS}, s AS (SELECT user_id, event_id, t, value, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM e),
f AS (SELECT user_id, event_id, t, value, i, value AS kept, true AS keep FROM s WHERE i = 1
      UNION ALL SELECT s.user_id, s.event_id, s.t, s.value, s.i, CASE WHEN abs(s.value - f.kept) > 40 THEN s.value ELSE f.kept END, abs(s.value - f.kept) > 40 FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1)
SELECT user_id, event_id, t, value FROM f WHERE keep""",
)
def tempo_deadband(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "event_id", "t", "value")
    return fold.dead_band(e, U, ["t", "event_id"], "value", 40.0)


@query("delta_encode", f"WITH {EVENTS} SELECT user_id, event_id, t - lag(t, 1, 0) OVER (PARTITION BY user_id ORDER BY t, event_id) AS delta FROM e")
def delta_encode(spark, sf_dir):
    return sequence.to_deltas(events(spark, sf_dir), U, ["t", "event_id"], "t").select("user_id", "event_id", "delta")


@query("delta_decode", f"WITH {EVENTS} SELECT user_id, event_id, CAST(sum(k) OVER (PARTITION BY user_id ORDER BY t, event_id) AS BIGINT) AS at FROM e")
def delta_decode(spark, sf_dir):
    return sequence.from_deltas(events(spark, sf_dir), U, ["t", "event_id"], "k").select("user_id", "event_id", F.col("at").cast("long").alias("at"))


@query(
    "clamped_delta",
    f"""
WITH {EVENTS}, d AS (SELECT user_id, event_id, t, greatest(0, k - lag(k, 1, 0) OVER (PARTITION BY user_id ORDER BY t, event_id)) AS d FROM e)
SELECT user_id, event_id, CAST(sum(d) OVER (PARTITION BY user_id ORDER BY t, event_id) AS BIGINT) AS clamped FROM d""",
)
def clamped_delta(spark, sf_dir):
    out = sequence.clamped_positions(events(spark, sf_dir), U, ["t", "event_id"], "k")
    return out.select("user_id", "event_id", F.col("clamped").cast("long").alias("clamped"))


@query(
    "gap_regions",
    f"""
WITH {VIEWS}, g AS (SELECT user_id, start, lag("end") OVER (PARTITION BY user_id ORDER BY start, event_id) AS p FROM w)
SELECT user_id, p + CASE WHEN start - p > {8 * HOUR} THEN {HOUR} ELSE {30 * MIN} END AS gap_start, start - CASE WHEN start - p > {8 * HOUR} THEN {HOUR} ELSE {30 * MIN} END AS gap_end FROM g WHERE start - p > {6 * HOUR}""",
)
def gap_regions(spark, sf_dir):
    return sequence.gaps(words(spark, sf_dir), U, ["start", "event_id"], 6 * HOUR, 8 * HOUR, 30 * MIN, HOUR)


FOLD = """
WITH RECURSIVE {events}, s AS (SELECT user_id, event_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM e),
f AS (SELECT user_id, event_id, t, i, t AS g FROM s WHERE i = 1
      UNION ALL SELECT s.user_id, s.event_id, s.t, s.i, CASE WHEN s.t - f.g >= {width} THEN s.t ELSE f.g END FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1)
"""


@query("anchor_groups", FOLD.format(events=EVENTS, width=12 * HOUR) + "SELECT user_id, event_id, t, g AS group_start FROM f")
def anchor_groups(spark, sf_dir):
    return fold.anchor_groups(events(spark, sf_dir).select("user_id", "event_id", "t"), U, ["t", "event_id"], "t", 12 * HOUR)


@query("throttle", FOLD.format(events=EVENTS, width=12 * HOUR) + "SELECT user_id, min(event_id) AS event_id, t FROM f WHERE t = g GROUP BY user_id, t")
def throttle(spark, sf_dir):
    return fold.throttle(events(spark, sf_dir).select("user_id", "event_id", "t"), U, ["t", "event_id"], "t", 12 * HOUR)


@query("clip_to_next", f"""WITH {VIEWS} SELECT user_id, event_id, start, greatest(least("end", coalesce(lead(start) OVER (PARTITION BY user_id ORDER BY start, event_id), "end")), start + {MIN}) AS "end" FROM w""")
def clip_to_next(spark, sf_dir):
    return sequence.clip_to_next(words(spark, sf_dir), U, ["start", "event_id"], least=MIN).drop("k")


@query(
    "beat_rate",
    f"""
WITH {VIEWS}, r AS (SELECT user_id, beat_id, beat_t, lead(beat_t) OVER p - beat_t AS d, beat_t - lag(beat_t) OVER p AS before FROM b WINDOW p AS (PARTITION BY user_id ORDER BY beat_t, beat_id))
SELECT user_id, beat_id, round(CASE WHEN coalesce(d, before) > 0 THEN {DAY}::DOUBLE / coalesce(d, before) ELSE 0 END, 6) AS per_day FROM r""",
)
def beat_rate(spark, sf_dir):
    """Beats a day from the interval to the next beat; the last beat repeats the rate before it."""
    p = Window.partitionBy("user_id").orderBy("beat_t", "beat_id")
    d = F.coalesce(F.lead("beat_t").over(p) - F.col("beat_t"), F.col("beat_t") - F.lag("beat_t").over(p))
    return beats(spark, sf_dir).withColumn("d", d).select("user_id", "beat_id", F.round(F.when(F.col("d") > 0, F.lit(float(DAY)) / F.col("d")).otherwise(0.0), 6).alias("per_day"))


@query("chord_ends", f"WITH {EVENTS} SELECT user_id, event_id, t AS start, coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id), 2147483647) AS until FROM e")
def chord_ends(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "event_id", F.col("t").alias("start"))
    return sequence.until_next(e, U, ["start", "event_id"], "start", "until", F.lit(2147483647).cast("long"))


@query(
    "runlength_suppress",
    f"""
WITH {EVENTS}, r AS (SELECT *, lag(kind) OVER p AS before, lag(t) OVER p AS was FROM e WINDOW p AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT user_id, event_id, kind, t FROM r WHERE was IS NULL OR (before <> kind AND t - was >= {2 * HOUR})""",
)
def runlength_suppress(spark, sf_dir):
    return sequence.suppress_runs(events(spark, sf_dir).select("user_id", "event_id", "kind", "t"), U, ["t", "event_id"], "kind", "t", 2 * HOUR)


@query(
    "note_pairing",
    f"""
WITH {EVENTS}, r AS (SELECT user_id, t, kind = 'click' AS is_on, CAST(sum(CASE WHEN kind = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS BIGINT) AS note FROM e WHERE kind IN ('click', 'view'))
SELECT user_id, note, min(t) FILTER (is_on) AS on_at, max(t) FILTER (NOT is_on) AS off_at FROM r WHERE note > 0 GROUP BY ALL""",
)
def note_pairing(spark, sf_dir):
    e = events(spark, sf_dir).where("kind IN ('click', 'view')")
    return sequence.pair_on_off(e, U, ["t", "event_id"], F.col("kind") == "click", "t")


@query("group_positions", f"WITH {EVENTS} SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, kind ORDER BY t, event_id) - 1 AS place, lead(t) OVER (PARTITION BY user_id, kind ORDER BY t, event_id) IS NULL AS is_last FROM e")
def group_positions(spark, sf_dir):
    e = sequence.last_in_group(events(spark, sf_dir), ["user_id", "kind"], ["t", "event_id"])
    place = F.row_number().over(Window.partitionBy("user_id", "kind").orderBy("t", "event_id")) - 1
    return e.select("user_id", "event_id", place.cast("long").alias("place"), "is_last")


@query(
    "slide_insertion",
    f"""
WITH {EVENTS}, r AS (SELECT user_id, event_id, t, k, lag(t) OVER p AS pt, lag(k) OVER p AS pk FROM e WINDOW p AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT user_id, event_id, t AS at, k AS pitch, false AS slide FROM r
UNION ALL SELECT user_id, event_id, pt + (t - pt) // 2, CAST((pk + k) // 2 AS INTEGER), true FROM r WHERE pt IS NOT NULL AND k % 10 = 0""",
)
def slide_insertion(spark, sf_dir):
    """A marked note also gets a slide half-way from the note before it."""
    p = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = events(spark, sf_dir).select("user_id", "event_id", "t", "k", F.lag("t").over(p).alias("pt"), F.lag("k").over(p).alias("pk"))
    own = F.struct(F.col("t").alias("at"), F.col("k").alias("pitch"), F.lit(False).alias("slide"))
    slide = F.struct(F.expr("pt + (t - pt) div 2").alias("at"), F.expr("cast((pk + k) div 2 as int)").alias("pitch"), F.lit(True).alias("slide"))
    both = F.when(F.col("pt").isNotNull() & (F.col("k") % 10 == 0), F.array(own, slide)).otherwise(F.array(own))
    return e.select("user_id", "event_id", F.explode(both).alias("n")).select("user_id", "event_id", "n.at", "n.pitch", "n.slide")


@query(
    "timeline_sync",
    f"""
WITH {VIEWS}, {OVERLAP},
nb AS (SELECT w.event_id, b.beat_id, b.beat_t, row_number() OVER (PARTITION BY w.event_id ORDER BY abs(b.beat_t - w.start), b.beat_t, b.beat_id) AS r FROM w JOIN b ON w.user_id = b.user_id),
c AS (SELECT user_id, event_id, start, greatest(least("end", coalesce(lead(start) OVER (PARTITION BY user_id ORDER BY start, event_id), "end")), start + {MIN}) AS "end" FROM w)
SELECT c.user_id, c.event_id, c.start, c."end", nb.beat_id, c.start - nb.beat_t AS lag_us, coalesce(q.pitch, 60) AS pitch, CAST(c.start // {DAY} AS BIGINT) AS phrase
FROM c LEFT JOIN nb ON nb.event_id = c.event_id AND nb.r = 1 LEFT JOIN q ON q.event_id = c.event_id AND q.r = 1""",
)
def timeline_sync(spark, sf_dir):
    """Words clipped to their followers, with the nearest beat, the best overlapping note and the phrase."""
    w = words(spark, sf_dir).select("user_id", "event_id", "start", "end")
    n = notes(spark, sf_dir).withColumnsRenamed({"n_start": "r_start", "n_end": "r_end"})
    pitched = interval.best_overlap(w, n, U, "event_id", "note_id", 6 * HOUR, 20_000).select("user_id", "event_id", "start", "end", "pitch")
    timed = asof(pitched, beats(spark, sf_dir), U, "start", "beat_t", "nearest", tie="beat_id", prefix="")
    timed = sequence.clip_to_next(timed, U, ["start", "event_id"], least=MIN)
    return timed.select("user_id", "event_id", "start", "end", "beat_id", (F.col("start") - F.col("beat_t")).alias("lag_us"), F.coalesce("pitch", F.lit(60)).alias("pitch"), F.floor(F.col("start") / DAY).cast("long").alias("phrase"))
