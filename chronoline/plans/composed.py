"""Composed queries: tempo grid and chart rows, difficulty ranks, bends, venue and event tracks, table checks."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoline.functions import scalar
from chronoline.operators import fold, stats, tree
from chronoline.plans.base import EVENTS, events, query, read
from chronoline.plans.tables import FRAMES, _profiles, frames
from chronoline.plans.timeline import DAY, HOUR, MIN, U, VIEWS, beats, notes, words

#: Least notes a second of each level from 6 down to 2, and the rank in the middle of levels 1 to 6.
DENSITY = {
    "drum": [(35, 6), (20, 5), (12, 4), (6, 3), (3, 2)],
    "guitar": [(30, 6), (20, 5), (13, 4), (8, 3), (4, 2)],
    "bass": [(30, 6), (20, 5), (13, 4), (6, 3), (3, 2)],
    "vocals": [(13, 6), (9, 5), (6, 4), (4, 3), (1.2, 2)],
}
RANKS = {
    "drum": [1, 150, 188, 250, 321, 374],
    "guitar": [1, 169, 220, 273, 327, 377],
    "bass": [1, 192, 239, 278, 323, 374],
    "vocals": [1, 159, 199, 239, 278, 335],
    "band": [1, 188, 246, 300, 355, 400],
}
PLAYS = {"drum": "click", "guitar": "view", "bass": "purchase", "vocals": "signup"}


def _level_sql(name: str) -> str:
    return "CASE " + " ".join(f"WHEN {name} >= {least} THEN {level}" for least, level in DENSITY[name]) + " ELSE 1 END"


@query(
    "instrument_ranks",
    f"""
WITH {EVENTS}, d AS (SELECT user_id, {", ".join(f"count(*) FILTER (kind = '{k}') * 20.0 / greatest(1.0::DOUBLE, (max(t) - min(t)) / {DAY}.0) AS {n}" for n, k in PLAYS.items())} FROM e GROUP BY user_id),
l AS (SELECT user_id, {", ".join(f"{_level_sql(n)} AS {n}" for n in PLAYS)} FROM d)
SELECT user_id, {", ".join(f"CAST({RANKS[n]}[{n}] AS INTEGER) AS {n}" for n in PLAYS)}, 0 AS keys, CAST({RANKS["band"]}[greatest(drum, guitar, bass, vocals)] AS INTEGER) AS band FROM l""",
)
def instrument_ranks(spark, sf_dir):
    """Rank of each instrument from its own density bands, absent ones included, and of the band from the highest level."""
    n = [F.count_if(F.col("kind") == k).alias(name) for name, k in PLAYS.items()]
    e = events(spark, sf_dir).groupBy("user_id").agg(F.greatest(F.lit(1.0), (F.max("t") - F.min("t")) / float(DAY)).alias("span"), *n)
    levels = e.select("user_id", *(stats.banded(F.col(name) * 20.0 / F.col("span"), DENSITY[name], 1).alias(name) for name in PLAYS))
    rank = lambda of, level: F.element_at(F.array(*map(F.lit, RANKS[of])), level).alias(of)
    return levels.select("user_id", *(rank(name, F.col(name)) for name in PLAYS), F.lit(0).alias("keys"), rank("band", F.greatest(*PLAYS)))


PITCHES = "p AS (SELECT user_id, value, try_cast(CASE WHEN k % 10 = 4 THEN '-' ELSE '' END || k || CASE WHEN k % 10 = 3 THEN 'x' ELSE '' END AS INTEGER) AS k FROM e WHERE k < 5)"


@query(
    "key_fallback",
    f"""
WITH {EVENTS}, {PITCHES}, w(tonic, tonality, pc, w) AS (VALUES {_profiles()}),
h AS (SELECT user_id, k % 12 AS pc, sum(CASE WHEN value <= 0 THEN 1.0::DOUBLE ELSE value END) AS h FROM p WHERE k >= 0 GROUP BY ALL),
s AS (SELECT user_id, tonic, tonality, sum(h * w) / sqrt((SELECT sum(x.h * x.h) FROM h x WHERE x.user_id = h.user_id) * (SELECT sum(q.w * q.w) FROM w q WHERE q.tonic = w.tonic AND q.tonality = w.tonality)) AS score FROM h JOIN w ON w.pc = h.pc GROUP BY user_id, tonic, tonality),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, tonic, tonality) AS i FROM s)
SELECT u.user_id, coalesce(tonic, 4) AS tonic, coalesce(tonality, 0) AS tonality FROM (SELECT DISTINCT user_id FROM e) u LEFT JOIN r ON r.user_id = u.user_id AND i = 1""",
)
def key_fallback(spark, sf_dir):
    """Keys from pitches given as text: malformed and negative ones are dropped, and users without any get (4, 0)."""
    e = events(spark, sf_dir)
    p = F.concat(F.when(F.col("k") % 10 == 4, "-").otherwise(""), F.col("k").cast("string"), F.when(F.col("k") % 10 == 3, "x").otherwise(""))
    p = e.where("k < 5").select("user_id", "value", p.try_cast("int").alias("k")).where("k >= 0")
    found = stats.detect_keys(p, ["user_id"], "k", "value")
    return e.select("user_id").distinct().join(found, "user_id", "left").select("user_id", F.coalesce("tonic", F.lit(4)).alias("tonic"), F.coalesce("tonality", F.lit(0)).alias("tonality"))


@query(
    "count_in",
    f"""
WITH {VIEWS}, r AS (SELECT user_id, beat_t, row_number() OVER (PARTITION BY user_id ORDER BY beat_t, beat_id) AS i FROM b),
f AS (SELECT user_id, max(beat_t) FILTER (i = 2) - max(beat_t) FILTER (i = 1) AS d FROM r WHERE i <= 2 GROUP BY user_id)
SELECT u.user_id, CASE WHEN d IS NULL THEN 0 ELSE 5760 END AS count_in_ticks, CAST(coalesce(round_even(12 * d / 1000.0::DOUBLE, 0), 0) AS BIGINT) AS count_in_ms FROM (SELECT DISTINCT user_id FROM e) u LEFT JOIN f ON f.user_id = u.user_id""",
)
def count_in(spark, sf_dir):
    """Twelve beats of lead-in by the first interval; nothing for users with fewer than two beats."""
    b = beats(spark, sf_dir).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("beat_t", "beat_id"))).where("i <= 2")
    first = b.groupBy("user_id").agg((F.max("beat_t") - F.min("beat_t")).alias("d"), F.count("*").alias("n")).where("n = 2")
    e = events(spark, sf_dir).select("user_id").distinct().join(first, "user_id", "left")
    return e.select("user_id", F.when(F.col("d").isNull(), 0).otherwise(5760).alias("count_in_ticks"), F.coalesce(F.bround(F.col("d") * 12 / 1000.0), F.lit(0.0)).cast("long").alias("count_in_ms"))


@query("flat_ticks", f"WITH {VIEWS} SELECT user_id, event_id, CAST(trunc((start % {DAY}) / 1000000.0::DOUBLE * 480 * 120.0::DOUBLE / 60.0) AS BIGINT) AS tick FROM w")
def flat_ticks(spark, sf_dir):
    """Times of the day to ticks at a flat 120 beats a minute."""
    return words(spark, sf_dir).select("user_id", "event_id", (F.col("start") % F.lit(DAY) / 1000000.0 * 480 * 120.0 / 60.0).cast("long").alias("tick"))


TOLERANCE = 2 * HOUR

#: sparse tempo events of each user's beats, from a virtual beat at the user's first event on
GRID = f"""
u AS (SELECT user_id, min(t) AS zero FROM e GROUP BY user_id),
v AS (SELECT b.user_id, beat_t - zero AS t FROM b JOIN u ON u.user_id = b.user_id UNION ALL SELECT u.user_id, 0 FROM u JOIN (SELECT user_id, min(beat_t) AS f, count(*) AS n FROM b GROUP BY user_id) x ON x.user_id = u.user_id WHERE n >= 2 AND f > zero),
g AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, max(t) OVER (PARTITION BY user_id) AS z, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS t1, lead(t, 4) OVER (PARTITION BY user_id ORDER BY t) AS t4 FROM v),
m AS (SELECT user_id, (i - 1) // 4 AS j, i * 480 AS tick, CAST((coalesce(t4, z) - t) // least(4, n - 1 - i) AS BIGINT) AS us FROM g WHERE n >= 2 AND i % 4 = 1 AND i < n - 1),
k AS (SELECT user_id, j, tick, us, us AS held, true AS keep FROM m WHERE j = 0
      UNION ALL SELECT m.user_id, m.j, m.tick, m.us, CASE WHEN abs(m.us - k.held) > {TOLERANCE} THEN m.us ELSE k.held END, abs(m.us - k.held) > {TOLERANCE} FROM k JOIN m ON m.user_id = k.user_id AND m.j = k.j + 1),
first AS (SELECT user_id, 0 AS tick, CASE WHEN t1 > t THEN t1 - t ELSE 500000 END AS us, n FROM g WHERE i = 0 AND n >= 2),
tempo AS (SELECT user_id, tick, us FROM first UNION ALL SELECT user_id, tick, us FROM k WHERE keep
          UNION ALL SELECT f.user_id, (f.n - 1) * 480, coalesce((SELECT k.held FROM k WHERE k.user_id = f.user_id ORDER BY j DESC LIMIT 1), f.us) FROM first f
          UNION ALL SELECT user_id, 0, 500000 FROM u WHERE user_id NOT IN (SELECT user_id FROM first))"""


def tempo_rows(spark, sf_dir):
    """Only differences of times count, so a user's times stay as they are and the virtual beat stands at the user's first event."""
    e = events(spark, sf_dir)
    beat = F.when(F.col("kind") == "purchase", F.struct("t"))
    users = e.groupBy("user_id").agg(F.min("t").alias("zero"), F.count(beat).alias("n"), F.min(beat["t"]).alias("f"))
    b = beats(spark, sf_dir).where("user_id IS NOT NULL").select("user_id", F.col("beat_t").alias("t"))
    lead_in = users.where("n >= 2 AND f > zero AND user_id IS NOT NULL").select("user_id", F.col("zero").alias("t"))
    parts = fold.parts_for(beats(spark, sf_dir))
    w = Window.partitionBy("user_id").orderBy("t")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one sort for all
    g = b.unionByName(lead_in).repartition(parts, "user_id")
    g = g.withColumns({"i": F.row_number().over(w) - 1, "n": F.count("*").over(whole), "z": F.max("t").over(whole), "t1": F.lead("t").over(w), "t4": F.lead("t", 4).over(w)})
    # the first beat, the measures and the last beat
    side = F.when(F.col("i") == 0, 0).when(F.col("i") == F.col("n") - 1, 2).when(F.expr("i % 4 = 1"), 1)
    us = F.when(F.col("i") == 0, F.when(F.col("t1") > F.col("t"), F.col("t1") - F.col("t")).otherwise(500000)).when(F.col("i") < F.col("n") - 1, F.expr("(coalesce(t4, z) - t) div least(4, n - 1 - i)"))
    rows = g.where("n >= 2").select("user_id", (F.col("i") * 480).cast("long").alias("tick"), side.alias("side"), us.cast("long").alias("us")).where("side IS NOT NULL")

    def event(state, side, us):
        held, first = state or (None, None)
        if side == 0:
            return us, (None, us)
        if side == 2:
            return first if held is None else held, state
        keep = us is not None and (held is None or abs(us - held) > TOLERANCE)
        return us if keep else None, (us if keep else held, first)

    kept = fold.fold_rows(rows, U, ["tick"], ["side", "us"], event, "event_us", "bigint", parts).where("event_us IS NOT NULL").select("user_id", "tick", F.col("event_us").alias("us"))
    flat = users.where("n < 2 OR user_id IS NULL").select("user_id", F.lit(0).cast("long").alias("tick"), F.lit(500000).cast("long").alias("us"))
    return kept.unionByName(flat)


@query("tempo_grid", f"WITH RECURSIVE {VIEWS}, {GRID} SELECT user_id, CAST(tick AS BIGINT) AS tick, us FROM tempo")
def tempo_grid(spark, sf_dir):
    """A tempo event for each measure that differs from the last one kept, a raw lead-in from a virtual first beat, and a closing event."""
    return tempo_rows(spark, sf_dir)


@query(
    "chart_rows",
    f"""
WITH RECURSIVE {VIEWS}, {GRID},
s AS (SELECT user_id, tick, us, coalesce(lead(tick) OVER p, NULL) AS next, CAST(coalesce(sum((nt - tick) // 480 * us) OVER (PARTITION BY user_id ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at FROM (SELECT *, lead(tick) OVER (PARTITION BY user_id ORDER BY tick) AS nt FROM tempo) WINDOW p AS (PARTITION BY user_id ORDER BY tick)),
x AS (SELECT w.user_id, w.event_id, w.start - u.zero AS a, w."end" - u.zero AS z FROM w JOIN u ON u.user_id = w.user_id),
y AS (SELECT user_id, event_id, p.side, CASE WHEN p.side = 0 THEN a ELSE z END AS t FROM x, (SELECT unnest([0, 1]) AS side) p),
j AS (SELECT y.user_id, y.event_id, y.side, CASE WHEN y.t <= 0 THEN 0 ELSE s.tick + CAST(((y.t - s.at) * 480) // s.us AS BIGINT) END AS tick, row_number() OVER (PARTITION BY y.event_id, y.side ORDER BY s.at DESC, s.tick DESC) AS r FROM y JOIN s ON s.user_id = y.user_id AND (s.at < y.t OR s.tick = 0)),
c AS (SELECT user_id, event_id, CAST(max(tick) FILTER (side = 0) AS BIGINT) AS a, CAST(max(tick) FILTER (side = 1) AS BIGINT) AS z FROM j WHERE r = 1 GROUP BY ALL)
SELECT user_id, event_id, a AS start_tick, greatest(a + 48, least(z, coalesce(lead(a) OVER (PARTITION BY user_id ORDER BY a, event_id), z))) AS end_tick, CAST(a // 3840 AS BIGINT) AS phrase FROM c""",
)
def chart_rows(spark, sf_dir):
    """Words on the tempo grid: start and end ticks by the inverse of the tempo events, ends clipped to the next word, phrases of two measures."""
    w = Window.partitionBy("user_id").orderBy("tick")
    t = tempo_rows(spark, sf_dir).withColumn("part", F.expr("(lead(tick) OVER (PARTITION BY user_id ORDER BY tick) - tick) div 480 * us"))
    t = t.withColumn("at", F.coalesce(F.sum("part").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    zero = events(spark, sf_dir).groupBy("user_id").agg(F.min("t").alias("zero"))
    x = words(spark, sf_dir).join(zero, "user_id").select("user_id", "event_id", F.explode(F.array(F.struct(F.lit(0).alias("side"), (F.col("start") - F.col("zero")).alias("t")), F.struct(F.lit(1).alias("side"), (F.col("end") - F.col("zero")).alias("t")))).alias("p")).select("user_id", "event_id", "p.*")
    # the last event that lies before the time, by one union and a window; the first one holds for all times before it
    none = F.lit(None)
    segment = F.struct("at", "tick", "us")
    both = t.select("user_id", F.when(F.col("tick") == 0, F.lit(-(1 << 62))).otherwise(F.col("at")).alias("k"), F.lit(1).alias("o"), "tick", segment.alias("s"), none.cast("long").alias("event_id"), none.cast("int").alias("side"), none.cast("long").alias("t"))
    both = both.unionByName(x.select("user_id", F.col("t").alias("k"), F.lit(0).alias("o"), none.cast("long").alias("tick"), none.cast(both.schema["s"].dataType).alias("s"), "event_id", "side", "t"))
    both = both.withColumn("s", F.last("s", True).over(Window.partitionBy("user_id").orderBy("k", "o", "tick").rowsBetween(Window.unboundedPreceding, 0))).where("side IS NOT NULL")
    both = both.select("user_id", "event_id", "side", F.when(F.col("t") <= 0, 0).otherwise(F.col("s.tick") + F.expr("((t - s.at) * 480) div s.us")).cast("long").alias("tick"))
    c = both.groupBy("user_id", "event_id").agg(F.max(F.when(F.col("side") == 0, F.col("tick"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("tick"))).alias("z"))
    end = F.greatest(F.col("a") + 48, F.least("z", F.coalesce(F.lead("a").over(Window.partitionBy("user_id").orderBy("a", "event_id")), F.col("z"))))
    return c.select("user_id", "event_id", F.col("a").alias("start_tick"), end.alias("end_tick"), F.floor(F.col("a") / 3840).cast("long").alias("phrase"))


@query(
    "overlap_trim",
    f"""
WITH {FRAMES}, w AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n, len(embedding) AS size FROM embeddings)
SELECT label, CAST(i * (size - 6) + bin - 3 AS BIGINT) AS frame, v FROM w JOIN f ON f.vec_id = w.vec_id WHERE bin >= 3 AND bin < size - 3 AND i * (size - 6) + bin - 3 < floor(n * 12000 * (86 / 22050.0::DOUBLE))""",
)
def overlap_trim(spark, sf_dir):
    """Windows of a clip without half of their overlap on each side, end to end, cut to the clip's own length."""
    p = Window.partitionBy("label")
    w = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.size("embedding").alias("size"))
    w = w.withColumns({"i": F.row_number().over(p.orderBy("vec_id")) - 1, "n": F.count("*").over(p)})
    f = frames(spark, sf_dir).join(w, "vec_id").where("bin >= 3 AND bin < size - 3")
    f = f.select("label", (F.col("i") * (F.col("size") - 6) + F.col("bin") - 3).cast("long").alias("frame"), "v", "n")
    return f.where(F.col("frame") < F.floor(F.col("n") * 12000 * F.lit(86 / 22050.0))).drop("n")


BELL = [math.exp(-0.5 * ((k - 25) / 5) ** 2) for k in range(51)]


@query(
    "pitch_bends",
    f"""
WITH b AS (SELECT vec_id, vec_id % len(embedding) AS f, len(embedding) AS n, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS c FROM embeddings),
s AS (SELECT vec_id, f, greatest(f - 25, 0) AS a, least(n, f + 26) AS z, c, {BELL} AS w FROM b),
m AS (SELECT vec_id, f, a, list_transform(range(a, z), lambda i: c[i + 1] * w[i - f + 25 + 1]) AS p FROM s)
SELECT vec_id, CAST(list_position(p, list_max(p)) - 1 + a - f AS BIGINT) AS bend, CAST(greatest(-8192, least(8191, round_even((list_position(p, list_max(p)) - 1 + a - f) * 4096 / 3.0::DOUBLE, 0))) AS BIGINT) AS ticks FROM m""",
)
def pitch_bends(spark, sf_dir):
    """Where a contour row under a bell around its note's bin is highest, in bins from there, and as bend ticks."""
    b = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("c"), F.pmod("vec_id", F.size("embedding")).cast("int").alias("f"))
    b = b.select("vec_id", "f", F.greatest(F.col("f") - 25, F.lit(0)).alias("a"), F.slice("c", F.greatest(F.col("f") - 25, F.lit(0)) + 1, F.lit(51) - F.greatest(F.lit(25) - F.col("f"), F.lit(0))).alias("c"))
    bell = F.slice(F.array(*map(F.lit, BELL)), F.col("a") - F.col("f") + 26, F.size("c"))
    p = F.zip_with("c", bell, lambda x, y: x * y)
    b = b.select("vec_id", (F.array_position(p, F.array_max(p)) - 1 + F.col("a") - F.col("f")).alias("bend"))
    return b.select("vec_id", "bend", F.greatest(F.lit(-8192), F.least(F.lit(8191), F.bround(F.col("bend") * 4096 / 3.0).cast("long"))).cast("long").alias("ticks"))


PARTS, CLUSTER = ("PART BASS", "PART DRUMS", "PART GUITAR"), (60, 72, 84, 96)


@query(
    "placeholder_rows",
    f"""
WITH {VIEWS}, r AS (SELECT user_id, count(*) AS n FROM b GROUP BY user_id), s AS (SELECT DISTINCT e.user_id, CASE WHEN coalesce(n, 0) >= 2 THEN 5760 ELSE 0 END AS begin_tick FROM e LEFT JOIN r ON r.user_id = e.user_id)
SELECT user_id, part, pitch, CAST(begin_tick AS BIGINT) AS on_tick, CAST(begin_tick + 120 AS BIGINT) AS off_tick FROM s, (SELECT unnest({list(PARTS)}) AS part), (SELECT unnest({list(CLUSTER)}) AS pitch)""",
)
def placeholder_rows(spark, sf_dir):
    """A note of each difficulty in each part without a chart, after the count-in."""
    c = count_in(spark, sf_dir).select("user_id", F.col("count_in_ticks").cast("long").alias("on_tick"), F.explode(F.array(*map(F.lit, PARTS))).alias("part"))
    return c.select("user_id", "part", F.explode(F.array(*map(F.lit, CLUSTER))).alias("pitch"), "on_tick", (F.col("on_tick") + 120).alias("off_tick"))


SHOTS = ("coop_all_near", "coop_all_far", "coop_front_behind", "coop_v_near", "coop_gv_near", "coop_g_closeup", "coop_b_behind", "coop_bk_far", "coop_d_near", "coop_k_near")


@query(
    "camera_notes",
    f"""
WITH {EVENTS}, s AS (SELECT user_id, event_id, t, '[' || {list(SHOTS)}[k % {len(SHOTS)} + 1] || ']' AS tag FROM e WHERE kind = 'error'),
p AS (SELECT *, CASE WHEN contains(tag, 'all_') THEN [62, 61, 63, 64] WHEN contains(tag, 'front_') THEN [61, 63, 64] WHEN contains(tag, 'v_') OR contains(tag, '_v') THEN [64] WHEN contains(tag, 'g_') OR contains(tag, '_g') THEN [63]
             WHEN (contains(tag, 'b_') OR contains(tag, '_b')) AND NOT contains(tag, 'behind') THEN [61] WHEN contains(tag, 'd_') OR contains(tag, '_d') THEN [62] WHEN contains(tag, 'k_') OR contains(tag, '_k') THEN [63] ELSE [] END AS who,
             CASE WHEN contains(tag, 'behind') THEN [73] WHEN contains(tag, 'near') OR contains(tag, 'closeup') THEN [70, 72] WHEN contains(tag, 'far') THEN [70, 73, 71] ELSE [] END AS place FROM s)
SELECT user_id, event_id, t, CAST(unnest([60] || who || place) AS INTEGER) AS note FROM p""",
)
def camera_notes(spark, sf_dir):
    """A camera tag's set of notes: the cut, the players in it and the placements that it allows."""
    has = lambda *parts: F.expr(" OR ".join(f"contains(tag, '{p}')" for p in parts))
    some = lambda *n: F.array(*map(F.lit, n))
    none = F.array().cast("array<int>")
    s = events(spark, sf_dir, "error").select("user_id", "event_id", "t", F.concat(F.lit("["), F.element_at(some(*SHOTS), (F.col("k") % len(SHOTS) + 1).cast("int")), F.lit("]")).alias("tag"))
    who = F.when(has("all_"), some(62, 61, 63, 64)).when(has("front_"), some(61, 63, 64)).when(has("v_", "_v"), some(64)).when(has("g_", "_g"), some(63))
    who = who.when(has("b_", "_b") & ~has("behind"), some(61)).when(has("d_", "_d"), some(62)).when(has("k_", "_k"), some(63)).otherwise(none)
    place = F.when(has("behind"), some(73)).when(has("near", "closeup"), some(70, 72)).when(has("far"), some(70, 73, 71)).otherwise(none)
    return s.select("user_id", "event_id", "t", F.explode(F.concat(some(60), who, place)).alias("note"))


@query(
    "exclusive_throttle",
    f"""
WITH RECURSIVE {EVENTS}, s AS (SELECT user_id, event_id, t, k % 2 AS kind, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM e),
f AS (SELECT user_id, 0::BIGINT AS i, 0::BIGINT AS event_id, 0::BIGINT AS t, 0 AS kind, [-1, -1]::BIGINT[] AS ends, false AS keep FROM (SELECT DISTINCT user_id FROM s)
      UNION ALL SELECT s.user_id, s.i, s.event_id, s.t, s.kind, CASE WHEN s.t > f.ends[2 - s.kind] THEN CASE s.kind WHEN 0 THEN [s.t + {6 * HOUR}, f.ends[2]] ELSE [f.ends[1], s.t + {6 * HOUR}] END ELSE f.ends END, s.t > f.ends[2 - s.kind] FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1)
SELECT user_id, event_id, t, CAST(kind AS INTEGER) AS kind FROM f WHERE keep""",
)
def exclusive_throttle(spark, sf_dir):
    """Events of two kinds; one is kept unless it falls within the length of the last kept one of the other kind."""

    def step(ends, t, kind):
        ends = ends or (-1, -1)
        keep = t > ends[1 - kind]
        if keep:
            ends = (t + 6 * HOUR, ends[1]) if kind == 0 else (ends[0], t + 6 * HOUR)
        return keep, ends

    e = events(spark, sf_dir).select("user_id", "event_id", "t", (F.col("k") % 2).cast("int").alias("kind"))
    return fold.fold_rows(e, U, ["t", "event_id"], ["t", "kind"], step, "keep", "boolean").where("keep").drop("keep")


@query("keys_animation", f"WITH {VIEWS} SELECT user_id, note_id, CAST(n_start // 1000 AS BIGINT) AS start_ms, CAST((n_end - n_start) // 1000 AS BIGINT) AS length_ms, CAST(1 << (pitch - 48) AS BIGINT) AS keys FROM n WHERE pitch BETWEEN 48 AND 72")
def keys_animation(spark, sf_dir):
    n = notes(spark, sf_dir).where("pitch BETWEEN 48 AND 72")
    return n.select("user_id", "note_id", F.expr("n_start div 1000").alias("start_ms"), F.expr("(n_end - n_start) div 1000").alias("length_ms"), F.expr("shiftleft(1L, cast(pitch - 48 as int))").alias("keys"))


@query(
    "event_flags",
    f"""
WITH {VIEWS}, m AS (SELECT user_id, t, event_id, k % 4 AS mark FROM e WHERE kind = 'error'),
g AS (SELECT user_id, arg_max(t, (t, event_id)) FILTER (mark IN (0, 2)) AS preview_start, arg_max(CASE WHEN mark = 2 THEN t + {30 * MIN} ELSE t END, (t, event_id)) FILTER (mark IN (1, 2)) AS preview_end, coalesce(bool_or(mark = 3), false) AS coda FROM m GROUP BY user_id),
l AS (SELECT user_id, arg_max(beat_id, (beat_t, beat_id)) AS last_fill FROM b GROUP BY user_id)
SELECT u.user_id, preview_start, preview_end, CASE WHEN coda THEN last_fill END AS ending_fill FROM (SELECT DISTINCT user_id FROM e) u LEFT JOIN g ON g.user_id = u.user_id LEFT JOIN l ON l.user_id = u.user_id""",
)
def event_flags(spark, sf_dir):
    """Preview window from the last mark of each kind, and the last fill where there is a coda."""
    e = events(spark, sf_dir)
    error, mark, at = F.col("kind") == "error", F.col("k") % 4, F.struct("t", "event_id")
    end = F.when(mark == 2, F.col("t") + F.lit(30 * MIN).cast("long")).otherwise(F.col("t"))
    return e.groupBy("user_id").agg(
        F.max_by("t", F.when(error & mark.isin(0, 2), at)).alias("preview_start"),
        F.max_by(end, F.when(error & mark.isin(1, 2), at)).alias("preview_end"),
        F.when(F.coalesce(F.bool_or(error & (mark == 3)), F.lit(False)), F.max_by(F.col("event_id"), F.when(F.col("kind") == "purchase", at))).alias("ending_fill"),
    )


ENTRY = """
t AS (SELECT p_brand, p_partkey, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n, p_size % 2 = 1 AS is_dir, CASE WHEN p_size % 7 = 0 THEN 65535 ELSE (p_partkey * 7) % 120 END AS parent,
             p_partkey % 400 AS start_block, CAST(floor(p_retailprice * 40) AS BIGINT) AS size FROM part)"""
PHYSICAL = "{0} + ({0} + 170) // 170 + CASE WHEN {0} >= 170 THEN ({0} + 28900) // 28900 ELSE 0 END + CASE WHEN {0} >= 28900 THEN 1 ELSE 0 END"


@query(
    "entry_errors",
    f"""
WITH {ENTRY}, b AS (SELECT *, start_block + (size + 4095) // 4096 - 1 AS last FROM t)
SELECT a.p_brand, a.p_partkey, CASE WHEN a.parent >= a.n THEN 'parent out of bounds' ELSE 'parent is a file' END AS error FROM t a LEFT JOIN t p ON p.p_brand = a.p_brand AND p.i = a.parent WHERE a.parent <> 65535 AND (a.parent >= a.n OR NOT p.is_dir)
UNION ALL
SELECT p_brand, p_partkey, 'payload past end' FROM b WHERE NOT is_dir AND size > 0 AND 49152 + ({PHYSICAL.format("last")}) * 4096 + CASE WHEN size % 4096 = 0 THEN 4096 ELSE size % 4096 END > 1500000""",
)
def entry_errors(spark, sf_dir):
    """Checks of a file table: parents by position in the list, and payloads within the file."""
    p = Window.partitionBy("p_brand")
    t = read(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.col("p_size") % 2 == 1).alias("is_dir"), F.when(F.col("p_size") % 7 == 0, 65535).otherwise(F.col("p_partkey") * 7 % 120).cast("long").alias("parent"), (F.col("p_partkey") % 400).cast("long").alias("start_block"), F.floor(F.col("p_retailprice") * 40).cast("long").alias("size"))
    t = t.withColumns({"i": (F.row_number().over(p.orderBy("p_partkey")) - 1).cast("long"), "n": F.count("*").over(p)})
    up = t.select(F.col("p_brand").alias("_b"), F.col("i").alias("_i"), F.col("is_dir").alias("_dir"))
    j = t.where("parent != 65535").join(up, (F.col("p_brand") == F.col("_b")) & (F.col("parent") == F.col("_i")), "left").where("parent >= n OR NOT _dir")
    parents = j.select("p_brand", "p_partkey", F.when(F.col("parent") >= F.col("n"), "parent out of bounds").otherwise("parent is a file").alias("error"))
    f = t.where("NOT is_dir AND size > 0").withColumn("last", F.expr("start_block + (size + 4095) div 4096 - 1"))
    past = f.where(tree.physical_block("last") * 4096 + 49152 + F.expr("if(size % 4096 = 0, 4096, size % 4096)") > 1_500_000)
    return parents.unionByName(past.select("p_brand", "p_partkey", F.lit("payload past end").alias("error")))


@query(
    "digest_levels",
    """
WITH b AS (SELECT doc_id, unnest(range(0, greatest(1, (length(text) + 3) // 4))) AS i, text FROM documents),
d AS (SELECT doc_id, i, sha1(substr(text, CAST(i * 4 + 1 AS BIGINT), 4)) AS h FROM b),
one AS (SELECT doc_id, CAST(i // 170 AS BIGINT) AS node, sha1(string_agg(h, '' ORDER BY i)) AS digest FROM d GROUP BY ALL)
SELECT doc_id, CAST(node // 170 AS BIGINT) AS node, sha1(string_agg(digest, '' ORDER BY node)) AS digest FROM one GROUP BY ALL""",
)
def digest_levels(spark, sf_dir):
    """Two levels of a hash tree over small blocks, 170 digests a node."""
    return tree.digest_nodes(read(spark, sf_dir, "documents"), "doc_id", "text")


@query("tolerant_diff", "SELECT o_orderkey, round(o_totalprice - s, 2) AS gap FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 + l_tax) * (1 - l_discount)) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE NOT abs(o_totalprice - s) < 0.01 * abs(o_totalprice)")
def tolerant_diff(spark, sf_dir):
    """Orders whose total isn't that of their lines, within a tolerance."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 + F.col("l_tax")) * (1 - F.col("l_discount"))).alias("s"))
    o = read(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    return o.where(~(F.abs(F.col("o_totalprice") - F.col("s")) < F.abs("o_totalprice") * 0.01)).select("o_orderkey", F.round(F.col("o_totalprice") - F.col("s"), 2).alias("gap"))


@query("frequency_bins", "SELECT bin, round(27.5::DOUBLE * pow(pow(2.0::DOUBLE, 1.0 / 36), bin), 6) AS hz FROM range(264) x(bin)")
def frequency_bins(spark, sf_dir):
    """A geometric grid: three bins a semitone over 88 semitones from 27.5 Hz."""
    return spark.range(264).select(F.col("id").alias("bin"), F.round(F.lit(27.5) * F.pow(F.lit(2.0 ** (1.0 / 36)), F.col("id")), 6).alias("hz"))


#: keyframes that every user gets
VENUE = (("lighting", 0, "verse"), ("post_process", 0, "bloom"), ("camera", 0, "all_far"), ("lighting", 3840, "chorus"), ("camera", 3840, "all_near"))


@query("venue_keyframes", f"WITH {EVENTS} SELECT user_id, track, CAST(tick AS BIGINT) AS tick, value FROM (SELECT DISTINCT user_id FROM e), (VALUES {', '.join(map(str, VENUE))}) v(track, tick, value)")
def venue_keyframes(spark, sf_dir):
    """Constant keyframes beside each user's own."""
    rows = F.array(*(F.struct(F.lit(t).alias("track"), F.lit(k).cast("long").alias("tick"), F.lit(v).alias("value")) for t, k, v in VENUE))
    return events(spark, sf_dir).select("user_id").distinct().select("user_id", F.explode(rows).alias("v")).select("user_id", "v.*")


NAMES = "n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'songId' WHEN 1 THEN 'VocalTonicNote' WHEN 2 THEN 'game_origin' ELSE 'a:b?' END || p_size || CASE WHEN p_size % 3 = 0 THEN 'HopoThreshold' ELSE '_x/y' END AS name FROM part)"


@query(
    "name_rules",
    f"""
WITH {NAMES}
SELECT p_partkey, name, lower(regexp_extract(name, '^([^A-Z]*[A-Z]?)', 1) || regexp_replace(substr(name, length(regexp_extract(name, '^([^A-Z]*[A-Z]?)', 1)) + 1), '([A-Z])', '_\\1', 'g')) AS snake,
       array_to_string(list_transform(string_split(name, '_'), lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), '') AS camel,
       regexp_replace(name, '[<>:"/\\\\|?*]', '_', 'g') AS safe, rpad(substr(upper(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')), 1, 12), 12, 'X') || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') AS id FROM n""",
)
def name_rules(spark, sf_dir):
    """Camel to snake case and back, safe file names and ids of fixed width."""
    head = F.when(F.col("p_partkey") % 4 == 0, "songId").when(F.col("p_partkey") % 4 == 1, "VocalTonicNote").when(F.col("p_partkey") % 4 == 2, "game_origin").otherwise("a:b?")
    name = F.concat(head, F.col("p_size").cast("string"), F.when(F.col("p_size") % 3 == 0, "HopoThreshold").otherwise("_x/y"))
    n = read(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    number = F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0")
    return n.select("p_partkey", "name", scalar.camel_to_snake(F.col("name")).alias("snake"), scalar.snake_to_camel(F.col("name")).alias("camel"), scalar.safe_name(F.col("name")).alias("safe"), F.concat(scalar.short_id(F.col("name")), number).alias("id"))


MARKS = ("", "#", "^", "%", "$", "+", "-", "$+")


@query(
    "lyric_flags",
    f"""
WITH {VIEWS}, l AS (SELECT user_id, event_id, CASE WHEN k % 8 IN (5, 7) THEN '' ELSE 'la' || k END || {list(MARKS)}[k % 8 + 1] AS lyric FROM w),
c AS (SELECT *, translate(lyric, '$#^', '') AS clean FROM l)
SELECT user_id, event_id, CASE WHEN clean = '+' THEN '' ELSE clean END AS text, clean = '+' AS slide, contains(lyric, '#') OR contains(lyric, '^') AS unpitched, contains(lyric, '^') AS generous, contains(lyric, '%') AS divider, NOT contains(lyric, '$') AS shown FROM c""",
)
def lyric_flags(spark, sf_dir):
    """Flags that the marks in a lyric stand for, and the lyric without them."""
    lyric = F.concat(F.when((F.col("k") % 8).isin(5, 7), "").otherwise(F.concat(F.lit("la"), F.col("k").cast("string"))), F.element_at(F.array(*map(F.lit, MARKS)), (F.col("k") % 8 + 1).cast("int")))
    l = words(spark, sf_dir).select("user_id", "event_id", lyric.alias("lyric")).withColumn("clean", F.translate("lyric", "$#^", ""))
    has = lambda c: F.contains(F.col("lyric"), F.lit(c))
    slide = F.col("clean") == "+"
    return l.select("user_id", "event_id", F.when(slide, "").otherwise(F.col("clean")).alias("text"), slide.alias("slide"), (has("#") | has("^")).alias("unpitched"), has("^").alias("generous"), has("%").alias("divider"), (~has("$")).alias("shown"))


#: Lighting cues and what they become, in the order in which they are tried.
CUES = (("[lighting (verse)]", "[verse]"), ("[lighting (chorus)]", "[chorus]"), ("[lighting (intro)]", "[lighting ()]"), ("[lighting (blackout_spot)]", "[lighting (silhouettes_spot)]"))


@query(
    "cue_rewrite",
    f"""
WITH {EVENTS}, c AS (SELECT user_id, event_id, t, {[c for c, _ in CUES] + ["[lighting (manual_cool)]", "[next]"]}[k % 6 + 1] AS cue FROM e WHERE kind = 'error')
SELECT user_id, event_id, t, CASE {" ".join(f"WHEN contains(cue, '{a}') THEN '{b}'" for a, b in CUES)} ELSE cue END AS cue FROM c""",
)
def cue_rewrite(spark, sf_dir):
    """Text events rewritten by the first rule whose text they contain."""
    cue = F.element_at(F.array(*(F.lit(c) for c, _ in CUES), F.lit("[lighting (manual_cool)]"), F.lit("[next]")), (F.col("k") % 6 + 1).cast("int"))
    c = events(spark, sf_dir, "error").select("user_id", "event_id", "t", cue.alias("cue"))
    rule = None
    for a, b in CUES:
        rule = (F if rule is None else rule).when(F.contains(F.col("cue"), F.lit(a)), b)
    return c.select("user_id", "event_id", "t", rule.otherwise(F.col("cue")).alias("cue"))


@query("pinned_order", "SELECT p_brand, p_partkey, CAST(r AS BIGINT) AS place FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size = 1 THEN 0 ELSE 1 END, p_name, p_size DESC, p_partkey) AS r FROM part) WHERE r > 2 AND r <= 12")
def pinned_order(spark, sf_dir):
    """Rows in the order of several keys, pinned ones first; two skipped, ten taken."""
    w = Window.partitionBy("p_brand").orderBy(F.when(F.col("p_size") == 1, 0).otherwise(1), "p_name", F.desc("p_size"), "p_partkey")
    return read(spark, sf_dir, "part").select("p_brand", "p_partkey", F.row_number().over(w).cast("long").alias("place")).where("place > 2 AND place <= 12")


@query("track_totals", f"WITH {EVENTS}, k AS (SELECT user_id, kind, max(t) AS last, count(*) AS n FROM e GROUP BY ALL) SELECT user_id, max(last) AS longest, arg_max(last, kind) AS of_last_track, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY user_id")
def track_totals(spark, sf_dir):
    """The end of the longest track, and that of the last track by name."""
    k = events(spark, sf_dir).groupBy("user_id", "kind").agg(F.max("t").alias("last"), F.count("*").alias("n"))
    return k.groupBy("user_id").agg(F.max("last").alias("longest"), F.max_by("last", "kind").alias("of_last_track"), F.sum("n").alias("n"))


@query("folder_sizes", "SELECT p_brand, shelf, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS size FROM (SELECT *, p_partkey % 5 AS shelf FROM part) GROUP BY ROLLUP (p_brand, shelf)")
def folder_sizes(spark, sf_dir):
    """The size of a folder is that of its entries, at every level."""
    return read(spark, sf_dir, "part").withColumn("shelf", F.col("p_partkey") % 5).rollup("p_brand", "shelf").agg(F.count("*").alias("n"), F.sum("p_size").cast("long").alias("size"))


@query("array_extremes", f"WITH {FRAMES} SELECT label, bin, round(max(v), 9) AS high, round(min(v), 9) AS low FROM f JOIN embeddings e ON e.vec_id = f.vec_id GROUP BY ALL")
def array_extremes(spark, sf_dir):
    """Element-wise largest and smallest values over a label's arrays."""
    e = read(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("bin", "v"))
    return e.groupBy("label", F.col("bin").cast("long").alias("bin")).agg(F.round(F.max(F.col("v").cast("double")), 9).alias("high"), F.round(F.min(F.col("v").cast("double")), 9).alias("low"))


@query("mean_tempo", f"WITH {VIEWS}, x AS (SELECT user_id, avg(60.0::DOUBLE / k) AS bpm FROM b WHERE k > 50 GROUP BY user_id) SELECT u.user_id, round(coalesce(bpm, 120.0), 9) AS bpm FROM (SELECT DISTINCT user_id FROM e) u LEFT JOIN x ON x.user_id = u.user_id")
def mean_tempo(spark, sf_dir):
    """The average tempo, 120 without any."""
    e = events(spark, sf_dir)
    bpm = F.avg(F.when((F.col("kind") == "purchase") & (F.col("k") > 50), F.lit(60.0) / F.col("k")))
    return e.groupBy("user_id").agg(F.round(F.coalesce(bpm, F.lit(120.0)), 9).alias("bpm"))


@query("metadata_text", "SELECT o_orderkey, '(' || chr(13) || chr(10) || '   (id ' || o_orderkey || ')' || chr(13) || chr(10) || '   (artist \"' || replace(c_name, '\"', '\\q') || '\")' || chr(13) || chr(10) || '   (rank ' || CASE WHEN o_totalprice > 100000 THEN 2 ELSE 1 END || ')' || chr(13) || chr(10) || ')' AS text FROM orders JOIN customer ON c_custkey = o_custkey")
def metadata_text(spark, sf_dir):
    """Metadata as text, a field a line."""
    j = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    artist = F.replace(F.col("c_name"), F.lit('"'), F.lit("\\q"))
    lines = F.concat_ws("\r\n", F.lit("("), F.format_string("   (id %d)", "o_orderkey"), F.format_string('   (artist "%s")', artist), F.format_string("   (rank %d)", F.when(F.col("o_totalprice") > 100000, 2).otherwise(1)), F.lit(")"))
    return j.select("o_orderkey", lines.alias("text"))


#: channels of an instrument by how many it has; what is left over is filled with tracks of their own
GROUPS = {("drum", 2): [0, 1], ("drum", 3): [0, 1, 1], ("drum", 4): [0, 1, 2, 2], ("drum", 5): [0, 1, 2, 3, 3], ("drum", 6): [0, 1, 2, 3, 4, 4], ("bass", 1): [0], ("bass", 2): [0, 0], ("vocals", 1): [0], ("vocals", 2): [0, 0]}


@query(
    "channel_groups",
    f"""
WITH {EVENTS}, c AS (SELECT user_id, CASE k % 3 WHEN 0 THEN 'drum' WHEN 1 THEN 'bass' ELSE 'vocals' END AS instrument, least(6, 1 + count(*) // 4) AS n FROM e GROUP BY ALL),
g(instrument, n, groups) AS (VALUES {", ".join(f"('{i}', {n}, {g})" for (i, n), g in GROUPS.items())})
SELECT c.user_id, c.instrument, CAST(c.n AS INTEGER) AS n, CAST(p.channel AS INTEGER) AS channel, CAST(CASE WHEN g.groups IS NULL THEN p.channel ELSE g.groups[p.channel + 1] END AS INTEGER) AS track, g.groups IS NULL AS filler
FROM c LEFT JOIN g ON g.instrument = c.instrument AND g.n = c.n, LATERAL (SELECT unnest(range(0, c.n)) AS channel) p""",
)
def channel_groups(spark, sf_dir):
    """Channels of each instrument to tracks, by a table of instrument and count; counts that it lacks give a track a channel."""
    kinds = F.when(F.col("k") % 3 == 0, "drum").when(F.col("k") % 3 == 1, "bass").otherwise("vocals")
    c = events(spark, sf_dir).groupBy("user_id", kinds.alias("instrument")).agg(F.least(F.lit(6), F.expr("1 + count(*) div 4")).cast("int").alias("n"))
    g = spark.createDataFrame([(i, n, g) for (i, n), g in GROUPS.items()], "instrument string, n int, groups array<int>")
    j = c.join(F.broadcast(g), ["instrument", "n"], "left")  # nine rows
    j = j.select("user_id", "instrument", "n", "groups", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("channel"))
    return j.select("user_id", "instrument", "n", "channel", F.coalesce(F.get("groups", F.col("channel")), "channel").alias("track"), F.col("groups").isNull().alias("filler"))
