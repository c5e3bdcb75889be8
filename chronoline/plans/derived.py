"""Whole derivations: notes from activations, and the charts of each instrument from its notes and markers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoline.operators import activations, gems, venue, vocals
from chronoline.plans.base import EVENTS, events, query, read
from chronoline.sources import midi

ONSET, LOUD, SHORTEST, TOLERANCE = 0.2, 0.15, 2, 3
BELL = [f"exp(-0.5 * pow(({k} - 25) / 5.0::DOUBLE, 2))" for k in range(51)]


@query(
    "activation_notes",
    f"""
WITH RECURSIVE e AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS f, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS v FROM embeddings),
t AS (SELECT label, f, unnest(range(64)) AS b, unnest(v) AS v FROM e),
d AS (SELECT *, CASE WHEN f < 2 THEN 0 ELSE greatest(0, least(v - lag(v, 1) OVER p, v - lag(v, 2) OVER p)) END AS rise FROM t WINDOW p AS (PARTITION BY label, b ORDER BY f)),
o AS (SELECT label, f, b, greatest(v, CASE WHEN max(rise) OVER q > 0 THEN max(v) OVER q * rise / max(rise) OVER q ELSE 0 END) AS o FROM d WINDOW q AS (PARTITION BY label)),
k AS (SELECT label, f, b, row_number() OVER (PARTITION BY label ORDER BY f DESC, b DESC) AS k FROM (SELECT *, o >= {ONSET} AND o > lag(o) OVER p AND o > lead(o) OVER p AS peak FROM o WINDOW p AS (PARTITION BY label, b ORDER BY f)) WHERE peak),
m AS (SELECT label, list(v ORDER BY f, b) AS v, max(f) + 1 AS n FROM t GROUP BY label),
r AS (
  SELECT label, CAST(0 AS BIGINT) AS step, v AS rem, n, 0 AS z, 0 AS a, 0 AS b, false AS ok FROM m
  UNION ALL
  SELECT label, step, CASE WHEN onset AND NOT ok THEN rem ELSE list_transform(rem, lambda x, i: CASE
           WHEN onset THEN (CASE WHEN abs((i - 1) % 64 - b) <= 1 AND (i - 1) // 64 BETWEEN a AND z - 1 THEN 0 ELSE x END)
           WHEN i - 1 = f * 64 + b THEN 0
           WHEN abs((i - 1) % 64 - b) <= 1 AND (((i - 1) // 64 BETWEEN f + 1 AND least(z + {TOLERANCE}, n - 2)) OR ((i - 1) // 64 BETWEEN greatest(a - {TOLERANCE}, 1) AND f - 1)) THEN 0 ELSE x END) END, n, z, a, b, ok
  FROM (SELECT *, z - a > {SHORTEST} AS ok FROM (SELECT *, CASE WHEN onset THEN hi + 1 ELSE hi END AS z, CASE WHEN onset THEN f ELSE lo END AS a FROM (
    SELECT *, list_reduce(list_prepend(f, list_filter(range(f + 1, n - 1), lambda t: rem[t * 64 + b + 1] >= {LOUD})), lambda x, t: CASE WHEN t - x <= {TOLERANCE} THEN t ELSE x END) AS hi,
              list_reduce(list_prepend(f, list_reverse(list_filter(range(1, f), lambda t: rem[t * 64 + b + 1] >= {LOUD}))), lambda x, t: CASE WHEN x - t <= {TOLERANCE} THEN t ELSE x END) AS lo
    FROM (SELECT r.label, r.step + 1 AS step, r.rem, r.n, k.f IS NOT NULL AS onset, coalesce(k.f, (list_position(r.rem, list_max(r.rem)) - 1) // 64) AS f, coalesce(k.b, (list_position(r.rem, list_max(r.rem)) - 1) % 64) AS b
          FROM r LEFT JOIN k ON k.label = r.label AND k.k = r.step + 1 WHERE k.f IS NOT NULL OR list_max(r.rem) > {LOUD}))))),
s AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY step) - 1 AS note, a, z, b FROM r WHERE ok),
bell AS (SELECT [{", ".join(BELL)}] AS w),
y AS (SELECT s.*, list_avg(list_transform(range(a, z), lambda t: m.v[t * 64 + s.b + 1])) AS amplitude,
             list_transform(range(a, z), lambda t: list_transform(range(greatest(0, s.b - 25), least(64, s.b + 26)), lambda i: m.v[t * 64 + i + 1] * w[i - s.b + 26])) AS p FROM s JOIN m ON m.label = s.label, bell)
SELECT label, note, a AS start_frame, z AS end_frame, b + 21 AS pitch, round(amplitude, 6) AS amplitude,
       round(a * 256 / 22050.0::DOUBLE - (a // 172) * {activations.SHIFT!r}::DOUBLE, 6) AS start, round(z * 256 / 22050.0::DOUBLE - (z // 172) * {activations.SHIFT!r}::DOUBLE, 6) AS "end",
       array_to_string(list_transform(p, lambda x: list_position(x, list_max(x)) - 1 + greatest(0, b - 25) - b), ',') AS bends,
       coalesce(max(z) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= a, true) AND coalesce(lead(a) OVER q >= z, true) AS alone
FROM y WINDOW q AS (PARTITION BY label ORDER BY a, z, b, note)""",
)
def activation_notes(spark, sf_dir):
    """Each label's vectors as frames of a clip: onsets and rises, notes by suppression, seconds, bends, and which notes overlap none."""
    e = read(spark, sf_dir, "embeddings")
    f = e.select("label", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long").alias("frame"), F.transform(F.col("embedding").cast("array<double>"), F.abs).alias("v"))
    f = activations.with_rises(f.withColumn("o", F.col("v")), "label", "frame", "v", "o")
    n = activations.notes(f, "label", "frame", "v", "o", ONSET, LOUD, SHORTEST, TOLERANCE)
    n = activations.bent(n, f, "label", "frame", "v", per_semitone=1)
    second = lambda c: F.round(activations.frame_seconds(F.col(c)), 6)
    return n.select("label", "note", "start_frame", "end_frame", "pitch", F.round("amplitude", 6).alias("amplitude"), second("start_frame").alias("start"), second("end_frame").alias("end"), F.array_join(F.col("bends").cast("array<string>"), ",").alias("bends"), activations.alone(n, "label").alias("alone"))


# Charts: a user's events as a song's tracks; a tick is a minute of January 2024, in steps of 60.
TEXTS = ["la", "+", "#ha", "oo^", "ne$", "so%", " ti ", "[idle]", "mi-"]
TICK = "CAST(t // 60000000 - 28401120 AS BIGINT) // 60 * 60"
VOX = f"""{EVENTS},
x AS (SELECT user_id AS song, CAST(1 + event_id % 3 AS INTEGER) AS track, kind, event_id, {TICK} AS tick, CAST(floor(value) AS BIGINT) AS size, k, {TEXTS}[k % 9 + 1] AS text FROM e),
items AS (
  SELECT song, track, event_id * 2 AS seq, tick, CAST(0 AS BIGINT) AS length, NULL AS key, text FROM x WHERE kind IN ('view', 'click')
  UNION ALL SELECT song, track, event_id * 2 + 1, tick, size + 1, 36 + k % 49, NULL FROM x WHERE kind IN ('view', 'signup')
  UNION ALL SELECT song, track, event_id * 2, tick, size * 8 + 60, CASE WHEN k % 3 = 0 THEN 106 ELSE 105 END, NULL FROM x WHERE kind = 'purchase'
  UNION ALL SELECT song, track, event_id * 2, tick, size, [116, 96, 97][k % 3 + 1], NULL FROM x WHERE kind = 'error'),
o AS (SELECT *, coalesce(key IN (105, 106), false) AS is_mark, row_number() OVER (PARTITION BY song, track ORDER BY tick, CASE WHEN key IS NULL THEN 0 ELSE 128 - key END, seq) AS i FROM items),
o1 AS (SELECT *, is_mark AND tick IS DISTINCT FROM max(CASE WHEN is_mark THEN tick END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS begins,
              last_value(CASE WHEN key IS NULL AND length(text) > 0 AND text[1] <> '[' THEN trim(text, ' ') END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS lyric FROM o WINDOW w AS (PARTITION BY song, track ORDER BY i)),
o2 AS (SELECT *, CAST(sum(CAST(begins AS INTEGER)) OVER (PARTITION BY song, track ORDER BY i) AS INTEGER) AS mark FROM o1),
mk AS (SELECT song, mark AS phrase, min(tick) AS begin_at, arg_min(length, i) AS length, sum(CASE WHEN key = 105 THEN 1 ELSE 2 END) AS flags FROM o2 WHERE is_mark AND track = 1 GROUP BY ALL),
sp AS (SELECT song, phrase, CASE WHEN phrase = 1 THEN (begin_at - 640 + 4294967296) % 4294967296 ELSE lag(begin_at + length) OVER (PARTITION BY song ORDER BY phrase) END AS start, begin_at + length AS "end", flags FROM mk
       UNION ALL SELECT song, 0, 0, coalesce((min(CASE WHEN is_mark THEN tick END) - 640 + 4294967296) % 4294967296, 0), 0 FROM o2 WHERE track = 1 GROUP BY song),
ph AS (SELECT song, phrase, start, ("end" - start + 4294967296) % 4294967296 AS length, flags, max(start + ("end" - start + 4294967296) % 4294967296) OVER (PARTITION BY song ORDER BY phrase) AS reach FROM sp),
n0 AS (SELECT o2.*, CASE WHEN track = 1 THEN mark ELSE (SELECT min(phrase) FROM ph WHERE ph.song = o2.song AND ph.reach > o2.tick) END AS phrase FROM o2 WHERE key BETWEEN 36 AND 84),
n1 AS (SELECT n0.*, ph.flags, translate(lyric, '$#^', '') AS plain FROM n0 LEFT JOIN ph ON ph.song = n0.song AND ph.phrase = n0.phrase),
n2 AS (SELECT *, coalesce(plain = '+', false) AS slide, lag(key) OVER w AS pkey, lag(tick + length) OVER w AS pend, lag(phrase) OVER w AS pphrase, lag(flags) OVER w AS pflags, lag(lyric) OVER w AS plyric FROM n1 WINDOW w AS (PARTITION BY song, track ORDER BY i)),
er AS (SELECT song, track, arg_min(error, i) AS error FROM (SELECT *, CASE WHEN lyric IS NULL THEN 'note without lyric' WHEN phrase IS NULL THEN 'note without phrase' WHEN slide AND pkey IS NULL THEN 'starts with +' END AS error FROM n2) WHERE error IS NOT NULL GROUP BY ALL
       UNION ALL SELECT song, track, 'no notes' FROM items GROUP BY ALL HAVING count(*) FILTER (key BETWEEN 36 AND 84) = 0),
n3 AS (SELECT * FROM n2 WHERE (song, track) NOT IN (SELECT (song, track) FROM er)),
nn AS (SELECT song, track, i, 1 AS part, tick, length % 65536 AS length, key, key AS key2, CASE WHEN slide THEN '' ELSE plain END AS lyric, phrase, flags, lead(phrase) OVER (PARTITION BY song, track ORDER BY i) IS DISTINCT FROM phrase AS last_in_phrase, slide AS portamento,
              contains(lyric, '#') OR contains(lyric, '^') AS unpitched, contains(lyric, '^') AS generous, contains(lyric, '%') AS divider, NOT contains(lyric, '$') AS shown FROM n3
       UNION ALL SELECT song, track, i, 0, pend, (tick - pend + 4294967296) % 65536, pkey, key, '', pphrase, pflags, false, true, false, false, false, NOT contains(plyric, '$') FROM n3 WHERE slide),
notes AS (SELECT *, row_number() OVER (PARTITION BY song, track ORDER BY i, part) - 1 AS note FROM nn)"""


def _vocals(spark, sf_dir):
    e = events(spark, sf_dir)
    tick = F.floor((F.floor(F.col("t") / 60_000_000) - 28_401_120) / 60) * 60
    x = e.select(F.col("user_id").alias("song"), (1 + F.col("event_id") % 3).cast("int").alias("track"), "kind", "event_id", tick.alias("tick"), F.floor("value").alias("size"), "k")
    none = F.lit(None)
    text = F.struct((F.col("event_id") * 2).alias("seq"), F.lit(0).cast("bigint").alias("length"), none.cast("int").alias("key"), F.get(F.array(*map(F.lit, TEXTS)), F.col("k") % 9).alias("text"))
    note = F.struct((F.col("event_id") * 2 + 1).alias("seq"), (F.col("size") + 1).alias("length"), (36 + F.col("k") % 49).alias("key"), none.cast("string").alias("text"))
    other = F.when(F.col("kind") == "error", F.get(F.array(F.lit(116), F.lit(96), F.lit(97)), F.col("k") % 3)).when(F.col("k") % 3 == 0, 106).otherwise(105)
    mark = F.struct((F.col("event_id") * 2).alias("seq"), F.when(F.col("kind") == "error", F.col("size")).otherwise(F.col("size") * 8 + 60).alias("length"), other.alias("key"), none.cast("string").alias("text"))
    rows = F.when(F.col("kind") == "view", F.array(text, note)).when(F.col("kind") == "click", F.array(text)).when(F.col("kind") == "signup", F.array(note)).when(F.col("kind").isin("purchase", "error"), F.array(mark))
    items = x.select("song", "track", "tick", F.explode(rows).alias("i")).select("song", "track", "tick", "i.*")
    return vocals.derive(items, x.groupBy("song").agg((F.max("tick") + 1920).alias("end")))


@query(
    "vocal_notes",
    f"""
WITH {VOX}
SELECT song AS user_id, track, note, tick, length, key, key2, lyric, phrase, CAST(flags AS BIGINT) AS flags, last_in_phrase, portamento, unpitched, generous, divider, shown, NULL AS error FROM notes
UNION ALL SELECT song, track, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, error FROM er""",
)
def vocal_notes(spark, sf_dir):
    """The notes of lead and harmonies with lyrics, slides and the phrases they lie in; a row for each track that fails."""
    return _vocals(spark, sf_dir).notes.withColumnRenamed("song", "user_id")


@query(
    "vocal_phrases",
    f"""
WITH {VOX},
b AS (SELECT DISTINCT song, track FROM items WHERE (song, track) NOT IN (SELECT (song, track) FROM er)),
g AS (SELECT song, track, phrase, max(note) + 1 AS end_note, bool_or(NOT unpitched) AS pitched, bool_or(unpitched) AS unpitched FROM notes WHERE part = 1 GROUP BY ALL),
c AS (SELECT DISTINCT song, track, CASE WHEN track = 1 THEN mark ELSE coalesce((SELECT arg_max(m.phrase, m.i) FROM notes m WHERE m.song = o2.song AND m.track = o2.track AND m.part = 1 AND m.i < o2.i), 0) END AS phrase FROM o2 WHERE key IN (96, 97)),
r AS (SELECT song, track, CASE WHEN any_pitched THEN min(low) OVER w END AS low, CASE WHEN any_pitched THEN max(high) OVER w END AS high FROM (SELECT song, track, min(key) AS low, max(key) AS high, bool_or(NOT unpitched) AS any_pitched FROM notes WHERE part = 1 GROUP BY ALL) WINDOW w AS (PARTITION BY song ORDER BY track)),
j AS (SELECT b.song, b.track, ph.*, g.end_note, g.pitched, g.unpitched, r.low, r.high, c.phrase IS NOT NULL AS percussion, coalesce(max(g.end_note) OVER (PARTITION BY b.song, b.track ORDER BY ph.phrase ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM b JOIN ph ON ph.song = b.song LEFT JOIN g ON g.song = b.song AND g.track = b.track AND g.phrase = ph.phrase LEFT JOIN c ON c.song = b.song AND c.track = b.track AND c.phrase = ph.phrase LEFT JOIN r ON r.song = b.song AND r.track = b.track)
SELECT song AS user_id, track, phrase, start, length, CASE WHEN phrase = 0 THEN -1 WHEN track > 1 AND end_note IS NULL THEN 0 ELSE before END AS start_note,
       coalesce(end_note, CASE WHEN phrase = 0 THEN -1 WHEN track > 1 THEN 0 ELSE before END) AS end_note, coalesce(pitched, false) AS pitched, coalesce(unpitched, false) AS unpitched, low, high, percussion, CAST(flags AS BIGINT) AS flags FROM j""",
)
def vocal_phrases(spark, sf_dir):
    """The phrases of every track: the lead's own, the harmonies' taken over."""
    return _vocals(spark, sf_dir).phrases.withColumnRenamed("song", "user_id")


@query(
    "vocal_rests",
    f"""
WITH {VOX},
m AS (SELECT *, tick + length AS stop, coalesce(lag(tick + length) OVER (PARTITION BY song, track ORDER BY i), 0) AS since FROM notes WHERE part = 1),
f AS (SELECT song, track, since + CASE WHEN tick - since > 800 THEN 100 ELSE 50 END AS start, tick - CASE WHEN tick - since > 800 THEN 100 ELSE 50 END AS "end" FROM m WHERE NOT portamento AND tick - since > 600
      UNION ALL SELECT m.song, track, arg_max(stop, i) + 100, s."end" FROM m JOIN (SELECT song, max(tick) + 1920 AS "end" FROM x GROUP BY song) s ON s.song = m.song GROUP BY m.song, track, s."end")
SELECT song AS user_id, track, start, "end" FROM f WHERE track <> 3 UNION ALL SELECT song, 3, start, "end" FROM f WHERE track = 2 AND song IN (SELECT song FROM notes WHERE track = 3)""",
)
def vocal_rests(spark, sf_dir):
    """Stretches without notes; the third track takes the second's."""
    return _vocals(spark, sf_dir).rests.withColumnRenamed("song", "user_id")


VENUE = ["[coop_all_near]", "[next]", "[lighting (manual_cool)]", "[coop_v_far]", "[ProFilm_a.pp]", "[bloom.pp]", "x [directed_vocals_cam_pt] ", "[lighting (verse)]", "[lighting (dischord)]", "[coop_b_behind]", "[posterize.pp]", "[next]", "[coop_bk_closeup]", "[unknown.pp]", "[directed_keys]", "plain", "[lighting (intro)]", "[coop_front_far]", "[idle]"]
MINUTE = "CAST(t // 60000000 - 28401120 AS BIGINT)"


def _any(parts):
    return "(" + " OR ".join(f"contains(cue, '{p}')" for p in parts) + ")"


def _case(table):
    rules = " ".join(f"WHEN {_any(parts)}{f" AND NOT contains(cue, '{but}')" if but else ''} THEN {list(notes)}" for parts, but, notes in table)
    return f"CASE {rules} ELSE []::INTEGER[] END"


def _directed():
    out = "cue"
    for a, b in venue.DIRECTED:
        out = f"replace({out}, '{a}', '{b}')"
    return out


@query(
    "venue_rewrite",
    f"""
WITH RECURSIVE {EVENTS},
m AS (SELECT user_id AS song, event_id AS seq, {MINUTE} AS tick, CASE WHEN kind = 'signup' THEN 37 + 4 * (k % 2) END AS key, CASE WHEN kind = 'signup' THEN 96 END AS velocity, CASE WHEN kind <> 'signup' THEN {VENUE}[k % {len(VENUE)} + 1] END AS text FROM e),
c AS (SELECT *, trim(substr(text, strpos(text, '['))) AS cue FROM m WHERE contains(text, '[')),
w AS (SELECT *, CASE WHEN contains(cue, '[directed') THEN 1 WHEN contains(cue, '[lighting') AND tick = 0 THEN 1 WHEN {_any(["[lighting (manual", "[lighting (dischord)]"])} THEN 2 WHEN {_any([a for a, _ in venue.CUES])} THEN 1 WHEN contains(cue, '[next]') THEN 3 WHEN contains(cue, '.pp]') THEN 4 WHEN contains(cue, '[coop') THEN 5 ELSE 0 END AS what FROM c),
b AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY tick, seq) AS i FROM w WHERE what IN (2, 3, 5)),
f AS (SELECT song, CAST(0 AS BIGINT) AS i, CAST(-9 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS z, CAST(-1 AS BIGINT) AS cut, false AS ok FROM (SELECT DISTINCT song FROM b)
      UNION ALL SELECT song, i, seq, CASE WHEN ok AND what = 2 THEN tick + 120 ELSE a END, CASE WHEN ok AND what = 3 THEN tick + 120 ELSE z END, CASE WHEN ok AND what = 5 THEN tick + 120 ELSE cut END, ok
      FROM (SELECT b.*, f.a, f.z, f.cut, b.tick > CASE b.what WHEN 2 THEN f.z WHEN 3 THEN f.a ELSE f.cut END AS ok FROM f JOIN b ON b.song = f.song AND b.i = f.i + 1)),
p AS (SELECT song, seq, note > 0 AND note <> lag(note, 1, 0) OVER q AND tick >= coalesce(lag(tick) OVER q + 1920, 0) AS ok, note FROM (SELECT *, CASE {" ".join(f"WHEN cue IN ({', '.join(map(repr, names))}) THEN {note}" for note, names in venue.EFFECTS.items())} ELSE 0 END AS note FROM w WHERE what = 4) WINDOW q AS (PARTITION BY song ORDER BY tick, seq)),
j AS (SELECT m.*, w.cue, coalesce(w.what, 0) AS what, coalesce(f.ok, p.ok) AS ok, p.note FROM m LEFT JOIN w ON w.song = m.song AND w.seq = m.seq LEFT JOIN f ON f.song = m.song AND f.seq = m.seq LEFT JOIN p ON p.song = m.song AND p.seq = m.seq),
a AS (SELECT song, seq, tick, unnest(CASE WHEN what = 2 THEN [50] WHEN what = 3 THEN [48] WHEN what = 4 THEN [note] ELSE [60] || {_case(venue.PLAYERS)} || {_case(venue.PLACES)} END) AS key, unnest(range(12)) AS n FROM j WHERE ok),
r AS (
  SELECT song, seq, 0 AS g, 0 AS n, CASE WHEN (what = 0 AND key IS DISTINCT FROM 41) OR (what = 2 AND ok) THEN 'kept' ELSE 'removed' END AS action, tick, key, velocity, text FROM j
  UNION ALL SELECT song, seq, 1, 0, 'added', tick, NULL, NULL, CASE WHEN contains(cue, '[directed') THEN {_directed()} WHEN contains(cue, '[lighting') AND tick = 0 THEN '[lighting ()]' {" ".join(f"WHEN contains(cue, '{x}') THEN '{y}'" for x, y in venue.CUES)} END FROM j WHERE what = 1
  UNION ALL SELECT song, seq, 1, 2 * n, 'added', tick, key, 96, NULL FROM a WHERE key IS NOT NULL
  UNION ALL SELECT song, seq, 1, 2 * n + 1, 'added', tick + 120, key, 0, NULL FROM a WHERE key IS NOT NULL
  UNION ALL SELECT song, -1, 1, 0, 'added', 0, NULL, NULL, '[verse]' FROM (SELECT DISTINCT song FROM m)
  UNION ALL SELECT song, 9223372036854775807, 2, 0, 'added', max(tick) + 240, NULL, NULL, 'end of track' FROM m GROUP BY song)
SELECT song AS user_id, action, CASE WHEN action <> 'removed' THEN row_number() OVER (PARTITION BY song, action = 'removed' ORDER BY tick, g, seq, n) - 1 END AS place, tick, key, velocity, text FROM r
WHERE song IN (SELECT song FROM m WHERE {" OR ".join(f"contains(text, '{x}')" for x in venue.NEWER)})""",
)
def venue_rewrite(spark, sf_dir):
    """Each user's events as a venue track, rewritten: what stays, what goes and what comes in, in the new order."""
    tick = F.floor(F.col("t") / 60_000_000) - 28_401_120
    note = F.col("kind") == "signup"
    m = events(spark, sf_dir).select(F.col("user_id").alias("song"), F.col("event_id").alias("seq"), tick.alias("tick"), F.when(note, 37 + 4 * (F.col("k") % 2)).cast("int").alias("key"), F.when(note, 96).alias("velocity"), F.when(~note, F.get(F.array(*map(F.lit, VENUE)), F.col("k") % len(VENUE))).alias("text"))
    return venue.rewrite(m).withColumnRenamed("song", "user_id")


GEMS = f"""{EVENTS},
x AS (SELECT user_id AS song, event_id AS seq, {TICK} + k % 7 AS tick, CAST(floor(value) AS BIGINT) AS size, k, kind FROM e)"""
GEM_KEY = "[60, 72, 84, 96][k // 25 + 1] + k % 5"
GUITAR = f"""{GEMS},
items AS (SELECT song, seq, tick, CASE WHEN kind IN ('purchase', 'error') THEN size * 16 ELSE size * 3 END AS length,
       CASE kind WHEN 'purchase' THEN [101, 102, 89, 90][k % 4 + 1] WHEN 'error' THEN [126, 127, 116, 103, 120, 40 + k % 20][k % 6 + 1] ELSE {GEM_KEY} END AS key FROM x),
o AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY tick, 127 - key, seq) AS i FROM items),
g AS (SELECT *, CASE WHEN key BETWEEN 60 AND 64 THEN 0 WHEN key BETWEEN 72 AND 76 THEN 1 WHEN key BETWEEN 84 AND 88 THEN 2 WHEN key BETWEEN 96 AND 100 THEN 3 END AS level,
             CASE WHEN key BETWEEN 60 AND 64 THEN key - 60 WHEN key BETWEEN 72 AND 76 THEN key - 72 WHEN key BETWEEN 84 AND 88 THEN key - 84 WHEN key BETWEEN 96 AND 100 THEN key - 96 END AS lane FROM o)"""


def _gem_items(spark, sf_dir, markers):
    e = events(spark, sf_dir)
    tick = F.floor((F.floor(F.col("t") / 60_000_000) - 28_401_120) / 60) * 60 + F.col("k") % 7
    gem = F.get(F.array(*map(F.lit, (60, 72, 84, 96))), F.expr("k div 25").cast("int")) + F.col("k") % 5
    key, length = gem, F.floor("value") * 3
    for kind, keys in markers.items():
        pick = F.get(F.array(*(k if hasattr(k, "alias") else F.lit(k) for k in keys)), F.col("k") % len(keys))
        key, length = F.when(F.col("kind") == kind, pick).otherwise(key), F.when(F.col("kind") == kind, F.floor("value") * 16).otherwise(length)
    return e.select(F.col("user_id").alias("song"), F.col("event_id").alias("seq"), tick.alias("tick"), length.alias("length"), key.cast("int").alias("key"))


def _guitar(spark, sf_dir):
    return gems.guitar(_gem_items(spark, sf_dir, {"purchase": (101, 102, 89, 90), "error": (126, 127, 116, 103, 120, 40 + F.col("k") % 20)}), threshold=1000)


@query(
    "guitar_chords",
    f"""
WITH RECURSIVE {GUITAR},
f AS (SELECT *, CASE WHEN key IN (101, 102) THEN 3 WHEN key IN (89, 90) THEN 2 END AS flevel FROM g),
s AS (SELECT g.*, f.key IN (101, 89) AS force_on, f.tick + f.length > g.tick AS force_open FROM g LEFT JOIN f ON f.song = g.song AND f.i = (SELECT max(i) FROM f q WHERE q.song = g.song AND q.i < g.i AND q.flevel = g.level) WHERE g.lane IS NOT NULL),
n AS (SELECT *, coalesce(force_open AND force_on, false) AS fon, coalesce(force_open AND NOT force_on, false) AS foff, row_number() OVER (PARTITION BY song, level ORDER BY i) AS j FROM s),
c AS (SELECT song, level, j, tick AS chord FROM n WHERE j = 1 UNION ALL SELECT n.song, n.level, n.j, CASE WHEN n.tick - c.chord >= 5 THEN n.tick ELSE c.chord END FROM c JOIN n ON n.song = c.song AND n.level = c.level AND n.j = c.j + 1),
h AS (SELECT song, level, chord, arg_min(length, j) AS length, arg_min(lane, j) AS lane, arg_min(fon, j) AS fon, arg_min(foff, j) AS foff, bit_or(1 << lane) AS lanes, count(*) AS n, bool_and(fon OR j = first_j) AS kept
      FROM (SELECT n.*, c.chord, min(n.j) OVER (PARTITION BY n.song, n.level, c.chord) AS first_j FROM n JOIN c ON c.song = n.song AND c.level = n.level AND c.j = n.j) GROUP BY ALL),
r AS (SELECT *, fon OR (coalesce(chord - lag(chord) OVER w <= 1000 AND (1 << lane) & lag(lanes) OVER w = 0, false) AND NOT foff) AS hammer FROM h WINDOW w AS (PARTITION BY song, level ORDER BY chord))
SELECT song AS user_id, level, chord AS tick, length, CAST(lanes AS INTEGER) AS lanes, hammer AND kept AND level > 1 AS hammer, length <= 120 OR ((hammer OR level <= 2) AND length <= 160) AS no_tail, CASE WHEN n = 1 THEN lane > 1 ELSE lanes & 3 = 0 END AS cymbal FROM r""",
)
def guitar_chords(spark, sf_dir):
    """Chords of each difficulty, hammer-ons by distance and by force markers."""
    return _guitar(spark, sf_dir)[0].withColumnRenamed("song", "user_id")


@query(
    "guitar_marks",
    f"""
WITH {GUITAR},
m AS (SELECT *, tick + length AS "end" FROM g WHERE lane IS NULL),
a AS (SELECT m.song, m.i, g.lane, row_number() OVER (PARTITION BY m.song, m.i ORDER BY g.i) AS n FROM g JOIN m ON m.song = g.song AND m.key IN (126, 127) AND m."end" > g.tick AND m.i = (SELECT max(q.i) FROM m q WHERE q.song = g.song AND q.key = m.key AND q.i < g.i) WHERE g.level = 3),
b AS (SELECT song, i, bit_or(1 << lane) AS lanes, max(CASE WHEN n = 1 THEN lane END) AS first, max(CASE WHEN n = 2 THEN lane END) AS second FROM a GROUP BY ALL),
t AS (SELECT m.song, m.tick, m."end", b.first, b.second, lead(m.i) OVER (PARTITION BY m.song ORDER BY m.i) IS NOT NULL AS follows FROM m LEFT JOIN b ON b.song = m.song AND b.i = m.i WHERE m.key = 127)
SELECT m.song AS user_id, 'tremolo' AS kind, tick, "end", CAST(coalesce(lanes, 0) AS INTEGER) AS lanes, NULL AS first, NULL AS second, NULL AS position FROM m LEFT JOIN b ON b.song = m.song AND b.i = m.i WHERE key = 126
UNION ALL SELECT song, 'trill', tick, "end", NULL, coalesce(first, -1), coalesce(second, CASE WHEN follows THEN first END, -1), NULL FROM t WHERE NOT follows OR first IS NOT NULL
UNION ALL SELECT song, CASE key WHEN 116 THEN 'overdrive' WHEN 103 THEN 'solo' WHEN 120 THEN 'fill' ELSE 'hand' END, tick, "end", NULL, NULL, NULL, CASE WHEN key BETWEEN 40 AND 59 THEN key - 40 END FROM m WHERE key IN (116, 103, 120) OR key BETWEEN 40 AND 59""",
)
def guitar_marks(spark, sf_dir):
    """Tremolos with their lanes, trills with their frets, hand positions and sections."""
    return _guitar(spark, sf_dir)[1].withColumnRenamed("song", "user_id")


DRUMS = f"""{GEMS},
items AS (SELECT song, seq, tick, CASE WHEN kind IN ('purchase', 'error') THEN size * 16 ELSE size * 3 END AS length,
       CASE kind WHEN 'purchase' THEN [110, 111, 112][k % 3 + 1] WHEN 'error' THEN [126, 127, 116, 103, 120][k % 5 + 1] ELSE {GEM_KEY} END AS key FROM x),
o AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY tick, CASE WHEN key <= 100 THEN 127 ELSE key END, length, seq) AS i FROM items),
g AS (SELECT *, CASE WHEN key < 101 THEN [60, 72, 84, 96] END AS f, CASE WHEN key BETWEEN 60 AND 64 THEN 0 WHEN key BETWEEN 72 AND 76 THEN 1 WHEN key BETWEEN 84 AND 88 THEN 2 WHEN key BETWEEN 96 AND 100 THEN 3 END AS level FROM o),
d AS (SELECT * EXCLUDE (f), key - f[level + 1] AS lane, CASE WHEN key BETWEEN 110 AND 112 THEN key - 108 END AS tom FROM g)"""


def _drums(spark, sf_dir):
    return gems.drums(_gem_items(spark, sf_dir, {"purchase": (110, 111, 112), "error": (126, 127, 116, 103, 120)}))


@query(
    "drum_gems",
    f"""
WITH {DRUMS},
l AS (SELECT DISTINCT t.song, (SELECT max(q.i) FROM d q WHERE q.song = t.song AND q.level = v.level AND q.i < t.i) AS i, t.tick, t.tom FROM d t, (VALUES (2), (3)) v(level) WHERE t.tom IS NOT NULL)
SELECT d.song AS user_id, d.level, d.tick, d.length, d.lane,
       d.lane > 1 AND coalesce((SELECT arg_max(t.tick + t.length, t.i) FROM d t WHERE t.song = d.song AND t.tom = d.lane AND t.i < d.i) <= d.tick, true) AND NOT EXISTS (SELECT 1 FROM l WHERE l.song = d.song AND l.i = d.i AND l.tom = d.lane AND l.tick - d.tick < 5) AS cymbal
FROM d WHERE d.lane IS NOT NULL""",
)
def drum_gems(spark, sf_dir):
    """Drum gems, and which of them are cymbals by their lane's tom markers."""
    return _drums(spark, sf_dir)[0].withColumnRenamed("song", "user_id")


@query(
    "drum_marks",
    f"""
WITH {DRUMS},
m AS (SELECT *, tick + length AS "end" FROM d WHERE lane IS NULL AND tom IS NULL),
b AS (SELECT m.song, m.i, bit_or(1 << d.lane) AS lanes FROM d JOIN m ON m.song = d.song AND m.key IN (126, 127) AND m."end" > d.tick AND m.i = (SELECT max(q.i) FROM m q WHERE q.song = d.song AND q.key IN (126, 127) AND q.i < d.i) WHERE d.level = 3 GROUP BY ALL)
SELECT m.song AS user_id, CASE key WHEN 116 THEN 'overdrive' WHEN 103 THEN 'solo' WHEN 120 THEN 'fill' ELSE 'roll' END AS kind, tick, "end", CASE WHEN key IN (126, 127) THEN CAST(coalesce(lanes, 0) AS INTEGER) END AS lanes FROM m LEFT JOIN b ON b.song = m.song AND b.i = m.i""",
)
def drum_marks(spark, sf_dir):
    """Rolls with their lanes, fills and sections."""
    return _drums(spark, sf_dir)[1].withColumnRenamed("song", "user_id")


@query(
    "drum_toms",
    f"""
WITH {DRUMS}, p AS (SELECT song, tick, tick + length AS "end", tom FROM d WHERE tom IS NOT NULL AND length > 0), k AS (SELECT song, tick FROM p UNION SELECT song, "end" FROM p)
SELECT k.song AS user_id, k.tick, CAST(coalesce((SELECT bit_or(1 << p.tom) FROM p WHERE p.song = k.song AND p.tick <= k.tick AND p."end" > k.tick), 0) AS BIGINT) AS flags FROM k""",
)
def drum_toms(spark, sf_dir):
    """The toms that hold from each tick on."""
    return _drums(spark, sf_dir)[2].withColumnRenamed("song", "user_id")


@query(
    "bend_tracks",
    f"""
WITH RECURSIVE {EVENTS},
n AS (SELECT user_id, event_id AS note, CAST({MINUTE} AS DOUBLE) AS start, {MINUTE} + floor(value) * 20 AS "end", 21 + k % 88 AS pitch, k / 100.0::DOUBLE AS amplitude, list_transform(range(k % 4), lambda i: (k + i * 3) % 17 - 8) AS bends,
             row_number() OVER (PARTITION BY user_id ORDER BY t // 60000000, floor(value), event_id) AS i FROM e WHERE kind = 'view'),
v AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS note, CAST(0 AS BIGINT) AS voice, []::DOUBLE[] AS ends FROM (SELECT DISTINCT user_id FROM n)
      UNION ALL SELECT user_id, i, note, at_voice, list_concat(list_concat(ends[:at_voice], [greatest(start, "end")]), ends[at_voice + 2:])
      FROM (SELECT n.*, v.ends, coalesce(list_position(list_transform(v.ends, lambda x: x <= n.start), true) - 1, len(v.ends)) AS at_voice FROM v JOIN n ON n.user_id = v.user_id AND n.i = v.i + 1)),
x AS (SELECT n.*, v.voice FROM n JOIN v ON v.user_id = n.user_id AND v.note = n.note),
b AS (SELECT user_id, voice, note, start, "end", len(bends) AS size, unnest(bends) AS bend, unnest(range(len(bends))) AS j FROM x),
e2 AS (SELECT user_id, voice, note, round_even(start * 440, 0) AS tick, 2 AS rank, 'on' AS kind, pitch AS key, round_even(127 * amplitude, 0) AS velocity FROM x
       UNION ALL SELECT user_id, voice, note, round_even("end" * 440, 0), 0, 'off', pitch, 0 FROM x
       UNION ALL SELECT user_id, voice, note, round_even((start + CASE WHEN size > 1 THEN ("end" - start) * j / (size - 1) ELSE 0 END) * 440, 0), 1, 'bend', greatest(-8192, least(8191, round_even(bend * 4096 / 3.0::DOUBLE, 0))), NULL FROM b)
SELECT user_id, CAST(voice AS INTEGER) AS track, row_number() OVER (PARTITION BY user_id, voice ORDER BY tick, rank, note, key) - 1 AS seq, CAST(tick AS BIGINT) AS tick, kind, CAST(key AS INTEGER) AS key, CAST(velocity AS INTEGER) AS velocity FROM e2""",
)
def bend_tracks(spark, sf_dir):
    """Notes with bends as the events of a file: overlapping notes on tracks of their own, bends between them in order."""
    tick = (F.floor(F.col("t") / 60_000_000) - 28_401_120).cast("double")
    bends = F.when(F.col("k") % 4 > 0, F.transform(F.sequence(F.lit(0), (F.col("k") % 4 - 1)), lambda i: (F.col("k") + i * 3) % 17 - 8))
    n = events(spark, sf_dir, "view").select("user_id", F.col("event_id").alias("note"), tick.alias("start"), (tick + F.floor("value") * 20).alias("end"), (21 + F.col("k") % 88).alias("pitch"), (F.col("k") / 100).alias("amplitude"), bends.alias("bends"))
    return midi.note_rows(n, "user_id").select(F.col("path").cast(n.schema["user_id"].dataType).alias("user_id"), "track", F.col("seq").cast("bigint").alias("seq"), "tick", "kind", "key", "velocity")
