"""Chart derivation queries: measures, lanes, chords, phrases, keyframes, markers, blocks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoline.operators import fold, sequence, tree
from chronoline.operators.asof import asof
from chronoline.plans.base import EVENTS, events, query, read
from chronoline.plans.timeline import DAY, HOUR, U, VIEWS, beats, notes, words


@query(
    "measure_boundaries",
    f"""
WITH {VIEWS}, s AS (SELECT user_id, beat_id, beat_t, (2 + k % 3) * {DAY} AS step, coalesce(lead(beat_t) OVER (PARTITION BY user_id ORDER BY beat_t, beat_id), beat_t + 1) AS stop FROM b)
SELECT user_id, beat_id, unnest(range(beat_t, stop, step)) AS at FROM s""",
)
def measure_boundaries(spark, sf_dir):
    """Measures of a signature's length from the signature to the next."""
    b = events(spark, sf_dir, "purchase").select("user_id", F.col("event_id").alias("beat_id"), F.col("t").alias("beat_t"), ((F.col("k") % 3 + 2).cast("long") * DAY).alias("step"))
    b = sequence.until_next(b, U, ["beat_t", "beat_id"], "beat_t", "stop", F.col("beat_t") + 1).where("stop > beat_t")
    return b.select("user_id", "beat_id", F.explode(F.sequence(F.col("beat_t"), F.col("stop") - 1, F.col("step"))).alias("at"))


LANES = [(0, 24, "easy"), (25, 49, "medium"), (50, 74, "hard"), (75, 99, "expert")]


@query(
    "gem_lanes",
    f"""
WITH {EVENTS}, r(lo, hi, difficulty) AS (VALUES {", ".join(map(str, LANES))})
SELECT user_id, difficulty, (k - lo) % 5 AS lane, count(*) AS gems FROM e JOIN r ON k BETWEEN lo AND hi GROUP BY ALL""",
)
def gem_lanes(spark, sf_dir):
    """Keys to difficulties and lanes by ranges, as one CASE instead of a range join."""
    k = F.col("k")
    name = F.when(k < LANES[0][0], None)
    low = F.when(k < LANES[0][0], None)
    for lo, hi, d in LANES:
        name, low = name.when(k <= hi, d), low.when(k <= hi, lo)
    e = events(spark, sf_dir).select("user_id", name.alias("difficulty"), ((k - low) % 5).cast("int").alias("lane")).where("difficulty IS NOT NULL")
    return e.groupBy("user_id", "difficulty", "lane").agg(F.count("*").alias("gems"))


@query("chord_classes", f"WITH {EVENTS} SELECT user_id, CAST(t // {DAY} AS BIGINT) AS day, list_sort(list(DISTINCT k % 12)) AS classes, bit_or(CAST(1 << (k % 12) AS BIGINT)) AS mask FROM e GROUP BY ALL".replace("list_sort(list(DISTINCT k % 12))", "string_agg(DISTINCT lpad(CAST(k % 12 AS VARCHAR), 2, '0'), ' ' ORDER BY lpad(CAST(k % 12 AS VARCHAR), 2, '0'))"))
def chord_classes(spark, sf_dir):
    """Distinct pitch classes of each day, in order, and as a bit mask."""
    e = events(spark, sf_dir).withColumn("day", F.floor(F.col("t") / DAY).cast("long")).withColumn("pc", F.pmod("k", F.lit(12)))
    names = F.transform(F.sort_array(F.collect_set("pc")), lambda p: F.lpad(p.cast("string"), 2, "0"))
    return e.groupBy("user_id", "day").agg(F.array_join(names, " ").alias("classes"), F.expr("bit_or(shiftleft(1L, pc))").alias("mask"))


@query(
    "phrase_of_note",
    f"""
WITH {VIEWS}, p AS (SELECT user_id, CAST(start // {DAY} AS BIGINT) AS phrase, min(start) AS p_start, max("end") AS p_end FROM w GROUP BY ALL),
j AS (SELECT n.user_id, n.note_id, n.pitch, p.phrase, p.p_end, row_number() OVER (PARTITION BY n.note_id ORDER BY p.p_end NULLS LAST, p.phrase) AS r FROM n LEFT JOIN p ON p.user_id = n.user_id AND p.p_end > n.n_start)
SELECT user_id, note_id, pitch, phrase, min(pitch) OVER (PARTITION BY user_id, phrase) AS low, max(pitch) OVER (PARTITION BY user_id, phrase) AS high FROM j WHERE r = 1""",
)
def phrase_of_note(spark, sf_dir):
    """Each note's phrase, the first whose end is past the note, with the phrase's range of pitch."""
    p = sequence.phrases(words(spark, sf_dir), U, DAY).select("user_id", F.col("phrase").cast("long").alias("phrase"), (F.col("phrase_end") - 1).alias("last"))
    out = asof(notes(spark, sf_dir), p, U, "n_start", "last", "forward", tie="phrase", prefix="")
    w = Window.partitionBy("user_id", "phrase")
    return out.select("user_id", "note_id", "pitch", "phrase", F.min("pitch").over(w).alias("low"), F.max("pitch").over(w).alias("high"))


@query(
    "note_words",
    f"""
WITH {VIEWS}, j AS (SELECT n.user_id, n.note_id, w.event_id AS word_id, w.k % 7 = 0 AS slide, row_number() OVER (PARTITION BY n.note_id ORDER BY w.start DESC NULLS LAST, w.event_id) AS r FROM n LEFT JOIN w ON w.user_id = n.user_id AND w.start <= n.n_start)
SELECT user_id, note_id, word_id, slide FROM j WHERE r = 1""",
)
def note_words(spark, sf_dir):
    """Each note with the last word so far."""
    w = words(spark, sf_dir).select("user_id", F.col("event_id").alias("word_id"), "start", (F.col("k") % 7 == 0).alias("slide"))
    return asof(notes(spark, sf_dir), w, U, "n_start", "start", "backward", tie="word_id", prefix="").select("user_id", "note_id", "word_id", "slide")


LEVELS = {"click": ("drums", "play"), "view": ("guitar", "mellow"), "purchase": ("vocals", "intense"), "signup": ("bass", "idle")}


@query(
    "intensity_keyframes",
    f"""
WITH {EVENTS}, m(kind, part, level) AS (VALUES {", ".join(str((k, *v)) for k, v in LEVELS.items())}),
j AS (SELECT user_id, part, level, t, event_id, lag(level) OVER (PARTITION BY user_id, part ORDER BY t, event_id) AS before FROM e JOIN m USING (kind))
SELECT user_id, part, count(*) AS frames, string_agg(CAST(round(t / {HOUR}.0::DOUBLE, 3) AS VARCHAR), ',' ORDER BY t, event_id) AS hours FROM j WHERE before IS DISTINCT FROM level GROUP BY ALL""",
)
def intensity_keyframes(spark, sf_dir):
    """Mapped events as keyframes of each part; frames that repeat the level before are left out."""
    m = F.broadcast(spark.createDataFrame([(k, *v) for k, v in LEVELS.items()], "kind string, part string, level string"))
    j = events(spark, sf_dir).join(m, "kind")
    w = Window.partitionBy("user_id", "part").orderBy("t", "event_id")
    j = j.withColumn("before", F.lag("level").over(w)).where("NOT before <=> level")
    g = j.groupBy("user_id", "part").agg(F.count("*").alias("frames"), F.sort_array(F.collect_list(F.struct("t", "event_id"))).alias("a"))
    return g.select("user_id", "part", "frames", F.array_join(F.transform("a", lambda x: F.round(x["t"] / float(HOUR), 3).cast("string")), ",").alias("hours"))


@query(
    "section_markers",
    f"""
WITH {VIEWS}, g AS (SELECT user_id, min(start) AS a, max("end") AS z FROM w GROUP BY user_id),
m AS (SELECT user_id, unnest(['intro', 'verse', 'preview', 'chorus', 'bridge', 'outro', 'music_end', 'end']) AS marker, unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS i,
             unnest([a, a + (z - a) // 8, {DAY} * 19730, a + (z - a) // 4, a + (z - a) // 2, a + (z - a) // 4 * 3, z, z + {HOUR}]) AS tick FROM g),
d AS (SELECT *, greatest(0, tick - lag(tick, 1, 0) OVER (PARTITION BY user_id ORDER BY i)) AS d FROM m)
SELECT user_id, marker, CAST(sum(d) OVER (PARTITION BY user_id ORDER BY i) AS BIGINT) AS lands_at FROM d""",
)
def section_markers(spark, sf_dir):
    """Eight markers of each song where they land when steps can't go back."""
    g = words(spark, sf_dir).groupBy("user_id").agg(F.min("start").alias("a"), F.max("end").alias("z"))
    places = [("intro", "a"), ("verse", "a + (z - a) div 8"), ("preview", f"{DAY * 19730}L"), ("chorus", "a + (z - a) div 4"), ("bridge", "a + (z - a) div 2"), ("outro", "a + (z - a) div 4 * 3"), ("music_end", "z"), ("end", f"z + {HOUR}L")]
    rows = F.array(*[F.struct(F.lit(k).alias("i"), F.lit(n).alias("marker"), F.expr(x).alias("tick")) for k, (n, x) in enumerate(places)])
    m = g.select("user_id", F.explode(rows).alias("m")).select("user_id", "m.*")
    return sequence.clamped_positions(m, U, ["i"], "tick", "lands_at").select("user_id", "marker", F.col("lands_at").cast("long").alias("lands_at"))


@query("beat_track", f"WITH {VIEWS}, c AS (SELECT user_id, count(*) AS n FROM b GROUP BY user_id), r AS (SELECT user_id, unnest(range(0, n)) AS beat FROM c) SELECT user_id, beat, beat * 480 AS tick, CASE WHEN beat % 4 = 0 THEN 12 ELSE 13 END AS pitch FROM r")
def beat_track(spark, sf_dir):
    c = beats(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"))
    r = c.select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("beat"))
    return r.select("user_id", "beat", (F.col("beat") * 480).alias("tick"), F.when(F.col("beat") % 4 == 0, 12).otherwise(13).alias("pitch"))


@query(
    "ticks_to_times",
    f"""
WITH {VIEWS},
s AS (SELECT user_id, beat_t AS a, lead(beat_t) OVER p AS z, row_number() OVER p - 1 AS i FROM b WINDOW p AS (PARTITION BY user_id ORDER BY beat_t, beat_id)),
q AS (SELECT user_id, i, unnest([i * 480 + 120, i * 480 + 360]) AS tick FROM s)
SELECT q.user_id, q.tick, CAST(trunc(s.a + (s.z - s.a)::DOUBLE * (q.tick - s.i * 480) / 480) AS BIGINT) AS t FROM q JOIN s ON s.user_id = q.user_id AND s.i = q.i WHERE s.z IS NOT NULL""",
)
def ticks_to_times(spark, sf_dir):
    """The inverse of the grid: ticks to times by a backward as-of on the segments' first ticks."""
    p = Window.partitionBy("user_id").orderBy("beat_t", "beat_id")
    s = beats(spark, sf_dir).select("user_id", F.col("beat_t").alias("a"), F.lead("beat_t").over(p).alias("z"), ((F.row_number().over(p) - 1) * 480).cast("long").alias("first_tick"))
    q = s.select("user_id", F.explode(F.array(F.col("first_tick") + 120, F.col("first_tick") + 360)).alias("tick"))
    j = asof(q, s, U, "tick", "first_tick", "backward", prefix="").where("z IS NOT NULL")
    return j.select("user_id", "tick", (F.col("a") + (F.col("z") - F.col("a")).cast("double") * (F.col("tick") - F.col("first_tick")) / 480).cast("long").alias("t"))


@query(
    "hammer_ons",
    f"""
WITH RECURSIVE {EVENTS}, s AS (SELECT user_id, event_id, t, k, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM e),
f AS (SELECT user_id, t, k, i, t AS g FROM s WHERE i = 1
      UNION ALL SELECT s.user_id, s.t, s.k, s.i, CASE WHEN s.t - f.g >= {2 * HOUR} THEN s.t ELSE f.g END FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1),
c AS (SELECT user_id, g AS chord, bit_or(CAST(1 << (k % 5) AS BIGINT)) AS lanes FROM f GROUP BY ALL),
l AS (SELECT *, lag(chord) OVER (PARTITION BY user_id ORDER BY chord) AS pc, lag(lanes) OVER (PARTITION BY user_id ORDER BY chord) AS pl FROM c)
SELECT user_id, chord, lanes, coalesce(chord - pc <= {8 * HOUR} AND lanes <> pl AND bit_count(lanes) = 1, false) AS hammer FROM l""",
)
def hammer_ons(spark, sf_dir):
    """Chords by anchor, then single notes of another lane soon after the chord before."""
    e = fold.anchor_groups(events(spark, sf_dir).select("user_id", "event_id", "t", "k"), U, ["t", "event_id"], "t", 2 * HOUR, "chord")
    c = e.groupBy("user_id", "chord").agg(F.expr("bit_or(shiftleft(1L, pmod(k, 5)))").alias("lanes"))
    w = Window.partitionBy("user_id").orderBy("chord")
    soon = (F.col("chord") - F.lag("chord").over(w) <= 8 * HOUR) & (F.col("lanes") != F.lag("lanes").over(w)) & (F.bit_count("lanes") == 1)
    return c.withColumn("hammer", F.coalesce(soon, F.lit(False)))


@query("payload_blocks", "WITH b AS (SELECT doc_id, unnest(range(0, (length(text) + 1023) // 1024)) AS block, text FROM documents) SELECT doc_id, CAST(block AS BIGINT) AS block, md5(rpad(substr(text, CAST(block * 1024 + 1 AS BIGINT), 1024), 1024, '0')) AS digest FROM b")
def payload_blocks(spark, sf_dir):
    d = read(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", "text", F.explode(F.expr("sequence(0L, (length(text) + 1023) div 1024 - 1)")).alias("block"))
    part = F.rpad(F.substring(F.col("text"), (F.col("block") * 1024 + 1).cast("int"), F.lit(1024)), 1024, "0")
    return d.select("doc_id", "block", F.md5(part.cast("binary")).alias("digest"))


@query(
    "frame_interleave",
    f"""
WITH {EVENTS}, p(kind, i) AS (VALUES ('click', 1), ('view', 2), ('purchase', 3)),
c AS (SELECT user_id, CAST(t // {DAY} AS BIGINT) AS frame, p.i, string_agg(CAST(k AS VARCHAR), ' ' ORDER BY t, event_id) AS ks FROM e JOIN p USING (kind) GROUP BY ALL),
s AS (SELECT user_id, frame, coalesce(max(ks) FILTER (i = 1), '') || '|' || coalesce(max(ks) FILTER (i = 2), '') || '|' || coalesce(max(ks) FILTER (i = 3), '') AS line FROM c GROUP BY ALL),
r AS (SELECT user_id, frame, rtrim(line, '|') AS line FROM s)
SELECT user_id, frame, line, CAST(coalesce(sum(length(line)) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM r""",
)
def frame_interleave(spark, sf_dir):
    """Parts side by side in each frame, empty ones at the end trimmed, with running offsets."""
    e = events(spark, sf_dir).where("kind IN ('click', 'view', 'purchase')").withColumn("frame", F.floor(F.col("t") / DAY).cast("long"))
    of = lambda kind: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("t", "event_id", "k")))), lambda x: x["k"].cast("string")), " ")
    g = e.groupBy("user_id", "frame").agg(F.rtrim(F.concat_ws("|", *map(of, ("click", "view", "purchase"))), F.lit("|")).alias("line"))
    w = Window.partitionBy("user_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    return g.withColumn("offset", F.coalesce(F.sum(F.length("line")).over(w), F.lit(0)).cast("long"))


@query("metadata_fields", "SELECT c_custkey, coalesce(nullif(trim(c_name), ''), 'unknown') AS title, lower(replace(c_mktsegment, ' ', '')) AS genre, c_acctbal > 0 AS is_master, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 2 END AS voice, greatest(0, CAST(trunc(0.25 * c_acctbal) AS BIGINT)) AS preview_start, least(CAST(trunc(greatest(c_acctbal, 0)) AS BIGINT), greatest(0, CAST(trunc(0.25 * c_acctbal) AS BIGINT)) + 30000) AS preview_end FROM customer")
def metadata_fields(spark, sf_dir):
    start = F.greatest(F.lit(0), (0.25 * F.col("c_acctbal")).cast("long")).cast("long")
    name = F.trim("c_name")
    return read(spark, sf_dir, "customer").select("c_custkey", F.when(name != "", name).otherwise("unknown").alias("title"), F.lower(F.replace(F.col("c_mktsegment"), F.lit(" "), F.lit(""))).alias("genre"), (F.col("c_acctbal") > 0).alias("is_master"), F.when(F.col("c_custkey") % 3 == 0, 1).otherwise(2).alias("voice"), start.alias("preview_start"), F.least(F.greatest(F.col("c_acctbal"), F.lit(0.0)).cast("long"), start + 30000).alias("preview_end"))


@query(
    "stem_mix",
    """
WITH f AS (SELECT label, CAST(unnest(range(1, len(embedding) + 1)) AS BIGINT) - 1 AS bin, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
s AS (SELECT label, bin, sum(v) AS v FROM f GROUP BY ALL), m AS (SELECT label, max(abs(v)) AS m FROM s GROUP BY label)
SELECT s.label, bin, round(CASE WHEN m > 1 THEN v / m ELSE v END, 9) AS v FROM s JOIN m ON s.label = m.label""",
)
def stem_mix(spark, sf_dir):
    """Signals of a label added up sample by sample, scaled down where the peak is over 1."""
    from chronoline.operators.stats import peak_normalized

    f = read(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("bin", "v"))
    s = f.groupBy("label", F.col("bin").cast("long").alias("bin")).agg(F.sum(F.col("v").cast("double")).alias("v"))
    return peak_normalized(s, ["label"], "v").withColumn("v", F.round("v", 9))


@query("frame_times", "WITH f AS (SELECT vec_id, CAST(unnest(range(0, len(embedding))) AS BIGINT) AS frame FROM embeddings) SELECT vec_id, frame, round(frame * 256 / 22050.0::DOUBLE - 0.0018 * (frame // 172), 9) AS t FROM f")
def frame_times(spark, sf_dir):
    """Frame numbers to seconds, with a correction for every window of 172 frames."""
    f = read(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0).cast("long"), (F.size("embedding") - 1).cast("long"))).alias("frame"))
    return f.select("vec_id", "frame", F.round(F.col("frame") * 256 / F.lit(22050.0) - 0.0018 * F.expr("frame div 172"), 9).alias("t"))


CHAINS = """
WITH RECURSIVE c AS (
  SELECT p_partkey AS head, p_partkey AS block, 0 AS step FROM part p WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_partkey * 2 = p.p_partkey AND q.p_partkey <> p.p_partkey)
  UNION ALL SELECT c.head, p.p_partkey, c.step + 1 FROM c JOIN part p ON p.p_partkey = c.block * 2 AND p.p_partkey <> c.block)
SELECT head, block, CAST(step AS BIGINT) AS step FROM c"""


@query("block_chains", CHAINS)
def block_chains(spark, sf_dir):
    """Chains of blocks by their next pointers from every head, without any limit."""
    return tree.chains(read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 2).alias("next")), "p_partkey", "next")


@query("block_chain", CHAINS.replace("SELECT head, block, CAST(step AS BIGINT) AS step FROM c", "SELECT head, CAST(max(step) AS BIGINT) AS steps, arg_max(block, step) AS last FROM c GROUP BY head"))
def block_chain(spark, sf_dir):
    """The length and the last block of every chain."""
    c = block_chains(spark, sf_dir)
    return c.groupBy("head").agg(F.max("step").alias("steps"), F.max_by("block", "step").alias("last"))
