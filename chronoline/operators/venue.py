"""A venue track from one format to an older one: text cues become other cues, notes, or nothing.

Messages are rows (song, seq, tick, key, velocity, text); notes have a key, cues a text. Rules are tried in order, and the
first whose text a cue contains decides. Three kinds of cue depend on what was accepted before: camera cuts keep
their distance from the last one kept, and first and next frames exclude each other; they go through one
fold, split where a gap clears its state. Effects depend on the cue before only, which is a window.

Defined results: cues without "[" and messages without key and text stay; a track without any cue of the newer
format stays as it is; of equal ticks the lower seq comes first; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoline.operators import fold

#: Fixed values of the two formats.
TPQN, LENGTH, VELOCITY = 480, 120, 96
NEWER = (".pp]", "[coop", "[directed")
NO_KEYS_SPOTLIGHT, FIRST_FRAME, NEXT_FRAME = 41, 50, 48
DIRECTED = (
    ("[directed_vocals_cam_pt]", "[directed_vocals_cam]"),
    ("[directed_vocals_cam_pr]", "[directed_vocals_cam]"),
    ("[directed_guitar_cam_pt]", "[directed_guitar_cam]"),
    ("[directed_guitar_cam_pr]", "[directed_guitar_cam]"),
    ("[directed_crowd]", "[directed_crowd_g]"),
    ("[directed_duo_drums]", "[directed_drums]"),
    ("[directed_duo_kv]", "[directed_duo_guitar]"),
    ("[directed_duo_kb]", "[directed_duo_gb]"),
    ("[directed_duo_kg]", "[directed_duo_gb]"),
    ("[directed_keys]", "[directed_crowd_b]"),
    ("[directed_keys_cam]", "[directed_crowd_b]"),
    ("[directed_keys_np]", "[directed_crowd_b]"),
    ("[directed", "[do_directed_cut directed"),
)
#: cue -> what it becomes, after the cues of frames
CUES = (("[lighting (verse)]", "[verse]"), ("[lighting (chorus)]", "[chorus]"), ("[lighting (intro)]", "[lighting ()]"), ("[lighting (blackout_spot)]", "[lighting (silhouettes_spot)]"))
EFFECTS = {
    96: ("[ProFilm_a.pp]", "[ProFilm_b.pp]"),
    97: ("[film_contrast.pp]", "[film_contrast_green.pp]", "[film_contrast_red.pp]", "[contrast_a.pp]"),
    98: ("[desat_posterize_trails.pp]", "[film_16mm.pp]"),
    99: ("[film_sepia_ink.pp]",),
    100: ("[film_silvertone.pp]",),
    101: ("[horror_movie_special.pp]", "[ProFilm_psychedelic_blue_red.pp]", "[photo_negative.pp]"),
    102: ("[photocopy.pp]",),
    103: ("[posterize.pp]", "[bloom.pp]"),
    104: ("[bright.pp]",),
    105: ("[ProFilm_mirror_a.pp]",),
    106: ("[desat_blue.pp]", "[film_contrast_blue.pp]", "[film_blue_filter.pp]"),
    107: ("[video_a.pp]",),
    108: ("[video_bw.pp]", "[film_b+w.pp]"),
    109: ("[shitty_tv.pp]", "[video_security.pp]"),
    110: ("[video_trails.pp]", "[flicker_trails.pp]", "[space_woosh.pp]", "[clean_trails.pp]"),
}
#: players and placements of a camera cut: parts of its name, a part that it must not have, notes
CUT = 60
PLAYERS = (
    (("all_",), None, (61, 62, 63, 64)),
    (("front_",), None, (61, 63, 64)),
    (("v_", "_v"), None, (64,)),
    (("g_", "_g"), None, (63,)),
    (("b_", "_b"), "behind", (61,)),
    (("d_", "_d"), None, (62,)),
    (("k_", "_k"), None, (63,)),
)
PLACES = ((("behind",), None, (73,)), (("near", "closeup"), None, (70, 72)), (("far",), None, (70, 71, 73)))
#: what a cue is, by the first rule that holds
LEAVE, TEXT, FIRST, NEXT, EFFECT, CAMERA = range(6)


def _has(cue: Column, *parts: str) -> Column:
    out = F.contains(cue, F.lit(parts[0]))
    for p in parts[1:]:
        out = out | F.contains(cue, F.lit(p))
    return out


def _first(rules: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = None
    for holds, value in rules:
        out = (F if out is None else out).when(holds, value)
    return out.otherwise(otherwise)


def _notes(cue: Column, table) -> Column:
    rules = [(_has(cue, *parts) & ~_has(cue, but) if but else _has(cue, *parts), F.array(*map(F.lit, notes))) for parts, but, notes in table]
    return _first(rules, F.array().cast("array<int>"))


def accept(state, tick, what):
    """Whether a frame or cut is kept, with the ends of the last first frame, next frame and cut kept."""
    first, after, cut = state or (0, 0, -1)
    if what == FIRST:
        keep = tick > after
        return keep, (tick + LENGTH if keep else first, after, cut)
    if what == NEXT:
        keep = tick > first
        return keep, (first, tick + LENGTH if keep else after, cut)
    keep = tick > cut
    return keep, (first, after, tick + LENGTH if keep else cut)


def rewrite(messages: DataFrame) -> DataFrame:
    """(song, action, place, tick, key, velocity, text): ``removed`` messages, and those ``kept`` and ``added``, by place in the new
    track; its end is a message with the text "end of track"."""
    m = messages.select("song", "seq", "tick", "key", "velocity", "text")
    newer = F.max(F.coalesce(_has(F.col("text"), *NEWER), F.lit(False))).over(Window.partitionBy("song"))
    m = m.withColumn("newer", newer)
    at = F.instr("text", "[")
    cue = F.when((at > 0) & F.col("newer"), F.trim(F.substring(F.col("text"), at, F.length("text"))))
    m = m.withColumn("cue", cue)
    c = F.col("cue")
    directed = c
    for a, b in DIRECTED:
        directed = F.replace(directed, F.lit(a), F.lit(b))
    opening = _has(c, "[lighting") & (F.col("tick") == 0)
    lit = F.lit
    what = _first(
        [(c.isNull(), lit(LEAVE)), (_has(c, "[directed"), lit(TEXT)), (opening, lit(TEXT)), (_has(c, "[lighting (manual", "[lighting (dischord)]"), lit(FIRST)), *((_has(c, a), lit(TEXT)) for a, _ in CUES), (_has(c, "[next]"), lit(NEXT)), (_has(c, ".pp]"), lit(EFFECT)), (_has(c, "[coop"), lit(CAMERA))], lit(LEAVE)
    )
    text = _first([(_has(c, "[directed"), directed), (opening, lit("[lighting ()]")), *((_has(c, a), lit(b)) for a, b in CUES)], lit(None).cast("string"))
    effect = _first([(c.isin(*names), lit(note)) for note, names in EFFECTS.items()], lit(0))
    m = m.withColumns({"what": what, "cue_text": text, "effect": F.when(what == EFFECT, effect)})

    # effects: another note than the cue before's, a measure or more after it
    order = Window.partitionBy("song").orderBy("tick", "seq")
    effects = Window.partitionBy("song", F.col("what") == EFFECT).orderBy("tick", "seq")
    new = (F.col("effect") > 0) & (F.col("effect") != F.coalesce(F.lag("effect").over(effects), lit(0))) & (F.col("tick") >= F.coalesce(F.lag("tick").over(effects) + 4 * TPQN, lit(0)))
    m = m.withColumn("new_effect", F.when(F.col("what") == EFFECT, new))

    # frames and cuts: one fold for each stretch without a gap that would clear its state
    bound = m.where(F.col("what").isin(FIRST, NEXT, CAMERA)).select("song", "seq", "tick", "what", "cue", "text")
    bound = bound.withColumn("part", F.sum(F.coalesce((F.col("tick") - F.lag("tick").over(order) > LENGTH).cast("int"), lit(0))).over(order))
    bound = fold.fold_rows(bound, ["song", "part"], ["tick", "seq"], ["tick", "what"], accept, "accepted", "boolean")
    note = F.when(F.col("what") == FIRST, F.array(lit(FIRST_FRAME))).when(F.col("what") == NEXT, F.array(lit(NEXT_FRAME))).otherwise(F.concat(F.array(lit(CUT)), _notes(c, PLAYERS), _notes(c, PLACES)))
    # an accepted first frame's own cue stays
    bound = bound.select("song", "seq", "tick", lit(None).cast("int").alias("key"), lit(None).cast("int").alias("velocity"), "text", (F.col("accepted") & (F.col("what") == FIRST)).alias("stays"), F.when(F.col("accepted"), note).alias("notes"), lit(None).cast("string").alias("cue_text"))
    others = m.where(~F.col("what").isin(FIRST, NEXT, CAMERA))
    stays = (F.col("what") == LEAVE) & ~F.coalesce((F.col("key") == NO_KEYS_SPOTLIGHT) & F.col("newer"), lit(False))
    others = others.select("song", "seq", "tick", "key", "velocity", "text", stays.alias("stays"), F.when(F.col("new_effect"), F.array("effect")).alias("notes"), "cue_text")
    judged = others.unionByName(bound)

    # all that a message becomes, the old ones first at their tick
    def message(group: int, n: Column, tick: Column, key: Column | None, velocity: Column | None, text: Column | None) -> Column:
        none = lambda x, kind: lit(None).cast(kind) if x is None else x.cast(kind)
        return F.struct(lit(group).alias("group"), n.cast("int").alias("n"), tick.cast("bigint").alias("tick"), none(key, "int").alias("key"), none(velocity, "int").alias("velocity"), none(text, "string").alias("text"))

    own = F.array(message(0, lit(0), F.col("tick"), F.col("key"), F.col("velocity"), F.col("text")))
    new_text = F.when(F.col("cue_text").isNotNull(), F.array(message(1, lit(0), F.col("tick"), None, None, F.col("cue_text")))).otherwise(F.array().cast(own_type := "array<struct<group:int,n:int,tick:bigint,key:int,velocity:int,text:string>>"))
    on_off = F.flatten(F.transform(F.coalesce("notes", F.array().cast("array<int>")), lambda k, i: F.array(message(1, 2 * i, F.col("tick"), k, lit(VELOCITY), None), message(1, 2 * i + 1, F.col("tick") + LENGTH, k, lit(0), None))))
    becomes = F.concat(F.transform(own, lambda x: F.struct(F.when(F.col("stays"), "kept").otherwise("removed").alias("action"), x.alias("m"))), F.transform(F.concat(new_text, on_off.cast(own_type)), lambda x: F.struct(lit("added").alias("action"), x.alias("m"))))
    rows = judged.select("song", "seq", F.explode(becomes).alias("x")).select("song", "seq", "x.action", "x.m.*")
    # seq -1 and beyond all: the verse that every new track begins with, and its end
    final = m.where("newer").groupBy("song").agg(F.max("tick").alias("last"))
    ends = final.select("song", F.explode(F.array(F.struct(lit(-1).cast("bigint").alias("seq"), lit("added").alias("action"), message(1, lit(0), lit(0), None, None, lit("[verse]")).alias("m")), F.struct(lit((1 << 63) - 1).alias("seq"), lit("added").alias("action"), message(2, lit(0), F.col("last") + 2 * LENGTH, None, None, lit("end of track")).alias("m")))).alias("x"))
    rows = rows.unionByName(ends.select("song", "x.seq", "x.action", "x.m.*"))
    place = F.row_number().over(Window.partitionBy("song", F.col("action") == "removed").orderBy("tick", "group", "seq", "n")) - 1
    return rows.withColumn("place", F.when(F.col("action") != "removed", place).cast("bigint")).select("song", "action", "place", "tick", "key", "velocity", "text")
