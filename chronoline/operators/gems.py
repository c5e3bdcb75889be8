"""Instrument charts: gems, chords and markers of guitar, bass and drum tracks.

Items are rows (song, seq, tick, length, key): gems of four difficulties and the markers that change
what they mean. Each kind of marker is carried along one window per song and difficulty, so gems meet the marker
that holds at their place without an interval join; chords are anchor groups.

Defined results: items without a key or tick are ignored; equal rows order by seq; a marker of length 0 holds
nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoline.operators import fold, interval

#: Fixed values of the format: first keys of the lanes of easy, medium, hard and expert, five lanes each.
FIRST_KEYS, LANES = (60, 72, 84, 96), 5
#: markers that force hammer-ons: key -> (difficulty, on)
FORCE = {102: (3, False), 101: (3, True), 90: (2, False), 89: (2, True)}
TRILL, TREMOLO, OVERDRIVE, SOLO, FILL, LEFT_HAND = 127, 126, 116, 103, 120, (40, 59)
#: drums: rolls; toms of the yellow, blue and green lane, which otherwise are cymbals
ROLLS, TOMS = (126, 127), {110: 2, 111: 3, 112: 4}
SAME_CHORD, SHORT, HAMMER_SHORT = 5, 120, 160
SONG = ["song"]


def _placed(items: DataFrame, rank: Column) -> DataFrame:
    """Items in the order (tick, rank, seq), with difficulty and lane of those that are gems."""
    k, level, lane = F.col("key"), F.lit(None).cast("int"), F.lit(None).cast("int")
    for d, first in enumerate(FIRST_KEYS):
        inside = k.between(first, first + LANES - 1)
        level, lane = F.when(inside, d).otherwise(level), F.when(inside, k - first).otherwise(lane)
    rows = items.select("song", "seq", F.col("tick").cast("bigint").alias("tick"), F.col("length").cast("bigint").alias("length"), "key").where("key IS NOT NULL AND tick IS NOT NULL")
    return rows.withColumns({"at": F.struct("tick", rank.alias("rank"), "seq"), "level": level, "lane": lane})


def _upto(*keys: str):
    return Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)


def _holding(rows: DataFrame, markers: Column) -> DataFrame:
    """Expert gems with the last of ``markers`` before them, if it is still open there: (song, marker, at, lane)."""
    last = F.last(F.when(markers, F.struct("at", (F.col("tick") + F.col("length")).alias("end"))), ignorenulls=True).over(_upto("song"))
    held = rows.withColumn("marker", last).where((F.col("level") == 3) & (F.col("marker.end") > F.col("tick")))
    return held.select("song", F.col("marker.at").alias("marker"), "at", "lane")


def _spans(rows: DataFrame, which: Column, kind: str) -> DataFrame:
    return rows.where(which).select("song", F.lit(kind).alias("kind"), "tick", (F.col("tick") + F.col("length")).alias("end"))


def guitar(items: DataFrame, threshold: int = 170) -> tuple[DataFrame, DataFrame]:
    """Chords (song, level, tick, length, lanes, hammer, no_tail, cymbal) and marks (song, kind, tick, end, lanes, first,
    second, position).

    A new chord is a hammer-on if it follows the one before within ``threshold`` on a lane that this lacks, unless forced off,
    or if forced on; further gems end that unless forced on where they stand. Of overlapping force markers of a
    difficulty the last one holds, also past its own end, where it forces nothing."""
    rows = _placed(items, 127 - F.col("key"))
    force = None
    for key, (level, on) in FORCE.items():
        force = (F if force is None else force).when(F.col("key") == key, F.struct(F.lit(level).alias("level"), F.lit(on).alias("on"), (F.col("tick") + F.col("length")).alias("end")))
    played = rows.withColumn("force", force).where("level IS NOT NULL OR force IS NOT NULL").withColumn("level", F.coalesce("level", "force.level"))
    played = played.withColumn("state", F.last("force", ignorenulls=True).over(_upto("song", "level"))).where("lane IS NOT NULL")
    open_ = F.coalesce(F.col("state.end") > F.col("tick"), F.lit(False))
    played = played.withColumns({"on": open_ & F.col("state.on"), "off": open_ & ~F.col("state.on")}).fillna(False, ["on", "off"])
    played = fold.anchor_groups(played.select("song", "level", "tick", "length", "lane", "at", "on", "off"), ["song", "level"], ["at"], "tick", SAME_CHORD, "chord")
    first = F.min_by(F.struct("tick", "length", "lane", "on", "off"), "at")
    others_on = F.bool_and(F.when(F.col("at") != F.col("first_at"), F.col("on")))
    w = Window.partitionBy("song", "level", "chord")
    chords = played.withColumn("first_at", F.min("at").over(w)).groupBy("song", "level", "chord").agg(first.alias("first"), F.expr("bit_or(shiftleft(1, lane))").alias("lanes"), F.coalesce(others_on, F.lit(True)).alias("kept"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("song", "level").orderBy("chord")
    soon = (F.col("first.tick") - F.lag("first.tick").over(order) <= threshold) & (F.expr("shiftleft(1, first.lane)").bitwiseAND(F.lag("lanes").over(order)) == 0)
    chords = chords.withColumn("hammer", F.coalesce(soon, F.lit(False)) & ~F.col("first.off") | F.col("first.on"))
    length = F.col("first.length")
    no_tail = (length <= SHORT) | ((F.col("hammer") | (F.col("level") <= 2)) & (length <= HAMMER_SHORT))
    cymbal = F.when(F.col("n") == 1, F.col("first.lane") > 1).otherwise(F.col("lanes").bitwiseAND(F.lit(3)) == 0)
    chords = chords.select("song", "level", F.col("first.tick").alias("tick"), length.alias("length"), "lanes", (F.col("hammer") & F.col("kept") & (F.col("level") > 1)).alias("hammer"), no_tail.alias("no_tail"), cymbal.alias("cymbal"))

    key = F.col("key")
    lanes = _holding(rows, key == TREMOLO).groupBy("song", "marker").agg(F.expr("bit_or(shiftleft(1, lane))").alias("lanes"))
    tremolos = rows.where(key == TREMOLO).withColumn("marker", F.col("at")).join(lanes, ["song", "marker"], "left")
    tremolos = tremolos.select("song", F.lit("tremolo").alias("kind"), "tick", (F.col("tick") + F.col("length")).alias("end"), F.coalesce("lanes", F.lit(0)).alias("lanes"))
    nth = Window.partitionBy("song", "marker").orderBy("at")
    frets = _holding(rows, key == TRILL).withColumn("i", F.row_number().over(nth)).groupBy("song", "marker").agg(F.max(F.when(F.col("i") == 1, F.col("lane"))).alias("first"), F.max(F.when(F.col("i") == 2, F.col("lane"))).alias("second"))
    trills = rows.where(key == TRILL).withColumn("marker", F.col("at")).join(frets, ["song", "marker"], "left")
    # a trill without gems goes, and one with a single fret repeats it, once another trill follows
    follows = F.lead("at").over(Window.partitionBy("song").orderBy("at")).isNotNull()
    trills = trills.withColumn("follows", follows).where("NOT follows OR first IS NOT NULL")
    second = F.coalesce("second", F.when(F.col("follows"), F.col("first")), F.lit(-1))
    trills = trills.select("song", F.lit("trill").alias("kind"), "tick", (F.col("tick") + F.col("length")).alias("end"), F.coalesce("first", F.lit(-1)).alias("first"), second.alias("second"))
    hand = rows.where(key.between(*LEFT_HAND)).select("song", F.lit("hand").alias("kind"), "tick", (F.col("tick") + F.col("length")).alias("end"), (key - LEFT_HAND[0]).alias("position"))
    marks = tremolos
    for more in (trills, hand, _spans(rows, key == OVERDRIVE, "overdrive"), _spans(rows, key == SOLO, "solo"), _spans(rows, key == FILL, "fill")):
        marks = marks.unionByName(more, allowMissingColumns=True)
    return chords, marks


def drums(items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gems (song, level, tick, length, lane, cymbal), marks (song, kind, tick, end, lanes), and the toms that hold from each
    tick on (song, tick, flags).

    Gems of the lanes above two are cymbals, unless their lane's last tom marker is still open. A tom marker that comes
    less than 5 ticks late still holds for the last gem of hard and expert. Toms of one lane are taken as merged."""
    key = F.col("key")
    rank = F.struct(F.when(key <= FIRST_KEYS[-1] + LANES - 1, 127).otherwise(key).alias("key"), F.col("length").alias("length"))
    rows = _placed(items, rank)
    tom = None
    for k, lane in TOMS.items():
        tom = (F if tom is None else tom).when(key == k, lane)
    by_lane = rows.withColumns({"tom": tom}).withColumn("own", F.coalesce("lane", "tom"))
    end = F.last(F.when(F.col("tom").isNotNull(), F.col("tick") + F.col("length")), ignorenulls=True).over(_upto("song", "own"))
    gems = by_lane.withColumn("tom_end", end).where("lane IS NOT NULL")
    # late markers: each meets the last gem of both levels before it
    late = by_lane.where("tom IS NOT NULL").withColumn("level", F.explode(F.array(F.lit(2), F.lit(3))))
    near = late.select("song", "level", "at", "tick", "tom").unionByName(gems.where("level >= 2").select("song", "level", "at", "tick", F.lit(None).cast("int").alias("tom"), "lane"), allowMissingColumns=True)
    near = near.withColumn("gem", F.last(F.when(F.col("tom").isNull(), F.struct("at", "tick", "lane")), ignorenulls=True).over(_upto("song", "level")))
    near = near.where((F.col("gem.lane") == F.col("tom")) & (F.col("tick") - F.col("gem.tick") < SAME_CHORD)).select("song", F.col("gem.at").alias("at"), F.lit(True).alias("late")).distinct()
    cymbal = (F.col("lane") > 1) & F.coalesce(F.col("tom_end") <= F.col("tick"), F.lit(True)) & F.col("late").isNull()
    out = gems.join(near, ["song", "at"], "left").select("song", "level", "tick", "length", "lane", cymbal.alias("cymbal"))

    lanes = _holding(rows, key.isin(*ROLLS)).groupBy("song", "marker").agg(F.expr("bit_or(shiftleft(1, lane))").alias("lanes"))
    rolls = rows.where(key.isin(*ROLLS)).withColumn("marker", F.col("at")).join(lanes, ["song", "marker"], "left")
    marks = rolls.select("song", F.lit("roll").alias("kind"), "tick", (F.col("tick") + F.col("length")).alias("end"), F.coalesce("lanes", F.lit(0)).alias("lanes"))
    for more in (_spans(rows, key == OVERDRIVE, "overdrive"), _spans(rows, key == SOLO, "solo"), _spans(rows, key == FILL, "fill")):
        marks = marks.unionByName(more, allowMissingColumns=True)
    toms = by_lane.where("tom IS NOT NULL").select("song", F.col("tick").alias("start"), (F.col("tick") + F.col("length")).alias("end"), (F.col("tom") - 2).alias("tom"))
    flags = interval.active_flags(toms, SONG, "tom", len(TOMS)).select("song", "tick", (F.col("flags") * 4).alias("flags"))
    return out, marks, flags


#: markup: keys of chords, solo notes of two ranges, and solo notes that carry their place as velocity
CHORDS, SOLO_LOW, SOLO_HIGH, SOLO_AT = (36, 64), (0, 11), (12, 23), 127
OPEN_END = 2_147_483_647


def markup(items: DataFrame, measures: DataFrame) -> DataFrame:
    """(song, kind, tick, end, offset, pitches) from items (song, seq, tick, length, key, velocity, text): chords of the pitch
    classes that begin at one tick, each up to the next one; solo notes; and loops, texts [sololoop n], up to the n-th of ``measures``
    (song, i, tick). A loop past the last measure has no end; the last chord ends with the format's largest tick."""
    key = F.col("key")
    chords = items.where(key.between(*CHORDS)).groupBy("song", "tick").agg(F.array_sort(F.collect_set(F.pmod("key", F.lit(12)).cast("int"))).alias("pitches"))
    end = F.coalesce(F.lead("tick").over(Window.partitionBy("song").orderBy("tick")), F.lit(OPEN_END))
    out = chords.select("song", F.lit("chord").alias("kind"), "tick", end.alias("end"), F.lit(None).cast("int").alias("offset"), F.array_join(F.col("pitches").cast("array<string>"), " ").alias("pitches"))
    for kind, inside, offset in (("solo low", key.between(*SOLO_LOW), key - SOLO_LOW[0]), ("solo high", key.between(*SOLO_HIGH), key - SOLO_HIGH[0]), ("solo", key == SOLO_AT, F.col("velocity"))):
        out = out.unionByName(items.where(inside).select("song", F.lit(kind).alias("kind"), "tick", (F.col("tick") + F.col("length")).alias("end"), offset.cast("int").alias("offset")), allowMissingColumns=True)
    n = F.regexp_extract("text", r"\[sololoop ([0-9]+)\]", 1).try_cast("int")
    loops = items.withColumn("n", n).where("n IS NOT NULL").join(measures.select("song", (F.col("i") + 1).alias("n"), F.col("tick").alias("end")), ["song", "n"], "left")
    return out.unionByName(loops.select("song", F.lit("loop").alias("kind"), "tick", "end"), allowMissingColumns=True)
