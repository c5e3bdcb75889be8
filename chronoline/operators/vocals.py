"""Vocal charts: notes with their lyrics and phrases, for a lead and for harmonies that take over its phrases.

Items are rows (song, track, seq, tick, length, key, text): a note or marker has a key, a lyric a text. Tracks
are numbered; track 1 leads, and every later one takes the phrases of the one before, which are track 1's. All is
windows of a track in order of (tick, higher keys first, seq), texts before notes; harmony notes find their
phrase by one forward as-of against track 1's phrases.

Defined results: a track fails, with one row that names the reason instead of its notes, if a note comes before any
lyric, if it begins with the lyric "+", if a harmony note lies past the last phrase, or if it has no
notes. Texts that are empty or begin with "[" are no lyrics; null keys and texts are ignored; equal rows order by
seq. A mark that repeats the tick of the one before only adds its flag; in harmonies such marks change no phrase.
Lengths below zero wrap as unsigned numbers of 16 and, for phrases, 32 bits do.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoline.operators.asof import asof

#: keys of the format, fixed values
NOTES, PHRASE, ALT_PHRASE, PERCUSSION, AUTO_PERCUSSION = (36, 84), 105, 106, 96, 97
#: ticks before the first phrase mark at which the opening phrase ends; unsigned 32 bits; milliseconds of rests
LEAD_IN, WRAP = 640, 1 << 32
REST, LONG_REST, EDGE, LONG_EDGE = 600, 800, 50, 100

TRACK = ["song", "track"]


class Vocals(NamedTuple):
    notes: DataFrame
    phrases: DataFrame
    rests: DataFrame


def _marked(items: DataFrame) -> DataFrame:
    """Items in order, with the lyric so far and ``mark``, the number of phrases begun so far."""
    rank = F.when(F.col("key").isNull(), 0).otherwise(128 - F.col("key"))
    items = items.withColumn("rank", rank)
    order = Window.partitionBy(*TRACK).orderBy("tick", "rank", "seq")
    is_mark = F.coalesce(F.col("key").isin(PHRASE, ALT_PHRASE), F.lit(False))
    before = F.last(F.when(is_mark, F.col("tick")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    lyric = F.when(F.col("key").isNull() & (F.length("text") > 0) & ~F.col("text").startswith("["), F.trim("text"))
    items = items.withColumns({"is_mark": is_mark, "begins": is_mark & F.coalesce(before != F.col("tick"), F.lit(True)), "lyric": F.last(lyric, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return items.withColumn("mark", F.sum(F.col("begins").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def _spans(marked: DataFrame) -> DataFrame:
    """(song, track, phrase, start, length, flags) of phrases from marks: each begins where the one before it ends, the
    first ``LEAD_IN`` before its mark, and phrase 0 is what comes before."""
    flag = F.when(F.col("key") == PHRASE, 1).otherwise(2)
    marks = marked.where("is_mark").groupBy(*TRACK, F.col("mark").alias("phrase")).agg(F.min("tick").alias("at"), F.min_by("length", F.struct("rank", "seq")).alias("length"), F.sum(flag).alias("flags"))
    w = Window.partitionBy(*TRACK).orderBy("phrase")
    lead = lambda at: F.pmod(at - LEAD_IN, F.lit(WRAP))
    first, second = F.col("phrase") == 1, F.col("phrase") == 2
    opens_at_zero = F.lag("at").over(w) == LEAD_IN  # its length is set again by the mark that follows
    begin = F.when(first | second & opens_at_zero, lead(F.col("at"))).otherwise(F.lag(F.col("at") + F.col("length")).over(w))
    own = marks.withColumn("start", begin)
    end = F.when(first & (F.col("at") == LEAD_IN) & F.lead("start").over(w).isNotNull(), F.lead("start").over(w)).otherwise(F.col("at") + F.col("length"))
    own = own.select(*TRACK, "phrase", "start", F.pmod(end - F.col("start"), F.lit(WRAP)).alias("length"), "flags")
    opening = marked.groupBy(*TRACK).agg(F.min(F.when(F.col("is_mark"), F.col("tick"))).alias("at"))
    opening = opening.select(*TRACK, F.lit(0).alias("phrase"), F.lit(0).cast("bigint").alias("start"), F.coalesce(lead(F.col("at")), F.lit(0)).alias("length"), F.lit(0).cast("bigint").alias("flags"))
    return opening.unionByName(own)


def derive(items: DataFrame, ends: DataFrame) -> Vocals:
    """Notes, phrases and rests of every song. ``ends``: (song, end), where the last rest ends."""
    marked = _marked(items.select(*TRACK, "seq", "tick", "length", "key", "text"))
    spans = _spans(marked)
    lead = spans.where("track = 1").drop("track")
    upto = Window.partitionBy("song").orderBy("phrase")
    within = lead.select("song", F.col("phrase").alias("its"), (F.max(F.col("start") + F.col("length")).over(upto) - 1).alias("last"), F.col("flags").alias("its_flags"))
    notes = marked.where(F.col("key").between(*NOTES)).drop("text", "is_mark", "begins")
    own = notes.where("track = 1").join(lead.select("song", F.col("phrase").alias("mark"), F.col("flags").alias("its_flags")), ["song", "mark"], "left").withColumn("its", F.col("mark"))
    taken = asof(notes.where("track > 1"), within, ["song"], "tick", "last", "forward", tie="its", prefix="").drop("last")
    notes = own.unionByName(taken.select(own.columns))

    order = Window.partitionBy(*TRACK).orderBy("tick", "rank", "seq")
    plain = F.translate("lyric", "$#^", "")
    notes = notes.withColumns({"slide": F.coalesce(plain == "+", F.lit(False)), "prev_key": F.lag("key").over(order), "prev_end": F.lag(F.col("tick") + F.col("length")).over(order), "prev_its": F.lag("its").over(order), "prev_flags": F.lag("its_flags").over(order), "prev_lyric": F.lag("lyric").over(order)})
    fails = F.when(F.col("lyric").isNull(), "note without lyric").when(F.col("its").isNull(), "note without phrase").when(F.col("slide") & F.col("prev_key").isNull(), "starts with +")
    failed = notes.withColumn("error", fails).where("error IS NOT NULL").groupBy(*TRACK).agg(F.min_by("error", F.struct("tick", "rank", "seq")).alias("error"))
    tracks = items.select(*TRACK).distinct()
    silent = tracks.join(notes.select(*TRACK).distinct(), TRACK, "left_anti").withColumn("error", F.lit("no notes"))
    failed = failed.unionByName(silent)
    notes = notes.join(failed.select(*TRACK), TRACK, "left_anti")

    def note(part: int, **fields: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), *(v.alias(k) for k, v in fields.items()))

    marks_of = lambda c: {"unpitched": F.col(c).contains("#") | F.col(c).contains("^"), "generous": F.col(c).contains("^"), "divider": F.col(c).contains("%")}
    no = F.lit(False)
    main = note(1, tick=F.col("tick"), length=F.pmod("length", F.lit(1 << 16)), key=F.col("key"), key2=F.col("key"), lyric=F.when(F.col("slide"), "").otherwise(plain), phrase=F.col("its"), flags=F.col("its_flags"), portamento=F.col("slide"), shown=~F.col("lyric").contains("$"), **marks_of("lyric"))
    glide = note(0, tick=F.col("prev_end"), length=F.pmod(F.col("tick") - F.col("prev_end"), F.lit(1 << 16)), key=F.col("prev_key"), key2=F.col("key"), lyric=F.lit(""), phrase=F.col("prev_its"), flags=F.col("prev_flags"), portamento=F.lit(True), shown=~F.col("prev_lyric").contains("$"), unpitched=no, generous=no, divider=no)
    every = notes.select(*TRACK, F.struct("tick", "rank", "seq").alias("at"), F.explode(F.when(F.col("slide"), F.array(glide, main)).otherwise(F.array(main))).alias("x")).select(*TRACK, "at", "x.*")
    listed = Window.partitionBy(*TRACK).orderBy("at", "part")
    every = every.withColumn("note", (F.row_number().over(listed) - 1).cast("bigint"))
    last = (F.col("part") == 1) & F.coalesce(F.lead(F.struct("part", "phrase")).over(Window.partitionBy(*TRACK, "part").orderBy("at"))["phrase"] != F.col("phrase"), F.lit(True))
    every = every.withColumn("last_in_phrase", last)

    # phrases: what their notes and percussion say of them
    main_notes = every.where("part = 1")
    said = main_notes.groupBy(*TRACK, "phrase").agg(F.min("note").alias("first"), (F.max("note") + 1).alias("end_note"), F.max(~F.col("unpitched")).alias("pitched"), F.max("unpitched").alias("unpitched"))
    beats = marked.where(F.col("key").isin(PERCUSSION, AUTO_PERCUSSION)).select(*TRACK, F.struct("tick", "rank", "seq").alias("at"), F.when(F.col("track") == 1, F.col("mark")).alias("phrase"), F.lit(True).alias("beat"))
    both = beats.unionByName(main_notes.select(*TRACK, "at", "phrase", F.lit(False).alias("beat")))
    now = F.coalesce(F.when(F.col("track") == 1, F.col("phrase")), F.last(F.when(~F.col("beat"), F.col("phrase")), ignorenulls=True).over(Window.partitionBy(*TRACK).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    struck = both.withColumn("phrase", now).where("beat").select(*TRACK, "phrase").distinct().withColumn("percussion", F.lit(True))
    keys = main_notes.groupBy(*TRACK).agg(F.min("key").alias("low"), F.max("key").alias("high"), F.max(~F.col("unpitched")).alias("any_pitched"))
    so_far = Window.partitionBy("song").orderBy("track")
    keys = keys.select(*TRACK, *(F.when(F.col("any_pitched"), f(c).over(so_far)).alias(c) for f, c in ((F.min, "low"), (F.max, "high"))))
    base = tracks.join(failed.select(*TRACK), TRACK, "left_anti")
    copied = base.where("track > 1").join(lead, "song")
    whole = base.where("track = 1").join(lead, "song").unionByName(copied)
    opened = F.coalesce("first", F.lit(None).cast("bigint"))
    before = F.max("end_note").over(Window.partitionBy(*TRACK).orderBy("phrase").rowsBetween(Window.unboundedPreceding, -1))
    whole = whole.join(said, [*TRACK, "phrase"], "left").join(struck, [*TRACK, "phrase"], "left").join(keys, TRACK, "left")
    whole = whole.withColumn("before", F.coalesce(before, F.lit(0)))
    start_note = F.when(F.col("phrase") == 0, -1).when((F.col("track") > 1) & opened.isNull(), 0).otherwise(F.col("before"))
    end_note = F.coalesce("end_note", F.when(F.col("phrase") == 0, -1).when(F.col("track") > 1, 0).otherwise(F.col("before")))
    phrases = whole.select(*TRACK, "phrase", "start", "length", start_note.cast("bigint").alias("start_note"), end_note.cast("bigint").alias("end_note"), F.coalesce("pitched", F.lit(False)).alias("pitched"), F.coalesce("unpitched", F.lit(False)).alias("unpitched"), "low", "high", F.coalesce("percussion", F.lit(False)).alias("percussion"), "flags")

    end = F.col("tick") + F.col("length")
    rest = main_notes.select(*TRACK, "at", "tick", "portamento", end.alias("stop")).withColumn("since", F.coalesce(F.lag("stop").over(Window.partitionBy(*TRACK).orderBy("at")), F.lit(0)))
    gap = F.col("tick") - F.col("since")
    edge = F.when(gap > LONG_REST, LONG_EDGE).otherwise(EDGE)
    rests = rest.where(~F.col("portamento") & (gap > REST)).select(*TRACK, (F.col("since") + edge).alias("start"), (F.col("tick") - edge).alias("end"))
    closing = main_notes.groupBy(*TRACK).agg(F.max_by(end, "at").alias("stop")).join(ends, "song").select(*TRACK, (F.col("stop") + LONG_EDGE).alias("start"), F.col("end"))
    rests = rests.unionByName(closing)
    # the third takes the second's rests
    second = rests.where("track = 2").join(base.where("track = 3").select("song"), "song").withColumn("track", F.lit(3))
    rests = rests.where("track != 3").unionByName(second)
    columns = ["tick", "length", "key", "key2", "lyric", "phrase", "flags", "last_in_phrase", "portamento", "unpitched", "generous", "divider", "shown"]
    return Vocals(every.select(*TRACK, "note", *columns, F.lit(None).cast("string").alias("error")).unionByName(failed, allowMissingColumns=True), phrases, rests)
