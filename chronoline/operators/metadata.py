"""A song's record from the entries of its metadata tree.

Entries are (key, i, value): the i-th value, from 1, under a key; keys of inner nodes are joined by a dot. Where a song's tree is in
one row, as an array of its entries, its record comes of that row alone (``records``); entries that lie apart, a row each with their song, are
first dealt by song and then aggregated, a part of the songs at a time (``record``).

Defined results: of repeated entries the smallest value counts; numbers that can't be read are null; a field that must be there
and isn't is null and named in ``missing``; without entries there is no song.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: field -> (key, place, kind, default); no default: the field must be there.
FIELDS = {
    "album_name": ("album_name", 1, "string", ""),
    "album_track_number": ("album_track_number", 1, "smallint", 0),
    "album_year": ("year_released", 1, "int", 0),
    "artist": ("artist", 1, "string", None),
    "band_rank": ("rank.band", 1, "int", None),
    "bass_rank": ("rank.bass", 1, "int", None),
    "drum_rank": ("rank.drum", 1, "int", None),
    "guitar_rank": ("rank.guitar", 1, "int", None),
    "keys_rank": ("rank.keys", 1, "int", None),
    "real_keys_rank": ("rank.real_keys", 1, "int", None),
    "vocals_rank": ("rank.vocals", 1, "int", None),
    "game_origin": ("game_origin", 1, "string", "ugc_plus"),
    "genre": ("genre", 1, "string", None),
    "name": ("name", 1, "string", None),
    "original_year": ("year_released", 1, "int", None),
    "vocal_parts": ("song.vocal_parts", 1, "int", 1),
    "song_length": ("song_length", 1, "int", None),
    "preview_start": ("preview", 1, "int", None),
    "preview_end": ("preview", 2, "int", None),
}
CONSTANTS = {"cover": False, "fake": False, "flags": 0, "medium": "", "tutorial": False, "type": 11, "version": -1}
TRUE, MALE, PREFIX, FIRST_ID, ID_BITS = ("1", "TRUE"), "male", "CU_", 90_000_000, 24


WANTED = {(key, i) for key, i, _, _ in FIELDS.values()} | {("album_art", 1), ("song.name", 1), ("freestyle_vocals", 1), ("vocal_gender", 1)}
COLUMNS = {w: f"_{n}" for n, w in enumerate(sorted(WANTED))}


def record(entries: DataFrame) -> DataFrame:
    """(song, the fields, missing) from rows (song, key, i, value)."""
    dealt = entries.repartition("song")  # sorted a part at a time, not a whole input split of entries
    return _fields(dealt.groupBy("song").agg(*(F.min(F.when((F.col("key") == key) & (F.col("i") == i), F.col("value"))).alias(c) for (key, i), c in COLUMNS.items())))


def records(trees: DataFrame) -> DataFrame:
    """(song, the fields, missing) from rows (song, entries), a song each: ``entries`` is an array of (key, i, value)."""
    at = lambda key, i: F.array_min(F.transform(F.filter("entries", lambda e: (e["key"] == key) & (e["i"] == i)), lambda e: e["value"]))
    return _fields(trees.select("song", *(at(*w).alias(c) for w, c in COLUMNS.items())))


def _fields(g: DataFrame) -> DataFrame:
    of = COLUMNS

    def field(key: str, i: int, kind: str, default) -> Column:
        c = F.col(of[key, i])
        c = c if kind == "string" else c.try_cast(kind)
        return c if default is None else F.coalesce(c, F.lit(default).cast(kind))

    short = F.concat(F.lit(PREFIX), F.substring_index(of["song.name", 1], "/", -1))
    digest = F.conv(F.substring(F.md5(short.cast("binary")), 1, ID_BITS // 4), 16, 10).cast("bigint")
    gender = F.coalesce(F.col(of["vocal_gender", 1]), F.lit(MALE)) == MALE
    out = {name: field(*spec) for name, spec in FIELDS.items()}
    out |= {
        "album_art": F.coalesce(F.col(of["album_art", 1]).isin(*TRUE), F.lit(False)),
        "has_freestyle_vocals": F.coalesce(F.col(of["freestyle_vocals", 1]).try_cast("int") == 1, F.lit(False)),
        "vocal_gender": F.when(gender, 1).otherwise(2),
        "short_name": F.lower(short),
        "song_id": digest + FIRST_ID,
    } | {k: F.lit(v) for k, v in CONSTANTS.items()}
    must = [*(name for name, spec in FIELDS.items() if spec[3] is None), "short_name"]
    rows = g.select("song", *(c.alias(k) for k, c in out.items()))
    return rows.withColumn("missing", F.array_join(F.array_compact(F.array(*(F.when(F.col(k).isNull(), k) for k in must))), ","))
