"""Standard MIDI files as rows, and rows as files.

``read_events`` decodes files of any number in parallel, one row per event, from Spark's own
``binaryFile`` source; ``track_bytes`` assembles a track per group. Both stream file by file.

Defined results: a file without a header gives no rows; a chunk that isn't a track ends its
file; a truncated track gives the events that are whole.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoline.operators.fold import fold_rows

EVENTS = "path string, division int, track int, seq int, tick bigint, kind string, channel int, key int, velocity int, text string"
SIZES = {0x8: 2, 0x9: 2, 0xA: 2, 0xB: 2, 0xC: 1, 0xD: 1, 0xE: 2}
NAMES = {0x8: "off", 0x9: "on", 0xA: "pressure", 0xB: "control", 0xC: "program", 0xD: "aftertouch", 0xE: "bend"}


def _number(data: bytes, at: int) -> tuple[int, int]:
    """A variable-length number and where it ends; IndexError where the bytes run out."""
    value = 0
    while True:
        byte = data[at]
        at += 1
        value = value << 7 | byte & 0x7F
        if byte < 0x80:
            return value, at


def decode_track(data: bytes):
    """Events (tick, kind, channel, key, velocity, text) of one track's bytes."""
    at, tick, status = 0, 0, 0
    try:
        while at < len(data):
            delta, at = _number(data, at)
            tick += delta
            if data[at] >= 0x80:
                status, at = data[at], at + 1
            if status in (0xF0, 0xF7):
                size, at = _number(data, at)
                at += size
            elif status == 0xFF:
                meta = data[at]
                size, at = _number(data, at + 1)
                body, at = data[at : at + size], at + size
                if meta == 0x51 and size == 3:
                    yield tick, "tempo", None, int.from_bytes(body, "big"), None, None
                elif 1 <= meta <= 7:
                    yield tick, "name" if meta == 3 else "text", None, meta, None, body.decode("latin-1")
                elif meta == 0x2F:
                    return
            else:
                kind, n = status >> 4, SIZES.get(status >> 4, 0)
                if kind < 8:
                    return
                key, velocity = data[at], data[at + 1] if n == 2 else None
                at += n
                name = "off" if kind == 9 and velocity == 0 else NAMES[kind]
                yield tick, name, status & 15, key, velocity, None
    except IndexError:
        return


def decode_file(path: str, data: bytes):
    if data[:4] != b"MThd" or len(data) < 14:
        return
    size, _, _, division = struct.unpack(">IHHH", data[4:14])
    at, track = 8 + size, 0
    while data[at : at + 4] == b"MTrk" and at + 8 <= len(data):
        n = int.from_bytes(data[at + 4 : at + 8], "big")
        for seq, event in enumerate(decode_track(data[at + 8 : at + 8 + n])):
            yield (path, division, track, seq, *event)
        at, track = at + 8 + n, track + 1


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of all files under ``path``."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = [f.split()[0] for f in EVENTS.split(", ")]

    def run(batches):
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = list(decode_file(p, bytes(content)))
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in ("channel", "key", "velocity")})

    return files.mapInPandas(run, EVENTS)


def note_counts(events: DataFrame) -> DataFrame:
    """(path, name, notes): note-ons of each track name; tracks of one name count together."""
    names = events.where("kind = 'name'").groupBy("path", "track").agg(F.min_by("text", "seq").alias("name"))
    ons = events.where("kind = 'on'").groupBy("path", "track").agg(F.count("*").alias("n"))
    return names.join(ons, ["path", "track"], "left").groupBy("path", "name").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("notes"))


def encode_number(value: int) -> bytes:
    """Variable-length bytes; negative numbers count as 0."""
    value = max(0, int(value))
    out = bytes([value & 0x7F])
    while value := value >> 7:
        out = bytes([value & 0x7F | 0x80]) + out
    return out


#: fixed values: half the range of a bend, and its units a semitone
BEND, PER_SEMITONE = 8192, 4096


def voices(notes: DataFrame, clip: str) -> DataFrame:
    """``notes`` (clip, note, start, end) with ``voice``: notes that overlap have different voices, and each takes the lowest that is free
    where it begins, so a clip has as many as notes sound at once. A fold with one end a voice as its state."""

    def step(ends, start, end):
        ends = ends or []
        at = next((k for k, e in enumerate(ends) if e <= start), len(ends))
        return at, [*ends[:at], max(start, end), *ends[at + 1 :]]

    return fold_rows(notes, [clip], ["start", "end", "note"], ["start", "end"], step, "voice", "int")


def note_rows(notes: DataFrame, clip: str, per_semitone: int = 3, bpm: float = 120.0, division: int = 220) -> DataFrame:
    """Events (path, track, name, seq, tick, kind, channel, key, velocity, text) for ``write_files`` from notes (clip, note, start,
    end, pitch, amplitude, bends), times in seconds. Each voice is a track. A note's bends stand evenly from its start to its end, in
    steps of 1 / ``per_semitone`` semitone, and are cut to two semitones. At one tick offs come before bends, and bends before ons.

    Null times, pitches or bends make no events. A null amplitude is 0, and an on of velocity 0 reads back as an off, as the format has it."""
    n = voices(notes.where(F.col("start").isNotNull() & F.col("end").isNotNull() & F.col("pitch").isNotNull()), clip)
    tick = lambda t: F.bround(t * (bpm * division / 60)).cast("bigint")
    velocity = F.least(F.lit(127), F.greatest(F.lit(0), F.bround(127 * F.coalesce("amplitude", F.lit(0.0))).cast("int")))
    event = lambda t, rank, kind, key, v: F.struct(tick(t).alias("tick"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), key.cast("int").alias("key"), v.cast("int").alias("velocity"))
    none = F.lit(None)
    size = F.size("bends")
    at = lambda i: F.col("start") + F.when(size > 1, (F.col("end") - F.col("start")) * i / (size - 1)).otherwise(F.lit(0.0))
    value = lambda b: F.greatest(F.lit(-BEND), F.least(F.lit(BEND - 1), F.bround(b * PER_SEMITONE / F.lit(float(per_semitone))).cast("int")))
    bends = F.filter(F.transform("bends", lambda b, i: F.when(b.isNotNull(), event(at(i), 1, "bend", value(b), none))), lambda x: x.isNotNull())
    both = F.array(event(F.col("start"), 2, "on", F.col("pitch"), velocity), event(F.col("end"), 0, "off", F.col("pitch"), F.lit(0)))
    kind = "array<struct<tick:bigint,rank:int,kind:string,key:int,velocity:int>>"
    rows = n.select(F.col(clip).alias("path"), F.col("voice").alias("track"), "note", F.explode(F.concat(both.cast(kind), F.coalesce(bends.cast(kind), F.array().cast(kind)))).alias("x")).select("path", "track", "note", "x.*")
    seq = F.row_number().over(Window.partitionBy("path", "track").orderBy("tick", "rank", "note", "key")) - 1
    return rows.select(F.col("path").cast("string").alias("path"), "track", F.concat(F.lit("voice "), F.col("track").cast("string")).alias("name"), seq.alias("seq"), "tick", "kind", F.lit(0).alias("channel"), "key", "velocity", none.cast("string").alias("text"))


def _track(name: str, rows) -> bytes:
    body = b"\x00\xff\x03" + encode_number(len(name.encode("latin-1", "replace"))) + name.encode("latin-1", "replace")
    before = 0
    for tick, kind, channel, key, velocity, text in rows:
        body += encode_number(tick - before)
        before = max(before, tick)
        if kind == "tempo":
            body += b"\xff\x51\x03" + int(key).to_bytes(3, "big")
        elif kind == "text":
            raw = str(text).encode("latin-1", "replace")
            body += b"\xff" + bytes([int(key) or 1]) + encode_number(len(raw)) + raw
        elif kind == "bend":
            value = max(-BEND, min(BEND - 1, int(key))) + BEND
            body += bytes([0xE0 | int(channel or 0), value & 127, value >> 7])
        else:
            body += bytes([(0x90 if kind == "on" else 0x80) | int(channel or 0), int(key), int(velocity or 0)])
    return b"MTrk" + (len(body) + 4).to_bytes(4, "big") + body + b"\x00\xff\x2f\x00"


def write_files(events: DataFrame, division: int = 480) -> DataFrame:
    """(path, content) from events (path, track, name, seq, tick, kind, channel, key, velocity, text):
    every file is assembled from its rows in one task, files in parallel."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tracks = []
        for (_, name), rows in pdf.sort_values(["track", "tick", "seq"]).groupby(["track", "name"], sort=True):
            tracks.append(_track(name, rows[["tick", "kind", "channel", "key", "velocity", "text"]].itertuples(index=False, name=None)))
        head = b"MThd" + struct.pack(">IHHH", 6, 1, len(tracks), division)
        return pd.DataFrame({"path": [pdf["path"].iloc[0]], "content": [head + b"".join(tracks)]})

    return events.groupBy("path").applyInPandas(build, "path string, content binary")
