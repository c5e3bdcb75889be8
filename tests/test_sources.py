"""Files as rows and back; streams against batches."""

import json
import time

from pyspark.sql import functions as F

from chronoline.sources import files, midi
from chronoline.streaming import timeline


def test_midi_round_trip(spark, tmp_path):
    data = [
        ("a.mid", 0, "tempo", 0, 0, "tempo", None, 500000, None, None),
        ("a.mid", 1, "PART DRUMS", 0, 0, "on", 9, 36, 100, None),
        ("a.mid", 1, "PART DRUMS", 1, 300, "off", 9, 36, 0, None),
        ("a.mid", 1, "PART DRUMS", 2, 20000, "on", 9, 38, 90, None),
        ("a.mid", 1, "PART DRUMS", 3, 20100, "text", None, 5, None, "la"),
    ]
    rows = spark.createDataFrame(data, "path string, track int, name string, seq int, tick long, kind string, channel int, key int, velocity int, text string")
    (tmp_path / "m").mkdir()
    for r in midi.write_files(rows).collect():
        (tmp_path / "m" / r["path"]).write_bytes(bytes(r["content"]))
    (tmp_path / "m" / "junk.mid").write_bytes(b"nothing")
    (tmp_path / "m" / "cut.mid").write_bytes((tmp_path / "m" / "a.mid").read_bytes()[:-30])
    got = midi.read_events(spark, str(tmp_path / "m"))
    own = got.where(F.col("path").endswith("/a.mid"))
    back = sorted((r["track"], r["tick"], r["kind"], r["key"], r["velocity"], r["text"]) for r in own.where("kind <> 'name'").collect())
    assert [b[:4] for b in back] == [(0, 0, "tempo", 500000), (1, 0, "on", 36), (1, 300, "off", 36), (1, 20000, "on", 38), (1, 20100, "text", 5)]
    assert [(r["name"], r["notes"]) for r in midi.note_counts(own).orderBy("name").collect()] == [("PART DRUMS", 2), ("tempo", 0)]
    assert got.where(F.col("path").endswith("/junk.mid")).count() == 0
    assert midi.encode_number(0x0FFFFFFF) == b"\xff\xff\xff\x7f" and midi.encode_number(-3) == b"\x00"


def test_lyrics_and_caches(spark, tmp_path):
    (tmp_path / "l.txt").write_text("[ar:someone]\n[00:01.50]one\n[01:00.25]two three\n[00:03]no point\n[00:09.00]\n")
    lines = files.read_lyrics(spark, str(tmp_path / "l.txt"))
    assert [(r["t"], r["text"]) for r in lines.orderBy("line").collect()] == [(1.5, "one"), (60.25, "two three")]
    ends = files.line_spans(lines, lines.select("path", F.lit(90.0).alias("duration")).distinct())
    assert [r["t_end"] for r in ends.orderBy("t").collect()] == [60.25, 90.0]
    (tmp_path / "t.json").write_text(json.dumps({"beat_times": [0.5, 1.0], "bpms": [120.0, 118.0]}))
    assert [(r["beat"], r["t"], r["bpm"]) for r in files.read_tempo(spark, str(tmp_path / "t.json")).collect()] == [(0, 0.5, 120.0), (1, 1.0, 118.0)]
    (tmp_path / "w.json").write_text(json.dumps({"word_segments": [{"word": "a", "start": 1.0, "end": 1.5, "score": 0.5}, {"word": "b", "time": 2.0}]}))
    for name, value in (("s1", {"synced_lyrics": [{"word": "a", "time": 1.0, "pitch": 64}, {"lyric": "b"}]}), ("s2", {"synced_words": [{"word": "a", "start": 1.0, "pitch": 64}, {"lyric": "b"}]}), ("s3", [{"word": "a", "start": 1.0, "end": 1.3, "pitch": 64}, {"start": 0.0, "lyric": "b"}])):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
        assert [tuple(r)[1:] for r in files.read_synced(spark, str(tmp_path / f"{name}.json")).orderBy("idx").collect()] == [(0, "a", 64, 1.0, 1.3), (1, "b", 60, 0.0, 0.3)]
    assert files.read_synced(spark, str(tmp_path / "missing.json")).count() == 0
    (tmp_path / "bad.json").write_text("{")
    assert files.read_synced(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "p.xml").write_text('<psproject><files><file targ_path="a/b.bin" orig_path="x\\b.bin"/><file targ_path="c"/></files></psproject>')
    assert [(r["targ_path"], r["orig_path"]) for r in files.read_project(spark, str(tmp_path / "p.xml")).orderBy("targ_path").collect()] == [("a/b.bin", "x\\b.bin"), ("c", None)]
    assert [(r["t_start"], r["t_end"], r["score"]) for r in files.read_words(spark, str(tmp_path / "w.json")).orderBy("word_idx").collect()] == [(1.0, 1.5, 0.5), (2.0, 2.3, 1.0)]


def test_pages_and_durations(spark, tmp_path):
    page = lambda granule, n: b"OggS\x00\x00" + granule.to_bytes(8, "little", signed=True) + b"\0" * 12 + b"\x01" + bytes([n]) + b"x" * n
    (tmp_path / "s.ogg").write_bytes(b"head" + page(0, 10) + page(44100, 20) + b"??" + page(-1, 5))
    p = files.read_pages(spark, str(tmp_path / "s.ogg"))
    assert [(r["offset"], r["granule"]) for r in p.orderBy("offset").collect()] == [(4, 0), (42, 44100), (92, -1)]
    assert files.durations(p, 44100).first()["ms"] == 1000


def test_file_table(spark, tmp_path):
    entry = lambda name, flags, blocks, start, parent, size: (name.encode().ljust(40, b"\0") + bytes([flags]) + blocks.to_bytes(3, "little") * 2 + start.to_bytes(3, "little") + parent.to_bytes(2, "big") + size.to_bytes(4, "big")).ljust(64, b"\0")
    body = b"\0" * 0xC000 + entry("songs", 128, 0, 0, 65535, 0) + b"\0" * 64 + entry("a.mid", 64, 2, 7, 0, 5000)
    (tmp_path / "p.con").write_bytes(body)
    got = [tuple(r)[1:] for r in files.read_file_table(spark, str(tmp_path / "p.con")).orderBy("idx").collect()]
    assert got == [(0, "songs", True, 0, 0, 65535, 0), (2, "a.mid", False, 2, 7, 0, 5000)]


def test_file_tables_are_found(spark, tmp_path):
    (tmp_path / "p").mkdir()
    entry = lambda name: name.encode().ljust(40, b"\0") + bytes([0x80 | len(name)]) + bytes(23)
    for at, name in ((0xC000, "c"), (0xA000, "a"), (0x9000, "n"), (0x1F000, "f")):
        (tmp_path / "p" / f"{name}.con").write_bytes(bytes(at) + entry("songs") + entry(name) + bytes(100))
    (tmp_path / "p" / "none.con").write_bytes(bytes(0xC000) + entry("other") + bytes(64))
    (tmp_path / "p" / "short.con").write_bytes(b"CON ")
    (tmp_path / "p" / "both.con").write_bytes(bytes(0xA000) + entry("songs") + entry("second") + bytes(0x2000 - 128) + entry("songs") + entry("first"))
    got = {(r["path"].rpartition("/")[2], r["name"]) for r in files.read_file_table(spark, str(tmp_path / "p"), offset=None).collect()}
    assert got == {(f"{x}.con", y) for x in "canf" for y in ("songs", x)} | {("none.con", "other"), ("both.con", "songs"), ("both.con", "first")}


def test_streams_equal_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.sql("SELECT id % 3 AS k, timestamp_seconds(1700000000 + id * 7) AS at, id div 3 % 2 AS on FROM range(200)")
    df.repartition(3).write.parquet(src)
    time.sleep(1.1)  # the source takes files by their time; the last event moves the watermark past all others
    spark.sql("SELECT 9L AS k, timestamp_seconds(1800000000) AS at, 1L AS on").write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)

    def all_of(out, name):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()  # a file a trigger, so events come out of order
        q.awaitTermination(120)
        return spark.table(name)

    got = all_of(timeline.throttled(stream, "k", "at", 60_000_000, "1 hour"), "throttled")
    want = []
    for k in range(3):
        last = None
        for t in sorted(1700000000 + i * 7 for i in range(200) if i % 3 == k):
            if last is None or t - last >= 60:
                last = t
                want.append((k, t * 1_000_000))
    assert sorted((r["key"], r["at_us"]) for r in got.collect()) == want
    pairs = all_of(timeline.paired_notes(stream, "k", "at", "on", "1 hour"), "pairs")
    assert sorted((r["key"], r["start_us"], r["end_us"]) for r in pairs.collect()) == sorted((k, (1700000000 + i * 7) * 1_000_000, (1700000000 + (i + 3) * 7) * 1_000_000) for k in range(3) for i in range(200) if i % 3 == k and i // 3 % 2 and i + 3 < 200)
    n = all_of(timeline.phrase_windows(stream, ["k"], "at", "60 seconds", "0 seconds"), "phrases").agg(F.sum("n")).first()[0]
    assert n is None or n <= 201  # windows still open at the end are not given yet


def test_bent_notes_round_trip(spark, tmp_path):
    notes = [("a", 0, 0.0, 1.0, 60, 0.5, [0, 3, -9]), ("a", 1, 0.5, 2.0, 64, 1.0, None), ("a", 2, 1.0, 1.5, 62, None, [1]), ("a", 3, 0.5, 0.6, 65, 2.0, []), ("b", 0, 0.0, 0.25, 30, 0.1, [6, None]), ("a", 4, None, 1.0, 60, 0.5, [1])]
    df = spark.createDataFrame(notes, "clip string, note int, start double, end double, pitch int, amplitude double, bends array<int>")
    rows = midi.note_rows(df, "clip")
    (tmp_path / "m").mkdir()
    for r in midi.write_files(rows, division=220).collect():
        (tmp_path / "m" / f"{r['path']}.mid").write_bytes(bytes(r["content"]))
    back = [r for r in midi.read_events(spark, str(tmp_path / "m")).where("kind <> 'name'").collect() if r["path"].endswith("a.mid")]
    of = lambda k: [(r["tick"], r["kind"], r["key"] + (r["velocity"] << 7) - 8192 if r["kind"] == "bend" else r["key"], r["velocity"] if r["kind"] == "on" else None) for r in sorted(back, key=lambda r: (r["track"], r["seq"])) if r["track"] == k]
    # the third note takes the first's track when that ends; bends stand at start, middle and end
    assert of(0) == [(0, "bend", 0, None), (0, "on", 60, 64), (220, "bend", 4096, None), (440, "off", 60, None), (440, "bend", -8192, None), (440, "bend", 1365, None), (440, "off", 62, None), (660, "off", 62, None)]
    assert of(1) == [(220, "on", 65, 127), (264, "off", 65, None)] and of(2) == [(220, "on", 64, 127), (880, "off", 64, None)]
