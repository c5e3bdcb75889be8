"""Other sources and sinks: lyric lines, tempo caches, audio pages, file tables, string grids.

Texts and JSON use Spark's own readers; binary layouts are decoded per file from ``binaryFile``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lyrics(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, t, text) of time-stamped lines ``[mm:ss.xx]text``, by their place in the file;
    lines without a stamp or text are left out."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\n")).alias("line", "raw"))
    stamp = r"\[(\d+):(\d+\.\d+)\](.*)"
    rows = files.select("path", "line", *[F.regexp_extract("raw", stamp, k).alias(c) for k, c in ((1, "m"), (2, "s"), (3, "text"))])
    rows = rows.where("m <> ''").select("path", "line", (60 * F.col("m").cast("int") + F.col("s").cast("double")).alias("t"), F.trim(F.regexp_replace("text", "\r", "")).alias("text"))
    return rows.where("text <> ''")


def line_spans(lines: DataFrame, durations: DataFrame) -> DataFrame:
    """Lines with their end: the next line's time, for the last the recording's ``duration``."""
    w = Window.partitionBy("path").orderBy("t", "line")
    return lines.join(durations, "path", "left").withColumn("t_end", F.coalesce(F.lead("t").over(w), "duration")).drop("duration")


def read_tempo(spark: SparkSession, path: str) -> DataFrame:
    """(path, beat, t, bpm) from JSON caches of the parallel arrays beat_times and bpms."""
    j = spark.read.schema("beat_times array<double>, bpms array<double>").json(path, multiLine=True)
    return j.select(F.input_file_name().alias("path"), F.posexplode(F.arrays_zip("beat_times", "bpms")).alias("beat", "z")).select("path", "beat", F.col("z.beat_times").alias("t"), F.col("z.bpms").alias("bpm"))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(path, word_idx, word, t_start, t_end, score) from JSON caches of ``word_segments``, with the
    fallbacks start, time, 0 and end = start + 0.3 and score 1."""
    item = "array<struct<word:string,start:double,time:double,`end`:double,score:double>>"
    j = spark.read.schema(f"word_segments {item}").json(path, multiLine=True)
    w = j.select(F.input_file_name().alias("path"), F.posexplode("word_segments").alias("word_idx", "w"))
    start = F.coalesce("w.start", "w.time", F.lit(0.0))
    return w.select("path", "word_idx", "w.word", start.alias("t_start"), F.coalesce("w.end", start + 0.3).alias("t_end"), F.coalesce("w.score", F.lit(1.0)).alias("score"))


def read_synced(spark: SparkSession, path: str) -> DataFrame:
    """(path, idx, word, pitch, t_start, t_end) from JSON caches of synced words: an object with ``synced_lyrics`` or
    ``synced_words``, or a bare array. Words fall back to lyric, then "la"; pitches to 60; starts to time,
    then 0; ends to start + 0.3. A path that doesn't exist, or isn't JSON, gives no rows."""
    item = "array<struct<word:string,lyric:string,pitch:int,start:double,time:double,`end`:double>>"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where):
        return spark.createDataFrame([], "path string, idx int, word string, pitch int, t_start double, t_end double")
    j = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    named = F.from_json("value", f"synced_lyrics {item}, synced_words {item}")
    bare = F.when(F.ltrim("value").startswith("["), F.from_json("value", item))
    w = j.select("path", F.posexplode(F.coalesce(named["synced_lyrics"], named["synced_words"], bare)).alias("idx", "w"))
    start = F.coalesce("w.start", "w.time", F.lit(0.0))
    return w.select("path", "idx", F.coalesce("w.word", "w.lyric", F.lit("la")).alias("word"), F.coalesce("w.pitch", F.lit(60)).alias("pitch"), start.alias("t_start"), F.coalesce("w.end", start + 0.3).alias("t_end"))


def read_project(spark: SparkSession, path: str) -> DataFrame:
    """(path, targ_path, orig_path) of the ``file`` elements of project XML."""
    return spark.read.format("xml").option("rowTag", "file").schema("_targ_path string, _orig_path string").load(path).select(F.input_file_name().alias("path"), F.col("_targ_path").alias("targ_path"), F.col("_orig_path").alias("orig_path"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, offset, granule, size) of the pages of Ogg files, wherever a page mark stands."""

    def run(batches):
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                data, rows = bytes(content), []
                at = data.find(b"OggS")
                while at >= 0 and at + 27 <= len(data):
                    laces = data[at + 27 : at + 27 + data[at + 26]]
                    size = 27 + data[at + 26] + sum(laces)
                    rows.append((p, at, int.from_bytes(data[at + 6 : at + 14], "little", signed=True), size))
                    at = data.find(b"OggS", at + size)
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "offset", "granule", "size"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, offset bigint, granule bigint, size bigint")


def durations(pages: DataFrame, rate: int) -> DataFrame:
    """(path, ms): the last granule that isn't negative, in whole milliseconds."""
    last = pages.where("granule >= 0").groupBy("path").agg(F.max_by("granule", "offset").alias("g"))
    return last.select("path", F.expr(f"g * 1000 div {rate}").alias("ms"))


#: fixed values of packages: where a table may stand, in the order tried, and what its first entry names
TABLE_OFFSETS, FIRST_NAME = (0xC000, 0xA000, *range(0x8000, 0x20000, 0x1000)), "songs"


def probed_offset(content, first: str = FIRST_NAME, offsets=TABLE_OFFSETS):
    """The first of ``offsets`` whose entry of 64 bytes holds the name, or else the first offset; a column of bytes in, a column out."""
    out = None
    for k in offsets:
        holds = F.contains(F.substring(content, k + 1, 64), F.lit(first.encode()))
        out = (F if out is None else out).when(holds, k)
    return out.otherwise(offsets[0])


def read_file_table(spark: SparkSession, path: str, offset: int | None = 0xC000, entries: int = 64) -> DataFrame:
    """(path, idx, name, is_dir, blocks, start_block, parent, size) from packages whose table of
    64-byte entries stands at ``offset``, or, if that is None, where it is found; empty entries are left out."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    files = files.withColumn("offset", F.lit(offset) if offset is not None else probed_offset(F.col("content")))
    entry = F.substring(F.col("content"), F.col("idx") * 64 + F.col("offset") + 1, F.lit(64))
    b = files.select("path", "content", "offset", F.explode(F.sequence(F.lit(0), F.lit(entries - 1))).alias("idx"))
    b = b.select("path", "idx", entry.alias("e")).where(F.length("e") == 64)
    number = lambda start, n, little=False: F.conv(F.hex(F.reverse(F.substring("e", start, n)) if little else F.substring("e", start, n)), 16, 10).cast("long")
    flags = number(41, 1)
    rows = b.select("path", "idx", F.rtrim(F.translate(F.decode(F.substring("e", 1, 40), "ISO-8859-1"), "\x00", "")).alias("name"), flags.alias("f"), *[F.hex(F.substring("e", s, 1)).alias(f"x{s}") for s in (42, 43, 44, 48, 49, 50)], number(51, 2).alias("parent"), number(53, 4).alias("size"))
    three = lambda a, z: F.conv(F.concat(f"x{a + 2}", f"x{a + 1}", f"x{a}"), 16, 10).cast("long").alias(z)
    return rows.where("name <> ''").select("path", "idx", "name", (F.col("f").bitwiseAND(128) != 0).alias("is_dir"), three(42, "blocks"), three(48, "start_block"), "parent", "size")


def grid_text(rows: DataFrame, keys: list[str], order: str, cells: str) -> DataFrame:
    """(keys, text): rows of string arrays as lines of comma-joined cells, unquoted; empty rows are left out."""
    g = rows.where(F.size(cells) > 0).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, F.array_join(cells, ",").alias("l")))).alias("r"))
    return g.select(*keys, F.array_join(F.transform("r", lambda x: x["l"]), "\n").alias("text"))


def mesh_text(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """(mesh, section, idx, line) of OBJ lines: vertices, texture coordinates with 1 - v, faces counted from 1."""
    v = vertices.select("mesh", F.lit(0).alias("section"), "idx", F.format_string("v %s %s %s", "x", "y", "z").alias("line"))
    t = vertices.select("mesh", F.lit(1).alias("section"), "idx", F.format_string("vt %s %s", F.col("u"), 1 - F.col("v")).alias("line"))
    f = triangles.select("mesh", F.lit(2).alias("section"), "idx", F.format_string("f %d/%d %d/%d %d/%d", *[F.col(c) + 1 for c in "aabbcc"]).alias("line"))
    return v.unionByName(t).unionByName(f)
