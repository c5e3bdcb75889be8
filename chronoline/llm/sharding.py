"""Shards of near-equal bytes by sampled splitters, in DataFrame operations only.

Records are ordered by (digest of the text, doc_id), so that equal texts lie side by side, and the
order is cut into ranges: keys are sampled with odds in proportion to their record's size, quantiles of
the sample are the splitters, and every splitter has a range of its own, so that no key can fill
a range between two. A shard ends where its share of the bytes is met. Ranges in which a shard ends,
and ranges of more than ``most`` rows, are overfull: they are sampled and split again, until a
range that holds an end has few rows, which are put in order; so the sample only finds the place and
the result doesn't depend on it.

* Equal texts stay in one shard as a whole, unless they weigh more than a hundredth of a shard or are more
  than a hundredth of its rows: such groups are cut between documents.
* A document of more than a hundredth of a shard could upset the balance alone. There are fewer than 100
  of them for each shard; they are dealt first, the largest to the emptiest shard, and the ranges fill up the rest.
* So shards differ by about a hundredth, unless a single document is larger than a shard.

Slots count a shard's documents from 0: the large ones first, then the others, in the order of keys.

Defined results: size is the text's UTF-8 bytes plus 1; a null text has none, and is in the group
of the empty text; null doc_ids come before others; rows equal in text and doc_id are interchangeable,
but each has a slot; texts of any length are read whole; an empty table gives an empty result; columns other
than the named ones are ignored unless they are kept.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoline.llm.common import CRC_TABLE, columns, crc_sql, cut, sized, table

#: splitters of a range, and sampled keys for each of them
SPLITTERS, OVERSAMPLE = 63, 16
#: documents and groups of over 1/SHARE of a shard's bytes, or groups of that part of its rows, are handled apart
SHARE = 100
#: a table of ranges is broadcast up to so many rows, with splitters of 4 kB each
MOST_SENT = 2000


def records(docs: DataFrame, doc: str = "doc_id", text: str = "text", keep: Column | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, h, m): h groups equal texts, m tells equal rows apart."""
    rows = columns(docs, doc_id=(doc, dict(docs.dtypes)[doc]), text=(text, "string")) if keep is None else docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"), keep.alias("kept"))
    b = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = rows.select("doc_id", (F.length(b) + 1).cast("bigint").alias("size"), F.crc32(b).alias("text_crc32"), F.md5(b).alias("h"), *(["kept"] if keep is not None else []))
    return cut(rows.withColumn("m", F.monotonically_increasing_id()))


def deal(large: DataFrame, shards: int) -> DataFrame:
    """(m, shard) of fewer than ``shards * SHARE`` rows: by falling size, each to the emptiest shard."""
    every = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("less"), "h", "doc_id", "m")))
    start = F.struct(F.array_repeat(F.lit(0).cast("bigint"), F.lit(shards)).alias("loads"), F.array().cast("array<struct<m:bigint,shard:int>>").alias("dealt"))

    def step(acc, x):
        at = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        loads = F.transform(acc["loads"], lambda v, i: F.when(i == at, v - x["less"]).otherwise(v))
        return F.struct(loads.alias("loads"), F.concat(acc["dealt"], F.array(F.struct(x["m"].alias("m"), at.alias("shard")))).alias("dealt"))

    return large.agg(every.alias("every")).select(F.explode(F.aggregate("every", start, step)["dealt"]).alias("x")).select("x.*")


def ends(loads: list[int], total: int) -> list[int]:
    """Where in the running bytes of the other documents each shard but the last ends: shards fill up to
    one level above what is dealt to them."""
    order = sorted(loads)
    level = next(v for k in range(1, len(order) + 1) if (v := (total + sum(order[:k])) // k) <= [*order, v][k])
    return list(accumulate(max(0, level - load) for load in loads[:-1]))


def _among(cuts: list[int], at: Column) -> Column:
    """How many cuts lie at or before a place in the running bytes."""
    return F.size(F.filter(F.array(*(F.lit(c).cast("double") for c in cuts)), lambda c: c <= at.cast("double"))) if cuts else F.lit(0)


def _small(df: DataFrame, n: int) -> DataFrame:
    """A table of a row a range, to be broadcast if it has at most ``MOST_SENT`` rows."""
    return F.broadcast(df) if n <= MOST_SENT else df


def ranges(rows: DataFrame, cuts: list[int], most: int, few: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` (unit, key, size) with the ``path`` of their range, and where each range begins: (path, base,
    first_row). Paths sort as keys do."""
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("path", F.lit(""))
    while True:
        by = rows.groupBy("path").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("unit").alias("low"), F.max("unit").alias("high"))
        by = by.withColumn("base", F.coalesce(F.sum("bytes").over(before), F.lit(0))).withColumn("first_row", F.coalesce(F.sum("n").over(before), F.lit(0)))
        ends_here = (_among(cuts, F.col("base")) < _among(cuts, F.col("base") + F.col("bytes"))) & (F.col("low") < F.col("high"))
        by, seen = sized(by.withColumn("open", (F.col("n") > most) | ends_here & (F.col("n") > few)), open=F.count_if("open"))
        if not seen["open"]:
            return rows, _small(by.select("path", "base", "first_row"), seen["n"])
        # a key's odds are its size's share of its range, times the size of the sample
        odds = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)
        tagged = rows.join(_small(by.where("open").select("path", "bytes"), seen["open"]), "path")
        splits = tagged.where(odds * F.col("bytes") < F.col("size") * float(SPLITTERS * OVERSAMPLE)).groupBy("path").agg(F.array_sort(F.collect_set("key")).alias("drawn"))
        pick = F.transform(F.sequence(F.lit(1), F.lit(SPLITTERS)), lambda i: F.element_at("drawn", F.ceil(i * F.size("drawn") / (SPLITTERS + 1)).cast("int")))
        splits = cut(splits.select("path", F.array_distinct(pick).alias("splitters")))
        rows = rows.join(_small(splits, seen["open"]), "path", "left").withColumn("less", F.size(F.filter("splitters", lambda s: s < F.col("key"))))
        at = 2 * F.col("less") + F.when(F.get("splitters", "less") == F.col("key"), 1).otherwise(0)
        rows = cut(rows.withColumn("path", F.when(F.col("splitters").isNull(), F.col("path")).otherwise(F.concat("path", F.lpad(at.cast("string"), 3, "0")))).drop("splitters", "less"))


def assign(docs: DataFrame, shards: int = 8, most: int = 1_000_000, few: int = 10_000, doc: str = "doc_id", text: str = "text", keep: Column | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every document, and ``kept`` if a column to keep is given."""
    rows = records(docs, doc, text, keep)
    extra = ["kept"] if keep is not None else []
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    parts = shards * SHARE
    # fewer than ``parts`` groups weigh over total / parts, and as many have over n / parts rows
    hot = rows.groupBy("h").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).where((F.col("bytes") * parts > total) | (F.col("n") > few) & (F.col("n") * parts > n)).select("h", F.lit(True).alias("hot"))
    large = rows.where(F.col("size") * parts > total)
    large = cut(large.join(F.broadcast(deal(large, shards)), "m").withColumn("slot", F.row_number().over(Window.partitionBy("shard").orderBy("h", "doc_id", "m")) - 1))
    dealt = {s: (b, k) for s, b, k in large.groupBy("shard").agg(F.sum("size"), F.count(F.lit(1))).collect()}
    loads = [dealt.get(s, (0, 0))[0] for s in range(shards)]
    cuts = ends(loads, total - sum(loads))

    unit = F.struct("h", F.when(F.col("hot"), F.col("doc_id")).alias("doc_id"), F.when(F.col("hot"), F.col("m")).alias("m"))
    others = rows.where(F.col("size") * parts <= total).join(F.broadcast(hot), "h", "left")
    others, begins = ranges(others.select(unit.alias("unit"), F.struct("h", "doc_id", "m").alias("key"), "size", "text_crc32", *extra), cuts, most, few)
    each = Window.partitionBy("path")
    upto = F.sum("size").over(each.orderBy("unit"))  # rows of a unit are peers: up to the unit's end
    others = others.join(begins, "path").withColumn("middle", F.col("base") + upto - F.sum("size").over(Window.partitionBy("path", "unit")) / 2)
    others = others.withColumn("shard", _among(cuts, F.col("middle"))).withColumn("row", F.col("first_row") + F.row_number().over(each.orderBy("key")) - 1)
    others = cut(others.select(F.col("key.doc_id").alias("doc_id"), "size", "text_crc32", "shard", "row", *extra))
    first = dict(others.groupBy("shard").agg(F.min("row")).collect())
    shift = F.array(*(F.lit(dealt.get(s, (0, 0))[1] - first.get(s, 0)).cast("bigint") for s in range(shards)))
    columns_ = ["doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("bigint").alias("slot"), *extra]
    return large.select(*columns_).unionAll(others.withColumn("slot", F.col("row") + F.get(shift, "shard")).select(*columns_))


def write(docs: DataFrame, folder: str, shards: int = 8, rows_per_file: int = 1_000_000, **how) -> None:
    """Writes the documents with all their columns as Parquet in ``folder/shard=k``, in the order of
    slots. If the documents have a column shard, the folders' name has underscores before it."""
    name = next("_" * k + "shard" for k in range(len(docs.columns) + 1) if "_" * k + "shard" not in docs.columns)
    out = assign(docs, shards, keep=F.struct(*(F.col(f"`{c}`") for c in docs.columns)), **how)
    out = out.repartition("shard", F.floor(F.col("slot") / rows_per_file)).sortWithinPartitions("shard", "slot")
    out.select(F.col("shard").alias(name), "kept.*").write.partitionBy(name).parquet(folder)


#: ties of equal rows aside, the result is fixed by the order of keys, so SQL needs no sample
SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, md5(coalesce(text, '')) AS h, coalesce(text, '') AS text FROM documents),
t AS (SELECT coalesce(sum(size), 0)::BIGINT AS total, count(*) AS n FROM d),
g AS (SELECT h, true AS hot FROM d, t GROUP BY h, t.total, t.n HAVING sum(size) * 800 > t.total OR (count(*) > 10000 AND count(*) * 800 > t.n)),
l AS (SELECT doc_id, size, h, row_number() OVER (ORDER BY size DESC, h, doc_id NULLS FIRST) AS k FROM d, t WHERE size * 800 > total),
p AS (SELECT 0::BIGINT AS k, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[] AS loads, 0 AS shard
      UNION ALL
      SELECT l.k, list_transform(p.loads, lambda v, i: CASE WHEN i = list_position(p.loads, list_min(p.loads)) THEN v + l.size ELSE v END),
             list_position(p.loads, list_min(p.loads)) - 1
      FROM p JOIN l ON l.k = p.k + 1),
big AS (SELECT l.doc_id, l.size, l.h, p.shard FROM l JOIN p ON l.k = p.k),
loads AS (SELECT s.shard, coalesce(sum(size), 0)::BIGINT AS load, count(size) AS k FROM (SELECT unnest(range(8)) AS shard) s LEFT JOIN big b ON b.shard = s.shard GROUP BY s.shard),
rest AS (SELECT d.*, g.hot, row_number() OVER (ORDER BY d.h, d.doc_id NULLS FIRST) AS r FROM d LEFT JOIN g ON g.h = d.h, t WHERE d.size * 800 <= t.total),
ranked AS (SELECT load, row_number() OVER (ORDER BY load) AS k, lead(load) OVER (ORDER BY load) AS next_load,
                  ((SELECT coalesce(sum(size), 0) FROM rest) + sum(load) OVER (ORDER BY load ROWS UNBOUNDED PRECEDING))::BIGINT AS filled FROM loads),
lvl AS (SELECT filled // k AS level FROM ranked WHERE next_load IS NULL OR filled // k <= next_load ORDER BY k LIMIT 1),
cuts AS (SELECT a.shard, sum(greatest(0, lvl.level - b.load))::BIGINT AS cut FROM loads a JOIN loads b ON b.shard <= a.shard, lvl WHERE a.shard < 7 GROUP BY a.shard),
mid AS (SELECT *, 2 * sum(size) OVER (ORDER BY r) AS upto, CASE WHEN hot THEN r END AS own FROM rest),
units AS (SELECT h, own, max(upto) - sum(size) AS middle FROM mid GROUP BY h, own),
placed AS (SELECT m.doc_id, m.size, m.text, m.h, m.r, (SELECT count(*) FROM cuts WHERE 2 * cut <= u.middle) AS shard
           FROM mid m JOIN units u ON u.h = m.h AND u.own IS NOT DISTINCT FROM m.own),
slots AS (SELECT doc_id, size, text, p.shard, loads.k + row_number() OVER (PARTITION BY p.shard ORDER BY r) - 1 AS slot FROM placed p JOIN loads ON loads.shard = p.shard
          UNION ALL
          SELECT b.doc_id, b.size, d.text, b.shard, row_number() OVER (PARTITION BY b.shard ORDER BY b.h, b.doc_id NULLS FIRST) - 1 FROM big b JOIN d ON d.doc_id = b.doc_id AND d.h = b.h),
{CRC_TABLE}
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST({crc_sql('text')} AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, CAST(slot AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM slots, crct
"""


def query(spark, sf_dir):
    out = assign(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
