"""Mixing sources to target weights by Pareto order sampling.

Every source gets a share of the words by weight, but never more than ``max_factor`` times
its own size; what a source can't take goes to the others by weight. A document's expected
copies are target / source size: the whole part is certain, the rest is an inclusion
probability p. Documents rank by the ratio of random odds u/(1-u) to inclusion odds p/(1-p),
where u is a hash of doc_id; the lowest ranks are taken until the source's words are met.

The cut is found without sorting a source in one task: ranks fall into ``bins`` per source,
bin sums give the bin where the cut lies, and only that bin is ordered. Sources may hold
any share of the rows.

Defined results: null text has size 0 and is never copied beyond the certain copies; null
source is a source of its own, ordered last; equal ranks (repeated doc_ids) order by size; rows
equal in both too are taken one by one by the running sum, so one may be taken and its repetition
not; texts of any length are counted whole; an empty table gives an empty result; columns other
than the named ones are ignored. Without words at all every document takes 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoline.llm.common import cut
from chronoline.llm.textcols import CLASSES, buffers

SPACE = CLASSES["space"]


def word_sizes(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and size: the number of words ``[^\\x20\\x09-\\x0D]+`` of the whole text."""

    def count(batches):
        for b in batches:
            raw, at = buffers(b.column(len(keep)))
            inside = SPACE[raw]
            begins = inside.copy()
            begins[1:] &= ~inside[:-1]
            firsts = at[:-1][at[:-1] < len(raw)]
            begins[firsts] = inside[firsts]
            total = np.zeros(len(raw) + 1, np.int64)
            np.cumsum(begins, out=total[1:])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(total[at[1:]] - total[at[:-1]], pa.int64())], [*keep, "size"])

    kinds = dict(docs.dtypes)
    return docs.select(*keep, text).mapInArrow(count, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", size bigint")


def targets(sizes: DataFrame, weights=(1, 2, 3), max_factor: int = 3) -> DataFrame:
    """(source, source_size, target) by water filling. ``sizes``: (source, source_size).
    One row per source goes through one task; their number is that of sources."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1).cast("double"))
    w = w.withColumn("cap", F.lit(float(max_factor)) * F.col("source_size")).withColumn("level", F.col("cap") / F.col("w"))
    rank = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    w = w.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    w = w.withColumn("open", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    # sources fill up in the order of level; from the first that does not, all share one level
    w = w.withColumn("full", F.col("level") <= F.col("left") / F.col("open"))
    w = w.withColumn("share", F.min(F.when(~F.col("full"), F.struct("level", F.col("left") / F.col("open")))).over(every)["col2"])
    return w.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("share") * F.col("w")).alias("target"))


def mix(docs: DataFrame, weights=(1, 2, 3), max_factor: int = 3, seed: str = "mix", bins: int = 4096, doc: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every document."""
    sized = word_sizes(docs.select(F.col(doc).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")), ["doc_id", "source"])
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.lit(seed)).cast("binary"))
    sized = sized.withColumn("u", (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48))
    sized = cut(sized)  # a few dozen bytes a document, read five times below
    goal = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_factor))
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    goal = goal.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    goal = goal.withColumn("p", F.when(F.col("source_size") > 0, F.col("rest") / F.col("source_size")).otherwise(F.lit(0.0)))
    rows = sized.join(F.broadcast(goal) if _few(goal) else goal, sized["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    # odds ratio q = (u/(1-u)) / (p/(1-p)); q/(1+q) is in (0, 1) and keeps the order
    q = (F.col("u") * (1 - F.col("p"))) / (F.col("u") * (1 - F.col("p")) + (1 - F.col("u")) * F.col("p"))
    rows = rows.withColumn("rank", F.when(F.col("p") > 0, q).otherwise(F.lit(1.0))).withColumn("bin", F.least(F.floor(F.col("rank") * bins), F.lit(bins - 1)).cast("int"))
    by = rows.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.max("rest").alias("rest"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    # the cut lies in the bin whose words pass what is wanted
    edge = by.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest"))).select("source", F.col("bin").alias("cut_bin"), F.col("before").alias("cut_before"))
    small = _few(goal)
    edge = F.broadcast(edge) if small else edge
    rows = rows.join(edge.withColumnRenamed("source", "cut_source"), F.col("source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source")
    within = rows.where(F.col("bin") == F.col("cut_bin"))
    order = Window.partitionBy("source", "cut_bin").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    within = within.withColumn("sofar", F.col("cut_before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    # half a document over is as near as half a document short
    within = within.withColumn("more", (F.col("sofar") + F.col("size") / 2 <= F.col("rest")).cast("long")).drop("sofar")
    other = rows.where(F.col("cut_bin").isNull() | (F.col("bin") != F.col("cut_bin")))
    other = other.withColumn("more", F.when(F.col("p") <= 0, 0).when(F.col("cut_bin").isNull() | (F.col("bin") < F.col("cut_bin")), 1).otherwise(0).cast("long"))
    out = within.unionByName(other).withColumn("copies", (F.col("whole") + F.col("more")).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _few(goal: DataFrame, most: int = 10_000) -> bool:
    """True if there are at most ``most`` sources, so that a table of them may be broadcast."""
    return goal.select("source").limit(most + 1).count() <= most


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix'), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0 AS u
  FROM documents),
s AS (SELECT source, sum(size) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
l AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, CAST(w AS DOUBLE) AS w, 3.0::DOUBLE * source_size AS cap FROM s),
m AS (SELECT *, cap / w AS level,
             sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_all,
             sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open
      FROM l),
f AS (SELECT *, level <= rest_all / open AS is_full FROM m),
g AS (SELECT source, source_size,
             CASE WHEN is_full THEN cap ELSE w * (SELECT rest_all / open FROM f WHERE NOT is_full ORDER BY level LIMIT 1) END AS target FROM f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM g),
r AS (SELECT *, target - whole * source_size AS rest FROM p),
j AS (SELECT d.*, r.source_size, r.target, r.whole, r.rest, CASE WHEN r.source_size > 0 THEN r.rest / r.source_size ELSE 0 END AS p
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) ELSE u END, doc_id, size
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sofar FROM j),
c AS (SELECT *, whole + CASE WHEN p > 0 AND sofar + size / 2.0 <= rest THEN 1 ELSE 0 END AS copies FROM o)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies, source FROM c
"""


def query(spark, sf_dir):
    from chronoline.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")
