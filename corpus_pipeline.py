"""From documents to a training mixture, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; ``run``
writes each stage's rows as Parquet to the shared folder and reads them again. All but the
last return the columns of ``documents``.

Defined results: null or empty texts are clean, equal to nothing, unredacted and of size 0;
rows with a null doc_id can't be named and so pass the filtering stages; repeated rows share
their decisions; empty tables give empty results; extra columns, whatever their names, are carried
to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoline.llm import decontaminate, jaccard_join, mixing, pii, toxicity
from chronoline.llm.common import columns, packed, shared_dir, small_batches, table, unpacked, without


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that op5_toxicity doesn't reject, by its own threshold."""
    small_batches(spark, 1000)
    model = toxicity.fit(columns(docs, doc_id=("doc_id", "bigint"), text=("text", "string")), table(spark, sf_dir, "labels"))
    return unpacked(toxicity.score(packed(docs), model).where("predicted = 0"), docs)


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near-duplicates."""
    small_batches(spark, 1000)
    groups = jaccard_join.near_duplicates(docs)
    return without(docs, groups.where("component_id != doc_id"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    small_batches(spark, 1000)
    found = decontaminate.overlaps(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.where(F.size("hits") > 0))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    small_batches(spark, 1000)
    out = pii.redact(docs, pii.fit(columns(docs, text=("text", "string"))))
    kind = dict(docs.dtypes).get("n_chars")
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind)) if kind else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: how often each document is taken."""
    return mixing.mix(docs).where("copies > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", one_per_group),
    ("decontamination", drop_benchmark),
    ("personal data", redact_pii),
    ("mixing", mix_sources),
]

#: the models of two stages can't be written in SQL; tests hold the stages' decisions against the
#: operators' own, and those against brute force where there is one
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; a stage's rows are deleted once the next one's are written."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    return docs
