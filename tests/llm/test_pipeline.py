"""The stages against their operators' own decisions, and the queries with SQL."""

import os
import random
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronoline.llm import jaccard_join, pii, registry, textcols, toxicity
from chronoline.llm.textcols import slabs

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_stages(spark, docs_of, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"] for r in docs.collect()}
    names = docs.columns
    kept = [before]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == names
        kept.append({r["doc_id"] for r in docs.collect()})
        assert kept[-1] <= kept[-2]
    assert kept[4] == kept[3] and kept[4]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/1").collect()}
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for d, t in texts.items() if any(b in t for b in bench)}
    assert not leaks & kept[3]
    assert len({texts[d] for d in kept[2]}) == len(kept[2])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_toxicity_stage_removes_what_op5_predicts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r["doc_id"]: (r["score"], r["predicted"]) for r in registry.queries()["op5_toxicity"](spark, SF).collect()}
    gone = {d for d, (_, p) in found.items() if p}
    assert gone == {d for d, (s, _) in found.items() if s >= 0.3}
    assert {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, SF).select("doc_id").collect()} == set(found) - gone


def test_toxicity_stage_by_the_score(spark, docs_of, monkeypatch):
    def score(docs, model, threshold=toxicity.score.__defaults__[0]):
        return docs.withColumn("predicted", (F.col("row.doc_id") / 100 >= threshold).cast("int"))

    monkeypatch.setattr(toxicity, "fit", lambda *_: None)
    monkeypatch.setattr(toxicity, "score", score)
    kept = corpus_pipeline.drop_toxic(spark, docs_of([(k, "x") for k in (5, 29, 30, 45, 50)]), SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == [5, 29]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_stages_on_odd_tables(spark, docs_of):
    odd = docs_of([(1, None), (2, ""), (None, "mail a@b.org"), (2, "x"), (3, "x"), (4, "one two three four five six"), (5, "one two three four five six")])
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in docs.collect())
    assert got == [("1", "None"), ("2", ""), ("2", "x"), ("4", "one two three four five six"), ("None", "mail <email>")]
    empty = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    show = lambda v: "null" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)
    got = sorted(tuple(show(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert got == sorted(tuple(show(r[names.index(c)]) for c in cols) for r in cur.fetchall())


def test_redaction_is_that_of_all_windows(docs_of, prose):
    """What the personal data stage redacts is what every window of every text decoded gives, marks or none."""
    r = random.Random(5)
    docs = docs_of([(k, f"{prose(r, r.randrange(60))} 555-123-4{k:03} {prose(r, r.randrange(60))}") for k in range(100, 140)] + [(1, prose(r, 90)), (2, None)])
    model = pii.Tagger(seed=3)
    model.p["T"] = np.eye(pii.TAGS, dtype=np.float32) * 3
    model.p["O"] = model.p["O"] * 3
    model.p["O"][-1, 4] += 1  # phones, in runs of many windows
    changed = 0
    got = {x["doc_id"]: x["text"] for x in pii.redact(docs, model).collect()}
    for row in docs.collect():
        text = row["text"] or ""
        ids = pii._ids(text)
        starts = pii._starts(len(ids))
        x, size = pii._cut(ids, starts)
        runs = pii._spans_of(model.decode(x, size), starts, size, len(ids)) if len(ids) else []
        spans = pii.base_spans(text)
        taken = {p for s, _, e in spans for p in range(s, e)}
        more = [f for f in (pii.trimmed(text, *r) for r in runs) if not taken & set(range(f[0], f[2])) and pii.holds(f[1], text[f[0] : f[2]])]
        at, out = 0, []
        for s, k, e in sorted(spans + more):
            out += [text[at:s], f"<{pii.KINDS[k]}>"] if s >= at else [f"<{pii.KINDS[k]}>"]
            at = e
        changed += bool(more)
        assert got[row["doc_id"]] == (None if row["text"] is None else "".join(out) + text[at:]), row["doc_id"]
    assert changed >= 5, changed


def test_text_passes_hold_little():
    """What a worker holds beside its texts, in the passes of toxicity and near duplicates, stays small: two work in each executor."""
    r = np.random.default_rng(5)
    texts = pa.array([" ".join(f"w{x}" for x in r.integers(0, 100_000, 500)) for _ in range(1000)])
    docs = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), texts], ["doc_id", "text"])
    model = np.zeros(toxicity.BUCKETS, np.float32), np.zeros((2, 2))

    def marks():
        for _, raw, at in slabs(texts, toxicity.BIG):
            toxicity._marked(raw, at, model)

    for most, work in ((60e6, marks), (50e6, lambda: list(jaccard_join._profile(5)([docs]))), (50e6, lambda: list(jaccard_join._distinct_sets([docs.select(["text"])], 5)))):
        textcols._powers.clear()
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most, peak
