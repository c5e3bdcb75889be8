"""License scan by diagonal voting.

Rolling word k-grams of every whole text are rows that Spark joins to the k-gram positions of
the templates; a joined row counts if its own words are the template's. It votes for the diagonal
(start in the text minus start in the template). Votes add up per document, template and
diagonal; diagonals of one template that lie within ``slack`` words of each other merge into
one region, so insertions and deletions don't split it; a region's score is the share of the
template's k-grams that it covers, and regions below ``floor`` fall away. All of this is Spark
aggregation and windows over the joined rows. Words are compared lower-cased (A-Z).

Phrases are templates that must stand whole: a diagonal with all their votes is a place.

Templates of up to ``MOST_GRAMS`` k-grams are broadcast, and a Bloom filter of them keeps
k-grams that can't join from leaving the task that reads the text; more templates are joined by
shuffle without a filter. The joined rows are dealt by document, so no label or template is hot.

Defined results: null and empty texts have no words, labels '' and score 0; texts of any length are
read whole, and their votes meet in one task; equal doc_ids give a row each; an empty table
gives an empty result; columns other than the named ones are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoline.llm.common import columns, cut
from chronoline.llm.textcols import Sieve, Words, grams, ragged, signed, slabs

K, MOST_GRAMS = 3, 200_000

#: Phrases that count wherever they stand whole.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

#: Opening passages of common licenses; a text that holds much of one gets its label.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version",
    "cc-by-nc": "this work is licensed under a creative commons attribution noncommercial international license",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
}


def _positions(phrases: dict[str, str], templates: dict[str, str]):
    """K-gram positions of all templates: (gram, template, position), labels, lengths, which are phrases."""
    texts = [*phrases.values(), *templates.values()]
    labels = [*phrases, *templates]
    gram, tid, pos, n_words = [], [], [], []
    for t, text in enumerate(texts):
        raw = np.frombuffer(text.encode(), np.uint8)
        w = Words(raw, np.array([0, len(raw)]), "alnum")
        if len(w) < K:
            raise ValueError(f"a template needs {K} words: {text!r}")
        g = grams(w.h, K)
        gram.append(g)
        tid.append(np.full(len(g), t))
        pos.append(np.arange(len(g)))
        n_words.append(len(w))
    return np.concatenate(gram), np.concatenate(tid), np.concatenate(pos), labels, np.array(n_words), len(phrases)


def template_rows(spark: SparkSession, phrases=None, templates=None) -> DataFrame:
    """(gram, template, position, words) of every k-gram of the templates."""
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    gram, tid, pos, *_ = _positions(phrases, templates)
    words = [t.split() for t in (*phrases.values(), *templates.values())]
    rows = [(int(a), int(b), int(c), " ".join(words[b][c : c + K])) for a, b, c in zip(signed(gram), tid, pos, strict=True)]
    return spark.createDataFrame(rows, "gram bigint, template int, position int, words string")


def _grams(docs: DataFrame, sieve) -> DataFrame:
    """(row, doc_id, n_words, grams): the k-grams of a document, with their start and their bytes."""
    kind = pa.struct([("gram", pa.int64()), ("start", pa.int64()), ("words", pa.binary())])

    def run(batches):
        for b in batches:
            n_words, offsets, parts = [], [np.zeros(1, np.int64)], []
            for _, raw, at in slabs(b.column(2)):
                w = Words(raw, at, "alnum")
                n_words.append(np.diff(w.first))
                g = grams(w.h, K)
                pick = sieve.value.pick(g) if sieve else np.arange(len(g))
                pick = pick[w.doc[pick] == w.doc[pick + K - 1]]
                size = w.end[pick + K - 1] - w.start[pick]
                data = w.low[np.repeat(w.start[pick], size) + ragged(size)]
                words = pa.Array.from_buffers(pa.large_binary(), len(pick), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(data)])
                parts.append(pa.StructArray.from_arrays([pa.array(signed(g[pick])), pa.array(pick - w.first[w.doc[pick]]), words.cast(pa.binary())], fields=list(kind)))
                offsets.append(offsets[-1][-1] + np.cumsum(np.bincount(w.doc[pick], minlength=len(at) - 1)))
            if n_words:
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(offsets), pa.int32()), pa.concat_arrays(parts))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(n_words), pa.int64()), lists], ["row", "doc_id", "n_words", "grams"])

    return docs.mapInArrow(run, "row bigint, doc_id bigint, n_words bigint, grams array<struct<gram:bigint,start:bigint,words:binary>>")


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, slack: int = 5, floor: float = 0.5, shuffle: bool | None = None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, places: array of (label, start), regions: array of (label, start, end, score)).
    Every phrase place and every template region of each document."""
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    gram, *_, labels, sizes, n_phrases = _positions(phrases, templates)
    spark = docs.sparkSession
    known = template_rows(spark, phrases, templates).withColumnRenamed("words", "known")
    shuffle = len(gram) > MOST_GRAMS if shuffle is None else shuffle
    docs = columns(docs, doc_id=(doc, "bigint"), text=(text, "string")).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    found = cut(_grams(docs, None if shuffle else spark.sparkContext.broadcast(Sieve(gram))))
    votes = found.select("row", F.explode("grams").alias("g")).select("row", "g.*").join(known if shuffle else F.broadcast(known), "gram")
    # the words themselves decide, not their hash
    own = F.regexp_replace(F.col("words").cast("string"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    votes = votes.where(own == F.col("known")).select("row", "template", (F.col("start") - F.col("position")).alias("diagonal"), "start", "position")
    lines = votes.repartition("row").groupBy("row", "template", "diagonal").agg(F.collect_set("position").alias("positions"), F.min("start").alias("start"), (F.max("start") + K).alias("end"))
    info = spark.createDataFrame([(t, label, int(n) - K + 1, t < n_phrases) for t, (label, n) in enumerate(zip(labels, sizes, strict=True))], "template int, label string, n_grams int, phrase boolean")
    lines = lines.join(F.broadcast(info), "template")  # a row for each template
    places = lines.where("phrase AND size(positions) = n_grams").groupBy("row").agg(F.sort_array(F.collect_list(F.struct(F.col("diagonal").alias("start"), "label"))).alias("places"))
    w = Window.partitionBy("row", "template").orderBy("diagonal")
    loose = lines.where("NOT phrase").withColumn("apart", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(w) > slack).cast("int"), F.lit(0)))
    loose = loose.withColumn("region", F.sum("apart").over(w))
    covered = F.size(F.array_distinct(F.flatten(F.collect_list("positions"))))
    regions = loose.groupBy("row", "template", "label", "n_grams", "region").agg(F.min("start").alias("start"), F.max("end").alias("end"), covered.alias("covered"))
    regions = regions.withColumn("score", F.col("covered") / F.col("n_grams")).where(F.col("score") >= floor)
    regions = regions.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "label", "end", "score"))).alias("regions"))
    out = found.select("row", "doc_id", "n_words").join(places, "row", "left").join(regions, "row", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce(F.transform("places", lambda p: F.struct(p["label"].alias("label"), p["start"].alias("start"))), F.array().cast("array<struct<label:string,start:bigint>>")).alias("places"),
        F.coalesce(F.transform("regions", lambda r: F.struct(r["label"].alias("label"), r["start"].alias("start"), r["end"].alias("end"), r["score"].alias("score"))), F.array().cast("array<struct<label:string,start:bigint,end:bigint,score:double>>")).alias("regions"),
    )


def query(spark, sf_dir):
    from chronoline.llm.common import table

    found = scan(table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda p: p["start"])
    named = lambda c: F.transform(c, lambda p: p["label"])
    best = F.array_max(F.transform("regions", lambda r: r["score"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(named("places"))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(named("places"), named("regions")))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.coalesce(best, F.lit(0.0)))).alias("score"),
    )
