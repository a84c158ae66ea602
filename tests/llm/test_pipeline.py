"""The corpus pipeline as a whole, against its stages one by one."""

from __future__ import annotations

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import decontaminate, language_id, packing

SF = "/root/testdata/sf0.001"


def test_each_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit(1)).cache()
    known = corpus_pipeline.known_language(spark, docs, SF)
    assert known.columns == docs.columns
    judge = language_id.Judge(language_id.dictionaries(docs))
    want = []
    for r in docs.collect():
        lang, margin = judge((r["text"] or "").encode())
        want += [r["doc_id"]] if lang != "und" and margin >= language_id.MARGIN else []
    assert sorted(r["doc_id"] for r in known.collect()) == sorted(want)

    def print_of(text):
        w = (text or "").encode().lower().split()
        s = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    unlike = corpus_pipeline.without_near_copies(spark, docs, SF)
    assert unlike.columns == docs.columns
    ids, prints = zip(*sorted((r["doc_id"], print_of(r["text"])) for r in docs.collect()))
    prints = np.array(prints, np.uint64)
    near = [set(np.nonzero(np.bitwise_count(prints ^ p) <= 4)[0].tolist()) for p in prints]
    stays, seen = [], set()
    for k, doc_id in enumerate(ids):
        if k not in seen:
            stays.append(doc_id)
            todo = [k]
            while todo:
                if (x := todo.pop()) not in seen:
                    seen.add(x)
                    todo += near[x] - seen
    assert sorted(r["doc_id"] for r in unlike.collect()) == sorted(stays)

    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    clean = corpus_pipeline.without_benchmark(spark, docs, SF)
    marked = {r["doc_id"] for r in decontaminate.contamination(docs, items).where("contaminated").collect()}
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == sorted(set(ids) - marked)
    private = corpus_pipeline.without_personal_data(spark, docs, SF)
    assert private.columns == docs.columns and private.where("n_chars <> length(text)").isEmpty() and private.count() == docs.count()


def test_whole_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    step = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = spark.createDataFrame(stage(spark, step, SF).collect(), docs.schema)
    encode = packing.encoder(packing.default_vocabulary()).tokenizer.encode
    sizes = {r["doc_id"]: len(encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in step.collect()}
    got: dict[int, int] = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        assert r["doc_tokens"] == sizes[r["doc_id"]]
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == sizes


def test_odd_rows(spark):
    g = random.Random(3)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(None, None, None, None, None), (1, "", None, None, None), (1, "", "en", "s", 0), (10**9, "the and of " * g.randrange(20_000, 30_000), "en", "s", None), (None, "the end", "en", None, 1)]
    given = docs.limit(40).unionByName(spark.createDataFrame(odd, docs.schema)).withColumns({"__key": F.lit(1), "spans": F.lit("x")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, given, SF)
        assert out.columns == given.columns and out.count() <= given.count() and out.limit(0).isEmpty()
        assert stage(spark, given.limit(0), SF).isEmpty()
    assert corpus_pipeline.packed(spark, given, SF).select("doc_id").distinct().count() == given.select("doc_id").distinct().count()
    assert corpus_pipeline.packed(spark, given.limit(0), SF).isEmpty()
