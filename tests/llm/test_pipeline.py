"""The pipeline's stages against what each should keep of its own input."""

import collections
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tabsight.functions.lineage import written
from tabsight.llm import decontamination, quality

from .test_operators import brute_components, words


def test_stages(spark, sf):
    docs = written(spark.read.parquet(f"{sf}/documents.parquet").withColumn("extra", F.lit("x")))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, sf))
        if name != "token output":
            assert docs.columns == before.columns
        kept[name] = (before.collect(), docs.collect())
    ids = {n: [[r["doc_id"] for r in x] for x in v] for n, v in kept.items()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    before, after = ids["quality classifier"]
    assert sum(labels.get(i) == 1 for i in after) >= 0.98 * sum(labels.get(i) == 1 for i in before)
    assert sum(labels.get(i) == 0 for i in after) <= 0.25 * sum(labels.get(i) == 0 for i in before)
    before, after = kept["n-gram Jaccard join"]
    rows = [(r["doc_id"], r["text"]) for r in before]
    assert sorted(r["doc_id"] for r in after) == sorted({c for _, n, c in brute_components(rows) if n} | {d for d, t in rows if not words(t)})
    before, after = ids["benchmark decontamination"]
    bad = {r[0] for r in decontamination.contaminated(spark.createDataFrame(kept["benchmark decontamination"][0]),
                                                      spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert set(before) - set(after) == bad & set(before)
    before, after = kept["mixing sources"]
    size = lambda rs: sum(len(words(r["text"])) for r in rs)
    assert 1.2 * size(before) < size(after) < 1.8 * size(before) and max(collections.Counter(r["doc_id"] for r in after).values()) <= 2
    before, after = kept["token output"]
    t, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    want = []
    for r in sorted(before, key=lambda r: r["doc_id"]):
        x = np.array(t.encode(r["text"] or "", add_special_tokens=False).ids + [0], dtype="<u4")
        want.append((r["doc_id"], at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert sorted(map(tuple, after)) == sorted(want)


def test_run_and_registration(spark, sf):
    import __spark_entry__ as entry
    assert entry.queries()["pipeline"] is corpus_pipeline.run and corpus_pipeline.ORACLE_SQL is None
    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in entry.queries()}
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 100


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf))
    assert docs.count() == 0
    assert quality.CUT == 0.3


def test_decontamination_stage_keeps_clean_rows_of_a_null_id(spark, sf):
    passage = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 200").first()["text"]
    docs = spark.createDataFrame([(None, passage), (None, "other text"), (2, passage), (2, "text of the same id")], "doc_id long, text string")
    assert sorted(r["text"] for r in corpus_pipeline.decontamination_stage(spark, docs, sf).collect()) == ["other text", "text of the same id"]
