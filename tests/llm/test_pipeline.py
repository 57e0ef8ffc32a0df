"""The pipeline's stages on planted cases, and its last stages against brute force."""

import hashlib

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.01"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    clean = " ".join(f"und die erung der heit {i} schaft ung von zu" for i in range(40))
    extra = spark.createDataFrame([(50001, None, None, None, None), (50002, "", "en", "s", 0), (50003, "1234 5678", "en", "s", 9), (50004, clean, "de", "s", 5), (50005, clean, "de", "s", 5), (50005, clean, "de", "s", 5), (50006, clean + passage, "de", "s", 5)], docs.schema)
    rows = docs.unionByName(extra)
    by = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect() if r["doc_id"] >= 50000)
    kept = by["toxicity"](spark, rows, SF)
    assert kept.columns == docs.columns and 0 < kept.count() <= rows.count()
    kept = by["language"](spark, rows, SF)
    assert kept.columns == docs.columns and ids(kept) == [50004, 50005, 50005, 50006]
    kept = by["near_duplicates"](spark, kept, SF)
    assert kept.columns == docs.columns and 50004 in ids(kept) and 50005 not in ids(kept)
    kept = by["decontamination"](spark, rows, SF)
    assert kept.columns == docs.columns and 50006 not in ids(kept) and 50004 in ids(kept) and 50001 in ids(kept)
    found = by["bpe"](spark, extra, SF).collect()
    assert len(found) == 7 and all(r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest() for r in found for t in [{50001: "", 50002: "", 50003: "1234 5678", 50006: clean + passage}.get(r["doc_id"], clean)])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_run_is_the_stages_in_turn(spark):
    whole = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 600 < whole.count() < docs.count()
    kept = docs.join(whole.select("doc_id"), "doc_id")
    sums = {r["doc_id"]: r["decoded_sha256"] for r in whole.collect()}
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == sums[r["doc_id"]] for r in kept.collect())
    texts = kept.groupBy(F.lower("text")).count().where("count > 1")
    assert texts.count() == 0


def test_toxicity_is_learnt_in_a_task(spark, monkeypatch):
    """The driver, which holds all plans, has neither the texts nor the tables that learning takes; the model is the same."""
    from loomwork.llm import toxicity

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels, rows=30)
    apart = toxicity.fit(docs, labels, rows=30, apart=True)
    assert model.shift == apart.shift and all((model.p[k] == apart.p[k]).all() for k in model.p) and model.constant is apart.constant is None
    assert toxicity.fit(docs, labels.limit(0), apart=True).constant == toxicity.fit(docs.limit(0), labels, apart=True).constant == 0.0
    monkeypatch.setattr(toxicity, "_run", None)  # in this process; tasks import their own
    assert 0 < corpus_pipeline.toxicity_stage(spark, docs, SF).count() <= docs.count()
