"""Documents to token ids: toxicity, language, near-duplicates, benchmark contamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written and read again.
- toxicity: documents scored 0.5 or more go. It learns from all labelled documents.
- language: documents without a language, and those whose language is uncertain, go. It learns from the lang column.
- near_duplicates: of documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, directly or
  through others, the one of the smallest doc_id stays. SimHash blocks link what they reach, min-hash bands the rest, and
  whole sets verify each link.
- decontamination: documents that share ten words in a row with a benchmark item, or hold a shorter item, go.
- bpe: the ids of what is left, with digests of the ids and of what they decode to.
Rows with a null in any column pass as the operators define it: a null text is empty, so it has no language and goes.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import bpe, decontam, langid, similar, toxicity
from loomwork.storage import Scratch

#: Words of a shingle and the least similarity of near-duplicates; the share of the usual tables that encoding keeps, as
#: workers of other stages need the memory.
SHINGLE, SIMILARITY, BPE_ENTRIES = 5, 0.8, 0.4


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), apart=True)
    return toxicity.score(docs, model, to="__score").where(F.col("__score") < 0.5).select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.predict(docs, langid.fit(docs), to="__language")
    return found.where(~langid.is_rejected(F.col("__language.lang_pred"), F.col("__language.score"))).select(*docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.survivors(docs, words=SHINGLE, least=SIMILARITY).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    marked = docs.withColumn("__key", F.xxhash64(F.col("doc_id").cast("string"), "text"))
    found = decontam.contamination(marked, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id="__key")
    hit = found.where(F.col("n_hit") > 0).select(F.col("doc_id").alias("__key")).distinct()
    return marked.join(hit, "__key", "left_anti").select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = bpe.round_trip(docs, path, public_tokenizers.PATTERN, keep_ids=True, entries=BPE_ENTRIES, release=True)
    return found.select("doc_id", "lang", "source", "bpe.*")


STAGES = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: The stages learn models and link fingerprints over rounds, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with Scratch() as scratch:
            docs = scratch.kept(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
