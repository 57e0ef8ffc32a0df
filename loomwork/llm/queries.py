"""The registered queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, langid, lm, permutation, quality, simhash, tokenfile, toxicity, warc
from .common import remainder, shared_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder("doc_id", 3) == 1
    model = langid.fit(docs.where(~held_out))
    scored = langid.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return scored.select("doc_id", "held_out", "language.*")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = shared_path(spark, "warc")
    return warc.read(warc.write(pages, folder), folder)


def _learnable(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents, and the labels that may be learnt from."""
    return _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _learnable(spark, sf_dir)
    model = quality.fit(docs, labels)
    scored = quality.score(docs, model, to="score")
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _learnable(spark, sf_dir)
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model, to="score")
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", (remainder("doc_id", 10) == 0).alias("held_out"))
    model, counts = lm.fit(docs.where(~F.col("held_out")))
    scored = lm.score(docs, model, counts)
    return scored.select("doc_id", "held_out", "lm.n_tokens", "lm.n_known", F.lit(model.n).cast("bigint").alias("train_tokens"), "lm.base_score", "lm.score")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN).select("doc_id", "bpe.*")


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest, folder = tokenfile.save(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfile.read(manifest, folder)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_text("fp").alias("fingerprint"), "component_id")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, is_query = permutation.usable(_table(spark, sf_dir, "embeddings")), F.pmod("vec_id", F.lit(20)) == 0
    index = permutation.fit(rows, is_query)
    if index is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    return permutation.search(rows, is_query, index)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language": op1_language,
        "op2_warc": op2_warc,
        "op3_quality": op3_quality,
        "op4_toxicity": op4_toxicity,
        "op5_lm": op5_lm,
        "op6_decontamination": op6_decontamination,
        "op7_bpe": op7_bpe,
        "op8_tokens": op8_tokens,
        "op9_simhash": op9_simhash,
        "op10_neighbours": op10_neighbours,
    }


_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), q AS (SELECT page_id, strlen(h) AS n, sha1(h) AS d FROM p), g AS (SELECT d, max(page_id) AS m FROM q WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, q.d AS payload_digest, CASE WHEN n >= 1000 AND m <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND m <> page_id THEN m END AS refers_to
FROM q LEFT JOIN g ON q.d = g.d
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_DECONTAMINATION = f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS win FROM b WHERE len(w) > 0),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents), s AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: {{'at': i, 'win': array_to_string(w[i:i + n - 1], ' ')}})) AS r FROM d, s WHERE len(w) >= n),
h AS (SELECT doc_id, dw.n, r.at AS a, item_id FROM dw JOIN bw ON dw.n = bw.n AND r.win = bw.win),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(a, a + n)) AS p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',')) AS items_sha256 FROM h GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express. The others are held against brute force, the libraries or held-out
    labels in the tests."""
    return {"op2_warc": _WARC, "op6_decontamination": _DECONTAMINATION}
