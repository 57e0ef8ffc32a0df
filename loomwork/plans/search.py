"""Queries over texts and pages: tokens, postings, ranked search, extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text
from .registry import Tables, query


def _squeezed(c: str) -> str:
    for x in "abcdefghijklmnopqrstuvwxyz0123456789":
        c = f"regexp_replace({c}, '{x}{{2,}}', '{x}', 'g')"
    return c


_TERMS = f"terms AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all({_squeezed('lower(text)')}, '[0-9a-z]+')) AS term FROM documents)"
#: ASCII terms only: what DuckDB can fold as well.
_ASCII = "[0-9a-z]+"


def _posts(t: Tables):
    words = F.regexp_extract_all(text.squeezed(F.lower("text")), F.lit(_ASCII), F.lit(0))
    return t.documents.select("doc_id", F.explode(F.array_distinct(words)).alias("term"))


@query(f"WITH {_TERMS} SELECT term, count(*) AS df, list_sort(list(doc_id)) AS docs FROM terms GROUP BY 1")
def inverted_index(t: Tables):
    found = text.term_docs(_posts(t))
    return found.select("term", "df", "docs")


@query(f"""
WITH {_TERMS}, f AS (SELECT term, count(*) AS df FROM terms GROUP BY 1), n AS (SELECT count(*)::DOUBLE AS n FROM documents),
h AS (SELECT doc_id, term, ln(1 + n / df) AS w FROM terms JOIN f USING (term), n WHERE term IN ('erner', 'thea', 'inor')),
d AS (SELECT doc_id, count(*) AS k, sum(w) AS score FROM h GROUP BY 1)
SELECT doc_id, round(score, 6) AS score FROM d WHERE k = (SELECT max(k) FROM d) AND 2 * k >= 3 ORDER BY score DESC, doc_id LIMIT 30
""")
def text_search_ranked(t: Tables):
    posts = _posts(t)
    words = ["erner", "thea", "inor"]
    hits = text.matched(posts, text.frequencies(posts), words, t.documents.count(), prefixes=False, typos=False)
    return text.ranked(hits, words, 30).select("doc_id", F.round("score", 6).alias("score"))


@query()
def text_search_fuzzy(t: Tables):
    """Exact, prefix, misspelt and compound matches together, over folded text."""
    posts = text.postings(t.documents, "doc_id", "text")
    words = ["errner", "theaand"]
    hits = text.matched(posts, text.frequencies(posts), words, t.documents.count())
    return text.ranked(hits, words, 30).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_TERMS} SELECT DISTINCT term FROM terms WHERE starts_with(term, 'th') AND term <> 'th' ORDER BY term LIMIT 64")
def prefix_terms(t: Tables):
    return text.with_prefix(_posts(t).select("term").distinct(), "th")


@query(f"""
WITH {_TERMS}, w AS (SELECT DISTINCT term FROM terms WHERE length(term) BETWEEN 3 AND 9)
SELECT word, term, CASE WHEN damerau_levenshtein(word, term) = 0 THEN 0 ELSE damerau_levenshtein(word, term) END::INT AS distance FROM w, (VALUES ('heated'), ('stion')) q(word) WHERE damerau_levenshtein(word, term) <= 1
""")
def typo_terms(t: Tables):
    terms = _posts(t).select("term").distinct().where(F.length("term").between(3, 9))
    return text.misspelt(terms, ["heated", "stion"], 1)


@query("SELECT p_type AS value, (row_number() OVER (ORDER BY p_type) - 1)::BIGINT AS code FROM (SELECT DISTINCT p_type FROM part)")
def string_dictionary(t: Tables):
    return text.dictionary(t.part, "p_type").select("value", F.col("code").cast("bigint").alias("code"))


@query("""
SELECT doc_id, regexp_matches(text, '[0-9]{4,}') AS numbers, regexp_matches(text, '(?i)https?://') AS links, regexp_matches(text, '!!') AS loud, regexp_matches(text, 'ción') AS spanish FROM documents
""")
def regex_label_matrix(t: Tables):
    return t.documents.select("doc_id", *[c.alias(n) for n, c in text.labels("text", {"numbers": "[0-9]{4,}", "links": "(?i)https?://", "loud": "!!", "spanish": "ción"}).items()])


@query("""
SELECT page_id, try_cast(coalesce(nullif(regexp_extract(url, '[?&]page=(\\d+)', 1), ''), nullif(regexp_extract(url, '/(\\d+)(?:[?#]|$)', 1), '')) AS BIGINT) AS id FROM pages
""")
def url_id_extract(t: Tables):
    return t.pages.select("page_id", text.ids_in("url", [r"[?&]page=(\d+)", r"/(\d+)(?:[?#]|$)"]).alias("id"))


@query("""
SELECT p_partkey, lower(trim(p_name)) AS name, concat_ws(' ', p_brand, nullif(p_type, ''), NULL) AS joined, p_brand || p_type AS plain, try_cast(substring(p_brand, 7, 2) AS INT) AS code, md5(p_name) AS md5, sha256(p_name) AS sha FROM part
""")
def string_functions(t: Tables):
    return t.part.select(
        "p_partkey",
        F.lower(F.trim("p_name")).alias("name"),
        F.concat_ws(" ", "p_brand", F.nullif(F.col("p_type"), F.lit("")), F.lit(None).cast("string")).alias("joined"),
        F.concat("p_brand", "p_type").alias("plain"),
        F.substring("p_brand", 7, 2).try_cast("int").alias("code"),
        F.md5(F.col("p_name").cast("binary")).alias("md5"),
        F.sha2(F.col("p_name").cast("binary"), 256).alias("sha"),
    )


@query("""
SELECT conv_id, count(*) AS turns, list(role ORDER BY turn) AS roles, sum(length(text))::BIGINT AS chars, arg_max(role, turn) AS last_role FROM conversations GROUP BY 1
""")
def parse_blocks(t: Tables):
    """Ordered rows gathered into one row a conversation."""
    from ..operators.sequence import sequences

    found = sequences(t.conversations, "conv_id", ["turn"], ["role", "text"])
    return found.select("conv_id", F.size("rows").cast("bigint").alias("turns"), F.transform("rows", lambda r: r["role"]).alias("roles"), F.aggregate("rows", F.lit(0).cast("bigint"), lambda a, r: a + F.char_length(r["text"])).alias("chars"), F.element_at("rows", -1)["role"].alias("last_role"))


_DIGITS = "trim(regexp_replace(url, '[^0-9]+', ' ', 'g'))"


@query(f"""
SELECT page_id, string_split(url, '/')[1:3] AS head, list_filter(list_transform(string_split({_DIGITS}, ' '), lambda x: try_cast(x AS BIGINT)), lambda x: x IS NOT NULL) AS ids,
list_sort(list_distinct(list_transform(regexp_extract_all(upper(url), '[A-Z0-9]{{2}}'), lambda x: CASE x WHEN 'HT' THEN 'DC' ELSE x END))) AS parts FROM pages
""")
def lists_in_text(t: Tables):
    """Lists read from pages' addresses."""
    digits = F.regexp_replace("url", "[^0-9]+", " ")
    return t.pages.select("page_id", F.slice(F.split("url", "/"), 1, 3).alias("head"), text.id_list(digits).alias("ids"), F.array_sort(text.chunks_of_two("url", {"HT": "DC"})).alias("parts"))


@query()
def catalog_search(t: Tables):
    """A search as it is typed, with a misspelt word: strict, then fuzzy, fields at the end."""
    docs = t.part.select(F.col("p_partkey").alias("doc_id"), (F.col("p_size") % 2).alias("status"), F.col("p_retailprice").alias("stars"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.col("p_type").alias("creator"))
    posts = text.postings(docs.withColumn("whole", F.concat_ws(" ", "title", "artist", "creator")), "doc_id", "whole")
    found = text.search(posts, text.frequencies(posts), docs, "standrad brand")
    return t.spark.createDataFrame([(r["doc_id"], round(r["score"], 6)) for r in found], "doc_id bigint, score double")
