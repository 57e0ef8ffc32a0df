"""Benchmark decontamination by winnowing, in DataFrame operations only.

Words are lower-cased runs of ASCII letters and digits and of all characters beyond ASCII. In every run of SPAN words of
a document, the K-gram of the least hash is kept, of equal ones the leftmost; the same is done to the benchmark. A run of
SPAN words that both share has the same K-grams in both, so both keep the same one: joining the kept K-grams finds every
shared run. Each hit is extended: the runs of SPAN words around it are compared as texts, so that a clash of hashes
counts for nothing. Items of fewer than SPAN words are one window each; documents are searched for them by all runs of
their lengths.

Documents are cut into words once, into a written table. From there K-grams go out alone, with their document's row and
their place; those that the benchmark has come back as places of rows, and the words of just these rows are looked at
again. What stands on the benchmark's side of a join, and the rows that were hit, are sent to all executors if a count
finds few enough, or else dealt out; nothing else differs. No text is carried by more than one row, so a long text costs
as much as its words in several short ones.

Null and empty texts have no words and no hits; a text may have up to 2 ** PLACE_BITS words. Each input row gives a row, repeated rows and repeated doc_ids too. Items with a
null id count as items without a name. Empty tables give empty results; without a benchmark nothing is hit. Only the
named columns are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SPAN, K = 10, 4
#: Bits of a kept K-gram that hold its place in the document; the others hold its hash.
PLACE_BITS = 28
#: K-grams (16 bytes each), windows (some 80) and rows that were hit (16), up to which each are sent to all executors.
BROADCAST_GRAMS, BROADCAST_WINDOWS, BROADCAST_ROWS = 2_000_000, 500_000, 1_000_000


def words(text: str | Column) -> Column:
    """The words, in order."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    whole = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    ascii_only = F.octet_length(whole) == F.char_length(whole)  # lower() may touch nothing beyond ASCII
    parts = F.split(F.when(ascii_only, F.lower(whole)).otherwise(F.translate(whole, upper, lower)), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.array_remove(parts, "")


def _shifted(values: Column, by: int) -> Column:
    """The values from index `by` on."""
    return F.slice(values, F.lit(by + 1), F.greatest(F.size(values) - by, F.lit(0)))


def _paired(left: Column, right: Column, join) -> Column:
    """join of left[i] and right[i], as far as the shorter one goes."""
    n = F.least(F.size(left), F.size(right))
    return F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(1), n), join)


def kept_grams(df: DataFrame, words_col: str, to: str, span: int = SPAN, k: int = K) -> DataFrame:
    """Adds the distinct kept K-grams: the hash in the high bits, the place of the first word in the low ones. Texts of
    fewer than `span` words have none."""
    places = (1 << PLACE_BITS) - 1
    grams = F.transform(F.col(words_col), lambda w: F.xxhash64(w))
    df = df.withColumn("__g1", grams)
    size, name = 1, "__g1"
    while size * 2 <= k:
        df = df.withColumn(f"__g{size * 2}", _paired(F.col(name), _shifted(F.col(name), size), lambda a, b: F.xxhash64(a, b)))
        size, name = size * 2, f"__g{size * 2}"
    if size < k:
        df = df.withColumn(f"__g{k}", _paired(F.col(name), _shifted(F.col(name), k - size), lambda a, b: F.xxhash64(a, b)))
        name = f"__g{k}"
    df = df.withColumn("__m1", F.transform(F.col(name), lambda h, i: h.bitwiseAND(F.lit(~places)).bitwiseOR(i.cast("bigint"))))
    width, size, name = span - k + 1, 1, "__m1"
    while size < width:
        step = min(size, width - size)
        df = df.withColumn(f"__m{size + step}", _paired(F.col(name), _shifted(F.col(name), step), lambda a, b: F.least(a, b)))
        size, name = size + step, f"__m{size + step}"
    return df.withColumn(to, F.array_distinct(F.col(name)))


def _sent(df: DataFrame, most: int) -> DataFrame:
    """The same table, to be sent to all executors if it has few enough rows."""
    return F.broadcast(df) if df.count() <= most else df


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN, k: int = K, broadcast_grams: int = BROADCAST_GRAMS, broadcast_windows: int = BROADCAST_WINDOWS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per row of docs: __row (unique), doc_id, n_words, n_hit, n_items, item_ids (sorted strings)."""
    hash_part, place_part = F.lit(~((1 << PLACE_BITS) - 1)), F.lit((1 << PLACE_BITS) - 1)
    items = written(benchmark.select(F.col(item_id).cast("string").alias("item"), words(item_text).alias("w")).where(F.size("w") > 0), "items")
    short = sorted(r["n"] for r in items.where(F.size("w") < span).select(F.size("w").alias("n")).distinct().collect())  # fewer than span lengths
    keys = [kept_grams(items.where(F.size("w") >= span), "w", "kept", span, k).select(F.explode_outer("kept").alias("kept")).where(F.col("kept").isNotNull()).select(F.col("kept").bitwiseAND(hash_part).alias("gram"))]
    keys += [items.where(F.size("w") == n).select(_run_key(F.col("w"), F.lit(1), n).alias("gram")) for n in short]
    grams = _sent(written(reduce(DataFrame.unionByName, keys).distinct(), "grams"), broadcast_grams)
    n = F.least(F.size("w"), F.lit(span))
    runs = items.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))).alias("window")).distinct()
    runs = written(runs.withColumn("wid", F.xxhash64("window")), "runs")  # joined by the window too, so a clash of hashes counts for nothing
    windows = _sent(runs.select("window").distinct(), broadcast_windows)

    whole = docs.select(F.col(doc_id).alias("doc_id"), words(text).alias("w"))
    whole = written(whole.select(F.monotonically_increasing_id().alias("__row"), "doc_id", F.size("w").alias("n_words"), "w"), "words")
    n_docs = whole.count()
    entry = lambda gram, place, n: F.struct(gram.alias("gram"), place.alias("place"), n.alias("n"))
    parts = [F.transform("__kept", lambda x: entry(x.bitwiseAND(hash_part), x.bitwiseAND(place_part).cast("int"), F.lit(span)))]
    for size in short:
        at = F.when(F.size("w") >= size, F.sequence(F.lit(1), F.size("w") - size + 1)).otherwise(F.array().cast("array<int>"))
        parts.append(F.transform(at, _run_entry(entry, size)))
    # explode_outer: for explode, the optimizer would add a filter on the array's size, and repeat all its steps there
    listed = kept_grams(whole.select("__row", "w"), "w", "__kept", span, k).select("__row", F.explode_outer(F.concat(*parts)).alias("e"))
    hits = listed.select("__row", "e.gram", "e.place", "e.n").join(grams, "gram")
    places = hits.groupBy("__row").agg(F.sort_array(F.collect_set(F.struct("n", "place"))).alias("places"))  # a text's own places
    places = _sent(written(places, "places", n_docs), broadcast_rows)

    # the runs around a kept K-gram start up to span - k words before it; a short run is its own only window
    def around(x: Column) -> Column:
        low = F.when(x["n"] == span, F.greatest(x["place"] - (span - k), F.lit(0))).otherwise(x["place"])
        high = F.when(x["n"] == span, F.least(x["place"], F.size("w") - span)).otherwise(x["place"])
        return F.transform(F.sequence(low, high), lambda at: F.struct(at.alias("at"), x["n"].alias("n")))

    starts = whole.select("__row", "w").join(places, "__row").select("__row", "w", F.array_distinct(F.flatten(F.transform("places", around))).alias("starts"))
    tried = starts.select("__row", F.explode_outer(F.transform("starts", lambda s: F.struct(s["at"].alias("at"), (s["at"] + s["n"]).alias("end"), F.array_join(F.slice("w", s["at"] + 1, s["n"]), " ").alias("window")))).alias("r"))
    matched = tried.select("__row", "r.*").join(windows, "window", "left_semi").groupBy("__row").agg(F.sort_array(F.collect_set(F.struct("at", "end", "window"))).alias("spans"))
    matched = written(matched, "matched", n_docs)
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(x["end"] - F.greatest(x["at"], acc["end"]), F.lit(0))).alias("n"), F.greatest(acc["end"], x["end"]).alias("end")),
        lambda acc: acc["n"],
    )
    once = matched.select("__row", F.explode(F.array_distinct(F.transform("spans", lambda x: x["window"]))).alias("window")).withColumn("wid", F.xxhash64("window"))
    named = once.join(runs, ["wid", "window"]).groupBy("__row").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    found = _sent(written(matched.select("__row", covered.cast("bigint").alias("n_hit")).join(named, "__row"), "hits", n_docs), broadcast_rows)
    none = F.array().cast("array<string>")
    result = whole.select("__row", "doc_id", F.col("n_words").cast("bigint")).join(found, "__row", "left")
    return result.select("__row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce(F.size("item_ids"), F.lit(0)).cast("bigint").alias("n_items"), F.coalesce("item_ids", none).alias("item_ids"))


def _run_entry(entry, n: int):
    """From a run's 1-based start to its entry. (A function of one argument: a second would be the element's place.)"""
    return lambda i: entry(_run_key(F.col("w"), i, n), i - 1, F.lit(n))


def _run_key(array: Column, start: Column, n: int) -> Column:
    """Hash of n words from 1-based `start`, apart from the K-grams' hashes by its low bits."""
    return F.xxhash64(F.lit(n), F.array_join(F.slice(array, start, n), " ")).bitwiseOR(F.lit(1))


def report(found: DataFrame) -> DataFrame:
    """doc_id, counts, and a digest of the items."""
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
