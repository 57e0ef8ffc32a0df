"""Text search: folding and tokens, postings, prefix, misspelt and compound terms, ranking."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

#: Runs of letters and digits, and of the scripts of Japanese, Chinese and Korean.
TOKEN = "[0-9a-z]+|[぀-ヿ]+|[一-鿿]+|[가-힯]+"
#: Fixed weights of the ranking.
EXACT, PREFIX, ONE_OFF, TWO_OFF, COMPOUND = 1.0, 0.75, 0.5, 0.32, 0.65


def folded(text: str | Column) -> Column:
    """Lower case, decomposed, without combining marks. Plain ASCII, most of the rows, never leaves the JVM's own
    functions but for the batch it is in."""

    @F.arrow_udf("string")
    def fold(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for value in batch:
                x = value.as_py()
                if x is None or x.isascii():
                    out.append(x)
                else:
                    out.append("".join(c for c in unicodedata.normalize("NFKD", x.lower()) if not unicodedata.combining(c)))
            yield pa.array(out, pa.string())

    return fold(F.lower(F.col(text) if isinstance(text, str) else text))


def squeezed(text: Column) -> Column:
    """A repeated ASCII letter or digit counts once."""
    return F.regexp_replace(text, r"([0-9a-z])\1+", "$1")


def tokens(text: str | Column, fold: bool = True) -> Column:
    """Tokens in order. fold=False takes text that is known to hold no marks, and stays in the JVM."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(squeezed(folded(c) if fold else F.lower(c)), F.lit(TOKEN), F.lit(0))


def postings(docs: DataFrame, doc_id: str, text: str, fold: bool = True) -> DataFrame:
    """term, doc_id: distinct. The long form of an inverted index; term_docs gathers it."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.array_distinct(tokens(text, fold))).alias("term"))


def frequencies(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def term_docs(posts: DataFrame) -> DataFrame:
    """A row per term with its documents in order. A term that most documents have makes a row as long as that: joins
    should use the long form."""
    return posts.groupBy("term").agg(F.sort_array(F.collect_set("doc_id")).alias("docs"), F.count(F.lit(1)).alias("df"))


def dictionary(rows: DataFrame, value: str) -> DataFrame:
    """Distinct values numbered from zero in order, without one task that sorts them all: values are dealt out by range
    and numbered within, after the numbers before."""
    parts = rows.select(F.col(value).alias("value")).where(F.col("value").isNotNull()).distinct().repartitionByRange("value").withColumn("p", F.spark_partition_id())
    numbered = parts.withColumn("i", F.row_number().over(Window.partitionBy("p").orderBy("value")) - 1)
    sizes = parts.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("p")) - F.col("n")).select("p", "before")  # a row a partition
    return numbered.join(F.broadcast(before), "p").select("value", (F.col("i") + F.col("before")).alias("code"))


def osa(a: str, b: str, most: int) -> int:
    """Optimal string alignment: insertions, deletions, substitutions and swaps of neighbours, each place once; most + 1
    where it is more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, two[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


def letter_mask(term: str | Column) -> Column:
    """A bit for each letter a-z and digit that occurs, 36 in all."""
    c = F.col(term) if isinstance(term, str) else term
    bits = F.lit(0).cast("bigint")
    for i, x in enumerate("abcdefghijklmnopqrstuvwxyz0123456789"):
        bits = bits.bitwiseOR(F.when(F.instr(c, x) > 0, F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return bits


def misspelt(terms: DataFrame, words: list[str], most: int = 2) -> DataFrame:
    """word, term, distance: terms within `most` edits of a word. Lengths and letter masks sort out nearly all terms
    (an edit changes two letters of a mask at most) before distances are computed."""

    @F.arrow_udf("int")
    def distance(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([osa(x, y, most) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())

    asked = F.explode(F.array(*[F.struct(F.lit(w).alias("word"), F.lit(len(w)).alias("size")) for w in words]))
    rows = terms.select("term", asked.alias("w")).select("term", "w.*")
    close = (F.abs(F.length("term") - F.col("size")) <= most) & (F.bit_count(letter_mask("term").bitwiseXOR(letter_mask("word"))) <= 2 * most)
    found = rows.where(close).withColumn("distance", distance("word", "term"))
    return found.where(F.col("distance") <= most).select("word", "term", "distance")


def with_prefix(terms: DataFrame, prefix: str, most: int = 64) -> DataFrame:
    """The first terms, in order, that begin with a prefix but are not it: a range of the sorted terms, which scans
    narrow down to."""
    return terms.where(F.col("term").startswith(prefix) & (F.col("term") != prefix)).orderBy("term").limit(most)


def splits(term: str, least: int = 4, shortest: int = 8, most: int = 6) -> list[tuple[str, str]]:
    """Ways to read a long word as two, the most even first."""
    if len(term) < shortest:
        return []
    places = sorted(range(least, len(term) - least + 1), key=lambda i: (abs(2 * i - len(term)), i))
    return [(term[:i], term[i:]) for i in places[:most]]


def matched(posts: DataFrame, frequency: DataFrame, words: list[str], n_docs: int, prefixes: bool = True, typos: bool = True, compounds: bool = True) -> DataFrame:
    """word, doc_id, weight: the best way in which a document has a word."""
    idf = F.log(F.lit(1.0) + F.lit(float(n_docs)) / F.col("df"))
    exact = frequency.where(F.col("term").isin(words)).select(F.col("term").alias("word"), "term", (F.lit(EXACT) * idf).alias("weight"))
    ways = exact
    if prefixes:
        for w in words:
            ways = ways.unionByName(with_prefix(frequency, w).select(F.lit(w).alias("word"), "term", (F.lit(PREFIX) * idf).alias("weight")))
    if typos:
        share = F.when(F.col("distance") == 1, ONE_OFF).otherwise(TWO_OFF)
        long = [w for w in words if len(w) >= 4]
        if long:
            near = misspelt(frequency, long, 2).where("distance > 0").join(frequency, "term")
            ways = ways.unionByName(near.select("word", "term", (share * F.log1p("df")).alias("weight")))
    compound = None
    for w in words:
        for left, right in splits(w) if compounds else []:
            pair = [posts.where(F.col("term") == x).select("doc_id") for x in (left, right)]
            both = pair[0].join(pair[1], "doc_id")
            hits = both.select(F.lit(w).alias("word"), "doc_id", F.lit(COMPOUND).alias("weight"))
            compound = hits if compound is None else compound.unionByName(hits)
    found = posts.join(F.broadcast(ways), "term").select("word", "doc_id", "weight")  # a bounded number of terms a word
    if compounds and any(splits(w) for w in words):
        found = found.unionByName(compound)
    return found.groupBy("word", "doc_id").agg(F.max("weight").alias("weight"))


def kept_words(counts: dict[int, int], n: int) -> tuple[set[int], int]:
    """Which of n words a search keeps, by number, and how many documents have them all. counts: documents by the set of
    words they have, as bits. Words that nothing has go first, if half of all remain; then, while no document has what is
    left and half of all words are, the word without which most documents do."""
    having = lambda words: sum(c for bits, c in counts.items() if all(bits >> w & 1 for w in words))
    words = {w for w in range(n) if having({w})}
    if not words or 2 * len(words) < n:
        return set(), 0
    found = having(words)
    while not found and len(words) > 1 and 2 * len(words) >= n:
        without = max(sorted(words), key=lambda w: having(words - {w}))
        found = having(words - {without})
        if not found:
            return set(), 0
        words = words - {without}
    return words, found


def ranked(hits: DataFrame, words: list[str], k: int | None = None, boost: DataFrame | None = None, minimum: int = 0) -> DataFrame:
    """doc_id, score: the documents that have all the words that `kept_words` keeps, best first, with a boost of their own."""
    bit = F.element_at(F.create_map(*[F.lit(x) for i, w in enumerate(words) for x in (w, 1 << i)]), F.col("word"))
    whole = hits.groupBy("doc_id").agg(F.bit_or(bit).alias("bits"), F.collect_list(F.struct("word", "weight")).alias("each"))  # an entry a word
    counts = {r["bits"]: r["n"] for r in whole.groupBy("bits").agg(F.count(F.lit(1)).alias("n")).collect()}  # 2 ** words rows at most
    kept, found = kept_words(counts, len(words))
    if found <= minimum:
        return whole.where(F.lit(False)).select("doc_id", F.lit(0.0).alias("score"))
    mask = sum(1 << w for w in kept)
    chosen = F.filter("each", lambda x: x["word"].isin([words[w] for w in kept]))
    score = F.aggregate(chosen, F.lit(0.0), lambda s, x: s + x["weight"])
    out = whole.where(F.col("bits").bitwiseAND(F.lit(mask)) == mask).select("doc_id", score.alias("score"))
    if boost is not None:
        out = out.join(boost, "doc_id", "left").withColumn("score", F.col("score") + F.coalesce("boost", F.lit(0.0))).drop("boost")
    return out if k is None else out.orderBy(F.desc("score"), "doc_id").limit(k)


#: Fixed values of field matches: weights of title, artist and creator, of hits by prefix and inside joined words, of one
#: and two misspellings, of a whole, leading and inner match of the joined query, and of popularity.
TITLE, ARTIST, CREATOR = 3.0, 2.0, 1.0
BY_PREFIX, INSIDE, MISSPELT = 0.7, 0.6, (0.0, 0.55, 0.35)
WHOLE, LEADING, INNER = 4.0, 2.5, 1.5
STATUS_BOOST, TEXT_BOOST, POPULARITY, MOST_POPULARITY = 0.5, 1.0, 0.05, 15.0
#: Documents whose strict hits a search is content with; words of a query; lengths of the lists that are ranked again, by
#: fields and by misspellings; hits up to which texts are looked through.
ENOUGH, MOST_WORDS, BY_FIELDS, BY_SPELLING, LOOKED_THROUGH = 10, 12, 300, 60, 5000


def fold_plain(text: str) -> str:
    """What `folded` and `squeezed` do, for one short text."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return re.sub(r"([0-9a-z])\1+", r"\1", plain)


def words_of(text: str | None) -> list[str]:
    return re.findall(TOKEN, fold_plain(text or ""))


def strong(word: str, field: list[str]) -> float:
    """1 for a word of a field, less for the beginning of one, or for five letters or more inside the joined field."""
    if word in field:
        return 1.0
    if len(word) > 1 and any(x.startswith(word) for x in field):
        return BY_PREFIX
    return INSIDE if len(word) > 4 and word in "".join(field) else 0.0


def weak(word: str, field: list[str]) -> float:
    """For a word that is misspelt, whole or as a beginning that at most four letters follow."""
    if len(word) < 3 or not re.fullmatch("[a-z0-9]+", word):
        return 0.0
    best = 0.0
    for x in field:
        near = osa(word, x, 2)
        if 0 < len(x) - len(word) <= 4 and x[0] == word[0]:
            near = min(near, osa(word, x[: len(word)], 2))
        if 0 < near <= 2:
            best = max(best, MISSPELT[near])
    return best


def field_order(rows: list[dict], words: list[str], k: int) -> list[dict]:
    """Of a bounded list of rows (score, stars, title, artist, creator) the k best, ranked again by what their fields have
    of the words, and the best of those by misspellings."""
    spaced, joined, out = " ".join(words), "".join(words), []
    for row in rows:
        fields = [words_of(row[f]) for f in ("title", "artist", "creator")]
        weights = (TITLE, ARTIST, CREATOR)
        by_field = sum(w * strong(x, f) for x in words for w, f in zip(weights, fields)) / len(words)
        title, every = "".join(fields[0]), "".join(fields[1] + fields[0] + fields[2])
        like = max((WHOLE if t == q else LEADING if t.startswith(q) else INNER if q in t else 0.0) for q, t in ((spaced, title), (joined, title), (joined, every)))
        stars = min((row["stars"] or 0.0) / 100, MOST_POPULARITY) * POPULARITY
        out.append((row["score"] + by_field + like + stars, fields, row))
    place = lambda x: (-x[0], -(x[2]["stars"] or 0.0), x[2]["doc_id"])
    best = []
    for score, fields, row in sorted(out, key=place)[:BY_SPELLING]:
        left = [x for x in words if not any(strong(x, f) for f in fields)]
        bonus = sum(w * weak(x, f) for x in left for w, f in zip((TITLE, ARTIST, CREATOR), fields)) / len(words)
        best.append((score + bonus, fields, row))
    return [row | {"score": score} for score, _, row in sorted(best, key=place)[:k]]


def search(posts: DataFrame, frequency: DataFrame, docs: DataFrame, query: str, k: int = 30) -> list[dict]:
    """A search as it is typed. docs: doc_id, status (above 0 for an approved one), stars, title, artist, creator. All words
    are looked for as they are and as beginnings; if fewer than ENOUGH documents have all, words of fewer hits also
    misspelt and as compounds, and words are dropped while none has all. The best BY_FIELDS are ranked again by fields."""
    words = list(dict.fromkeys(words_of(query)[:MOST_WORDS]))
    if not words:
        return []
    n = docs.count()
    hits = written(matched(posts, frequency, words, n, typos=False, compounds=False), "hits")
    found = written(all_words(hits, words), "strict")
    strict = found.count()
    if strict < ENOUGH:
        per = {r["word"]: r["n"] for r in hits.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
        few = [w for w in words if per.get(w, 0) < ENOUGH]
        if few:
            more = matched(posts, frequency, few, n).unionByName(hits).groupBy("word", "doc_id").agg(F.max("weight").alias("weight"))
            found = written(ranked(more, words, minimum=strict).unionByName(found).groupBy("doc_id").agg(F.max("score").alias("score")), "fuzzy")
    rows = found.join(docs, "doc_id").withColumn("score", F.col("score") + F.when(F.col("status") > 0, STATUS_BOOST).otherwise(0.0))
    if found.count() <= LOOKED_THROUGH and any(len(w) >= 4 for w in words):
        whole = squeezed(folded(F.concat_ws(" ", "artist", "title", "creator")))
        rows = rows.withColumn("score", F.col("score") + sum((F.contains(whole, F.lit(w)).cast("int") for w in words), F.lit(0)) * TEXT_BOOST)
    top = rows.orderBy(F.desc("score"), F.desc("stars"), "doc_id").limit(BY_FIELDS).collect()
    return field_order([r.asDict() for r in top], words, k)


def all_words(hits: DataFrame, words: list[str]) -> DataFrame:
    """doc_id, score of the documents that have every word."""
    per = hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("score"))
    return per.where(F.col("n") == len(words)).select("doc_id", "score")


def ids_in(text: str | Column, patterns: list[str]) -> Column:
    """The number that the first pattern to match finds."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(*[F.try_to_number(F.nullif(F.regexp_extract(c, p, 1), F.lit("")), F.lit("999999999999999999")).cast("bigint") for p in patterns])


def id_list(text: str | Column) -> Column:
    """Numbers separated by spaces, without what is no number."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.transform(F.split(F.trim(c), r"\s+"), lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())


def labels(text: str | Column, patterns: dict[str, str]) -> dict[str, Column]:
    """A boolean column for each pattern."""
    c = F.col(text) if isinstance(text, str) else text
    return {name: c.rlike(p) for name, p in patterns.items()}


def chunks_of_two(text: str | Column, alias: dict[str, str] | None = None) -> Column:
    """Pairs of letters in order, upper case, some under another name, each once."""
    c = F.upper(F.col(text) if isinstance(text, str) else text)
    pairs = F.regexp_extract_all(c, F.lit("[A-Z0-9]{2}"), F.lit(0))
    if alias:
        names = F.create_map(*[F.lit(x) for kv in alias.items() for x in kv])
        pairs = F.transform(pairs, lambda x: F.coalesce(F.element_at(names, x), x))
    return F.array_distinct(pairs)


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0
