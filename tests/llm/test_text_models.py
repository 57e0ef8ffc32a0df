"""Language, quality, toxicity and language-model scores: exactness where there is some, held-out accuracy elsewhere."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import langid, lm, queries, quality, toxicity
from loomwork.llm.common import labelled_sample, remainder

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "12 !? 34"), (5, "word " * 30_000), (6, "x" * 200_000), (7, "日本語 text 🙂"), (7, "日本語 text 🙂"), (None, "no id")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, columns whose names clash with results."""
    return spark.createDataFrame(ODD, "doc_id bigint, text string").withColumns({c: F.lit("own") for c in ("score", "lang_pred", "lang", "fp", "ids", "t", "k")})


# --- prediction by partial matching


def brute_bits(streams: dict[str, bytes], order: int, text: bytes, language: str) -> float:
    """Code length from plain dictionaries."""
    counts: dict[bytes, Counter] = {}
    data = streams[language]
    for k in range(order + 1):
        for i in range(k, len(data)):
            counts.setdefault(data[i - k : i], Counter())[data[i]] += 1
    padded, bits = b"\n" * order + text.lower(), 0.0
    for i in range(order, len(padded)):
        for k in range(order, -2, -1):
            if k < 0:
                bits += 8
                break
            seen = counts.get(padded[i - k : i])
            if seen is None:
                continue
            whole = sum(seen.values()) + len(seen)
            if padded[i] in seen:
                bits += math.log2(whole / seen[padded[i]])
                break
            bits += math.log2(whole / len(seen))
    return bits


def test_code_lengths_are_exact(monkeypatch):
    texts = {"a": [b"the cat sat on the mat", b"a cat"], "b": [b"le chat est la", b"un chat \xc3\xa9"]}
    model = langid.learn(texts, 2)
    streams = {k: b"".join(b"\n\n" + x for x in v) for k, v in texts.items()}
    asked = [b"the chat", b"zzz", b"Un Cat \xff\x00", b"t"]
    exact = np.array([[brute_bits(streams, 2, x, k) for k in ("a", "b")] for x in asked])
    assert np.allclose(langid.code_lengths(model, asked), exact, rtol=1e-5)
    monkeypatch.setattr(langid, "BLOCK", 3)
    assert np.allclose(langid.code_lengths(model, asked), exact, rtol=1e-5)


def test_gram_table_finds_all_and_nothing_else():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 40, 5000).astype(np.uint64))
    table = langid.GramTable(keys, np.zeros((len(keys), 1)))
    assert (table.find(keys) == np.arange(len(keys))).all()
    assert (table.find(keys + np.uint64(1 << 41)) == -1).all()


def test_language(spark, odd):
    rows = [r.asDict() for r in queries.op1_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()]
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    found = langid.predict(odd, model).select("doc_id", "language.*").collect()
    assert len(found) == len(ODD) and all(0 <= r["score"] <= 1 for r in found)
    assert {r["doc_id"]: r["lang_pred"] for r in found if r["doc_id"] in (1, 2, 3, 4)} == dict.fromkeys((1, 2, 3, 4), "und")
    assert langid.predict(odd.limit(0), model).count() == 0
    nothing = langid.fit(odd.limit(0))
    assert {r[0] for r in langid.predict(odd, nothing).select("language.lang_pred").collect()} == {"und"}


# --- quality


def test_quality_gradients():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 110, n).tolist()) for n in (5, 300, 700, 2000)]
    model = quality.train(texts, [0, 1, 0, 1], passes=1)
    p = {k: v.astype(np.float64) for k, v in model.p.items()}
    y, w = np.array([0.0, 1, 0, 1]), np.ones(4)

    def loss(p):
        z = quality.logits(p, texts)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    g = quality._gradients(p, texts, y, w)
    for name in ("F", "E", "H", "w", "f"):
        flat = np.argmax(np.abs(g[name]))
        for sign in (1e-3,):
            a, b = ({k: v.copy() for k, v in p.items()} for _ in range(2))
            a[name].flat[flat] += sign
            b[name].flat[flat] -= sign
            assert math.isclose((loss(a) - loss(b)) / (2 * sign), g[name].flat[flat], rel_tol=0.15, abs_tol=2e-4), name


def test_quality_is_the_same_alone_and_together():
    texts = [b"", b"abc", b"word " * 500, b"LOUD!! " * 90, b"x" * 128, b"y" * 120, b"z" * 121]
    model = quality.train(texts * 3, [0, 1, 1, 0, 1, 0, 1] * 3, passes=2)
    together = quality.scores(model, texts)
    assert np.allclose(together, [quality.scores(model, [x])[0] for x in texts], atol=1e-6)


def test_quality(spark, odd):
    rows = queries.op3_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality"), "doc_id").where("held_out").collect()
    good = [r["predicted"] == 1 for r in rows if r["quality"] == 1]
    bad = [r["predicted"] == 0 for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) > 0.6
    for labels, constant in (([], 0.5), ([1, 1], 1.0)):
        model = quality.train([b"a"] * len(labels), labels)
        assert {r[0] for r in quality.score(odd, model, to="q").select("q").collect()} == {constant}
    model = quality.train([b"a b", b"A!! B!!"] * 4, [1, 0] * 4, passes=1)
    found = [r["q"] for r in quality.score(odd, model, to="q").select("q").collect()]
    assert len(found) == len(ODD) and all(0 <= x <= 1 for x in found)
    assert quality.score(odd.limit(0), model, to="q").count() == 0


# --- toxicity


def test_windows_cover_everything():
    for n in (0, 1, 47, 48, 49, 84, 85, 500):
        starts = toxicity.windows_of(n)
        covered = set().union(*(range(s, min(n, s + toxicity.WINDOW)) for s in starts))
        assert covered == set(range(n)) and all(b - a <= toxicity.STEP for a, b in zip(starts, starts[1:]))


def test_toxicity_gradients():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in toxicity._start(rng).items()}
    sizes = np.array([5, 3, 1])
    at = rng.integers(0, 7, (5, 3))
    x, y = rng.standard_normal((7, toxicity.VECTOR)), np.array([1.0, 0, 1])

    def run(p, x, keep=False):
        tables = toxicity.Words(toxicity.Model(p)).projected(x).astype(np.float64)
        return toxicity._run(p, lambda d, t: tables[d][:, at[t]], sizes, keep)

    def loss(p, x):
        z = run(p, x)
        return float((np.logaddexp(0, z) - y * z).sum())

    logit, kept = run(p, x, True)
    g, d_in = toxicity._back(p, kept, (toxicity._sigmoid(logit) - y).astype(np.float32), at, 7)
    g["b"] = d_in.sum(axis=1)
    for name in ("U", "A", "v", "w", "b"):
        flat = int(np.argmax(np.abs(g[name])))
        a, b = ({k: v.copy() for k, v in p.items()} for _ in range(2))
        a[name].flat[flat] += 1e-2
        b[name].flat[flat] -= 1e-2
        assert math.isclose((loss(a, x) - loss(b, x)) / 2e-2, g[name].flat[flat], rel_tol=0.05, abs_tol=1e-3), name


def test_toxicity_finds_planted_words(spark, odd):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(300)]
    make = lambda bad: " ".join([*rng.choice(words, 150), *(["vilewort"] * bad), *rng.choice(words, 90)]).encode()
    texts, labels = [make(i % 2) for i in range(300)], [i % 2 for i in range(300)]
    model = toxicity.train(texts, labels)
    fresh = [make(i % 2) for i in range(60)]
    found = toxicity.scores(model, toxicity.Words(model), fresh) >= 0.5
    assert np.mean(found == [i % 2 == 1 for i in range(60)]) > 0.95
    alone = [toxicity.scores(model, toxicity.Words(model), [x])[0] for x in fresh[:6]]
    assert np.allclose(alone, toxicity.scores(model, toxicity.Words(model), fresh[:6]), atol=1e-5)
    rows = [r["q"] for r in toxicity.score(odd, model, to="q").select("q").collect()]
    assert len(rows) == len(ODD) and all(0 <= x <= 1 for x in rows)
    assert toxicity.score(odd.limit(0), model, to="q").count() == 0
    assert {r[0] for r in toxicity.score(odd, toxicity.train([], []), to="q").select("q").collect()} == {0.0}


def test_labelled_sample_is_bounded_and_null_safe(spark):
    docs = spark.createDataFrame([(i, "t" * (i % 50)) for i in range(100)] + [(None, "x"), (5, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(90)] + [(None, 1), (3, None), (4, 0)], "doc_id bigint, toxic int")
    texts, ys = labelled_sample(docs, labels, "toxic", 10, 40)
    assert len(texts) == len(ys) <= 20 and all(len(x) <= 40 for x in texts) and set(ys) == {0, 1}
    assert labelled_sample(docs, labels.limit(0), "toxic", 10, 40) == ([], [])


# --- language model


def test_lm_base_counts_and_both_ways(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300").select("doc_id", "text").unionByName(spark.createDataFrame([(900001, None), (900002, ""), (900003, "Neverseen neverseen the")], "doc_id bigint, text string"))
    train = docs.where(remainder("doc_id", 10) != 0)
    model, counts = lm.fit(train)
    assert model.words is not None
    found = {r["doc_id"]: r["lm"] for r in lm.score(docs, model, counts).collect()}
    texts = {r["doc_id"]: lm.tokens_of((r["text"] or "").encode()) for r in docs.collect()}
    c = Counter(w for i, ws in texts.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(c.values()), len(c)
    assert (model.n, model.v) == (n, v)
    for i, ws in texts.items():
        assert found[i]["n_tokens"] == len(ws) and found[i]["n_known"] == sum(c[w] > 0 for w in ws)
        assert math.isclose(found[i]["base_score"], sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9, abs_tol=1e-9)
    held = [i for i in texts if zlib.crc32(str(i).encode()) % 10 == 0]
    assert sum(found[i]["score"] for i in held) > sum(found[i]["base_score"] for i in held)
    model.words = None  # the way for vocabularies too large to send
    other = {r["doc_id"]: r["lm"] for r in lm.score(docs.withColumn("c", F.lit(1)).drop("c"), model, counts).collect()}
    for i in texts:
        assert found[i]["n_known"] == other[i]["n_known"] and math.isclose(found[i]["score"], other[i]["score"], rel_tol=1e-6) and math.isclose(found[i]["base_score"], other[i]["base_score"], rel_tol=1e-9)


def test_word_counts_compare_words():
    import pyarrow as pa
    import xxhash

    words = [f"w{i}".encode() * (1 + i % 4) for i in range(500)]
    h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    h[3], h[4] = h[5], xxhash.xxh64_intdigest(b"other")  # two words of one hash, and a hash that isn't its word's
    held = lm.WordCounts(h, pa.array(words, pa.binary()), np.arange(1, 501))
    found = held.of([*words, b"other", b"never", b"w"])
    assert found[5] == 6 and found[[4, 500, 501, 502]].tolist() == [0, 0, 0, 0]
    assert [int(x) for i, x in enumerate(found[:500]) if i not in (3, 4)] == [i + 1 for i in range(500) if i not in (3, 4)]
    assert held.of([]).tolist() == []


def test_lm_probabilities_add_up():
    rng = np.random.default_rng(3)
    unigram = rng.random(20) + 0.1
    p = lm._start(20, unigram / unigram.sum())
    model = lm.Model({}, p, np.zeros(0), 1, 1)
    context = np.array([3, 7, 1])
    total = sum(10 ** lm.class_scores(model, np.append(context, k), np.array([4]))[3] for k in range(20))
    assert math.isclose(total, 1, rel_tol=1e-5)


def test_lm_without_training_texts(spark, odd):
    model, counts = lm.fit(odd.limit(0))
    found = lm.score(odd, model, counts).select("doc_id", "lm.*").collect()
    assert len(found) == len(ODD) and all(r["score"] == r["base_score"] and r["n_known"] == 0 for r in found)
    model, counts = lm.fit(odd)
    assert lm.score(odd.limit(0), model, counts).count() == 0


def test_lm_predicts_frequent_words_themselves(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 37 + j) % 900}" for j in range(60))) for i in range(300)], "doc_id bigint, text string")
    model, _ = lm.fit(docs)
    assert len(model.frequent) >= 1 + 384 and len(model.share) >= 256


def test_lm_learns_from_every_token(spark):
    """Texts of six tokens: with a stride of six only their first words would be targets."""
    rng = np.random.default_rng(4)
    lines = ["one two three four five", "six seven eight nine ten"]
    docs = spark.createDataFrame([(i, lines[rng.integers(2)]) for i in range(6000)], "doc_id bigint, text string").coalesce(1)
    model, counts = lm.fit(docs)
    found = lm.score(docs, model, counts).agg(F.sum("lm.score"), F.sum("lm.base_score")).first()
    assert found[0] > 0.5 * found[1]


def test_toxicity_reads_all_of_a_long_run():
    rng = np.random.default_rng(5)
    signs = [chr(c) for c in range(0x4E00, 0x4E00 + 200)]
    text = "".join(rng.choice(signs, 300)).encode()
    parts = toxicity.words_of(b"a " + text + b" b")
    assert parts[0] == b"a" and parts[-1] == b"b" and all(len(x) <= toxicity.LONGEST for x in parts)
    assert all(any(text[i : i + 5] in x for x in parts) for i in range(len(text) - 4))
    grams, first = toxicity._gram_rows([b"x" * 60])
    assert len(grams) == 60 + 59 + 58 and first.tolist() == [0]
    make = lambda bad: "".join([*rng.choice(signs, 40), *("悪口雑言罵倒" * bad), *rng.choice(signs, 20)]).encode()
    labels = [i % 2 for i in range(300)]
    model = toxicity.train([make(x) for x in labels], labels)
    found = toxicity.scores(model, toxicity.Words(model), [make(i % 2) for i in range(60)]) >= 0.5
    assert np.mean(found == [i % 2 == 1 for i in range(60)]) > 0.9


def test_toxicity_training_gives_its_memory_back(monkeypatch):
    held, given, own = [], [], toxicity.Words.projected
    monkeypatch.setattr(toxicity.Words, "projected", lambda self, x: held.append((len(x), self.tables.size)) or own(self, x))
    texts = [f"word{i} and word{i % 7} {'bad' if i % 2 else 'good'}".encode() for i in range(40)]
    monkeypatch.setattr(toxicity, "labelled_sample", lambda *a: (texts, [i % 2 for i in range(40)]))
    monkeypatch.setattr(toxicity, "tidy", lambda: given.append(1))
    model = toxicity.fit(None, None)
    assert model.constant is None and given
    assert {size for n, size in held if n == max(held)[0]} == {0}  # no table of all words stands beside the next one


def test_words_are_counted_without_a_list_of_each(spark, monkeypatch):
    from collections import Counter

    from loomwork.llm import lm

    texts = [" A b\tb\nc ", None, "", "b \x0b\x0c z", "café CAFÉ"] + [f"w{i} w{i % 3}" for i in range(50)]
    want = Counter(w for x in texts for w in lm.tokens_of((x or "").encode()))
    frame = spark.createDataFrame([(x,) for x in texts], "text string").coalesce(1)
    for counted in (lm.COUNTED, 4):  # the second gives what it has added up again and again
        monkeypatch.setattr(lm, "COUNTED", counted)
        assert {bytes(r["word"]): r["c"] for r in lm.count_words(frame).collect()} == want
    assert lm.count_words(frame.limit(0)).count() == 0


def test_words_lie_in_files_and_not_with_the_driver(spark, monkeypatch):
    """The model that the driver holds and sends has no list of all words; looked up in any number of files, each has
    its count."""
    import pickle

    texts = [" ".join(f"w{(i * 7919 + j * j) % 30_000}ü" for j in range(400)) + " É\xa0x" * (i % 3) for i in range(500)] + [None, ""]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id bigint, text string")
    want = Counter(w for x in texts for w in lm.tokens_of((x or "").encode()))
    asked = [*want, b"never", "ü".encode()]
    for most in (lm.FILE_WORDS, 3_000):
        monkeypatch.setattr(lm, "FILE_WORDS", most)
        model, _ = lm.fit(docs)
        sent = pickle.dumps(model)
        assert len(sent) < 8 * len(want) and model.v == len(want) > 25_000  # the words' bytes and counts alone are more
        words = pickle.loads(sent).words
        assert words.of(asked).tolist() == [want[w] for w in asked] and words.of([]).tolist() == []
        assert (len(words.names) == 1) == (most > model.v)
