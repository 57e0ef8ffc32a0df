"""Near-duplicates of the pipeline against brute force over all pairs of shingle sets."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

def brute_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

def brute_kept(docs):
    sets = [brute_set(t) for _, t in docs]
    label = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or a and 5 * len(a & b) >= 4 * len(a | b):
                label = [label[j] if x == label[i] else x for x in label]
    best = {}
    for x, (i, _) in zip(label, docs):
        best[x] = min(best.get(x, i), i)
    return sorted(best.values())

def edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"x{rng.random()}"
    return " ".join(words)

def test_near_duplicates_stage_is_that_of_brute_force(spark, monkeypatch):
    rng, docs = random.Random(3), []
    for group in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 120, 300]))]
        docs += [" ".join(words)] + [edited(rng, words, max(1, round(len(words) * rng.choice([0.01, 0.018, 0.022, 0.04])))) for _ in range(6)]
    shared = [f"v{i}" for i in range(200)]
    docs += [edited(rng, shared, rng.choice([1, 3, 5])) for _ in range(60)]  # most are near some others only
    docs += ["", None, " \n", "one two", "ONE  two", "one three"]
    rows = [(i, t) for i, t in enumerate(rng.sample(docs, len(docs)))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute_kept(rows)
    stage = corpus_pipeline.near_duplicates_stage
    assert sorted(r["doc_id"] for r in stage(spark, frame, "").collect()) == want
    assert stage(spark, frame.limit(0), "").count() == 0
    from loomwork.llm import similar

    monkeypatch.setattr(similar, "ROUNDS", 0)  # all that the fingerprints leave is compared by least hashes, in parts
    monkeypatch.setattr(similar, "PART", 9)
    assert sorted(r["doc_id"] for r in stage(spark, frame, "").collect()) == want

def test_each_round_joins_a_row_a_class_and_only_open_buckets(spark, monkeypatch):
    from loomwork.llm import similar

    rng, docs = random.Random(4), []
    for group in range(6):
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        docs += [" ".join(words)] + [edited(rng, words, 1) for _ in range(8)] + [edited(rng, words, 4) for _ in range(8)]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    tables, own = [], similar.written
    monkeypatch.setattr(similar, "written", lambda df, name, rows=None: tables.append((name, own(df, name, rows))) or tables[-1][1])
    kept = corpus_pipeline.near_duplicates_stage(spark, frame, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == brute_kept(list(enumerate(docs)))
    rooted = [t for name, t in tables if name == "rooted"]
    opened = [t for name, t in tables if name == "open"]
    members = next(t for name, t in tables if name == "members")
    assert rooted and len(rooted) == len(opened)
    for before, after in zip([members, *opened], rooted):  # a round starts from what the last one left
        assert sorted(map(tuple, before.select("band", "key", "c").collect())) == sorted(map(tuple, after.select("band", "key", "c").collect()))

def test_the_driver_rests_between_rounds(spark, monkeypatch):
    from loomwork.llm import similar

    rng, rested = random.Random(5), []
    own = similar.rested
    monkeypatch.setattr(similar, "rested", lambda s: rested.append(s) or own(s))
    words = [f"w{rng.randrange(3000)}" for _ in range(120)]
    docs = [(i, edited(rng, words, rng.randrange(4))) for i in range(30)]
    kept = similar.survivors(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == brute_kept(docs) and len(rested) >= 2

def test_shuffle_files_go_with_the_table_that_they_were_made_for(spark):
    import time

    from loomwork import storage

    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = blocks.getAllFiles()
        names = [found.apply(i).getName() for i in range(found.size())]
        return {x for x in names if x.startswith("shuffle_")}

    before, setting = files(), spark.conf.get(storage.FREED, None)
    rows = spark.range(20_000).selectExpr("id % 1000 AS k", "id").repartition(3, "k")
    held = [rows, storage.written(rows, "dealt")]
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before and held[1].count() == 20_000
    assert spark.conf.get(storage.FREED, None) == setting

def test_sets_go_only_to_members_that_a_likely_pair_has(spark, monkeypatch):
    from loomwork.llm import similar

    rng, docs = random.Random(6), []
    shared = [f"v{i}" for i in range(60)]
    docs += [" ".join([*shared, *(f"a{rng.random()}" for _ in range(80))]) for _ in range(120)]  # share buckets, but are little alike
    words = [f"w{i}" for i in range(140)]
    docs += [edited(rng, words, rng.randrange(4)) for _ in range(12)]
    rows = list(enumerate(docs))
    tables, own = [], similar.written
    monkeypatch.setattr(similar, "written", lambda df, name, rows=None: tables.append((name, own(df, name, rows))) or tables[-1][1])
    monkeypatch.setattr(similar, "ROUNDS", 0)
    monkeypatch.setattr(similar, "PART", 50)
    kept = similar.survivors(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == brute_kept(rows)
    count = {name: t.select("c").distinct().count() for name, t in tables if name in ("open", "likely")}
    assert count["open"] >= 60 and 2 <= count["likely"] <= 12
