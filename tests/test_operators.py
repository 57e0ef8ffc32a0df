"""Small cases with known results."""

import gzip
import io
import math
import struct
import tarfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwork.functions import scalar
from loomwork.operators import catalog, cluster, evaluate, graph, joins, sequence, text, vectors
from loomwork.sources import collections as binary
from loomwork.sources import files, maps


def values(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_asof_strict_and_inclusive(spark):
    left = spark.createDataFrame([(1, 5), (1, 8)], "k int, t int")
    right = spark.createDataFrame([(1, 5, "a"), (1, 6, "b")], "k int, t int, v string")
    assert values(joins.asof(left, right, ["k"], "t", ["v"], strict=True), "t") == [(1, 5, None), (1, 8, "b")]
    assert values(joins.asof(left, right, ["k"], "t", ["v"]), "t") == [(1, 5, "a"), (1, 8, "b")]


def test_require_fails_where_a_key_is_missing(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 9)], "k int, v int")
    with pytest.raises(Exception, match="no row for"):
        joins.require(left, right, ["k"]).collect()
    assert values(joins.require(left.where("k = 1"), right, ["k"]), "k") == [(1, 9)]


def test_average_rank_and_clip(spark):
    rows = spark.createDataFrame([("a", 10, 1), ("a", 10, 2), ("a", 20, 3), ("b", 5, 4)], "g string, v int, i int")
    assert [r[0] for r in rows.select(scalar.average_rank(["g"], F.col("v")).alias("r"), "i").orderBy("i").collect()] == [1.5, 1.5, 3.0, 1.0]
    one = spark.sql("select cast(null as double) a, 7d b, double('nan') c")
    assert tuple(one.select(scalar.clip(F.col("a"), 0.0, 5.0), scalar.clip(F.col("b"), 0.0, 5.0), scalar.is_finite(F.col("b")), scalar.is_finite(F.col("c")), scalar.is_finite(F.col("a"))).first()) == (None, 5.0, True, False, False)


def test_month_bounds(spark):
    low, high = scalar.month_bounds("2021-12", "2021-12")
    a, b = spark.range(1).select(low, high).first()
    assert (b - a) == 31 * 86400 * 10**6


def test_random_average_precision(spark):
    assert spark.range(1).select(scalar.random_average_precision(F.lit(1), F.lit(2))).first()[0] == 0.75


def test_onsets_and_bins(spark):
    rows = spark.createDataFrame([(1, 1000.0), (1, 1500.0), (1, 7000.0)], "k int, t double")
    assert [(r["ioi"], r["state"]) for r in sequence.onsets(rows, "k", "t", ["t"]).orderBy("t").collect()] == [(200.0, 0), (500.0, 1), (5000.0, 2)]
    spans = spark.createDataFrame([(i, True) for i in range(1, 7)] + [(9, False)], "n int, s boolean")
    assert [r[0] for r in spans.select(sequence.span_bin(F.col("n"), F.col("s")).alias("b"), "n").orderBy("n").collect()] == [0, 1, 2, 3, 4, 3, 0]
    for keys, slots in ((4, [3, 4, 6, 7]), (7, [2, 3, 4, 5, 6, 7, 8])):
        found = spark.range(keys).select(sequence.hand_slot(F.col("id"), keys).alias("s")).orderBy("s").collect()
        assert [r[0] for r in found] == slots


def test_grid_states_keep_the_largest(spark):
    rows = spark.createDataFrame([(1, 0, 1), (1, 0, 4), (1, 2, 3)], "k int, slot int, state int")
    packed = sequence.grid_states(rows, ["k"], F.col("slot"), F.col("state"), 11)
    assert packed.first()["packed"] == 4 + 3 * 25
    assert tuple(packed.select(*sequence.unpack(F.col("packed"), 3)).first()) == (4, 0, 3)


def test_timing_sections(spark):
    rows = spark.createDataFrame([(1, 0, 500.0), (1, 1000, -50.0)], "k int, t int, len double")
    found = sequence.timing_sections(rows, "k", "t", "len").orderBy("t").collect()
    assert [(r["bpm"], r["speed"], r["origin"]) for r in found] == [(120.0, 1.0, 0), (120.0, 2.0, 0)]


def test_upsert_changes_and_soft_delete(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c", 5), (3, "d", 6)], "id int, v string, extra int")
    assert values(catalog.upsert(old, new, ["id"]), "id") == [(1, "a", None), (2, "c", 5), (3, "d", 6)]
    assert values(catalog.changes(old, new, "id", "v"), "id") == [(1, "removed"), (2, "changed"), (3, "new")]
    marked = catalog.soft_delete(old.withColumn("deleted_at", F.lit(None).cast("string")), new, "id", F.lit("now"))
    assert [r["deleted_at"] for r in marked.orderBy("id").collect()] == ["now", None]
    with pytest.raises(ValueError, match="extra"):
        catalog.check_columns(old, ["id", "extra"])


def test_similar_groups_match_brute_force(spark):
    rng = np.random.default_rng(1)
    sets = {g: set(rng.choice(30, rng.integers(2, 9), replace=False).tolist()) for g in range(60)}
    edges = spark.createDataFrame([(g, i) for g, s in sets.items() for i in s], "g int, i int")
    exact = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.4}
    found = graph.similar_groups(edges, "g", "i", 0.4)
    assert {(r["a"], r["b"]) for r in found.collect()} == exact
    kept: list[int] = []
    for g in sorted(sets, key=lambda g: (-len(sets[g]), g)):
        if not any((min(g, k), max(g, k)) in exact for k in kept):
            kept.append(g)
    stay = graph.drop_similar(graph.group_sets(edges, "g", "i"), found)
    assert {r["g"] for r in stay.collect()} == set(kept)


def test_sampled_pairs_share_a_group(spark):
    edges = spark.createDataFrame([(g, i) for g in range(20) for i in range(g, g + 4)] + [(99, 1)], "g int, i int")
    member = {(r["g"], r["i"]) for r in edges.collect()}
    rows = graph.sample_pairs(edges, "g", "i", 3).collect()
    assert len(rows) == 3 * 23 and all(r["i"] != r["partner"] and (r["g"], r["partner"]) in member for r in rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, graph.sample_pairs(edges.repartition(7), "g", "i", 3).collect()))


def test_nearest_blocks_agree_with_sql(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, rng.standard_normal(8).round(1).tolist()) for i in range(90)], "vec_id bigint, embedding array<double>")
    found = {(r["query"], r["candidate"]): r["score"] for r in vectors.nearest(rows, rows, 5).collect()}
    v = np.array([r["embedding"] for r in rows.orderBy("vec_id").collect()])
    for q in range(90):
        s = (v * v[q]).sum(axis=1)
        best = sorted((-x, i) for i, x in enumerate(s) if i != q)[:5]
        assert {i for _, i in best} == {c for a, c in found if a == q} or math.isclose(-best[4][0], min(found[q, c] for a, c in found if a == q))


def test_near_copies_are_suppressed():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((4, 16))
    rows = [{"i": i, "embedding": base[i % 4] + rng.standard_normal(16) * 0.01} for i in range(12)]
    kept = vectors.distinct_results(rows, base[0], 10)
    assert len(kept) == 3 and {r["i"] % 4 for r in kept} == {1, 2, 3}


def test_bfloat16_halves_go_to_even():
    x = np.array([1.0, 1.00390625, 1.01171875, -2.5, 0.1], np.float32)
    back = vectors.from_bfloat16(vectors.bfloat16(x))
    assert back[0] == 1.0 and back[1] == 1.0 and back[2] == np.float32(1.015625) and back[3] == -2.5


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_osa_is_symmetric_and_bounded(a, b):
    d = text.osa(a, b, 9)
    assert d == text.osa(b, a, 9) and d <= max(len(a), len(b)) and (d == 0) == (a == b)
    assert text.osa(a, b, 1) == min(d, 2)


def test_text(spark):
    assert text.osa("abcd", "abdc", 2) == 1
    assert spark.createDataFrame([("Bööm!! Hello",)], "t string").select(text.tokens("t")).first()[0] == ["bom", "helo"]
    assert text.splits("abcdefgh") == [("abcd", "efgh")]
    docs = spark.createDataFrame([(1, "green tea"), (2, "green"), (3, "grean teapot"), (4, "")], "d int, t string")
    posts = text.postings(docs, "d", "t")
    hits = text.matched(posts, text.frequencies(posts), ["green", "tea"], 4)
    assert [r["doc_id"] for r in text.ranked(hits, ["green", "tea"], 5).collect()] == [1, 3]
    assert values(text.dictionary(spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "v string"), "v"), "code") == [("a", 0), ("b", 1)]


def test_clusters_find_separate_groups():
    rng = np.random.default_rng(4)
    v = np.concatenate([np.eye(8)[i] + 0.05 * rng.standard_normal((5 + i, 8)) for i in range(3)])
    own = cluster.clusters(v)
    assert (own == 0).all()  # twelve rows for a start
    v = np.concatenate([np.eye(8)[i] + 0.05 * rng.standard_normal((12 + i, 8)) for i in range(3)])
    own = cluster.clusters(v)
    assert [set(own[a:b]) for a, b in ((0, 12), (12, 25), (25, 39))] == [{2}, {1}, {0}]
    assert len(set(cluster.clusters(np.concatenate([v, -np.eye(8)[:2]])))) == 3  # clusters of fewer than three go


def test_large_groups_are_clustered_like_small_ones(spark):
    rng = np.random.default_rng(14)
    v = rng.standard_normal((150, 6))
    rows = spark.createDataFrame([("a" if i < 100 else "b", i, v[i].tolist()) for i in range(150)] + [("a", 900, None)], "g string, k int, v array<double>").repartition(5)
    small = sorted(map(tuple, cluster.cluster_groups(rows, "g", "k", "v").collect()))
    assert small == sorted(map(tuple, cluster.cluster_groups(rows, "g", "k", "v", held_rows=60).collect())) and len(small) == 150


def test_play_groups(spark):
    rng = np.random.default_rng(15)
    vectors_ = spark.createDataFrame([(i, (np.eye(4)[i % 2] + 0.05 * rng.standard_normal(4)).tolist()) for i in range(60)], "key int, v array<double>")
    rows = [(1, i, ["NC", "HD"] if i % 2 else ["HR"], i) for i in range(48)] + [(1, 5, ["DT"], 99), (1, 7, [], 50), (1, 900, ["HD"], 3), (2, 1, [], 0)]
    groups, missing = cluster.play_groups(spark.createDataFrame(rows, "owner int, key int, mods array<string>, place int"), vectors_)
    found = {(r["owner"], r["name"]): (sorted(r["keys"]), r["rank"]) for r in groups.collect()}
    assert found == {(1, "hddt"): (list(range(1, 48, 2)), 2), (1, "hr"): (sorted([*range(0, 48, 2), 7]), 1), (2, "nm"): ([1], 1)} and [tuple(r) for r in missing.collect()] == [(1, 900)]


def test_label_head_matches_numpy(spark):
    rng = np.random.default_rng(16)
    x = rng.standard_normal((50, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.c_[x[:, 0] > 0, x[:, 1] > 0].astype(float)
    rows = spark.createDataFrame([(x[i].tolist(), bool(y[i, 0]), bool(y[i, 1])) for i in range(50)], "v array<double>, a boolean, b boolean").repartition(3)
    head = cluster.label_head(rows, "v", ["a", "b"], least=5)
    z, t = x - x.mean(axis=0), y / y.sum(axis=0) ** 0.25
    w = np.linalg.solve(z.T @ z + np.eye(4), z.T @ (t - t.mean(axis=0)))
    assert np.allclose(head.weight, w) and np.allclose(head.bias, -(x @ w).mean(axis=0))
    for r in rows.select("v", head.name("v").alias("name")).collect():
        assert r["name"] == ["a", "b"][int((np.array(r["v"]) @ w + head.bias).argmax())]
    with pytest.raises(ValueError, match="too few"):
        cluster.label_head(rows, "v", ["a", "b"], least=40)


def test_disjoint_batches(spark):
    pairs = spark.createDataFrame([(i % 20, 100 + i % 33) for i in range(400)], "a int, b int")
    rows = graph.disjoint_batches(pairs, "a", "b", 8).collect()
    by = {}
    for r in rows:
        by.setdefault((r["round"], r["part"], r["batch"]), []).extend([r["a"], r["b"]])
    assert rows and all(len(x) == len(set(x)) and 4 <= len(x) <= 16 for x in by.values()) and len({(r["a"], r["b"]) for r in rows}) == len(rows)


def test_vectors_must_be_whole(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (4, [None, 1.0])], "vec_id int, embedding array<double>")
    assert sorted((r["query"], r["candidate"]) for r in vectors.nearest(rows, rows, 5).collect()) == [(1, 3), (3, 1)]
    with pytest.raises(ValueError, match="components"):
        vectors.nearest(rows, rows.where("vec_id = 1").unionByName(spark.createDataFrame([(9, [1.0])], rows.schema)), 5)
    assert [round(x, 6) for x in rows.where("vec_id = 3").select(vectors.linear("embedding", [[1.0, 0.0], [3.0, 4.0]])).first()[0]] == [0.6, 0.8]


def test_words_that_a_search_keeps(spark):
    assert text.kept_words({0b111: 2, 0b011: 5}, 3) == ({0, 1, 2}, 2)
    assert text.kept_words({0b011: 5, 0b100: 9, 0b110: 1}, 3) == ({0, 1}, 5)
    assert text.kept_words({0b001: 5}, 3) == (set(), 0)
    docs = spark.createDataFrame([(1, 1, 300.0, "Green Tea", "Bob", "x"), (2, 0, 900.0, "Green", "Tea Band", "y"), (3, 0, 1.0, "Grean Teapot", "z", "w"), (4, 0, 1.0, None, None, None)], "doc_id int, status int, stars double, title string, artist string, creator string")
    posts = text.postings(docs.withColumn("t", F.concat_ws(" ", "title", "artist", "creator")), "doc_id", "t")
    found = text.search(posts, text.frequencies(posts), docs, "green tea")
    assert [r["doc_id"] for r in found][:2] == [1, 2]
    assert [r["doc_id"] for r in text.search(posts, text.frequencies(posts), docs, "bbob grene")][0] == 1 and text.search(posts, text.frequencies(posts), docs, " !") == []
    assert text.strong("tea", ["teapot"]) == 0.7 and text.weak("teaopt", ["teapot"]) == 0.55


def test_caches_and_ledgers(spark):
    done = spark.createDataFrame([(1, 10, True), (2, 5, False), (3, 10, False)], "id int, size int, pruned boolean")
    wanted = spark.createDataFrame([(1, 40), (2, 5), (3, 40), (4, 1)], "id int, size int")
    assert sorted(map(tuple, catalog.uncached(wanted, done, "id", "size", 10).collect())) == [(4, 1)]
    assert sorted(r["id"] for r in catalog.uncached_whole(wanted, done, "id", "size", "pruned").collect()) == [1, 4]
    assert sorted(r["id"] for r in catalog.uncached_whole(wanted, done, "id", "size", "pruned", 10).collect()) == [4]
    old = spark.createDataFrame([(1, "a", 2)], "id int, reason string, tries int")
    new = spark.createDataFrame([(1, "b"), (2, "c")], "id int, reason string")
    assert sorted(map(tuple, catalog.failures(old, new).collect())) == [(1, "b", 3), (2, "c", 1)]
    assert evaluate.stratified_folds({"a": {"x": 4}, "b": {"x": 4}, "c": {"y": 2}, "d": {"y": 2}}, 2) == {"a": 0, "b": 1, "c": 0, "d": 1}


def test_ridge_folds_match_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((80, 4))
    y = x @ [1.0, -2, 0.5, 0] + 0.1 * rng.standard_normal(80)
    rows = spark.createDataFrame([(i % 4, x[i].tolist(), float(y[i])) for i in range(80)], "f int, v array<double>, y double")
    found = evaluate.out_of_fold_r2(rows, "v", "y", "f", 0.5)
    lost, ridge = 0.0, np.diag([0.5] * 4 + [0])
    c, fold = np.c_[x, np.ones(80)], np.arange(80) % 4
    for k in range(4):
        w = np.linalg.solve(c[fold != k].T @ c[fold != k] + ridge, c[fold != k].T @ y[fold != k])
        lost += ((y[fold == k] - c[fold == k] @ w) ** 2).sum()
    assert math.isclose(found, 1 - lost / ((y - y.mean()) ** 2).sum(), rel_tol=1e-9)


def test_pair_accuracy_counts_ties_half(spark):
    p = spark.createDataFrame([(1, 0.5)], "q int, s double")
    n = spark.createDataFrame([(1, 0.5), (1, 0.1)], "q int, s double")
    assert evaluate.pair_accuracy(p, n, "q", "s").first()["accuracy"] == 0.75


def test_resampling(spark):
    rows = spark.createDataFrame([(i, float(i % 7)) for i in range(300)], "k int, x double")
    mean, low, high = evaluate.bootstrap(rows, "x", "k", 500).first()
    assert (mean, low, high) == tuple(evaluate.bootstrap(rows.repartition(7), "x", "k", 500).first())
    assert low < mean < high and high - low < 1
    assert evaluate.sign_flip_test(rows.withColumn("x", F.col("x") - 3), "x", "k", 300).first()["p"] > 0.05
    assert evaluate.sign_flip_test(rows, "x", "k", 300).first()["p"] < 0.05
    assert evaluate.balanced_folds({"a": 5, "b": 4, "c": 3, "d": 2}, 2) == {"a": 0, "b": 1, "c": 1, "d": 0}


MAP = b"""osu file format v14
[General]
Mode: 0
[Metadata]
BeatmapID:77
[Difficulty]
SliderMultiplier:1
[TimingPoints]
0,500,4,2,0,60,1,1
1000,-50,4,2,0,60,0,0
[HitObjects]
100,100,0,5,0
0,0,1000,2,0,L|100:0,2,100
0,0,2000,2,0,B|100:0|100:0|100:100,1,200
256,192,3000,12,0,3500
0,0,9000,2,0,P|100:100|200:0,1,314.159
bad line
"""


def test_map_parser():
    found = maps.parse(MAP)
    assert found["map_id"] == 77 and found["error"] is None
    circle, line, corner, spinner, arc = found["objects"]
    assert circle["new_combo"] and circle["kiai"] and circle["bpm"] == 120.0
    assert line["end_time"] == 1000 + int(100 / 200 * 500 * 2) and line["repeats"] == 1 and (line["end_dx"], line["end_dy"]) == (100, 0)
    assert corner["hard_anchors"] == 1 and corner["anchors"] == 2 and np.allclose((corner["end_dx"], corner["end_dy"]), (100, 100))
    assert spinner["end_time"] == 3500 and spinner["kind"] == "spinner"
    assert np.allclose((arc["end_dx"], arc["end_dy"]), (200, 0), atol=0.5)
    assert maps.parse(b"[HitObjects]\n1,1,1,1,0")["error"] == "no id"
    assert maps.parse(MAP, modes=(3,))["error"] == "other mode"


def test_map_files(spark, tmp_path):
    import zstandard

    (tmp_path / "12.map").write_bytes(MAP.replace(b"100,100,0", b"9,9,0"))
    (tmp_path / "12.map.zst").write_bytes(zstandard.compress(MAP))
    (tmp_path / "13.map").write_bytes(b"nothing")
    found = maps.read(spark, str(tmp_path))
    assert maps.objects(found).where("kind = 'circle'").first()["x"] == 100
    assert [tuple(r) for r in maps.failures(found).collect()] == [(13, "no timing points")]


def _collections(version: str) -> bytes:
    text_ = lambda s: bytes([len(s)]) + s.encode()
    n = lambda x: struct.pack("<i", x)
    number, small = int(version.removeprefix("o!dm").removesuffix("min") or 1), version.endswith("min")
    entry = lambda i: n(i) + (n(1) if number >= 2 else b"") + (b"" if small else text_("a") * 3) + text_("h") + (text_("") if number >= 4 else b"") + (b"\0" if number >= 8 or number >= 5 and not small else b"") + (bytes(8) if number >= 8 or number >= 6 and not small else b"")
    body = bytes(8) + text_("me") + n(1) + text_("best") + (n(0) if number >= 7 else b"") + n(2) + entry(5) + entry(6) + (n(0) if number >= 3 else b"")
    return text_(version) + (gzip.compress(text_(version) + body) if number >= 7 else body)


@pytest.mark.parametrize("version", ["o!dm", "o!dm2", "o!dm3", "o!dm5", "o!dm6", "o!dm7", "o!dm8", "o!dm7min", "o!dm8min"])
def test_collection_files(version):
    assert binary.parse(_collections(version)) == [("best", [5, 6])]


def test_collection_reader(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(_collections("o!dm8"))
    (tmp_path / "b.bin").write_bytes(b"\x03abc")
    rows = binary.read(spark, str(tmp_path)).collect()
    assert sorted(r["item_id"] for r in rows if r["error"] is None) == [5, 6] and sum(r["error"] is not None for r in rows) == 1


def test_plain_files(spark, tmp_path):
    (tmp_path / "ids").write_text("5\nx\n\n7\n")
    assert values(files.read_ids(spark, str(tmp_path / "ids")), "id") == [(5,), (7,)]
    (tmp_path / "block.json").write_text('{"collections": {"a": [1, 2], "b": [3]}}')
    assert values(files.read_blocklist(spark, str(tmp_path / "block.json")), "id") == [("a", 1), ("a", 2), ("b", 3)]
    with tarfile.open(tmp_path / "x.tar.gz", "w:gz") as archive:
        for name, data in (("m/3.map", b"one"), ("m/4.map", b"two"), ("m/5.map", b"one")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))
    found = files.read_archives(spark, str(tmp_path), "*.tar.gz")
    assert values(found.select("id", "content"), "id") == [(3, b"one"), (4, b"two")]
    df = spark.createDataFrame([(1, float("nan")), (123, 2.0)], "id int, x double")
    files.write_csv(df, str(tmp_path / "csv"))
    assert files.read_csv(spark, str(tmp_path / "csv"), "id int, x double").count() == 2
    assert {r["json"] for r in files.to_json(df).collect()} == {'{"id":1}', '{"id":123,"x":2.0}'}
    files.write_sharded(df, str(tmp_path / "sharded"), "id")
    assert sorted(p.name for p in (tmp_path / "sharded").glob("shard=*")) == ["shard=01", "shard=23"]


def test_index_shards(spark, tmp_path):
    path = str(tmp_path / "index")
    files.write_shard(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), path, 0, "m")
    files.write_shard(spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), path, 1, "m")
    assert values(files.read_index(spark, path, "id", "m").select("id", "v"), "id") == [(1, "a"), (2, "c"), (3, "d")]
    with pytest.raises(ValueError, match="another model"):
        files.read_index(spark, path, "id", "other")


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 10


def _objects(spark, rows):
    """rows: time, kind and what differs from a plain circle."""
    plain = {"map_id": 1, "x": 0, "y": 0, "end_time": None, "new_combo": False, "hit_sound": 0, "bpm": 120.0, "end_bpm": 120.0, "anchors": 0, "hard_anchors": 0, "repeats": 0, "length": 0.0, "path_valid": False, "end_dx": 0.0, "end_dy": 0.0, "third_dx": 0.0, "third_dy": 0.0, "two_thirds_dx": 0.0, "two_thirds_dy": 0.0}
    out = []
    for i, (time, kind, more) in enumerate(rows):
        row = plain | {"time": time, "kind": kind, "object_index": i} | more
        row["end_time"] = row["end_time"] or time
        out.append(row)
    schema = "map_id bigint, object_index int, x int, y int, time bigint, end_time bigint, kind string, new_combo boolean, hit_sound int, bpm double, end_bpm double, anchors int, hard_anchors int, repeats int, length double, path_valid boolean, end_dx double, end_dy double, third_dx double, third_dy double, two_thirds_dx double, two_thirds_dy double"
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in out], schema)


def test_standard_and_catching_features(spark):
    from loomwork.operators import rulesets

    rows = [(0, "circle", {"x": 256}), (500, "slider", {"x": 256, "end_time": 1000, "repeats": 1, "path_valid": True, "end_dx": 100.0, "length": 50.0, "anchors": 3, "hard_anchors": 1}), (1500, "circle", {"x": 259, "y": 4}), (1600, "spinner", {"end_time": 2600}), (3000, "circle", {}), (9000, "circle", {"x": 512})]
    rows += [(9000 + 100 * i, "circle", {}) for i in range(1, 6)]
    objects = _objects(spark, rows)
    found = rulesets.standard(objects, None).orderBy("object_index").collect()
    assert [r["incoming_motion_valid"] for r in found[:6]] == [0, 1, 1, 1, 0, 2]
    assert math.isclose(found[2]["log_jump_distance"], math.log1p(5)) and math.isclose(found[2]["jump_direction_cos"], 0.6)
    assert found[1]["span_count_bin"] == 1 and found[1]["red_anchor_bin"] == 1 and math.isclose(found[1]["span_rhythm_cos"], 1.0)
    assert found[5]["norm_x"] == 1.0 and found[0]["norm_x"] == 0.0 and math.isclose(found[3]["log_spinner_duration_ms"], math.log1p(1000))
    caught = rulesets.catching(objects, None).orderBy("object_index").collect()
    assert [r["incoming_state"] for r in caught[:6]] == [0, 1, 1, 1, 0, 2] and caught[2]["movement_direction"] == 1.0
    rules = rulesets.RULESETS["standard"]
    assert len(rules.names) == 28 and len(set(rules.names)) == 28 and set(rules.names) <= set(found[0].asDict())
    assert [len(rulesets.RULESETS[n].names) for n in ("drums", "catching", "keys")] == [10, 16, 16]
    flipped = rules.augmented(rulesets.standard(objects, None), seed=1).orderBy("object_index").collect()
    assert abs(flipped[5]["norm_x"]) == 1.0
    vectors_ = rulesets.vectors("standard", objects, None, 4).first()
    assert len(vectors_["rows"]) == 4 and all(len(v) == 28 for v in vectors_["rows"])
    assert rulesets.standard(_objects(spark, rows[:5]), None).count() == 0


def test_drum_features(spark):
    from loomwork.operators import rulesets

    rows = [(0, "circle", {}), (100, "circle", {"hit_sound": 2}), (200, "circle", {"hit_sound": 12}), (300, "slider", {"end_time": 800, "hit_sound": 4}), (900, "spinner", {"end_time": 1900, "hit_sound": 4})] + [(2000 + i, "circle", {}) for i in range(6)]
    found = rulesets.drums(_objects(spark, rows), None).orderBy("object_index").collect()
    assert [r["note_type"] for r in found[:5]] == [0, 1, 1, 2, 3] and [r["is_big"] for r in found[:5]] == [0, 0, 1, 1, 0]
    assert math.isclose(found[3]["drumroll_rhythm_cos"], 1.0)


def test_key_states(spark):
    from loomwork.operators import rulesets

    at = lambda column: {"x": column * 128 + 64}  # noqa: E731  four keys
    rows = [(0, "circle", at(0)), (0, "hold", at(1) | {"end_time": 200}), (100, "circle", at(2)), (200, "circle", at(3)), (300, "circle", at(1))] + [(400 + 100 * i, "circle", at(0)) for i in range(6)]
    maps_ = spark.createDataFrame([(1, 4.0)], "map_id bigint, cs double")
    found = rulesets.keys(_objects(spark, rows), maps_).orderBy("time").collect()
    state = lambda r: (r["left_2"], r["left_1"], r["right_1"], r["right_2"])
    assert [state(r) for r in found[:4]] == [(1, 2, 0, 0), (0, 3, 1, 0), (0, 4, 0, 1), (0, 1, 0, 0)]
    assert all(r["center"] == 0 and r["key_count"] == 3 for r in found)
    assert len(rulesets.vectors("keys", _objects(spark, rows), maps_).first()["rows"]) == len(found)


def test_records(spark):
    from loomwork.sources import records

    rows = spark.createDataFrame([(1, "4", (7, "t")), (2, "x", (8, None))], "item int, state string, set struct<id:int,title:string>")
    mapping = records.Mapping({"id": "item", "status": "state", "stars": "'no number'"}, {"status": {"4": "loved"}})
    assert values(records.normalised(rows, mapping, "id bigint,status string,stars double,more int"), "id") == [(1, "loved", None, None), (2, None, None, None)]
    assert values(records.flattened(rows, "set"), "item")[0] == (1, "4", 7, "t")
    a = spark.createDataFrame([(1, None), (2, "a")], "id int, v string")
    b = spark.createDataFrame([(1, "b", 5), (3, "c", 6)], "id int, v string, w int")
    assert values(records.first_known([a, b], "id"), "id") == [(1, "b", 5), (2, "a", None), (3, "c", 6)]
    coded = records.group_codes(spark.createDataFrame([(0, "b"), (1, None), (2, "a")], "i int, g string"), "g", "code", "i")
    assert [r["code"] for r in coded.orderBy("i").collect()] == [1, -2, 0]


def test_requests(spark):
    from loomwork.plans.requests import SearchRequest, recommend, run

    rng = np.random.default_rng(6)
    rows = [(i, i % 8, (rng.standard_normal(6)).tolist(), 0.1 * (i % 3), float(i) if i % 5 else None, ["4", "loved", "0"][i % 3], None if i % 7 == 0 else i * 10**12) for i in range(60)]
    index = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>, density double, stars double, status string, released_us bigint")
    found = run(index, SearchRequest((1, 2, 2), 5))
    assert len(found) == 5 and [r["rank"] for r in found] == [1, 2, 3, 4, 5] and not {r["label"] for r in found} & {1, 2}
    near = run(index, SearchRequest((1,), 9, {"stars": (10, 50)}, status="loved", exclude_same_group=False, distinct=True), statuses={"loved": ["4", "loved"]})
    assert near and all(10 <= r["vec_id"] <= 50 and r["vec_id"] % 5 and r["vec_id"] % 3 != 2 for r in near)
    dated = run(index, SearchRequest((1,), 60, months=("1970-01", "1970-02")))
    assert dated and all(0 < r["vec_id"] <= 5 for r in dated)
    for bad in ({"sources": ()}, {"sources": (1,), "top_k": 0}, {"sources": (-1,)}):
        with pytest.raises(ValueError):
            SearchRequest(**bad)
    with pytest.raises(KeyError):
        run(index, SearchRequest((999,)))
    plays = spark.createDataFrame([(1, ["HD"]), (2, ["HD", "DT"]), (3, [])], "vec_id bigint, mods array<string>")
    drawn = recommend(index, plays, ["HD"], SearchRequest((1,), 10, exclude_same_group=False))
    assert len(drawn) == 5 and drawn == recommend(index, plays, ["HD"], SearchRequest((1,), 10, exclude_same_group=False)) and not {r["vec_id"] for r in drawn} & {1, 2, 3}


def test_multiclass_probe(spark):
    rng = np.random.default_rng(7)
    rows = [(i, i % 3, i % 4, (np.eye(3)[i % 3] * 3 + rng.standard_normal(3)).tolist()) for i in range(120)]
    found = evaluate.multiclass_probe(spark.createDataFrame(rows, "i int, y int, f int, v array<double>"), "v", "y", "f", least=20)
    assert found["classes"] == 3 and found["top5"] == 1 and found["accuracy"] > 0.85 and found["macro_recall"] > 0.85
