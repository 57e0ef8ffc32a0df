"""Approximate nearest neighbours by a permutation index.

A vector is represented by its PREFIX nearest of a set of pivots, in order. It is posted, with that order, in the lists
of its POSTED nearest pivots; a query is sent to the lists of its PROBED nearest pivots only. There the list's vectors are
ranked by the footrule: for each shared pivot, PREFIX less the difference of its ranks, so that the largest sum has the
smallest footrule distance. The best SHARE of a list (LEAST rows at least) is reranked by inner product in double
precision, and of all its lists' best a query keeps the nearest `k`.

The lists are the unit of work: dealt out by pivot, and those of more than LIST_ROWS rows cut into parts by a hash, with
the queries sent to each part. The number of pivots follows the root of the number of vectors, so lists grow with the
root too, and a query meets a share of the vectors that falls as they become more. Equal vectors are one class with its
k + 1 smallest ids, found before anything is dealt out by pivot, so a vector that a third of the rows have is posted and
asked for once.

Nearness by inner product is turned into nearness by angle first: with the largest norm M, a vector gets one more
component, the root of M squared less its own norm squared, and a query gets zero there. Norms are of vectors divided by
the largest component, so none overflows; scores are of the vectors as they are, and one that isn't a number is last.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with a null id. A vector
that is shorter than others counts as filled up with zeros. Rows that repeat an id and its vector are rows of their own;
a query never finds rows of its own id. Ties go to the smaller id. An empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Vectors a pivot at least; pivots that are used if there are vectors enough, and at most; nearest pivots that represent
#: a vector, whose lists it is posted in, and whose lists a query is sent to.
ROWS_A_PIVOT, PIVOTS, MOST_PIVOTS, PREFIX, POSTED, PROBED = 20, 512, 16384, 112, 4, 80
#: The share of a list that is reranked, rows of it at least; rows of a list's part, about.
SHARE, LEAST, LIST_ROWS = 0.15, 48, 4096
#: Queries of a list computed together; rows of a task, about; rows that a task holds before it passes them on.
TOGETHER, TASK_ROWS, HELD = 128, 16384, 1 << 20


@dataclass
class Index:
    """pivots: a row each, with the added component and of length one; scale: the largest component; largest: the largest
    norm of vectors divided by it; size: components of a vector; ranked: the classes, a written table of c, least, ids,
    v, asks, ranks and, if it asks, its ranks as a query."""

    pivots: np.ndarray
    scale: float
    largest: float
    size: int
    prefix: int
    ranked: DataFrame


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and v, an array of doubles, of the rows that take part."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    inf = F.lit(float("inf"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < inf), F.lit(False))) & F.exists("v", lambda x: F.coalesce(x != 0, F.lit(False))))


def extended(v: np.ndarray, largest: float) -> np.ndarray:
    """With the component that makes all norms equal, divided by that norm."""
    rest = np.sqrt(np.maximum(largest**2 - (v * v).sum(axis=1), 0))
    return np.concatenate([v, rest[:, None]], axis=1) / largest


def prefixes(v: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each row in order, of equally near ones the first."""
    near = -(v @ pivots.T)
    if prefix < near.shape[1]:
        some = np.argpartition(near, prefix - 1, axis=1)[:, :prefix]
        some.sort(axis=1)
    else:
        some = np.tile(np.arange(near.shape[1]), (len(v), 1))
    order = np.argsort(np.take_along_axis(near, some, axis=1), axis=1, kind="stable")
    return np.take_along_axis(some, order, axis=1)


def classes_of(rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    """Of `usable` rows: least, ids (id and times of the k + 1 smallest ids), v, asks (whether a query has this vector).
    Ids and repeats are summed up where they lie, and a vector's ids are cut to k + 1 before they meet."""
    size = rows.agg(F.max(F.size("v"))).first()[0] or 0
    full = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(size) - F.size("v")))
    counted = rows.select("vec_id", full.alias("v"), is_query.alias("asks")).groupBy("v", "vec_id").agg(F.count(F.lit(1)).alias("n"), F.max("asks").alias("asks"))
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = counted.select("v", "vec_id", F.least("n", F.lit(k)).alias("n"), place.alias("place")).where(F.col("place") <= k + 1)
    named = few.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("vec_id", "n"))).alias("ids"))
    asked = counted.where("asks").select("v").distinct().withColumn("asks", F.lit(True))
    return named.join(asked, "v", "left").select(F.col("ids")[0]["vec_id"].alias("least"), "ids", "v", F.coalesce("asks", F.lit(False)).alias("asks"))


def fit(rows: DataFrame, is_query: Column, k: int = 20, pivots: int = PIVOTS, prefix: int = PREFIX) -> Index | None:
    """rows: as `usable` gives them. The pivots are distinct vectors of the least hashes, as many as the root of the
    number of vectors asks for, MOST_PIVOTS at most; every vector is ranked by them."""
    classes = written(classes_of(rows, is_query, k).withColumn("c", F.monotonically_increasing_id()), "classes")
    total = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("size"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("scale")).first()
    if not total["n"]:
        return None
    n, scale, size = total["n"], float(total["scale"]), int(total["size"])
    squares = F.aggregate(F.transform("v", lambda x: x / F.lit(scale)), F.lit(0.0), lambda a, x: a + x * x)
    largest = float(np.sqrt(classes.agg(F.max(squares)).first()[0])) * (1 + 1e-12)
    wanted = max(1, min(n // ROWS_A_PIVOT, max(pivots, int(2 * np.sqrt(n))), MOST_PIVOTS))
    chosen = np.array([r["v"] for r in classes.select("v", F.xxhash64("v").alias("h")).orderBy("h", "v").limit(wanted).collect()]) / scale
    axes = extended(chosen, largest)
    prefix = min(prefix, len(axes))
    held = rows.sparkSession.sparkContext.broadcast(axes)

    @F.arrow_udf("struct<ranks:array<smallint>,asked:array<smallint>>")
    def ranks(vs: pa.Array, asks: pa.Array) -> pa.Array:
        v = vs.flatten().to_numpy(zero_copy_only=False).reshape(len(vs), size) / scale
        own, asked = np.zeros((len(v), prefix), np.int16), np.flatnonzero(asks.to_numpy(zero_copy_only=False))
        for i in range(0, len(v), 1024):
            own[i : i + 1024] = prefixes(extended(v[i : i + 1024], largest), held.value, prefix)
        other = prefixes(v[asked], held.value[:, :size], prefix).astype(np.int16)  # its added component is zero, its length is nothing to the order
        ends = np.zeros(len(v) + 1, np.int32)
        ends[asked + 1] = prefix
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * prefix, pa.int32()), pa.array(own.ravel())), pa.ListArray.from_arrays(pa.array(np.cumsum(ends), pa.int32()), pa.array(other.ravel()))]
        return pa.StructArray.from_arrays(lists, ["ranks", "asked"])

    ranked = classes.withColumn("r", ranks("v", "asks")).select("c", "least", "ids", "v", "asks", "r.ranks", "r.asked")
    return Index(axes, scale, largest, size, prefix, written(ranked, "ranked"))


class Postings:
    """A part of one pivot's list: c, least ids, vectors and orders of pivots."""

    def __init__(self, c: np.ndarray, least: np.ndarray, v: np.ndarray, ranks: np.ndarray, pivots: int):
        order = np.argsort(least, kind="stable")
        self.c, self.least, self.v, ranks = c[order], least[order], v[order], ranks[order]
        flat = ranks.ravel()
        by = np.argsort(flat, kind="stable")
        self.rows, self.ranks = by // ranks.shape[1], (by % ranks.shape[1]).astype(np.int32)
        self.begin = np.searchsorted(flat[by], np.arange(pivots + 1))

    def footrules(self, ranks: np.ndarray) -> np.ndarray:
        """Per query and vector the sum over shared pivots; larger is nearer."""
        width = ranks.shape[1]
        sums = np.zeros((len(ranks), len(self.c)), np.int32)
        by = np.argsort(ranks, axis=None, kind="stable")
        pivots = ranks.ravel()[by]
        edge = np.flatnonzero(np.r_[True, pivots[1:] != pivots[:-1], True])
        for low, high in zip(edge, edge[1:]):
            a, b = self.begin[pivots[low]], self.begin[pivots[low] + 1]
            if b > a:
                asked, at = np.divmod(by[low:high], width)
                sums[asked[:, None], self.rows[None, a:b]] += width - np.abs(at[:, None] - self.ranks[None, a:b])
        return sums

    def nearest(self, queries: np.ndarray, ranks: np.ndarray, k: int, share: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For blocks of queries: the query's row, rows of the list, and products, of the k nearest reranked."""
        n = len(self.c)
        take = min(n, max(LEAST, int(np.ceil(share * n))))
        for low in range(0, len(queries), TOGETHER):
            asked = queries[low : low + TOGETHER]
            if take < n:
                sums = self.footrules(ranks[low : low + TOGETHER]).astype(np.int64) * n + np.arange(n)[::-1]  # ties to the smaller id
                some = np.argpartition(-sums, take - 1, axis=1)[:, :take]
                some.sort(axis=1)
            else:
                some = np.tile(np.arange(n), (len(asked), 1))
            with np.errstate(all="ignore"):  # a sum of its own for each pair, so that every list gives a pair the same
                score = (self.v[some] * asked[:, None, :]).sum(axis=2)
            score[np.isnan(score)] = -np.inf
            best = np.argsort(-score, axis=1, kind="stable")[:, :k]
            yield np.repeat(np.arange(low, low + len(asked)), best.shape[1]), np.take_along_axis(some, best, axis=1).ravel(), np.take_along_axis(score, best, axis=1).ravel()


def _merged(parts: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """Of rows of asking class, found class, its least id and score: each found once, the k nearest of each that asks."""
    q, c, least, score = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((c, least, -score, q))
    q, c, least, score = q[order], c[order], least[order], score[order]
    new = np.r_[True, (q[1:] != q[:-1]) | (c[1:] != c[:-1])]  # a class found twice has one score, so it stands together
    q, c, least, score = q[new], c[new], least[new], score[new]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return q[place < k], c[place < k], least[place < k], score[place < k]


def _posted(index: Index, posted: int, probed: int) -> tuple[DataFrame, int]:
    """Rows pivot, part, asks, c, least, v, ranks: candidates in their lists and queries in the parts of theirs; and how
    many tasks they are for."""
    ranked = index.ranked
    pivot = F.explode(F.slice("ranks", 1, posted)).alias("pivot")
    sizes = ranked.select(pivot).groupBy("pivot").agg(F.count(F.lit(1)).alias("n"))
    sizes = written(sizes.withColumn("parts", F.ceil(F.col("n") / F.lit(LIST_ROWS)).cast("int")), "lists")  # a row a pivot
    asking = ranked.where("asks").select("c", "least", "v", F.col("asked").alias("ranks"), F.explode(F.slice("asked", 1, probed)).alias("pivot")).join(F.broadcast(sizes), "pivot")
    asking = asking.select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("asks"), "c", "least", "v", "ranks")
    lists = ranked.select("c", "least", "v", "ranks", pivot).join(F.broadcast(sizes), "pivot")
    lists = lists.select("pivot", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("asks"), "c", "least", "v", "ranks")
    rows = ranked.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("asks"), 1)).alias("q")).first()
    return lists.unionByName(asking), max(1, (posted * rows["n"] + probed * rows["q"]) // TASK_ROWS)


def found_classes(index: Index, k: int, share: float = SHARE, posted: int = POSTED, probed: int = PROBED) -> DataFrame:
    """q, found: for each asking class the k nearest classes found, itself included, nearest first: far (the score's
    negative), least, c. A task gives a query one row of k at most, and a query meets the parts of PROBED lists at most."""
    size, prefix, pivots = index.size, index.prefix, len(index.pivots)
    both, tasks = _posted(index, posted, min(probed, prefix))
    dealt = both.repartition(tasks, "pivot", "part").sortWithinPartitions("pivot", "part", "asks")

    def out(q: np.ndarray, c: np.ndarray, least: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        found = pa.StructArray.from_arrays([pa.array(-score), pa.array(least), pa.array(c)], ["far", "least", "c"])
        return pa.record_batch([pa.array(q[first]), pa.ListArray.from_arrays(pa.array(np.r_[first, len(q)], pa.int32()), found)], names=["q", "found"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids, postings = None, [], None
        held, size_held = [], 0
        for batch in batches:
            pivot, part, asks, c, least = (batch.column(i).to_numpy() for i in range(5))
            v = batch.column(5).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), size)
            ranks = batch.column(6).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), prefix)
            edge = np.flatnonzero(np.r_[True, (pivot[1:] != pivot[:-1]) | (part[1:] != part[:-1]) | (asks[1:] != asks[:-1]), True])
            for low, high in zip(edge, edge[1:]):
                if (pivot[low], part[low]) != own:
                    own, ids, postings = (pivot[low], part[low]), [], None
                if not asks[low]:
                    ids.append((c[low:high], least[low:high], v[low:high], ranks[low:high]))
                    continue
                if not ids:
                    continue
                postings = postings or Postings(*(np.concatenate(x) for x in zip(*ids)), pivots)
                for query, row, score in postings.nearest(v[low:high], ranks[low:high], k, share):
                    held.append((c[low:high][query], postings.c[row], postings.least[row], score))
                    size_held += len(query)
                if size_held > HELD:
                    held = [_merged(held, k)]
                    size_held = len(held[0][0])
                    if size_held > HELD // 2:
                        yield out(*held[0])
                        held, size_held = [], 0
        if held:
            yield out(*_merged(held, k))

    found = dealt.mapInArrow(answer, "q bigint, found array<struct<far:double,least:bigint,c:bigint>>")
    whole = found.groupBy("q").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"))
    return whole.select("q", F.slice("found", 1, k).alias("found"))


def search(rows: DataFrame, is_query: Column, index: Index, k: int = 20, share: float = SHARE, posted: int = POSTED, probed: int = PROBED) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found for each row that is a query, among all rows. k: at most that the
    index was fitted for. A class brings k + 1 ids at most, and k + 1 classes are kept, so a list is bounded."""
    found = found_classes(index, k + 1, share, posted, probed)
    found = found.select("q", F.explode("found").alias("x")).select("q", "x.far", "x.c")
    entries = F.transform("ids", lambda x: F.struct(F.col("far"), x["vec_id"].alias("vec_id"), x["n"].alias("n")))
    lists = found.join(index.ranked.select("c", "ids"), "c").select("q", entries.alias("e")).groupBy("q").agg(F.array_sort(F.flatten(F.collect_list("e"))).alias("e"))
    full = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(index.size) - F.size("v")))
    asking = rows.where(is_query).select("vec_id", full.alias("v")).join(index.ranked.where("asks").select("v", F.col("c").alias("q")), "v").select(F.col("vec_id").alias("query_id"), "q").distinct()
    others = F.filter("e", lambda x: x["vec_id"] != F.col("query_id"))
    each = F.flatten(F.transform(others, lambda x: F.array_repeat(x, x["n"].cast("int"))))
    best = asking.join(lists, "q").select("query_id", F.posexplode(F.slice(each, 1, k)).alias("place", "x"))
    return best.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.far")).alias("score"))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours that were found."""
    hits = exact.join(found, ["query_id", "vec_id"], "left_semi").count()
    return hits / max(1, exact.count())
