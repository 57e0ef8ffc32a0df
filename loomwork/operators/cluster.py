"""Cosine clusters of each group's vectors, groups of plays with their names, and shared attributes.

Clusters are found from three questions to a set of unit vectors: which row is nearest the mean, which row is least like
the centres so far, and how many rows and what sum each centre has. `Held` answers them from an array, `Spread` by sums
over a DataFrame's tasks, so a group of any size is clustered whole, by the same steps.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vectors import doubles, mean_vector

#: Clusters of a group at most, rows a cluster that is started, members of a cluster at least, rounds.
MOST, ROWS_A_START, LEAST, ROUNDS = 6, 12, 3, 30
#: Rows of a group up to which one task holds it.
HELD_ROWS = 200_000
#: Other names of a mod, mods that change the speed, and the order in which a name lists mods.
ALIASES = {"NC": "DT", "DC": "HT"}
SPEED = ["DT", "HT"]
ORDER = ["EZ", "HT", "HD", "HR", "DT", "FL"]


def units(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


class Held:
    """Unit vectors in memory, in the order of their keys."""

    def __init__(self, v: np.ndarray):
        self.v, self.n = units(v), len(v)

    def central(self) -> np.ndarray:
        return self.v[(self.v @ self.v.mean(axis=0)).argmax()]

    def remote(self, centres: np.ndarray) -> np.ndarray:
        return self.v[(self.v @ centres.T).max(axis=1).argmin()]

    def totals(self, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = np.eye(len(centres))[(self.v @ centres.T).argmax(axis=1)]
        return own.sum(axis=0), own.T @ self.v


class Spread:
    """The same of rows k, v. Every answer is one pass, in which a task brings back one row of a few vectors."""

    def __init__(self, rows: DataFrame, n: int):
        self.rows, self.n = rows, n

    def _fold(self, of: Callable, join: Callable):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for batch in batches:
                if len(batch):
                    v = units(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1))
                    part = of(batch.column(0).to_pylist(), v)
                    out = part if out is None else join(out, part)
            if out is not None:
                yield pa.record_batch([pa.array([pickle.dumps(out)])], names=["x"])

        parts = [pickle.loads(r["x"]) for r in self.rows.mapInArrow(task, "x binary").collect()]
        whole = parts[0]
        for part in parts[1:]:
            whole = join(whole, part)
        return whole

    def _best(self, score: Callable) -> np.ndarray:
        """The vector of the largest score, of equal ones that of the least key."""

        def of(keys: list, v: np.ndarray) -> tuple:
            s = score(v)
            at = min(np.flatnonzero(s == s.max()), key=lambda i: keys[i])
            return s[at], keys[at], v[at]

        return self._fold(of, lambda a, b: a if (-a[0], a[1]) <= (-b[0], b[1]) else b)[2]

    def central(self) -> np.ndarray:
        mean = self._fold(lambda _, v: v.sum(axis=0), lambda a, b: a + b) / self.n
        return self._best(lambda v: v @ mean)

    def remote(self, centres: np.ndarray) -> np.ndarray:
        return self._best(lambda v: -(v @ centres.T).max(axis=1))

    def totals(self, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._fold(lambda _, v: Held(v).totals(centres), lambda a, b: (a[0] + b[0], a[1] + b[1]))


def centres_of(rows: Held | Spread, most: int = MOST, least: int = LEAST, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres: a start for every ROWS_A_START rows, `most` at most, far from one another; then a round either
    takes away the smallest cluster, if it has fewer than `least` rows, or moves each centre to its rows' mean. Totals
    that come back unchanged end it."""
    wanted = max(1, min(most, rows.n // ROWS_A_START))
    found = rows.central()[None]
    for _ in range(wanted - 1):
        found = np.concatenate([found, rows.remote(found)[None]])
    before: tuple | None = None
    for _ in range(rounds):
        sizes, sums = rows.totals(found)
        smallest = int(sizes.argmin())
        if sizes[smallest] < least and len(found) > 1:
            found, before = found[np.arange(len(found)) != smallest], None
        elif before is not None and np.array_equal(sizes, before[0]) and np.allclose(sums, before[1], atol=1e-12):
            return found
        else:
            found, before = units(sums), (sizes, sums)
    return found


def clusters(v: np.ndarray, most: int = MOST, least: int = LEAST, rounds: int = ROUNDS) -> np.ndarray:
    """A cluster number for each row; numbers go by size, then first row."""
    held = Held(v)
    own = (held.v @ centres_of(held, most, least, rounds).T).argmax(axis=1)
    names, first, sizes = np.unique(own, return_index=True, return_counts=True)
    place = np.empty(own.max() + 1, int)
    place[names[np.lexsort((first, -sizes))]] = np.arange(len(names))
    return place[own]


def _large(rows: DataFrame, n: int) -> DataFrame:
    """k, cluster of one group that no task holds."""
    centres = centres_of(Spread(rows, n))

    @F.arrow_udf("int")
    def own(v: pa.Array) -> pa.Array:
        return pa.array((units(v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)) @ centres.T).argmax(axis=1), pa.int32())

    found = rows.select("k", own("v").alias("own"))
    sizes = found.groupBy("own").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first"))  # MOST rows
    number = (F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1).alias("cluster")
    return found.join(F.broadcast(sizes.select("own", number)), "own").select("k", "cluster")


def cluster_groups(rows: DataFrame, group: str, key: str, v: str, held_rows: int = HELD_ROWS) -> DataFrame:
    """group, key, cluster. Groups of up to `held_rows` rows are a task's work each; larger ones, of which there can't be
    many, are clustered one after the other over all tasks, by the same steps. Rows without a vector are left out."""
    narrow = rows.select(F.col(group).alias("g"), F.col(key).alias("k"), doubles(v).alias("v")).where("g is not null and v is not null")
    sizes = narrow.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    large = [(r["g"], r["n"]) for r in sizes.where(F.col("n") > held_rows).collect()]

    def one(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("k")
        return pd.DataFrame({"g": df["g"], "k": df["k"], "cluster": clusters(np.stack(df["v"].to_numpy()).astype(float))})

    kinds = dict(rows.dtypes)
    small = narrow.where(~F.col("g").isin([g for g, _ in large])) if large else narrow
    found = small.groupBy("g").applyInPandas(one, f"g {kinds[group]}, k {kinds[key]}, cluster int")
    for g, n in large:
        own = _large(narrow.where(F.col("g") == F.lit(g)).select("k", "v"), n)
        found = found.unionByName(own.select(F.lit(g).cast(kinds[group]).alias("g"), "k", "cluster"))
    return found.select(F.col("g").alias(group), F.col("k").alias(key), "cluster")


def shared_values(rows: DataFrame, group: str, values: str) -> DataFrame:
    """Values of an array column that at least half of a group's rows have."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    each = rows.select(group, F.explode(F.array_distinct(values)).alias("value")).groupBy(group, "value").agg(F.count(F.lit(1)).alias("c"))
    return each.join(sizes, group).where(2 * F.col("c") >= F.col("n")).select(group, "value", "c")


# --- plays


def usual_mods(mods: str | Column) -> Column:
    """Mods under their usual names, each once, in order."""
    names = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    c = F.col(mods) if isinstance(mods, str) else mods
    return F.array_sort(F.array_distinct(F.transform(c, lambda m: F.coalesce(names[m], m))))


def mods_name(mods: Column) -> Column:
    """The mods of ORDER that are there, as one word; `nm` without any."""
    word = F.lower(F.array_join(F.filter(F.array(*map(F.lit, ORDER)), lambda m: F.array_contains(mods, m)), ""))
    return F.when(word == "", F.lit("nm")).otherwise(word)


def play_groups(plays: DataFrame, vectors: DataFrame, labels: Head | None = None, owner: str = "owner", key: str = "key", mods: str = "mods", place: str = "place", v: str = "v") -> tuple[DataFrame, DataFrame]:
    """Groups of each owner's plays: owner, name, keys, size, the largest first by `rank`; and the plays (owner, key) whose
    key has no vector. Plays are divided by the mods that change the speed; of plays that repeat a key there the first
    counts. Each part is clustered; a cluster is named by the mods that half of it has and, with `labels`, its mean's
    label; clusters of one name are one group, its keys by cluster and key."""
    each = plays.select(F.col(owner).alias("owner"), F.col(key).alias("key"), usual_mods(mods).alias("mods"), F.col(place).alias("place"))
    each = each.withColumn("speed", F.array_join(F.array_intersect("mods", F.array(*map(F.lit, SPEED))), ""))
    once = each.groupBy("owner", "speed", "key").agg(F.min_by("mods", "place").alias("mods"))
    known = once.join(vectors.select(F.col(key).alias("key"), doubles(v).alias("v")), "key").withColumn("part", F.struct("owner", "speed").cast("string"))
    missing = once.join(vectors.select(F.col(key).alias("key")), "key", "left_anti").select(F.col("owner").alias(owner), F.col("key").alias(key)).distinct()
    found = known.join(cluster_groups(known, "part", "key", "v"), ["part", "key"]).withColumn("cl", F.concat_ws("|", "part", "cluster"))
    common = shared_values(found, "cl", "mods").groupBy("cl").agg(F.collect_list("value").alias("common"))
    named = found.select("cl", "owner", "speed", "cluster").distinct().join(common, "cl", "left")
    name = mods_name(F.coalesce("common", F.array().cast("array<string>")))
    if labels is not None:
        named = named.join(mean_vector(found, ["cl"], "v"), "cl")
        name = F.concat_ws(" ", name, labels.name("mean"))
    parts = found.groupBy("cl").agg(F.array_sort(F.collect_list("key")).alias("keys")).join(named.select("cl", "owner", "speed", "cluster", name.alias("name")), "cl")
    merged = parts.groupBy("owner", "name").agg(F.array_sort(F.collect_list(F.struct("speed", "cluster", "keys"))).alias("x"))
    groups = merged.select("owner", "name", F.flatten(F.transform("x", lambda x: x["keys"])).alias("keys")).withColumn("size", F.size("keys"))
    rank = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("size"), "name"))
    return groups.withColumn("rank", rank).withColumnRenamed("owner", owner), missing


# --- naming by labels


class Head:
    """Linear scores of labels for a unit vector."""

    def __init__(self, names: list[str], weight: np.ndarray, bias: np.ndarray):
        self.names, self.weight, self.bias = names, weight, bias

    def name(self, v: str | Column) -> Column:
        """The label of the largest score, of equal ones the first."""

        @F.arrow_udf("string")
        def best(rows: pa.Array) -> pa.Array:
            x = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
            return pa.array([self.names[i] for i in (x @ self.weight + self.bias).argmax(axis=1)], pa.string())

        return best(doubles(v))


def label_head(groups: DataFrame, v: str, names: list[str], ridge: float = 1.0, balance: float = 0.25, least: int = 40) -> Head:
    """A ridge regression from groups' unit vectors to boolean label columns, a label's members weighed by its size to
    the power -balance; scores are zero on average. Every label needs `least` members. Groups are only summed up."""
    rows = groups.select(doubles(v).alias("v"), F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names]).alias("y")).where("v is not null")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                x, y = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1) for i in (0, 1))
                x = np.c_[np.ones(len(x)), units(x)]
                part = x.T @ np.c_[x, y]
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array([pickle.dumps(total)])], names=["x"])

    parts = [pickle.loads(r["x"]) for r in rows.mapInArrow(task, "x binary").collect()]  # a matrix a task
    if not parts:
        raise ValueError("no groups to learn labels from")
    s = sum(parts)
    size = s.shape[0]
    n, sizes = s[0, 0], s[0, size:]
    if sizes.min() < least:
        raise ValueError(f"too few groups of label {names[int(sizes.argmin())]}: {int(sizes.min())}")
    mean, scale = s[0, 1:size] / n, sizes**-balance
    spread = s[1:, 1:size] - n * np.outer(mean, mean)
    joint = (s[1:, size:] - np.outer(mean, sizes)) * scale
    weight = np.linalg.solve(spread + ridge * np.eye(size - 1), joint)
    return Head(names, weight, -(mean @ weight))
