"""Evaluation: ranking metrics, ridge probes with grouped folds, resampling tests, and statistics of features."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import random_average_precision
from ..storage import written
from .vectors import mean_vector, unit


def ranking_metrics(ranked: DataFrame, query: str, relevant: str, place: str, at: int = 10, recall_at: int = 20) -> DataFrame:
    """Per query from ranked candidates (place from 1, relevant boolean): positives, ap, ndcg, r_precision, recall."""
    per = Window.partitionBy(query)
    hit = F.col(relevant).cast("int")
    rows = ranked.withColumns({"__p": F.sum(hit).over(per), "__seen": F.sum(hit).over(per.orderBy(place).rowsBetween(Window.unboundedPreceding, 0))})
    gain = F.lit(1.0) / F.log2(F.col(place) + 1)
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.first("__p"), F.lit(at)).cast("int")), F.lit(0.0), lambda a, i: a + F.lit(1.0) / F.log2(i + F.lit(1.0)))
    n = F.first("__p")
    found = rows.where("__p > 0").groupBy(query).agg(
        n.alias("positives"),
        (F.sum(F.when(F.col(relevant), F.col("__seen") / F.col(place)).otherwise(0.0)) / n).alias("ap"),
        (F.sum(F.when(F.col(relevant) & (F.col(place) <= at), gain).otherwise(0.0)) / ideal).alias("ndcg"),
        (F.sum(F.when(F.col(place) <= F.col("__p"), hit).otherwise(0)) / n).alias("r_precision"),
        (F.sum(F.when(F.col(place) <= recall_at, hit).otherwise(0)) / n).alias("recall"),
    )
    return found


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)


def worst_mean(rows: DataFrame, value: str, share: float = 0.2) -> DataFrame:
    """The mean of the lowest share of values, rounded up to whole rows: all below a threshold, the value of that rank,
    and as many of those at it as are needed. Values are counted by themselves, and ranks found over ranges of them, so
    no task sorts them all."""
    each = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("x")).agg(F.count(F.lit(1)).alias("c"))
    parts = written(each.repartitionByRange("x").withColumn("p", F.spark_partition_id()), "values")
    sums = parts.groupBy("p").agg(F.sum("c").alias("m"))  # a row a range
    before = sums.select("p", (F.sum("m").over(Window.orderBy("p")) - F.col("m")).alias("before"), F.sum("m").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    placed = parts.join(F.broadcast(before), "p").withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy("p").orderBy("x")))
    take = F.greatest(F.least(F.ceil(F.lit(share) * F.col("n")) - (F.col("upto") - F.col("c")), F.col("c")), F.lit(0))
    low = placed.select("x", take.alias("t")).where("t > 0")
    return low.agg((F.sum(F.col("x") * F.col("t")) / F.sum("t")).alias("worst_mean"), F.sum("t").alias("n"))


def skewness(value: str) -> list[Column]:
    """Sums from which skewness_of takes the mean cubed deviation in sample standard deviations."""
    return [F.avg(value).alias("m1"), F.avg(F.pow(value, F.lit(2.0))).alias("m2"), F.avg(F.pow(value, F.lit(3.0))).alias("m3"), F.stddev_samp(value).alias("sd")]


def skewness_of() -> Column:
    m1, m2, m3 = F.col("m1"), F.col("m2"), F.col("m3")
    return (m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1) / F.pow("sd", F.lit(3.0))


def gated_stats(rows: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """feature, n, mean, std (sample) of each feature over the rows whose gate holds; std 1 where it would be 0 or null.
    One pass of sums for all features."""
    parts = []
    for name, gate in gates.items():
        x = F.when(gate, F.col(name).cast("double"))
        parts += [F.count(x).alias(f"n_{name}"), F.avg(x).alias(f"m_{name}"), F.stddev_samp(x).alias(f"s_{name}")]
    one = rows.agg(*parts)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"n_{f}").alias("n"), F.col(f"m_{f}").alias("mean"), F.when(F.col(f"s_{f}") > 0, F.col(f"s_{f}")).otherwise(F.lit(1.0)).alias("std")) for f in gates]))
    return one.select(each.alias("f")).select("f.*")


def histogram(rows: DataFrame, value: str, width: float, most: int) -> DataFrame:
    """bucket, n: value over width, rounded down with a tolerance of 1e-6; from `most` on all in one bucket."""
    bucket = F.least(F.lit(most).cast("bigint"), F.floor(F.col(value) / F.lit(width) + F.lit(1e-6)))
    return rows.where(F.col(value).isNotNull()).groupBy(bucket.cast("bigint").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def pair_accuracy(positives: DataFrame, negatives: DataFrame, query: str, score: str) -> DataFrame:
    """Per query and positive the share of negatives with a lower score; equal ones count half. Counted from sorted
    scores with windows, so no pairs are listed."""
    both = positives.select(query, F.col(score).alias("s"), F.lit(1).alias("p")).unionByName(negatives.select(query, F.col(score).alias("s"), F.lit(0).alias("p")))
    per = Window.partitionBy(query)
    low = F.sum(1 - F.col("p")).over(per.orderBy("s").rangeBetween(Window.unboundedPreceding, 0))
    same = F.sum(1 - F.col("p")).over(Window.partitionBy(query, "s"))
    every = F.sum(1 - F.col("p")).over(per)
    rows = both.select(query, "p", "s", low.alias("low"), same.alias("same"), every.alias("every"))
    return rows.where("p = 1 and every > 0").select(query, F.col("s").alias(score), ((F.col("low") - F.col("same") / 2) / F.col("every")).alias("accuracy"))


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per class: support, recall, precision, f1."""
    counts = rows.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    hit = F.sum(F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0))
    a = counts.groupBy(F.col(truth).alias("class")).agg(F.sum("n").alias("support"), hit.alias("hits"))
    b = counts.groupBy(F.col(predicted).alias("class")).agg(F.sum("n").alias("called"))
    both = a.join(b, "class", "left").withColumn("called", F.coalesce("called", F.lit(0)))
    return both.select("class", "support", (F.col("hits") / F.col("support")).alias("recall"), F.when(F.col("called") > 0, F.col("hits") / F.col("called")).otherwise(0.0).alias("precision"), (2 * F.col("hits") / (F.col("support") + F.col("called"))).alias("f1"))


# --- linear probes: the rows are only summed up, the small systems are solved here


def normal_equations(rows: DataFrame, v: str, target: str, by: str | None = None) -> dict:
    """For each value of `by`: n, X'X, X'y, sum of y, of y squared, with a constant as X's last column. Sums in each
    task first, one matrix a task and value."""
    from collections.abc import Iterator

    import pyarrow as pa

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            keys = np.array(batch.column(0).to_pylist(), object)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            x, y = np.c_[x, np.ones(len(x))], batch.column(2).to_numpy(zero_copy_only=False)
            for k in set(keys.tolist()):
                own = np.array([z == k for z in keys.tolist()])
                part = np.concatenate([[own.sum(), y[own].sum(), (y[own] ** 2).sum()], x[own].T @ y[own], (x[own].T @ x[own]).ravel()])
                sums[k] = sums[k] + part if k in sums else part
        yield pa.record_batch([pa.array(list(sums), pa.string()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))], names=["k", "s"])

    from pyspark.sql import functions as F

    key = F.col(by).cast("string") if by else F.lit("")
    narrow = rows.select(key.alias("k"), F.col(v).cast("array<double>").alias("v"), F.col(target).cast("double").alias("y")).where("v is not null and y is not null and forall(v, x -> x is not null)")
    parts = narrow.mapInArrow(partial, "k string, s array<double>")
    each = parts.select("k", F.posexplode("s").alias("i", "x")).groupBy("k", "i").agg(F.sum("x").alias("x"))
    out = {}
    for r in each.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s")).collect():
        s = np.array([x["x"] for x in r["s"]])
        d = int((-1 + np.sqrt(1 + 4 * (len(s) - 3))) / 2)
        out[r["k"]] = {"n": s[0], "y": s[1], "yy": s[2], "xy": s[3 : 3 + d], "xx": s[3 + d :].reshape(d, d)}
    return out


def solve(parts: list[dict], penalty: float) -> np.ndarray:
    """Ridge weights of the sum of parts; the constant isn't penalised."""
    xx, xy = sum(p["xx"] for p in parts), sum(p["xy"] for p in parts)
    ridge = penalty * np.eye(len(xy))
    ridge[-1, -1] = 0
    return np.linalg.solve(xx + ridge, xy)


def out_of_fold_r2(rows: DataFrame, v: str, target: str, fold: str, penalty: float = 1.0) -> float:
    """R squared of ridge predictions, each fold predicted from the others: from the folds' sums alone."""
    sums = normal_equations(rows, v, target, fold)
    lost = 0.0
    for k, own in sums.items():
        w = solve([s for other, s in sums.items() if other != k], penalty)
        lost += own["yy"] - 2 * w @ own["xy"] + w @ own["xx"] @ w
    n, y, yy = (sum(s[x] for s in sums.values()) for x in ("n", "y", "yy"))
    return float(1 - lost / (yy - y * y / n))


def balanced_folds(sizes: dict, folds: int) -> dict:
    """Groups to folds, the largest first, each to the fold that has the least. sizes: a bounded number of groups."""
    held = [0] * folds
    out = {}
    for group, n in sorted(sizes.items(), key=lambda x: (-x[1], str(x[0]))):
        at = min(range(folds), key=lambda i: (held[i], i))
        held[at] += n
        out[group] = at
    return out


def hash_fold(column: str, folds: int, seed: int = 0) -> Column:
    """A fold for each group by a hash, for any number of groups."""
    return F.pmod(F.xxhash64(F.lit(seed), column), F.lit(folds)).cast("int")



def _draws(rows: DataFrame, value: str, key: str, rounds: int, seed: int) -> DataFrame:
    """x, r, h: for each row and round the first digits of md5(seed:key:round), as a number up to 16 ** 7: the same
    however rows are divided, and in any engine."""
    one = rows.select(F.col(value).cast("double").alias("x"), F.col(key).cast("string").alias("k")).where("x is not null")
    each = one.select("x", "k", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("r"))
    return each.select("x", "r", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "k", "r").cast("binary")), 1, 7), 16, 10).cast("bigint").alias("h"))


#: Chances that a row is drawn at most 0, 1, ... times in a round: Poisson of mean one, as parts of 16 ** 7.
_POISSON = [round(16**7 * sum(1 / np.e / math.factorial(j) for j in range(i + 1))) for i in range(9)]


def bootstrap(values: DataFrame, value: str, key: str, rounds: int = 4000, seed: int = 0, share: float = 0.95) -> DataFrame:
    """One row: mean, low, high. Each row counts a Poisson number of times in each round, drawn from a hash of its key and
    the round, so rounds are sums, added up in each task first."""
    times = sum(((F.col("h") >= F.lit(limit)).cast("int") for limit in _POISSON), F.lit(0))
    per = _draws(values, value, key, rounds, seed).withColumn("t", times).groupBy("r").agg((F.sum(F.col("x") * F.col("t")) / F.sum("t")).alias("m"))
    low, high = (1 - share) / 2, (1 + share) / 2
    ends = per.agg(F.percentile("m", F.array(F.lit(low), F.lit(high))).alias("p"))
    mean = values.agg(F.avg(F.col(value).cast("double")).alias("mean"))
    return mean.crossJoin(ends).select("mean", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))  # a row each


def sign_flip_test(differences: DataFrame, value: str, key: str, rounds: int = 20000, seed: int = 0) -> DataFrame:
    """One row: the mean difference, and its two-sided p value: the share of rounds, in each of which a hash gives every
    row a sign, whose sum lies as far from zero as the rows' own."""
    sign = F.when(F.col("h") < 16**7 // 2, F.lit(-1.0)).otherwise(F.lit(1.0))
    per = _draws(differences, value, key, rounds, seed).groupBy("r").agg(F.sum(F.col("x") * sign).alias("s"))
    total = differences.agg(F.sum(F.col(value).cast("double")).alias("s0"), F.avg(F.col(value).cast("double")).alias("delta"))
    beyond = per.crossJoin(F.broadcast(total)).agg(F.sum((F.abs("s") >= F.abs("s0") - 1e-9).cast("int")).alias("n"))
    return total.crossJoin(beyond).select("delta", (F.col("n") / F.lit(float(rounds))).alias("p"))  # a row each


def multiclass_probe(rows: DataFrame, v: str, label: str, fold: str, penalty: float = 1.0, least: int = 50) -> dict:
    """Out-of-fold ridge classification over labels of `least` rows or more: a target a class, each class's rows weighed so
    that classes count alike, the largest prediction wins. Sums by fold, over all classes at once, are gathered; rows are
    scored where they lie, and counted by class. Returns accuracy, macro_recall, macro_f1, top5 and classes."""
    usable = rows.where(F.col(v).isNotNull() & F.forall(v, lambda x: x.isNotNull()) & F.col(label).isNotNull())
    counts = {r[0]: r[1] for r in usable.groupBy(label).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).collect()}
    classes = sorted(counts)
    if len(classes) < 2:
        raise ValueError("fewer than two labels have rows enough")
    known = usable.join(F.broadcast(usable.sparkSession.createDataFrame([(c, i, 1.0 / counts[c]) for i, c in enumerate(classes)], f"{label} {dict(rows.dtypes)[label]}, __y int, __w double")), label)
    narrow = known.select(F.col(fold).cast("string").alias("f"), F.col(v).cast("array<double>").alias("x"), F.col("__y").alias("y"), F.col("__w").alias("w"))

    def sums(batches):
        held: dict = {}
        for batch in batches:
            if not len(batch):
                continue
            folds = np.array(batch.column(0).to_pylist())
            x = np.c_[batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1), np.ones(len(batch))]
            y, w = np.eye(len(classes))[batch.column(2).to_numpy()], batch.column(3).to_numpy()[:, None]
            for f in np.unique(folds):
                own = folds == f
                part = (x[own] * w[own]).T @ np.c_[x[own], y[own]]
                held[f] = held[f] + part if f in held else part
        if held:
            yield pa.record_batch([pa.array([str(f) for f in held]), pa.array([s.tobytes() for s in held.values()], pa.binary())], names=["f", "s"])

    parts: dict = {}
    for r in narrow.mapInArrow(sums, "f string, s binary").collect():  # a matrix a task and fold
        parts[r["f"]] = parts.get(r["f"], 0) + np.frombuffer(r["s"])
    size = next(iter(parts.values())).size
    d = int(round((-len(classes) + np.sqrt(len(classes) ** 2 + 4 * size)) / 2))
    parts = {f: s.reshape(d, d + len(classes)) for f, s in parts.items()}
    total, weights = sum(parts.values()), {}
    for f, own in parts.items():
        s = total - own
        ridge = penalty * np.eye(d) / max(1.0, sum(counts.values()) / len(classes))
        ridge[-1, -1] = 1e-12
        weights[f] = np.linalg.solve(s[:, :d] + ridge, s[:, d:])
    held = rows.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("array<int>")
    def best(x, f):
        flat = np.c_[x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1), np.ones(len(x))]
        out = [np.argsort(-(row @ held.value[k]), kind="stable")[:5].tolist() for k, row in zip(f.to_pylist(), flat)]
        return pa.array(out, pa.list_(pa.int32()))

    scored = narrow.select("y", best("x", "f").alias("b"))
    table = scored.groupBy("y", F.col("b")[0].alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.array_contains("b", F.col("y")).cast("int")).alias("five")).collect()  # classes squared at most
    n = sum(r["n"] for r in table)
    hit = {c: sum(r["n"] for r in table if r["y"] == r["p"] == c) for c in range(len(classes))}
    true, called = ({c: sum(r["n"] for r in table if r[k] == c) for c in hit} for k in ("y", "p"))
    return {"accuracy": sum(hit.values()) / n, "macro_recall": float(np.mean([hit[c] / true[c] for c in hit])), "macro_f1": float(np.mean([2 * hit[c] / (true[c] + called[c]) for c in hit])), "top5": sum(r["five"] for r in table) / n, "classes": len(classes)}


# --- retrieval of sets


def set_retrieval(scores: DataFrame, own: DataFrame, positives: DataFrame, at: int = 50) -> DataFrame:
    """Retrieval at set level. scores: query, item, item_set, score of all candidates; own: query, query_set; positives:
    query, item_set, weight. Per query: sets (others than its own), positives, ap, chance (the expected ap of a random
    order), ndcg and recall. A set has its best item's score; it is ranked among all sets, of equal ones by number, less
    one if the query's own set stands before it."""
    best = scores.groupBy("query", "item_set").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "item_set")))
    mine = ranked.join(own.withColumnRenamed("query_set", "item_set"), ["query", "item_set"]).select("query", F.col("rank").alias("own_rank"))
    sizes = best.join(own, "query").groupBy("query").agg(F.sum((F.col("item_set") != F.col("query_set")).cast("int")).alias("sets"))
    wanted = positives.join(own, "query").where("item_set != query_set").groupBy("query", "item_set").agg(F.max("weight").alias("weight"))
    hits = wanted.join(ranked, ["query", "item_set"]).join(mine, "query", "left")
    hits = hits.withColumn("place", F.col("rank") - (F.coalesce("own_rank", F.lit(1 << 31)) < F.col("rank")).cast("int"))
    hits = hits.withColumn("seen", F.row_number().over(Window.partitionBy("query").orderBy("place")))
    gain = lambda x: F.lit(1.0) / F.log2(x + F.lit(1.0))
    per = hits.groupBy("query").agg(
        F.count(F.lit(1)).alias("positives"),
        (F.sum(F.col("weight") * F.col("seen") / F.col("place")) / F.sum("weight")).alias("ap"),
        F.sum(F.when(F.col("place") <= at, gain(F.col("place"))).otherwise(0.0)).alias("gained"),
        F.avg((F.col("place") <= at).cast("double")).alias("recall"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("positives", F.lit(at)).cast("int")), F.lit(0.0), lambda a, i: a + gain(i))
    return per.join(sizes, "query").select("query", "sets", "positives", "ap", random_average_precision(F.col("positives"), F.col("sets")).alias("chance"), (F.col("gained") / ideal).alias("ndcg"), "recall")


# --- the same from one query's scores of all candidates, without a row a pair


def rank_of(scores: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The wanted candidates (rising positions) by falling score, of equal scores the first, and their ranks from 1 among
    all."""
    ranked = np.sort(scores)
    if (ranked[1:] == ranked[:-1]).any():
        place = np.empty(len(scores), np.int64)
        place[np.argsort(-scores, kind="stable")] = np.arange(1, len(scores) + 1)
        order = wanted[np.argsort(place[wanted])]
        return order, place[order]
    order = wanted[np.argsort(-scores[wanted])]
    return order, len(scores) - np.searchsorted(ranked, scores[order[::-1]])[::-1]  # rising keys are found faster


def rank_metrics(places: np.ndarray, at: int = 10, recall_at: int = 20) -> tuple[int, float, float, float, float]:
    """ranking_metrics from the sorted ranks of one query's positives, of which there is one at least."""
    n = len(places)
    gain = lambda x: float((1 / np.log2(x + 1.0)).sum())
    ndcg = gain(places[places <= at]) / gain(np.arange(1, min(n, at) + 1))
    return n, float((np.arange(1, n + 1) / places).sum() / n), ndcg, int((places <= n).sum()) / n, int((places <= recall_at).sum()) / n


def levels(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded to whole units of a digit, halves away from zero, taken after scaling, as SQL does it."""
    y = x * 10.0**digits
    whole = np.rint(y)
    half = np.flatnonzero(np.abs(y - whole) == 0.5)
    whole[half] = np.trunc(y[half]) + np.sign(y[half])
    return whole.astype(np.int64)


def mean_accuracy(scores: np.ndarray, wanted: np.ndarray, left_out: np.ndarray) -> float | None:
    """The mean of pair_accuracy's shares over one query's wanted candidates, against all but those left out. Scores are
    levels, few enough to be counted; None where either side is empty."""
    low, high = int(scores.min()), int(scores.max())
    count = lambda x: np.bincount(x - low, minlength=high - low + 1)
    yes, no = count(scores[wanted]), count(scores) - count(scores[left_out])
    pairs = int(yes.sum()) * int(no.sum())
    return float((yes * (2 * (np.cumsum(no) - no) + no)).sum() / 2 / pairs) if pairs else None


def set_ranks(best: np.ndarray, wanted: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
    """rank_of for sets by their best item's score, less one where the query's own set stands before."""
    order, rank = rank_of(best, wanted)
    mine = 1 + np.count_nonzero(best > best[own]) + np.count_nonzero(best[:own] == best[own])
    return order, rank - (rank > mine)



def few_shot(rows: DataFrame, v: str, owner: str, fold: str, support: int = 0) -> DataFrame:
    """owner, hits, n: prototypes are the owners' mean unit vectors over the rows of one fold (`support`); each other row is
    given to the owner of the nearest prototype, of equal ones the first. Owners are a panel, so prototypes are few."""
    each = rows.select(F.col(owner).alias("owner"), F.col(fold).alias("fold"), unit(v).alias("v")).where(F.col("v").isNotNull())
    prototypes = mean_vector(each.where(F.col("fold") == support), ["owner"], "v").orderBy("owner").collect()
    names, matrix = [r["owner"] for r in prototypes], np.array([r["mean"] for r in prototypes])
    kind = dict(rows.dtypes)[owner]

    @F.arrow_udf("int")
    def nearest_one(x):
        return pa.array((x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) @ matrix.T).argmax(axis=1), pa.int32())

    found = each.where(F.col("fold") != support).withColumn("p", nearest_one("v"))
    found = found.withColumn("named", F.element_at(F.array(*[F.lit(n).cast(kind) for n in names]), F.col("p") + 1))
    return found.groupBy("owner").agg(F.sum((F.col("owner") == F.col("named")).cast("int")).alias("hits"), F.count(F.lit(1)).alias("n"))


def stratified_folds(groups: dict, folds: int) -> dict:
    """Groups to folds so that every label is spread evenly. groups: group to its labels' counts, a bounded number of
    groups. The largest go first, each to the fold whose labels then lie closest to an even share; of equal ones to the
    fold with fewer rows, then the first."""
    labels = sorted({x for counts in groups.values() for x in counts}, key=str)
    at = {x: i for i, x in enumerate(labels)}
    rows = {g: np.array([counts.get(x, 0) for x in labels], float) for g, counts in groups.items()}
    total = np.maximum(sum(rows.values()), 1)
    held, out = np.zeros((folds, len(at))), {}
    for g in sorted(rows, key=lambda g: (-rows[g].sum(), str(g))):
        with_it = (held + rows[g]) / total
        lost = ((with_it - 1 / folds) ** 2).sum(axis=1) - ((held / total - 1 / folds) ** 2).sum(axis=1)
        out[g] = min(range(folds), key=lambda i: (round(lost[i], 12), held[i].sum(), i))
        held[out[g]] += rows[g]
    return out
