"""Groups and their members: sets, equal and similar groups, and pairs of members drawn through shared groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def group_sets(edges: DataFrame, group: str, item: str, least: int = 1, to: str = "items") -> DataFrame:
    """Each group's distinct items in order, and how many."""
    found = edges.groupBy(group).agg(F.sort_array(F.collect_set(item)).alias(to))
    return found.withColumn("n_items", F.size(to)).where(F.col("n_items") >= least)


def distinct_sets(sets: DataFrame, group: str, items: str = "items") -> DataFrame:
    """Of groups with equal items that of the smallest key: a hash aggregate, so a content that very many groups have is
    added up before it is dealt out."""
    return sets.groupBy(items).agg(F.min(group).alias(group)).select(group, items, F.size(items).alias("n_items"))


def within_spread(rows: DataFrame, keys: list[str], value: str, most: float) -> DataFrame:
    """Rows that lie at most `most` below their group's largest value."""
    top = F.max(value).over(Window.partitionBy(*keys))
    return rows.withColumn("__top", top).where(F.col("__top") - F.col(value) <= most).drop("__top")


def similar_groups(edges: DataFrame, group: str, item: str, threshold: float) -> DataFrame:
    """Pairs a < b of groups whose distinct items have a Jaccard similarity of `threshold` or more, exactly.

    Prefix filter: with items in one order from rare to frequent, two similar groups of n items share one among their
    first n - ceil(threshold * n) + 1. Only these are joined, so frequent items hardly ever pair groups; the sizes must
    fit too. What is left is compared as sorted arrays. For edges in which many groups have the same items, give those of
    `distinct_sets` alone: m equal groups have m * m / 2 pairs."""
    rows = edges.select(F.col(group).alias("g"), F.col(item).alias("i")).where(F.col("i").isNotNull()).distinct()
    often = rows.groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    ranked = rows.join(often, "i").groupBy("g").agg(F.sort_array(F.collect_list(F.struct("n", "i"))).alias("s"))
    sets = ranked.select("g", F.sort_array(F.transform("s", lambda x: x["i"])).alias("items"), F.size("s").alias("size"), F.transform("s", lambda x: x["i"]).alias("rare"))
    first = F.col("size") - F.ceil(F.col("size") * F.lit(threshold) - F.lit(1e-9)) + 1
    keyed = sets.select("g", "size", F.explode(F.slice("rare", F.lit(1), first.cast("int"))).alias("i"))
    a, b = keyed.select(F.col("g").alias("a"), F.col("size").alias("na"), "i"), keyed.select(F.col("g").alias("b"), F.col("size").alias("nb"), "i")
    fits = (F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(threshold) - 1e-9) & (F.col("a") < F.col("b"))
    pairs = a.join(b, "i").where(fits).select("a", "b").distinct()
    whole = sets.select("g", "items")
    both = pairs.join(whole.withColumnsRenamed({"g": "a", "items": "x"}), "a").join(whole.withColumnsRenamed({"g": "b", "items": "y"}), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", shared.alias("shared"), (shared / (F.size("x") + F.size("y") - shared)).alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)


def drop_similar(sets: DataFrame, pairs: DataFrame, group: str = "g", size: str = "n_items") -> DataFrame:
    """Groups that greedy removal keeps: by size, largest first, then key, a group stays unless a similar one before it
    stays. Settled in rounds: what has no undecided similar group before it stays, what is similar to that goes. Each
    round is a written table; there are as many as the longest chain has links."""
    rows = sets.select(F.col(group).alias("g"), F.col(size).alias("n"))
    keep = lambda df: written(df, "similar")
    order = lambda x: F.struct(-x["n"], x["g"])
    a, b = rows.alias("a"), rows.alias("b")
    links = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().alias("p")
    before = keep(links.join(a, F.col("p.a") == F.col("a.g")).join(b, F.col("p.b") == F.col("b.g")).where(order({"n": F.col("a.n"), "g": F.col("a.g")}) < order({"n": F.col("b.n"), "g": F.col("b.g")})).select(F.col("p.a").alias("first"), F.col("p.b").alias("second")))
    gone = None
    while before.head(1):
        stay = before.select(F.col("first").alias("g")).distinct().join(before.select(F.col("second").alias("g")), "g", "left_anti")
        lost = keep(before.join(stay, before["first"] == stay["g"], "left_semi").select(F.col("second").alias("g")).distinct())
        gone = lost if gone is None else gone.unionByName(lost)
        rest = before.join(lost, before["first"] == lost["g"], "left_anti")
        before = keep(rest.join(lost, rest["second"] == lost["g"], "left_anti").join(stay, rest["first"] == stay["g"], "left_anti"))
    return sets if gone is None else sets.join(gone.withColumnRenamed("g", group), group, "left_anti")


def related(pairs: DataFrame, edges: DataFrame, group: str, item: str) -> DataFrame:
    """For pairs (a, b) of items: the sum over shared groups of one over the group's size, at most one."""
    rows = edges.select(F.col(group).alias("g"), F.col(item).alias("i")).distinct()
    weight = rows.groupBy("g").agg((F.lit(1.0) / F.count(F.lit(1))).alias("w"))
    rows = rows.join(weight, "g")
    left = pairs.select("a", "b").join(rows.select(F.col("i").alias("a"), "g", "w"), "a")
    shared = left.join(rows.select(F.col("i").alias("b"), "g"), ["b", "g"])
    return shared.groupBy("a", "b").agg(F.least(F.sum("w"), F.lit(1.0)).alias("weight"))


def unordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs, the smaller first, without pairs of one."""
    return pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).distinct()


def drawn(*parts: Column) -> Column:
    """A number between 0 and 1 for each row, from the first 48 bits of md5 of the parts, joined by colons: the same in any
    run and engine."""
    digits = F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def sample_pairs(edges: DataFrame, group: str, item: str, passes: int, seed: int = 0, largest: int = 256) -> DataFrame:
    """For each item and pass: a group, drawn with weight one over its size, and another item of it. Groups of 2 to
    `largest` items are drawn from; an item that has none of these draws from all its groups. Draws are hashes, so that runs agree: the group of the least -ln(u) * size. A group's members are numbered once;
    the partner is found by number, so no pairs are listed."""
    rows = edges.select(F.col(group).alias("g"), F.col(item).alias("i")).distinct()
    numbered = rows.withColumns({"at": F.row_number().over(Window.partitionBy("g").orderBy("i")) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("g"))})
    numbered = numbered.where(F.col("n") > 1)
    small = F.col("n") <= largest
    open_ = numbered.withColumn("some", F.max(small).over(Window.partitionBy("i"))).where(small | ~F.col("some"))
    unit = lambda *c: drawn(F.lit(seed), *c)
    turns = open_.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    draw = -F.log(unit(F.col("turn"), F.col("g"), F.col("i"))) * F.col("n")
    chosen = turns.groupBy("i", "turn").agg(F.min_by(F.struct("g", "at", "n"), F.struct(draw, F.col("g"))).alias("c")).select("i", "turn", "c.*")
    skip = F.floor(unit(F.lit("other"), F.col("turn"), F.col("i")) * (F.col("n") - 1)).cast("int") + 1
    wanted = chosen.select("i", "turn", "g", F.pmod(F.col("at") + skip, F.col("n")).alias("at"))
    return wanted.join(numbered.select("g", "at", F.col("i").alias("partner")), ["g", "at"]).select("i", "turn", "g", "partner")


def extracted(edges: DataFrame, items: DataFrame, blocked: DataFrame, spread: float, least: int = 5, buckets: int = 10) -> DataFrame:
    """Collections to learn from: collection, source, items, n_items. edges: collection, source, item; items: item, set,
    stars; blocked: collection, source. Items without a set or stars, blocked collections, items of held-out sets (one in
    `buckets`) and items more than `spread` stars below the hardest one of their set in the collection go; collections of
    fewer than `least` items go; of those with equal items the first stays."""
    known = edges.join(items.where("set is not null and stars is not null and pmod(set, %d) != 0" % buckets), "item")
    open_ = known.join(blocked, ["collection", "source"], "left_anti")
    near = within_spread(open_, ["collection", "source", "set"], "stars", spread)
    sets = near.groupBy("collection", "source").agg(F.sort_array(F.collect_set("item")).alias("items")).where(F.size("items") >= least)
    once = sets.groupBy("items").agg(F.min(F.struct("collection", "source")).alias("g"))
    return once.select("g.collection", "g.source", "items", F.size("items").alias("n_items"))


def disjoint_batches(pairs: DataFrame, a: str, b: str, size: int, seed: int = 0) -> DataFrame:
    """Pairs in batches in which no item occurs twice: round, part, batch, a, b. In each round a pair is taken if its hash
    is the least at both its items, so the round's pairs share none; they are cut into batches of `size`. A batch of fewer
    than a quarter of that waits for the next round, and a round without a whole one is the last; what still waits then
    is left out."""
    pending = written(pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b").distinct(), "pending")
    few, out, turn = min(size, max(2, size // 4)), None, 0
    while True:
        hashed = pending.withColumn("h", F.xxhash64(F.lit(seed), F.lit(turn), "a", "b"))
        least = hashed.select(F.explode(F.array("a", "b")).alias("i"), "h", "a", "b").groupBy("i").agg(F.min(F.struct("h", "a", "b")).alias("m"))
        taken = least.groupBy("m").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("m.*")
        parts = pending.count() // (64 * size) + 1
        placed = taken.withColumn("part", F.pmod("h", F.lit(parts)).cast("int"))
        placed = placed.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("part").orderBy("h", "a", "b")) - 1) / size).cast("int"))
        whole = placed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("part", "batch"))).where(F.col("n") >= few)
        found = written(whole.select(F.lit(turn).alias("round"), "part", "batch", "a", "b"), "batches")
        out = found if out is None else out.unionByName(found)
        if not found.head(1):
            return out.withColumnsRenamed({"a": a, "b": b}) if (a, b) != ("a", "b") else out
        pending = written(pending.join(found, ["a", "b"], "left_anti"), "pending")
        turn += 1
