"""Catalogue upkeep: upserts, change detection, shards of which the last counts, ledgers, and default lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import keep_one


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Rows of both, of equal keys the new one; missing columns become null. `order` tells which of new rows with equal
    keys comes first; without it they must be unique."""
    both = old.withColumn("__batch", F.lit(0)).unionByName(new.withColumn("__batch", F.lit(1)), allowMissingColumns=True)
    return keep_one(both, keys, [F.desc("__batch"), *(order or [])]).drop("__batch")


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Of rows with equal keys the last by a total order, given as descending columns."""
    return keep_one(rows, keys, list(order))


def changes(old: DataFrame, new: DataFrame, key: str, checksum: str) -> DataFrame:
    """key and change: new, changed, removed or same. One full join on the key."""
    a = old.select(key, F.col(checksum).alias("__old"), F.lit(True).alias("__in_old"))
    b = new.select(key, F.col(checksum).alias("__new"), F.lit(True).alias("__in_new"))
    both = a.join(b, key, "full")
    kind = F.when(F.col("__in_old").isNull(), "new").when(F.col("__in_new").isNull(), "removed").when(F.col("__old").eqNullSafe(F.col("__new")), "same").otherwise("changed")
    return both.select(key, kind.alias("change"))


def soft_delete(rows: DataFrame, seen: DataFrame, key: str, when: Column, to: str = "deleted_at") -> DataFrame:
    """Rows that the feed no longer has get the time `when`, unless they have one; rows that it has get null."""
    marked = rows.join(seen.select(key).distinct().withColumn("__seen", F.lit(True)), key, "left")
    return marked.withColumn(to, F.when(F.col("__seen").isNull(), F.coalesce(F.col(to), when))).drop("__seen")


def pending(wanted: DataFrame, done: DataFrame, key: str, failed: DataFrame | None = None, refresh: DataFrame | None = None) -> DataFrame:
    """Wanted keys that are neither done nor failed, and those to be done again."""
    rows = wanted.join(done.select(key), key, "left_anti")
    rows = rows if failed is None else rows.join(failed.select(key), key, "left_anti")
    return rows if refresh is None else rows.unionByName(wanted.join(refresh.select(key), key, "left_semi")).distinct()


def check_columns(df: DataFrame, needed: list[str]) -> DataFrame:
    """The same, if it has all needed columns: known from the schema alone."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def top_share(rows: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """Rows whose average rank by value in their group is at least `share` of the group's size."""
    from ..functions.scalar import average_rank

    whole = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return rows.withColumn("__rank", average_rank(by, F.col(value)) / whole).where(F.col("__rank") >= share).drop("__rank")


def interleave(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """n rows, the groups' first rows before their second ones. Only each group's first n rows are sorted together."""
    within = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(within)).where(F.col("place") <= n).orderBy("place", group).limit(n)


def cache(found: DataFrame, failed: DataFrame, key: str, model: str, order: list[Column]) -> DataFrame:
    """A cache's state: of each key's rows that were made with `model` the last, of values (`found`) and failures with a
    reason (`failed`). Rows of other models count for nothing. `is_known` tells a value from a failure."""
    both = found.withColumn("is_known", F.lit(True)).unionByName(failed.withColumn("is_known", F.lit(False)), allowMissingColumns=True)
    return keep_one(both.where(F.col("model") == model), [key], order)


def uncached(wanted: DataFrame, done: DataFrame, key: str, size: str, most: int) -> DataFrame:
    """Wanted keys that have no result for the objects they would be cut to: key and size, at most `most`, are the cache's
    key. The size is that of the cut."""
    return wanted.withColumn(size, F.least(F.col(size), F.lit(most))).join(done.select(key, size).distinct(), [key, size], "left_anti")


def uncached_whole(wanted: DataFrame, done: DataFrame, key: str, size: str, pruned: str, most: int | None = None) -> DataFrame:
    """Wanted keys of which no result stands for the whole: one that wasn't pruned, or, with `most`, one of at most `most`
    objects or pruned to just that many."""
    whole = ~F.col(pruned) if most is None else (~F.col(pruned) & (F.col(size) <= most)) | (F.col(size) == most)
    return wanted.join(done.where(whole).select(key).distinct(), key, "left_anti")


def failures(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """A ledger of key, reason and tries: a new failure takes the reason and counts one more."""
    both = old.select(key, "reason", "tries", F.lit(0).alias("late")).unionByName(new.select(key, "reason", F.lit(1).alias("tries"), F.lit(1).alias("late")))
    return both.groupBy(key).agg(F.max_by("reason", "late").alias("reason"), F.sum("tries").cast("int").alias("tries"))
