"""Features of ordered events: onset intervals, truncation, running state, and state grids packed into integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip


def valid_groups(rows: DataFrame, key: str, bad: Column, least: int = 1) -> DataFrame:
    """Keys with `least` rows or more and none that is bad; a row of which nothing is known counts as bad."""
    flag = F.max(F.coalesce(bad, F.lit(True)).cast("int"))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), flag.alias("__bad")).where((F.col("__n") >= least) & (F.col("__bad") == 0)).select(key)


def bad_number(c: Column, most: float) -> Column:
    """Null, NaN, infinite, not above zero, or above `most`."""
    return F.coalesce(F.isnan(c) | (c <= 0) | (c > most), F.lit(True))


def truncate(rows: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """Each key's first n rows."""
    return rows.withColumn("__i", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__i") <= n).drop("__i")


def onsets(rows: DataFrame, key: str, time_ms: str, order: list, first: float = 200.0, most: float = 5000.0) -> DataFrame:
    """ioi: milliseconds since the key's row before, `first` for its first row, at most `most`. state: 0 for the first
    row, 2 from an interval of `most` on, else 1."""
    gap = F.col(time_ms) - F.lag(time_ms).over(Window.partitionBy(key).orderBy(*order))
    rows = rows.withColumn("__gap", gap)
    state = F.when(F.col("__gap").isNull(), 0).when(F.col("__gap") >= most, 2).otherwise(1)
    return rows.withColumns({"ioi": clip(F.coalesce("__gap", F.lit(first)), 0.0, most), "state": state}).drop("__gap")


def running_max(rows: DataFrame, keys: list[str], order: list, value: str, to: str) -> DataFrame:
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(to, F.max(value).over(before))


def forward_fill(rows: DataFrame, keys: list[str], order: list, values: list[str]) -> DataFrame:
    """The last value that isn't null, up to each row."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({v: F.last(v, ignorenulls=True).over(before) for v in values})


def timing_sections(points: DataFrame, key: str, at: str, length: str) -> DataFrame:
    """points: a positive length starts a section of that beat length, a negative one scales speed in the section that
    runs. Gives beat length, bpm and speed of each point; speed is one where a section starts."""
    own = F.when(F.col(length) > 0, F.col(length))
    start = F.when(F.col(length) > 0, F.col(at))
    rows = forward_fill(points.withColumns({"beat_length": own, "origin": start}), [key], [at], ["beat_length", "origin"])
    speed = F.when(F.col(length) < 0, F.lit(-100.0) / F.col(length)).otherwise(F.lit(1.0))
    return rows.withColumns({"bpm": F.lit(60000.0) / F.col("beat_length"), "speed": speed})


def span_bin(spans: Column, is_slider: Column) -> Column:
    """One to three spans as 0 to 2, then even counts as 3 and odd ones as 4; 0 for other objects."""
    return F.when(~is_slider, 0).when(spans <= 3, spans - 1).when(spans % 2 == 0, 3).otherwise(4)


def hand_slot(column: Column, keys: int, centre: int = 5) -> Column:
    """Columns laid out around the centre slot, which even numbers of keys leave free."""
    half = keys // 2
    left = F.lit(centre - half) + column
    return left if keys % 2 else F.when(column < half, left).otherwise(left + 1)


def grid_states(rows: DataFrame, keys: list[str], slot: Column, state: Column, slots: int, base: int = 5) -> DataFrame:
    """For each key one long with a digit per slot: the largest state of the slot, 0 where it has no row."""
    cells = rows.groupBy(*keys, slot.alias("__slot")).agg(F.max(state).alias("__state")).where(F.col("__slot").between(0, slots - 1))
    weight = F.pow(F.lit(float(base)), F.col("__slot")).cast("bigint")
    return cells.groupBy(*keys).agg(F.sum(F.col("__state") * weight).cast("bigint").alias("packed"))


def unpack(packed: Column, slots: int, base: int = 5) -> list[Column]:
    return [F.pmod(F.floor(packed / F.lit(base**i)), F.lit(base)).cast("int") for i in range(slots)]


def sequences(rows: DataFrame, key: str, order: list[str], values: list[str], most: int | None = None) -> DataFrame:
    """Each key's rows as one array of structs in order."""
    found = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *[v for v in values if v not in order]))).alias("rows"))
    return found if most is None else found.withColumn("rows", F.slice("rows", 1, most))


def packed_batches(sizes: DataFrame, key: str, size: str, most: int) -> DataFrame:
    """Keys by size in batches whose sizes add up to about `most`: batch number by the running sum before the row.
    The sums are taken by buckets of equal size, so no task sorts all keys."""
    per = sizes.groupBy(size).agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum(F.col("n") * F.col(size)).over(Window.orderBy(size)) - F.col("n") * F.col(size))
    within = Window.partitionBy(size).orderBy(key)
    placed = sizes.withColumn("__i", F.row_number().over(within) - 1).join(per.select(size, "before"), size)
    return placed.withColumn("batch", F.floor((F.col("before") + F.col("__i") * F.col(size)) / most).cast("bigint")).drop("__i", "before")


def packed(rows: DataFrame, batch: str, order: str, size: str) -> DataFrame:
    """Sequences of a batch laid end to end: where each starts and ends, and the batch's total and longest."""
    per = Window.partitionBy(batch)
    end = F.sum(size).over(per.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"end": end, "start": end - F.col(size), "total": F.sum(size).over(per), "longest": F.max(size).over(per)})
