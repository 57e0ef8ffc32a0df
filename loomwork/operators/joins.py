"""Joins that Spark has no operator for, and checked forms of those it has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str], strict: bool = False) -> DataFrame:
    """Each left row with the values of the latest right row of its key at or before it; with `strict`, before it.

    Both sides are united and sorted once by key and time, where left rows stand after right rows of the same time, or
    before them if strict; the last right values seen are carried on. One shuffle, no pairs. Right rows should be unique
    by key and time. A key with very many rows is one task's sort, which spills."""
    side = F.lit(0 if strict else 2)
    lefts = left.select("*", side.alias("__side"), F.lit(None).cast(_struct(right, values)).alias("__last"))
    rights = right.select(*by, at, F.lit(1).alias("__side"), F.struct(*values).alias("__last"))
    both = lefts.unionByName(rights, allowMissingColumns=True)
    before = Window.partitionBy(*by).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__last", F.last("__last", ignorenulls=True).over(before)).where("__side <> 1")
    return found.select(*left.columns, *[F.col(f"__last.{v}").alias(v) for v in values])


def _struct(df: DataFrame, names: list[str]) -> str:
    kinds = dict(df.dtypes)
    return "struct<" + ",".join(f"`{n}`:{kinds[n]}" for n in names) + ">"


def lookup(left: DataFrame, right: DataFrame, on: list[str], fill: dict[str, object]) -> DataFrame:
    """Left join whose missing values are filled. Right rows must be unique by key."""
    found = left.join(right, on, "left")
    return found.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in fill.items()})


def backfill(left: DataFrame, right: DataFrame, on: list[str], names: list[str]) -> DataFrame:
    """Nulls of the named columns taken from the right row of the same key."""
    other = right.select(*on, *[F.col(n).alias(f"__{n}") for n in names])
    found = left.join(other, on, "left")
    return found.withColumns({n: F.coalesce(F.col(n), F.col(f"__{n}")) for n in names}).drop(*[f"__{n}" for n in names])


def require(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join that fails where a left key is missing, at the row that lacks it."""
    marked = right.withColumn("__found", F.lit(True))
    found = left.join(marked, on, "left")
    checked = F.when(F.col("__found").isNull(), F.raise_error(F.concat(F.lit("no row for "), F.to_json(F.struct(*on))))).otherwise(F.lit(True))
    return found.withColumn("__found", checked.cast("boolean")).where("__found").drop("__found")
