"""Records of several providers brought to one schema, by mappings."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import keep_one


@dataclass(frozen=True)
class Mapping:
    """columns: name to a column or an SQL expression over the provider's fields; enums: name to a table from the
    provider's code to ours, where unknown codes become null."""

    columns: dict[str, str | Column]
    enums: dict[str, dict] = field(default_factory=dict)


def normalised(rows: DataFrame, mapping: Mapping, schema: str) -> DataFrame:
    """Rows with the schema's columns: what the mapping lacks, or can't be cast, is null."""
    kinds = [(c.split()[0], c.split()[1]) for c in schema.split(",")]
    out = []
    for name, kind in kinds:
        c = mapping.columns.get(name)
        c = F.lit(None) if c is None else F.expr(c) if isinstance(c, str) else c
        if name in mapping.enums:
            c = F.create_map(*[F.lit(x) for kv in mapping.enums[name].items() for x in kv])[c]
        out.append(c.cast("string").try_cast(kind).alias(name))
    return rows.select(*out)


def first_known(providers: list[DataFrame], key: str) -> DataFrame:
    """One row a key, from the first provider in the list that has it; its nulls filled from the others in turn."""
    marked = [df.withColumn("__from", F.lit(i)) for i, df in enumerate(providers)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)
    names = [c for c in both.columns if c not in (key, "__from")]
    filled = [F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("__from"))).alias(c) for c in names]
    return both.groupBy(key).agg(*filled)


def flattened(rows: DataFrame, nested: str) -> DataFrame:
    """A struct's fields beside the other columns; a field whose name is taken keeps the outer column."""
    own = [c for c in rows.columns if c != nested]
    inner = [f.name for f in rows.schema[nested].dataType.fields if f.name not in own]
    return rows.select(*own, *[F.col(f"{nested}.{n}").alias(n) for n in inner])


def group_codes(rows: DataFrame, column: str, to: str, ordinal: str) -> DataFrame:
    """Dense codes of a column's values from zero; a null gets a code of its own, -1 less its row's ordinal."""
    from ..operators.text import dictionary

    codes = dictionary(rows, column).withColumnsRenamed({"value": column, "code": to})
    return rows.join(codes, column, "left").withColumn(to, F.coalesce(F.col(to).cast("bigint"), -1 - F.col(ordinal).cast("bigint")))


def newest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    return keep_one(rows, [key], list(order))
