"""Plain sources and sinks: id lists, CSV with a schema, block lists, archives, shards by id, ragged sequences."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One number a line; other lines are left out."""
    return spark.read.text(path).select(F.trim("value").try_cast("bigint").alias("id")).where("id is not null")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").option("mode", "PERMISSIVE").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def read_blocklist(spark: SparkSession, path: str, field: str = "collections") -> DataFrame:
    """A JSON object that lists ids by source: source, id."""
    rows = spark.read.schema(f"{field} map<string,array<bigint>>").option("multiLine", "true").json(path)
    return rows.select(F.explode(field).alias("source", "ids")).select("source", F.explode("ids").alias("id"))


def shard_of(key: str) -> Column:
    """The last two digits, as text."""
    return F.lpad(F.right(F.col(key).cast("string"), F.lit(2)), 2, "0")


def write_sharded(df: DataFrame, path: str, key: str, mode: str = "append") -> None:
    df.withColumn("shard", shard_of(key)).repartition("shard", key).write.mode(mode).partitionBy("shard").parquet(path)


def read_archives(spark: SparkSession, root: str, pattern: str = "*.tar*") -> DataFrame:
    """archive, member, id (from the member's name if that is a number), content, md5; each md5 once, that of the first
    archive and member. An archive is read by one task, as a stream."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "content")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns)):
                with tarfile.open(fileobj=io.BytesIO(content), mode="r|*") as archive:
                    for m in archive:
                        if m.isfile():
                            data = archive.extractfile(m).read()
                            yield pa.record_batch([pa.array([path]), pa.array([m.name]), pa.array([data], pa.binary())], names=["archive", "member", "content"])

    found = files.mapInArrow(members, "archive string, member string, content binary").withColumn("md5", F.md5("content"))
    kept = found.groupBy("md5").agg(F.min_by(F.struct("archive", "member", "content"), F.struct("archive", "member")).alias("f"))
    return kept.select("f.*", "md5", F.regexp_extract("f.member", r"(\d+)\.[^/]*$", 1).try_cast("bigint").alias("id"))


def write_failures(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_sequences(rows: DataFrame, path: str, key: str, group: str) -> None:
    """Ragged sequences by key, one file group a value of `group`; of repeated keys the first batch's stays."""
    rows.dropDuplicates([key]).write.mode("append").partitionBy(group).option("compression", "zstd").parquet(path)


def read_sequence(spark: SparkSession, path: str, key: str, ids: list[int], most: int | None = None, values: str = "rows") -> DataFrame:
    found = spark.read.parquet(path).where(F.col(key).isin(ids))
    return found if most is None else found.withColumn(values, F.slice(values, 1, most))


def stored_ids(spark: SparkSession, path: str, key: str) -> DataFrame:
    return spark.read.parquet(path).select(key).distinct()


def write_shard(rows: DataFrame, path: str, shard: int, checksum: str) -> None:
    """Adds a shard of an index; shards are never changed."""
    rows.withColumns({"shard": F.lit(shard), "checksum": F.lit(checksum)}).write.mode("append").partitionBy("shard").parquet(path)


def read_index(spark: SparkSession, path: str, key: str, checksum: str) -> DataFrame:
    """Each key's row of the last shard; fails if a shard was made by another model. The newest shard of each key is
    found on narrow columns and joined back."""
    rows = spark.read.parquet(path)
    other = rows.where(~F.col("checksum").eqNullSafe(F.lit(checksum))).select("shard").limit(1).collect()
    if other:
        raise ValueError(f"shard {other[0]['shard']} was made by another model")
    newest = rows.groupBy(key).agg(F.max("shard").alias("shard"))
    return rows.join(newest, [key, "shard"], "left_semi").drop("checksum")


def without_nan(df: DataFrame) -> DataFrame:
    """For JSON: NaN and infinite numbers become null."""
    return df.withColumns({c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def to_json(df: DataFrame) -> DataFrame:
    return without_nan(df).select(F.to_json(F.struct("*")).alias("json"))
