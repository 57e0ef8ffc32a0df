"""A keyed table kept up to date from a stream: each batch's last row of a key replaces the one before.

The table is a folder of versions; a batch writes the next version and then names it, so readers and a batch that is run
again never see half of one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import keep_one


def current(spark: SparkSession, path: str) -> tuple[DataFrame | None, int]:
    """The newest version that is named, and its number; -1 if there is none."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return None, -1
    numbers = [int(s.getPath().getName().removeprefix("v")) for s in system.listStatus(folder) if s.getPath().getName().startswith("v") and system.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return (spark.read.parquet(f"{path}/v{max(numbers)}"), max(numbers)) if numbers else (None, -1)


def upsert_stream(rows: DataFrame, path: str, checkpoint: str, key: str, order: list[str]):
    """A started query. rows: a streaming frame; `order` tells the last of a key's rows within a batch."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old, version = current(spark, path)
        if version >= number:  # this batch was written before its end was recorded
            return
        new = keep_one(batch, [key], [F.col(c).desc() for c in order])
        both = new if old is None else new.unionByName(old.join(new.select(key), key, "left_anti"))
        both.write.mode("overwrite").parquet(f"{path}/v{number}")

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
