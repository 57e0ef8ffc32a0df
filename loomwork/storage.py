"""Tables and files that outlive a stage, in the folder that the cluster's machines share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

#: Rows of a file where their number is known; Spark's setting for shuffle files that go when their query ends.
FILE_ROWS, FREED = 200_000, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITTEN: list[tuple[SparkSession, str]] = []


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="loomwork-")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, with its file system. Only where it is unset and the master is local, a folder
    of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _own_folder()
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/loomwork/{name}-{uuid.uuid4().hex[:12]}"
    _WRITTEN.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _drop_written() -> None:
    for spark, path in _WRITTEN:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before this process
            return


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Queries that run in the block take their shuffle files with them when they end. Otherwise these stay on the
    executors' disks until the driver happens to collect its garbage, beside those of the queries that follow."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """The same rows, read from a Parquet table in the shared folder: lineage ends there, and a lost executor
    costs no more than the tasks that it ran. What was shuffled for it goes at once. rows: a bound on their number, if
    one is known, for tables that are cheap to make: they then go to as many files as it asks for."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with freed(spark):
        (df if rows is None else df.coalesce(rows // FILE_ROWS + 1)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that are written in a block and not read after it go when it ends, but for those that are kept."""

    def __enter__(self) -> Scratch:
        self.first, self.held = len(_WRITTEN), []
        return self

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        out = written(df, name)
        self.held.append(_WRITTEN.pop())
        return out

    def __exit__(self, *_) -> None:
        for spark, path in _WRITTEN[self.first :]:
            drop_path(spark, path)
        _WRITTEN[self.first :] = self.held
