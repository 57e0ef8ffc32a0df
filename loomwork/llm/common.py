"""What the training-data operators share: how rows are divided, text as bytes, and samples of labelled texts."""

from __future__ import annotations

import ctypes
import gc
import pickle
from collections.abc import Callable, Iterator
from contextlib import suppress
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import shared_dir, shared_path, written  # noqa: F401  the operators' own modules take them from here


def remainder(column: str, by: int) -> Column:
    """crc32 of the column as text, modulo: how the contracts divide rows. Null counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(by))


def raw(column: str) -> Column:
    """Text as its bytes, so that ill-formed UTF-8 can't stop a Python worker."""
    return F.col(column).cast("binary")


def byte_rows(batch: pa.Array) -> Iterator[bytes]:
    """Each value's bytes; null as empty."""
    for value in batch:
        yield value.as_py() or b""


def cut_up(values: pa.Array) -> list[bytes]:
    """An array's values, none of them null, as bytes: what to_pylist gives, in a fifth of the time for short ones."""
    values = values.cast(pa.large_binary())
    if not len(values):
        return []
    _, ends, held = values.buffers()
    ends = np.frombuffer(ends, np.int64)[values.offset : values.offset + len(values) + 1]
    data = held[int(ends[0]) : int(ends[-1])].to_pybytes() if held is not None else b""
    ends = (ends - ends[0]).tolist()
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def cut_up_text(values: pa.Array) -> list[str]:
    """The same for well-formed text."""
    values = values.cast(pa.large_string())
    if not len(values):
        return []
    _, ends, held = values.buffers()
    ends = np.frombuffer(ends, np.int64)[values.offset : values.offset + len(values) + 1]
    data = held[int(ends[0]) : int(ends[-1])].to_pybytes() if held is not None else b""
    ends, text = ends - ends[0], data.decode()
    if len(text) < len(data):  # places of characters, not of bytes
        ends = np.r_[0, np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)][ends]
    ends = ends.tolist()
    return [text[a:b] for a, b in zip(ends, ends[1:])]


def tidy() -> None:
    """Gives memory that a task has freed back to the system: its worker may stay, and wait, for a long time."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # another C library may lack it
        ctypes.CDLL(None).malloc_trim(0)


def rested(spark: SparkSession) -> None:
    """Between the rounds of a long job: the driver's processes drop what ended plans, broadcasts and shuffles left, and
    Spark's cleaner takes these from the executors too, before the next round makes its own."""
    tidy()
    spark.sparkContext._jvm.System.gc()


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, longest: int, key: str = "doc_id", text: str = "text") -> DataFrame | None:
    """k, y, t: texts and labels 0 or 1 of `rows` labelled keys of each class at most, those of the least hashes, without
    texts that are null or longer than `longest` bytes. The keys are chosen among the labels alone and then sent to the
    texts; of rows that repeat a key, the two of the least hashes are taken, so the same rows in any run. None if no row
    is labelled."""
    chosen: list[tuple[int, int]] = []
    for value in (0, 1):
        keys = labels.where((F.col(label) == value) & F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("k")).distinct()
        chosen += [(r["k"], value) for r in keys.orderBy(F.xxhash64("k"), "k").limit(rows).collect()]
    if not chosen:
        return None
    spark = docs.sparkSession
    small = F.broadcast(spark.createDataFrame(chosen, "k bigint, y int"))
    usable = docs.select(F.col(key).cast("bigint").alias("k"), raw(text).alias("t")).where(F.col("t").isNotNull() & (F.octet_length("t") <= longest))
    place = F.row_number().over(Window.partitionBy("k", "y").orderBy(F.xxhash64("t"), "t"))
    return usable.join(small, "k").withColumn("p", place).where("p <= 2").select("k", "y", "t")


def _in_order(found: pa.Table) -> tuple[list[bytes], list[int]]:
    order = sorted(zip(found["k"].to_pylist(), found["y"].to_pylist(), found["t"].to_pylist()))
    return [t for _, _, t in order], [y for _, y, _ in order]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, longest: int, key: str = "doc_id", text: str = "text") -> tuple[list[bytes], list[int]]:
    """The texts and labels of labelled_rows."""
    found = labelled_rows(docs, labels, label, rows, longest, key, text)
    return ([], []) if found is None else _in_order(found.toArrow())


def learnt_in_task(found: DataFrame | None, train: Callable[[list[bytes], list[int]], Any]) -> Any:
    """What train makes of labelled_rows, in a task: the driver gets the model alone, neither texts nor what learning
    takes."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("k", pa.int64()), ("y", pa.int32()), ("t", pa.binary())])
        held = pickle.dumps(train(*_in_order(pa.Table.from_batches([x.cast(kinds) for x in batches], kinds))))
        yield pa.record_batch([pa.array([held], pa.binary())], names=["model"])
        del held
        tidy()

    rows = [] if found is None else found.repartition(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(rows[0]["model"]) if rows else train([], [])
