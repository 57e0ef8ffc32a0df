"""Binary collection files: the ids that each collection lists.

Strings have a length of seven bits a byte before them; numbers are little-endian. Version 7 and later are compressed
after the version. What a version holds is a table of fields, read in order."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The versions of the format by name.
VERSIONS = {
    "o!dm": 1,
    "o!dm2": 2,
    "o!dm3": 3,
    "o!dm4": 4,
    "o!dm5": 5,
    "o!dm6": 6,
    "o!dm7": 7,
    "o!dm8": 8,
    "o!dm7min": 1007,
    "o!dm8min": 1008,
}


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the file ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def size(self) -> int:
        out = shift = 0
        while True:
            b = self.take(1)[0]
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    def text(self) -> str:
        return self.take(self.size()).decode("utf-8")

    def number(self) -> int:
        return struct.unpack("<i", self.take(4))[0]


def _entry(version: int, minimal: bool) -> list[str]:
    """An entry's fields after its id."""
    rich = version >= 8 or not minimal
    fields = [("number", version >= 2), ("text", not minimal), ("text", not minimal), ("text", not minimal), ("text", True), ("text", version >= 4), ("byte", version >= 5 and rich), ("double", version >= 6 and rich)]
    return [kind for kind, held in fields if held]


def parse(data: bytes) -> list[tuple[str, list[int]]]:
    """Name and ids of each collection."""
    file = Reader(data)
    name = file.text()
    if name not in VERSIONS:
        raise ValueError(f"unknown version {name!r}")
    minimal, version = VERSIONS[name] > 1000, VERSIONS[name] % 1000
    if version >= 7:
        file = Reader(gzip.decompress(file.data[file.at :]))
        file.text()
    file.take(8)
    file.text()
    skip = {"number": file.number, "text": file.text, "byte": lambda: file.take(1), "double": lambda: file.take(8)}
    fields, out = _entry(version, minimal), []
    for _ in range(file.number()):
        title = file.text()
        if version >= 7:
            file.number()
        ids = []
        for _ in range(file.number()):
            ids.append(file.number())
            for kind in fields:
                skip[kind]()
        if version >= 3:
            for _ in range(file.number()):
                file.text()
        out.append((title, ids))
    return out


def read(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, collection, item_id; a file that can't be read gives one row with its error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    kind = pa.schema([("path", pa.string()), ("collection", pa.string()), ("item_id", pa.int64()), ("error", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, data in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    out += [{"path": path, "collection": name, "item_id": i} for name, ids in parse(data) for i in ids]
                except Exception as e:  # noqa: BLE001
                    out.append({"path": path, "error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return files.select("path", "content").mapInArrow(rows, "path string, collection string, item_id bigint, error string").withColumn("error", F.col("error"))
