"""WARC archives in seekable Zstandard bundles.

A bundle groups records into frames that are compressed independently. After them comes the seek table of the seekable
Zstandard format, a skippable frame that lists each frame's compressed and decompressed size, so a plain decompressor
reads the bundle too. A catalogue maps each record's id to its bundle, frame and offset within the frame's content.

Records are WARC/1.1: response records carry an HTTP response with the payload, revisit records its head alone and the
identifier of the record that has the payload. Of records with equal payloads of at least `least` bytes, that of the
largest id is the response; rows that repeat this id are all responses. An identifier is made from the id and the
payload's digest, so rows that are equal in both are records of one identifier. Null payloads count as empty. Rows with a
null id are written under an id of "null" and identifiers of their own, and refer to nothing; they are never named by a
revisit. Very long payloads are records like any other, in a frame of their own at most with what came before. Empty
tables give no bundle. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import posixpath
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Payloads of fewer bytes are always written; bytes of content that end a frame; frames that end a bundle.
LEAST, FRAME_BYTES, BUNDLE_FRAMES, LEVEL = 1000, 1 << 19, 64, 3
#: Fixed values of the seekable format: skippable frame magic, end magic.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Fixed value: the profile of revisits of an equal payload.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads that several records have, up to which they are sent to all tasks, at some 40 bytes each; tasks that read.
BROADCAST_PAYLOADS, READERS = 500_000, 20_000


# --- bundles


class BundleWriter:
    """Records in, bytes out: `add` gives a record's frame and offset; `close` gives the bundle."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.frame_bytes, self.compressor = frame_bytes, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.done: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.size = 0

    def add(self, record: bytes) -> tuple[int, int]:
        if self.size >= self.frame_bytes:
            self._end()
        place = len(self.done), self.size
        self.open.append(record)
        self.size += len(record)
        return place

    def _end(self) -> None:
        frame = self.compressor.compress(b"".join(self.open))
        self.done.append(frame)
        self.sizes.append((len(frame), self.size))
        self.open, self.size = [], 0

    def close(self) -> bytes:
        if self.open:
            self._end()
        entries = b"".join(struct.pack("<II", *x) for x in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, _SEEKABLE)
        return b"".join([*self.done, struct.pack("<II", _SKIPPABLE, len(entries) + len(footer)), entries, footer])


class BundleReader:
    """Frames and records of a bundle, through a function that reads `size` bytes at an offset."""

    def __init__(self, read, size: int):
        self.read = read
        n, flags, magic = struct.unpack("<IBI", read(size - 9, 9))
        if magic != _SEEKABLE:
            raise ValueError("the file has no seek table")
        width = 12 if flags & 0x80 else 8
        table = read(size - 9 - n * width, n * width)
        self.frames, at = [], 0
        for i in range(n):
            packed, plain = struct.unpack_from("<II", table, i * width)
            self.frames.append((at, packed, plain))
            at += packed
        self.decompressor = zstandard.ZstdDecompressor()

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.frames[number]
        return self.decompressor.decompress(self.read(at, packed), max_output_size=plain)

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        return next(records(self.frame(frame), offset))[1:]


# --- records


def record(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"WARC/1.1\r\n{head}Content-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"


def records(content: bytes, offset: int = 0) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and payload of each record from the offset on."""
    while offset < len(content):
        end = content.index(b"\r\n\r\n", offset)
        version, *lines = content[offset:end].decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at {offset}")
        headers = dict(x.split(": ", 1) for x in lines)
        size = int(headers["Content-Length"])
        yield offset, headers, content[end + 4 : end + 4 + size]
        offset = end + 8 + size


def _clean(value: str) -> str:
    """A header's value may not break the header."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


# --- tables


def plan(pages: DataFrame, page_id: str = "page_id", payload: str = "html", least: int = LEAST) -> DataFrame:
    """digest, response: of each payload that several rows have, the largest id. Only digests and ids are dealt out, and
    groups are summed up where they lie first."""
    data = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    rows = pages.where(F.octet_length(payload) >= least).select(F.col(page_id).cast("bigint").alias("id"), F.unhex(F.sha1(data)).alias("digest"))
    groups = rows.groupBy("digest").agg(F.max("id").alias("response"), F.count("*").alias("n")).where("n > 1 and response is not null").drop("n")
    return written(groups, "payloads")


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid4() if page is None else uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}')}>"


def http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP head of a block."""
    return block[block.index(b"\r\n\r\n") + 4 :]


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def write(pages: DataFrame, uri: str, page_id: str = "page_id", payload: str = "html", url: str | Column | None = "url", least: int = LEAST, frame_bytes: int = FRAME_BYTES, bundle_frames: int = BUNDLE_FRAMES, date: str | None = None) -> DataFrame:
    """Writes bundles into a folder that all machines share; gives the catalogue, a written table with a row per record:
    record_id, page_id, bundle, frame, offset. A task that is run again writes bundles of other names; the catalogue
    has those of the run that counted. date: the records' date, now unless given. Payloads are dealt out only where more
    than BROADCAST_PAYLOADS payloads have several rows."""
    when = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    target = F.col(url) if isinstance(url, str) else url if url is not None else F.lit(None)
    rows = pages.select(F.col(page_id).cast("bigint").alias("id"), F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary")).alias("payload"), target.cast("string").alias("url"))
    rows = rows.withColumn("digest", F.when((F.octet_length("payload") >= least) & F.col("id").isNotNull(), F.unhex(F.sha1("payload"))))
    payloads = plan(pages, page_id, payload, least)
    rows = rows.join(F.broadcast(payloads) if payloads.count() <= BROADCAST_PAYLOADS else payloads, "digest", "left")
    rows = rows.select("id", "payload", "url", F.when(F.col("id") < F.col("response"), F.col("response")).alias("refers_to"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _filesystem(uri)
        system.create_dir(folder, recursive=True)
        bundle, held = BundleWriter(frame_bytes), []

        def close() -> pa.RecordBatch:
            name = f"bundle-{uuid.uuid4().hex}.warc.zst"
            with system.open_output_stream(posixpath.join(folder, name), compression=None) as f:
                f.write(bundle.close())
            columns = list(zip(*held))
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64()]
            out = [pa.array(x, k) for x, k in zip(columns, kinds)]
            return pa.record_batch([*out[:2], pa.array([name] * len(held)), *out[2:]], names=["record_id", "page_id", "bundle", "frame", "offset"])

        for batch in batches:
            for i, data, link, to in zip(*(c.to_pylist() for c in batch.columns)):
                digest = hashlib.sha1(data).hexdigest()
                name = record_id(i, digest)
                headers = [("WARC-Type", "response" if to is None else "revisit"), ("WARC-Record-ID", name), ("WARC-Date", when), ("WARC-Target-URI", f"urn:page:{i}" if link is None else _clean(link))]
                headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Page-ID", "null" if i is None else str(i))]
                if to is not None:
                    headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(to, digest)), ("WARC-Refers-To-Page-ID", str(to))]
                block = http_head(len(data)) + (data if to is None else b"")
                held.append((name, i, *bundle.add(record(headers, block))))
                if len(bundle.done) >= bundle_frames:
                    yield close()
                    bundle, held = BundleWriter(frame_bytes), []
        if held:
            yield close()

    return written(rows.mapInArrow(store, "record_id string, page_id bigint, bundle string, frame int, offset bigint"), "catalogue")


_READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read(catalogue: DataFrame, uri: str) -> DataFrame:
    """Reads the catalogue's records back, frame by frame: page_id, payload_bytes, payload_digest, record_type, refers_to.
    Size and digest are those of the bytes that were read; a revisit's are those of the response that it refers to, and
    it is an error if there is none of the digest that it names. A task reads one bundle or a few."""
    bundles = catalogue.select("bundle").distinct().count()
    frames = catalogue.repartition(max(1, min(bundles, READERS)), "bundle").groupBy("bundle", "frame").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))  # a frame holds few records

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _filesystem(uri)
        held: tuple[str, BundleReader] | None = None
        for batch in batches:
            out: list[tuple] = []
            for name, number, offsets in zip(*(c.to_pylist() for c in batch.columns)):
                if held is None or held[0] != name:
                    f = system.open_input_file(posixpath.join(folder, name))
                    held = name, BundleReader(lambda at, size, f=f: f.read_at(size, at), f.size())
                content = held[1].frame(number)
                for at in offsets:
                    _, headers, data = next(records(content, at))
                    kind, page = headers["WARC-Type"], headers["WARC-Page-ID"]
                    page = None if page == "null" else int(page)
                    if kind == "revisit":
                        out.append((page, None, headers["WARC-Payload-Digest"].removeprefix("sha1:"), kind, int(headers["WARC-Refers-To-Page-ID"])))
                    else:
                        data = payload_of(data)
                        out.append((page, len(data), hashlib.sha1(data).hexdigest(), kind, None))
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.record_batch([pa.array(x, k) for x, k in zip(columns, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    rows = written(frames.mapInArrow(load, _READ), "records")
    revisits, responses = rows.where("record_type = 'revisit'"), rows.where("record_type = 'response'")
    asked = revisits.select("refers_to", "payload_digest").distinct()  # few columns, each response once
    held = asked.join(responses.select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct(), ["refers_to", "payload_digest"], "left")
    size = F.when(F.col("payload_bytes").isNull(), F.raise_error(F.concat(F.lit("no response of the payload of page "), F.col("page_id").cast("string"))).cast("bigint")).otherwise(F.col("payload_bytes"))
    checked = revisits.drop("payload_bytes").join(held, ["refers_to", "payload_digest"]).select("page_id", size.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return responses.unionByName(checked)


def lookup(catalogue: DataFrame, uri: str, page_id: int) -> list[tuple[dict[str, str], bytes]]:
    """The records of one page: headers and payload, each by one read of its frame."""
    system, folder = _filesystem(uri)
    out = []
    for r in catalogue.where(F.col("page_id") == page_id).collect():
        with system.open_input_file(posixpath.join(folder, r["bundle"])) as f:
            headers, block = BundleReader(lambda at, size: f.read_at(size, at), f.size()).record(r["frame"], r["offset"])
            out.append((headers, payload_of(block)))
    return out
