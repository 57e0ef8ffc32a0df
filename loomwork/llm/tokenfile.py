"""Token ids in canonical, length-limited Huffman files.

One code is made from the counts of all ids (package-merge keeps it within LIMIT bits) and given to all files. A file
holds ids in independent blocks: a directory gives each block's bit offset and number of ids, so any block can be read
alone, and blocks are decoded side by side, one table look-up giving an id and its length in each block at a time. An
index gives each document's place. Layout of a file, integers little-endian:

    magic "LWTK0001"; u32 ids in the code, u32 code length limit, u64 ids, u64 documents, u64 blocks, u64 payload bytes
    the code: u32 ids, ascending, and u8 lengths
    the blocks: u64 bit offset and u32 ids each
    the documents: u64 place of the first id in the file, in order
    the payload: most significant bits first; eight bytes of zeros at the end

Null texts encode as empty ones, so a document of them holds the end id alone. Rows that repeat a doc_id follow each
other in an order that their texts give; null doc_ids come first. An empty table gives no file and an empty result.
Other columns are not touched. A lost task writes its file again under another name; only the manifest's files count.
"""

from __future__ import annotations

import os
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, cut_up_text, raw, shared_path, written
from .pieces import splits

MAGIC = b"LWTK0001"
#: Longest code in bits; ids of a block; stretches of text, and texts, that a worker keeps.
LIMIT, BLOCK_IDS, KEPT, COPIES = 18, 1024, 1_600_000, 2000
#: Signs that form a piece of their own after a word.
SIGNS = ".,;:!?%&$#*|"
#: Blocks decoded side by side; ids of a file; ranges up to which their bounds are worked out here.
TOGETHER, FILE_IDS, MOST_RANGES = 4096, 6_000_000, 4096

# --- the code


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `limit` bits, by package-merge; 0 for ids that don't occur."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if not len(used):
        return lengths
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids have no code of {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weight = counts[used].astype(np.float64)
    # each level: which entries of the sorted list are ids; packages pair the entries of the level before
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        merged = np.concatenate([weight, packages])
        order = np.argsort(merged, kind="stable")
        levels.append(order < len(weight))
        merged = merged[order]
        pairs = len(merged) // 2 * 2
        packages = merged[0:pairs:2] + merged[1:pairs:2]
    take, deep = 2 * len(used) - 2, np.zeros(len(used), np.int64)
    for is_id in reversed(levels):  # of the first `take` entries: ids get a bit more, packages double in the next level
        ids = int(is_id[:take].sum())
        deep[:ids] += 1
        take = 2 * (take - ids)
    lengths[used] = deep
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then id."""
    codes = np.zeros(len(lengths), np.uint32)
    code, before = 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    for length in np.unique(lengths[order]) if len(order) else []:
        code <<= int(length) - before
        ids = order[lengths[order] == length]
        codes[ids] = code + np.arange(len(ids))
        code, before = code + len(ids), int(length)
    return codes


def decoding_table(ids: np.ndarray, lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length by the next `limit` bits."""
    dense = np.zeros(int(ids.max(initial=0)) + 1, np.uint8)
    dense[ids] = lengths
    order = np.lexsort((np.arange(len(dense)), dense))
    order = order[dense[order] > 0]
    spans = np.left_shift(1, limit - dense[order].astype(np.int64))
    table = np.repeat(order.astype(np.uint32), spans)
    steps = np.repeat(dense[order], spans)
    rest = (1 << limit) - len(table)
    return np.concatenate([table, np.zeros(rest, np.uint32)]), np.concatenate([steps, np.ones(rest, np.uint8)])


def _pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The ids' codes after each other, filled to whole bytes, and where each begins."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    start = end - size
    bits = int(end[-1])
    words = np.zeros(bits // 32 + 2, np.uint64)  # 32 bits each, with room for what runs over
    # a code ends within 64 bits from the start of the word it starts in
    shifted = codes[ids].astype(np.uint64) << (64 - (start & 31) - size).astype(np.uint64)
    word = start >> 5
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    both = np.bitwise_or.reduceat(shifted, first)
    at = word[first]
    words[at] |= both >> np.uint64(32)
    words[at + 1] |= both & np.uint64(0xFFFFFFFF)
    return words.astype(">u4").tobytes()[: (bits + 7) // 8], start


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, block_ids: int = BLOCK_IDS) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Payload, and the bit offset and ids of each block. Groups of blocks begin at whole bytes, which bounds the memory
    that packing takes."""
    blocks = np.arange(0, len(ids), block_ids)
    parts, offsets, done = [], [np.zeros(0, np.int64)], 0
    for low in range(0, len(ids), 256 * block_ids):
        data, start = _pack(ids[low : low + 256 * block_ids], codes, lengths)
        offsets.append(start[::block_ids] + 8 * done)
        parts.append(data)
        done += len(data)
    return b"".join(parts) + bytes(8), np.concatenate(offsets), np.diff(np.append(blocks, len(ids)))


def unpack(payload: bytes, offsets: np.ndarray, sizes: np.ndarray, table: np.ndarray, steps: np.ndarray, limit: int) -> np.ndarray:
    """The ids of blocks, one after the other; the blocks are decoded side by side."""
    out = np.zeros(int(sizes.sum()), np.uint32)
    begin = np.cumsum(sizes) - sizes
    data = np.frombuffer(payload + bytes(16), np.uint8)
    whole = len(data) // 4 * 4
    words = data[:whole].view(">u4").astype(np.uint64)
    pairs = (words[:-1] << np.uint64(32)) | words[1:]  # 64 bits from each 32-bit border
    for low in range(0, len(offsets), TOGETHER):
        at, left = offsets[low : low + TOGETHER].astype(np.int64), sizes[low : low + TOGETHER]
        place = begin[low : low + TOGETHER].copy()
        for i in range(int(left.max(initial=0))):
            if i and (left <= i).any():
                keep = left > i
                at, left, place = at[keep], left[keep], place[keep]
            window = (pairs[at >> 5] >> (64 - limit - (at & 31)).astype(np.uint64)).astype(np.int64) & ((1 << limit) - 1)
            out[place + i] = table[window]
            at += steps[window]
    return out


def to_bytes(ids: np.ndarray, documents: np.ndarray, lengths: np.ndarray, limit: int = LIMIT, block_ids: int = BLOCK_IDS) -> bytes:
    """A file. documents: the place of each document's first id."""
    codes = canonical(lengths)
    payload, offsets, sizes = pack(ids, codes, lengths, block_ids)
    known = np.flatnonzero(lengths)
    head = np.array([len(known), limit], "<u4").tobytes() + np.array([len(ids), len(documents), len(offsets), len(payload)], "<u8").tobytes()
    return b"".join([MAGIC, head, known.astype("<u4").tobytes(), lengths[known].tobytes(), offsets.astype("<u8").tobytes(), sizes.astype("<u4").tobytes(), documents.astype("<u8").tobytes(), payload])


class TokenFile:
    """A file opened for reading from its bytes."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        n, self.limit = (int(x) for x in np.frombuffer(data, "<u4", 2, 8))
        self.n_ids, docs, blocks, size = (int(x) for x in np.frombuffer(data, "<u8", 4, 16))
        at = 48
        ids = np.frombuffer(data, "<u4", n, at)
        lengths = np.frombuffer(data, np.uint8, n, at + 4 * n)
        at += 5 * n
        self.offsets = np.frombuffer(data, "<u8", blocks, at)
        self.sizes = np.frombuffer(data, "<u4", blocks, at + 8 * blocks).astype(np.int64)
        at += 12 * blocks
        self.documents = np.frombuffer(data, "<u8", docs, at).astype(np.int64)
        self.payload = data[at + 8 * docs : at + 8 * docs + size]
        self.table, self.steps = decoding_table(ids, lengths, self.limit)
        self.begin = np.cumsum(self.sizes) - self.sizes

    def blocks(self, first: int, last: int) -> np.ndarray:
        """The ids of the blocks from first on, before last."""
        return unpack(self.payload, self.offsets[first:last], self.sizes[first:last], self.table, self.steps, self.limit)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, np.uint32)
        first = int(np.searchsorted(self.begin, start, "right")) - 1
        last = int(np.searchsorted(self.begin, stop))
        return self.blocks(first, last)[start - self.begin[first] : stop - self.begin[first]]


# --- text to ids


class Encoder:
    """Ids by the tokenizers library, each distinct stretch between spaces once, a word and the signs after it apart.
    Text of Latin-1 characters is cut here; other text, for which the library's classes of characters decide, goes to
    the library whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {}
        self.seen: set[int] = set()
        self.copies: dict[str, bytes] = {}
        self.model, level = self.own.model, ByteLevel(add_prefix_space=False, use_regex=False)
        self.names = {i: level.pre_tokenize_str(chr(i))[0][0] for i in [32, *range(128, 256)]}  # as the model has them
        added = self.own.get_added_tokens_decoder().values()
        self.direct = self.own.normalizer is None and isinstance(self.own.pre_tokenizer, ByteLevel) and all(x.special for x in added)
        sizes = {x: len(x) for x in ByteLevel.alphabet()}  # a byte is one character of a token's name
        vocabulary = self.own.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.data = [i.to_bytes(4, "little") for i in range(len(self.sizes))]
        for name, i in vocabulary.items():
            self.sizes[i] = sum(sizes.get(x, len(x.encode())) for x in name)

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.own.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> None:
        """Words of letters are one piece each, with the space before them: the library's model gets them itself,
        without cutting and without places in a text."""
        if not self.direct:
            return self._together(words)
        known, names, data, model, space = self.known, self.names, self.data, self.model.tokenize, self.names[32]
        for c in words:
            known[c] = b"".join([data[t.id] for t in model(space + (c if c.isascii() else c.translate(names)))])

    def _together(self, stretches: list[str]) -> None:
        """Stretches that stay apart when they follow each other: one call for many, cut by the tokens' bytes."""
        for low in range(0, len(stretches), 4000):
            part = stretches[low : low + 4000]
            whole = " " + " ".join(part)
            ids = np.array(self.own.encode_batch_fast([whole], add_special_tokens=False)[0].ids, "<u4")
            text = whole.encode()  # stretches hold no spaces
            ends = np.append(np.flatnonzero(np.frombuffer(text, np.uint8) == 32)[1:], len(text))
            cuts = (4 * np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 4).tolist()
            data, at = ids.tobytes(), 0
            for c, end in zip(part, cuts):
                self.known[c] = data[at:end]
                at = end

    def _learn(self, new: list[str]) -> None:
        """The ids of a space and what stands between it and the next."""
        known, signs = self.known, self.signs
        words, ended, plain, rest = [], [], [], []
        for c in new:
            if c.isalpha():
                words.append(c)
            elif (w := c.rstrip(SIGNS)).isalpha():
                ended.append((c, w))
            elif c and not c[0].isspace() and not c[-1].isspace():
                plain.append(c)
            else:
                rest.append(c)
        words += {w for _, w in ended if w not in known}.difference(words)
        self._words(words)
        self._together(plain)
        for c, w in ended:
            end = c[len(w) :]
            if end not in signs:
                signs[end] = self._each([end])[0]
            known[c] = known[w] + signs[end]
        known.update(zip(rest, self._each([" " + c for c in rest])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text. A text that comes again is kept, for its further copies."""
        copies, seen = self.copies, self.seen
        if len(copies) >= COPIES:
            copies.clear()
        if len(seen) >= 100 * COPIES:
            seen.clear()
        new = list(dict.fromkeys(x for x in texts if x not in copies))
        found = dict(zip(new, self._encode(new)))
        out = [copies[x] if x in copies else found[x] for x in texts]
        for x in new:
            if (h := hash(x)) in seen and len(x) < 1 << 16:
                copies[x] = found[x]
            seen.add(h)
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) >= KEPT // 2:  # what is asked for again comes back from the older half
            self.older, self.known, self.signs = self.known, {}, {}
        whole: list[str] = []  # texts that can't be cut, and the others up to their first space
        rest: list[str] = []
        cut: list[int] = []
        for k, x in enumerate(texts):
            space = ""
            try:
                x.encode("latin-1")
                if splits(x):
                    x, space, after = x.partition(" ")
            except UnicodeEncodeError:
                pass
            whole.append(x)
            if space:
                rest.append(after)
                cut.append(k)
        out = self._each(whole)
        if not cut:
            return out
        parts = pc.split_pattern(pa.array(rest, pa.large_string()), " ")
        stretches = parts.flatten().dictionary_encode()
        distinct = cut_up_text(stretches.dictionary)
        known, older, new = self.known, self.older, []
        own = list(map(known.get, distinct))
        gone = [i for i, x in enumerate(own) if x is None]
        for i in gone:
            c = distinct[i]
            if c in older:
                known[c] = older[c]
            else:
                new.append(c)
        self._learn(new)
        for i in gone:
            own[i] = known[distinct[i]]
        found = pa.array(own, pa.large_binary()).take(stretches.indices)
        _, ends, held = found.buffers()
        edges = np.frombuffer(ends, np.int64)[parts.offsets.to_numpy()].tolist()
        data = held.to_pybytes() if held is not None else b""
        for k, low, high in zip(cut, edges, edges[1:]):
            out[k] += data[low:high]
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process; what it has learnt serves later tasks. (A function of the module, so that tasks
    refer to it: what they carry along themselves would be new in each.)"""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _blocks(batch: pa.Array) -> Iterator[list[str]]:
    texts, size = [], 0
    for x in byte_rows(batch):
        texts.append(x.decode("utf-8", "replace"))
        size += len(x)
        if size >= 1 << 20:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def _added(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    if len(n) > len(total):
        total = np.concatenate([total, np.zeros(len(n) - len(total), np.int64)])
    total[: len(n)] += n
    return total


def encode(docs: DataFrame, path: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids: with the end id, little-endian unsigned integers, of 16 bits if those of its neighbours fit too, behind a byte
    that gives the width in bytes. Besides, each task adds a row with `counts`: the ids that it has seen and how often,
    as 64-bit integers."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = encoder(path)
        end, total = np.array([end_id], "<u4").tobytes(), np.zeros(1 << 16, np.int64)
        names = ["doc_id", "ids", "counts"]
        for batch in batches:
            out = []
            for texts in _blocks(batch.column(1)):
                found = own.encode(texts)
                ids = np.frombuffer(end.join([*found, b""]), "<u4")
                total = _added(total, np.bincount(ids))
                width = 2 if ids.max() < 1 << 16 else 4
                data, first, at = ids.astype(f"<u{width}").tobytes(), bytes([width]), 0
                for x in found:
                    start, at = at, at + (len(x) // 4 + 1) * width
                    out.append(first + data[start:at])
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary()), pa.nulls(len(out), pa.binary())], names=names)
        used = np.flatnonzero(total)
        if len(used):
            yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([np.concatenate([used, total[used]]).astype("<i8").tobytes()])], names=names)

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), raw(text).alias("t")).mapInArrow(rows, "doc_id bigint, ids binary, counts binary")


def counts(encoded: DataFrame) -> np.ndarray:
    """How often each id occurs in all rows: the tasks' counts, added up by id. The result is as long as the
    vocabulary."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in byte_rows(batch.column(0)):
                both = np.frombuffer(x, "<i8").reshape(2, -1)
                yield pa.record_batch([pa.array(both[0]), pa.array(both[1])], names=["id", "n"])

    rows = encoded.where(F.col("counts").isNotNull()).select("counts").mapInArrow(partial, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    at, n = rows["id"].to_numpy(), rows["n"].to_numpy()
    out = np.zeros(int(at.max(initial=-1)) + 1, np.int64)
    out[at] = n
    return out


# --- files


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def _placed(encoded: DataFrame, files: int) -> DataFrame:
    """Documents in ranges of ascending doc_id, sorted; the number of the range is `p`."""
    rows = encoded.where(F.col("ids").isNotNull()).select("doc_id", "ids")
    first = F.col("doc_id").asc_nulls_first()
    if files > MOST_RANGES:
        return rows.repartitionByRange(files, first).withColumn("p", F.spark_partition_id()).sortWithinPartitions(first, "ids")
    # bounds from the doc_ids alone, so that the texts' ids needn't be read for a sample
    shares = F.array(*[F.lit(i / files) for i in range(1, files)])
    bounds = sorted(set(rows.agg(F.percentile_approx("doc_id", shares, F.lit(10_000)).alias("b")).first()["b"] or [])) if files > 1 else []
    after = F.filter(F.array(*map(F.lit, bounds)).cast("array<bigint>"), lambda b: b <= F.col("doc_id"))
    rows = rows.withColumn("p", F.coalesce(F.size(after), F.lit(0)))
    return rows.repartitionById(len(bounds) + 1, F.col("p")).sortWithinPartitions(first, "ids")


def write(encoded: DataFrame, uri: str, lengths: np.ndarray, n_ids: int, file_ids: int = FILE_IDS, limit: int = LIMIT) -> DataFrame:
    """Writes the rows in ascending doc_id order into a folder that all machines share, in files of about `file_ids` ids.
    Gives the manifest, a written table: part and seq (ascending as the doc_ids are), file, n_ids, and the doc_ids in
    order."""
    held = encoded.sparkSession.sparkContext.broadcast(lengths)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list = []
        parts: list[np.ndarray] = []
        number, seq, size = None, 0, 0
        system, folder = _filesystem(uri)
        system.create_dir(folder, recursive=True)

        def close() -> pa.RecordBatch:
            sizes = np.array([len(x) for x in parts], np.int64)
            data = to_bytes(np.concatenate(parts), np.cumsum(sizes) - sizes, held.value, limit)
            name = f"part-{number:06d}-{seq:04d}-{uuid.uuid4().hex[:8]}.lwtk"
            with system.open_output_stream(posixpath.join(folder, name), compression=None) as f:
                f.write(data)
            return pa.record_batch([pa.array([number], pa.int32()), pa.array([seq], pa.int32()), pa.array([name]), pa.array([int(sizes.sum())], pa.int64()), pa.array([docs], pa.list_(pa.int64()))], names=["part", "seq", "file", "n_ids", "docs"])

        for batch in batches:
            for i, x, p in zip(batch.column(0).to_pylist(), byte_rows(batch.column(1)), batch.column(2).to_pylist()):
                if docs and (size >= file_ids or p != number):
                    yield close()
                    docs, parts, seq, size = [], [], seq + 1, 0
                number = p
                docs.append(i)
                parts.append(np.frombuffer(x, "<u2" if x[0] == 2 else "<u4", offset=1))
                size += len(parts[-1])
        if docs:
            yield close()

    placed = _placed(encoded, max(1, -(-n_ids // file_ids)))
    return written(placed.select("doc_id", "ids", "p").mapInArrow(store, "part int, seq int, file string, n_ids bigint, docs array<bigint>"), "manifest")


def read(manifest: DataFrame, uri: str, doc_id: str = "doc_id") -> DataFrame:
    """Reads the files back. Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    files = manifest.select("part", "seq", "n_ids").orderBy("part", "seq").collect()  # one row a file
    before = dict(zip([(r["part"], r["seq"]) for r in files], np.cumsum([0, *[r["n_ids"] for r in files]]).tolist()))
    held = spark.sparkContext.broadcast(before)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _filesystem(uri)
        for batch in batches:
            for part, seq, name, docs in zip(*(c.to_pylist() for c in batch.columns)):
                with system.open_input_stream(posixpath.join(folder, name), compression=None) as f:
                    file = TokenFile(f.read())
                starts = file.documents
                sizes = np.diff(np.append(starts, file.n_ids))
                crc = [0] * len(docs)
                for low in range(0, len(file.sizes), TOGETHER):  # a document may lie in several of these stretches
                    found = file.blocks(low, low + TOGETHER).astype("<u4")
                    a = int(file.begin[low])
                    b = a + len(found)
                    data = memoryview(found.view(np.uint8))
                    first = max(0, int(np.searchsorted(starts, a, "right")) - 1)
                    for k in range(first, int(np.searchsorted(starts, b))):
                        x, y = max(int(starts[k]), a), min(int(starts[k] + sizes[k]), b)
                        if y > x:
                            crc[k] = zlib.crc32(data[4 * (x - a) : 4 * (y - a)], crc[k])
                yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(starts + held.value[part, seq]), pa.array(sizes), pa.array(crc, pa.int64())], names=[doc_id, "start", "n_tokens", "ids_crc32"])

    # a row a file: each is a task's work
    one_each = manifest.select("part", "seq", "file", "docs").repartition(max(1, len(files)))
    return one_each.mapInArrow(load, f"`{doc_id}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def save(docs: DataFrame, path: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", uri: str | None = None) -> tuple[DataFrame, str]:
    """Encodes and writes all documents; gives the manifest and the folder. One pass encodes and counts, into a written
    table; the files are made from that."""
    uri = uri or shared_path(docs.sparkSession, "token-files")
    encoded = written(encode(docs, path, end_id, doc_id, text), "ids")
    total = counts(encoded)
    return write(encoded, uri, code_lengths(total), int(total.sum())), uri
