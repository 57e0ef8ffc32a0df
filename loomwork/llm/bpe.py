"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is one token that can end its encoding: the token must be what merging its own
bytes gives, and it must be able to stand after the token that ends the prefix before it. Storing that token for each
prefix encodes a piece in one pass, makes appending exact (earlier entries never change) and lets an edit be encoded
anew from its place on, as far as the entries differ.

Null texts encode as empty ones. Ill-formed UTF-8 is read with replacement characters. Equal rows give equal results;
an empty table gives an empty table; texts of any length are encoded whole. Other columns stay as they are, but a column
of the result's name is replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, raw, tidy
from .pieces import PATTERN, splits

#: Entries that a worker keeps of pieces, of what stands between spaces, and of pairs of tokens.
PIECES, CHUNKS, PAIRS = 600_000, 400_000, 400_000
NEVER = 1 << 40


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Kept(dict):
    """A table of what has been worked out, of `most` entries: when it is half full, it becomes the older half, whose
    entries come back as they are asked for, and what no one asks for is dropped."""

    def __init__(self, work_out, most: int):
        self.work_out, self.half, self.older = work_out, most // 2, {}

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key)
        if found is None:
            found = self.work_out(key)
        if len(key) <= 64:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


class PrefixEncoder:
    """Encodes and decodes by a table of ranks; `pattern` cuts a text into the pieces that are encoded separately.
    entries: the share of the usual sizes that the tables of what has been worked out get."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, entries: float = 1):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, ranks))
        self.find = regex.compile(pattern).findall
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._pairs: dict[int, bool] = {}
        self.most_pairs = int(PAIRS * entries)
        self._pieces = Kept(self._ids, int(PIECES * entries))
        self._chunks = Kept(self._after_space, int(CHUNKS * entries)) if pattern == PATTERN else None

    def merged(self, data: bytes, below: int = NEVER) -> list[int]:
        """Merging by lowest rank, leftmost first, with ranks below a limit only: the definition the rest rests on."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte and for a token that merging never makes."""
        found = self._parts.get(token, 0)
        if found == 0:
            data = self.tokens[token]
            halves = self.merged(data, token) if len(data) > 1 else []
            found = self._parts[token] = (halves[0], halves[1]) if len(halves) == 2 else None
        return found

    def stands(self, token: int) -> bool:
        return len(self.tokens[token]) == 1 or self.parts(token) is not None

    def follows(self, left: int, right: int) -> bool:
        """Whether the right token stands, and merging the bytes of both tokens gives just these two. Seen backwards in time, the symbols at the
        border are taken apart one by one, the last made first; a merge across the border of lower rank than what
        consumed either symbol would have come first. Of equal ranks the left one comes first."""
        tokens, ranks = self.tokens, self.ranks
        x, y, end_x, end_y, found = left, right, NEVER, NEVER, self.stands(right)
        while found:
            rank = ranks.get(tokens[x] + tokens[y])
            if rank is not None and rank < end_x and rank <= end_y:
                found = False
                break
            cut_x, cut_y = self.parts(x), self.parts(y)
            if cut_x is None and cut_y is None:
                break
            if cut_y is None or cut_x is not None and x > y:
                x, end_x = cut_x[1], x
            else:
                y, end_y = cut_y[0], y
        if len(self._pairs) >= self.most_pairs:
            self._pairs.clear()
        self._pairs[left << 32 | right] = found
        return found

    def extend(self, data: bytes, last: list[int], old: list[int] | None = None, shift: int = 0, settled: int = 0) -> list[int]:
        """Appends to `last` the last token of each further prefix of `data`. With `old`, the entries before an edit
        that moved what follows by `shift`: once as many entries agree as the longest token has bytes, past `settled`,
        the rest is taken over."""
        rank, pair, longest = self.ranks.get, self._pairs.get, self.longest
        agreed = 0
        for end in range(len(last) + 1, len(data) + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = rank(data[start:end])
                if token is None:
                    continue
                if start:
                    fits = pair(last[start - 1] << 32 | token)
                    if fits is None:
                        fits = self.follows(last[start - 1], token)
                else:
                    fits = self.stands(token)
                if fits:
                    last.append(token)
                    break
            if old is not None and end > settled:
                agreed = agreed + 1 if old[end - shift - 1] == last[-1] else 0
                if agreed >= self.longest:
                    return last + old[end - shift :]
        return last

    def walk(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.tokens[out[-1]])
        return out[::-1]

    def piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.walk(self.extend(data, []))

    def _ids(self, piece: str) -> bytes:
        return np.array(self.piece(piece.encode("utf-8", "replace")), "<u4").tobytes()

    def _after_space(self, chunk: str) -> bytes:
        """The ids of a space and what stands between it and the next."""
        return b"".join(map(self._pieces.__getitem__, self.find(" " + chunk)))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self._chunks is not None and splits(text):
            first, *rest = text.split(" ")
            return b"".join(map(self._pieces.__getitem__, self.find(first))) + b"".join(map(self._chunks.__getitem__, rest))
        return b"".join(map(self._pieces.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class EditablePiece:
    """A piece whose encoding follows appends and edits; equal to encoding it afresh without the whole-piece shortcut."""

    def __init__(self, encoder: PrefixEncoder, data: bytes = b""):
        self.encoder, self.data = encoder, data
        self.last = encoder.extend(data, [])

    def append(self, more: bytes) -> None:
        self.data += more
        self.encoder.extend(self.data, self.last)

    def replace(self, start: int, end: int, new: bytes) -> None:
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = self.encoder.extend(self.data, old[:start], old, shift, start + len(new))

    def ids(self) -> list[int]:
        return self.encoder.walk(self.last)


_ENCODERS: dict[tuple[str, str, float], PrefixEncoder] = {}


def encoder(path: str, pattern: str, entries: float = 1) -> PrefixEncoder:
    """One encoder for each worker process; what it has learnt of pieces serves later tasks. entries: the share of the
    tables' usual sizes."""
    if (path, pattern, entries) not in _ENCODERS:
        _ENCODERS[path, pattern, entries] = PrefixEncoder(read_ranks(path), pattern, entries)
    return _ENCODERS[path, pattern, entries]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", to: str = "ids") -> DataFrame:
    """Adds a binary column: the text's ids as little-endian unsigned 32-bit integers. `path` must hold the rank file
    on every machine."""

    @F.arrow_udf("binary")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(path, pattern)
        for batch in batches:
            yield pa.array([own.encode(x.decode("utf-8", "replace")) for x in byte_rows(batch)], pa.binary())

    return docs.withColumn(to, ids(raw(text)))


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds a binary column: the bytes that the ids stand for."""

    @F.arrow_udf("binary")
    def data(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(path, pattern)
        for batch in batches:
            yield pa.array([own.decode(x) for x in byte_rows(batch)], pa.binary())

    return docs.withColumn(to, data(F.col(ids)))


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", keep_ids: bool = False, to: str = "bpe", entries: float = 1, release: bool = False) -> DataFrame:
    """Encodes and decodes each text and adds a struct: the ids' number and SHA-256, and that of the decoded bytes; with
    `keep_ids` the ids too. One pass, so that the ids need not leave the worker. release: a task leaves its worker no
    tables, for jobs that use the workers' memory otherwise afterwards."""
    names = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary()]

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string" + ",ids:binary" * keep_ids + ">")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(path, pattern, entries)
        for batch in batches:
            rows = []
            for x in byte_rows(batch):
                ids = own.encode(x.decode("utf-8", "replace"))
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest(), ids if keep_ids else None))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.StructArray.from_arrays([pa.array(x, k) for x, k, _ in zip(columns, kinds, names)], names)
        if release:
            own = None
            _ENCODERS.clear()
            tidy()

    return docs.withColumn(to, both(raw(text)))
