"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of up to ORDER bytes is counted once, from labelled texts, and then frozen. A
text's code length under a language is exact: at each byte the longest context that the tree knows gives the byte's
length (escape method C), or the length of an escape and then that of the next shorter context, down to one in 256.
The language with the shortest code wins; the score is its share of 2 to the minus code length.

As the statistics are frozen, the lengths of a byte under all languages depend on the last ORDER + 1 bytes alone. The
trees are therefore kept as tables of byte strings, one row of lengths for all languages each, and a text is scored by
looking up its longest known string at every byte.

Null texts, and texts without a letter, get `und` and score 0. Ties go to the language first in the alphabet. Where
nothing can be learnt (no labelled rows) all texts get `und`. Rows are scored one by one: repeated rows get equal
results, an empty table gives an empty table, other columns stay as they
are, but a column of the result's name is replaced. A text of any length is scored whole, in
blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, raw, tidy

UNDETERMINED = "und"
#: Context bytes; bytes of labelled text learnt from for each language (about, and the longest single text).
ORDER, LEARN_BYTES = 4, 1_500_000
#: Bytes scored at a time.
BLOCK = 1 << 19
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_LETTER = re.compile(rb"[A-Za-z]")


class GramTable:
    """Byte strings of one length, packed into integers, with a row of numbers each; open addressing, looked up in bulk."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        self.rows = rows
        self.bits = max(4, int(np.ceil(np.log2(4 * max(1, len(keys))))))
        size = 1 << self.bits
        self.slots = np.full(size, EMPTY)
        self.at = np.zeros(size, np.int32)
        left, slot = np.arange(len(keys)), self.slot(keys)
        while len(left):
            free = self.slots[slot] == EMPTY
            first = np.unique(np.where(free, slot, -1), return_index=True)
            take = first[1][first[0] >= 0]
            self.slots[slot[take]], self.at[slot[take]] = keys[left[take]], left[take]
            rest = np.ones(len(left), bool)
            rest[take] = False
            left, slot = left[rest], (slot[rest] + 1) & (size - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers; -1 where a key is unknown."""
        slot = self.slot(keys)
        held = self.slots[slot]
        out = np.where(held == keys, self.at[slot], np.int32(-1))
        left = np.flatnonzero((held != keys) & (held != EMPTY))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & (len(self.slots) - 1)
            held, asked = self.slots[slot], keys[left]
            good = held == asked
            out[left[good]] = self.at[slot[good]]
            more = ~good & (held != EMPTY)
            left, slot = left[more], slot[more]
        return out


@dataclass
class Model:
    """languages; lengths[k]: code lengths in bits of the last byte of known strings of k + 1 bytes, by language;
    escapes[k]: the bits of an escape from such a string as context, 0 where the language doesn't know it."""

    languages: list[str]
    order: int
    lengths: list[GramTable]
    escapes: list[np.ndarray]


def _grams(stream: np.ndarray, k: int) -> np.ndarray:
    """The k bytes that end at each place from k - 1 on, the last byte lowest."""
    out = np.zeros(len(stream) - k + 1, np.uint64)
    for j in range(k):
        out = (out << np.uint64(8)) | stream[j : len(stream) - k + 1 + j].astype(np.uint64)
    return out


def _padded(texts: list[bytes], order: int) -> bytes:
    pad = b"\n" * order
    return b"".join(pad + x.lower() for x in texts)


def learn(texts: dict[str, list[bytes]], order: int = ORDER) -> Model:
    languages = sorted(texts)
    streams = [np.frombuffer(_padded(texts[x], order), np.uint8) for x in languages]
    counts = []  # by length and language: strings and how often they occur
    for k in range(1, order + 2):
        counts.append([np.unique(_grams(s, k), return_counts=True) if len(s) >= k else (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for s in streams])
    tables: list[GramTable] = []
    escapes: list[np.ndarray] = []
    for k in range(1, order + 2):
        union = np.unique(np.concatenate([c[0] for c in counts[k - 1]])) if k > 1 else np.arange(256, dtype=np.uint64)
        if k == 1:
            shorter = np.full((256, len(languages)), 8.0)
        else:
            suffix = union & np.uint64((1 << 8 * (k - 1)) - 1)
            shorter = tables[-1].rows[tables[-1].find(suffix)]
        rows = shorter.astype(np.float64).copy()
        for at, (keys, n) in enumerate(counts[k - 1]):
            if not len(keys):
                continue
            contexts, first = np.unique(keys >> np.uint64(8), return_index=True)
            total, kinds = np.add.reduceat(n, first), np.diff(np.append(first, len(keys)))
            place = np.searchsorted(contexts, union >> np.uint64(8)).clip(max=len(contexts) - 1)
            known = contexts[place] == union >> np.uint64(8)
            whole = (total + kinds)[place].astype(np.float64)
            mine = np.searchsorted(keys, union).clip(max=len(keys) - 1)
            seen = keys[mine] == union
            rows[:, at] = np.where(seen, np.log2(whole) - np.log2(n[mine]), np.where(known, np.log2(whole) - np.log2(kinds[place]) + shorter[:, at], shorter[:, at]))
        tables.append(GramTable(union, rows.astype(np.float32)))
        escape = np.zeros((len(union), len(languages)), np.float32)
        if k <= order:
            for at, (keys, n) in enumerate(counts[k]):
                if len(keys):
                    contexts, first = np.unique(keys >> np.uint64(8), return_index=True)
                    total, kinds = np.add.reduceat(n, first), np.diff(np.append(first, len(keys)))
                    place = tables[-1].find(contexts)
                    escape[place[place >= 0], at] = (np.log2(total + kinds) - np.log2(kinds))[place >= 0]
        escapes.append(escape)
    return Model(languages, order, tables, escapes)


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Bits of each text under each language."""
    order, n = model.order, len(model.languages)
    stream = np.frombuffer(_padded(texts, order), np.uint8)
    sizes = np.array([len(x) for x in texts], np.int64)
    starts = np.cumsum(sizes + order) - sizes
    out = np.zeros((len(texts), n))
    for low in range(order, len(stream), BLOCK):
        high = min(low + BLOCK, len(stream))
        grams = _grams(stream[low - order : high], order + 1)
        bits = np.zeros((high - low + 1, n), np.float32)
        left = None  # all places
        for k in range(order, -1, -1):
            keys = (grams if left is None else grams[left]) & np.uint64((1 << 8 * (k + 1)) - 1)
            found = model.lengths[k].find(keys) if k else keys.astype(np.int32)
            hit = found >= 0
            if left is None:
                np.take(model.lengths[k].rows, np.maximum(found, 0), axis=0, out=bits[:-1])
                left = np.flatnonzero(~hit)
                bits[left] = 0
            else:
                bits[left[hit]] += model.lengths[k].rows[found[hit]]
                left = left[~hit]
            if not len(left):
                break
            context = keys[~hit] >> np.uint64(8)
            place = model.lengths[k - 1].find(context) if k > 1 else context.astype(np.int32)
            know = place >= 0
            bits[left[know]] += model.escapes[k - 1][place[know]]
        first = max(0, int(np.searchsorted(starts, low, "right")) - 1)
        last = int(np.searchsorted(starts, high))
        a = (starts[first:last] - low).clip(0, high - low)
        b = (starts[first:last] + sizes[first:last] - low).clip(0, high - low)
        some = b > a
        if some.any():
            edges = np.stack([a[some], b[some]], 1).ravel()
            sums = np.add.reduceat(bits, edges, axis=0, dtype=np.float64)[::2]
            out[first:last][some] += sums
    return out


def has_letter(text: bytes) -> bool:
    return _LETTER.search(text) is not None or any(map(str.isalpha, text.decode("utf-8", "replace")))


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", order: int = ORDER, learn_bytes: int = LEARN_BYTES) -> Model:
    """Learns from about `learn_bytes` of each language's texts, chosen by a hash of key and text; texts longer than
    that alone are left out. The key only chooses, it is no input."""
    rows = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).alias("l"), raw(text).alias("t"), F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("h"))
    size = F.octet_length("t")
    totals = {r["l"]: r["n"] for r in rows.where(size <= learn_bytes).groupBy("l").agg(F.sum(size).alias("n")).collect()}
    totals = {k: n for k, n in totals.items() if n}
    if not totals:
        return Model([], order, [], [])
    span = 1 << 30
    share = F.create_map(*[x for k, n in sorted(totals.items()) for x in (F.lit(k), F.lit(min(span, int(span * learn_bytes / n))))])
    chosen = rows.where((size <= learn_bytes) & (F.pmod("h", F.lit(span)) < F.element_at(share, F.col("l")))).select("l", "t").toArrow()
    texts: dict[str, list[bytes]] = {}
    for language, data in zip(chosen["l"].to_pylist(), chosen["t"].to_pylist()):
        texts.setdefault(language, []).append(data)
    return learn({k: sorted(v) for k, v in texts.items() if sum(map(len, v))}, order)


def predict(docs: DataFrame, model: Model, text: str = "text", to: str = "language") -> DataFrame:
    """Adds a struct: lang_pred, score."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = held.value
        for batch in batches:
            names, scores, texts, size = [], [], [], 0

            def flush() -> None:
                letters = [bool(own.languages) and has_letter(x) for x in texts]
                asked = [x for x, ok in zip(texts, letters) if ok]
                bits = code_lengths(own, asked) if asked else np.zeros((0, 1))
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(bits.min(axis=1, keepdims=True) - bits).sum(axis=1)
                found = zip(best.tolist(), share.tolist())
                for ok in letters:
                    language, p = next(found) if ok else (None, 0.0)
                    names.append(UNDETERMINED if language is None else own.languages[language])
                    scores.append(p)
                texts.clear()

            for x in byte_rows(batch):
                texts.append(x)
                size += len(x)
                if size >= 2 * BLOCK:
                    flush()
                    size = 0
            if texts:
                flush()
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])
        tidy()

    return docs.withColumn(to, score(raw(text)))


def is_rejected(lang_pred: Column, score: Column, least: float = 0.5) -> Column:
    """Rows without a language, and those whose language has less than `least` of the weight."""
    return (lang_pred == UNDETERMINED) | (score < least)
