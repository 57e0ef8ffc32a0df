"""Language-model scores by a log-bilinear neural model, trained in numpy with noise-contrastive estimation.

All words of all training texts are counted. The most frequent ones and the end of a text are classes of their own; the
others form classes by a hash of their last bytes. The model predicts a token's class from the classes of the ORDER
tokens before it: their vectors, weighed by place, add up to a prediction, whose products with the classes' output
vectors, all at once, give normalised probabilities. Within a class a word has its share of the smoothed counts, and one
unknown word has a share too, so the probabilities of all words add up to one.

Every task that reads training texts trains a replica on every token of all its texts (STRIDE is 1), from the same start,
against noise drawn from the counts; the replicas are averaged by the tokens they have seen. So counts and gradients
cover all training texts and grow with them. A replica draws its noise by the first text it reads, so scores depend, in
their last digits, on how the texts lie in files.

If the vocabulary is small enough by a count made before, tasks write the words' counts, cut by hash, to files in the
folder that all machines share, and those that score map these: no machine holds them twice, and the driver never does.
Beyond that, each text's words are joined with them. Both look words up by all their bytes and give the same scores but
for rounding.

Null and empty texts hold the end alone. Without training texts every probability is the base's. Rows are scored one by
one, texts of any length whole: repeated rows get equal scores; an empty table gives an empty table. Other columns stay
as they are, but a column of the result's name is replaced.
"""

from __future__ import annotations

import posixpath
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, cut_up, raw, shared_path, tidy, written

#: The end of a text; no word holds white space.
END = b"\n"
#: Frequent words, classes of the others, bytes that choose these; tokens before one; sizes of vectors.
FREQUENT, OTHERS, LAST_BYTES, ORDER, VECTOR = 384, 256, 3, 3, 24
#: Of the tokens, every so many is trained on (1: all); tokens and noise words of a step.
STRIDE, STEP_TOKENS, NOISE, RATE = 1, 1024, 48, 0.15
#: Words up to which all tasks get their counts, at some 35 bytes each; words of a file of them at most, about; words
#: that a worker keeps.
BROADCAST_WORDS, FILE_WORDS, KEPT = 4_000_000, 200_000, 600_000
#: Words with counts that a task adds up at once.
COUNTED = 1_000_000
#: Contexts whose probabilities are computed together, so that they stay in the processor's cache; bytes of texts scored
#: together, whose equal contexts are met once.
TOGETHER, BLOCK = 512, 2 << 20


def tokens_of(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def _split(texts: list[bytes]) -> pa.Array:
    """Each text's words, with empty ones where white space stands at its edges."""
    return pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_binary()).view(pa.large_string())))


def numbered(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct tokens, the place among them of each token of each text, and where each text's tokens end: tokens_of by
    Arrow, which takes the bytes as they are, well-formed or not."""
    held = _split(texts)
    words = held.flatten()
    is_word = pc.greater(pc.binary_length(words), 0)  # white space at a text's edges leaves empty ones
    last = np.r_[0, np.cumsum(is_word.to_numpy(zero_copy_only=False))][held.offsets.to_numpy()[1:] - held.offsets[0].as_py()]
    found = words.filter(is_word).dictionary_encode()
    distinct = cut_up(found.dictionary.view(pa.large_binary()))
    places = np.insert(found.indices.to_numpy().astype(np.int64), last, len(distinct))
    return [*distinct, END], places, last + np.arange(1, len(texts) + 1)


def other_class(word: bytes) -> int:
    return zlib.crc32(word[-LAST_BYTES:]) % OTHERS


class WordCounts:
    """Counts by word, in arrays: found by 64-bit hash, then compared byte by byte. Arrays are sorted by hash; the words'
    bytes lie end to end."""

    def __init__(self, h: np.ndarray, words: pa.Array, counts: np.ndarray):
        order = np.argsort(h, kind="stable")
        self.hashes, self.counts = h[order], counts[order]
        taken = words.cast(pa.large_binary()).take(pa.array(order))
        _, ends, held = taken.buffers()
        self.ends = np.frombuffer(ends, np.int64)[: len(order) + 1].copy() if len(order) else np.zeros(1, np.int64)
        self.bytes = np.frombuffer(held, np.uint8).copy() if held is not None else np.zeros(0, np.uint8)

    def to_bytes(self) -> bytes:
        parts = [np.array([len(self.hashes)], np.int64), self.hashes, self.counts, self.ends, self.bytes]
        return b"".join([x.tobytes() for x in parts])

    @classmethod
    def over(cls, held: pa.Buffer) -> WordCounts:
        """The same over what to_bytes gave, without a copy."""
        found = cls.__new__(cls)
        n = int(np.frombuffer(held, np.int64, 1)[0])
        found.hashes, found.counts = np.frombuffer(held, np.uint64, n, 8), np.frombuffer(held, np.int64, n, 8 + 8 * n)
        found.ends = np.frombuffer(held, np.int64, n + 1, 8 + 16 * n)
        found.bytes = np.frombuffer(held, np.uint8, int(found.ends[-1]), 16 + 24 * n)
        return found

    def of(self, words: list[bytes], asked: np.ndarray | None = None) -> np.ndarray:
        """asked: the words' hashes, if they are at hand."""
        n, out = len(words), np.zeros(len(words), np.int64)
        if not n or not len(self.hashes):
            return out
        if asked is None:
            asked = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
        order, at = np.argsort(asked), np.empty(n, np.int64)
        at[order] = np.searchsorted(self.hashes, asked[order])  # near places in a row stay in the processor's cache
        some = np.flatnonzero((at < len(self.hashes)) & (self.hashes[at.clip(max=len(self.hashes) - 1)] == asked))
        if not len(some):
            return out
        at, size = at[some], np.fromiter((len(words[i]) for i in some.tolist()), np.int64, len(some))
        begin = np.cumsum(size) - size
        text = np.frombuffer(b"".join([words[i] for i in some.tolist()]), np.uint8)
        places = np.repeat(self.ends[at] - begin, size) + np.arange(len(text))
        equal = self.bytes[places.clip(max=len(self.bytes) - 1)] == text
        same = (self.ends[at + 1] - self.ends[at] == size) & (np.add.reduceat(equal, begin) == size)  # no word is empty
        out[some[same]] = self.counts[at[same]]
        for i, k in zip(some[~same].tolist(), at[~same].tolist()):  # words of one hash, if there ever are any
            while k < len(self.hashes) and self.hashes[k] == asked[i]:
                if self.bytes[self.ends[k] : self.ends[k + 1]].tobytes() == words[i]:
                    out[i] = self.counts[k]
                k += 1
        return out


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


@dataclass
class WordFiles:
    """Counts by word in files of a folder that all machines share, one for each value of the hashes' highest bits.
    Names and numbers of bits travel with the model; a worker opens the files when it first looks a word up, and maps
    them where the folder is in its machine's file system, so its processes share one copy in the system's cache."""

    uri: str
    bits: int
    names: dict[int, str]
    held: dict[int, WordCounts] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"held": {}}

    def part(self, k: int) -> WordCounts:
        if k not in self.held:
            system, folder = _filesystem(self.uri)
            path = posixpath.join(folder, self.names[k])
            local = isinstance(system, pafs.LocalFileSystem)
            with pa.memory_map(path) if local else system.open_input_file(path) as f:
                self.held[k] = WordCounts.over(f.read_buffer())
        return self.held[k]

    def of(self, words: list[bytes]) -> np.ndarray:
        n, out = len(words), np.zeros(len(words), np.int64)
        asked = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
        parts = _part(asked, self.bits)
        order = np.argsort(parts, kind="stable")
        edge = np.flatnonzero(np.r_[True, parts[order][1:] != parts[order][:-1], True][: n + 1]) if n else np.zeros(1, np.int64)
        for low, high in zip(edge, edge[1:]):
            pick = order[low:high]
            if (k := int(parts[pick[0]])) in self.names:
                out[pick] = self.part(k).of([words[i] for i in pick.tolist()], asked[pick])
        return out


def _part(h: np.ndarray, bits: int) -> np.ndarray:
    """The highest bits of hashes."""
    return (h >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(h), np.int32)


def word_files(counts: DataFrame, v: int) -> WordFiles:
    """counts: word, c; v: their number. A file is written by the task that got its words; the names that count come
    back, one a file."""
    bits, uri = (v // FILE_WORDS).bit_length(), shared_path(counts.sparkSession, "word-files")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.fromiter(map(xxhash.xxh64_intdigest, cut_up(batch.column(0))), np.uint64, len(batch))
            yield pa.record_batch([pa.array(_part(h, bits)), pa.array(h.view(np.int64)), batch.column(0), batch.column(1)], names=["p", "h", "word", "c"])

    def store(table: pa.Table) -> pa.Table:
        held = WordCounts(table["h"].to_numpy().view(np.uint64), table["word"].cast(pa.large_binary()).combine_chunks(), table["c"].to_numpy())
        system, folder = _filesystem(uri)
        system.create_dir(folder, recursive=True)
        name = f"words-{uuid.uuid4().hex}"
        with system.open_output_stream(posixpath.join(folder, name), compression=None) as f:
            f.write(held.to_bytes())
        out = pa.table({"p": table["p"][:1], "name": [name]})
        del held, table
        tidy()
        return out

    dealt = counts.select("word", "c").mapInArrow(hashed, "p int, h bigint, word binary, c bigint")
    rows = dealt.groupBy("p").applyInArrow(store, "p int, name string").collect()
    return WordFiles(uri, bits, {r["p"]: r["name"] for r in rows})


@dataclass
class Model:
    """frequent: word to class, the end first. Classes after these are the others'. p: parameters; the last context
    vector stands for what is before a text. share: log10 of the others' smoothed totals. n, v: training tokens and
    distinct ones. words: where all words' counts lie, if they are few enough."""

    frequent: dict[bytes, int]
    p: dict[str, np.ndarray]
    share: np.ndarray
    n: int
    v: int
    words: WordFiles | WordCounts | None = None

    @property
    def base(self) -> float:
        return float(np.log10(self.n + 0.1 * (self.v + 1)))


def count_words(texts: DataFrame, text: str = "text") -> DataFrame:
    """word, c: how often each occurs. A task adds up its own words first."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = ends = 0

        def added() -> list[pa.RecordBatch]:
            total = pa.Table.from_batches(held).group_by("word").aggregate([("c", "sum")]).select(["word", "c_sum"])
            return total.rename_columns(["word", "c"]).combine_chunks().to_batches()

        for batch in batches:
            for block in _blocks(batch.column(0)):
                words = _split(block).flatten()
                found = words.filter(pc.greater(pc.binary_length(words), 0)).value_counts()
                held.append(pa.record_batch([found.field("values").view(pa.large_binary()).cast(pa.binary()), found.field("counts")], names=["word", "c"]))
                rows, ends = rows + len(found), ends + len(block)
                if rows > COUNTED:
                    held = added()
                    rows = sum(map(len, held))
                    if rows > COUNTED // 2:
                        yield from held
                        held, rows = [], 0
        if ends:
            held.append(pa.record_batch([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], names=["word", "c"]))
            yield from added()

    return texts.select(raw(text).alias("t")).mapInArrow(partial, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def _start(classes: int, unigram: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    f = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
    return {"E": f(classes + 1, VECTOR), "D": np.ones((ORDER, VECTOR), np.float32) / ORDER, "Q": f(classes, VECTOR), "b": np.log(unigram).astype(np.float32)}


def _summed(rows: np.ndarray, values: np.ndarray, n: int, taken: np.ndarray | None = None) -> np.ndarray:
    """values, or those at `taken`, added up by row number. Short numbers are sorted by their digits, which is faster."""
    order = np.argsort(rows.astype(np.int16) if n < 1 << 15 else rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    out = np.zeros((n, values.shape[1]), np.float32)
    out[rows[first]] = np.add.reduceat(values.take(order if taken is None else taken[order], axis=0), first, axis=0)
    return out


class Trainer:
    """One replica. unigram: the classes' shares of the training tokens, also the noise."""

    def __init__(self, unigram: np.ndarray, seed: int):
        self.p = _start(len(unigram), unigram)
        self.noise_share = np.log(NOISE * unigram).astype(np.float32)
        self.cumulative = np.cumsum(unigram)
        self.squares = {k: np.full_like(v, 1e-6) for k, v in self.p.items()}
        self.rng = np.random.default_rng(seed)
        self.seen = 0

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        p, n = self.p, len(target)
        classes = len(p["b"])
        noise = np.searchsorted(self.cumulative, self.rng.random(NOISE) * self.cumulative[-1]).clip(max=classes - 1)
        placed = (p["E"] * p["D"][:, None]).reshape(-1, VECTOR)  # each class's vector at each place
        at = context.T + np.arange(ORDER)[:, None] * (classes + 1)
        guess = placed.take(at[0], axis=0)
        for j in range(1, ORDER):
            guess += placed.take(at[j], axis=0)
        q_own, q_noise, bias = p["Q"].take(target, axis=0), p["Q"][noise], p["b"] - self.noise_share
        own = np.einsum("nv,nv->n", guess, q_own) + bias[target]
        d_own = (0.5 * np.tanh(0.5 * own) - 0.5) / n
        d_other = (0.5 * np.tanh(0.5 * (guess @ q_noise.T + bias[noise])) + 0.5) / n
        q_own *= d_own[:, None]
        d_guess = d_other @ q_noise + q_own
        both = np.empty((n + NOISE, VECTOR + 1), np.float32)
        both[:n, :-1], both[:n, -1] = guess * d_own[:, None], d_own
        both[n:, :-1], both[n:, -1] = d_other.T @ guess, d_other.sum(axis=0)
        out = _summed(np.concatenate([target, noise]), both, classes)
        by_place = _summed(at.ravel(), d_guess, len(placed), np.tile(np.arange(n), ORDER)).reshape(ORDER, classes + 1, VECTOR)
        g = {"Q": out[:, :-1], "b": out[:, -1], "D": np.einsum("ocv,cv->ov", by_place, p["E"]), "E": np.einsum("ocv,ov->cv", by_place, p["D"])}
        for k, grad in g.items():
            self.squares[k] += grad * grad
            p[k] -= RATE * grad / np.sqrt(self.squares[k])
        self.seen += n


def contexts(classes: np.ndarray, ends: np.ndarray, outside: int) -> np.ndarray:
    """For each token the classes of the ORDER tokens before it in its text, the nearest first. ends: after each text."""
    start = np.repeat(np.r_[0, ends[:-1]], np.diff(np.r_[0, ends]))
    at = np.arange(len(classes))
    out = np.empty((len(classes), ORDER), np.int64)
    for j in range(ORDER):
        before = at - 1 - j
        out[:, j] = np.where(before >= start, classes[np.maximum(before, 0)], outside)
    return out


class Classes(dict):
    """Word to class; what it has worked out is kept, up to KEPT words."""

    def __init__(self, frequent: dict[bytes, int]):
        super().__init__(frequent)
        self.frequent = frequent

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
            self.update(self.frequent)
        found = self[word] = self.frequent[word] if word in self.frequent else len(self.frequent) + other_class(word)
        return found

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The class of each token, and where each text's tokens end."""
        words, at, ends = numbered(texts)
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))[at], ends


def train(texts: DataFrame, frequent: dict[bytes, int], unigram: np.ndarray, text: str = "text", stride: int = STRIDE) -> dict[str, np.ndarray]:
    """One pass over the training texts, a replica a task; the average, weighed by tokens."""
    held = texts.sparkSession.sparkContext.broadcast((frequent, unigram))
    names = ["E", "D", "Q", "b"]

    def replica(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, share = held.value
        known = Classes(own)
        trainer, number = None, 0
        for batch in batches:
            texts_, size = [], 0

            def learn() -> None:
                nonlocal trainer, number
                classes, ends = known.of(texts_)
                if trainer is None:  # the noise is told apart by what the task reads
                    trainer = Trainer(share, zlib.crc32(texts_[0]))
                place = np.arange(len(classes))
                place = place[(place + number) % stride == 0]
                number += len(classes)
                before = contexts(classes, ends, len(share))[place]
                order = trainer.rng.permutation(len(place))
                for low in range(0, len(order), STEP_TOKENS):
                    pick = order[low : low + STEP_TOKENS]
                    trainer.step(before[pick], classes[place[pick]])

            for x in byte_rows(batch.column(0)):
                texts_.append(x)
                size += len(x)
                if size >= 1 << 20:
                    learn()
                    texts_, size = [], 0
            if texts_:
                learn()
        if trainer is not None and trainer.seen:
            flat = np.concatenate([trainer.p[k].ravel() for k in names]).astype(np.float64) * trainer.seen
            yield pa.record_batch([pa.array([trainer.seen], pa.int64()), pa.array([flat.tobytes()])], names=["n", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            n += sum(batch.column(0).to_pylist())
            for x in batch.column(1):
                part = np.frombuffer(x.as_py())
                total = part if total is None else total + part
        if n:
            yield pa.record_batch([pa.array([n], pa.int64()), pa.array([total.tobytes()])], names=["n", "sums"])

    kind = "n bigint, sums binary"
    replicas = written(texts.select(raw(text).alias("t")).mapInArrow(replica, kind), "replicas")
    sums = replicas.repartition(16).mapInArrow(add, kind).collect()  # 16 rows, whatever the input
    p = _start(len(unigram), unigram)
    seen = sum(r["n"] for r in sums)
    if seen:
        flat, at = sum(np.frombuffer(r["sums"]) for r in sums) / seen, 0
        for k in names:
            p[k] = flat[at : at + p[k].size].reshape(p[k].shape).astype(np.float32)
            at += p[k].size
    return p


def fit(texts: DataFrame, text: str = "text", broadcast_words: int = BROADCAST_WORDS) -> tuple[Model, DataFrame]:
    """The model, and the words' counts as a written table."""
    counts = written(count_words(texts, text), "words")
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = int(total["n"] or 0), int(total["v"])
    if not n:
        return Model({}, {}, np.zeros(0), 0, 0, WordCounts(np.zeros(0, np.uint64), pa.array([], pa.binary()), np.zeros(0, np.int64))), counts
    top = counts.where(F.col("word") != F.lit(END)).orderBy(F.desc("c"), "word").limit(FREQUENT).collect()
    ends = n - int(counts.where(F.col("word") != F.lit(END)).agg(F.sum("c")).first()[0] or 0)
    frequent = {END: 0} | {bytes(r["word"]): i + 1 for i, r in enumerate(top)}
    own = np.array([ends, *(r["c"] for r in top)], np.float64)

    size = F.octet_length("word")
    last = F.substring("word", F.greatest(size - LAST_BYTES + 1, F.lit(1)), F.lit(LAST_BYTES))
    rest = counts.where(~F.col("word").isin([bytearray(w) for w in frequent])).groupBy(F.pmod(F.crc32(last), F.lit(OTHERS)).alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    totals = np.full(OTHERS, 0.1)
    for r in rest:
        totals[r["k"]] += r["c"] + 0.1 * r["v"]
    unigram = np.concatenate([own + 0.1, totals])
    model = Model(frequent, train(texts, frequent, unigram / unigram.sum(), text), np.log10(totals), n, v)
    if v <= broadcast_words:
        model.words = word_files(counts, v)
    return model, counts


def class_scores(model: Model, classes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """log10 probability of each token's class; normalised over all classes. What a context's probabilities add up to is
    worked out once for all tokens that share it."""
    p = model.p
    bias, out = p["b"], np.empty(len(classes), np.float64)
    n = len(bias)
    placed = [np.ascontiguousarray(p["E"] * d) for d in p["D"]]
    output = np.ascontiguousarray(np.c_[p["Q"], bias].T)
    before = contexts(classes, ends, n)
    code = before[:, 0]
    for j in range(1, ORDER):  # ORDER numbers up to n as one
        code = code * (n + 1) + before[:, j]
    order = np.argsort(code)
    new = np.r_[True, code[order][1:] != code[order][:-1]][: len(code)]
    first, which = np.flatnonzero(new), np.cumsum(new) - 1
    own_classes, ones = classes[order], np.ones(n, np.float32)
    longest, high = float(np.linalg.norm(p["Q"], axis=1).max()), float(bias.max())
    guess, logits = np.ones((TOGETHER, VECTOR + 1), np.float32), np.empty((TOGETHER, n), np.float32)
    for low in range(0, len(first), TOGETHER):
        part = before[order[first[low : low + TOGETHER]]]
        k = len(part)
        vectors = placed[0][part[:, 0]]
        for j in range(1, ORDER):
            vectors += placed[j][part[:, j]]
        guess[:k, :-1] = vectors
        np.matmul(guess[:k], output, out=logits[:k])
        begin, end = first[low], first[low + TOGETHER] if low + TOGETHER < len(first) else len(code)
        row = which[begin:end] - low
        own = logits[row, own_classes[begin:end]].astype(np.float64)
        top = np.zeros(k)
        if np.sqrt((vectors * vectors).sum(axis=1).max()) * longest + high > 60:  # else no exponential overflows
            top = logits[:k].max(axis=1).astype(np.float64)
            logits[:k] -= top[:, None]
        np.exp(logits[:k], out=logits[:k])
        total = top + np.log((logits[:k] @ ones).astype(np.float64))
        out[order[begin:end]] = own - total[row]
    return out / np.log(10)


class Numbers(dict):
    """Word to a number of its own; `new` lists the words that came last."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        self.new.append(word)
        return found


class Scorer:
    """Scores texts in a worker; what it has looked up of words serves later texts."""

    def __init__(self, model: Model):
        self.model = model
        self.empty()

    def empty(self) -> None:
        self.number = Numbers()
        self.kind = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)

    def classes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of each token, where each text's tokens end and where they begin."""
        if len(self.number) >= KEPT:
            self.empty()
        words, at, ends = numbered(texts)
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))[at]
        new = self.number.new
        if new:
            frequent, first = self.model.frequent, len(self.model.frequent)
            self.kind = np.concatenate([self.kind, np.array([frequent[w] if w in frequent else first + other_class(w) for w in new], np.int64)])
            if self.model.words is not None:
                self.count = np.concatenate([self.count, self.model.words.of(new)])
            self.number.new = []
        return at, ends, np.r_[0, ends[:-1]]

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base_score, score; the words' counts are at hand."""
        model = self.model
        at, ends, begin = self.classes(texts)
        log_count = np.log10(self.count[at] + 0.1)
        base = np.add.reduceat(log_count, begin) - (ends - begin) * model.base
        known = np.add.reduceat((self.count[at] > 0).astype(np.int64), begin)
        if not model.n:
            return ends - begin, known, base, base
        kind, first = self.kind[at], len(model.frequent)
        token = class_scores(model, kind, ends)
        other = kind >= first
        token[other] += log_count[other] - model.share[kind[other] - first]
        return ends - begin, known, base, np.add.reduceat(token, begin)

    def apart(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[list[tuple[bytes, int]]]]:
        """n_tokens, the part of the score that needs no counts, and each text's words with how often they occur."""
        model = self.model
        at, ends, begin = self.classes(texts)
        kind, first = self.kind[at], len(model.frequent)
        token = class_scores(model, kind, ends)
        other = kind >= first
        token[other] -= model.share[kind[other] - first]
        return ends - begin, np.add.reduceat(token, begin), [list(Counter(x).items()) for x in map(tokens_of, texts)]


def _blocks(batch: pa.Array, size: int = BLOCK) -> Iterator[list[bytes]]:
    texts, held = [], 0
    for x in byte_rows(batch):
        texts.append(x)
        held += len(x)
        if held >= size:
            yield texts
            texts, held = [], 0
    if texts:
        yield texts


_SCORERS: dict[int, Scorer] = {}


def _scorer(model: Model) -> Scorer:
    if id(model) not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[id(model)] = Scorer(model)
    return _SCORERS[id(model)]


def score(docs: DataFrame, model: Model, counts: DataFrame, text: str = "text", to: str = "lm") -> DataFrame:
    """Adds a struct: n_tokens, n_known, base_score, score."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = "struct<n_tokens:bigint,n_known:bigint,base_score:double,score:double>"
    if model.words is not None:

        @F.arrow_udf(kind)
        def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = _scorer(held.value)
            for batch in batches:
                found = [own.score(x) for x in _blocks(batch)]
                columns = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2
                yield pa.StructArray.from_arrays([pa.array(x) for x in columns], ["n_tokens", "n_known", "base_score", "score"])

        return docs.withColumn(to, of(raw(text)))

    @F.arrow_udf("struct<n_tokens:bigint,part:double,words:array<struct<word:binary,n:bigint>>>")
    def part(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _scorer(held.value)
        words = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
        for batch in batches:
            n, parts, bags = [np.zeros(0, np.int64)], [np.zeros(0)], []
            for x in _blocks(batch):
                a, b, c = own.apart(x)
                n.append(a)
                parts.append(b)
                bags += [[{"word": w, "n": k} for w, k in bag] for bag in c]
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(n)), pa.array(np.concatenate(parts)), pa.array(bags, words)], ["n_tokens", "part", "words"])

    others = [c for c in docs.columns if c != to]
    rows = written(docs.select(F.struct(*others).alias("__own"), part(raw(text)).alias("__part"), F.monotonically_increasing_id().alias("__row")), "parts")
    bag = rows.select("__row", F.explode("__part.words").alias("x")).select("__row", "x.word", "x.n")
    found = bag.join(counts, "word", "left")
    log_count = F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))
    is_frequent = F.col("word").isin([bytearray(w) for w in model.frequent])
    sums = found.groupBy("__row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_known"), F.sum(F.col("n") * log_count).alias("all"), F.sum(F.when(is_frequent, 0.0).otherwise(F.col("n") * log_count)).alias("rest"))
    n = F.col("__part.n_tokens")
    whole = F.struct(n.alias("n_tokens"), "n_known", (F.col("all") - n * model.base).alias("base_score"), (F.col("__part.part") + F.col("rest")).alias("score"))
    return rows.join(sums, "__row").select("__own.*", whole.alias(to))


def known_share(lm: str = "lm") -> Column:
    """The share of a text's tokens that occur in the training texts."""
    return F.col(f"{lm}.n_known") / F.col(f"{lm}.n_tokens")
