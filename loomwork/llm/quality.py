"""Quality by a convolutional network over bytes, trained and run in numpy.

Each byte has a learned vector, and beside it how long the bytes up to it have repeated what is a few bytes before them.
Learned filters over WIDTH bytes, every STRIDE bytes, are pooled by their maximum over chunks of CHUNK bytes. Chunks
overlap and cover the whole text. Over a text's chunks the pooled values are averaged, and their maximum and minimum
taken; with the text's length, a hidden layer and a logistic unit combine these into one probability.

Null and empty texts are scored as one chunk of padding. Without any labelled row the score is 0.5; with labels of one
class only, that class's value. Repeated rows get equal scores; an empty table gives an empty table; other columns stay
as they are, but a column of the result's name is replaced. Very long texts are scored whole. Labels that are null are not learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, labelled_sample, raw, tidy

#: Bytes of a filter and between its places; sizes of a byte's vector, and of the filter bank and the hidden layer.
WIDTH, STRIDE, VECTOR, FILTERS, HIDDEN = 8, 2, 8, 40, 16
#: How far back bytes are compared, bytes that must agree, and the longest repetition that is told from longer ones.
LAGS, AGREE, LONGEST = range(2, 25), 8, 96
#: Zero bytes before a text, so that nothing looks into the text before it.
LEAD = 32
#: Bytes of a chunk, and the parts it is pooled from; chunks start every CHUNK - PART bytes.
CHUNK, PART = 512, 128
#: Labelled rows learnt from, of each class at most, and the longest text among them; passes over that many rows.
LEARN_ROWS, LEARN_BYTES, PASSES, MOST_PASSES = 1500, 30_000, 12, 30
#: Bytes convolved together.
BLOCK = 1 << 18


@dataclass
class Model:
    p: dict[str, np.ndarray]
    shift: float = 0.0
    constant: float | None = None


def lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts after each other, each after LEAD zero bytes and filled with zeros to whole parts; parts per text."""
    parts = np.array([-(-(len(x) + LEAD) // PART) for x in texts])
    out = bytearray()
    for x, n in zip(texts, parts):
        out += bytes(LEAD)
        out += x
        out += bytes(int(n) * PART - LEAD - len(x))
    return np.frombuffer(bytes(out) + bytes(WIDTH), np.uint8), parts


def repetition(stream: np.ndarray) -> np.ndarray:
    """For each byte, over LONGEST, how many bytes up to it belong to stretches that repeat earlier ones."""
    n = len(stream)
    held = np.zeros(n, bool)
    for lag in LAGS:
        if n <= lag + AGREE:
            break
        same = stream[lag:] == stream[:-lag]
        width = 1
        while width < AGREE:  # whether all of the last `width` bytes agree, by doubling
            same[width:] &= same[:-width]
            same[:width] = False
            width *= 2
        held[lag:] |= same
    held &= stream != 0
    at = np.arange(n)
    start = np.maximum.accumulate(np.where(held, 0, at + 1))
    return (np.minimum(at + 1 - start, LONGEST) * np.float32(1 / LONGEST)).astype(np.float32)


def _inputs(p: dict, stream: np.ndarray, repeats: np.ndarray) -> np.ndarray:
    out = np.empty((*stream.shape, VECTOR + 1), p["E"].dtype)
    out[..., :VECTOR] = p["E"][stream]
    out[..., VECTOR] = repeats
    return out


def _bank(p: dict) -> np.ndarray:
    """The filters by pairs of bytes: WIDTH / STRIDE slices beside each other."""
    return p["F"].reshape(WIDTH // STRIDE, STRIDE * (VECTOR + 1), FILTERS).transpose(1, 0, 2).reshape(STRIDE * (VECTOR + 1), -1)


def _parts(p: dict, stream: np.ndarray, repeats: np.ndarray, where: bool = False):
    """The filters' largest values over each part, before the bias; with `where`, also the places."""
    slices, bank = WIDTH // STRIDE, _bank(p)
    n = (len(stream) - WIDTH) // PART
    out, at = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.int64) if where else None
    step = BLOCK // PART
    for low in range(0, n, step):
        high = min(n, low + step)
        places = (high - low) * PART // STRIDE
        own = slice(low * PART, high * PART + WIDTH - STRIDE)
        vectors = _inputs(p, stream[own], repeats[own]).reshape(places + slices - 1, STRIDE * (VECTOR + 1))
        product = vectors @ bank
        total = product[:places, :FILTERS].copy()
        for j in range(1, slices):
            total += product[j : j + places, j * FILTERS : (j + 1) * FILTERS]
        total = total.reshape(high - low, PART // STRIDE, FILTERS)
        out[low:high] = total.max(axis=1)
        if where:
            at[low:high] = total.argmax(axis=1) * STRIDE + (np.arange(low, high) * PART)[:, None]
    return out, at


def _chunks(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last part of every chunk, and chunks per text."""
    width, step = CHUNK // PART, CHUNK // PART - 1
    per = np.maximum(1, -(-(parts - 1) // step))
    text = np.repeat(np.arange(len(parts)), per)
    begin = np.cumsum(parts) - parts
    first = begin[text] + (np.arange(len(text)) - (np.cumsum(per) - per)[text]) * step
    return first, np.minimum(first + width, (begin + parts)[text]) - 1, per


def _features(pooled: np.ndarray, parts: np.ndarray, sizes: np.ndarray):
    """Per text: mean, maximum and minimum over its chunks of the chunks' largest values, and its length."""
    first, last, per = _chunks(parts)
    edges = np.stack([first, last + 1], 1).ravel()
    value = np.maximum.reduceat(np.concatenate([pooled, pooled[:1]]), edges, axis=0)[::2]
    begin = np.cumsum(per) - per
    value = np.maximum(value, 0)
    return np.concatenate([np.add.reduceat(value, begin, axis=0) / per[:, None], np.maximum.reduceat(value, begin, axis=0), np.minimum.reduceat(value, begin, axis=0), np.log1p(sizes)[:, None] / 10], axis=1), (first, last, per, value)


def logits(p: dict, texts: list[bytes]) -> np.ndarray:
    stream, parts = lay_out(texts)
    features, _ = _features(_parts(p, stream, repetition(stream))[0] + p["f"], parts, np.array([len(x) for x in texts]))
    hidden = np.maximum(features @ p["H"] + p["h"], 0)
    return hidden @ p["w"] + p["c"][0]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _gradients(p: dict, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    stream, parts = lay_out(texts)
    repeats = repetition(stream)
    pooled, at = _parts(p, stream, repeats, where=True)
    pooled += p["f"]
    features, (first, last, per, value) = _features(pooled, parts, np.array([len(x) for x in texts]))
    hidden = np.maximum(features @ p["H"] + p["h"], 0)
    logit = hidden @ p["w"] + p["c"][0]
    error = ((_sigmoid(logit) - y) * weight / len(y)).astype(np.float32)
    g = {"w": hidden.T @ error, "c": np.array([error.sum()], np.float32)}
    d_hidden = error[:, None] * p["w"] * (hidden > 0)
    g["H"], g["h"] = features.T @ d_hidden, d_hidden.sum(axis=0)
    d = d_hidden @ p["H"].T
    text = np.repeat(np.arange(len(parts)), per)
    d_value = (d[:, :FILTERS] / per[:, None])[text]
    begin, columns = np.cumsum(per) - per, np.arange(FILTERS)
    for k, (low, high) in enumerate(zip(begin, begin + per)):
        own = value[low:high]
        d_value[low + own.argmax(axis=0), columns] += d[k, FILTERS : 2 * FILTERS]
        d_value[low + own.argmin(axis=0), columns] += d[k, 2 * FILTERS : 3 * FILTERS]
    d_value *= value > 0
    # a chunk's largest value comes from one of its parts, there from one place
    best = np.repeat(first[:, None], FILTERS, axis=1)
    top = pooled[first]
    for j in range(1, CHUNK // PART):
        other = np.minimum(first + j, last)
        better = pooled[other] > top
        best = np.where(better, other[:, None], best)
        top = np.maximum(top, pooled[other])
    place = at[best, columns]  # chunks, FILTERS
    covered = place[:, :, None] + np.arange(WIDTH)
    bytes_ = stream[covered]
    vectors = _inputs(p, bytes_, repeats[covered]).reshape(len(first), FILTERS, -1)
    g["f"] = d_value.sum(axis=0)
    g["F"] = np.einsum("cf,cfk->kf", d_value, vectors)
    d_vectors = (d_value[:, :, None] * p["F"].T[None]).reshape(-1, VECTOR + 1)
    flat = bytes_.reshape(-1)
    g["E"] = np.stack([np.bincount(flat, d_vectors[:, j], 256) for j in range(VECTOR)], axis=1).astype(np.float32)
    return g


def train(texts: list[bytes], labels: list[int], passes: int | None = None, seed: int = 11) -> Model:
    y = np.array(labels, np.float32)
    if not len(y):
        return Model({}, constant=0.5)
    if y.min() == y.max():
        return Model({}, constant=float(y[0]))
    passes = passes or min(MOST_PASSES, max(PASSES, 2 * LEARN_ROWS * PASSES // len(y)))
    rng = np.random.default_rng(seed)
    f = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
    p = {"E": f(256, VECTOR, scale=0.5), "F": f(WIDTH * (VECTOR + 1), FILTERS, scale=0.2), "f": np.full(FILTERS, -0.5, np.float32), "H": f(3 * FILTERS + 1, HIDDEN, scale=0.15), "h": np.full(HIDDEN, 0.1, np.float32), "w": f(HIDDEN, scale=0.3), "c": np.zeros(1, np.float32)}
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step, size = 0, 32
    total = passes * -(-len(y) // size)
    for _ in range(passes):
        order = rng.permutation(len(y))
        for low in range(0, len(order), size):
            pick = order[low : low + size]
            g = _gradients(p, [texts[i] for i in pick], y[pick], weight[pick])
            step += 1
            rate = 0.006 * (1 - step / total) + 0.0003
            for name, grad in g.items():
                m, s = moment[name]
                m += 0.1 * (grad - m)
                s += 0.005 * (grad * grad - s)
                p[name] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.995**step)) + 1e-6)
    return Model(p)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", rows: int = LEARN_ROWS) -> Model:
    return train(*labelled_sample(docs, labels, label, rows, LEARN_BYTES, key, text))


def scores(model: Model, texts: list[bytes]) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    return _sigmoid(logits(model.p, texts).astype(np.float64))


def score(docs: DataFrame, model: Model, text: str = "text", to: str = "quality") -> DataFrame:
    """Adds the probability that the text has label 1."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = held.value
        for batch in batches:
            out, texts, size = [np.zeros(0)], [], 0
            for x in byte_rows(batch):
                texts.append(x)
                size += len(x)
                if size >= BLOCK:
                    out.append(scores(own, texts))
                    texts, size = [], 0
            if texts:
                out.append(scores(own, texts))
            yield pa.array(np.concatenate(out))
        tidy()

    return docs.withColumn(to, of(raw(text)))
