"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's input is a learned vector of the word (by hash) plus the mean of learned vectors of its runs of 3 to 5 bytes
(by hash), so that unseen forms of known stems are read too. Runs of over 40 bytes, as in scripts without spaces, are cut
into words that overlap. Two gated recurrent networks read a window of words from
both sides, attention weighs the places, and a logistic unit gives the window's probability. Windows overlap and cover
the whole text; a text's score is that of its worst window. Training knows labels of texts only: the worst window of
each text gets its label.

Null and empty texts, and those without a word, are scored as one empty window. Without any labelled row the score is 0;
with labels of one class only, the share of toxic rows. Repeated rows get equal scores; an empty table gives an empty
table; other columns stay as they are, but a column of the result's name is replaced. Very long texts are scored whole. Labels that are null are not learnt from.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, labelled_rows, labelled_sample, learnt_in_task, raw, tidy

#: Words of a window and from one window's start to the next.
WINDOW, STEP = 48, 36
#: Sizes of word vectors, of each direction's state, of the attention layer, and of the tables that hashes point into.
VECTOR, STATE, ATTEND, WORD_ROWS, GRAM_BITS = 16, 16, 8, 1 << 14, 15
#: Bytes of a word at most, and bytes that the parts of a longer run share.
LONGEST, SHARED = 40, 10
#: Labelled rows learnt from, of each class at most, and the longest text among them; passes over that many rows of both
#: classes, more over fewer rows, up to the most passes.
LEARN_ROWS, LEARN_BYTES, PASSES, MOST_PASSES = 1600, 60_000, 8, 24
#: Texts that must hold a word or a run of bytes for its vector to be learnt.
RARE = 6
#: Windows computed together; words that a worker keeps; words whose vectors are made together.
BATCH, KEPT, CHUNK = 2048, 150_000, 20_000
_AS_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and bytes beyond ASCII, A-Z lower-cased. A run of over LONGEST bytes, such as a
    sentence without spaces, becomes several words that overlap, so that every run of 5 bytes is whole in one of them."""
    words = text.translate(_AS_WORDS).split()
    if max(map(len, words), default=0) <= LONGEST:
        return words
    return [part for w in words for part in ([w] if len(w) <= LONGEST else [w[i : i + LONGEST] for i in range(0, len(w) - SHARED, LONGEST - SHARED)])]


def _gram_rows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the grams' table for each word's runs of 3 to 5 bytes, its ends marked, and where each word's begin. The
    hashes are worked out at all places of all words at once."""
    marked = [b"<" + w + b">" if w else b"<<>" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    x = np.frombuffer(b"".join(marked) + bytes(4), np.uint8).astype(np.uint32)
    n = len(x) - 4
    word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)
    value, owners, rows = np.zeros(n, np.uint32), [], []
    for k in range(1, 6):
        value = value * np.uint32(0x01000193) + x[k - 1 : k - 1 + n] + np.uint32(k)
        if k >= 3:
            whole = left >= k
            owners.append(word[whole])
            rows.append(((value[whole] * np.uint32(0x9E3779B1)) >> np.uint32(32 - GRAM_BITS)).astype(np.int32))
    owner, row = np.concatenate(owners), np.concatenate(rows)
    order = np.argsort(owner, kind="stable")
    return row[order], np.searchsorted(owner[order], np.arange(len(words)))


@dataclass
class Model:
    """p: the parameters by name; shift: what is taken from the log odds so that 0.5 parts the classes."""

    p: dict[str, np.ndarray]
    shift: float = 0.0
    constant: float | None = None


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Words:
    """Word to its number, with the words' inputs to the gates of both networks by number. Number 0 is the gap after a
    window."""

    def __init__(self, model: Model):
        self.p = model.p
        self.number: dict[bytes, int] = {}
        self.rows = 1
        self.tables = np.zeros((2, 3, 1024, STATE), np.float32)

    def vectors(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the words' table; rows of the grams' table and where each word's begin."""
        own = np.fromiter((zlib.crc32(w) % WORD_ROWS for w in words), np.int32, len(words))
        rows, first, at = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        for low in range(0, len(words), CHUNK):
            part, begin = _gram_rows(words[low : low + CHUNK])
            rows.append(part)
            first.append(begin + at)
            at += len(part)
        return own, np.concatenate(rows), np.concatenate(first)

    def inputs(self, own: np.ndarray, grams: np.ndarray, first: np.ndarray) -> np.ndarray:
        ends = np.append(first, len(grams))
        n = np.diff(ends)[:, None].astype(np.float32)
        out = self.p["word"][own]
        for low in range(0, len(own), CHUNK):
            high = min(low + CHUNK, len(own))
            out[low:high] += np.add.reduceat(self.p["gram"][grams[ends[low] : ends[high]]], first[low:high] - first[low], axis=0) / n[low:high]
        return out

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Inputs by direction, gate and word."""
        n = len(x)
        out = np.empty((2, 3, n, STATE), np.float32)
        for low in range(0, n, CHUNK):
            part = x[low : low + CHUNK]
            for d in (0, 1):
                out[d, :, low : low + CHUNK] = (part @ self.p["W"][d] + self.p["b"][d]).reshape(len(part), 3, STATE).transpose(1, 0, 2)
        return out

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.number.get
        found = [get(w, -1) for w in words]
        out = np.array(found, np.int64)
        if len(out) and out.min() < 0:
            if self.rows >= KEPT:
                self.number.clear()
                self.rows = 1
                new = list(dict.fromkeys(words))
            else:
                new = list(dict.fromkeys(w for w, i in zip(words, found) if i < 0))
            end = self.rows + len(new)
            if end > self.tables.shape[2]:
                more = np.zeros((2, 3, end * 6 // 5, STATE), np.float32)
                more[:, :, : self.rows] = self.tables[:, :, : self.rows]
                self.tables = more
            self.tables[:, :, self.rows : end] = self.projected(self.inputs(*self.vectors(new)))
            self.number.update(zip(new, range(self.rows, end)))
            self.rows = end
            out = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        return out


def windows_of(n: int) -> list[int]:
    """Starts of the windows over n words; the last one reaches the end."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STEP), n - WINDOW]


def cut(numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows as rows of word numbers (0 past the end), their lengths, and how many each text has."""
    per = np.array([len(windows_of(len(x))) for x in numbers])
    at = np.zeros((per.sum(), WINDOW), np.int32)
    sizes = np.zeros(per.sum(), np.int64)
    row = 0
    for x, n in zip(numbers, per):
        if n == 1:
            at[row, : len(x)] = x
            sizes[row] = len(x)
        else:
            at[row : row + n] = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[windows_of(len(x))]
            sizes[row : row + n] = WINDOW
        row += n
    return at, sizes, per


def _run(p: dict, inputs, sizes: np.ndarray, keep: bool = False):
    """Log odds of windows. inputs(d, t): the projected inputs of step t for direction d, of the gates for keeping, for
    forgetting and of the new state. Sigmoids are computed as (1 + tanh(x / 2)) / 2, which numpy does fastest."""
    n, steps = len(sizes), max(1, int(sizes.max(initial=1)))
    full = len(sizes) > 0 and int(sizes.min()) == steps
    states = np.empty((2, steps, n, STATE), np.float32)
    saved: list = []
    for d in (0, 1):
        Uz, Ur, Un = (np.ascontiguousarray(p["U"][d][:, i * STATE : (i + 1) * STATE]) for i in range(3))
        h = np.zeros((n, STATE), np.float32)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            xz, xr, xn = inputs(d, t)
            z, reset, own = h @ Uz, h @ Ur, h @ Un
            for gate, x in ((z, xz), (reset, xr)):
                gate += x
                gate *= 0.5
                np.tanh(gate, out=gate)
                gate *= 0.5
                gate += 0.5
            new = reset * own
            new += xn
            np.tanh(new, out=new)
            after = states[d, t]
            np.subtract(h, new, out=after)
            after *= z
            after += new
            live = None
            if not full:
                live = (sizes > t)[:, None]
                np.copyto(after, h, where=~live)
            if keep:
                saved.append((d, t, h, z, reset, new, own, np.ones((n, 1), bool) if live is None else live))
            h = after
    u = states[0] @ p["A"][:STATE]
    u += states[1] @ p["A"][STATE:]
    u += p["a"]
    np.tanh(u, out=u)
    e = u @ p["v"]
    if not full:
        e[np.arange(steps)[:, None] >= np.maximum(sizes, 1)[None, :]] = -np.inf
    weight = np.exp(e - e.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = np.concatenate([np.einsum("tnh,tn->nh", x, weight) for x in states], axis=1)
    logit = pooled @ p["w"] + p["c"][0]
    return (logit, (saved, np.concatenate([states[0], states[1]], axis=2), u, weight, pooled)) if keep else logit


def logits(words: Words, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Full windows and shorter ones apart, as full ones need no masks."""
    p, out, tables = words.p, np.empty(len(at), np.float64), words.tables
    for rows in (np.flatnonzero(sizes == WINDOW), np.flatnonzero(sizes < WINDOW)):
        for low in range(0, len(rows), BATCH):
            pick = rows[low : low + BATCH]
            part = np.ascontiguousarray(at[pick].T)
            room = np.empty((3, len(pick), STATE), np.float32)

            def inputs(d: int, t: int, part=part, room=room) -> np.ndarray:
                for g in range(3):
                    np.take(tables[d, g], part[t], axis=0, out=room[g], mode="clip")
                return room

            out[pick] = _run(p, inputs, sizes[pick])
    return out


def _start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    f = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
    return {"word": f(WORD_ROWS, VECTOR, scale=0.05), "gram": f(1 << GRAM_BITS, VECTOR, scale=0.05), "W": f(2, VECTOR, 3 * STATE, scale=0.4), "b": np.zeros((2, 3 * STATE), np.float32), "U": f(2, STATE, 3 * STATE, scale=0.25), "A": f(2 * STATE, ATTEND, scale=0.3), "a": np.zeros(ATTEND, np.float32), "v": f(ATTEND, scale=0.5), "w": f(2 * STATE, scale=0.3), "c": np.zeros(1, np.float32)}


def _odds(rows: list[np.ndarray], labels: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of the texts that hold a row, drawn towards zero where few do: the start of one dimension of the
    vectors. And which rows enough texts hold to be learnt."""
    seen = np.zeros((2, size), np.int64)
    for x, label in zip(rows, labels):
        seen[label, x] += 1
    n = np.bincount(labels, minlength=2)
    both = seen.sum(axis=0)
    usual = (both + 1e-3) / n.sum()  # two more texts of either class hold it as often as all do
    odds = np.log((seen[1] + 2 * usual) / (n[1] + 2)) - np.log((seen[0] + 2 * usual) / (n[0] + 2))
    return (odds.clip(-4, 4) * both / (both + RARE)).astype(np.float32), both >= RARE


def train(texts: list[bytes], labels: list[int], passes: int | None = None, seed: int = 7) -> Model:
    """The parameters are learnt from four texts in five; the others place the shift."""
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return Model({}, constant=float(y.mean()) if len(y) else 0.0)
    passes = passes or min(MOST_PASSES, max(PASSES, 2 * LEARN_ROWS * PASSES // len(y)))
    rng = np.random.default_rng(seed)
    p = _start(rng)
    spared = np.zeros(len(y), bool)
    for value in (0, 1):
        own = np.flatnonzero(y == value)
        spared[own[4::5]] = len(own) >= 25
    vocabulary: dict[bytes, int] = {}
    numbers = []
    for x in texts:
        numbers.append(np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(x)], np.int32))
    words = Words(Model(p))
    own, grams, begin = words.vectors([b"", *vocabulary])
    ends = np.append(begin, len(grams))
    del vocabulary
    known = [(np.unique(x), label) for x, label, out in zip(numbers, y, spared) if not out]
    seen = np.array([label for _, label in known])
    learnt = {}
    for name, rows in (("word", [np.unique(own[x]) for x, _ in known]), ("gram", [np.unique(np.concatenate([np.zeros(0, np.int32), *(grams[ends[i] : ends[i + 1]] for i in x)])) for x, _ in known])):
        odds, learnt[name] = _odds(rows, seen, len(p[name]))
        p[name][:, 0] += 0.3 * odds
        p[name][~learnt[name]] *= 0.2  # vectors that little is known of stay near zero
    del known
    at, sizes, per = cut(numbers)
    first = np.cumsum(per) - per
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    beta, step = (0.9, 0.99), 0
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))

    def table() -> None:
        words.tables = words.tables[:, :, :0].copy()  # the last one's memory serves the next
        words.tables = words.projected(words.inputs(own, grams, begin))

    for turn in range(passes):
        table()
        scores = logits(words, at, sizes)
        worst = np.array([a + int(scores[a : a + n].argmax()) for a, n in zip(first, per)])
        other = first + (rng.random(len(per)) * per).astype(np.int64)
        used_texts = np.flatnonzero(~spared)
        clean = np.flatnonzero((y == 0) & (other != worst) & ~spared)
        picks = np.concatenate([worst[used_texts], other[clean]])
        target, force = np.concatenate([y[used_texts], y[clean]]), np.concatenate([weight[used_texts], 0.5 * weight[clean]])
        order, rate = rng.permutation(len(picks)), 0.01 * (1 - turn / passes) + 0.001
        size = int(np.clip(len(order) // 40, 16, 128))
        for low in range(0, len(order), size):
            pick = order[low : low + size]
            w_at, lengths = at[picks[pick]], sizes[picks[pick]]
            used, inverse = np.unique(w_at, return_inverse=True)
            inverse = np.ascontiguousarray(inverse.reshape(w_at.shape).T)
            part = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in used])
            n_grams = np.diff(ends)[used]
            begins = np.cumsum(n_grams) - n_grams
            x = words.inputs(own[used], grams[part], begins)
            mine = words.projected(x)
            logit, kept = _run(p, lambda d, t: mine[d][:, inverse[t]], lengths, keep=True)
            error = ((_sigmoid(logit) - target[pick]) * force[pick] / len(pick)).astype(np.float32)
            g, d_in = _back(p, kept, error, inverse, len(used))
            d_x = sum(d_in[d] @ p["W"][d].T for d in (0, 1))
            g["W"] = np.stack([x.T @ d_in[d] for d in (0, 1)])
            g["b"] = d_in.sum(axis=1)
            step += 1
            scale = np.sqrt(1 - beta[1] ** step) / (1 - beta[0] ** step)
            for name, grad in g.items():
                m, s = moment[name]
                m += (1 - beta[0]) * (grad - m)
                s += (1 - beta[1]) * (grad * grad - s)
                p[name] -= rate * scale * m / (np.sqrt(s) + 1e-7)
            for name, rows, grad in (("word", own[used], d_x), ("gram", grams[part], np.repeat(d_x / n_grams[:, None], n_grams, axis=0))):
                often = learnt[name][rows]
                where, inv = np.unique(rows[often], return_inverse=True)
                total = np.zeros((len(where), VECTOR), np.float32)
                np.add.at(total, inv, grad[often])
                s = moment[name][1]
                s[where] += total * total
                p[name][where] -= rate * total / (np.sqrt(s[where]) + 1e-6)
    table()
    scores = logits(words, at, sizes)
    top = np.maximum.reduceat(scores, first)
    placed = spared if spared.any() and y[spared].min() != y[spared].max() else ~spared
    return Model(p, shift=_parting(top[placed], y[placed]))


def _back(p: dict, kept, error: np.ndarray, inverse: np.ndarray, used: int) -> tuple[dict, np.ndarray]:
    """Gradients of the parameters, and of each used word's projected inputs by direction."""
    saved, both, u, weight, pooled = kept
    g = {"w": pooled.T @ error, "c": np.array([error.sum()], np.float32)}
    d_pool = error[:, None] * p["w"]
    d_weight = (both * d_pool).sum(axis=2)
    d_both = weight[:, :, None] * d_pool
    d_e = weight * (d_weight - (weight * d_weight).sum(axis=0))
    g["v"] = np.einsum("tna,tn->a", u, d_e)
    d_u = d_e[:, :, None] * p["v"] * (1 - u * u)
    g["a"] = d_u.sum(axis=(0, 1))
    g["A"] = np.einsum("tnh,tna->ha", both, d_u)
    d_both += d_u @ p["A"].T
    g["U"] = np.zeros_like(p["U"])
    d_in = np.zeros((2, used, 3 * STATE), np.float32)
    carry = {0: 0.0, 1: 0.0}
    for d, t, h, z, reset, new, r_new, live in reversed(saved):
        d_h = d_both[t, :, d * STATE : (d + 1) * STATE] + carry[d]
        d_live = np.where(live, d_h, 0)
        d_new = d_live * (1 - z) * (1 - new * new)
        d_z = d_live * (h - new) * z * (1 - z)
        d_reset = d_new * r_new * reset * (1 - reset)
        d_r = np.concatenate([d_z, d_reset, d_new * reset], axis=1)
        np.add.at(d_in[d], inverse[t], np.concatenate([d_z, d_reset, d_new], axis=1))
        g["U"][d] += h.T @ d_r
        carry[d] = d_live * z + d_r @ p["U"][d].T + np.where(live, 0, d_h)
    return g, d_in


def _parting(top: np.ndarray, y: np.ndarray) -> float:
    """The log odds that part the classes with the least error, a clean text's share counting double; amid the widest
    such gap."""
    order = np.argsort(top)
    top, y = top[order], y[order]
    missed = np.cumsum(np.r_[0, y]) / max(1, y.sum())
    false = 1 - np.cumsum(np.r_[0, 1 - y]) / max(1, (1 - y).sum())
    cost = missed + 2 * false
    edges = np.r_[top[0] - 2, top, top[-1] + 2]
    best = np.flatnonzero(cost <= cost.min() + 1e-9)
    at = best[np.argmax(edges[best + 1] - edges[best])]
    return float((edges[at] + edges[at + 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", rows: int = LEARN_ROWS, apart: bool = False) -> Model:
    """apart: a task learns the same model, beside which the driver holds nothing."""
    asked = (docs, labels, label, rows, LEARN_BYTES, key, text)
    model = learnt_in_task(labelled_rows(*asked), train) if apart else train(*labelled_sample(*asked))
    tidy()  # the driver needs the memory for plans
    return model


def scores(model: Model, words: Words | None, texts: list[bytes]) -> np.ndarray:
    if words is None:
        return np.full(len(texts), model.constant or 0.0)
    split = [words_of(x) for x in texts]
    sizes = np.array([len(x) for x in split])
    flat = words.numbers([w for x in split for w in x])
    at, window_sizes, per = cut(np.split(flat, np.cumsum(sizes)[:-1]))
    top = np.maximum.reduceat(logits(words, at, window_sizes), np.cumsum(per) - per)
    return _sigmoid(top - model.shift)


def score(docs: DataFrame, model: Model, text: str = "text", to: str = "toxicity") -> DataFrame:
    """Adds the probability that the text is toxic."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = held.value
        words = Words(own) if own.constant is None else None
        for batch in batches:
            out, texts, size = [np.zeros(0)], [], 0
            for x in byte_rows(batch):
                texts.append(x)
                size += len(x)
                if size >= 1 << 20:
                    out.append(scores(own, words, texts))
                    texts, size = [], 0
            if texts:
                out.append(scores(own, words, texts))
            yield pa.array(np.concatenate(out))
        del words
        tidy()

    return docs.withColumn(to, of(raw(text)))
