"""SimHash near-duplicates by pigeonhole blocks.

Each text gets a 64-bit fingerprint of its word shingles. Equal fingerprints first become one class. Of fingerprints
that differ in few bits, cut into blocks, some blocks must be equal: each class is listed under every choice of that
many blocks, the list is dealt out by block contents, and fingerprints under the same contents are compared. A task
returns no pairs but, for each fingerprint, the smallest one that its links under these contents reach. Tasks join these
links to trees, and large-star and small-star rounds join the trees of several tasks to components.

Contents shared by more fingerprints than a task compares are cut again: the bits still free are divided into blocks in
the same way, until few enough share them. With every cut fewer bits are free, and r free bits allow 2 ** r
fingerprints at most, so this ends, and no link is lost.

Null and empty texts have fingerprint zero, which links like any other. Rows that repeat a doc_id each keep a row; a null
doc_id is never a component's name unless all its documents have none. Empty tables give empty tables. Only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, raw, tidy, written

WORDS, SEED, DISTANCE = 4, 42, 4
#: Fingerprints under the same contents that one task compares with each other; the rest of a larger group is cut again.
TOGETHER = 4096
#: Shingles hashed at a time; links that a task joins to trees at once.
BLOCK, LINK_ROWS = 1 << 18, 1_000_000
_MASK = (1 << 64) - 1


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """A bit is one if it is set in over half the hashes of the shingles, repeats included."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    if len(parts) >= words:
        starts, ends = starts[: len(parts) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    for low in range(0, len(starts), BLOCK):
        pairs = zip(starts[low : low + BLOCK].tolist(), ends[low : low + BLOCK].tolist())
        ones += _bits(b"".join([digest(joined[a:b], seed) for a, b in pairs]))
    return _majority(ones, len(starts))


def _bits(digests: bytes) -> np.ndarray:
    """How many of the hashes, as eight bytes each with the highest first, have each bit."""
    return np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def _majority(ones: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def folded(hashes: np.ndarray) -> int:
    """The fingerprint of hashes that are at hand."""
    ones = np.zeros(64, np.int64)
    for low in range(0, len(hashes), BLOCK):
        ones += _bits(hashes[low : low + BLOCK].astype(">u8").tobytes())
    return _majority(ones, len(hashes))


def fingerprints(docs: DataFrame, text: str = "text", to: str = "fp", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """Adds the fingerprint as a signed long."""

    @F.arrow_udf("bigint")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = np.array([fingerprint(x, words, seed) for x in byte_rows(batch)], np.uint64)
            yield pa.array(found.view(np.int64))
        tidy()

    return docs.withColumn(to, of(raw(text)))


def as_text(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cuts(free: list[int], distance: int, blocks: int) -> list[int]:
    """Masks, one for each choice of blocks - distance of the blocks that the free bits are divided into."""
    parts = [sum(1 << int(b) for b in x) for x in np.array_split(np.array(free), blocks)]
    return [sum(x) for x in combinations(parts, blocks - distance)]


def blocks_for(classes: int, distance: int) -> int:
    """Blocks so that some sixteen classes share contents by chance, as far as four more blocks than bits that differ
    allow: more blocks list a class more often, under contents that are rarer."""
    for blocks in range(distance + 1, distance + 5):
        if 64 * (blocks - distance) // blocks >= np.log2(max(2, classes)) - 4:
            return blocks
    return distance + 4


def _components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of n nodes reaches over the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label


def _dense(fp: np.ndarray, distance: int) -> np.ndarray:
    """The same for all fingerprints compared with each other, block by block."""
    label, change = np.arange(len(fp)), True
    while change:
        change = False
        for low in range(0, len(fp), 256):
            near = np.bitwise_count(fp[low : low + 256, None] ^ fp[None, :]) <= distance
            best = np.where(near, label[None, :], len(fp)).min(axis=1)
            change |= bool((best < label[low : low + 256]).any())
            np.minimum.at(label, label[low : low + 256], best)
            label[low : low + 256] = np.minimum(label[low : low + 256], best)
        label = label[label]
    return label


def _links(group: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and, for each, the smallest that its links within its groups reach. Rows are sorted by group, then
    by fingerprint as unsigned; groups larger than TOGETHER must have been taken out."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[first, len(group)])
    node, root = [], []
    for at, size in zip(first[sizes > 64], sizes[sizes > 64]):
        own = fp[at : at + size]
        label = _dense(own, distance)
        moved = label != np.arange(size)
        node.append(own[moved])
        root.append(own[label[moved]])
    small = np.repeat((sizes > 1) & (sizes <= 64), sizes)
    fp, group = fp[small], group[small]
    a, b, step, left = [], [], 1, np.arange(len(fp))
    while len(left := left[left + step < len(fp)]):
        left = left[group[left] == group[left + step]]
        near = left[np.bitwise_count(fp[left] ^ fp[left + step]) <= distance]
        a.append(near)
        b.append(near + step)
        step += 1
    if a:
        label = _components(np.concatenate(a), np.concatenate(b), len(fp))
        moved = label != np.arange(len(fp))
        node.append(fp[moved])
        root.append(fp[label[moved]])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *node]), np.concatenate([none, *root])


def _compare(rows: DataFrame, distance: int, together: int) -> DataFrame:
    """rows: mask, part, fp, sorted, equal masks and parts in one partition. Gives links (a, b) with a null mask, and
    the rows of groups that are too large, with a null b."""
    schema = pa.schema([("mask", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # of the group that the last batch may not have ended, and of the batch
        size, large = 0, False

        def out(mask: np.ndarray | None, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
            null = pa.nulls(len(a), pa.int64())
            return pa.record_batch([null if mask is None else pa.array(mask), pa.array(a.view(np.int64)), null if b is None else pa.array(b.view(np.int64))], schema=schema)

        def settle(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(rows):
                return
            edge = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
            sizes = np.diff(np.r_[edge, len(rows)])
            group = np.repeat(np.arange(len(edge)), sizes)
            over = np.repeat(sizes > together, sizes)
            if over.any():
                yield out(rows[over, 0], rows[over, 2].view(np.uint64), None)
            rows, group = rows[~over], group[~over]
            fp = rows[:, 2].copy().view(np.uint64)
            order = np.lexsort((fp, group))
            a, b = _links(group[order], fp[order], distance)
            if len(a):
                yield out(None, a, b)

        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
            if not len(rows):
                continue
            if large:  # the rest of a group that was already too large
                same = (rows[:, :2] == held[0][0, :2]).all(axis=1)
                n = len(rows) if same.all() else int(same.argmin())
                if n:
                    yield out(rows[:n, 0].copy(), rows[:n, 2].copy().view(np.uint64), None)
                rows = rows[n:]
                if not len(rows):
                    continue
                held, large = [], False
            rows = np.concatenate([*held, rows])
            change = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1))
            at = int(change[-1]) + 1 if len(change) else 0
            yield from settle(rows[:at])
            rest = rows[at:]
            if len(rest) > together:
                yield out(rest[:, 0].copy(), rest[:, 2].copy().view(np.uint64), None)
                held, large = [rest[:1].copy()], True
            else:
                held = [rest]
        if held and not large:
            yield from settle(np.concatenate(held))

    return rows.mapInArrow(links, "mask bigint, a bigint, b bigint")


def _listed(classes: DataFrame, masks: list[int]) -> DataFrame:
    listed = classes.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    return listed.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("part"), "fp")


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("mask", "part").sortWithinPartitions("mask", "part")


def near_links(classes: DataFrame, distance: int = DISTANCE, together: int = TOGETHER) -> DataFrame:
    """classes: distinct fingerprints fp. Links (a, b), unsigned b < a, that connect what differs in `distance` bits or
    fewer."""
    n = classes.count()
    found = written(_compare(_dealt(_listed(classes, cuts(list(range(64)), distance, blocks_for(n, distance)))), distance, together), "links")
    links = found.where(F.col("b").isNotNull()).select("a", "b")
    while True:
        over = found.where(F.col("b").isNull()).select("mask", F.col("a").alias("fp")).distinct()
        masks = [r["mask"] & _MASK for r in over.select("mask").distinct().collect()]  # choices of blocks, not rows
        if not masks:
            return links.distinct()
        finer = None
        for mask in masks:
            free = [i for i in range(64) if not mask >> i & 1]
            part = over.where(F.col("mask") == _signed(mask))
            more = [mask | m for m in cuts(free, distance, min(distance + 2, len(free)))]
            own = _listed(part.select("fp"), more)
            finer = own if finer is None else finer.unionByName(own)
        # a group of which too few bits are free to grow beyond `together` is compared whole
        found = written(_compare(_dealt(finer.distinct()), distance, max(together, 1 << distance + 2)), "links")
        links = links.unionByName(found.where(F.col("b").isNotNull()).select("a", "b"))


def _trees(links: DataFrame, most: int) -> DataFrame:
    """links: a, b. Links (a, b) of each node with the smallest that it reaches over the links of its task, `most` at a
    time or a few more; they connect what the links connect."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def joined() -> np.ndarray:
            nodes, at = np.unique(np.concatenate(held), return_inverse=True)
            at = at.reshape(-1, 2)
            label = _components(at[:, 0], at[:, 1], len(nodes))
            moved = np.flatnonzero(label != np.arange(len(nodes)))
            return np.stack([nodes[moved], nodes[label[moved]]], axis=1)

        def out(pairs: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)], axis=1))
            size += len(batch)
            if size > most:
                held = [joined()]
                size = len(held[0])
                if size > most // 2:
                    yield out(held[0])
                    held, size = [], 0
        if size:
            yield out(joined())
        tidy()

    return links.select("a", "b").mapInArrow(of, "a bigint, b bigint")


def reach(links: DataFrame) -> DataFrame:
    """Connected components: node and root, the component's smallest node by signed order, for all nodes but the roots.
    Tasks join their links to trees; those of several tasks are joined by large-star and small-star, where each round is
    a written table and equal tables end it."""
    parts = links.count() // LINK_ROWS + 1  # rounds never add links, so few files hold few of them
    both = _trees(links.coalesce(parts), LINK_ROWS)
    if parts == 1:  # all links have met
        return written(both, "trees").select(F.col("a").alias("node"), F.col("b").alias("root"))
    both = both.distinct()
    state = None
    while True:
        both = written(both.coalesce(parts), "stars")
        new = both.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if new == state:
            return both.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = new
        around = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        both = small.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def _rooted(classes: DataFrame, distance: int) -> DataFrame:
    """classes: fp, least. The same with each component's root."""
    roots = reach(near_links(classes.select("fp"), distance))
    return classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, distance: int = DISTANCE, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, fp, and component_id, the smallest doc_id that links reach."""
    marked = written(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "fp", words, seed).select("doc_id", "fp"), "fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    rooted = _rooted(classes, distance)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    names = rooted.join(named, "root").select("fp", "component_id")
    return marked.join(names, "fp").select("doc_id", "fp", "component_id")


def survivors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, distance: int = DISTANCE, seed: int = SEED) -> DataFrame:
    """The row of the smallest doc_id of each component, with all its columns; of rows that repeat it, one. A null
    doc_id stands after all others."""
    marked = written(fingerprints(docs, text, "__fp", words, seed), "marked")
    classes = written(marked.groupBy(F.col("__fp").alias("fp")).agg(F.min(doc_id).alias("least")), "classes")
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fp")).alias("kept")
    kept = _rooted(classes, distance).groupBy("root").agg(first).select(F.col("kept.least").alias("__least"), F.col("kept.fp").alias("__kept"))
    found = marked.join(kept, marked[doc_id].eqNullSafe(kept["__least"]) & (marked["__fp"] == kept["__kept"]), "left_semi")
    return found.dropDuplicates([doc_id, "__fp"]).drop("__fp")
