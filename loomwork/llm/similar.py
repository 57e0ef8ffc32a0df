"""Near-duplicates by the Jaccard similarity of word shingles: SimHash blocks and min-hash bands choose pairs, whole sets
decide.

Texts of equal shingle sets first become one class. Classes whose SimHash fingerprints of the same shingles differ in
DISTANCE bits or fewer are linked by the pigeonhole blocks of `simhash`. Fingerprints of sets that are as little alike as
0.8 differ in ten bits in the median, too many for blocks, so what these leave is found by bands: a class has BANDS * ROWS
least hashes; classes that agree on all rows of a band share a bucket, so a pair of similarity s shares none with
probability (1 - s ** ROWS) ** BANDS: 3e-6 at 0.8, less above. Every link is verified by the whole sets, and only links
are followed.

Buckets are worked off in rounds. In each, all members of a bucket that aren't in one component yet are compared with a
few of it (the pivots), which a hash chooses. After ROUNDS such rounds the members of a bucket that lie in different
components are compared with each other by their least hashes alone, a byte of each: of a pair of similarity s a share s
of the BANDS * ROWS hashes agrees, so a pair that is similar enough lies over a bound SURE deviations lower but in one
case of 100,000. A task holds a part of a bucket, PART members and PART_BYTES of sets at most, verifies the pairs over
the bound there, each in the first band that it shares, and gives links alone.

Null and empty texts have the empty set and are alike. Texts of any length are read whole. An empty table gives an empty
table; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, raw, rested, tidy, written
from .simhash import DISTANCE, folded, near_links, reach

WORDS, SEED, LEAST = 5, 42, 0.8
BANDS, ROWS, PIVOTS, ROUNDS = 24, 4, 4, 2
#: Standard deviations below the expected number of equal hashes; members of a bucket that a task compares at once, and
#: bytes of their sets.
SURE, PART, PART_BYTES = 4.3, 4096, 16 << 20
#: Pairs of one pivot that a part holds; shingles whose least hashes are worked out together.
TOGETHER, BLOCK = 256, 1 << 12
#: Pairs that a task verifies, members of buckets that it compares, where there are few of them.
VERIFIED, COMPARED = 5_000, 2_000
#: Classes up to which a list of them is sent to all tasks.
SENT = 1_000_000
_RNG = np.random.default_rng(1)
_A, _B = (_RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64) for _ in range(2))
_A |= np.uint64(1)


def hashes(text: bytes, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Hashes of the runs of `words` words, lower-cased, repeats included; of a shorter text, of the whole."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(parts) - words + 1)
    pairs = zip(starts[:n].tolist(), ends[-n:].tolist())
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in pairs), np.uint64, n)


def band_keys(found: np.ndarray) -> tuple[np.ndarray, bytes]:
    """A hash of each band's least hashes, and a byte of each of these."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for low in range(0, len(found), BLOCK):
        x = (found[None, low : low + BLOCK] ^ _B[:, None]) * _A[:, None]
        least = np.minimum(least, (x ^ (x >> np.uint64(29))).min(axis=1))
    keys = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in least.reshape(BANDS, ROWS)], np.uint64).view(np.int64)
    return keys, (least & np.uint64(255)).astype(np.uint8).tobytes()


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have that similarity; two empty ones have any."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < least * len(b):
        return False
    at = np.searchsorted(b, a).clip(max=max(0, len(b) - 1))
    both = int((b[at] == a).sum()) if len(a) else 0
    return not len(b) or both >= least * (len(a) + len(b) - both)


def marked_rows(docs: DataFrame, text: str, words: int, seed: int) -> DataFrame:
    """docs with a row number, the class, its fingerprint and the bands' keys. The sets themselves are larger than the
    texts and most are never compared, so they aren't kept."""

    @F.arrow_udf("struct<c:bigint,fp:bigint,k:array<bigint>,sig:binary>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            c, fp, keys, sigs = [], [], [], []
            for x in byte_rows(batch):
                every = hashes(x, words, seed)
                own = np.unique(every)
                c.append(xxhash.xxh64_intdigest(own.tobytes()))
                fp.append(folded(every))
                key, sig = band_keys(own)
                keys.append(key)
                sigs.append(sig)
            c, fp = (np.array(x, np.uint64).view(np.int64) for x in (c, fp))
            yield pa.StructArray.from_arrays([pa.array(c), pa.array(fp), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], ["c", "fp", "k", "sig"])
        tidy()

    found = docs.withColumns({"__set": of(raw(text)), "__row": F.monotonically_increasing_id()})
    return found.select(*docs.columns, "__row", F.col("__set.c").alias("__c"), F.col("__set.fp").alias("__fp"), F.col("__set.k").alias("__k"), F.col("__set.sig").alias("__sig"))


def sets_of(marked: DataFrame, asked: DataFrame, n: int, text: str, words: int, seed: int) -> DataFrame:
    """c, s: the sets of these classes, n at most, worked out again from a text of each. The classes are sent to all
    tasks if they are few enough."""

    @F.arrow_udf("binary")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([np.unique(hashes(x, words, seed)).tobytes() for x in byte_rows(batch)], pa.binary())
        tidy()

    sent = F.broadcast if n <= SENT else lambda x: x
    least = marked.select("__c", "__row").join(sent(asked.select("c").distinct()), F.col("__c") == F.col("c")).groupBy("c").agg(F.min("__row").alias("r"))
    chosen = written(least, "chosen", n)
    texts = marked.select("__row", raw(text).alias("t")).join(sent(chosen), F.col("__row") == F.col("r"))
    return written(texts.select("c", of("t").alias("s")), "sets")


def _in_tasks(rows: DataFrame, n: int, each: int) -> DataFrame:
    """n pieces of work, so many each task, but no fewer tasks than can run at once: each one writes a file and starts
    a Python function, which for a few pieces takes longer than the work. Groups that lie in a partition stay whole."""
    return rows.coalesce(n // each + rows.sparkSession.sparkContext.defaultParallelism)


def _verified(pairs: DataFrame, sets: DataFrame, least: float, rows: int) -> DataFrame:
    """Of pairs (a, b) of classes, those similar enough. A pivot's many pairs are dealt out in parts; its set goes to each
    part once, ahead of the others', so no row holds two sets."""
    pairs = written(pairs.select("a", "b").where("a != b").distinct(), "pairs", rows)
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(TOGETHER)).cast("int").alias("parts"))
    first = parts.join(sets, parts.a == sets.c).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("bigint").alias("b"), "s")
    dealt = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    others = dealt.join(sets.withColumnRenamed("c", "b"), "b").select("a", "part", "b", "s")
    both = first.unionByName(others).repartition("a", "part")
    dealt_out = _in_tasks(both, pairs.count(), VERIFIED).sortWithinPartitions("a", "part", F.asc_nulls_first("b"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: np.ndarray | None = None
        for batch in batches:
            a, b = [], []
            for i in range(len(batch)):
                one, other = batch.column(0)[i].as_py(), batch.column(2)[i].as_py()
                s = np.frombuffer(batch.column(3)[i].as_buffer(), np.uint64)
                if other is None:
                    own = s.copy()
                elif similar(own, s, least):
                    a.append(one)
                    b.append(other)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        tidy()

    return written(dealt_out.mapInArrow(near, "a bigint, b bigint"), "near")


def _likely(sig: np.ndarray, band: int, may: Callable[[int, int], np.ndarray], bound: int, known: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members of a bucket that share `bound` least hashes or more and no earlier band, which would have them.
    may: of so many members from one on, which pairs count. known: pairs of two that it marks aren't asked for; what has
    been given may be marked meanwhile."""
    for low in range(0, len(sig), 256):
        same = np.zeros((min(256, len(sig) - low), len(sig)), np.uint8)
        for k in range(sig.shape[1]):
            same += sig[low : low + 256, k, None] == sig[None, :, k]
        near = (same >= bound) & may(low, low + 256)
        if known is not None:
            near &= ~(known[low : low + 256, None] & known[None, :])
        x, y = np.nonzero(near)
        for at in range(0, len(x), BLOCK):
            one, other = x[at : at + BLOCK] + low, y[at : at + BLOCK]
            first = (sig[one] == sig[other]).reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band
            yield one[first], other[first]


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each band, key, i, j, which follow each other."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([batch.column(k).to_numpy() for k in range(4)], axis=1).astype(np.int64)
        edge = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for low, high in zip(edge, edge[1:]):
            if low == high:
                continue
            if last is not None and (keys[low] != last).any():
                yield pa.Table.from_batches(held)
                held = []
            last = keys[low]
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def _met(rows: DataFrame, parts: Column, members: int) -> DataFrame:
    """rows: band, key, c, root, sig and more. Each bucket in that many parts, each pair of parts (i, j) in a task."""
    parts = rows.groupBy("band", "key").agg(F.ceil(parts).cast("int").alias("parts"))
    own = rows.join(parts, ["band", "key"]).withColumn("p", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))
    met = own.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rest = [x for x in rows.columns if x not in ("band", "key")]
    met = met.select("band", "key", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "p", *rest)
    return _in_tasks(met.repartition("band", "key", "i", "j"), members, COMPARED).sortWithinPartitions("band", "key", "i", "j")


def _left(rows: DataFrame, sets: DataFrame, least: float, members: int) -> DataFrame:
    """rows: band, key, c, root, sig; members: their number; sets: c, s. Links (a, b) between a bucket's members of
    different roots. A bucket of several parts is compared part with part, each pair of parts in a task. First by the
    least hashes alone: sets are many times larger, and go only to those members of a bucket that a likely pair has."""
    bound = int(BANDS * ROWS * least - SURE * np.sqrt(BANDS * ROWS * least * (1 - least)))
    n, size = F.count(F.lit(1)) / F.lit(PART), F.sum(F.octet_length("s")) / F.lit(PART_BYTES)

    def opened(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, Callable[[int, int], np.ndarray]]:
        i, j, p, c, root = (table.column(k).to_numpy() for k in (2, 3, 4, 5, 6))
        sig = np.frombuffer(b"".join(table.column(7).to_pylist()), np.uint8).reshape(len(c), -1)

        def may(low: int, high: int) -> np.ndarray:
            out = (root[low:high, None] != root[None, :]) & (c[low:high, None] < c[None, :])
            return out & (p[low:high, None] != p[None, :]) if i[0] != j[0] else out

        return c, root, sig, table.column(0)[0].as_py(), may

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_part(batches):
            c, _, sig, band, may = opened(table)
            found = np.zeros(len(c), bool)
            for x, y in _likely(sig, band, may, bound, found):
                found[x] = found[y] = True
            if found.any():
                both = table.select([0, 1, 5]).filter(pa.array(found)).combine_chunks()
                yield from both.to_batches()
        tidy()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_part(batches):
            c, root, sig, band, may = opened(table)
            sets = [np.frombuffer(x, np.uint64) for x in table.column(8).to_pylist()]
            name = {x: x for x in root.tolist()}

            def top(x: int) -> int:
                while name[x] != x:
                    name[x] = x = name[name[x]]
                return x

            found_a, found_b = [], []
            for xs, ys in _likely(sig, band, may, bound):
                for x, y in zip(xs.tolist(), ys.tolist()):
                    one, other = top(int(root[x])), top(int(root[y]))
                    if one != other and similar(sets[x], sets[y], least):
                        name[one] = other
                        found_a.append(c[x])
                        found_b.append(c[y])
            if found_a:
                yield pa.record_batch([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])
        tidy()

    rows = rows.select("band", "key", "c", "root", "sig")
    chosen = _met(rows, n, members).mapInArrow(choose, "band int, key bigint, c bigint").distinct()
    chosen = written(chosen, "likely", members)
    asked = rows.join(chosen, ["band", "key", "c"]).join(sets, "c").select(*rows.columns, "s")
    return written(_met(asked, F.greatest(n, size), chosen.count()).mapInArrow(compare, "a bigint, b bigint"), "left")


def _by_fingerprint(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes: each with the one that stands for its fingerprint, and these as the blocks link them."""
    named = classes.groupBy("fp").agg(F.min("c").alias("a"))
    same = classes.join(named, "fp").select("a", F.col("c").alias("b"))
    links = near_links(classes.select("fp").distinct(), DISTANCE)
    ends = links.join(named.select(F.col("fp").alias("a"), F.col("a").alias("x")), "a").join(named.select(F.col("fp").alias("b"), F.col("a").alias("y")), "b")
    return same.unionByName(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).where("a != b")


def links_of(marked: DataFrame, text: str, words: int, least: float, seed: int) -> DataFrame:
    """Links (a, b) that connect all classes of which a pair in a bucket is similar enough."""
    classes = marked.groupBy(F.col("__c").alias("c")).agg(F.first("__k").alias("k"), F.first("__sig").alias("sig"), F.min("__fp").alias("fp"))
    classes = written(classes, "classes", marked.count())
    n = classes.count()
    by_fp = written(_by_fingerprint(classes.select("c", "fp")), "by_fingerprint", 8 * n)
    rows = classes.select("c", F.posexplode("k").alias("band", "key"))
    shared = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = written(rows.join(shared, ["band", "key"]), "members", BANDS * n)
    asked = members.select("c").unionByName(by_fp.select(F.explode(F.array("a", "b")).alias("c")))
    sets = sets_of(marked, asked, n, text, words, seed)
    links = _verified(by_fp, sets, least, 8 * n)
    open_ = members
    for turn in range(ROUNDS + 1):  # a bucket that lies in one component stays so and isn't looked at again
        rested(marked.sparkSession)
        roots = reach(links)
        listed = open_.groupBy("c").agg(F.collect_list(F.struct("band", "key")).alias("at"))  # BANDS at most
        found = listed.join(roots, listed.c == roots.node, "left").select("c", F.coalesce("root", "c").alias("root"), F.explode("at").alias("at"))
        rooted = written(found.select("at.band", "at.key", "c", "root"), "rooted", BANDS * n)
        apart = rooted.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("band", "key")
        open_ = written(rooted.join(apart, ["band", "key"]), "open", BANDS * n)
        if not open_.head(1):
            return links
        if turn == ROUNDS:  # whatever lies in different components
            return links.unionByName(_left(open_.join(classes.select("c", "sig"), "c"), sets, least, open_.count()))
        chosen = [F.min(F.struct(F.xxhash64("c", F.lit(PIVOTS * turn + i)).alias("h"), "c"))["c"] for i in range(PIVOTS)]
        pivots = open_.groupBy("band", "key").agg(F.array_distinct(F.array(*chosen)).alias("p"))
        found = open_.join(pivots, ["band", "key"]).select("c", F.explode("p").alias("p"))
        pairs = found.select(F.col("p").alias("a"), F.col("c").alias("b"))
        links = links.unionByName(_verified(pairs, sets, least, BANDS * PIVOTS * n))
    return links


def survivors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, least: float = LEAST, seed: int = SEED) -> DataFrame:
    """The row of the smallest doc_id of each component, with all its columns; of rows that repeat it, one. A null
    doc_id stands after all others. Null and empty texts are alike."""
    rested(docs.sparkSession)
    marked = written(marked_rows(docs, text, words, seed), "marked")
    roots = reach(links_of(marked, text, words, least, seed))
    classes = marked.groupBy(F.col("__c").alias("c")).agg(F.min(doc_id).alias("least"))
    rooted = classes.join(roots, classes.c == roots.node, "left").select("c", "least", F.coalesce("root", "c").alias("root"))
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "c")).alias("kept")
    kept = rooted.groupBy("root").agg(first).select(F.col("kept.least").alias("__least"), F.col("kept.c").alias("__kept"))
    rows = marked.select(F.col(doc_id).alias("__id"), "__row", "__c")
    chosen = rows.join(kept, rows["__id"].eqNullSafe(kept["__least"]) & (rows["__c"] == kept["__kept"]), "left_semi")
    chosen = chosen.groupBy("__id", "__c").agg(F.min("__row").alias("__row")).select("__row")
    return marked.join(chosen, "__row", "left_semi").drop("__row", "__c", "__fp", "__k", "__sig")
