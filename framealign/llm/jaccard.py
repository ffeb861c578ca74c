"""Near-duplicates by the exact Jaccard similarity of word shingles, at 0.8 and above.

Shingles: A-Z lower-cased, words [^\\x20\\x09-\\x0D]+, runs of five words joined by a space, as a set (a text of fewer
words is one shingle; texts without words have one empty shingle and link to each other).

Search. All documents order their shingles alike, rare ones first. Two sets of n and m shingles with a similarity of t
share one of the first n - ceil(t n) + 1 and m - ceil(t m) + 1 in that order, so a document is filed under just these
(prefix filter), and no pair is missed. Which shingles are frequent comes from a sample; it changes the order, so the
work, and never the result. Lengths and the place of the first shared shingle rule out many pairs, sketches most of the
rest. A sketch has a bit per shingle or more; each shingle flips the bit that its hash names. A shingle that only one of
two texts has changes one bit between their sketches, so these differ in no more bits than the sets do in shingles, and a
pair whose sketches differ in more than a similarity of t allows is none. The others are compared on their whole texts: first the likeliest pair of each document, then one of each two components, then all
that are still in different ones. Of a key with many documents only neighbours by length and the pairs with the least id are taken
at first; then the pairs that aren't in one component yet.

Cases: rows with a null doc_id are left out. Rows of one doc_id are one document. Columns other than doc_id and text
are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

SHINGLE = 5
#: Least similarity, as a fraction.
LEAST = (4, 5)
SEED = 42
#: One document in so many tells the frequent shingles; those that so many of them share go last, this many at most.
SAMPLE, FREQUENT, MOST_FREQUENT = 16, 3, 200_000
#: Keys of more documents are compared in two rounds.
FEW = 16
#: Rows of a task that meets keys.
TASK_ROWS = 250_000
#: Ids up to which they are sent to every task.
MOST_BROADCAST = 2_000_000

_PAIR = "u long, v long"
_GROUP = "ids array<long>, sizes array<int>, places array<int>"


def shingles(text: bytes) -> set[bytes]:
    words = text.translate(common.LOWER_AZ).split()
    if len(words) <= SHINGLE:
        return {b" ".join(words)}
    return set(map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False)))


def similar(a: set[bytes], b: set[bytes]) -> bool:
    both = len(a & b)
    return both * LEAST[1] >= LEAST[0] * (len(a) + len(b) - both)


def _hashes(text: bytes) -> np.ndarray:
    found = shingles(text)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(SEED)), np.uint64, len(found)))


def _texts(b: pa.RecordBatch, name: str) -> list[bytes]:
    data, offs = common.raw_text(b.column(name))
    return [data[s:e] for s, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]


@common.lean
def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            found = [_hashes(t) for t in _texts(b.slice(at, 256), "text")]
            yield pa.record_batch([pa.array(np.concatenate(found).view(np.int64))], names=["key"])


def _prefixes(frequent: np.ndarray, rank: np.ndarray) -> Callable:
    """frequent: sorted hashes; rank: their places in the order, from 1."""

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                out: list[list[np.ndarray]] = [[], [], [], []]
                for doc, text in zip(part.column("doc_id").to_pylist(), _texts(part, "text"), strict=True):
                    keys = _hashes(text)
                    n = len(keys)
                    if len(frequent):
                        near = np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)
                        keys = keys[np.argsort(np.where(frequent[near] == keys, rank[near], 0), kind="stable")]
                    most = n + (-LEAST[0] * n // LEAST[1]) + 1
                    out[0].append(keys[:most])
                    out[1].append(np.full(most, doc, np.int64))
                    out[2].append(np.full(most, n, np.int32))
                    out[3].append(np.arange(most, dtype=np.int32))
                key, doc, size, place = (np.concatenate(x) for x in out)
                yield pa.record_batch([pa.array(x) for x in (key.view(np.int64), doc, size, place)], names=["key", "doc_id", "size", "place"])

    return run


def _possible(n: np.ndarray, i: np.ndarray, m: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sets of n and m shingles whose first shared ones are at places i and j can be similar enough."""
    a, b = LEAST
    return (b * np.minimum(n, m) >= a * np.maximum(n, m)) & ((a + b) * np.minimum(n - i, m - j) >= a * (n + m))


@common.lean
def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of keys of few documents, first pairs of the others, and these keys whole."""
    held = [[b.column(k).to_numpy() for k in range(4)] for b in batches if b.num_rows]
    if not held:
        return
    key, doc, size, place = (np.concatenate(x) for x in zip(*held, strict=True))
    held.clear()
    order = np.lexsort((doc, size, key))
    key, doc, size, place = key[order], doc[order], size[order].astype(np.int64), place[order].astype(np.int64)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    counts = np.diff(np.r_[starts, len(key)])
    first, second, groups = [], [], []
    for gap in range(1, FEW):  # documents of small keys that are so far apart
        s, c = starts[(counts > gap) & (counts <= FEW)], counts[(counts > gap) & (counts <= FEW)]
        if len(s):
            inside = np.arange((c - gap).sum()) - np.repeat(np.cumsum(c - gap) - (c - gap), c - gap)
            first.append(np.repeat(s, c - gap) + inside)
            second.append(first[-1] + gap)
    for s, c in zip(starts[counts > FEW].tolist(), counts[counts > FEW].tolist(), strict=True):
        at = np.arange(s, s + c)
        first += [at[:-1], np.full(c, s + int(doc[s : s + c].argmin()))]
        second += [at[1:], at]
        groups.append([x[s : s + c].tolist() for x in (doc, size, place)])
    if first:
        a, b = np.concatenate(first), np.concatenate(second)
        good = (doc[a] != doc[b]) & _possible(size[a], place[a], size[b], place[b])
        yield _pairs(doc[a[good]], doc[b[good]])
    for g in groups:
        kinds = (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
        yield pa.record_batch([*(pa.nulls(1, pa.int64()) for _ in range(3)), *(pa.array([x], k) for x, k in zip(g, kinds, strict=True))], names=["u", "v", "n", "ids", "sizes", "places"])


def _sketch(keys: np.ndarray) -> bytes:
    """Parities of how many of the different hashes fall on each bit; bits are a power of two, as many as hashes at least, 64 or more."""
    bits = 1 << max(6, (len(keys) - 1).bit_length())
    ones = np.bincount((keys & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(ones.astype(np.uint8), bitorder="little").tobytes()


def _may_be(a: bytes, n: int, b: bytes, m: int) -> bool:
    """Sets of n and m shingles with these sketches can be similar enough."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    bits, least = 8 * max(len(a), len(b)), 8 * min(len(a), len(b))
    if len(a) < len(b):
        x, y = y, x
    while bits > least:  # the longer one as it is with half the bits
        bits //= 2
        x = (x >> bits) ^ (x & ((1 << bits) - 1))
    return (LEAST[0] + LEAST[1]) * (x ^ y).bit_count() <= (LEAST[1] - LEAST[0]) * (n + m)


@common.lean
def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes, out = [], []
        for text in _texts(b, "text"):
            keys = _hashes(text)
            sizes.append(len(keys))
            out.append(_sketch(keys))
        yield pa.record_batch([b.column("doc_id"), pa.array(sizes, pa.int32()), pa.array(out, pa.binary())], names=["doc_id", "size", "sketch"])


@common.lean
def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that their sketches don't rule out."""
    for b in batches:
        keep = [_may_be(*x) for x in zip(*(b.column(c).to_pylist() for c in ("sketch_u", "size_u", "sketch_v", "size_v")), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Different pairs, larger id first, and how many keys have each."""
    found, n = np.unique(np.c_[np.maximum(a, b), np.minimum(a, b)], axis=0, return_counts=True)
    none = [pa.nulls(len(found), pa.list_(t)) for t in (pa.int64(), pa.int32(), pa.int32())]
    return pa.record_batch([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(n, pa.int64()), *none], names=["u", "v", "n", "ids", "sizes", "places"])


def _apart(likeliest: bool) -> Callable:
    """Pairs of a key whose documents aren't in one component yet; members: structs of id, size, place, root.

    likeliest: of the pairs of a document only the one whose other document has the fewest shingles of its own before the key.
    """

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members in batch.column("members"):
                doc, size, place, root = (members.values.field(k).to_numpy() for k in range(4))
                kinds, at, n = np.unique(root, return_inverse=True, return_counts=True)
                if len(kinds) < 2:
                    continue
                size, place = size.astype(np.int64), place.astype(np.int64)
                for k in np.flatnonzero(at != n.argmax()).tolist():  # each document beside the largest component
                    other = np.flatnonzero((at != at[k]) & _possible(size, place, size[k], place[k]))
                    if len(other):
                        if likeliest:
                            other = other[[int(np.lexsort((doc[other], place[other]))[0])]]
                        yield _pairs(np.full(len(other), doc[k]), doc[other]).select(["u", "v"])

    return run


@common.lean
def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        last: list = [None, set()]
        keep = []
        for v, one, other in zip(b.column("v").to_pylist(), _texts(b, "text_u"), _texts(b, "text_v"), strict=True):
            if (v, other) != last[0]:
                last = [(v, other), shingles(other)]
            keep.append(similar(shingles(one), last[1]))
        yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _of(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of the rows (doc_id, ...) whose documents are in pairs."""
    ids = common.cut(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct())
    return common.cut(rows.join(F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids, "doc_id", "left_semi"))


def _both(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """u, v and the other columns of rows (doc_id, ...) for both, with _u and _v after their names."""
    for end in ("u", "v"):
        pairs = pairs.join(rows.select(*[F.col(c).alias(end if c == "doc_id" else f"{c}_{end}") for c in rows.columns]), end)
    return pairs


def _alike(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The different pairs that their sketches don't rule out."""
    pairs = common.cut(pairs.distinct())
    return common.cut(_both(pairs, _of(pairs, sketches)).mapInArrow(_left, _PAIR).distinct())


def _edges(pairs: DataFrame, docs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Those of the pairs whose texts are similar enough."""
    pairs = _alike(pairs, sketches)
    return common.cut(_both(pairs, _of(pairs, docs)).select("u", "v", "text_u", "text_v").mapInArrow(_verified, _PAIR).distinct())


def _across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (u, v, n) whose two documents aren't in one component yet, with root_u and root_v."""
    one = roots.select(F.col("node").alias("u"), F.col("root").alias("root_u"))
    other = roots.select(F.col("node").alias("v"), F.col("root").alias("root_v"))
    named = pairs.join(one, "u", "left").join(other, "v", "left")
    return named.select("u", "v", "n", F.coalesce("root_u", "u").alias("root_u"), F.coalesce("root_v", "v").alias("root_v")).filter("root_u <> root_v")


def _best_of_documents(pairs: DataFrame) -> DataFrame:
    """u, v: of the pairs of each document the one that shares most keys; as many pairs as documents at most."""
    ends = F.array(F.struct(F.col("u").alias("at"), F.col("v").alias("other"), F.lit(True).alias("first")), F.struct(F.col("v").alias("at"), F.col("u").alias("other"), F.lit(False).alias("first")))
    both = pairs.select("n", F.explode(ends).alias("e")).select("n", "e.*")
    best = both.groupBy("at").agg(F.max(F.struct("n", -F.col("other"), "first")).alias("x"))
    at, other = F.col("at"), -F.col("x.col2")
    return best.select(F.greatest(at, other).alias("u"), F.least(at, other).alias("v"))


def _best_of_components(pairs: DataFrame) -> DataFrame:
    """u, v: of the pairs of each two components the one that shares most keys."""
    key = F.greatest("root_u", "root_v").alias("a"), F.least("root_u", "root_v").alias("b")
    return pairs.groupBy(*key).agg(F.max(F.struct("n", "u", "v")).alias("x")).select("x.u", "x.v")


def _all(pairs: DataFrame) -> DataFrame:
    return pairs.select("u", "v")


def near_duplicates(docs: DataFrame, close: DataFrame | None = None) -> DataFrame:
    """doc_id, component_id of the documents that have a near-duplicate; close: pairs (u, v) of ids that are looked at first."""
    spark = docs.sparkSession
    common.ship(spark)
    read = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = common.cut(read.mapInArrow(_sketched, "doc_id long, size int, sketch binary"))
    known = _edges(close, read, sketches) if close is not None else None
    sample = read.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(_sampled, "key long")
    counted = common.cut(sample.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    rows = SAMPLE * (counted.agg(F.sum("n")).first()[0] or 0) * (LEAST[1] - LEAST[0]) // LEAST[1]
    top = counted.filter(F.col("n") >= FREQUENT).orderBy(F.col("n").desc(), "key").limit(MOST_FREQUENT).toArrow()
    frequent, n = top.column("key").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(frequent)
    rank = np.empty(len(n), np.int64)
    rank[np.lexsort((frequent, n))] = np.arange(1, len(n) + 1)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    filed = read.mapInArrow(_prefixes(frequent[order], rank[order]), "key long, doc_id long, size int, place int").repartition(parts, "key")
    met = common.cut(filed.mapInArrow(_meet, f"{_PAIR}, n long, {_GROUP}"))
    # Pairs of a large group are many, and most needn't be compared: those whose documents are linked by then are left out each time.
    pairs = common.cut(met.filter("u is not null").groupBy("u", "v").agg(F.sum("n").alias("n")))
    edges = known if known is not None else common.cut(pairs.limit(0).select("u", "v"))
    for chosen in (_best_of_documents, _best_of_components, _all):
        pairs = common.cut(_across(pairs, components(edges)).select("u", "v", "n", "root_u", "root_v"))
        if pairs.isEmpty():
            break
        edges = common.cut(edges.unionByName(_edges(chosen(pairs), read, sketches)))
        pairs = pairs.select("u", "v", "n")
    roots = components(edges)
    crowded = met.filter("ids is not null").select("ids", "sizes", "places").distinct().withColumn("at", F.monotonically_increasing_id())
    crowded = common.cut(crowded.select("at", F.explode(F.arrays_zip("ids", "sizes", "places")).alias("m")).select("at", F.col("m.ids").alias("doc_id"), F.col("m.sizes").alias("size"), F.col("m.places").alias("place")))
    member = F.struct("doc_id", "size", "place", F.coalesce("root", "doc_id").alias("root"))
    for likeliest in (True, False):
        named = crowded.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").groupBy("at").agg(F.collect_list(member).alias("members"))
        more = _edges(named.select("members").mapInArrow(_apart(likeliest), _PAIR), read, sketches)
        if not more.isEmpty():
            edges = common.cut(edges.unionByName(more))
            roots = components(edges)
    return roots.select(F.col("node").alias("doc_id"), F.col("root").alias("component_id"))
