"""SimHash near-duplicates by multi-index hashing.

Fingerprint: A-Z lower-cased, words [^\\x20\\x09-\\x0D]+, shingles of three words joined by a space (repeats count; a
text of fewer words is one shingle; a text of none has fingerprint zero), XXH64 with seed 42 of each shingle. A bit is
set if it is set in more than half of the hashes. Fingerprints link at 3 or fewer differing bits.

Search. Distinct fingerprints are cut into two segments of 32 bits. Two fingerprints that differ in at most 3 bits
differ in at most one bit of one segment, so each fingerprint is filed under its two segments and asks for its
segments and their one-bit neighbours. Of two segments that differ in one bit just one has the bit set, so it is
enough to ask for those with a bit cleared. All rows of a key are compared on all 64 bits; the task walks from match to
match and writes one edge per member it reaches (a star to the least id), never all pairs. Stars meet in
`components.components`.

Cases: null and empty texts have fingerprint zero and link like any other. Rows with a null doc_id don't open links;
they get the component of an equal fingerprint, else null. Equal fingerprints are one class before anything is
compared, so a text that fills a third of the table costs one row. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, jaccard
from .components import components

MAX_BITS = 3
SHINGLE = 3
SEED = 42


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of a UTF-8 text, over shingles of `size` words."""
    words = text.translate(common.LOWER_AZ).split()
    if not words:
        return 0
    if len(words) <= size:
        shingles: list = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)))
    n = len(shingles)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):  # very long texts in blocks
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def _fingerprints(size: int):  # noqa: ANN202
    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = common.raw_text(b.column("text"))
            out = [fingerprint(data[s:e], size) for s, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            yield pa.record_batch([b.column("doc_id"), pa.array(out, pa.int64())], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""
    common.ship(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(_fingerprints(size), "doc_id long, fp long")


def _filed(classes: DataFrame) -> DataFrame:
    """key, fp, id, own: each fingerprint under its segments (own) and under those with one set bit cleared."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    parts = F.array(F.struct(F.lit(0).alias("seg"), low.alias("value")), F.struct(F.lit(1).alias("seg"), high.alias("value")))
    cut = classes.select("fp", "id", F.explode(parts).alias("p")).select("fp", "id", F.col("p.seg").alias("seg"), F.col("p.value").alias("value"))
    masks = F.array(*[F.lit(1 << k).cast("long") for k in range(32)])
    balls = F.concat(F.array(F.col("value")), F.transform(F.filter(masks, lambda m: F.col("value").bitwiseAND(m) != 0), lambda m: F.col("value") - m))
    asked = cut.select("fp", "id", "seg", "value", F.explode(balls).alias("at"))
    key = F.col("at") + F.col("seg").cast("long") * F.lit(1 << 32)
    return asked.select(key.alias("key"), "fp", "id", (F.col("at") == F.col("value")).alias("own"))


def _stars(fps: np.ndarray, ids: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges (member, least id of its component) among the rows of one key; each row is compared once it is reached."""
    fps, first = np.unique(fps, return_index=True)
    ids = ids[first]
    u: list[int] = []
    v: list[int] = []
    rest = np.arange(len(fps))
    while len(rest):
        reached, queue, rest = [int(rest[0])], [int(rest[0])], rest[1:]
        while queue and len(rest):
            near = np.bitwise_count(fps[rest] ^ fps[queue.pop()]) <= MAX_BITS
            if near.any():
                new = rest[near].tolist()
                reached += new
                queue += new
                rest = rest[~near]
        if len(reached) > 1:
            members = ids[reached]
            least = members.min()
            u += members[members != least].tolist()
            v += [int(least)] * (len(reached) - 1)
    return u, v


@common.lean
def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; a key may go on in the next batch."""
    held = [np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, bool)]

    def edges(key: np.ndarray, fp: np.ndarray, doc: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        u: list[int] = []
        v: list[int] = []
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        counts = np.diff(np.r_[starts, len(key)])
        filed = np.add.reduceat(own.astype(np.int64), starts)
        for s, c in zip(starts[(counts > 1) & (filed > 0)].tolist(), counts[(counts > 1) & (filed > 0)].tolist(), strict=True):
            a, b = _stars(fp[s : s + c], doc[s : s + c])
            u += a
            v += b
        if u:
            yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for b in batches:
        if not b.num_rows:
            continue
        new = [b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy(), b.column(3).to_numpy(zero_copy_only=False)]
        held = [np.concatenate(x) for x in zip(held, new, strict=True)]
        last = int(np.searchsorted(held[0], held[0][-1]))
        if last:
            yield from edges(*(x[:last] for x in held))
            held = [x[last:] for x in held]
    if len(held[0]):
        yield from edges(*held)


def _classes(rows: DataFrame) -> DataFrame:
    """fp, id (the least), n of the rows (doc_id, fp) with equal fingerprints."""
    return common.cut(rows.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")))


def _near(classes: DataFrame) -> DataFrame:
    """u, v: stars of classes that multi-index hashing finds at MAX_BITS or fewer differing bits."""
    parts = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-classes.count() * 34 // 4_000_000))
    filed = _filed(classes.filter("id is not null")).repartition(parts, "key").sortWithinPartitions("key")
    return filed.mapInArrow(_links, "u long, v long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for every row."""
    rows = common.cut(fingerprints(docs))
    classes = _classes(rows)
    roots = components(_near(classes))
    linked = classes.join(roots, classes["id"] == roots["node"], "left")
    joined = linked.filter("n > 1 or root is not null").select("fp", F.coalesce("root", "id").alias("component"))
    out = rows.join(joined, "fp", "left")
    return out.select("doc_id", "fp", F.coalesce("component", "doc_id").alias("component_id"))


def similar_documents(docs: DataFrame, row: str) -> DataFrame:
    """row, component of the documents with a near-duplicate: a similarity of 0.8 or more over sets of five-word shingles.

    row: the column that numbers the rows; component: the least row of those reachable. Fingerprints over five-word
    shingles and multi-index hashing find close ones, whose whole texts are then compared. A similarity of 0.8 may
    stand at twenty bits and more, which no ball of a size that can be enumerated reaches, so `jaccard` finds the pairs
    that this leaves open, exactly.
    """
    read = docs.select(F.col(row).alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = common.cut(fingerprints(read, jaccard.SHINGLE))
    classes = _classes(rows)
    roots = components(_near(classes))
    linked = classes.join(roots, classes["id"] == roots["node"], "left").filter("n > 1 or root is not null")
    # one pair per document at most: itself and the first of those that the fingerprints link it to
    close = rows.join(linked.select("fp", F.coalesce("root", "id").alias("v")), "fp").filter("doc_id <> v").select(F.col("doc_id").alias("u"), "v")
    found = jaccard.near_duplicates(read, close)
    return found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"))


def op2_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
