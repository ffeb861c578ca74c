"""Exact deduplication against a minimal perfect hash over the distinct digests of earlier rows.

Digest: SHA-256 of the UTF-8 text with A-Z lower-cased; null counts as empty.

History. The distinct digests of earlier rows are cut into buckets by their leading bits. For each bucket one task
builds a minimal perfect hash: levels of bit arrays, a key sits in the first level in which it collides with no
other key, and its slot is the rank of its bit. A slot holds the full digest, the locator of the winner (its doc_id
and row number) and the number of rows. One bucket is one row of the index table, so an index can be written and read
again.

Lookup. New rows are grouped by digest first (partial aggregation, so a text that fills a third of the table is one
row per task), then meet the bucket of their digest. A perfect hash also answers for keys it never saw, so the full
digest in the slot is compared. Members are repeats of the slot's winner, and their rows are added to the slot's; the
others are groups of their own. The groups of all digests are the slots and these: nothing else groups a digest.

Cases: rows with a null doc_id take part, never win over a numbered row, and are kept only if no row of the group has
a number. Rows that repeat a doc_id with the same text are one document and share their flags (`row` tells them apart:
of these the one with the largest is `keep_row`). An empty table gives an empty result. Columns other than doc_id and
text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Distinct digests per bucket, on average. A bucket is built and read by one task.
BUCKET_KEYS = 8192
#: Bits per remaining key in each level of the perfect hash.
GAMMA = 2.0


@common.lean
def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = hashlib.sha256
    for b in batches:
        data, offs = common.raw_text(b.column("text"))
        view = memoryview(data.translate(common.LOWER_AZ))
        out = [sha(view[s:e]).digest() for s, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        yield pa.record_batch([b.column("row"), b.column("doc_id"), pa.array(out, pa.binary())], names=["row", "doc_id", "digest"])


def digests(docs: DataFrame, row: str | None = None) -> DataFrame:
    """row long, doc_id long, digest binary (32 bytes); row: the column that numbers the rows, if there is one."""
    common.ship(docs.sparkSession)
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    read = docs.select(number.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(_digests, "row long, doc_id long, digest binary")


def _grouped(rows: DataFrame) -> DataFrame:
    """digest, winner, row, n: the largest doc_id, a numbered one before null, then the largest row."""
    best = F.max(F.struct("doc_id", "row"))
    return rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("n")).select("digest", F.col("best.doc_id").alias("winner"), F.col("best.row").alias("row"), "n")


def _bucket(buckets: int) -> F.Column:
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(buckets)).cast("int")


# ---- the perfect hash of one bucket ----


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """keys: n x 4 of uint64."""
    with np.errstate(over="ignore"):
        x = keys[:, 1] ^ (keys[:, 2] + np.uint64((level * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1)))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def build_bucket(keys: np.ndarray, winners: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> bytes:
    """keys: n x 32 of uint8, all different; winners: _NO_ID where there is none."""
    n = len(keys)
    words = np.ascontiguousarray(keys).view("<u8").reshape(n, 4)
    left, sizes, bits, slot, base, level = np.arange(n), [], [], np.zeros(n, np.int64), 0, 0
    while len(left):
        m = max(64, int(GAMMA * len(left)) + 1)
        at = (_mixed(words[left], level) % np.uint64(m)).astype(np.int64)
        hits = np.bincount(at, minlength=m)
        alone = hits[at] == 1
        mark = hits == 1
        slot[left[alone]] = base + np.cumsum(mark)[at[alone]] - 1
        base += int(mark.sum())
        bits.append(np.packbits(mark, bitorder="little"))
        sizes.append(m)
        left, level = left[~alone], level + 1
    order = np.argsort(slot)
    head = np.array([n, level, *sizes], "<i8")
    return b"".join([head.tobytes(), *(x.tobytes() for x in bits), keys[order].tobytes(), *(x[order].astype("<i8").tobytes() for x in (winners, rows, counts))])


class Bucket:
    """A built bucket, read back."""

    def __init__(self, blob: bytes):
        n, levels = np.frombuffer(blob, "<i8", 2)
        self.n, at = int(n), 16 + 8 * int(levels)
        self.sizes = np.frombuffer(blob, "<i8", int(levels), 16).tolist()
        self.marks, self.ranks, base = [], [], 0
        for m in self.sizes:
            size = (m + 7) // 8
            mark = np.unpackbits(np.frombuffer(blob, np.uint8, size, at), bitorder="little", count=m).astype(bool)
            rank = np.cumsum(mark) + base - 1
            base = int(rank[-1]) + 1
            self.marks.append(mark)
            self.ranks.append(rank)
            at += size
        self.keys = np.frombuffer(blob, np.uint8, 32 * self.n, at).reshape(self.n, 32)
        self.winners = np.frombuffer(blob, "<i8", self.n, at + 32 * self.n)
        self.rows = np.frombuffer(blob, "<i8", self.n, at + 40 * self.n)
        self.counts = np.frombuffer(blob, "<i8", self.n, at + 48 * self.n)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where the slot holds another digest or there is none."""
        found, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        words = np.ascontiguousarray(keys).view("<u8").reshape(len(keys), 4)
        for level, (m, mark, rank) in enumerate(zip(self.sizes, self.marks, self.ranks, strict=True)):
            at = (_mixed(words[left], level) % np.uint64(m)).astype(np.int64)
            hit = mark[at]
            found[left[hit]] = rank[at[hit]]
            left = left[~hit]
        some = np.flatnonzero(found >= 0)
        wrong = ~(self.keys[found[some]] == keys[some]).all(axis=1)
        found[some[wrong]] = -1
        return found


#: Locator of a group without a numbered row.
_NO_ID = np.iinfo(np.int64).min


def _keys(t: pa.Table) -> np.ndarray:
    col = t.column("digest").combine_chunks()
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    return np.frombuffer(common.raw_text(col)[0], np.uint8).reshape(len(col), 32)


def _numbers(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).combine_chunks().fill_null(_NO_ID).to_numpy()


def _build(t: pa.Table) -> pa.Table:
    blob = build_bucket(_keys(t), _numbers(t, "winner"), _numbers(t, "row"), _numbers(t, "n"))
    return pa.table({"bucket": pa.array([t.column("bucket")[0].as_py()], pa.int32()), "slots": pa.array([blob], pa.binary())})


def _groups(keys: np.ndarray, winner: np.ndarray, row: np.ndarray, n: np.ndarray, member: bool) -> pa.Table:
    digest = pa.array([k.tobytes() for k in keys], pa.binary())
    return pa.table([digest, pa.array(winner, pa.int64(), mask=winner == _NO_ID), pa.array(row, pa.int64()), pa.array(n, pa.int64()), pa.array([member] * len(keys), pa.bool_())], names=["digest", "winner", "row", "n", "known"])


def _look_up(asked: pa.Table, index: pa.Table) -> pa.Table:
    """The bucket's slots, with the rows that were asked for added, and the groups that no slot knows."""
    none = np.empty(0, np.int64)
    keys, own = (_keys(asked), [_numbers(asked, c) for c in ("winner", "row", "n")]) if len(asked) else (np.empty((0, 32), np.uint8), [none] * 3)
    if not len(index):
        return _groups(keys, *own, False)
    bucket = Bucket(index.column("slots")[0].as_py())
    slot = bucket.find(keys)
    member = slot >= 0
    at = slot[member]
    winners, rows, counts = bucket.winners.copy(), bucket.rows.copy(), bucket.counts.copy()
    counts[at] += own[2][member]  # a digest is asked for once
    unnumbered = winners[at] == _NO_ID
    winners[at[unnumbered]] = own[0][member][unnumbered]
    rows[at[unnumbered]] = own[1][member][unnumbered]
    return pa.concat_tables([_groups(bucket.keys, winners, rows, counts, True), _groups(keys[~member], *(x[~member] for x in own), False)])


def build_index(groups: DataFrame, distinct: int) -> tuple[DataFrame, int]:
    """Index table (bucket, slots) over groups (digest, winner, row, n), and its number of buckets."""
    buckets = max(1, -(-distinct // BUCKET_KEYS))
    index = groups.withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInArrow(_build, "bucket int, slots binary")
    return index, buckets


def look_up(groups: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """digest, winner, row, n, known of all digests: the slots of the index with the rows of groups (digest, winner, row, n) that they know, and the other groups."""
    asked = groups.withColumn("bucket", _bucket(buckets))
    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(_look_up, "digest binary, winner long, row long, n long, known boolean")


def exact_dedup(batch: DataFrame, history: DataFrame) -> DataFrame:
    """Rows of both tables of digests (row, doc_id, digest), earlier ones in `history`: row, doc_id, digest, keep_id, keep_row, group_size.

    History wins over the batch; within either the largest doc_id wins.
    """
    known = common.cut(_grouped(history))
    index, buckets = build_index(known, known.count())
    # a text that is there once keeps itself, so only groups of two and more are joined; the skewed side is split at run time
    repeated = look_up(_grouped(batch), index, buckets).filter("n > 1").select("digest", F.col("winner").alias("keep_id"), F.col("row").alias("keep_row"), F.col("n").alias("group_size"))
    out = history.unionByName(batch).join(repeated, "digest", "left")
    alone = F.col("group_size").isNull()
    return out.select(
        "row", "doc_id", "digest", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("keep_row", "row").alias("keep_row"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
    )


def _halves(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One table of digests as history (the upper half of the ids, which hold the winners) and batch (the lower half)."""
    lo, hi = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = 0 if lo is None else lo + (hi - lo) // 2
    return rows.filter(F.col("doc_id") > middle), rows.filter((F.col("doc_id") <= middle) | F.col("doc_id").isNull())


def dedup_table(docs: DataFrame, row: str | None = None) -> DataFrame:
    """row, doc_id, keep_id, keep_row, group_size, kept, text_sha256 for every row of one table; row: see `digests`."""
    history, batch = _halves(common.cut(digests(docs, row)))
    out = exact_dedup(batch, history)
    return out.select("row", "doc_id", "keep_id", "keep_row", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_table(common.table(spark, sf_dir, "documents")).drop("row", "keep_row")


OP7_SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id AS doc_id, g.keep_id AS keep_id, CAST(g.group_size AS BIGINT) AS group_size,
       n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
