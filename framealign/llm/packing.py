"""Packing of token pieces into sequences: bounded-space online best-fit.

A document is its token ids and an end id. A document longer than a sequence is cut into full pieces and a last, shorter
one; all others are one piece. Each task reads its pieces in a pseudo-random order of their row numbers (rows that share a
doc_id, or have none, are spread like any others), and holds at most OPEN_BINS bins. A bitset over free space has a bit for each free space that some open bin has, so the best
fit is the lowest bit at or above the piece's length. A piece that fits nowhere opens a bin; if all places are taken, the
fullest open bin closes first. The bins that are open when a task's pieces end are emptied again, and their pieces go on
to a next pass of fewer tasks, until one task is left; so what stays unfilled doesn't grow with the number of tasks. With
`settle`, an optional step after the method, the last task puts the pieces of its last open bins again, longest first.

Cases: null counts as empty, an empty text is one piece (its end id). A null doc_id is packed like any other. Rows that
repeat a doc_id are packed each. An empty table gives no sequences. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .huffman import vocabulary_path
from .tokens import encoder, slices

LENGTH = 2048
END_ID = 0
OPEN_BINS = 1024
#: Characters of texts whose ids a task makes at once.
BLOCK = 4_000_000
#: Sequences that one task fills, about.
TASK_SEQUENCES = 8192


def _pieces(path: str, end_id: int, length: int):  # noqa: ANN202
    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row = encoder(path), TaskContext.get().partitionId() << 40
        for texts, docs in ((texts, b.column("doc_id").slice(at, len(texts))) for b in batches for at, texts in slices(b.column("text"), BLOCK)):
            rows: list[tuple] = []
            for doc, raw in zip(docs.to_pylist(), own.encode(texts), strict=True):
                ids = np.append(np.frombuffer(raw, own.dtype), end_id).astype("<u4").tobytes()
                for k in range(0, len(ids), 4 * length):
                    part = ids[k : k + 4 * length]
                    rows.append((row, doc, k // (4 * length), k // 4, len(part) // 4, zlib.crc32(part)))
                    row += 1
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["row", "doc_id", "piece", "start", "length", "ids_crc32"])
        own.forget()

    return run


def pieces(docs: DataFrame, path: str, end_id: int = END_ID, length: int = LENGTH) -> DataFrame:
    """row (a number of its own), doc_id, piece, start, length, ids_crc32 of each piece."""
    common.ship(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(_pieces(path, end_id, length), "row long, doc_id long, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Open bins by free space. A bin is its list of items; `put` returns the bins that closed."""

    def __init__(self, length: int, places: int):
        self.length, self.places, self.open, self.mask = length, places, 0, 0
        self.by_free: list[list[list]] = [[] for _ in range(length + 1)]

    def _take(self, free: int) -> list:
        held = self.by_free[free]
        out = held.pop()
        if not held:
            self.mask &= ~(1 << free)
        self.open -= 1
        return out

    def _lowest(self, at_least: int) -> int:
        rest = self.mask >> at_least
        return at_least + (rest & -rest).bit_length() - 1 if rest else -1

    def put(self, item: object, size: int) -> list[list]:
        closed = []
        free = self._lowest(size)
        if free < 0:
            if size < self.length and self.open >= self.places:
                closed.append(self._take(self._lowest(0)))
            free, held = self.length, []
        else:
            held = self._take(free)
        held.append(item)
        free -= size
        if free:
            self.by_free[free].append(held)
            self.mask |= 1 << free
            self.open += 1
        else:
            closed.append(held)
        return closed

    def rest(self) -> list[list]:
        return [b for held in self.by_free for b in held]


_SCHEMA = "row long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _pack(length: int, places: int, level: int, last: bool, settle: bool):  # noqa: ANN202
    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, made = Bins(length, places), (level << 58) + (TaskContext.get().partitionId() << 32)

        def rows(closed: list[list], done: bool) -> Iterator[pa.RecordBatch]:
            nonlocal made
            out = []
            for held in closed:
                at = 0
                for item in held:
                    out.append((*item, made if done else None, at if done else None))
                    at += item[4]
                made += 1
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                names = ["row", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            closed = []
            for item in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                closed += bins.put(item, item[4])
            yield from rows(closed, True)
        yield from rows(settled(bins.rest(), length) if last and settle else bins.rest(), last)

    return run


def settled(bins: list[list], length: int) -> list[list]:
    """The last open bins (OPEN_BINS at most) with their pieces put again, longest first, if that takes fewer bins."""
    again = Bins(length, sum(map(len, bins)) + 1)
    closed = [b for item in sorted((i for held in bins for i in held), key=lambda i: (-i[4], i[0])) for b in again.put(item, item[4])]
    better = closed + again.rest()
    return better if len(better) < len(bins) else bins


def pack(items: DataFrame, length: int = LENGTH, places: int = OPEN_BINS, settle: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of items (see `pieces`).

    settle: whether the last task puts the pieces of its open bins again, longest first.
    """
    done: list[DataFrame] = []
    level = 0
    parts = None
    while True:
        total = items.agg(F.sum("length")).first()[0] or 0
        wanted = max(1, -(-total // (length * TASK_SEQUENCES)))
        parts = wanted if parts is None else max(1, min(wanted, parts // 2))
        dealt = items.withColumn("h", F.xxhash64("row", F.lit(level)))
        dealt = (dealt.repartition(parts, "h") if parts > 1 else dealt.coalesce(1)).sortWithinPartitions("h", "row").drop("h")
        packed = dealt.mapInArrow(_pack(length, places, level, parts == 1, settle), _SCHEMA)
        if parts == 1:
            done.append(packed)
            break
        packed = common.cut(packed)
        done.append(packed.filter("sequence_id is not null"))
        items = packed.filter("sequence_id is null").drop("sequence_id", "offset")
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("row")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.cut(pieces(common.table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))))
