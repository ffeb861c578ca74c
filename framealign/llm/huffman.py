"""Token ids in a binary format: canonical length-limited Huffman codes, decoded by table in independent blocks.

Steps: texts to ids (`tokens`), an end id after each document; ids counted over all documents; code lengths of at most
MAX_BITS (more if there are more ids in use than such codes) by package-merge; canonical codes. Documents are written in
ascending doc_id order as segments. A segment is one binary value: a header, its documents (doc_id and number of ids), and
blocks of at most BLOCK_IDS ids. A block has its bit stream and the bit offset of every STRIDE-th id, so that a reader
starts anywhere, and decodes all strides side by side: the next bits are looked up in a table of (id, length).

File. A folder with two Parquet tables: `codebook` (one row: the length of each id's code) and `segments` (segment, n_ids,
payload). It holds all that a later session needs to decode it. Spark's writer commits the tables, the codebook first, so a
lost executor leaves no half-written segment.

Order. Rows are dealt out by ranges of (doc_id, row), so that a doc_id that very many rows share, or null, is split too.

Cases: null counts as empty, an empty text is its end id alone. Equal doc_ids stand in the order in which they were read.
Rows with a null doc_id come first. An empty table has no segments. Ids that no document holds get no code. A codebook of
one id gives it one bit. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .tokens import encoder, slices

MAX_BITS = 16
#: A code and the bits before it in its first byte fit 32 bits.
MOST_BITS = 24
STRIDE = 256
BLOCK_IDS = 1 << 18
#: Ids of one range of documents, which one task writes in order, and of a segment, about.
RANGE_IDS = 1 << 23
SEGMENT_IDS = 1 << 20
END_ID = 2


# ---- codes ----


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Length of each id's code (0: it has none), by package-merge."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    limit = max(limit, (len(used) - 1).bit_length())
    if limit > MOST_BITS:
        raise ValueError("more ids in use than codes of 24 bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    levels, weights = [], leaves
    levels.append(np.ones(len(leaves), bool))
    for _ in range(limit - 1):
        even = len(weights) // 2 * 2
        packages = weights[0:even:2] + weights[1:even:2]
        both = np.r_[leaves, packages]
        at = np.argsort(both, kind="stable")
        weights = both[at]
        levels.append(at < len(leaves))
    take, lengths = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for leaf in reversed(levels):
        own = int(leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out[order] = lengths
    return out


class Codebook:
    """Canonical codes of given lengths, and the table that decodes them."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.most = most = max(MAX_BITS, int(self.lengths.max(initial=0)))
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        size = np.int64(1) << (most - self.lengths[order])
        first = np.cumsum(np.r_[0, size])
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = (first[:-1] >> (most - self.lengths[order])).astype(np.uint64)
        self.ids = np.zeros(1 << most, np.uint32)
        self.bits = np.ones(1 << most, np.uint8)
        self.ids[: first[-1]] = np.repeat(order, size)
        self.bits[: first[-1]] = np.repeat(self.lengths[order], size)

    def encode_block(self, ids: np.ndarray) -> bytes:
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        at = ends - sizes
        word = at >> 5
        value = self.codes[ids] << (64 - (at & 31) - sizes).astype(np.uint64)
        total = int(ends[-1]) if len(ids) else 0
        words = np.zeros((total >> 5) + 3, np.uint64)
        if len(ids):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            words[word[starts]] = np.add.reduceat(value >> np.uint64(32), starts)
            words[word[starts] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), starts)
        marks = at[::STRIDE].astype("<u4")
        bits = words.astype(">u4").tobytes()
        return b"".join([np.array([len(ids), len(bits)], "<u4").tobytes(), marks.tobytes(), bits])

    def decode_block(self, blob: memoryview, at: int) -> tuple[np.ndarray, int]:
        """The ids of the block that starts at a byte, and the byte after it."""
        n, size = np.frombuffer(blob, "<u4", 2, at).tolist()
        lanes = -(-n // STRIDE)
        p = np.frombuffer(blob, "<u4", lanes, at + 8).astype(np.int64)
        stream = np.frombuffer(blob, np.uint8, size, at + 8 + 4 * lanes).astype(np.uint32)
        window = stream[:-3] << 24 | stream[1:-2] << 16 | stream[2:-1] << 8 | stream[3:]
        out = np.zeros((lanes, STRIDE), np.uint32)
        last, spare, mask = len(window) - 1, 32 - self.most, np.uint32((1 << self.most) - 1)
        for step in range(min(n, STRIDE)):
            peek = window[np.minimum(p >> 3, last)] >> (spare - (p & 7)).astype(np.uint32) & mask
            out[:, step] = self.ids[peek]
            p += self.bits[peek]
        return out.reshape(-1)[:n], at + 8 + 4 * lanes + size


# ---- segments ----

_MAGIC = b"HTOK0001"


def write_segment(book: Codebook, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """Header, documents and blocks. A null doc_id is marked in a bitmap after the ids."""
    known = np.array([d is not None for d in doc_ids], bool)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    blocks = [book.encode_block(ids[s : s + BLOCK_IDS]) for s in range(0, len(ids), BLOCK_IDS)]
    head = np.array([len(doc_ids), len(ids), len(blocks)], "<i8")
    return b"".join([_MAGIC, head.tobytes(), numbers.tobytes(), np.packbits(known).tobytes(), counts.astype("<i8").tobytes(), *blocks])


def read_segment(book: Codebook, blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    view = memoryview(blob)
    if bytes(view[:8]) != _MAGIC:
        raise ValueError("not a segment")
    docs, total, blocks = np.frombuffer(view, "<i8", 3, 8).tolist()
    at = 32
    numbers = np.frombuffer(view, "<i8", docs, at).tolist()
    at += 8 * docs
    known = np.unpackbits(np.frombuffer(view, np.uint8, -(-docs // 8), at), count=docs).astype(bool).tolist()
    at += -(-docs // 8)
    counts = np.frombuffer(view, "<i8", docs, at)
    at += 8 * docs
    parts = []
    for _ in range(blocks):
        ids, at = book.decode_block(view, at)
        parts.append(ids)
    ids = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    if len(ids) != total:
        raise ValueError("a segment is cut short")
    return [d if k else None for d, k in zip(numbers, known, strict=True)], counts, ids


# ---- steps ----


def _tokenize(path: str, end_id: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row = encoder(path), TaskContext.get().partitionId() << 40
        end = np.array([end_id], own.dtype).tobytes()
        for b in batches:
            for at, texts in slices(b.column("text")):
                ids = [x + end for x in own.encode(texts)]
                doc = b.column("doc_id").slice(at, len(texts))
                yield pa.record_batch([doc, pa.array(np.arange(row, row + len(texts))), pa.array(ids, pa.binary())], names=["doc_id", "row", "ids"])
                row += len(texts)
        own.forget()

    return run


def _count(width: int, size: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(common.raw_text(b.column("ids"))[0], f"<u{width}"), minlength=size)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["id", "n"])

    return run


def _write(lengths, width: int):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, made = Codebook(lengths.value), TaskContext.get().partitionId() << 32
        for b in batches:
            column = b.column("ids")
            offs = common.offsets(column) // width
            at = 0
            while at < b.num_rows:
                to = min(b.num_rows, max(at + 1, int(np.searchsorted(offs, offs[at] + SEGMENT_IDS, side="right")) - 1))
                ids = np.frombuffer(common.raw_text(column.slice(at, to - at))[0], f"<u{width}")
                blob = write_segment(book, b.column("doc_id").slice(at, to - at).to_pylist(), np.diff(offs[at : to + 1]), ids)
                yield pa.record_batch([pa.array([made], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([blob], pa.binary())], names=["segment", "n_ids", "payload"])
                made, at = made + 1, to

    return run


def _read(lengths):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(lengths.value)
        for b in batches:
            for key, blob in zip(b.column("segment").to_pylist(), b.column("payload"), strict=True):
                docs, counts, ids = read_segment(book, blob.as_buffer())
                ends = np.cumsum(counts)
                flat = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(flat[4 * (e - n) : 4 * e]) for n, e in zip(counts.tolist(), ends.tolist(), strict=True)]
                yield pa.record_batch([pa.array([key] * len(docs), pa.int64()), pa.array(docs, pa.int64()), pa.array(ends - counts), pa.array(counts), pa.array(crc, pa.int64())], names=["segment", "doc_id", "within", "n_tokens", "ids_crc32"])

    return run


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int = END_ID) -> None:
    """Write the file of a table's ids to a new folder; path: of the tokenizer."""
    spark = docs.sparkSession
    common.ship(spark)
    own = encoder(path)
    width, vocabulary = own.dtype.itemsize, max(own.library.get_vocab_size(), end_id + 1)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = common.staged(read.mapInArrow(_tokenize(path, end_id), "doc_id long, row long, ids binary"), "ids", "zstd")
    counts = np.zeros(vocabulary, np.int64)
    # at most one row per id of the vocabulary
    for row in ids.select("ids").mapInArrow(_count(width, vocabulary), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row.id] = row.n
    lengths = code_lengths(counts)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").write.parquet(f"{folder}/codebook")
    parts = max(1, -(-int(counts.sum()) // RANGE_IDS))
    ordered = ids.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "row").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row")
    written = ordered.select("doc_id", "ids").mapInArrow(_write(spark.sparkContext.broadcast(lengths), width), "segment long, n_ids long, payload binary")
    written.write.option("parquet.enable.dictionary", "false").option("compression", "none").parquet(f"{folder}/segments")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the file in a folder."""
    common.ship(spark)
    lengths = np.frombuffer(spark.read.parquet(f"{folder}/codebook").first()[0], np.uint8)
    segments = spark.read.schema("segment long, n_ids long, payload binary").parquet(f"{folder}/segments")
    # one row per segment: a running sum over the table of contents, not over documents
    base = segments.select("segment", "n_ids").withColumn("base", F.sum("n_ids").over(Window.orderBy("segment")) - F.col("n_ids"))
    rows = segments.select("segment", "payload").mapInArrow(_read(spark.sparkContext.broadcast(lengths)), "segment long, doc_id long, within long, n_tokens long, ids_crc32 long")
    return rows.join(base, "segment").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.folder(spark, "tokens")
    write_tokens(common.table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), folder)
    return read_tokens(spark, folder)
