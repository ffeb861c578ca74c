"""Benchmark decontamination with an FM-index per training shard.

Words: A-Z lower-cased, [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+. A window is 10 consecutive words of an item; an item of
fewer words (but not none) is one window. A document word inside any occurrence of a window is hit.

A shard is a bounded slice of the documents that one task holds. Its words become symbols of the alphabet of the test
phrases; all words outside it become separators, and so do document borders. A run between separators that is shorter
than the shortest window can hold no occurrence and isn't indexed. Over the rest:

* suffix array by prefix doubling (separators are unique, so a run bounds the depth),
* Burrows-Wheeler transform in a wavelet matrix with popcount ranks,
* backward search of all windows at once, word by word from the end,
* occurrences located by walking to the next sampled suffix position (every 8th position and each start of a run).

Occurrences merge into removal spans per document.

The benchmark is read to the driver in blocks of at most BLOCK_BYTES of text, each sent to the executors and searched
in every shard in turn, so no block that is broadcast grows with the benchmark or the corpus.

Cases: null and empty texts have no words; an empty benchmark hits nothing; items may repeat (each item_id counts once);
null item_ids are not reported as items but their windows are hit. Rows with a null or repeated doc_id are rows like any
other. An empty table gives an empty result. Columns other than doc_id, text, item_id are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 10
#: Bytes of document text in one shard (a longer document is a shard of its own).
SHARD_BYTES = 16_000_000
#: Bytes of benchmark text searched at once.
BLOCK_BYTES = 8_000_000
SAMPLE = 8

#: A-Z to a-z, word bytes as they are, all others to a space.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SPAN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


class Phrases:
    """The windows of a block of items as rows of symbols, and which items hold each window."""

    def __init__(self, items: list[tuple[object, bytes]]):
        self.symbols: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], list[str]] = {}
        for item, text in items:
            ids = [self.symbols.setdefault(w, len(self.symbols) + 1) for w in words_of(text)]
            for at in range(max(1, len(ids) - WINDOW + 1) if ids else 0):
                held = windows.setdefault(tuple(ids[at : at + WINDOW]), [])
                if item is not None:
                    held.append(str(item))
        self.items = [sorted(set(x)) for x in windows.values()]
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.rows = np.zeros((len(windows), WINDOW), np.int64)
        for k, w in enumerate(windows):
            self.rows[k, : len(w)] = w
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0


class WaveletMatrix:
    """rank and access over symbols below 2**levels, with a popcount directory per 64 bits."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.n = levels, len(symbols)
        self.words, self.counts, self.zeros = [], [], []
        for level in range(levels - 1, -1, -1):
            bit = (symbols >> level & 1).astype(np.uint8)
            packed = np.zeros((self.n // 64 + 1) * 8, np.uint8)
            part = np.packbits(bit, bitorder="little")
            packed[: len(part)] = part
            words = packed.view("<u8")
            self.words.append(words)
            self.counts.append(np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.zeros.append(self.n - int(bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def _ones(self, k: int, i: np.ndarray) -> np.ndarray:
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[k][i >> 6] + np.bitwise_count(self.words[k][i >> 6] & mask)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol stands before place i."""
        start = np.zeros_like(i)
        for k in range(self.levels):
            bit = (symbol >> (self.levels - 1 - k) & 1).astype(bool)
            a, b = self._ones(k, start), self._ones(k, i)
            start = np.where(bit, self.zeros[k] + a, start - a)
            i = np.where(bit, self.zeros[k] + b, i - b)
        return i - start

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for k in range(self.levels):
            bit = (self.words[k][i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            ones = self._ones(k, i)
            i = np.where(bit == 1, self.zeros[k] + ones, i - ones)
            out = out << 1 | bit
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of symbols in which each 0 is unique, the earlier the smaller."""
    n = len(text)
    gaps = text == 0
    rank = np.where(gaps, np.cumsum(gaps) - 1, text + int(gaps.sum()))
    order, depth = np.argsort(rank, kind="stable"), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - depth] = rank[depth:] + 1
        key = rank * np.int64(max(int(rank.max()), int(after.max())) + 2) + after
        order = np.argsort(key, kind="stable")
        steps = np.r_[0, np.cumsum(key[order][1:] != key[order][:-1])]
        rank = np.empty(n, np.int64)
        rank[order] = steps
        if steps[-1] == n - 1:
            return order
        depth *= 2


class FMIndex:
    def __init__(self, text: np.ndarray, alphabet: int):
        """text: symbols 1..alphabet and separators 0; begins and ends with a separator."""
        order = suffix_array(text)
        bwt = text[order - 1]
        self.matrix = WaveletMatrix(bwt, max(1, int(alphabet).bit_length()))
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=alphabet + 1))]
        marked = (order % SAMPLE == 0) | (bwt == 0)
        self.marked, self.samples = marked, order[marked]
        self.sample_at = np.cumsum(marked) - 1

    def search(self, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the range of suffixes that start with each row of symbols."""
        lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), self.matrix.n, np.int64)
        for step in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((step < lengths) & (lo < hi))
            if not len(live):
                break
            c = rows[live, lengths[live] - 1 - step]
            lo[live] = self.before[c] + self.matrix.rank(c, lo[live])
            hi[live] = self.before[c] + self.matrix.rank(c, hi[live])
        return lo, hi

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text places of suffixes, by walking back to sampled ones."""
        place, walked, left = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.arange(len(at))
        at = at.copy()
        while len(left):
            done = self.marked[at[left]]
            hit = left[done]
            place[hit] = self.samples[self.sample_at[at[hit]]] + walked[hit]
            left = left[~done]
            c = self.matrix.access(at[left])
            at[left] = self.before[c] + self.matrix.rank(c, at[left])
            walked[left] += 1
        return place


def shard_hits(ids: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Word places and windows of all occurrences in a shard; ids: symbols of its words, 0 outside the alphabet."""
    none = np.empty(0, np.int64)
    inside = np.r_[0, (ids > 0).astype(np.int8), 0]
    turn = np.flatnonzero(np.diff(inside))
    starts, stops = turn[0::2], turn[1::2]
    long = stops - starts >= max(1, phrases.shortest)
    starts, stops = starts[long], stops[long]
    if not len(starts):
        return none, none
    sizes = stops - starts
    # each run is followed by a separator, and one stands first
    total = int(sizes.sum()) + len(sizes) + 1
    text, origin = np.zeros(total, np.int64), np.full(total, -1, np.int64)
    heads = 1 + np.cumsum(np.r_[0, sizes[:-1] + 1])
    within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(np.r_[0, sizes[:-1]]), sizes)
    into, source = np.repeat(heads, sizes) + within, np.repeat(starts, sizes) + within
    text[into], origin[into] = ids[source], source
    index = FMIndex(text, len(phrases.symbols))
    lo, hi = index.search(phrases.rows, phrases.lengths)
    found = np.flatnonzero(lo < hi)
    if not len(found):
        return none, none
    sizes = (hi - lo)[found]
    rows = np.repeat(lo[found], sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(np.r_[0, sizes[:-1]]), sizes)
    return origin[index.locate(rows)], np.repeat(found, sizes)


def _shard(texts: list[bytes], blocks: Iterable[Phrases]) -> Iterator[tuple]:
    """(n_words, n_hit, items, spans) of each document of a shard; spans in code points."""
    # each different word is held once, and its number at each of its places
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    words = [np.fromiter(map(numbers.__getitem__, own), np.int32, len(own)) for own in map(words_of, texts)]
    counts = [len(w) for w in words]
    # a separator word between documents
    firsts = np.r_[0, np.cumsum(np.array(counts, np.int64) + 1)]
    at_place = np.full(int(firsts[-1]), -1, np.int32)
    for at, own in zip(firsts[:-1].tolist(), words, strict=True):
        at_place[at : at + len(own)] = own
    del words
    edge = np.zeros(int(firsts[-1]) + 1, np.int64)
    held: dict[int, set[str]] = {}
    for phrases in blocks:
        if not phrases.lengths.size:
            continue
        symbol = np.fromiter(map(phrases.symbols.get, numbers, repeat(0)), np.int32, len(numbers))
        places, windows = shard_hits(np.append(symbol, np.int32(0))[at_place], phrases)
        np.add.at(edge, places, 1)
        np.add.at(edge, places + phrases.lengths[windows], -1)
        doc_of = np.searchsorted(firsts, places, side="right") - 1
        for d, w in set(zip(doc_of.tolist(), windows.tolist(), strict=True)):
            held.setdefault(d, set()).update(phrases.items[w])
    hit = np.cumsum(edge)[:-1] > 0
    for d, (text, n) in enumerate(zip(texts, counts, strict=True)):
        if d not in held:
            yield n, 0, [], []
            continue
        own = hit[firsts[d] : firsts[d] + n]
        turn = np.flatnonzero(np.diff(np.r_[0, own.astype(np.int8), 0]))
        places_of = [m.span() for m in _SPAN.finditer(text)]
        spans = []
        for a, b in zip(turn[0::2].tolist(), turn[1::2].tolist(), strict=True):
            s = len(text[: places_of[a][0]].decode("utf-8", "replace"))
            spans.append((s, s + len(text[places_of[a][0] : places_of[b - 1][1]].decode("utf-8", "replace"))))
        yield n, int(own.sum()), sorted(held[d]), spans


_SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _in_turn(shared: list) -> Iterator[Phrases]:
    """The broadcast blocks; where there are several, a worker holds one at a time."""
    for block in shared:
        yield block.value
        if len(shared) > 1 and hasattr(block, "_value"):
            del block._value


def _found(column: pa.Array, shared: list) -> Iterator[tuple[int, list[tuple]]]:
    """The rows of `_shard` for a column of texts a shard at a time, with the row each starts at."""
    data, offs = common.raw_text(column)
    ends, at = offs.tolist(), 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + SHARD_BYTES, side="right")) - 1)
        to = min(to, len(column))
        yield at, list(_shard([data[ends[k] : ends[k + 1]] for k in range(at, to)], _in_turn(shared)))
        at = to


def _search(shared: list):  # noqa: ANN202
    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, rows in _found(b.column("text"), shared):
                spans = [[{"start": s, "end": e} for s, e in r[3]] for r in rows]
                yield pa.record_batch(
                    [b.column("doc_id").slice(at, len(rows)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.string())), pa.array(spans, _SPANS)],
                    names=["doc_id", "n_words", "n_hit", "items", "spans"],
                )

    return run


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, bytes]]]:
    block: list[tuple[object, bytes]] = []
    size = 0
    for row in benchmark.select("item_id", F.col("text").cast("string").alias("text")).toLocalIterator():
        text = (row.text or "").encode()
        if block and size + len(text) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row.item_id, text))
        size += len(text)
    yield block


def _shared(benchmark: DataFrame) -> list:
    """The benchmark's blocks, broadcast; each has a fixed bound."""
    context = benchmark.sparkSession.sparkContext
    common.ship(benchmark.sparkSession)
    return [context.broadcast(Phrases(block)) for block in _blocks(benchmark)]


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids as strings), spans (code points, end exclusive), for each document."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(_search(_shared(benchmark)), _SCHEMA)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that hold no window; nothing is joined or shuffled."""
    shared = _shared(benchmark)

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean = [n_hit == 0 for _, rows in _found(b.column("text"), shared) for _, n_hit, _, _ in rows]
            yield b.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """`text` with its removal spans cut out."""
    out, at = [], 0
    for s, e in spans:
        out.append(text[at:s])
        at = e
    return "".join([*out, text[at:]])


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS p
      FROM b, unnest(generate_series(1, greatest(1, len(w) - 9))) AS g(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM q),
x AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS p
      FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lens WHERE len(w) >= n)),
h AS (SELECT x.doc_id, x.i, x.n, q.item_id FROM x JOIN q ON x.p = q.p AND x.n = q.n),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS pos FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id AS doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""
