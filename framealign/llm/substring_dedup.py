"""Removal of repeated 200-byte strings by a hash-compared sort of sampled suffixes.

A byte goes if a string of LENGTH bytes that covers it starts at another place too, in any document. Only whole texts are
compared, as UTF-8 bytes, and matches never cross documents.

Sampling. Of each LENGTH-byte window, the least hash of its GRAM-byte strings (leftmost on ties) marks an anchor. The
choice depends on the window's bytes alone, so two equal windows have anchors at the same offset with the same hash, and
each repeated window shows up among the suffixes that start at anchors, about one place in eighty. All hashes are
differences of prefix polynomial hashes. Windows that repeat within their own document are found there (and compared
byte by byte); only their first occurrence gets anchors, so that periodic texts stay small.

Sorting. Anchors whose hash occurs once are dropped. The others get their context (what a window at them can reach) and
meet by hash. Within a hash, suffixes are merge-sorted; a comparison finds the common extension of two suffixes by
binary search over prefix hashes, so it takes a logarithmic number of steps. The neighbours in this order give the longest
extension to the right, the same on reversed contexts gives it to the left, and both are checked byte by byte. Where both reach
as far as a window can, all windows at the anchor are repeated. For the other anchors, the windows at each offset are
sorted by hash, and those that have a partner are checked byte by byte again. If a check ever fails, the hash had a
collision, and the group is done over with plain byte comparisons.

Hot groups. Equal texts are one from the start, so copies never reach the sort. A hash with more than MOST_MEMBERS anchors
(a passage in a great many documents) isn't sorted in one task: its windows are counted by a 128-bit digest with
partial aggregation, and joined back with skew handling.

Cases: null counts as empty; texts shorter than LENGTH lose nothing; a text that is there twice and has LENGTH bytes loses
all of them. Null and repeated doc_ids are rows like any other. An empty table gives an empty result. Columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH = 200
GRAM = 40
#: Anchors of one hash that one task sorts.
MOST_MEMBERS = 32_768
#: Bytes of text that are hashed at once, of texts that are written at once, and anchors that are sorted at once.
STRETCH = 400_000
BLOCK_BYTES = 4_000_000
BLOCK_ANCHORS = 8_192
#: Rows of one number that are broadcast at most.
MOST_BROADCAST = 500_000

_BASE = 0x9E3779B97F4A7C55 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = (1 << 24) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: list[np.ndarray] = [_powers(_BASE, 1), _powers(_INVERSE, 1)]


class Prefixes:
    """Prefix polynomial hashes of a byte string; equal strings have equal hashes, wherever they stand."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, down = _tables
        if len(up) <= n:
            up, down = _powers(_BASE, n), _powers(_INVERSE, n)
            if n <= 2 * STRETCH:  # the tables of usual sizes are kept
                _tables[:] = up, down
        self.sums = np.zeros(n + 1, np.uint64)
        part = data.astype(np.uint64)
        part += np.uint64(1)
        part *= up[:n]
        np.cumsum(part, out=self.sums[1:])
        self.down = down[: n + 1]

    def of(self, start: np.ndarray, size) -> np.ndarray:  # noqa: ANN001
        return (self.sums[start + size] - self.sums[start]) * self.down[start]

    def all(self, size: int) -> np.ndarray:
        """Hashes of all strings of a size."""
        n = len(self.sums) - size
        if n <= 0:
            return np.empty(0, np.uint64)
        out = self.sums[size:] - self.sums[:n]
        out *= self.down[:n]
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = x ^ (x >> np.uint64(32))
        x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _same_document(data: np.ndarray, at: np.ndarray, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For some windows of one document (ascending places and hashes): whether one is the first of its kind, and whether it has an equal."""
    n = len(at)
    order = np.argsort(hashes, kind="stable").astype(np.int32 if n < 1 << 31 else np.int64)
    new = np.r_[True, hashes[order[1:]] != hashes[order[:-1]]]
    starts = np.flatnonzero(new)
    first_of = np.empty(n, order.dtype)
    first_of[order] = np.repeat(order[starts], np.diff(np.r_[starts, n]))
    del order, new, starts
    # runs of windows that follow each other, like their firsts, are compared as one string
    later = np.flatnonzero(first_of != np.arange(n))
    repeated, first = np.zeros(n, bool), np.ones(n, bool)
    if not len(later):
        return first, repeated
    place = at[later]
    lag = place - at[first_of[later]]
    cuts = np.flatnonzero(np.r_[True, (place[1:] != place[:-1] + 1) | (lag[1:] != lag[:-1])])
    for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(later)], strict=True):
        a, b, shift = int(place[s]), int(place[e - 1]) + 1, int(lag[s])
        if not (data[a : b + length - 1] == data[a - shift : b - shift + length - 1]).all():
            return _slowly(data, at, length)
    repeated[later] = True
    repeated[first_of[later]] = True
    first[later] = False
    return first, repeated


def _slowly(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    raw, seen = data.tobytes(), {}
    first, repeated = np.ones(len(at), bool), np.zeros(len(at), bool)
    for k, p in enumerate(at.tolist()):
        was = seen.setdefault(raw[p : p + length], k)
        if was != k:
            first[k], repeated[k], repeated[was] = False, True, True
    return first, repeated


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    turn = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    return turn[0::2], turn[1::2]


def _least(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of some bytes, the place of its least gram; and the hashes of all grams."""
    grams = mixed(Prefixes(data).all(gram))
    keys = grams & ~np.uint64(_PLACE)
    keys |= np.arange(len(grams), dtype=np.uint64)
    least = sliding_min(keys, length - gram + 1)
    least &= np.uint64(_PLACE)
    return least.astype(np.int64), grams


def _window_hashes(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the windows at ascending places, a stretch at a time."""
    out = np.empty(len(at), np.uint64)
    k = 0
    while k < len(at):
        a = int(at[k])
        to = int(np.searchsorted(at, a + STRETCH, side="left"))
        out[k:to] = Prefixes(data[a : int(at[to - 1]) + length]).of(at[k:to] - a, length)
        k = to
    return out


def _repeats_inside(data: np.ndarray, places: np.ndarray, hashes: np.ndarray, begins: np.ndarray, windows: int, length: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which anchors of a text have a window that is the first of its kind in it, and the spans of windows that repeat in it.

    begins: the first window of each anchor. Only windows of anchors whose hash repeats can repeat.
    """
    _, kind, n = np.unique(hashes, return_inverse=True, return_counts=True)
    again = np.flatnonzero(n[kind] > 1)
    sizes = np.diff(np.r_[begins, windows])[again]
    ends = np.cumsum(sizes)
    at = np.repeat(begins[again] - ends + sizes, sizes) + np.arange(int(ends[-1]))
    first, repeated = _same_document(data, at, _window_hashes(data, at, length), length)
    kept = np.ones(len(places), bool)
    kept[again] = np.logical_or.reduceat(first, ends - sizes)
    held = at[repeated]
    turn = np.flatnonzero(np.r_[True, held[1:] != held[:-1] + 1]) if len(held) else np.empty(0, np.int64)
    last = np.r_[turn[1:] - 1, len(held) - 1] if len(held) else turn
    return kept, [(int(s), int(e) + length) for s, e in zip(held[turn], held[last], strict=True)]


def find_anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """(hashes, places, spans that repeat within the text) of each of some texts.

    Texts are hashed together, STRETCH bytes at a time; a longer one in stretches that overlap by a window.
    """
    empty = (np.empty(0, np.uint64), np.empty(0, np.int64), [])
    at = 0
    while at < len(texts):
        to, size = at + 1, len(texts[at])
        while to < len(texts) and size + len(texts[to]) <= STRETCH:
            size += len(texts[to])
            to += 1
        joined = texts[at] if to == at + 1 else b"".join(texts[at:to])
        data = np.frombuffer(joined, np.uint8)
        least = grams = None
        if length <= size <= 2 * STRETCH:
            least, grams = _least(data, length, gram)
        a = 0
        for text in texts[at:to]:
            b = a + len(text)
            windows = b - a - length + 1
            if windows < 1:
                yield empty
                a = b
                continue
            if least is not None:
                own = least[a : a + windows]
                begins = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                places = own[begins]
                hashes = grams[places]
                places = places - a
            else:  # the only text of its block
                parts: list[tuple[np.ndarray, ...]] = []
                for s in range(0, windows, STRETCH):
                    own, some = _least(data[s : min(s + STRETCH, windows) + length - 1], length, gram)
                    turn = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                    parts.append((turn + s, own[turn] + s, some[own[turn]]))
                begins, places, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
                new = np.r_[True, places[1:] != places[:-1]]
                begins, places, hashes = begins[new], places[new], hashes[new]
            spans: list[tuple[int, int]] = []
            if len(set(hashes.tolist())) < len(hashes):
                kept, spans = _repeats_inside(data[a:b], places, hashes, begins, windows, length)
                hashes, places = hashes[kept], places[kept]
            yield hashes, places, spans
            a = b
        at = to


# ---- sorting ----


class Suffixes:
    """Strings that stand in one buffer, compared by prefix hashes."""

    def __init__(self, strings: list[bytes]):
        self.sizes = np.array([len(s) for s in strings], np.int64)
        self.starts = np.r_[0, np.cumsum(self.sizes)][:-1]
        self.data = np.frombuffer(b"".join(strings) + b"\0", np.uint8)
        self.prefixes = Prefixes(self.data)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of strings a and b, by binary search."""
        x, y = self.starts[a], self.starts[b]
        low, high = np.zeros(len(a), np.int64), np.minimum(self.sizes[a], self.sizes[b])
        for _ in range(int(high.max(initial=0)).bit_length()):
            middle = (low + high + 1) >> 1
            same = self.prefixes.of(x, middle) == self.prefixes.of(y, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether string a sorts before b; ties: the answer for equal ones."""
        n = self.extension(a, b)
        ends_a, ends_b = n >= self.sizes[a], n >= self.sizes[b]
        at_a, at_b = self.data[np.minimum(self.starts[a] + n, len(self.data) - 1)], self.data[np.minimum(self.starts[b] + n, len(self.data) - 1)]
        return np.where(ends_a & ends_b, ties, np.where(ends_a | ends_b, ends_a, at_a < at_b))

    def checked(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the first `size` bytes of strings a and b are equal, byte by byte."""
        out = np.ones(len(a), bool)
        for k in range(int(size.max(initial=0))):
            live = size > k
            out &= ~live | (self.data[np.where(live, self.starts[a] + k, 0)] == self.data[np.where(live, self.starts[b] + k, 0)])
        return out


def merge_sorted(strings: Suffixes, groups: np.ndarray) -> np.ndarray:
    """Order of the strings within their groups (group numbers ascend); all merges of a level run side by side."""
    n = len(groups)
    order = np.arange(n)
    firsts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[firsts, n])
    begin, end = np.repeat(firsts, sizes), np.repeat(firsts + sizes, sizes)
    run = 1
    while run < sizes.max(initial=0):
        live = np.flatnonzero(end - begin > run)
        block = (live - begin[live]) // run
        own = begin[live] + block * run
        left = block % 2 == 0
        other = np.where(left, own + run, own - run)
        low, high = np.minimum(other, end[live]), np.minimum(other + run, end[live])
        base = low.copy()
        for _ in range(run.bit_length()):  # where each string goes in the run beside its own
            open_ = np.flatnonzero(low < high)
            middle = (low[open_] + high[open_]) >> 1
            after = strings.before(order[middle], order[live[open_]], ~left[open_])
            low[open_], high[open_] = np.where(after, middle + 1, low[open_]), np.where(after, high[open_], middle)
        place = np.minimum(own, np.where(left, own, other)) + (live - own) + (low - base)
        new = order.copy()
        new[place] = order[live]
        order = new
        run *= 2
    return order


def longest(strings: Suffixes, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest common prefix of each string with another of its group, and whether the bytes bear it out."""
    order = merge_sorted(strings, groups)
    a, b = order[:-1], order[1:]
    same = groups[a] == groups[b]
    size = np.where(same, strings.extension(a, b), 0)
    good = strings.checked(a, b, size)
    out, sound = np.zeros(len(groups), np.int64), np.ones(len(groups), bool)
    np.maximum.at(out, a, size)
    np.maximum.at(out, b, size)
    np.logical_and.at(sound, a, good)
    np.logical_and.at(sound, b, good)
    return out, sound


def _plainly(left: list[bytes], right: list[bytes], length: int) -> list[tuple[int, int]]:
    """Reach of one group's anchors with byte strings as keys."""
    seen: dict[bytes, list[tuple[int, int]]] = {}
    for k, (x, y) in enumerate(zip(left, right, strict=True)):
        text = x + y
        for o in range(min(len(x), length - 1) + 1):
            if len(y) >= length - o and length - o > 0:
                seen.setdefault(text[len(x) - o : len(x) - o + length], []).append((k, o))
    reach = [(-1, -1)] * len(left)
    for held in seen.values():
        if len(held) > 1:
            for k, o in held:
                low, high = reach[k]
                reach[k] = (max(low, o), max(high, length - o))
    return reach


def reach(groups: np.ndarray, left: list[bytes], right: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """How far repeated windows reach before and after each anchor (-1: it has none).

    left, right: what stands before an anchor (as it stands) and from it on, as far as a window at it can reach.
    """
    n = len(groups)
    most = length - gram
    # before an anchor, its own bytes are compared too, so that a collision shows
    ahead, backward = Suffixes(right), Suffixes([(x + y[:gram])[::-1] for x, y in zip(left, right, strict=True)])
    to_right, good = longest(ahead, groups)
    to_left, also = longest(backward, groups)
    before, after = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    full_right, full_left = to_right >= length, to_left >= most + gram
    after[full_right], before[full_right] = length, 0
    before[full_left] = most
    after[full_left] = np.maximum(after[full_left], gram)
    bad = set(groups[~(good & also)].tolist())
    todo = np.unique(groups[~(full_right & full_left)])
    some = np.flatnonzero(np.isin(groups, todo))
    if len(some):
        joined = Suffixes([left[i] + right[i] for i in some.tolist()])
        lead, size = backward.sizes[some] - np.minimum(ahead.sizes[some], gram), ahead.sizes[some]
        low, high = np.full(len(some), -1, np.int64), np.full(len(some), length + 1, np.int64)
        pair_low, pair_high = np.zeros(len(some), np.int64), np.zeros(len(some), np.int64)
        for o in range(most + 1):
            fits = np.flatnonzero((lead >= o) & (size >= length - o))
            if len(fits) < 2:
                continue
            at = joined.starts[fits] + lead[fits] - o
            key = mixed(joined.prefixes.of(at, length)) ^ mixed(groups[some[fits]].astype(np.uint64) + np.uint64(1))
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            a, b = fits[order[:-1][same]], fits[order[1:][same]]
            for x, y in ((a, b), (b, a)):
                low[x], pair_low[x] = o, y  # offsets ascend, so the last is the largest
                early = high[x] > length
                high[x[early]], pair_high[x[early]] = o, y[early]
        found = np.flatnonzero(low >= 0)
        for offsets, pairs in ((low, pair_low), (high, pair_high)):
            o = offsets[found]
            x, y = joined.starts[found] + lead[found] - o, joined.starts[pairs[found]] + lead[pairs[found]] - o
            for s in range(0, len(found), 4096):
                rows = np.arange(length)[None, :]
                equal = (joined.data[x[s : s + 4096, None] + rows] == joined.data[y[s : s + 4096, None] + rows]).all(axis=1)
                bad |= set(groups[some[found[s : s + 4096][~equal]]].tolist())
        before[some[found]] = np.maximum(before[some[found]], low[found])
        after[some[found]] = np.maximum(after[some[found]], length - high[found])
    for g in bad:
        members = np.flatnonzero(groups == g)
        for k, (x, y) in zip(members.tolist(), _plainly([left[i] for i in members], [right[i] for i in members], length), strict=True):
            before[k], after[k] = x, y
    return before, after


# ---- steps ----


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for b in batches:
        data, offs = common.raw_text(b.column("text"))
        ends, at = offs.tolist(), 0
        while at < b.num_rows:
            to = min(b.num_rows, max(at + 1, int(np.searchsorted(offs, offs[at] + BLOCK_BYTES, side="right")) - 1))
            texts = [data[ends[k] : ends[k + 1]] for k in range(at, to)]
            rows = list(find_anchors(texts))
            columns = [
                b.column("doc_id").slice(at, to - at),
                pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([h.tobytes() + p.astype("<i4").tobytes() for h, p, _ in rows], pa.binary()),
                pa.array([np.array(s, "<i4").tobytes() for _, _, s in rows], pa.binary()),
                pa.array([pack.compress(t) for t in texts], pa.binary()),
            ]
            yield pa.record_batch(columns, names=["doc_id", "digest", "n_bytes", "anchors", "own_spans", "packed"])
            at = to


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        uid = b.column("uid").to_numpy()
        data, offs = common.raw_text(b.column("anchors"))
        for s in range(0, len(uid), 512):
            hashes, places, owner = [], [], []
            for k in range(s, min(len(uid), s + 512)):
                n = int(offs[k + 1] - offs[k]) // 12
                hashes.append(np.frombuffer(data, "<i8", n, int(offs[k])))
                places.append(np.frombuffer(data, "<i4", n, int(offs[k]) + 8 * n))
                owner.append(np.full(n, uid[k]))
            yield pa.record_batch([pa.array(np.concatenate(hashes)), pa.array(np.concatenate(owner)), pa.array(np.concatenate(places))], names=["h", "uid", "place"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    most = LENGTH - GRAM
    for b in batches:
        rows: list[list] = [[], [], [], [], [], []]
        held = 0
        for uid, packed, listed in zip(b.column("uid").to_pylist(), b.column("packed"), b.column("listed").to_pylist(), strict=True):
            text = unpack.decompress(packed.as_py())
            for x in listed:
                p = x["place"]
                for column, value in zip(rows, (x["h"], uid, p, x["hot"], text[max(0, p - most) : p], text[p : p + LENGTH]), strict=True):
                    column.append(value)
            held += len(listed)
            if held > 20_000:
                yield _context_batch(rows)
                rows, held = [[], [], [], [], [], []], 0
        yield _context_batch(rows)


_CONTEXT = "h long, uid long, place int, hot boolean, left binary, right binary"


def _context_batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["h", "uid", "place", "hot", "left", "right"])


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by hash; whole groups are gathered and sorted together."""
    held: list[list] = [[], [], [], [], []]

    def spans(n: int) -> pa.RecordBatch:
        h, uid, place, left, right = (c[:n] for c in held)
        groups = np.cumsum(np.r_[0, np.array(h[1:], np.int64) != np.array(h[:-1], np.int64)])
        before, after = reach(groups, left, right)
        some = np.flatnonzero(after >= 0)
        at = np.array(place, np.int64)[some]
        return pa.record_batch([pa.array(np.array(uid, np.int64)[some]), pa.array((at - before[some]).astype(np.int32)), pa.array((at + after[some]).astype(np.int32))], names=["uid", "start", "stop"])

    for b in batches:
        for column, name in zip(held, ("h", "uid", "place", "left", "right"), strict=True):
            column += b.column(name).to_pylist()
        if len(held[0]) >= BLOCK_ANCHORS:
            h, n = held[0], len(held[0]) - 1
            while n and h[n - 1] == h[-1]:
                n -= 1
            if n:
                yield spans(n)
                held = [c[n:] for c in held]
    if held[0]:
        yield spans(len(held[0]))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in range(0, b.num_rows, 256):
            rows: list[tuple] = []
            part = b.slice(s, 256)
            for uid, place, left, right in zip(*(part.column(c).to_pylist() for c in ("uid", "place", "left", "right")), strict=True):
                text = left + right
                for o in range(len(left) + 1):
                    if len(right) >= LENGTH - o:
                        at = len(left) - o
                        rows.append((hashlib.blake2b(text[at : at + LENGTH], digest_size=16).digest(), uid, place - o))
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.record_batch([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())], names=["window", "uid", "start"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        out: list[tuple] = []
        for uid, packed, listed in zip(b.column("uid").to_pylist(), b.column("packed"), b.column("listed").to_pylist(), strict=True):
            kept, n, spans = remove(unpack.decompress(packed.as_py()), [(x["start"], x["stop"]) for x in listed])
            out.append((uid, n, spans, hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["uid", "n_removed", "n_spans", "kept"])


def remove(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What stays of a text, the bytes removed and the number of maximal removed runs."""
    parts, at, runs_, removed, stop = [], 0, 0, 0, -1
    for s, e in sorted(spans):
        if s > stop:
            if stop >= 0:
                at = stop
            parts.append(text[at:s])
            runs_ += 1
            removed += e - s
            stop = at = e
        elif e > stop:
            removed += e - stop
            stop = at = e
    return b"".join([*parts, text[at:]]), removed, runs_


def repeated_spans(rows: DataFrame, most_members: int) -> DataFrame:
    """uid, listed (array of start, stop) of the texts that lose something to other texts or themselves.

    rows: uid, anchors, own_spans, packed of all different texts.
    """
    anchors = rows.filter(F.length("anchors") > 0).select("uid", "anchors").mapInArrow(_anchor_rows, "h long, uid long, place int")
    counts = common.cut(anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", (F.col("n") > most_members).alias("hot")))
    found = anchors.join(counts, "h").select("uid", F.struct("place", "h", "hot").alias("x"))
    # as many as the text itself has anchors
    listed = found.groupBy("uid").agg(F.collect_list("x").alias("listed"))
    contexts = rows.select("uid", "packed").join(listed, "uid").mapInArrow(_contexts, _CONTEXT)
    spans = _sorted_spans(contexts)
    if not counts.filter("hot").isEmpty():
        spans = spans.unionByName(_counted_spans(contexts))
    own = rows.filter(F.length("own_spans") > 0).select("uid", "own_spans").mapInArrow(_own_rows, "uid long, start int, stop int")
    return spans.unionByName(own).groupBy("uid").agg(F.collect_list(F.struct("start", "stop")).alias("listed"))


def _own_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        uid, start, stop = [], [], []
        for u, raw in zip(b.column("uid").to_pylist(), b.column("own_spans").to_pylist(), strict=True):
            pairs = np.frombuffer(raw, "<i4").reshape(-1, 2)
            uid += [u] * len(pairs)
            start += pairs[:, 0].tolist()
            stop += pairs[:, 1].tolist()
        yield pa.record_batch([pa.array(uid, pa.int64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())], names=["uid", "start", "stop"])


def _sorted_spans(contexts: DataFrame) -> DataFrame:
    """uid, start, stop of the repeated windows at anchors that aren't hot, merged per anchor."""
    parts = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fair = contexts.filter("not hot").drop("hot").repartition(parts, "h").sortWithinPartitions("h", "uid", "place")
    return fair.mapInArrow(_sorted, "uid long, start int, stop int")


def _counted_spans(contexts: DataFrame) -> DataFrame:
    """uid, start, stop of each repeated window at hot anchors."""
    windows = contexts.filter("hot").mapInArrow(_windows, "window binary, uid long, start int").distinct()
    often = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("window")
    return windows.join(often, "window", "left_semi").select("uid", "start", (F.col("start") + LENGTH).cast("int").alias("stop"))


def dedup_substrings(docs: DataFrame, most_members: int = MOST_MEMBERS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    common.ship(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, digest binary, n_bytes long, anchors binary, own_spans binary, packed binary"
    made = common.staged(read.mapInArrow(_prepared, schema).withColumn("uid", F.monotonically_increasing_id()), "texts")
    light = made.select("uid", "doc_id", "digest", "n_bytes")
    copies = common.cut(light.groupBy("digest").agg(F.min("uid").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    again = common.cut(light.join(copies, "digest").filter("uid <> first").select("uid"))
    if again.count() <= MOST_BROADCAST:  # a checked bound of a few MB; beyond it the join is by shuffle
        again = F.broadcast(again)
    texts = made.join(again, "uid", "left_anti")
    rows = texts.select("uid", "anchors", "own_spans", "packed")
    listed = repeated_spans(rows, most_members)
    done = rows.select("uid", "packed").join(listed, "uid").mapInArrow(_removed, "uid long, n_removed long, n_spans long, kept string")
    out = light.join(copies.select("digest", "n"), "digest", "left").join(done, "uid", "left")
    gone = F.col("n").isNotNull() & (F.col("n_bytes") >= LENGTH)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(gone, nothing).otherwise(F.coalesce("kept", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(common.table(spark, sf_dir, "documents"))
