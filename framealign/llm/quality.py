"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities.

Word vectors. Words (split at white space, lower-cased, without punctuation around them) are hashed to BUCKETS places.
Each place has a sparse ternary index vector, drawn once from a fixed seed. Over all documents, the context vector of a
word adds up the index vectors of its neighbours (two to either side) and of the shapes of the two to its right; sums are whole
numbers, so they don't depend on how rows are dealt out. Tasks add up their own matrix, and Spark adds those up by place.
The matrix has a fixed size (BUCKETS x DIMS), so it can be collected and broadcast whatever the input.

Document vectors. The mean of the unit context vectors of its words, weighted down by frequency over all documents; the
mean of the index vectors of its shape tokens (case, punctuation and digits of each word, and a token for a word that
repeats the one before); the logarithm of its length.

Network. Two layers in numpy, trained on at most `most_rows` pairs of document and label, of those that aren't held out,
least hash first. A part of these is set aside: it picks the number of epochs, and the temperature that divides the last layer's output. A
score is the calibrated probability of label 1; doc_id, lang, source and labels are no inputs.

Cases: null counts as empty; an empty text has a zero vector and gets a score. Labels that are null are left out, a
doc_id with several labels counts with each. Without labels of both kinds all scores are the share of label 1 (0.5 if
there are none). A null doc_id is scored and not held out. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DIMS = 32
NONZERO = 4
BUCKETS = 1 << 14
SHAPES = 65
REPEAT = SHAPES - 1
REACH = 2
#: Bound of the sample of labelled rows that the network is trained on.
MOST_ROWS = 20_000
#: Bytes of text that are pooled at once.
SLICE_BYTES = 8_000_000
FEATURES = 2 * DIMS + 1

_PUNCT = bytes(b for b in range(33, 127) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the ternary index vectors of words (first) and shapes (after them)."""
    rng = np.random.default_rng(20240601)
    n = BUCKETS + SHAPES
    return rng.integers(0, DIMS, (n, NONZERO)), rng.choice(np.array([-1, 1]), (n, NONZERO))


def dense(places: np.ndarray, signs: np.ndarray) -> np.ndarray:
    out = np.zeros((len(places), DIMS))
    np.add.at(out, (np.repeat(np.arange(len(places)), NONZERO), places.ravel()), signs.ravel())
    return out


def shape_of(word: bytes) -> int:
    """Case (none or lower, first letter, all), punctuation at the end, digits: a number below SHAPES - 1."""
    core = word.strip(_PUNCT)
    case = 3 if not core else 2 if len(core) > 1 and core.isupper() else 1 if core[:1].isupper() else 0
    tail = word[len(word.rstrip(_PUNCT)) :]
    end = 0 if not tail else 1 if tail in (b".", b",", b";", b":", b"?", b"!") else 2 if len(tail) > 1 and len(set(tail)) == 1 else 3
    symbol = (tail[-1] % 3 if end > 1 and tail else 0) if end != 1 else 0
    return ((case * 4 + end) * 2 + any(48 <= c <= 57 for c in word)) + 32 * (symbol > 0)


class Words(dict):
    """word -> place | shape << 16, kept for recurring words of a task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        core = word.translate(common.LOWER_AZ).strip(_PUNCT) or word
        out = zlib.crc32(core) % BUCKETS | shape_of(word) << 16
        self[word] = out
        return out


_words = Words()


def read_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and shapes of all words, and the first word of each document (one more at the end)."""
    code, firsts = [], [0]
    for text in texts:
        words = text.split()
        part = np.fromiter(map(_words.__getitem__, words), np.int32, len(words))
        code.append(part)
        firsts.append(firsts[-1] + len(words))
    flat = np.concatenate(code) if code else np.empty(0, np.int32)
    return flat & 0xFFFF, flat >> 16, np.array(firsts, np.int64)


def _texts(b: pa.RecordBatch) -> list[bytes]:
    data, offs = common.raw_text(b.column("text"))
    ends = offs.tolist()
    return [data[s:e] for s, e in zip(ends[:-1], ends[1:], strict=True)]


@common.lean
def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places, signs = (x.astype(np.int32) for x in index_vectors())
    total = np.zeros(BUCKETS * DIMS)
    counts = np.zeros(BUCKETS, np.int64)
    for _, texts in (x for b in batches for x in _slices(b)):
        word, shape, firsts = read_words(texts)
        counts += np.bincount(word, minlength=BUCKETS)
        doc = np.repeat(np.arange(len(firsts) - 1, dtype=np.int32), np.diff(firsts))
        for k in range(1, REACH + 1):
            same = np.flatnonzero(doc[k:] == doc[:-k]) if len(doc) > k else np.empty(0, np.int64)
            for back, kind in ((0, "next"), (k, "before"), (0, "shape")):
                to = word[same + back] * DIMS
                of = BUCKETS + shape[same + k] if kind == "shape" else word[same + k - back]
                for j in range(NONZERO):
                    total += np.bincount(to + places[of, j], weights=signs[of, j], minlength=BUCKETS * DIMS)
    _words.clear()
    some = np.flatnonzero(counts)
    matrix = total.reshape(BUCKETS, DIMS)[some].astype(np.int64)
    columns = [pa.array(some, pa.int32()), pa.array(counts[some], pa.int64()), *(pa.array(matrix[:, k]) for k in range(DIMS))]
    yield pa.record_batch(columns, names=["place", "n", *(f"c{k}" for k in range(DIMS))])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Weighted unit context vectors of all places, over all documents."""
    schema = "place int, n long, " + ", ".join(f"c{k} long" for k in range(DIMS))
    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_contexts, schema)
    summed = parts.groupBy("place").agg(F.sum("n").alias("n"), *(F.sum(f"c{k}").alias(f"c{k}") for k in range(DIMS)))
    out, share = np.zeros((BUCKETS, DIMS)), np.zeros(BUCKETS)
    for row in summed.collect():
        out[row.place], share[row.place] = row[2:], row.n
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    weight = 1e-3 / (1e-3 + share / max(share.sum(), 1))
    return (out * weight[:, None]).astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """Document vectors, one row per text."""
    word, shape, firsts = read_words(texts)
    n = len(texts)
    out = np.zeros((n, FEATURES), np.float32)
    size = np.diff(firsts)
    some = np.flatnonzero(size)
    if len(some):
        again = np.r_[False, word[1:] == word[:-1]]
        doc = np.repeat(np.arange(n, dtype=np.int32), size)
        for k in range(DIMS):
            out[some, k] = np.add.reduceat(vectors[word, k].astype(np.float64), firsts[some]) / size[some]
        held = np.bincount(doc.astype(np.int64) * SHAPES + shape, minlength=n * SHAPES).reshape(n, SHAPES).astype(np.float64)
        again[firsts[some]] = False
        held[:, REPEAT] += np.bincount(doc[again], minlength=n)
        out[some, DIMS : 2 * DIMS] = (held[some] @ shapes) / size[some, None]
        out[some, 2 * DIMS] = np.log1p(size[some])
    return out


def _slices(b: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a batch in slices of bounded size, with the row each starts at."""
    texts, at, size = _texts(b), 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size > SLICE_BYTES:
            yield at, texts[at : k + 1]
            at, size = k + 1, 0
    yield at, texts[at:]


def _sampled(shared):  # noqa: ANN001, ANN202
    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, shapes = shared.value, dense(*index_vectors())[BUCKETS:]
        for b in batches:
            x = np.concatenate([pooled(texts, vectors, shapes) for _, texts in _slices(b)])
            yield pa.record_batch([b.column("doc_id"), b.column("quality"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "quality", "vector"])
        _words.clear()

    return run


class Network:
    """Two layers (tanh, logistic), trained with Adam on whole batches."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 400, seed: int = 7):
        rng = np.random.default_rng(seed)
        aside = rng.random(len(y)) < 0.2
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.temperature, self.share = 1.0, float(y.mean()) if len(y) else 0.5
        self.weights: list[np.ndarray] = []
        if len(set(y[~aside].tolist())) < 2 or len(set(y[aside].tolist())) < 2:
            return
        z = (x - self.mean) / self.scale
        w = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
        best, held = np.inf, w
        zt, yt = z[~aside], y[~aside]
        for step in range(1, epochs + 1):
            h = np.tanh(zt @ w[0] + w[1])
            p = 1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -50, 50)))
            d = (p - yt) / len(yt)
            back = np.outer(d, w[2]) * (1 - h * h)
            grads = [zt.T @ back + 1e-4 * w[0], back.sum(axis=0), h.T @ d + 1e-4 * w[2], np.array([d.sum()])]
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - 0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            if step % 10 == 0:
                loss = self._loss(self._raw(z[aside], w), y[aside])
                if loss < best:
                    best, held = loss, [a.copy() for a in w]
        self.weights = held
        raw = self._raw(z[aside], held)
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        self.temperature = float(grid[int(np.argmin([self._loss(raw / t, y[aside]) for t in grid]))])

    @staticmethod
    def _raw(z: np.ndarray, w: list[np.ndarray]) -> np.ndarray:
        return np.tanh(z @ w[0] + w[1]) @ w[2] + w[3]

    @staticmethod
    def _loss(raw: np.ndarray, y: np.ndarray) -> float:
        return float(np.mean(np.logaddexp(0, raw) - y * raw))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(x), self.share)
        raw = self._raw((x - self.mean) / self.scale, self.weights) / self.temperature
        return 1 / (1 + np.exp(-np.clip(raw, -50, 50)))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Model:
    """Word vectors and network; scores texts."""

    def __init__(self, vectors: np.ndarray, network: Network):
        self.vectors, self.network, self.shapes = vectors, network, dense(*index_vectors())[BUCKETS:]

    def score(self, b: pa.RecordBatch) -> np.ndarray:
        return np.concatenate([self.network.score(pooled(texts, self.vectors, self.shapes).astype(np.float64)) for _, texts in _slices(b)])


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model:
    """The model of a table: word vectors over all documents, network from labels (doc_id, quality)."""
    spark = docs.sparkSession
    common.ship(spark)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    vectors = word_vectors(read)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("quality is not null").filter(~held_out())
    there = known.join(read.select("doc_id").distinct(), "doc_id", "left_semi")
    order = F.xxhash64("doc_id"), "doc_id", "quality"
    sample = there.orderBy(*order).limit(most_rows)
    # at most most_rows rows of two numbers, so the broadcast has a fixed bound; a doc_id may be there many times, so the limit holds for what comes back too
    found = read.join(F.broadcast(sample), "doc_id").mapInArrow(_sampled(spark.sparkContext.broadcast(vectors)), "doc_id long, quality int, vector binary")
    rows = found.orderBy(*order, "vector").limit(most_rows).collect()
    rows.sort(key=lambda r: (r.doc_id, r.quality, bytes(r.vector)))
    x = np.array([np.frombuffer(r.vector, np.float32) for r in rows], np.float64).reshape(-1, FEATURES)
    network = Network(x, np.array([float(r.quality > 0) for r in rows])) if rows else Network(np.zeros((1, FEATURES)), np.array([0.5]))
    return Model(vectors, network)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column("doc_id"), pa.array(shared.value.score(b), pa.float64())], names=["doc_id", "score"])
        _words.clear()

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that score at least `least`; nothing is joined or shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.score(b) >= least))
        _words.clear()

    return docs.mapInArrow(run, docs.schema)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = score_documents(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
