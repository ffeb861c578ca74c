"""Descriptor matching: two nearest neighbours, ratio test, mutual matches, fusion of runs, and selection over a grid.

Keypoint tables hold (pair_id, kp_id, x, y, descriptor array<float>), match tables (pair_id, method, sx, sy, rx, ry, score).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RATIO = 0.78
GRID = 10
CELL_LIMIT = 20
LEAST_MATCHES = 8
#: Reference rows that a task compares its queries with at once.
BLOCK = 4096


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays in doubles."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of longs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)


def _met(queries: DataFrame, targets: DataFrame, directions: tuple[int, ...]) -> DataFrame:
    """pair_id, way, q, t, d: for each block of targets (way 0) or of queries (way 1) the two nearest of its rows to each row of the other side.

    Both sides of a pair are cut into blocks, and each block of queries meets each block of targets once, so neither a pair with
    very many keypoints nor all pairs of rows ever sit in one task.
    """
    q = queries.select("pair_id", F.col("kp_id").alias("q"), F.col("descriptor").alias("a"))
    t = targets.select("pair_id", F.col("kp_id").alias("t"), F.col("descriptor").alias("b"))
    rows = q.select("pair_id", F.lit(1).alias("nq"), F.lit(0).alias("nt")).unionByName(t.select("pair_id", F.lit(0).alias("nq"), F.lit(1).alias("nt")))
    cuts = rows.groupBy("pair_id").agg(F.ceil(F.sum("nq") / BLOCK).cast("int").alias("parts"), F.ceil(F.sum("nt") / BLOCK).cast("int").alias("blocks")).filter("parts > 0 and blocks > 0")
    q = q.join(cuts, "pair_id").select(F.col("pair_id").alias("pair_id"), "q", "a", F.pmod(F.xxhash64("q"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    t = t.join(cuts, "pair_id").select(F.col("pair_id").alias("pair_id"), "t", "b", F.pmod(F.xxhash64("t"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    keys = "pair_id", "block", "part"
    kinds, others = dict(queries.dtypes), dict(targets.dtypes)
    schema = f"pair_id {kinds['pair_id']}, way int, q {kinds['kp_id']}, t {others['kp_id']}, d double"
    return q.groupBy(*keys).cogroup(t.groupBy(*keys)).applyInArrow(_best_of(directions), schema)


def _two_of(near: DataFrame, of: list[str], other: str) -> DataFrame:
    """The columns `of`, t1, d1, d2 from the best of the blocks; two per block."""
    best = near.groupBy(*of).agg(F.slice(F.array_sort(F.collect_list(F.struct("d", F.col(other).alias("t")))), 1, 2).alias("x"))
    return best.filter("size(x) = 2").select(*of, F.col("x")[0]["t"].alias("t1"), F.col("x")[0]["d"].alias("d1"), F.col("x")[1]["d"].alias("d2"))


def two_nearest(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """pair_id, q, t1, d1, d2 of each query with at least two targets in its pair; ties go to the lesser id."""
    return _two_of(_met(queries, targets, (0,)), ["pair_id", "q"], "t")


def _best_of(directions: tuple[int, ...]):  # noqa: ANN202
    def best(q: pa.Table, t: pa.Table) -> pa.Table:
        ids = [q.column("q").combine_chunks(), t.column("t").combine_chunks()]
        vectors = [_matrix(q.column("a")), _matrix(t.column("b"))]
        parts = []
        for way in directions:
            if len(q) and len(t):
                rows, near, d = two_least(vectors[way], vectors[1 - way], pc.rank(ids[1 - way], tiebreaker="first").to_numpy())
                pair = [rows, near] if way == 0 else [near, rows]
                parts.append(pa.table([pa.array(np.full(len(d), way), pa.int32()), ids[0].take(pa.array(pair[0])), ids[1].take(pa.array(pair[1])), pa.array(d)], names=["way", "q", "t", "d"]))
        if not parts:
            parts.append(pa.table([pa.array([], pa.int32()), ids[0].slice(0, 0), ids[1].slice(0, 0), pa.array([], pa.float64())], names=["way", "q", "t", "d"]))
        out = pa.concat_tables(parts)
        pair_id = (q if len(q) else t).column("pair_id")[0]
        return out.add_column(0, "pair_id", pa.array([pair_id.as_py()] * len(out), pair_id.type))

    return best


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def two_least(a: np.ndarray, b: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a, their two nearest rows of b and the distances; ties by `order` of b's rows.

    One matrix product gives squared distances up to rounding; all rows of b that may be among the two nearest by its error
    are then compared by sums in the order of the components.
    """
    norms = (b * b).sum(axis=1)
    out: list[tuple[np.ndarray, ...]] = []
    for s in range(0, len(a), 512):
        part = a[s : s + 512]
        own = (part * part).sum(axis=1)
        rough = own[:, None] + norms[None, :] - 2.0 * (part @ b.T)
        slack = 1e-12 * a.shape[1] * (own + norms.max())
        second = np.partition(rough, min(1, len(b) - 1), axis=1)[:, min(1, len(b) - 1)]
        rows, near = np.nonzero(rough <= (second + 2 * slack)[:, None])
        exact = np.zeros(len(rows))
        for k in range(a.shape[1]):
            exact += (part[rows, k] - b[near, k]) ** 2
        by = np.lexsort((order[near], exact, rows))
        rows, near, exact = rows[by], near[by], exact[by]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        two = place < 2
        out.append((rows[two] + s, near[two], np.sqrt(exact[two])))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def ratio_test(nearest: DataFrame, threshold: float = RATIO) -> DataFrame:
    """Rows of two_nearest whose best is clearly nearer than the second, with the ratio."""
    ratio = F.col("d1") / F.greatest(F.col("d2"), F.lit(1e-12))
    return nearest.withColumn("ratio", ratio).filter(F.col("ratio") < threshold)


def match(queries: DataFrame, targets: DataFrame, threshold: float = RATIO) -> DataFrame:
    """Mutual matches that pass the ratio test both ways: pair_id, q, t, d1, ratio. One meeting of the blocks serves both ways."""
    met = _met(queries, targets, (0, 1))
    forward = F.col("way") == 0
    asked = met.select("pair_id", "way", F.when(forward, F.col("q")).otherwise(F.col("t")).alias("id"), F.when(forward, F.col("t")).otherwise(F.col("q")).alias("other"), "d")
    passed = ratio_test(_two_of(asked, ["pair_id", "way", "id"], "other"), threshold)
    ends = passed.select("pair_id", "way", F.when(forward, F.col("id")).otherwise(F.col("t1")).alias("q"), F.when(forward, F.col("t1")).otherwise(F.col("id")).alias("t"), "d1", "ratio")
    both = ends.groupBy("pair_id", "q", "t").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(forward, F.col("d1"))).alias("d1"), F.max(F.when(forward, F.col("ratio"))).alias("ratio"))
    return both.filter("n = 2").drop("n")


def union_runs(*runs: tuple[str, DataFrame]) -> DataFrame:
    """Match tables of several runs, with the run's name and place."""
    out = None
    for place, (method, rows) in enumerate(runs):
        part = rows.withColumn("method", F.lit(method)).withColumn("run_ord", F.lit(place))
        out = part if out is None else out.unionByName(part)
    return out


def fuse(matches: DataFrame, higher_is_better: bool = False) -> DataFrame:
    """One match per pair and coordinates (to 0.1 px): the best score, then the first run."""
    key = [F.bround(c, 1) for c in ("sx", "sy", "rx", "ry")]
    score = F.col("score").desc() if higher_is_better else F.col("score").asc()
    w = Window.partitionBy("pair_id", *key).orderBy(score, "run_ord", "row_ord")
    return matches.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def grid_cell(v: Column, extent: Column, n: int = GRID) -> Column:
    """Row or column of the grid, clamped to it."""
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), (v * n / F.greatest(extent, F.lit(1))).cast("int")))


def cap_cells(points: DataFrame, cell: list[str], order: list[Column], limit: int = CELL_LIMIT) -> DataFrame:
    """At most `limit` rows per cell in the given order; the limit is the feature."""
    w = Window.partitionBy(*cell).orderBy(*order)
    return points.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit)


def greedy_cells(matches: DataFrame, limit: int = CELL_LIMIT, least: int = LEAST_MATCHES) -> DataFrame:
    """Matches with `selected` and `status`: by rising score, those whose source and reference cells both have room.

    Each choice depends on those before it, so a pair is walked in one task, as a stream in sorted order; it holds counts per cell only.
    Input: pair_id, s_cell, r_cell, score, row_ord and more columns. A pair with too few survivors has status FAILED.
    """
    schema = matches.schema
    names = matches.columns

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair, source, reference = object(), {}, {}
        for b in batches:
            keep = []
            for p, s, r in zip(b["pair_id"], b["s_cell"], b["r_cell"], strict=True):
                if p != pair:
                    pair, source, reference = p, {}, {}
                ok = source.get(s, 0) < limit and reference.get(r, 0) < limit
                if ok:
                    source[s], reference[r] = source.get(s, 0) + 1, reference.get(r, 0) + 1
                keep.append(ok)
            yield b[names][keep]

    parts = int(matches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = matches.repartition(parts, "pair_id").sortWithinPartitions("pair_id", "score", "row_ord")
    chosen = dealt.mapInPandas(walk, schema)
    counts = chosen.groupBy("pair_id").agg(F.count(F.lit(1)).alias("survivors"))
    return chosen.join(counts, "pair_id").withColumn("status", F.when(F.col("survivors") >= least, "OK").otherwise("FAILED"))


def confident(matches: DataFrame, least: float = 0.35) -> DataFrame:
    """Raw matches of a learned matcher at or above a confidence whose both ends are on valid pixels, best first."""
    return matches.filter((F.col("confidence") >= least) & F.coalesce(F.col("s_valid"), F.lit(False)) & F.coalesce(F.col("r_valid"), F.lit(False))).orderBy(F.col("confidence").desc(), "row_ord")


def rescaled(matches: DataFrame, source: float, reference: float) -> DataFrame:
    """Coordinates of a coarser run in full pixels."""
    return matches.withColumns({"sx": F.col("sx") * source, "sy": F.col("sy") * source, "rx": F.col("rx") * reference, "ry": F.col("ry") * reference})
