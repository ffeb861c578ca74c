"""Footprint overlap: candidate pairs by cells, exact clipping, and the verdict with its gate."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.states import LEAST_OVERLAP

#: Side of a candidate cell in degrees.
CELL = 5.0
#: Corners that are clipped at once, for rings of equal sizes.
MOST_CORNERS = 100_000


def candidates(sources: DataFrame, references: DataFrame, cell: float = CELL) -> DataFrame:
    """source_id, reference_id of products whose bounds meet; tables: id, min_a, max_a, min_b, max_b (degrees).

    Each product is filed under the cells its bounds touch, and products meet by cell; a pair is kept only in the cell that holds the lower
    corner of the common bounds, so it comes once and no distinct is needed. Skewed cells are split at run time. The references are
    dealt out evenly first: a table of one small file can have very many pairs.
    """
    parts = int(references.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def filed(t: DataFrame, p: str) -> DataFrame:
        row = F.sequence(F.floor(F.col("min_a") / cell).cast("int"), F.floor(F.col("max_a") / cell).cast("int"))
        col = F.sequence(F.floor(F.col("min_b") / cell).cast("int"), F.floor(F.col("max_b") / cell).cast("int"))
        out = t.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "min_a", "max_a", "min_b", "max_b")], F.explode(row).alias("ca"), col.alias("cols"))
        return out.select("*", F.explode("cols").alias("cb")).drop("cols")

    s, r = filed(sources, "s"), filed(references.repartition(parts), "r")
    lower_a, lower_b = F.greatest("s_min_a", "r_min_a"), F.greatest("s_min_b", "r_min_b")
    met = s.join(r, ["ca", "cb"]).filter((F.col("s_min_a") <= F.col("r_max_a")) & (F.col("r_min_a") <= F.col("s_max_a")) & (F.col("s_min_b") <= F.col("r_max_b")) & (F.col("r_min_b") <= F.col("s_max_b")) & (F.col("s_id") != F.col("r_id")))
    return met.filter((F.floor(lower_a / cell) == F.col("ca")) & (F.floor(lower_b / cell) == F.col("cb"))).drop("ca", "cb")


def box_overlap(pairs: DataFrame) -> DataFrame:
    """Areas of the products' bounds and of what they share, with the gate, for pairs of `candidates`."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), hi - lo)
    own = lambda p: (F.col(f"{p}_max_a") - F.col(f"{p}_min_a")) * (F.col(f"{p}_max_b") - F.col(f"{p}_min_b"))
    shared = side(F.greatest("s_min_a", "r_min_a"), F.least("s_max_a", "r_max_a")) * side(F.greatest("s_min_b", "r_min_b"), F.least("s_max_b", "r_max_b"))
    out = pairs.withColumns({"source_area": own("s"), "reference_area": own("r"), "overlap_area": shared})
    return gated(out)


def gated(out: DataFrame, least: float = LEAST_OVERLAP) -> DataFrame:
    """Percentages and status from source_area, reference_area, overlap_area (square degrees)."""
    pct = lambda of: F.when(of > 0, F.col("overlap_area") / of * 100.0).otherwise(0.0)
    out = out.withColumns({"pct_source": pct(F.col("source_area")), "pct_reference": pct(F.col("reference_area")), "pct_smaller": pct(F.least("source_area", "reference_area")), "overlap_km2": G.km2(F.col("overlap_area"))})
    status = F.when(F.col("overlap_area") <= 0, "rejected").when(F.col("pct_smaller") < least, "insufficient_overlap").otherwise("validated")
    return out.withColumn("status", status).withColumn("gate_passed", F.col("status") == "validated")


def clip(subject: list[tuple[float, float]], window: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The part of a polygon inside a convex one, by cutting it with the half plane of each side in turn."""
    twice = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(window, [*window[1:], window[0]], strict=True))
    way = 1.0 if twice >= 0 else -1.0
    for (ax, ay), (bx, by) in zip(window, [*window[1:], window[0]], strict=True):
        depth = [way * ((bx - ax) * (y - ay) - (by - ay) * (x - ax)) for x, y in subject]
        kept: list[tuple[float, float]] = []
        for k, (x, y) in enumerate(subject):
            (px, py), dp, d = subject[k - 1], depth[k - 1], depth[k]
            if (d >= -G.SIDE) != (dp >= -G.SIDE):
                t = dp / (dp - d)
                kept.append((px + t * (x - px), py + t * (y - py)))
            if d >= -G.SIDE:
                kept.append((x, y))
        subject = kept
        if not subject:
            break
    return subject


def polygon_area(p: list[tuple[float, float]]) -> float:
    return abs(math.fsum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, [*p[1:], *p[:1]], strict=True))) / 2 if len(p) > 2 else 0.0


def is_simple(p: list[tuple[float, float]]) -> bool:
    """A polygon of positive area whose sides that aren't neighbours don't cross; sides of no length and shared corners are passed over."""
    n = len(p)
    if n < 3 or polygon_area(p) <= 1e-12:
        return False
    near = lambda a, b: math.dist(a, b) <= 1e-12
    turn = lambda a, b, c: (lambda v: (v > G.SIDE) - (v < -G.SIDE))((b[1] - a[1]) * (c[0] - b[0]) - (b[0] - a[0]) * (c[1] - b[1]))
    sides = [(p[k], p[(k + 1) % n]) for k in range(n)]
    for i in range(n):
        for j in range(i + 2, n - (i == 0)):
            (a, b), (c, d) = sides[i], sides[j]
            if near(a, b) or near(c, d) or any(near(u, v) for u in (a, b) for v in (c, d)):
                continue
            if turn(a, b, c) != turn(a, b, d) and turn(c, d, a) != turn(c, d, b):
                return False
    return True


# The same over many pairs at once: rings of n corners as arrays (pairs, n).


def _next(x: np.ndarray, count: np.ndarray | None = None) -> np.ndarray:
    """The corner after each; count: how many of the columns a row has, all if it is None."""
    out = np.roll(x, -1, axis=1)
    if count is not None:
        at = np.flatnonzero(count > 0)
        out[at, count[at] - 1] = x[at, 0]
    return out


def _areas(x: np.ndarray, y: np.ndarray, count: np.ndarray | None = None) -> np.ndarray:
    """`geometry.area` of each row, summed in the same order."""
    terms = x * _next(y, count) - _next(x, count) * y
    total = np.zeros(len(x))
    for k in range(x.shape[1]):
        total += terms[:, k] if count is None else np.where(k < count, terms[:, k], 0.0)
    return np.where((x.shape[1] if count is None else count) >= 3, np.abs(total / 2.0), 0.0)


def _simple(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """`is_simple` of each row; rings with a corner that isn't a finite point aren't."""
    n = x.shape[1]
    ok = np.isfinite(x).all(axis=1) & np.isfinite(y).all(axis=1)
    if n < 3:
        return np.zeros(len(x), bool)
    nx, ny = _next(x), _next(y)
    slack = (np.abs(x * ny) + np.abs(nx * y)).sum(axis=1) * n * 1e-15
    for k in np.flatnonzero(ok & (_areas(x, y) <= 1e-12 + slack)).tolist():  # where rounding may tell
        ok[k] = polygon_area(list(zip(x[k].tolist(), y[k].tolist(), strict=True))) > 1e-12

    def turns(a, b, c) -> np.ndarray:  # noqa: ANN001
        v = (b[1] - a[1]) * (c[0] - b[0]) - (b[0] - a[0]) * (c[1] - b[1])
        return (v > G.SIDE).astype(np.int8) - (v < -G.SIDE)

    near = lambda a, b: np.hypot(a[0] - b[0], a[1] - b[1]) <= 1e-12
    for i in range(n - 2):
        one, rest = slice(i, i + 1), slice(i + 2, n - (i == 0))
        a, b, c, d = (x[:, one], y[:, one]), (nx[:, one], ny[:, one]), (x[:, rest], y[:, rest]), (nx[:, rest], ny[:, rest])
        crossed = (turns(a, b, c) != turns(a, b, d)) & (turns(c, d, a) != turns(c, d, b))
        if crossed.any():
            crossed &= ~(near(a, b) | near(c, d) | near(a, c) | near(a, d) | near(b, c) | near(b, d))
            ok &= ~crossed.any(axis=1)
    return ok


def _clip(x: np.ndarray, y: np.ndarray, wx: np.ndarray, wy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`clip` of each row: corners, and how many of the columns a row has."""
    ex, ey = _next(wx), _next(wy)
    twice = np.zeros(len(x))
    for k in range(wx.shape[1]):
        twice += wx[:, k] * ey[:, k] - ex[:, k] * wy[:, k]
    way = np.where(twice >= 0, 1.0, -1.0)[:, None]
    count = np.full(len(x), x.shape[1])
    for k in range(wx.shape[1]):
        ax, ay, bx, by = (t[:, k : k + 1] for t in (wx, wy, ex, ey))
        there = np.arange(x.shape[1]) < count[:, None]
        depth = way * ((bx - ax) * (y - ay) - (by - ay) * (x - ax))
        inside = (depth >= -G.SIDE) & there
        if (inside == there).all():
            continue
        last = np.maximum(count - 1, 0)[:, None]
        px, py, dp = (np.concatenate([np.take_along_axis(t, last, 1), t[:, :-1]], axis=1) for t in (x, y, depth))
        cross = (inside != (dp >= -G.SIDE)) & there
        t = dp / np.where(cross, dp - depth, 1.0)
        kept = np.stack([cross, inside], axis=2).reshape(len(x), -1)
        count = kept.sum(axis=1)
        to = np.arange(max(1, count.max(initial=0))) < count[:, None]
        both = []
        for old, new in ((x, px + t * (x - px)), (y, py + t * (y - py))):
            out = np.zeros(to.shape)
            out[to] = np.stack([new, old], axis=2).reshape(len(x), -1)[kept]
            both.append(out)
        x, y = both
    return x, y, count


def _unwrapped(lon: np.ndarray) -> np.ndarray:
    """`geometry.unwrapped` of each row."""
    out = lon.copy()
    for k in range(1, lon.shape[1]):
        out[:, k] -= 360.0 * np.floor((out[:, k] - out[:, k - 1] + 180.0) / 360.0)
    return out


def _middles(lon: np.ndarray) -> np.ndarray:
    total = np.zeros(len(lon))
    for k in range(lon.shape[1]):
        total += lon[:, k]
    return total / lon.shape[1]


def _corners(rings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First corner and number of corners of each ring (none if it is null), and the corners of all."""
    starts = rings.offsets.to_numpy().astype(np.int64)
    size = np.where(rings.is_valid().to_numpy(zero_copy_only=False), np.diff(starts), 0)
    a, b = (c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in rings.values.flatten())
    return starts[:-1], size, a, b


_FOUND = ("source_area", "reference_area", "overlap_area")


def _overlaps(s: pa.Array, r: pa.Array, degrees: pa.Array) -> pa.StructArray:
    n = len(s)
    (s_at, s_size, s_a, s_b), (r_at, r_size, r_a, r_b) = _corners(s), _corners(r)
    degrees = degrees.to_numpy(zero_copy_only=False).astype(bool)
    areas, valid, count = np.zeros((3, n)), np.zeros(n, bool), np.zeros(n, np.int64)
    held = []
    kinds, of = np.unique(np.stack([s_size, r_size]), axis=1, return_inverse=True) if n and (np.ptp(s_size) or np.ptp(r_size)) else (np.array([s_size[:1], r_size[:1]]), np.zeros(n, np.int64))
    for kind, (p, q) in enumerate(kinds.T.tolist()):
        rows = np.flatnonzero(of.ravel() == kind)
        step = max(1, MOST_CORNERS // (p + q + 1))
        for at in (rows[k : k + step] for k in range(0, len(rows), step)):
            with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
                where_s, where_r = s_at[at][:, None] + np.arange(p), r_at[at][:, None] + np.arange(q)
                x, y, wx, wy = s_a[where_s], s_b[where_s], r_a[where_r], r_b[where_r]
                turned = degrees[at][:, None]
                if turned.any():
                    y, wy = np.where(turned, _unwrapped(y), y), np.where(turned, _unwrapped(wy), wy)
                    if p and q:
                        wy = np.where(turned, wy + np.rint((_middles(y) - _middles(wy)) / 360.0)[:, None] * 360.0, wy)
                areas[0, at], areas[1, at] = _areas(x, y), _areas(wx, wy)
                ok = _simple(x, y) & _simple(wx, wy)
                valid[at] = ok
                if ok.any():
                    cx, cy, c = _clip(x[ok], y[ok], wx[ok], wy[ok])
                    areas[2, at[ok]], count[at[ok]] = _areas(cx, cy, c), c
                    held.append((at[ok], cx, cy, c))
    starts = np.concatenate([[0], np.cumsum(count)])
    a, b = np.zeros(starts[-1]), np.zeros(starts[-1])
    for at, cx, cy, c in held:
        k = np.arange(cx.shape[1])
        there = k < c[:, None]
        to = (starts[at][:, None] + k)[there]
        a[to], b[to] = cx[there], cy[there]
    ring = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"]))
    return pa.StructArray.from_arrays([*(pa.array(x) for x in areas), ring, pa.array(valid)], names=[*_FOUND, "overlap_polygon", "rings_valid"])


_RING = "array<struct<a:double,b:double>>"


def clipped(pairs: DataFrame, source: str = "source_ring", reference: str = "reference_ring", degrees: Column | None = None) -> DataFrame:
    """pairs with overlap_polygon, rings_valid and the areas of both rings and of the polygon.

    Both rings are in one plane; or, where `degrees` holds, in degrees, and are unwrapped, with the reference moved by whole turns to
    the source, first. A task works on batches of pairs, as arrays over rings of equal sizes.
    """

    @F.arrow_udf(f"struct<{','.join(f'{c}:double' for c in _FOUND)},overlap_polygon:{_RING},rings_valid:boolean>")
    def both(s: pa.Array, r: pa.Array, degrees: pa.Array) -> pa.Array:
        return _overlaps(s, r, degrees)

    names = [*_FOUND, "overlap_polygon", "rings_valid"]
    found = pairs.withColumn("clip", both(source, reference, F.lit(False) if degrees is None else degrees))
    return found.select(*[c for c in pairs.columns if c not in names], *[f"clip.{c}" for c in names])


def evaluate(pairs: DataFrame, least: float = LEAST_OVERLAP) -> DataFrame:
    """Overlap verdict per pair: source_ring, reference_ring (degrees, or null), source_projection, reference_projection.

    Both south of 60 S with polar projections: clipped in the polar plane, in km2. Else in degrees, with the reference moved by whole
    turns to the source. Missing rings: pending; rings that cross themselves: geometry_error. Percentages are always the true ones.
    """
    polar_name = lambda c: F.lower(F.coalesce(F.col(c), F.lit("Equirectangular"))).rlike("polar|stereographic")
    south = lambda c: F.forall(c, lambda p: p["a"] <= -60.0)
    polar = F.coalesce(south("source_ring") & south("reference_ring"), F.lit(False)) & polar_name("source_projection") & polar_name("reference_projection")
    plane = lambda c: F.transform(c, lambda p: G.polar(p["a"], p["b"]))
    flat = pairs.withColumn("polar", polar)
    flat = flat.withColumns({k: F.when(F.col("polar"), plane(c)).otherwise(F.col(c)) for k, c in (("s", "source_ring"), ("r", "reference_ring"))})
    areas = clipped(flat, "s", "r", ~F.col("polar"))
    out = gated(areas, least)
    missing = F.col("source_ring").isNull() | F.col("reference_ring").isNull()
    status = F.when(missing, "pending").when(~F.coalesce("rings_valid", F.lit(False)), "geometry_error").otherwise(F.col("status"))
    back = F.when(F.col("polar"), F.transform("overlap_polygon", lambda p: G.from_polar(p["a"], p["b"]))).otherwise(F.col("overlap_polygon"))
    km2 = F.when(F.col("polar"), F.col("overlap_area")).otherwise(G.km2(F.col("overlap_area")))
    return out.withColumn("overlap_km2", km2).withColumn("status", status).withColumn("gate_passed", F.col("status") == "validated").withColumn("overlap_polygon", back).drop("s", "r")


def area_of(c: Column) -> Column:
    return G.area(c)
