"""Footprint geometry as column expressions: rings, areas, intersection tests, polar projection, pixel windows.

A ring is array<struct<a double, b double>> (latitude and longitude, or plane coordinates), in the order upper left, upper
right, lower right, lower left.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lunar radius in km, and the tolerances of the tests.
RADIUS_KM = 1737.4
SIDE = 1e-9
KM2_PER_SQ_DEG = (RADIUS_KM * math.pi / 180) ** 2


def point(a: Column, b: Column) -> Column:
    return F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"))


def ring(ul: Column, ur: Column, lr: Column, ll: Column) -> Column:
    return F.array(ul, ur, lr, ll)


def box(south: Column, north: Column, west: Column, east: Column) -> Column:
    return ring(point(north, west), point(north, east), point(south, east), point(south, west))


def unwrapped(r: Column) -> Column:
    """Longitudes moved by whole turns so that no step exceeds 180 degrees."""
    start = F.expr("cast(array() as array<struct<a:double,b:double>>)")

    def step(done: Column, p: Column) -> Column:
        last = F.element_at(done, -1)["b"]
        turns = F.when(F.size(done) == 0, F.lit(0.0)).otherwise(F.floor((p["b"] - last + 180.0) / 360.0).cast("double"))
        return F.concat(done, F.array(point(p["a"], p["b"] - 360.0 * turns)))

    return F.aggregate(r, start, step)


def edges(r: Column) -> Column:
    """Pairs of neighbours, the last with the first."""
    return F.arrays_zip(r.alias("p"), F.concat(F.slice(r, 2, F.size(r) - 1), F.slice(r, 1, 1)).alias("q"))


def signed_area(r: Column) -> Column:
    n = F.size(r)
    term = lambda i: r[i]["a"] * r[(i + 1) % n]["b"] - r[(i + 1) % n]["a"] * r[i]["b"]
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + term(i)) / 2.0


def area(r: Column) -> Column:
    return F.when(F.size(r) >= 3, F.abs(signed_area(r))).otherwise(0.0)


def km2(sq_deg: Column) -> Column:
    return sq_deg * F.lit(KM2_PER_SQ_DEG)


def _turn(p: Column, q: Column, r: Column) -> Column:
    v = (q["b"] - p["b"]) * (r["a"] - q["a"]) - (q["a"] - p["a"]) * (r["b"] - q["b"])
    return F.when(v > SIDE, 1).when(v < -SIDE, -1).otherwise(0)


def crosses(p: Column, q: Column, r: Column, s: Column) -> Column:
    """Whether segments pq and rs have their ends on different sides of each other."""
    return (_turn(p, q, r) != _turn(p, q, s)) & (_turn(r, s, p) != _turn(r, s, q))


def contains(r: Column, p: Column) -> Column:
    """Even-odd rule over the ring's edges."""
    n = F.size(r)

    def toggles(i: Column) -> Column:
        u, v = r[i], r[(i + 1) % n]
        cut = (v["a"] - u["a"]) * (p["b"] - u["b"]) / F.when(v["b"] == u["b"], F.lit(None)).otherwise(v["b"] - u["b"]) + u["a"]
        return F.when((u["b"] > p["b"]) != (v["b"] > p["b"]), p["a"] < cut).otherwise(False)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), lambda x, i: x != F.coalesce(toggles(i), F.lit(False)))


def intersects(r: Column, s: Column) -> Column:
    """An edge of one crosses one of the other, or the first corner of one lies in the other."""
    n, m = F.size(r), F.size(s)
    cross = F.exists(F.sequence(F.lit(0), n - 1), lambda i: F.exists(F.sequence(F.lit(0), m - 1), lambda j: crosses(r[i], r[(i + 1) % n], s[j], s[(j + 1) % m])))
    return cross | contains(s, r[0]) | contains(r, s[0])


def wrapped(lon: Column) -> Column:
    return F.pmod(lon.cast("double"), F.lit(360.0))


def polar(lat: Column, lon: Column, radius: float = RADIUS_KM) -> Column:
    """South polar stereographic plane coordinates in km; y runs along longitude 0."""
    rho = F.lit(2.0 * radius) * F.tan(F.radians(F.greatest(F.lit(90.0) + lat, F.lit(0.0)) / 2.0))
    return point(rho * F.sin(F.radians(lon)), rho * F.cos(F.radians(lon)))


def from_polar(x: Column, y: Column, radius: float = RADIUS_KM) -> Column:
    """Latitude and longitude of plane coordinates; the inverse of `polar`."""
    rho = F.hypot(x, y)
    lat = F.degrees(F.atan(rho / F.lit(2.0 * radius))) * 2.0 - 90.0
    return F.when(rho < 1e-12, point(F.lit(-90.0), F.lit(0.0))).otherwise(point(lat, wrapped(F.degrees(F.atan2(x, y)))))


def projection_status(projection: Column, radius: Column, parameters_default: Column) -> Column:
    """NOT_PROVIDED, UNSUPPORTED, PROJECTION_ERROR or VALID."""
    low = F.lower(F.trim(F.coalesce(projection, F.lit(""))))
    known = low.contains("polar") | low.contains("stereographic") | low.contains("equirectangular") | low.contains("simple cylindrical")
    return F.when(low == "", "NOT_PROVIDED").when(~known, "UNSUPPORTED").when((radius <= 0) | ~F.coalesce(parameters_default, F.lit(True)), "PROJECTION_ERROR").otherwise("VALID")


def bounds(r: Column) -> Column:
    a, b = F.transform(r, lambda p: p["a"]), F.transform(r, lambda p: p["b"])
    return F.struct(F.array_min(a).alias("min_a"), F.array_max(a).alias("max_a"), F.array_min(b).alias("min_b"), F.array_max(b).alias("max_b"))


def pixel_window(height: Column, width: Column, image: tuple[Column, ...], overlap: tuple[Column, ...], padding: float = 0.05) -> Column:
    """Rows and columns (y0, y1, x0, x1) of geographic bounds in a north-up image; the whole image if nothing is left.

    Bounds are (min_lat, max_lat, min_lon, max_lon); rounding is half to even.
    """
    south, north, west, east = image
    o_south, o_north, o_west, o_east = overlap
    tall, broad = F.greatest(north - south, F.lit(1e-9)), F.greatest(east - west, F.lit(1e-9))
    top, bottom = (north - o_north) / tall, (north - o_south) / tall
    left, right = (o_west - west) / broad, (o_east - west) / broad
    dy, dx = (bottom - top) * padding, (right - left) * padding
    whole = lambda c: F.bround(c, 0).cast("int")
    y0, y1 = F.greatest(F.lit(0), whole((top - dy) * height)), F.least(height, whole((bottom + dy) * height))
    x0, x1 = F.greatest(F.lit(0), whole((left - dx) * width)), F.least(width, whole((right + dx) * width))
    return F.struct(
        F.when(y1 <= y0, 0).otherwise(y0).alias("y0"), F.when(y1 <= y0, height).otherwise(y1).alias("y1"),
        F.when(x1 <= x0, 0).otherwise(x0).alias("x0"), F.when(x1 <= x0, width).otherwise(x1).alias("x1"),
    )


def scale_ratio(source_gsd: Column, reference_gsd: Column) -> Column:
    """Reference over source resolution; null unless both are positive."""
    return F.when((source_gsd > 0) & (reference_gsd > 0), reference_gsd / source_gsd)


def scale_summary(source_gsd: Column, reference_gsd: Column) -> Column:
    """Source over reference (3 decimals), the coarser side, whole octaves, and the factor to resample the finer side by."""
    ratio = F.when((source_gsd > 0) & (reference_gsd > 0), source_gsd / reference_gsd)
    return F.struct(
        F.bround(ratio, 3).alias("ratio"), F.when(ratio > 1, "source").when(ratio < 1, "reference").when(ratio == 1, "equal").alias("coarser"),
        F.abs(F.bround(F.log2(ratio), 0)).cast("int").alias("octaves"), F.when(ratio >= 1, ratio).otherwise(1 / ratio).alias("factor"),
    )
