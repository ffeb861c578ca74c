import math
import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from framealign.functions import geometry as G
from framealign.operators import overlap as O


def square(a, b, side, turn=0.0):
    out = []
    for x, y in ((0, 0), (0, side), (side, side), (side, 0)):
        out.append((a + x * math.cos(turn) - y * math.sin(turn), b + x * math.sin(turn) + y * math.cos(turn)))
    return out


def test_clip_properties():
    rng = random.Random(1)
    for _ in range(200):
        p, q = (square(rng.uniform(0, 3), rng.uniform(0, 3), rng.uniform(0.5, 3), rng.uniform(0, 6)) for _ in range(2))
        a, b = O.polygon_area(O.clip(p, q)), O.polygon_area(O.clip(q, p))
        assert abs(a - b) < 1e-6 and a <= min(O.polygon_area(p), O.polygon_area(q)) + 1e-6
    assert O.polygon_area(O.clip(square(0, 0, 2), square(1, 1, 2))) == 1.0
    assert O.clip(square(0, 0, 1), square(5, 5, 1)) == []
    assert not O.is_simple([(0, 0), (1, 1), (1, 0), (0, 1)]) and O.is_simple(square(0, 0, 1, 0.3))


def test_batches_of_pairs_clip_like_one_pair():
    """Corner for corner, and many at once."""
    rng = random.Random(2)

    def ring():
        n, x, y = rng.choice([0, 1, 2, 3, 4, 4, 4, 5, 9]), rng.uniform(0, 3), rng.uniform(0, 3)
        kind = rng.randrange(4)
        if kind == 0:
            return None if n == 1 else [(float(rng.randrange(4)), float(rng.randrange(4))) for _ in range(n)]
        far = [rng.uniform(0.2, 1.5) if kind == 1 else 1.0 for _ in range(n)]
        return [(x + f * math.cos(2 * math.pi * k / n), y + f * math.sin(2 * math.pi * k / n)) for k, f in enumerate(far)][:: rng.choice([1, -1])]

    kind = pa.list_(pa.struct([("a", pa.float64()), ("b", pa.float64())]))
    made = lambda rows: pa.array([r and [{"a": x, "b": y} for x, y in r] for r in rows], kind)
    pairs = [(ring(), ring()) for _ in range(3000)]
    got = O._overlaps(*(made(x).slice(7) for x in zip(*pairs, strict=True)), pa.array([False] * 2993)).to_pylist()
    for (p, q), found in zip(pairs[7:], got, strict=True):
        ok = O.is_simple(p or []) and O.is_simple(q or [])
        want = O.clip(p, q) if ok else []
        assert found["rings_valid"] == ok and [(c["a"], c["b"]) for c in found["overlap_polygon"]] == want
        assert abs(found["overlap_area"] - O.polygon_area(want)) < 1e-9
    boxes = [made([square(rng.uniform(0, 9), rng.uniform(0, 9), 3.0) for _ in range(40_000)]) for _ in range(2)]
    start = time.process_time()
    assert sum(O._overlaps(*boxes, pa.array([True] * 40_000)).field("rings_valid").to_pylist()) == 40_000
    assert time.process_time() - start < 4


def test_rings_without_corners_or_with_unknown_ones(spark):
    """A corner without a coordinate ended the job before."""
    box = [(1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    got = O.evaluate(rings(spark, (box, box, None, None), ([(1.0, None), *box[1:]], box, None, None), ([], box, None, None), (None, box, None, None))).orderBy("k").collect()
    assert [r.status for r in got] == ["validated", "geometry_error", "geometry_error", "pending"] and got[0].overlap_area == 1.0


def rings(spark, *pairs):
    shape = "array<struct<a:double,b:double>>"
    return spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], f"k int, source_ring {shape}, reference_ring {shape}, source_projection string, reference_projection string")


def test_verdicts(spark):
    box = lambda *v: (lambda s, n, w, e: [(n, w), (n, e), (s, e), (s, w)])(*map(float, v))
    polar = "Polar stereographic"
    got = O.evaluate(rings(
        spark, (box(0, 10, 0, 10), box(9.998, 19.998, 0, 10), None, None), (box(0, 10, 0, 10), box(5, 15, 5, 15), None, None), (box(0, 10, 350, 370), box(0, 10, -5, 5), None, None),
        (box(0, 1, 0, 1), box(5, 6, 5, 6), None, None), (None, box(0, 1, 0, 1), None, None), ([(0.0, 0.0), (1.0, 1.0), (1.0, 0.0), (0.0, 1.0)], box(0, 1, 0, 1), None, None),
        ([(-89.0, 0.0), (-89.0, 90.0), (-89.0, 180.0), (-89.0, 270.0)], [(-88.0, 0.0), (-88.0, 90.0), (-88.0, 180.0), (-88.0, 270.0)], polar, polar),
    )).orderBy("k").collect()
    assert [r.status for r in got] == ["insufficient_overlap", "validated", "validated", "rejected", "pending", "geometry_error", "validated"]
    assert abs(got[0].pct_smaller - 0.02) < 1e-6 and got[1].overlap_area == 25.0 and abs(got[2].overlap_area - 100.0) < 1e-6
    inner = 2 * (2 * G.RADIUS_KM * math.tan(math.radians(0.5))) ** 2
    assert got[6].polar and abs(got[6].overlap_km2 - inner) < 1e-6 and abs(got[6].pct_smaller - 100) < 1e-6
    assert all(abs(p.a + 89) < 1e-6 for p in got[6].overlap_polygon)


def test_polar_inverse_and_window(spark):
    df = spark.createDataFrame([(-89.2, 222.3), (-60.0, 0.5), (-90.0, 10.0)], "lat double, lon double").withColumn("p", G.polar(F.col("lat"), F.col("lon")))
    for r in df.withColumn("q", G.from_polar(F.col("p.a"), F.col("p.b"))).collect():
        assert abs(r.q.a - r.lat) < 1e-9 and (abs(r.q.b - r.lon) < 1e-9 or r.lat == -90)
    num = lambda *v: tuple(F.lit(float(x)) for x in v)
    w = spark.range(1).select(G.pixel_window(F.lit(100), F.lit(200), num(0, 10, 0, 10), num(2, 4, 5, 6)).alias("w"), G.pixel_window(F.lit(100), F.lit(200), num(0, 10, 0, 10), num(20, 21, 5, 6)).alias("e")).first()
    assert tuple(w.w) == (59, 81, 99, 121) and tuple(w.e)[:2] == (0, 100)


def test_rings_that_cross_the_seam_and_tests_of_points(spark):
    shape = "array<struct<a:double,b:double>>"
    df = spark.createDataFrame([([(1.0, 359.0), (1.0, 1.0), (0.0, 1.0), (0.0, 359.0)], [(0.2, 0.2), (0.2, 0.4), (0.1, 0.4), (0.1, 0.2)], [(5.0, 5.0), (5.0, 6.0), (4.0, 6.0), (4.0, 5.0)])], f"r {shape}, s {shape}, t {shape}")
    u = df.select(G.unwrapped(F.col("r")).alias("r"), F.transform("s", lambda p: G.point(p["a"], p["b"] + 360.0)).alias("s"), "t")
    got = u.select("r", G.area(F.col("r")), G.intersects(F.col("r"), F.col("s")), G.intersects(F.col("r"), F.col("t")), G.bounds(F.col("r")).alias("b")).first()
    assert [p.b for p in got[0]] == [359.0, 361.0, 361.0, 359.0] and got[1] == 2.0 and got[2] is True and got[3] is False and got.b.max_b == 361.0


def test_candidates_come_once(spark):
    rng = random.Random(3)
    make = lambda k: (k, *(lambda a, b: (a, a + rng.uniform(0, 25), b, b + rng.uniform(0, 25)))(rng.uniform(-80, 60), rng.uniform(0, 330)))
    s, r = [make(k) for k in range(60)], [make(k + 30) for k in range(60)]
    cols = "id long, min_a double, max_a double, min_b double, max_b double"
    got = sorted((x.s_id, x.r_id) for x in O.candidates(spark.createDataFrame(s, cols), spark.createDataFrame(r, cols)).collect())
    want = sorted((x[0], y[0]) for x in s for y in r if x[0] != y[0] and x[1] <= y[2] and y[1] <= x[2] and x[3] <= y[4] and y[3] <= x[4])
    assert got == want
