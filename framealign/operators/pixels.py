"""Raster kernels. Pixels are long rows (product_id, line, sample, value, valid); images of one product for Arrow kernels are arrays
cut into tiles with a halo, so a task holds one tile however large the product."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 256
KEY = ("product_id", "line", "sample")


def stretch(pixels: DataFrame, low: float = 0.01, high: float = 0.99, least: int = 100) -> DataFrame:
    """Values between two percentiles of the valid ones as 0 to 255; status FAILED for too few values or no contrast."""
    v = F.when(F.col("valid"), F.col("value").cast("double"))
    stats = pixels.groupBy("product_id").agg(F.count(v).alias("n"), F.percentile(v, F.array(F.lit(low), F.lit(high))).alias("q"))
    ok = (F.col("n") >= least) & (F.col("q")[1] > F.col("q")[0])
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("value") - F.col("q")[0]) / (F.col("q")[1] - F.col("q")[0])))
    return pixels.join(stats, "product_id").select(*KEY, F.when(ok & F.col("valid"), (scaled * 255).cast("int")).when(ok, 0).alias("value"), "valid", F.when(ok, "OK").otherwise("FAILED").alias("status"))


def stencil(pixels: DataFrame, weights: dict[str, dict[tuple[int, int], float]]) -> DataFrame:
    """Weighted sums over neighbours, one column per name, missing neighbours left out.

    Each pixel sends its value to the neighbours that use it, and sums meet by pixel: one shuffle, no join of the image to itself.
    """
    offsets = sorted({o for w in weights.values() for o in w})
    sent = F.array(*[F.struct(F.lit(k).alias("k"), (F.col("line") - dy).alias("line"), (F.col("sample") - dx).alias("sample")) for k, (dy, dx) in enumerate(offsets)])
    rows = pixels.select("product_id", "value", F.explode(sent).alias("t")).select("product_id", F.col("t.line").alias("line"), F.col("t.sample").alias("sample"), F.col("t.k").alias("k"), F.col("value").cast("double").alias("value"))
    center = offsets.index((0, 0)) if (0, 0) in offsets else None
    if center is None:
        raise ValueError("a stencil needs its centre; give it the weight 0")
    sums = [F.sum(F.when(F.col("k") == k, F.col("value") * w.get(o, 0.0))) for w in weights.values() for k, o in enumerate(offsets)]
    per = len(offsets)
    totals = []
    for i, name in enumerate(weights):
        total = F.lit(0.0)
        for s in sums[i * per : (i + 1) * per]:
            total = total + F.coalesce(s, F.lit(0.0))
        totals.append(total.alias(name))
    return rows.groupBy(*KEY).agg(F.count(F.when(F.col("k") == center, 1)).alias("own"), F.count(F.lit(1)).alias("neighbours"), *totals).filter("own > 0").drop("own")


SOBEL = {
    "gx": {(-1, -1): -1.0, (-1, 1): 1.0, (0, -1): -2.0, (0, 1): 2.0, (1, -1): -1.0, (1, 1): 1.0, (0, 0): 0.0},
    "gy": {(-1, -1): -1.0, (-1, 0): -2.0, (-1, 1): -1.0, (1, -1): 1.0, (1, 0): 2.0, (1, 1): 1.0, (0, 0): 0.0},
}
LAPLACE = {"lap": {(-1, 0): 1.0, (1, 0): 1.0, (0, -1): 1.0, (0, 1): 1.0, (0, 0): -4.0}}


def gradient(pixels: DataFrame) -> DataFrame:
    """Sobel magnitude of inner pixels, scaled to 0 to 255 per product."""
    g = stencil(pixels, SOBEL).filter("neighbours = 9").withColumn("magnitude", F.hypot("gx", "gy"))
    ends = g.groupBy("product_id").agg(F.min("magnitude").alias("lo"), F.max("magnitude").alias("hi"))
    span = F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12))
    return g.join(ends, "product_id").select(*KEY, "magnitude", ((F.col("magnitude") - F.col("lo")) / span * 255).cast("int").alias("value"))


def structure(pixels: DataFrame, share: float = 0.7) -> DataFrame:
    """Blend of an image and the size of its Laplacian; 0 where not valid."""
    lap = stencil(pixels, LAPLACE).select(*KEY, F.least(F.abs("lap"), F.lit(255.0)).alias("edge"))
    mixed = F.least(F.lit(255.0), F.col("value") * share + F.col("edge") * (1 - share))
    return pixels.join(lap, list(KEY)).select(*KEY, F.when(F.col("valid"), F.bround(mixed, 0).cast("int")).otherwise(0).alias("value"), "valid")


def eroded(pixels: DataFrame, size: int = 7) -> DataFrame:
    """Valid pixels whose whole neighbourhood within the image is valid."""
    half = size // 2
    bad = pixels.filter("not valid")
    reach = F.sequence(F.lit(-half), F.lit(half))
    near = bad.select("product_id", F.explode(F.transform(reach, lambda d: F.col("line") + d)).alias("line"), "sample").select("product_id", "line", F.explode(F.transform(reach, lambda d: F.col("sample") + d)).alias("sample")).distinct()
    hit = near.withColumn("near", F.lit(True))
    return pixels.join(hit, list(KEY), "left").withColumn("valid", F.col("valid") & F.col("near").isNull()).drop("near")


def display_stats(pixels: DataFrame) -> DataFrame:
    """Per product: lines, samples, least, largest and mean value of what a preview shows (no-numbers left out; zeros for an empty one)."""
    v = F.when(~F.isnan(F.col("value").cast("double")), F.col("value").cast("double"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return pixels.groupBy("product_id").agg((F.max("line") + 1).alias("lines"), (F.max("sample") + 1).alias("samples"), zero(F.min(v)).alias("least"), zero(F.max(v)).alias("largest"), zero(F.avg(v)).alias("mean"))


def on_mask(matches: DataFrame, mask: DataFrame, x: str, y: str, into: str) -> DataFrame:
    """matches with `into`: whether the pixel at (x, y), rounded and clipped to the mask, is valid; mask: pair_id, line, sample, valid.

    The point meets its pixel in an equi-join; pairs without a mask count as valid everywhere.
    """
    ends = mask.groupBy("pair_id").agg(F.max("line").alias("_ml"), F.max("sample").alias("_ms"))
    clip = lambda c, most: F.greatest(F.lit(0), F.least(F.col(most), F.bround(F.col(c), 0).cast("int")))
    placed = matches.join(ends, "pair_id", "left").withColumns({"_l": clip(y, "_ml"), "_s": clip(x, "_ms")})
    pixel = mask.select("pair_id", F.col("line").alias("_l"), F.col("sample").alias("_s"), F.col("valid").alias("_ok"))
    out = placed.join(pixel, ["pair_id", "_l", "_s"], "left")
    return out.withColumn(into, F.when(F.col("_ml").isNull(), True).otherwise(F.coalesce("_ok", F.lit(False)))).drop("_l", "_s", "_ml", "_ms", "_ok")


def _lanczos(t: Column, lobes: int = 4) -> Column:
    a = F.abs(t)
    x = F.lit(np.pi) * t
    return F.when(a < 1e-12, 1.0).when(a < lobes, lobes * F.sin(x) * F.sin(x / lobes) / (x * x)).otherwise(0.0)


#: Reach of a kernel in source pixels, and its weight at a distance.
RESIZE = {"nearest": (1, None), "linear": (1, lambda t: F.greatest(F.lit(0.0), 1.0 - F.abs(t))), "lanczos": (4, _lanczos)}


def resize(pixels: DataFrame, height: int, width: int, kind: str = "linear") -> DataFrame:
    """Images in another size (product_id, line, sample, value, valid): area (mean of the covered pixels, shares counted), nearest, linear or lanczos.

    Each output pixel asks for the source pixels that its kernel reaches, clipped to the image; weights are renewed. The requests
    meet the source by pixel, so neither image is held in one task. A pixel is valid if the nearest source pixel is.
    """
    if kind not in ("area", *RESIZE):
        raise ValueError(f"unknown kind of resize {kind}")
    size = pixels.groupBy("product_id").agg((F.max("line") + 1).alias("h"), (F.max("sample") + 1).alias("w"))
    at = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    grid = size.withColumn("line", at(height)).withColumn("sample", at(width))

    def asked(out: str, extent: str, n: int, name: str) -> Column:
        k = F.col(extent) / n
        if kind == "area":
            low, high = F.col(out) * k, (F.col(out) + 1) * k
            first, last = F.floor(low), F.greatest(F.ceil(high) - 1, F.floor(low))
            weight = lambda p: F.greatest(F.lit(0.0), F.least(high, p + 1) - F.greatest(low, p.cast("double")))
        else:
            reach, shape = RESIZE[kind]
            centre = (F.col(out) + 0.5) * k - 0.5
            near = F.least(F.col(extent) - 1, F.floor((F.col(out) + 0.5) * k))
            first, last = (near, near) if shape is None else (F.floor(centre) - (reach - 1), F.floor(centre) + reach)
            weight = lambda p: F.lit(1.0) if shape is None else shape(centre - p)
        return F.explode(F.transform(F.sequence(first.cast("int"), last.cast("int")), lambda p: F.struct(F.greatest(F.lit(0), F.least(F.col(extent) - 1, p)).cast("int").alias(name), weight(p).alias("k"))))

    lines = grid.withColumn("a", asked("line", "h", height, "p")).select("product_id", "line", "sample", "h", "w", F.col("a.p").alias("cl"), F.col("a.k").alias("ka"))
    both = lines.withColumn("b", asked("sample", "w", width, "p")).select("product_id", "line", "sample", "h", "w", "cl", F.col("b.p").alias("cs"), (F.col("ka") * F.col("b.k")).alias("k")).filter("k <> 0")
    source = pixels.select("product_id", F.col("line").alias("cl"), F.col("sample").alias("cs"), F.col("value").cast("double").alias("value"), "valid")
    nearest = (F.col("cl") == F.least(F.col("h") - 1, F.floor((F.col("line") + 0.5) * F.col("h") / height))) & (F.col("cs") == F.least(F.col("w") - 1, F.floor((F.col("sample") + 0.5) * F.col("w") / width)))
    got = both.join(source, ["product_id", "cl", "cs"])
    return got.groupBy(*KEY).agg((F.sum(F.col("k") * F.col("value")) / F.sum("k")).alias("value"), F.coalesce(F.max(F.when(nearest, F.col("valid"))), F.lit(False)).alias("valid"))


def area_mean(pixels: DataFrame, factor: int) -> DataFrame:
    """Blocks of factor x factor pixels as their mean over valid ones."""
    return pixels.groupBy("product_id", F.floor(F.col("line") / factor).cast("int").alias("line"), F.floor(F.col("sample") / factor).cast("int").alias("sample")).agg(
        F.avg(F.when(F.col("valid"), F.col("value").cast("double"))).alias("value"), F.max("valid").alias("valid")
    )


_BINOMIAL = (1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16)
PYRAMID = {"sum": {(dy - 2, dx - 2): a * b for dy, a in enumerate(_BINOMIAL) for dx, b in enumerate(_BINOMIAL)}, "weight": {}}


def half(pixels: DataFrame) -> DataFrame:
    """The next level of a Gaussian pyramid: a 5 x 5 binomial mean at every other pixel, weights renewed at the border."""
    w = {o: v for o, v in PYRAMID["sum"].items()}
    ones = pixels.withColumn("one", F.lit(1.0))
    total = stencil(pixels, {"total": w})
    weight = stencil(ones.select(*KEY, F.col("one").alias("value")), {"weight": w})
    out = total.join(weight.select(*KEY, "weight"), list(KEY)).filter("line % 2 = 0 and sample % 2 = 0")
    return out.select("product_id", F.floor(F.col("line") / 2).cast("int").alias("line"), F.floor(F.col("sample") / 2).cast("int").alias("sample"), (F.col("total") / F.col("weight")).alias("value"))


def pyramid(pixels: DataFrame, levels: int = 2) -> DataFrame:
    """All levels, the image itself as level 0."""
    out, level = pixels.select(F.lit(0).alias("level"), *KEY, F.col("value").cast("double").alias("value")), pixels
    for k in range(levels):
        level = half(level)
        out = out.unionByName(level.select(F.lit(k + 1).alias("level"), *KEY, "value"))
    return out


def blend(a: DataFrame, b: DataFrame, share: float = 0.5) -> DataFrame:
    """Source over reference where the source is valid."""
    s = a.select(*KEY, F.col("value").alias("s"), F.col("valid").alias("ok"))
    mixed = F.bround(F.col("s") * share + F.col("value") * (1 - share), 0).cast("int")
    return b.join(s, list(KEY), "left").select(*KEY, F.when(F.coalesce("ok", F.lit(False)), mixed).otherwise(F.col("value").cast("int")).alias("value"))


def checkerboard(a: DataFrame, b: DataFrame, tile: int = 64) -> DataFrame:
    """Squares of the reference (even) and the source (odd) by turns."""
    even = (F.floor(F.col("line") / tile) + F.floor(F.col("sample") / tile)) % 2 == 0
    return b.join(a.select(*KEY, F.col("value").alias("s")), list(KEY)).select(*KEY, F.when(even, F.col("value")).otherwise(F.col("s")).alias("value"))


def crop(pixels: DataFrame, y0: Column, y1: Column, x0: Column, x1: Column) -> DataFrame:
    """Pixels of a window, moved to its corner; the predicate reaches the scan."""
    return pixels.filter((F.col("line") >= y0) & (F.col("line") < y1) & (F.col("sample") >= x0) & (F.col("sample") < x1)).withColumns({"line": F.col("line") - y0, "sample": F.col("sample") - x0})


# ---- kernels over tiles ----


def tiled(pixels: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], halo: int, tile: int = TILE) -> DataFrame:
    """A kernel over (values, valid) of tiles with a halo; what it gives for the inner part comes back as pixels.

    A pixel is sent to its own tile and to those whose halo it is in.
    """
    ends = lambda c: F.sequence(F.greatest(F.floor((F.col(c) - halo) / tile), F.lit(0)).cast("int"), F.floor((F.col(c) + halo) / tile).cast("int"))
    sent = pixels.select(*KEY, F.col("value").cast("double").alias("value"), "valid", F.explode(ends("line")).alias("ty"), ends("sample").alias("txs")).select("*", F.explode("txs").alias("tx")).drop("txs")
    kinds = dict(pixels.dtypes)
    schema = f"product_id {kinds['product_id']}, line int, sample int, value double"

    def run(g: pd.DataFrame) -> pd.DataFrame:
        ty, tx, name = int(g["ty"].iloc[0]), int(g["tx"].iloc[0]), g["product_id"].iloc[0]
        y, x = g["line"].to_numpy(int), g["sample"].to_numpy(int)
        y0, x0 = y.min(), x.min()
        values, valid = np.full((y.max() - y0 + 1, x.max() - x0 + 1), np.nan), np.zeros((y.max() - y0 + 1, x.max() - x0 + 1), bool)
        values[y - y0, x - x0], valid[y - y0, x - x0] = g["value"].to_numpy(float), g["valid"].to_numpy(bool)
        out = kernel(values, valid)
        own = (y // tile == ty) & (x // tile == tx)
        return pd.DataFrame({"product_id": name, "line": y[own], "sample": x[own], "value": out[y[own] - y0, x[own] - x0]})

    return sent.groupBy("product_id", "ty", "tx").applyInPandas(run, schema)


def equalise(pixels: DataFrame, limit: float = 2.0, grid: int = 8) -> DataFrame:
    """Contrast-limited adaptive equalisation of 8-bit values: product_id, line, sample, value.

    A clipped histogram per field of a grid over the whole image, and maps blended between the fields around a pixel. The
    histograms are aggregates (grid x grid x 256 numbers a product); pixels ask for the four maps by their value and are summed up
    again, so an image is never held whole. Values that are null, not numbers or out of range are clipped, null counts as 0.
    """
    v = F.coalesce(F.when(~F.isnan(F.col("value").cast("double")), F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col("value").cast("double")))), F.lit(0.0)).cast("int")
    size = pixels.groupBy("product_id").agg(F.max("line").alias("_ml"), F.max("sample").alias("_ms")).select("product_id", "_ml", "_ms", F.floor((F.col("_ml") + grid) / grid).alias("fy"), F.floor((F.col("_ms") + grid) / grid).alias("fx"))
    last = size.select("product_id", "fy", "fx", F.floor(F.col("_ml") / F.col("fy")).cast("int").alias("my"), F.floor(F.col("_ms") / F.col("fx")).cast("int").alias("mx"))
    placed = pixels.select(*KEY, v.alias("v")).join(last, "product_id")
    field = placed.select("product_id", F.floor(F.col("line") / F.col("fy")).cast("int").alias("i"), F.floor(F.col("sample") / F.col("fx")).cast("int").alias("j"), "v")
    counted = field.groupBy("product_id", "i", "j", "v").agg(F.count(F.lit(1)).alias("c"))
    # a field has 256 counts at most
    held = counted.groupBy("product_id", "i", "j").agg(F.map_from_entries(F.collect_list(F.struct("v", "c"))).alias("h"), F.sum("c").alias("n"))
    most = F.greatest(F.lit(1.0), F.col("n") * limit / 256)
    bins = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda k: F.coalesce(F.try_element_at("h", k), F.lit(0)).cast("double"))
    shaped = held.withColumns({"most": most, "bins": bins}).withColumn("extra", F.aggregate("bins", F.lit(0.0), lambda s, c: s + F.greatest(c - F.col("most"), F.lit(0.0))) / 256)
    clipped = F.transform("bins", lambda c: F.least(c, F.col("most")) + F.col("extra"))
    shaped = shaped.withColumn("clipped", clipped)
    upto = F.transform(F.sequence(F.lit(1), F.lit(256)), lambda k: F.aggregate(F.slice("clipped", F.lit(1), k), F.lit(0.0), lambda s, c: s + c) * 255 / F.col("n"))
    maps = shaped.select("product_id", "i", "j", F.posexplode(upto).alias("v", "mapped"))
    y, x = (F.col("line") + 0.5) / F.col("fy") - 0.5, (F.col("sample") + 0.5) / F.col("fx") - 0.5
    at = placed.withColumns({"y": y, "x": x}).withColumns({"i0": F.least(F.col("my"), F.greatest(F.lit(0), F.floor("y").cast("int"))), "j0": F.least(F.col("mx"), F.greatest(F.lit(0), F.floor("x").cast("int")))})
    share = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    at = at.withColumns({"ty": share(F.col("y") - F.col("i0")), "tx": share(F.col("x") - F.col("j0"))})
    corner = lambda dy, dx: F.struct(F.least(F.col("my"), F.col("i0") + dy).alias("i"), F.least(F.col("mx"), F.col("j0") + dx).alias("j"), ((F.col("ty") if dy else 1 - F.col("ty")) * (F.col("tx") if dx else 1 - F.col("tx"))).alias("k"))
    asked = at.select(*KEY, "v", F.explode(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)])).alias("c")).select(*KEY, "v", "c.*")
    total = asked.join(maps, ["product_id", "i", "j", "v"]).groupBy(*KEY).agg(F.sum(F.col("k") * F.col("mapped")).alias("total"))
    return total.select(*KEY, F.bround(F.round(F.greatest(F.lit(0.0), F.least(F.lit(255.0), "total")), 6), 0).cast("int").alias("value"))


def warp(pixels: DataFrame, h: np.ndarray, height: int, width: int, field: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """An image in the reference frame: each output pixel asks for the four source pixels around its place and blends them.

    `field`: two rows of coefficients of a quadratic residual (over width and height) that is taken off first. Output pixels
    without all four neighbours are not valid. The requests meet the source by pixel, so neither image is held in one task.
    """
    inverse = np.linalg.inv(h).ravel().tolist()
    spark = pixels.sparkSession
    grid = spark.range(height * width).select(F.floor(F.col("id") / width).cast("int").alias("line"), (F.col("id") % width).cast("int").alias("sample"))
    x, y = F.col("sample").cast("double"), F.col("line").cast("double")
    if field is not None:
        u, v = x / max(width, 1), y / max(height, 1)
        terms = [F.lit(1.0), u, v, u * u, u * v, v * v]
        off = [sum((t * float(c) for t, c in zip(terms, row, strict=True)), F.lit(0.0)) for row in field]
        x, y = x - off[0], y - off[1]
    w = inverse[6] * x + inverse[7] * y + inverse[8]
    place = grid.withColumns({"sx": (inverse[0] * x + inverse[1] * y + inverse[2]) / w, "sy": (inverse[3] * x + inverse[4] * y + inverse[5]) / w})
    fx, fy = F.floor("sx").cast("int"), F.floor("sy").cast("int")
    corner = lambda dy, dx: F.struct((fy + dy).alias("cl"), (fx + dx).alias("cs"), ((1 - F.abs(F.col("sy") - fy - dy)) * (1 - F.abs(F.col("sx") - fx - dx))).alias("k"))
    asked = place.select("line", "sample", F.explode(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)])).alias("c")).select("line", "sample", "c.*").filter("k > 0")
    source = pixels.select("product_id", F.col("line").alias("cl"), F.col("sample").alias("cs"), F.col("value").cast("double").alias("value"), "valid")
    got = asked.join(source, ["cl", "cs"])
    out = got.groupBy("product_id", "line", "sample").agg(F.sum(F.col("k") * F.col("value")).alias("value"), F.sum("k").alias("k"), F.min("valid").alias("valid"))
    return out.select("product_id", "line", "sample", "value", (F.col("valid") & (F.col("k") > 1 - 1e-9)).alias("valid"))


def refined(images: DataFrame, points: DataFrame, half: int = 5, rounds: int = 40, eps: float = 0.01) -> DataFrame:
    """points (product_id, id, x, y) with tx, ty: corners moved to where the gradients around them are at right angles to the way to
    them. Each point gets the pixels of its neighbourhood by an equi-join, so an image is never held whole; points whose neighbourhood
    isn't complete, or that would leave it, stay."""
    reach = half + 2
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    asked = points.withColumns({"cy": F.bround("y", 0).cast("int"), "cx": F.bround("x", 0).cast("int")}).withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
    asked = asked.withColumns({"line": F.col("cy") + F.col("dy"), "sample": F.col("cx") + F.col("dx")})
    patch = asked.join(images.select(*KEY, F.col("value").cast("double").alias("value")), list(KEY))
    # a patch has a fixed number of pixels
    gathered = patch.groupBy("product_id", "id", "x", "y", "cy", "cx").agg(F.transform(F.array_sort(F.collect_list(F.struct("dy", "dx", "value"))), lambda p: p["value"]).alias("patch"))
    size = 2 * reach + 1

    @F.pandas_udf("tx double, ty double")
    def move(x: pd.Series, y: pd.Series, cy: pd.Series, cx: pd.Series, patch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([corner(np.asarray(p, float).reshape(size, size), a - v + reach, b - u + reach, half, rounds, eps, a, b) if len(p) == size * size else (a, b) for a, b, u, v, p in zip(x, y, cy, cx, patch, strict=True)], columns=["tx", "ty"])

    done = gathered.withColumn("t", move("x", "y", "cy", "cx", "patch")).select("product_id", "id", "t.tx", "t.ty")
    return points.join(done, ["product_id", "id"], "left").withColumns({"tx": F.coalesce("tx", "x"), "ty": F.coalesce("ty", "y")})


def corner(patch: np.ndarray, px: float, py: float, half: int, rounds: int, eps: float, x: float, y: float) -> tuple[float, float]:
    """Least-squares corner of a patch near (px, py), in the coordinates of (x, y)."""
    gy, gx = np.gradient(patch)
    rows, cols = np.mgrid[0 : patch.shape[0], 0 : patch.shape[1]]
    qx, qy = px, py
    for _ in range(rounds):
        near = np.exp(-(((cols - qx) ** 2 + (rows - qy) ** 2) / (half * half)))
        near[(np.abs(cols - qx) > half) | (np.abs(rows - qy) > half)] = 0
        a, b, c = (near * gx * gx).sum(), (near * gx * gy).sum(), (near * gy * gy).sum()
        u = (near * (gx * gx * cols + gx * gy * rows)).sum()
        v = (near * (gx * gy * cols + gy * gy * rows)).sum()
        det = a * c - b * b
        if abs(det) < 1e-12:
            return x, y
        nx, ny = (c * u - b * v) / det, (a * v - b * u) / det
        moved = np.hypot(nx - qx, ny - qy)
        qx, qy = nx, ny
        if abs(qx - px) > half or abs(qy - py) > half:
            return x, y
        if moved < eps:
            break
    return x + float(qx - px), y + float(qy - py)
