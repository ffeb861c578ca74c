"""Hyperspectral cubes in long form (product_id, band, line, sample, value, valid): cleaning, statistics, normalisation, composites, PCA."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pixels import gradient

NODATA = -9999.0
LOW, HIGH = -1e4, 1e6
PIXEL = ("product_id", "line", "sample")
BAND = ("product_id", "band")


def usable(value: Column, nodata: float = NODATA) -> Column:
    """Finite, within the physical range, and not the no-data value."""
    v = value.cast("double")
    return F.coalesce(~F.isnan(v) & (v > LOW) & (v < HIGH) & (v != nodata), F.lit(False))


def band_stats(cube: DataFrame) -> DataFrame:
    """Per band over valid values: n, p01, p99, median (exact, linear), mean, population deviation."""
    v = F.when(F.col("valid"), F.col("value").cast("double"))
    q = F.percentile(v, F.array(F.lit(0.01), F.lit(0.99), F.lit(0.5)))
    out = cube.groupBy(*BAND).agg(F.count(v).alias("n"), q.alias("q"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    return out.select(*BAND, "n", F.col("q")[0].alias("p01"), F.col("q")[1].alias("p99"), F.col("q")[2].alias("median"), "mean", "std")


def _with_stats(cube: DataFrame) -> DataFrame:
    # one row per band: a few hundred per product
    return cube.join(band_stats(cube), list(BAND))


def pixel_validity(cube: DataFrame) -> DataFrame:
    """Pixels with a usable value in at least half of the bands (rounded down, one at least)."""
    good = F.sum(F.when(F.col("valid"), 1).otherwise(0))
    return cube.groupBy(*PIXEL).agg(good.cast("long").alias("good_bands"), (good >= F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 2))).alias("pixel_valid"))


def clean(cube: DataFrame, nodata: float = NODATA) -> DataFrame:
    """Unusable values replaced by the band's median, with `valid` telling which were usable."""
    marked = cube.withColumn("valid", usable(F.col("value"), nodata))
    filled = _with_stats(marked).withColumn("value", F.when(F.col("valid"), F.col("value")).otherwise(F.coalesce("median", F.lit(0.0))))
    return filled.select(*BAND, "line", "sample", "value", "valid")


def validate(cube: DataFrame) -> DataFrame:
    """Per product: share of valid values, range, constant bands, and status (error below 5 %, warning below 50 %)."""
    per_band = cube.groupBy(*BAND).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("valid"), 1).otherwise(0)).alias("good"), F.min(F.when(F.col("valid"), F.col("value"))).alias("lo"), F.max(F.when(F.col("valid"), F.col("value"))).alias("hi"))
    out = per_band.groupBy("product_id").agg(F.count(F.lit(1)).alias("bands"), (F.sum("good") / F.sum("n") * 100.0).alias("valid_pct"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum(F.when(F.col("hi") <= F.col("lo"), 1).otherwise(0)).cast("long").alias("flat_bands"))
    status = F.when(F.col("valid_pct") < 5.0, "error").when(F.coalesce(F.col("hi") <= F.col("lo"), F.lit(True)), "error").when((F.col("valid_pct") < 50.0) | (F.col("flat_bands") > 0), "warning").otherwise("ok")
    return out.withColumn("status", status)


def normalise(cube: DataFrame, how: str = "percentile") -> DataFrame:
    """Values per band stretched between the 1st and 99th percentile, standardised, or as they are; 0 where not valid."""
    if how == "none":
        return cube.withColumn("value", F.when(F.col("valid"), F.col("value").cast("double")).otherwise(0.0))
    if how not in ("percentile", "standardize"):
        raise ValueError(f"unknown normalisation {how}")
    joined = _with_stats(cube)
    if how == "percentile":
        span = F.col("p99") - F.col("p01")
        value = F.when(span > 1e-7, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("value") - F.col("p01")) / span))).otherwise(0.0)
    else:
        value = F.when(F.col("std") > 1e-7, (F.col("value") - F.col("mean")) / F.col("std")).otherwise(F.col("value") - F.col("mean"))
    return joined.select(*BAND, "line", "sample", F.when(F.col("valid"), value).otherwise(0.0).alias("value"), "valid")


def composite_bands(bands: int) -> list[int]:
    """Band numbers (from 1) at a sixth, a half and five sixths of the range."""
    return sorted({max(1, bands // 6), max(1, bands // 2), min(bands, 5 * bands // 6) or 1})


def composite(cube: DataFrame, bands: list[int]) -> DataFrame:
    """Mean of some stretched bands per pixel, as 0 to 255."""
    chosen = normalise(cube.filter(F.col("band").isin(*bands)))
    return chosen.groupBy(*PIXEL).agg((F.avg("value") * 255).cast("int").alias("value"), F.max("valid").alias("valid"))


#: Products whose sums a task holds at once.
MOST_HELD = 64


def _merged(a: tuple, b: tuple) -> tuple:
    """Count, mean and centred products of two sets of vectors together."""
    (n, mean, m2), (k, other, o2) = a, b
    if not n or not k:
        return a if n else b
    d = other - mean
    return n + k, mean + d * (k / (n + k)), m2 + o2 + np.outer(d, d) * (n * k / (n + k))


def moments(pixels: DataFrame, vector: str, group: str = "product_id") -> DataFrame:
    """group, n, mean array<double>, products array<double> (size x size, centred, row by row) of a vector column, per group.

    Tasks add up their own matrices, which are then merged, so one pass reads the vectors and no task holds them. Vectors
    that are null or have another length than the group's first are left out.
    """
    kind = dict(pixels.dtypes)[group]
    schema = f"{group} {kind}, n long, mean array<double>, products array<double>"

    def rows(held: dict) -> pa.RecordBatch:
        names, sums = list(held), list(held.values())
        columns = [pa.array(names, key_type[0]), pa.array([x[0] for x in sums], pa.int64()), pa.array([x[1].tolist() for x in sums], pa.list_(pa.float64())), pa.array([x[2].ravel().tolist() for x in sums], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, names=[group, "n", "mean", "products"])

    key_type: list = [None]

    def partial(batches):  # noqa: ANN001, ANN202
        held: dict = {}
        for b in batches:
            key_type[0] = b.column(0).type
            keys, column = b.column(0).to_pylist(), b.column(1)
            sizes = np.array([-1 if v is None else v for v in pc.list_value_length(column).to_pylist()])
            for key in dict.fromkeys(keys):
                own = np.array([k == key for k in keys]) & (sizes > 0)
                size = len(held[key][1]) if key in held else int(sizes[own][0]) if own.any() else 0
                x = column.filter(pa.array(own & (sizes == size))).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size) if size else np.empty((0, 0))
                if not len(x):
                    continue
                mean = x.mean(axis=0)
                y = x - mean
                new = (len(x), mean, y.T @ y)
                held[key] = _merged(held[key], new) if key in held else new
            if len(held) > MOST_HELD:
                yield rows(held)
                held = {}
        if held:
            yield rows(held)

    def merge(t: pa.Table) -> pa.Table:
        out = (0, None, None)
        for n, mean, products in zip(*(t.column(c).to_pylist() for c in ("n", "mean", "products")), strict=True):
            m = np.array(mean)
            if out[1] is None or len(out[1]) == len(m):
                out = _merged(out, (n, m, np.array(products).reshape(len(m), len(m))))
        return pa.table({group: t.column(group).slice(0, 1), "n": pa.array([out[0]], pa.int64()), "mean": pa.array([out[1].tolist()], pa.list_(pa.float64())), "products": pa.array([out[2].ravel().tolist()], pa.list_(pa.float64()))})

    return pixels.select(group, vector).mapInArrow(partial, schema).groupBy(group).applyInArrow(merge, schema)


def covariance(pixels: DataFrame, vector: str, group: str = "product_id") -> DataFrame:
    """group, i, j, cov (ddof 1, i <= j) of a vector column."""
    size = F.size("mean")
    cells = F.explode(F.sequence(F.lit(0), size * size - 1))
    sums = moments(pixels, vector, group).filter("n > 1").select(group, "n", "products", size.alias("size"), cells.alias("at"))
    i, j = F.floor(F.col("at") / F.col("size")).cast("int"), (F.col("at") % F.col("size")).cast("int")
    return sums.filter(i <= j).select(group, i.alias("i"), j.alias("j"), (F.element_at("products", F.col("at") + 1) / (F.col("n") - 1)).alias("cov"))


def principal_components(pixels: DataFrame, vector: str, keep: int = 3, group: str = "product_id") -> DataFrame:
    """group, mean, loadings (array of `keep` arrays), share (of the variance, of each) per group.

    Signs are fixed by the largest loading of each component being positive. Groups of fewer than two vectors have no row.
    """
    kind = dict(pixels.dtypes)[group]
    schema = f"{group} {kind}, mean array<double>, loadings array<array<double>>, share array<double>"

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            means, loadings, shares, keys = [], [], [], []
            for key, n, mean, products in zip(b.column(0), *(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                size = len(mean)
                values, vectors = np.linalg.eigh(np.array(products).reshape(size, size) / max(n - 1, 1))
                order = np.argsort(values)[::-1][:keep]
                out = vectors[:, order].T
                out = out * np.where(out[np.arange(len(out)), np.abs(out).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
                total = values.sum()
                keys.append(key.as_py())
                means.append(mean)
                loadings.append(out.tolist())
                shares.append((values[order] / total).tolist() if total > 0 else [1.0 / size] * len(order))
            doubles = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.column(0).type), pa.array(means, doubles), pa.array(loadings, pa.list_(doubles)), pa.array(shares, doubles)], names=[group, "mean", "loadings", "share"])

    return moments(pixels, vector, group).filter("n > 1").mapInArrow(run, schema)


def project_components(pixels: DataFrame, vector: str, components: DataFrame, keep: int = 3, group: str = "product_id") -> DataFrame:
    """pixels with pc1, pc2, ...; components: one row per group. Groups without components get null."""
    held = components.select(F.col(group), F.col("mean").alias("_mean"), F.col("loadings").alias("_loadings"))
    out = pixels.join(held, group, "left")
    centred = F.zip_with(F.col(vector), F.col("_mean"), lambda a, m: a.cast("double") - m)
    for k in range(keep):
        score = F.aggregate(F.zip_with(centred, F.try_element_at("_loadings", F.lit(k + 1)), lambda a, w: a * w), F.lit(0.0), lambda s, v: s + v)
        out = out.withColumn(f"pc{k + 1}", score)
    return out.drop("_mean", "_loadings")


def representation(cube: DataFrame, bands: int, mode: str = "automatic", band: int = 1, component: int = 1, chosen: list[int] | None = None) -> DataFrame:
    """A 2-D picture (product_id, line, sample, value, valid) of a cube whose bands count from 1; values are 0 to 255, 0 where not valid.

    automatic: the first principal component of the product, its one band if there is only one; pca: component 1 to 3;
    selected_band; composite: the mean of stretched bands; gradient: Sobel magnitude of the automatic picture; any other
    mode: the selected band, clipped to 0 to 255.
    """
    mode = mode.lower().strip()
    band = min(max(band, 1), bands)
    if mode in ("automatic", "pca"):
        mode = "pca" if bands > 1 else "selected_band"
    if mode == "composite":
        return composite(cube, chosen or composite_bands(bands))
    if mode == "selected_band":
        return _picture(normalise(cube.filter(F.col("band") == band)))
    if mode == "gradient":
        base = representation(cube, bands, "automatic")
        edges = gradient(base).select(*PIXEL, F.col("value").alias("edge"))
        joined = base.join(edges, list(PIXEL), "left")
        return joined.select(*PIXEL, F.when(F.col("valid"), F.coalesce("edge", F.lit(0))).otherwise(0).cast("int").alias("value"), "valid")
    if mode != "pca":
        value = F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col("value").cast("double"))).cast("int")
        return cube.filter(F.col("band") == band).select(*PIXEL, F.when(F.col("valid"), value).otherwise(0).alias("value"), "valid")
    keep = min(3, bands)
    component = min(max(component, 1), keep)
    vectors = cube.groupBy(*PIXEL).agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "value"))), lambda x: x["value"]).alias("spectrum"), F.max("valid").alias("valid"))
    found = principal_components(vectors.filter("valid"), "spectrum", keep)
    scored = project_components(vectors, "spectrum", found, keep).select("product_id", F.lit(0).alias("band"), "line", "sample", F.col(f"pc{component}").alias("value"), "valid")
    return _picture(normalise(scored))


def _picture(stretched: DataFrame) -> DataFrame:
    return stretched.select(*PIXEL, (F.col("value") * 255).cast("int").alias("value"), "valid")
