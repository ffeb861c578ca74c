"""Evaluation of transforms: projection, residuals, spatial holdout, error summaries, coverage, comparison, stage trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRID = 5
FRACTION = 0.25
#: Steps of a run that a report doesn't show.
HIDDEN_STAGES = ("Spatial Consistency", "Evaluation")


def _w(h: list[Column], x: Column, y: Column) -> Column:
    w = h[6] * x + h[7] * y + h[8]
    return F.when(F.abs(w) < 1e-12, F.lit(1e-12)).otherwise(w)


def projected(h: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """A point under a homography of nine row-major numbers."""
    w = _w(h, x, y)
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def residual(h: list[Column], sx: Column, sy: Column, rx: Column, ry: Column) -> Column:
    px, py = projected(h, sx, sy)
    return F.hypot(px - rx, py - ry)


def product3(a: Column, b: Column) -> Column:
    """Product of two 3x3 matrices as arrays of nine."""
    cell = lambda i, j: a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j]
    return F.array(*[cell(i, j) for i in range(3) for j in range(3)])


def scaling(sx: Column, sy: Column) -> Column:
    zero = F.lit(0.0)
    return F.array(sx, zero, zero, zero, sy, zero, zero, zero, F.lit(1.0))


def original_transform(h: Column, source: tuple[Column, Column], reference: tuple[Column, Column]) -> Column:
    """The transform between original pixels: reference scale, transform of working pixels, inverse of the source scale."""
    return product3(product3(scaling(*reference), h), scaling(1 / source[0], 1 / source[1]))


def spatial_holdout(points: DataFrame, group: list[str], x: str = "rx", y: str = "ry", grid: int = GRID, fraction: float = FRACTION) -> DataFrame:
    """points with `cell` and `holdout`: the last quarter of the occupied cells of a grid over the points' extent.

    Extents and the number of cells are aggregates per group, joined back, so no group is ever sorted in one task.
    """
    ends = points.groupBy(*group).agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    place = lambda v, lo, hi: F.least(F.lit(grid - 1), ((F.col(v) - F.col(lo)) / F.greatest(F.col(hi) - F.col(lo), F.lit(1e-9)) * grid).cast("int"))
    celled = points.join(ends, group).withColumn("cell", place(x, "x0", "x1") + grid * place(y, "y0", "y1")).drop("x0", "x1", "y0", "y1")
    cells = celled.groupBy(*group, "cell").agg(F.count(F.lit(1)).alias("n"))  # at most grid * grid rows a group
    w = Window.partitionBy(*group)
    ranked = cells.withColumn("rank", F.row_number().over(w.orderBy("cell"))).withColumn("cells", F.count(F.lit(1)).over(w))
    held = ranked.withColumn("holdout", F.col("rank") > F.col("cells") - F.greatest(F.lit(1), F.bround(F.col("cells") * fraction, 0)))
    return celled.join(held.select(*group, "cell", "holdout"), [*group, "cell"])


def error_summary(rows: DataFrame, group: list[str], error: str = "error") -> DataFrame:
    """n, rmse, median, p95 and largest error; percentiles are exact and linear between ranks."""
    e = F.col(error)
    return rows.groupBy(*group).agg(
        F.count(e).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.percentile(e, 0.5).alias("median"), F.percentile(e, 0.95).alias("p95"), F.max(e).alias("worst")
    )


def inlier_summary(rows: DataFrame, group: list[str], limit: float) -> DataFrame:
    inside = F.when(F.col("error") <= limit, 1).otherwise(0)
    return rows.groupBy(*group).agg(F.sum(inside).cast("long").alias("inliers"), F.sum(1 - inside).cast("long").alias("outliers"), F.avg(inside).alias("inlier_ratio"))


def grid_histogram(points: DataFrame, group: list[str], row: str = "row", col: str = "col", n: int = 10) -> DataFrame:
    """Points per cell of an n x n grid, empty cells included."""
    counts = points.groupBy(*group, row, col).agg(F.count(F.lit(1)).alias("points"))
    every = points.select(*group).distinct().select(*group, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(row)).select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(col))
    return every.join(counts, [*group, row, col], "left").select(*group, row, col, F.coalesce("points", F.lit(0)).cast("long").alias("points"))


def grid_coverage(histogram: DataFrame, group: list[str], least: float = 0.3) -> DataFrame:
    used = F.col("points") > 0
    out = histogram.groupBy(*group).agg(
        F.sum(F.when(used, 1).otherwise(0)).cast("long").alias("occupied"), F.count(F.lit(1)).alias("cells"),
        F.avg(F.when(used, F.col("points"))).alias("mean_per_cell"), F.max("points").alias("max_per_cell"),
    )
    return out.withColumn("coverage", F.col("occupied") / F.col("cells")).withColumn("warning", F.col("coverage") < least)


def compare_runs(metrics: DataFrame, run: str, names: list[str]) -> DataFrame:
    """Metrics (run, metric, value) side by side, one column per run."""
    return metrics.groupBy("metric").pivot(run, names).agg(F.first("value"))


def visible_stages(stages: DataFrame, hidden: tuple[str, ...] = HIDDEN_STAGES) -> DataFrame:
    """Stages of each pair without the hidden ones, numbered anew; and the time of all stages."""
    total = Window.partitionBy("pair_id")
    timed = stages.withColumn("total_seconds", F.sum("seconds").over(total))
    shown = timed.filter(~F.col("name").isin(*hidden))
    place = F.row_number().over(total.orderBy("ord"))
    return shown.withColumn("stage_id", F.concat(F.when(place < 10, "0").otherwise(""), place.cast("string")))
