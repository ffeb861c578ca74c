"""The whole run over a table of pairs: matches, fusion, selection, holdout, robust fit, coverage, errors, residual field, report.

Every step is a DataFrame keyed by pair_id. A pair that fails a step isn't an error of the batch: it keeps the name of the step
and a message in its report row, and later steps don't see it. Detectors and learned matchers are inputs: keypoints with
descriptors for pairs of one sensor, raw matches with confidences for the others.

pairs: pair_id, source_id, reference_id, s_sensor, r_sensor, s_width, s_height, r_width, r_height (working pixels), s_scale,
r_scale (original pixels per working pixel), gate_passed (null counts as passed: nothing was evaluated).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evaluation as E
from ..operators import fitting as FIT
from ..operators import matching as M
from ..session import settled

#: Representations of a working image in the order of their runs; a point of the half-size run counts twice as far.
RUNS = (("intensity", 1.0), ("structure", 1.0), ("gradient", 1.0), ("half", 2.0))
LEAST_LEARNED = 4
LEAST_FIELD_INLIERS = 20


@dataclass(frozen=True)
class Settings:
    ratio: float = M.RATIO
    confidence: float = 0.35
    grid: int = M.GRID
    cell_limit: int = M.CELL_LIMIT
    model: str = "Homography"
    verifier: str = "MAGSAC++"
    threshold: float = FIT.THRESHOLD


def routed(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("route", X.sensor_route(F.col("s_sensor"), F.col("r_sensor"))).withColumn("gate", F.coalesce("gate_passed", F.lit(True)))


def raw_matches(pairs: DataFrame, keypoints: DataFrame, learned: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """pair_id, method, run_ord, row_ord, sx, sy, rx, ry, score (smaller is better) of all runs of all pairs behind an open gate.

    keypoints: product_id, representation, kp_id, x, y, descriptor; learned: pair_id, row_ord, sx, sy, rx, ry, confidence, s_valid, r_valid.
    """
    open_ = routed(pairs).filter("gate")
    same = open_.filter("route = 'same'").select("pair_id", "source_id", "reference_id")
    runs = []
    for name, factor in RUNS:
        own = keypoints.filter(F.col("representation") == name)
        side = lambda c: same.select("pair_id", F.col(c).alias("product_id")).join(own, "product_id").select("pair_id", "kp_id", "x", "y", "descriptor")  # noqa: B023, E731
        s, r = side("source_id"), side("reference_id")
        found = M.match(s, r, settings.ratio)
        at = found.join(s.select("pair_id", F.col("kp_id").alias("q"), F.col("x").alias("sx"), F.col("y").alias("sy")), ["pair_id", "q"]).join(r.select("pair_id", F.col("kp_id").alias("t"), F.col("x").alias("rx"), F.col("y").alias("ry")), ["pair_id", "t"])
        runs.append((name, M.rescaled(at.select("pair_id", F.col("q").alias("row_ord"), "sx", "sy", "rx", "ry", F.col("ratio").alias("score")), factor, factor)))
    other = learned.join(open_.filter("route = 'different'").select("pair_id"), "pair_id", "left_semi")
    sure = other.filter((F.col("confidence") >= settings.confidence) & F.coalesce(F.col("s_valid"), F.lit(False)) & F.coalesce(F.col("r_valid"), F.lit(False)))
    runs.append(("learned", sure.select("pair_id", "row_ord", "sx", "sy", "rx", "ry", (1.0 - F.col("confidence")).alias("score"))))
    return M.union_runs(*runs).select("pair_id", "method", "run_ord", "row_ord", "sx", "sy", "rx", "ry", "score")


def selected(pairs: DataFrame, matches: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Fused matches that both grids have room for, with s_row and s_col of the source grid; pairs with too few survive nothing."""
    sizes = pairs.select("pair_id", "s_width", "s_height", "r_width", "r_height")
    cell = lambda v, extent: M.grid_cell(F.col(v), F.col(extent), settings.grid)
    fused = M.fuse(matches).join(sizes, "pair_id")
    celled = fused.withColumns({"s_row": cell("sy", "s_height"), "s_col": cell("sx", "s_width")})
    celled = celled.withColumns({"s_cell": F.col("s_row") * settings.grid + F.col("s_col"), "r_cell": cell("ry", "r_height") * settings.grid + cell("rx", "r_width")})
    return M.greedy_cells(celled.drop("s_width", "s_height", "r_width", "r_height"), settings.cell_limit).filter("status = 'OK'").drop("status", "survivors")


def _h(name: str = "h") -> list[Column]:
    return [F.col(name)[k] for k in range(9)]


def correspondences(pairs: DataFrame, points: DataFrame, models: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The correspondence table of the pairs with a model; points: held-out ones marked."""
    scale = pairs.select("pair_id", F.col("s_scale").cast("double").alias("ks"), F.col("r_scale").cast("double").alias("kr"))
    rows = points.join(models.filter("status = 'OK'").select("pair_id", "h"), "pair_id").join(scale, "pair_id")
    error = E.residual(_h(), F.col("sx"), F.col("sy"), F.col("rx"), F.col("ry"))
    whole = E.original_transform(F.col("h"), (F.col("ks"), F.col("ks")), (F.col("kr"), F.col("kr")))
    rows = rows.withColumns({"fit_error_working_px": error, "whole": whole})
    original = E.residual(_h("whole"), F.col("sx") * F.col("ks"), F.col("sy") * F.col("ks"), F.col("rx") * F.col("kr"), F.col("ry") * F.col("kr"))
    return rows.select(
        "pair_id", F.col("sx").alias("source_x_working_px"), F.col("sy").alias("source_y_working_px"), F.col("rx").alias("reference_x_working_px"), F.col("ry").alias("reference_y_working_px"),
        (F.col("sx") * F.col("ks")).alias("source_x_original_px"), (F.col("sy") * F.col("ks")).alias("source_y_original_px"), (F.col("rx") * F.col("kr")).alias("reference_x_original_px"), (F.col("ry") * F.col("kr")).alias("reference_y_original_px"),
        F.col("score").alias("match_score"), F.col("method").alias("representation"), (~F.col("holdout") & (F.col("fit_error_working_px") <= settings.threshold)).alias("training_inlier"), F.col("holdout").alias("holdout_validation"),
        "fit_error_working_px", original.alias("fit_error_original_px"), "row_ord", "run_ord",
    )


def residual_fields(pairs: DataFrame, table: DataFrame, models: DataFrame) -> DataFrame:
    """pair_id, dx, dy: coefficients of the residual field over the reference image, for pairs with enough inliers."""
    inliers = table.filter("training_inlier").join(models.select("pair_id", "h"), "pair_id").join(pairs.select("pair_id", "r_width", "r_height"), "pair_id")
    x, y = F.col("reference_x_working_px"), F.col("reference_y_working_px")
    px, py = E.projected(_h(), F.col("source_x_working_px"), F.col("source_y_working_px"))
    sums = FIT.normal_sums(inliers, ["pair_id"], FIT.design(x, y, F.col("r_width"), F.col("r_height")), {"dx": x - px, "dy": y - py})
    return FIT.solve_field(sums.filter(F.col("n") >= LEAST_FIELD_INLIERS), ["pair_id"], ["dx", "dy"])


def run(pairs: DataFrame, matches: DataFrame, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """correspondences, models, fields, report and stages of all pairs; matches: raw_matches()."""
    pairs = routed(pairs)
    raw = matches.groupBy("pair_id").agg(F.count(F.lit(1)).alias("raw_matches"))
    enough = pairs.join(raw, "pair_id", "left").filter((F.col("route") == "same") | (F.coalesce("raw_matches", F.lit(0)) >= LEAST_LEARNED)).select("pair_id")
    chosen = settled(selected(pairs, matches.join(enough, "pair_id", "left_semi"), settings))
    points = E.spatial_holdout(chosen, ["pair_id"])
    models = settled(FIT.fit_pairs(points.filter("not holdout"), settings.model, settings.threshold, verifier=settings.verifier))
    table = settled(correspondences(pairs, points, models, settings))
    coverage = E.grid_coverage(E.grid_histogram(chosen, ["pair_id"], "s_row", "s_col", settings.grid), ["pair_id"])
    error = F.col("fit_error_working_px")
    inside, held = F.when(F.col("training_inlier"), error), F.when(F.col("holdout_validation"), error)
    figures = table.groupBy("pair_id").agg(
        F.sqrt(F.avg(inside * inside)).alias("fit_rmse"), F.percentile(inside, 0.5).alias("fit_median"), F.percentile(inside, 0.95).alias("fit_p95"),
        F.sqrt(F.avg(held * held)).alias("holdout_rmse"), F.count(F.when(F.col("holdout_validation"), 1)).alias("holdout_points"),
    )
    counts = chosen.groupBy("pair_id").agg(F.count(F.lit(1)).alias("match_count"))
    fields = residual_fields(pairs, table, models)
    joined = pairs.join(raw, "pair_id", "left").join(counts, "pair_id", "left").join(models, "pair_id", "left").join(figures, "pair_id", "left")
    joined = joined.join(coverage.select("pair_id", F.col("coverage").alias("spatial_coverage"), F.col("warning").alias("coverage_warning")), "pair_id", "left").join(fields.select("pair_id", F.col("dx").isNotNull().alias("field")), "pair_id", "left")
    raws, fused = F.coalesce("raw_matches", F.lit(0)), F.coalesce("match_count", F.lit(0))
    failed = (
        F.when(~F.col("gate"), "Geographic Gate").when((F.col("route") == "different") & (raws < LEAST_LEARNED), "Feature Matching")
        .when(fused < M.LEAST_MATCHES, "Confidence Filtering").when(F.coalesce("status", F.lit("FAILED")) != "OK", "Geometric Verification")
    )
    message = (
        F.when(failed == "Geographic Gate", "footprints don't overlap enough").when(failed == "Feature Matching", F.format_string("%d learned matches, %d are needed", raws, F.lit(LEAST_LEARNED)))
        .when(failed == "Confidence Filtering", F.format_string("fewer than %d matches after fusion", F.lit(M.LEAST_MATCHES))).when(failed.isNotNull(), F.format_string("%d robust inliers, %d are needed", F.coalesce("inlier_count", F.lit(0).cast("long")), F.lit(FIT.LEAST_INLIERS)))
    )
    report = joined.select(
        "pair_id", "source_id", "reference_id", "route", F.when(failed.isNull(), "success").otherwise("failed").alias("status"), failed.alias("failed_stage"), message.alias("error_message"),
        raws.alias("raw_matches"), fused.alias("match_count"), "model", "verifier_requested", "verifier", "fallback_used", "inlier_count", "outlier_count", "inlier_ratio",
        "fit_rmse", "fit_median", "fit_p95", "holdout_rmse", "holdout_points", "spatial_coverage", "coverage_warning", F.coalesce("field", F.lit(False)).alias("residual_field"),
    )
    return {"correspondences": table, "models": models, "fields": fields, "report": report, "stages": stages(report)}


#: Steps of a run in order, and the figure of each in the report.
STAGES = (("Geographic Gate", "route"), ("Feature Matching", "raw_matches"), ("Confidence Filtering", "match_count"), ("Geometric Verification", "inlier_count"), ("Spatial Distribution", "spatial_coverage"), ("Evaluation", "fit_rmse"))


def stages(report: DataFrame) -> DataFrame:
    """pair_id, ord, name, status, result_metric, error_message: the steps of each pair up to the one that failed."""
    place = F.coalesce(F.array_position(F.array(*[F.lit(n) for n, _ in STAGES]), F.col("failed_stage")), F.lit(0))
    each = F.array(*[F.struct(F.lit(k + 1).alias("ord"), F.lit(n).alias("name"), F.col(c).cast("string").alias("result_metric")) for k, (n, c) in enumerate(STAGES)])
    rows = report.withColumn("failed_at", place).select("pair_id", "failed_at", "coverage_warning", "error_message", F.explode(each).alias("s")).select("pair_id", "failed_at", "coverage_warning", "error_message", "s.*")
    shown = rows.filter("failed_at = 0 or ord <= failed_at")
    status = F.when(F.col("ord") == F.col("failed_at"), "failed").when((F.col("name") == "Spatial Distribution") & F.coalesce("coverage_warning", F.lit(False)), "warning").otherwise("success")
    return shown.select("pair_id", "ord", "name", status.alias("status"), "result_metric", F.when(F.col("ord") == F.col("failed_at"), F.col("error_message")).alias("error_message"))
