"""All queries over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import raster_spec as R
from ..functions import report as T
from ..functions import states as S
from ..functions import text as X
from ..operators import evaluation as E
from ..operators import fitting as FIT
from ..operators import matching as M
from ..operators import overlap as O
from ..operators import pixels as P
from ..operators import spectral as H
from ..sources import catalog as C
from ..sources import labels as L
from ..sources import store as K
from . import correspond, roles

FLAGSHIP = "match_knn2_ratio_mutual"
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


# ---- matching ----

_NEAR = """
WITH s AS (SELECT vec_id AS k, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 2 = 0), t AS (SELECT vec_id AS k, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 2 = 1),
d AS (SELECT s.k AS q, t.k AS t, list_distance(s.e, t.e) AS d FROM s, t),
f AS (SELECT q, t AS t1, d AS d1, lead(d) OVER w AS d2, row_number() OVER w AS rn FROM d WINDOW w AS (PARTITION BY q ORDER BY d, t)),
b AS (SELECT t AS q, q AS t1, d AS d1, lead(d) OVER w AS d2, row_number() OVER w AS rn FROM d WINDOW w AS (PARTITION BY t ORDER BY d, q))
"""


@query(_NEAR + "SELECT f.q AS q, f.t1 AS t, round(f.d1, 6) AS distance, round(f.d1 / greatest(f.d2, 1e-12), 6) AS ratio FROM f JOIN b ON b.q = f.t1 AND b.t1 = f.q WHERE f.rn = 1 AND b.rn = 1 AND f.d1 / greatest(f.d2, 1e-12) < 0.95 AND b.d1 / greatest(b.d2, 1e-12) < 0.95")
def match_knn2_ratio_mutual(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.match(roles.keypoints(spark, sf_dir, 0), roles.keypoints(spark, sf_dir, 1), 0.95)
    return found.select("q", "t", F.round("d1", 6).alias("distance"), F.round("ratio", 6).alias("ratio"))


@query(_NEAR + "SELECT q, t1 AS t, round(d1, 6) AS d1, round(d2, 6) AS d2 FROM f WHERE rn = 1")
def match_two_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.two_nearest(roles.keypoints(spark, sf_dir, 0), roles.keypoints(spark, sf_dir, 1)).select("q", F.col("t1").alias("t"), F.round("d1", 6).alias("d1"), F.round("d2", 6).alias("d2"))


@query(f"""WITH {roles.MATCHES}, r AS (SELECT *, row_number() OVER (PARTITION BY pair_id, sx, round(sy, 1), rx, round(ry, 1) ORDER BY score, run_ord, row_ord) AS rn FROM matches)
SELECT pair_id, row_ord, method, round(score, 2) AS score FROM r WHERE rn = 1""")
def match_dedupe_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.fuse(roles.matches(spark, sf_dir)).select("pair_id", "row_ord", "method", F.round("score", 2).alias("score"))


@query(f"WITH {roles.MATCHES} SELECT pair_id, method, count(*) AS n, round(min(score), 2) AS best FROM matches GROUP BY ALL")
def match_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = roles.matches(spark, sf_dir)
    runs = [(name, m.filter(F.col("method") == name).drop("method", "run_ord")) for name in ("A", "N", "R")]
    return M.union_runs(*runs).groupBy("pair_id", "method").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("score"), 2).alias("best"))


_CELL = "greatest(0, least(9, CAST(trunc({v} * 10 / greatest({w}, 1)) AS INTEGER)))"
_EVENTS = f"""pts AS (SELECT event_id, event_type, {_CELL.format(v='(epoch(ts) % 86400)', w='86400.0')} AS col, {_CELL.format(v='value', w='100.0')} AS row, value FROM events)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = roles.table(spark, sf_dir, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 % 86400
    return e.select("event_id", "event_type", "value", M.grid_cell(seconds, F.lit(86400.0)).alias("col"), M.grid_cell(F.col("value"), F.lit(100.0)).alias("row"))


_HISTOGRAM = f"""WITH {_EVENTS}, c AS (SELECT event_type, row, col, count(*) AS points FROM pts GROUP BY ALL),
every AS (SELECT event_type, r.i AS row, k.i AS col FROM (SELECT DISTINCT event_type FROM pts), range(10) AS r(i), range(10) AS k(i)),
hist AS (SELECT every.event_type AS event_type, CAST(every.row AS INTEGER) AS row, CAST(every.col AS INTEGER) AS col, CAST(coalesce(points, 0) AS BIGINT) AS points FROM every LEFT JOIN c ON c.event_type = every.event_type AND c.row = every.row AND c.col = every.col)
"""


@query(_HISTOGRAM + "SELECT * FROM hist")
def grid_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.grid_histogram(_events(spark, sf_dir), ["event_type"])


@query(_HISTOGRAM + """SELECT event_type, CAST(count(*) FILTER (WHERE points > 0) AS BIGINT) AS occupied, count(*) AS cells, round(avg(points) FILTER (WHERE points > 0), 6) AS mean_per_cell, max(points) AS max_per_cell,
 round(count(*) FILTER (WHERE points > 0) / count(*), 6) AS coverage, count(*) FILTER (WHERE points > 0) / count(*) < 0.3 AS warning FROM hist GROUP BY event_type""")
def grid_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.grid_coverage(E.grid_histogram(_events(spark, sf_dir), ["event_type"]), ["event_type"]), 6, "mean_per_cell", "coverage")


@query(f"WITH {_EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY value, event_id) AS rn FROM pts) SELECT event_id, row, col, rn FROM r WHERE rn <= 20")
def cell_cap_single_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cap_cells(_events(spark, sf_dir), ["row", "col"], [F.col("value"), F.col("event_id")]).select("event_id", "row", "col", F.col("rn").cast("long").alias("rn"))


def _two_way_cell(x: str, w: str, y: str, h: str) -> str:
    return f"({_CELL.format(v=x, w=w)} * 10 + {_CELL.format(v=y, w=h)})"


@query(f"""WITH RECURSIVE {roles.MATCHES}, m AS (SELECT pair_id, row_ord, score, {_two_way_cell('sx', '51.0', 'sy', '11.0')} AS s_cell, {_two_way_cell('rx', '8.0', 'ry', '9.0')} AS r_cell, row_number() OVER (PARTITION BY pair_id ORDER BY score, row_ord) AS rn FROM matches),
walk AS (SELECT pair_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS row_ord, false AS kept, list_transform(range(100), lambda x: 0) AS s, list_transform(range(100), lambda x: 0) AS r FROM (SELECT DISTINCT pair_id FROM m)
 UNION ALL SELECT w.pair_id, m.rn, m.row_ord, w.s[m.s_cell + 1] < 3 AND w.r[m.r_cell + 1] < 3,
  CASE WHEN w.s[m.s_cell + 1] < 3 AND w.r[m.r_cell + 1] < 3 THEN list_transform(w.s, lambda v, i: v + CASE WHEN i = m.s_cell + 1 THEN 1 ELSE 0 END) ELSE w.s END,
  CASE WHEN w.s[m.s_cell + 1] < 3 AND w.r[m.r_cell + 1] < 3 THEN list_transform(w.r, lambda v, i: v + CASE WHEN i = m.r_cell + 1 THEN 1 ELSE 0 END) ELSE w.r END
 FROM walk w JOIN m ON m.pair_id = w.pair_id AND m.rn = w.rn + 1),
k AS (SELECT pair_id, rn FROM walk WHERE kept), c AS (SELECT pair_id, count(*) AS survivors FROM k GROUP BY pair_id)
SELECT m.pair_id AS pair_id, m.row_ord AS row_ord, round(score, 2) AS score, CAST(s_cell AS INTEGER) AS s_cell, CAST(r_cell AS INTEGER) AS r_cell, survivors, CASE WHEN survivors >= 8 THEN 'OK' ELSE 'FAILED' END AS status
FROM m JOIN k ON k.pair_id = m.pair_id AND k.rn = m.rn JOIN c ON c.pair_id = m.pair_id""")
def cell_cap_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = roles.matches(spark, sf_dir)
    cell = lambda x, w, y, h: M.grid_cell(F.col(x), F.lit(w)) * 10 + M.grid_cell(F.col(y), F.lit(h))
    celled = m.select("pair_id", "row_ord", "score", cell("sx", 51.0, "sy", 11.0).alias("s_cell"), cell("rx", 8.0, "ry", 9.0).alias("r_cell"))
    return rounded(M.greedy_cells(celled, 3), 2, "score")


# ---- evaluation ----


@query(f"""WITH {roles.POINTS}, e AS (SELECT pair_id, min(rx) AS x0, max(rx) AS x1, min(ry) AS y0, max(ry) AS y1 FROM points GROUP BY pair_id),
c AS (SELECT p.pair_id AS pair_id, id, least(4, CAST(trunc((rx - x0) / greatest(x1 - x0, 1e-9) * 5) AS INTEGER)) + 5 * least(4, CAST(trunc((ry - y0) / greatest(y1 - y0, 1e-9) * 5) AS INTEGER)) AS cell FROM points p JOIN e ON e.pair_id = p.pair_id),
k AS (SELECT pair_id, cell, row_number() OVER (PARTITION BY pair_id ORDER BY cell) AS rk, count(*) OVER (PARTITION BY pair_id) AS n FROM (SELECT DISTINCT pair_id, cell FROM c))
SELECT c.pair_id AS pair_id, id, CAST(c.cell AS INTEGER) AS cell, rk > n - greatest(1, round_even(n * 0.25, 0)) AS holdout FROM c JOIN k ON k.pair_id = c.pair_id AND k.cell = c.cell""")
def spatial_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.spatial_holdout(roles.points(spark, sf_dir), ["pair_id"]).select("pair_id", "id", "cell", "holdout")


def _projected_sql() -> str:
    h = roles.H
    return f"""WITH {roles.POINTS}, w AS (SELECT *, CASE WHEN abs({h[6]} * sx + {h[7]} * sy + {h[8]}) < 1e-12 THEN 1e-12 ELSE {h[6]} * sx + {h[7]} * sy + {h[8]} END AS w FROM points),
r AS (SELECT pair_id, id, sqrt(((({h[0]} * sx + {h[1]} * sy + {h[2]}) / w - rx)) ** 2 + ((({h[3]} * sx + {h[4]} * sy + {h[5]}) / w - ry)) ** 2) AS error FROM w)
"""


def _residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = [F.lit(v) for v in roles.H]
    return roles.points(spark, sf_dir).select("pair_id", "id", E.residual(h, F.col("sx"), F.col("sy"), F.col("rx"), F.col("ry")).alias("error"))


@query(_projected_sql() + "SELECT pair_id, id, round(error, 6) AS error FROM r")
def homography_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_residuals(spark, sf_dir), 6, "error")


@query(_projected_sql() + "SELECT pair_id, count(*) AS n, round(sqrt(avg(error * error)), 6) AS rmse, round(quantile_cont(error, 0.5), 6) AS median, round(quantile_cont(error, 0.95), 6) AS p95, round(max(error), 6) AS worst FROM r GROUP BY pair_id")
def rmse_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.error_summary(_residuals(spark, sf_dir), ["pair_id"]), 6, "rmse", "median", "p95", "worst")


@query(_projected_sql() + "SELECT pair_id, count(*) FILTER (WHERE error <= 0.75) AS inliers, count(*) FILTER (WHERE error > 0.75) AS outliers, round(count(*) FILTER (WHERE error <= 0.75) / count(*), 6) AS inlier_ratio FROM r GROUP BY pair_id")
def inlier_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.inlier_summary(_residuals(spark, sf_dir), ["pair_id"], 0.75), 6, "inlier_ratio")


_TERMS = ("CAST(1 AS DOUBLE)", "u", "v", "u * u", "u * v", "v * v")


@query(f"WITH {roles.POINTS}, t AS (SELECT *, sx / 64.0 AS u, sy / 128.0 AS v, rx - sx AS dx, ry - sy AS dy FROM points) SELECT pair_id, count(*) AS n, "
       + ", ".join(f"round(sum(({_TERMS[i]}) * ({_TERMS[j]})), 4) AS m_{i}_{j}" for i in range(6) for j in range(i, 6)) + ", " + ", ".join(f"round(sum(({_TERMS[i]}) * {t}), 4) AS {t}_{i}" for t in ("dx", "dy") for i in range(6)) + " FROM t GROUP BY pair_id")
def residual_normal_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _field_sums(spark, sf_dir)
    return rounded(sums, 4, *[c for c in sums.columns if c not in ("pair_id", "n")])


def _field_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = roles.points(spark, sf_dir)
    terms = FIT.design(F.col("sx"), F.col("sy"), F.lit(64.0), F.lit(128.0))
    return FIT.normal_sums(p, ["pair_id"], terms, {"dx": F.col("rx") - F.col("sx"), "dy": F.col("ry") - F.col("sy")})


def _solved_sql() -> str:
    """Elimination without pivots (the sums are positive definite): step k takes row k off all others."""
    names = {"m": [(i, j) for i in range(6) for j in range(6)], "dx": [(i,) for i in range(6)], "dy": [(i,) for i in range(6)]}
    call = lambda t, at: t + "_" + "_".join(map(str, at))
    cells = [(t, at) for t, places in names.items() for at in places]
    ridge = lambda i, j: " + 0.05" if i == j > 2 else ""
    first = ", ".join((f"sum(({_TERMS[at[0]]}) * ({_TERMS[at[1]]})){ridge(*at)}" if t == "m" else f"sum(({_TERMS[at[0]]}) * {t})") + f" AS {call(t, at)}" for t, at in cells)
    out = f"WITH {roles.POINTS}, t AS (SELECT *, sx / 64.0 AS u, sy / 128.0 AS v, rx - sx AS dx, ry - sy AS dy FROM points), e0 AS (SELECT pair_id, count(*) AS n, {first} FROM t GROUP BY pair_id)"
    for k in range(6):
        rows = [call(t, at) if at[0] == k else f"{call(t, at)} - m_{at[0]}_{k} / m_{k}_{k} * {call(t, (k, *at[1:]))}" for t, at in cells]
        out += f", e{k + 1} AS (SELECT pair_id, n, " + ", ".join(f"{r} AS {call(t, at)}" for r, (t, at) in zip(rows, cells, strict=True)) + f" FROM e{k})"
    return out + " SELECT pair_id, " + ", ".join(f"round(CASE WHEN n >= 12 THEN {t}_{i} / m_{i}_{i} END, 5) AS {t}_{i}" for t in ("dx", "dy") for i in range(6)) + " FROM e6"


@query(_solved_sql())
def residual_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    solved = FIT.solve_field(_field_sums(spark, sf_dir), ["pair_id"], ["dx", "dy"])
    return solved.select("pair_id", *[F.round(F.col(t)[i], 5).alias(f"{t}_{i}") for t in ("dx", "dy") for i in range(6)])


@query()
def robust_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FIT.fit_pairs(roles.points(spark, sf_dir), threshold=0.75)


@query(_projected_sql() + ", m AS (SELECT pair_id % 2 AS run, count(*) AS n, sqrt(avg(error * error)) AS rmse, max(error) AS worst FROM r GROUP BY 1) "
       "SELECT metric, round(max(v) FILTER (WHERE run = 0), 6) AS baseline, round(max(v) FILTER (WHERE run = 1), 6) AS other FROM (SELECT run, 'n' AS metric, CAST(n AS DOUBLE) AS v FROM m UNION ALL SELECT run, 'rmse', rmse FROM m UNION ALL SELECT run, 'worst', worst FROM m) GROUP BY metric")
def verifier_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _residuals(spark, sf_dir).withColumn("run", F.when(F.col("pair_id") % 2 == 0, "baseline").otherwise("other"))
    s = E.error_summary(r, ["run"])
    long = s.select("run", F.explode(F.map_from_arrays(F.array(F.lit("n"), F.lit("rmse"), F.lit("worst")), F.array(F.col("n").cast("double"), "rmse", "worst"))).alias("metric", "value"))
    return rounded(E.compare_runs(long, "run", ["baseline", "other"]), 6, "baseline", "other")


@query("""WITH s AS (SELECT user_id % 50 AS pair_id, event_id AS ord, CASE event_type WHEN 'view' THEN 'Evaluation' WHEN 'click' THEN 'Matching' ELSE event_type END AS name, value AS seconds FROM events),
t AS (SELECT *, sum(seconds) OVER (PARTITION BY pair_id) AS total FROM s)
SELECT pair_id, CASE WHEN rn < 10 THEN '0' || rn ELSE CAST(rn AS VARCHAR) END AS stage_id, ord, name, round(total, 4) AS total_seconds FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY ord) AS rn FROM t WHERE name NOT IN ('Spatial Consistency', 'Evaluation'))""")
def stage_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = roles.table(spark, sf_dir, "events")
    name = F.when(F.col("event_type") == "view", "Evaluation").when(F.col("event_type") == "click", "Matching").otherwise(F.col("event_type"))
    stages = e.select((F.col("user_id") % 50).alias("pair_id"), F.col("event_id").alias("ord"), name.alias("name"), F.col("value").alias("seconds"))
    return E.visible_stages(stages).select("pair_id", "stage_id", "ord", "name", F.round("total_seconds", 4).alias("total_seconds"))


def _run(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Line items as raw matches under a known affine map, one in five far off; a pair per 100 orders, some behind a closed gate or with few matches."""
    line = roles.table(spark, sf_dir, "lineitem")
    pair = F.floor(F.col("l_orderkey") / 100).cast("long")
    sx, sy = (F.col("l_partkey") * 7 % 1000).cast("double"), ((F.col("l_suppkey") * 13 + F.col("l_linenumber") * 50 + F.col("l_orderkey") * 3) % 800).cast("double")
    off = F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 5 == 0, 90.0 + F.col("l_orderkey") % 50).otherwise(0.0)
    m = line.select(pair.alias("pair_id"), F.lit("intensity").alias("method"), F.lit(0).alias("run_ord"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("row_ord"), sx.alias("sx"), sy.alias("sy"), off.alias("off"), F.col("l_extendedprice").cast("double").alias("score"))
    m = m.filter("pair_id % 7 <> 3 or row_ord % 1000 < 20").withColumns({"rx": 1.0 * F.col("sx") - 0.0625 * F.col("sy") + 60 + F.col("off"), "ry": 0.03125 * F.col("sx") + 0.9375 * F.col("sy") + 10 - F.col("off")}).drop("off")
    pairs = m.select("pair_id").distinct().select(
        "pair_id", (F.col("pair_id") * 2).alias("source_id"), (F.col("pair_id") * 2 + 1).alias("reference_id"), F.lit("OHRC").alias("s_sensor"), F.when(F.col("pair_id") % 2 == 0, "OHRC").otherwise("TMC").alias("r_sensor"),
        F.lit(1000).alias("s_width"), F.lit(800).alias("s_height"), F.lit(1100).alias("r_width"), F.lit(850).alias("r_height"), F.lit(2.0).alias("s_scale"), F.lit(4.0).alias("r_scale"), F.when(F.col("pair_id") % 11 == 0, F.col("pair_id") % 22 == 0).alias("gate_passed"),
    )
    gated = pairs.filter("coalesce(gate_passed, true)").select("pair_id")
    return correspond.run(pairs, m.join(gated, "pair_id", "left_semi"), correspond.Settings(model="Affine"))


_RUN = f"""WITH RECURSIVE line AS (SELECT CAST(floor(l_orderkey / 100.0) AS BIGINT) AS pair_id, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS row_ord, CAST(l_partkey * 7 % 1000 AS DOUBLE) AS sx, CAST((l_suppkey * 13 + l_linenumber * 50 + l_orderkey * 3) % 800 AS DOUBLE) AS sy,
 CASE WHEN (l_orderkey + l_linenumber) % 5 = 0 THEN 90.0::DOUBLE + l_orderkey % 50 ELSE 0.0::DOUBLE END AS off, CAST(l_extendedprice AS DOUBLE) AS score FROM lineitem),
few AS (SELECT *, sx - 0.0625::DOUBLE * sy + 60 + off AS rx, 0.03125::DOUBLE * sx + 0.9375::DOUBLE * sy + 10 - off AS ry FROM line WHERE pair_id % 7 <> 3 OR row_ord % 1000 < 20),
pairs AS (SELECT DISTINCT pair_id, pair_id % 11 <> 0 OR pair_id % 22 = 0 AS gate FROM few), raw AS (SELECT s.* FROM few s JOIN pairs p ON p.pair_id = s.pair_id WHERE gate),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, round_even(sx, 1), round_even(sy, 1), round_even(rx, 1), round_even(ry, 1) ORDER BY score, row_ord) AS first FROM raw) WHERE first = 1),
m AS (SELECT pair_id, row_ord, sx, sy, rx, ry, {_two_way_cell('sy', '800.0', 'sx', '1000.0')} AS s_cell, {_two_way_cell('ry', '850.0', 'rx', '1100.0')} AS r_cell, off, row_number() OVER (PARTITION BY pair_id ORDER BY score, row_ord) AS rn FROM f),
walk AS (SELECT pair_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS row_ord, false AS kept, list_transform(range(100), lambda x: 0) AS s, list_transform(range(100), lambda x: 0) AS r FROM (SELECT DISTINCT pair_id FROM m)
 UNION ALL SELECT w.pair_id, m.rn, m.row_ord, w.s[m.s_cell + 1] < 20 AND w.r[m.r_cell + 1] < 20,
  CASE WHEN w.s[m.s_cell + 1] < 20 AND w.r[m.r_cell + 1] < 20 THEN list_transform(w.s, lambda v, i: v + CASE WHEN i = m.s_cell + 1 THEN 1 ELSE 0 END) ELSE w.s END,
  CASE WHEN w.s[m.s_cell + 1] < 20 AND w.r[m.r_cell + 1] < 20 THEN list_transform(w.r, lambda v, i: v + CASE WHEN i = m.r_cell + 1 THEN 1 ELSE 0 END) ELSE w.r END
 FROM walk w JOIN m ON m.pair_id = w.pair_id AND m.rn = w.rn + 1),
k AS (SELECT m.*, count(*) OVER (PARTITION BY m.pair_id) AS match_count FROM m JOIN walk w ON w.pair_id = m.pair_id AND w.rn = m.rn AND kept),
e AS (SELECT pair_id, min(rx) AS x0, max(rx) AS x1, min(ry) AS y0, max(ry) AS y1 FROM k WHERE match_count >= 8 GROUP BY pair_id),
c AS (SELECT k.*, least(4, CAST(trunc((rx - x0) / greatest(x1 - x0, 1e-9) * 5) AS INTEGER)) + 5 * least(4, CAST(trunc((ry - y0) / greatest(y1 - y0, 1e-9) * 5) AS INTEGER)) AS cell FROM k JOIN e ON e.pair_id = k.pair_id),
g AS (SELECT pair_id, cell, row_number() OVER (PARTITION BY pair_id ORDER BY cell) AS rk, count(*) OVER (PARTITION BY pair_id) AS n FROM (SELECT DISTINCT pair_id, cell FROM c)),
h AS (SELECT c.*, rk > n - greatest(1, round_even(n * 0.25, 0)) AS holdout FROM c JOIN g ON g.pair_id = c.pair_id AND g.cell = c.cell),
t AS (SELECT pair_id, max(match_count) AS match_count, count(*) FILTER (WHERE NOT holdout AND off = 0) AS inliers, count(*) FILTER (WHERE NOT holdout AND off > 0) AS outliers, count(*) FILTER (WHERE holdout) AS held,
  sqrt(avg(2 * off * off) FILTER (WHERE holdout)) AS holdout_rmse, count(DISTINCT s_cell) / 100.0 AS coverage FROM h GROUP BY pair_id),
a AS (SELECT p.pair_id, p.gate, (SELECT count(*) FROM raw WHERE raw.pair_id = p.pair_id) AS raw_matches, (SELECT count(*) FROM k WHERE k.pair_id = p.pair_id) AS fused, t.* EXCLUDE (pair_id) FROM pairs p LEFT JOIN t ON t.pair_id = p.pair_id)
"""


@query(_RUN + """SELECT pair_id, pair_id * 2 AS source_id, CASE WHEN pair_id % 2 = 0 THEN 'same' ELSE 'different' END AS route, CASE WHEN gate AND (pair_id % 2 = 0 OR raw_matches >= 4) AND coalesce(match_count, 0) >= 8 AND coalesce(inliers, 0) >= 8 THEN 'success' ELSE 'failed' END AS status,
 CASE WHEN NOT gate THEN 'Geographic Gate' WHEN pair_id % 2 = 1 AND raw_matches < 4 THEN 'Feature Matching' WHEN coalesce(match_count, 0) < 8 THEN 'Confidence Filtering' WHEN inliers < 8 THEN 'Geometric Verification' END AS failed_stage,
 raw_matches, CAST(coalesce(match_count, 0) AS BIGINT) AS match_count, CASE WHEN inliers >= 8 THEN inliers END AS inlier_count, CASE WHEN inliers >= 8 THEN outliers END AS outlier_count, CASE WHEN inliers >= 8 THEN held END AS holdout_points,
 CASE WHEN inliers >= 8 THEN 0.0::DOUBLE END AS fit_rmse, CASE WHEN inliers >= 8 THEN round(holdout_rmse, 3) END AS holdout_rmse, round(coverage, 4) AS spatial_coverage, coalesce(inliers >= 20, false) AS residual_field FROM a""")
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = _run(spark, sf_dir)["report"]
    fitted = lambda c: F.when(F.col("inlier_count") >= 8, F.col(c)).alias(c)
    return report.select(
        "pair_id", "source_id", "route", "status", "failed_stage", "raw_matches", F.col("match_count").cast("long").alias("match_count"), fitted("inlier_count"), fitted("outlier_count"), fitted("holdout_points"),
        F.abs(F.round("fit_rmse", 3)).alias("fit_rmse"), F.round("holdout_rmse", 3).alias("holdout_rmse"), F.round("spatial_coverage", 4).alias("spatial_coverage"), "residual_field",
    )


@query()
def run_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir)["stages"]


# ---- spectral ----

_STATS = "s AS (SELECT product_id, band, count(value) FILTER (WHERE valid) AS n, quantile_cont(value, 0.01) FILTER (WHERE valid) AS p01, quantile_cont(value, 0.99) FILTER (WHERE valid) AS p99, median(value) FILTER (WHERE valid) AS median, avg(value) FILTER (WHERE valid) AS mean, stddev_pop(value) FILTER (WHERE valid) AS std FROM cube GROUP BY ALL)"


def _cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.cube(spark, sf_dir).withColumn("valid", H.usable(F.col("value")))


@query(f"WITH {roles.CUBE}, {_STATS} SELECT product_id, band, n, round(p01, 4) AS p01, round(p99, 4) AS p99, round(median, 4) AS median, round(mean, 4) AS mean, round(std, 4) AS std FROM s")
def band_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.band_stats(_cube(spark, sf_dir)), 4, "p01", "p99", "median", "mean", "std")


@query(f"WITH {roles.CUBE}, {_STATS} SELECT c.product_id AS product_id, c.band AS band, line, sample, round(CASE WHEN NOT valid THEN 0.0 WHEN p99 - p01 > 1e-7 THEN greatest(0.0, least(1.0, (value - p01) / (p99 - p01))) ELSE 0.0 END, 6) AS value FROM cube c JOIN s ON s.product_id = c.product_id AND s.band = c.band")
def band_percentile_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.normalise(_cube(spark, sf_dir)).drop("valid"), 6, "value")


@query(f"WITH {roles.CUBE}, {_STATS} SELECT c.product_id AS product_id, c.band AS band, line, sample, round(CASE WHEN NOT valid THEN 0.0 WHEN std > 1e-7 THEN (value - mean) / std ELSE value - mean END, 6) AS value FROM cube c JOIN s ON s.product_id = c.product_id AND s.band = c.band")
def band_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.normalise(_cube(spark, sf_dir), "standardize").drop("valid"), 6, "value")


@query(f"WITH {roles.CUBE} SELECT product_id, line, sample, count(*) FILTER (WHERE valid) AS good_bands, count(*) FILTER (WHERE valid) >= greatest(1, count(*) // 2) AS pixel_valid FROM cube GROUP BY ALL")
def pixel_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.pixel_validity(_cube(spark, sf_dir))


@query(f"WITH {roles.CUBE}, {_STATS} SELECT c.product_id AS product_id, c.band AS band, line, sample, round(CASE WHEN valid THEN value ELSE coalesce(median, 0.0) END, 4) AS value, valid FROM cube c JOIN s ON s.product_id = c.product_id AND s.band = c.band")
def invalid_fill_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.clean(roles.cube(spark, sf_dir)), 4, "value")


@query(f"""WITH {roles.CUBE}, b AS (SELECT product_id, band, count(*) AS n, count(*) FILTER (WHERE valid) AS good, min(value) FILTER (WHERE valid) AS lo, max(value) FILTER (WHERE valid) AS hi FROM cube GROUP BY ALL),
p AS (SELECT product_id, count(*) AS bands, sum(good) / sum(n) * 100.0 AS valid_pct, min(lo) AS lo, max(hi) AS hi, CAST(count(*) FILTER (WHERE hi <= lo) AS BIGINT) AS flat_bands FROM b GROUP BY product_id)
SELECT product_id, bands, round(valid_pct, 6) AS valid_pct, round(lo, 4) AS lo, round(hi, 4) AS hi, flat_bands, CASE WHEN valid_pct < 5.0 OR coalesce(hi <= lo, true) THEN 'error' WHEN valid_pct < 50.0 OR flat_bands > 0 THEN 'warning' ELSE 'ok' END AS status FROM p""")
def cube_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(H.validate(_cube(spark, sf_dir)), 6, "valid_pct"), 4, "lo", "hi")


@query(f"""WITH {roles.CUBE}, {_STATS}, v AS (SELECT c.product_id AS product_id, line, sample, valid, CASE WHEN valid AND p99 - p01 > 1e-7 THEN greatest(0.0, least(1.0, (value - p01) / (p99 - p01))) ELSE 0.0 END AS value FROM cube c JOIN s ON s.product_id = c.product_id AND s.band = c.band WHERE c.band IN (1, 3, 5))
SELECT product_id, line, sample, CAST(trunc(avg(value) * 255) AS INTEGER) AS value, bool_or(valid) AS valid FROM v GROUP BY ALL""")
def band_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.composite(_cube(spark, sf_dir), H.composite_bands(7))


@query("SELECT i.i AS i, j.j AS j, round(covar_samp(CAST(embedding[i.i + 1] AS DOUBLE), CAST(embedding[j.j + 1] AS DOUBLE)), 9) AS cov FROM embeddings, (SELECT CAST(range AS INTEGER) AS i FROM range(8)) i, (SELECT CAST(range AS INTEGER) AS j FROM range(8)) j WHERE i.i <= j.j GROUP BY 1, 2")
def spectral_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = roles.table(spark, sf_dir, "embeddings").select(F.lit(0).alias("product_id"), F.slice("embedding", 1, 8).alias("spectrum"))
    return rounded(H.covariance(e, "spectrum").drop("product_id"), 9, "cov")


@query("SELECT label, i.i AS i, j.j AS j, round(covar_samp(CAST(embedding[i.i + 1] AS DOUBLE), CAST(embedding[j.j + 1] AS DOUBLE)), 9) AS cov FROM embeddings, (SELECT CAST(range AS INTEGER) AS i FROM range(4)) i, (SELECT CAST(range AS INTEGER) AS j FROM range(4)) j WHERE i.i <= j.j GROUP BY ALL HAVING count(*) > 1")
def covariance_by_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = roles.table(spark, sf_dir, "embeddings").select("label", F.slice("embedding", 1, 4).alias("spectrum"))
    return rounded(H.covariance(e, "spectrum", "label"), 9, "cov")


@query()
def principal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as spectra of a product per label."""
    e = roles.table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("product_id"), F.slice("embedding", 1, 16).alias("spectrum"))
    return H.project_components(e, "spectrum", H.principal_components(e, "spectrum")).drop("spectrum")


def _full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of the cube that have its first three bands, cleaned."""
    dense = _cube(spark, sf_dir).filter("band <= 3")
    full = dense.groupBy(*H.PIXEL).agg(F.count(F.lit(1)).alias("n")).filter("n = 3").drop("n")
    return H.clean(dense.join(full, list(H.PIXEL), "left_semi").drop("valid"))


@query()
def cube_representation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.representation(_full(spark, sf_dir), 3)


_BAND = "WITH {cube}, k AS (SELECT product_id, line, sample FROM cube WHERE band <= 3 GROUP BY ALL HAVING count(*) = 3), f AS (SELECT c.* FROM cube c JOIN k ON k.product_id = c.product_id AND k.line = c.line AND k.sample = c.sample WHERE band = 2)"


@query(_BAND.format(cube=roles.CUBE) + """, m AS (SELECT product_id, median(value) FILTER (WHERE valid) AS median FROM f GROUP BY ALL), s AS (SELECT product_id, quantile_cont(value, 0.01) FILTER (WHERE valid) AS lo, quantile_cont(value, 0.99) FILTER (WHERE valid) AS hi FROM f GROUP BY ALL)
SELECT f.product_id AS product_id, line, sample, CAST(trunc(CASE WHEN valid AND hi - lo > 1e-7 THEN greatest(0.0, least(1.0, (value - lo) / (hi - lo))) ELSE 0.0 END * 255) AS INTEGER) AS value, valid FROM f JOIN s ON s.product_id = f.product_id""")
def selected_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.representation(_full(spark, sf_dir), 3, "selected_band", 2)


@query(_BAND.format(cube=roles.CUBE) + " SELECT product_id, line, sample, CASE WHEN valid THEN CAST(trunc(greatest(0.0, least(255.0, value))) AS INTEGER) ELSE 0 END AS value, valid FROM f")
def fallback_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.representation(_full(spark, sf_dir), 3, "unknown mode", 2)


# ---- pixels ----


@query(f"""WITH {roles.IMAGE}, s AS (SELECT count(value) FILTER (WHERE valid) AS n, quantile_cont(value, 0.01) FILTER (WHERE valid) AS lo, quantile_cont(value, 0.99) FILTER (WHERE valid) AS hi FROM image)
SELECT product_id, line, sample, CASE WHEN n >= 100 AND hi > lo THEN CASE WHEN valid THEN CAST(trunc(greatest(0.0, least(1.0, (value - lo) / (hi - lo))) * 255) AS INTEGER) ELSE 0 END END AS value, valid, CASE WHEN n >= 100 AND hi > lo THEN 'OK' ELSE 'FAILED' END AS status FROM image, s""")
def percentile_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.stretch(roles.image(spark, sf_dir))


def _neighbours(name: str, offsets: dict) -> str:
    return f"SELECT a.product_id AS product_id, a.line AS line, a.sample AS sample, count(*) AS n, " + ", ".join(
        f"sum(CASE {' '.join(f'WHEN b.line = a.line + {dy} AND b.sample = a.sample + {dx} THEN {w} * b.value' for (dy, dx), w in o.items())} ELSE 0.0 END) AS {k}" for k, o in offsets.items()
    ) + f" FROM {name} a JOIN {name} b ON b.line BETWEEN a.line - 1 AND a.line + 1 AND b.sample BETWEEN a.sample - 1 AND a.sample + 1 GROUP BY ALL"


@query(f"WITH {roles.IMAGE}, g AS ({_neighbours('image', P.SOBEL)}), m AS (SELECT *, sqrt(gx * gx + gy * gy) AS magnitude FROM g WHERE n = 9), e AS (SELECT min(magnitude) AS lo, max(magnitude) AS hi FROM m) "
       "SELECT product_id, line, sample, round(magnitude, 6) AS magnitude, CAST(trunc((magnitude - lo) / greatest(hi - lo, 1e-12) * 255) AS INTEGER) AS value FROM m, e")
def gradient_stencil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.gradient(_dense(spark, sf_dir)), 6, "magnitude")


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.image(spark, sf_dir)


@query(f"WITH {roles.IMAGE}, g AS ({_neighbours('image', P.LAPLACE)}) SELECT i.product_id AS product_id, i.line AS line, i.sample AS sample, CASE WHEN valid THEN CAST(round_even(least(255.0, value * CAST(0.7 AS DOUBLE) + least(abs(lap), 255.0) * (1 - CAST(0.7 AS DOUBLE))), 0) AS INTEGER) ELSE 0 END AS value, valid FROM image i JOIN g ON g.line = i.line AND g.sample = i.sample")
def laplacian_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.structure(_dense(spark, sf_dir))


@query(f"WITH {roles.IMAGE} SELECT a.product_id AS product_id, a.line AS line, a.sample AS sample, a.value AS value, a.valid AND NOT EXISTS (SELECT 1 FROM image b WHERE NOT b.valid AND b.line BETWEEN a.line - 1 AND a.line + 1 AND b.sample BETWEEN a.sample - 1 AND a.sample + 1) AS valid FROM image a")
def mask_erode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.eroded(_dense(spark, sf_dir), 3)


@query(f"WITH {roles.IMAGE} SELECT product_id, line // 4 AS line, sample // 4 AS sample, round(avg(value) FILTER (WHERE valid), 6) AS value, bool_or(valid) AS valid FROM image GROUP BY ALL")
def resize_area_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.area_mean(_dense(spark, sf_dir), 4), 6, "value")


def _half_sql(name: str) -> str:
    return f"""SELECT a.product_id AS product_id, a.line // 2 AS line, a.sample // 2 AS sample, sum(k[b.line - a.line + 3] * k[b.sample - a.sample + 3] * b.value) / sum(k[b.line - a.line + 3] * k[b.sample - a.sample + 3]) AS value
 FROM {name} a JOIN {name} b ON b.line BETWEEN a.line - 2 AND a.line + 2 AND b.sample BETWEEN a.sample - 2 AND a.sample + 2, (SELECT [0.0625::DOUBLE, 0.25, 0.375, 0.25, 0.0625] AS k) WHERE a.line % 2 = 0 AND a.sample % 2 = 0 GROUP BY ALL"""


@query(f"WITH {roles.IMAGE}, l1 AS ({_half_sql('image')}), l2 AS ({_half_sql('l1')}) SELECT CAST(level AS INTEGER) AS level, product_id, line, sample, round(value, 6) AS value FROM (SELECT 0 AS level, product_id, line, sample, value FROM image UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 2, * FROM l2)")
def gaussian_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.pyramid(_dense(spark, sf_dir)), 6, "value")


_OTHER = "other AS (SELECT product_id, line, sample, 255 - value AS value, valid FROM image)"


def _pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = _dense(spark, sf_dir)
    return a, a.withColumn("value", 255 - F.col("value"))


@query(f"WITH {roles.IMAGE}, {_OTHER} SELECT b.product_id AS product_id, b.line AS line, b.sample AS sample, CAST(CASE WHEN a.valid THEN round_even(a.value * 0.5 + b.value * 0.5, 0) ELSE b.value END AS INTEGER) AS value FROM other b JOIN image a ON a.line = b.line AND a.sample = b.sample")
def alpha_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.blend(*_pair(spark, sf_dir))


@query(f"WITH {roles.IMAGE}, {_OTHER} SELECT b.product_id AS product_id, b.line AS line, b.sample AS sample, CASE WHEN (b.line // 16 + b.sample // 16) % 2 = 0 THEN b.value ELSE a.value END AS value FROM other b JOIN image a ON a.line = b.line AND a.sample = b.sample")
def checkerboard_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.checkerboard(*_pair(spark, sf_dir), 16)


_WARP = np.array([[1.0, 0.05, 2.0], [-0.03, 1.0, 1.0], [0.0001, 0.0, 1.0]])


def _warp_sql() -> str:
    h = [repr(float(v)) for v in np.linalg.inv(_WARP).ravel()]
    return f"""WITH {roles.IMAGE}, grid AS (SELECT CAST(range // 64 AS INTEGER) AS line, CAST(range % 64 AS INTEGER) AS sample FROM range(4096)),
w AS (SELECT *, {h[6]}::DOUBLE * sample + {h[7]}::DOUBLE * line + {h[8]}::DOUBLE AS w FROM grid),
p AS (SELECT line, sample, ({h[0]}::DOUBLE * sample + {h[1]}::DOUBLE * line + {h[2]}::DOUBLE) / w AS sx, ({h[3]}::DOUBLE * sample + {h[4]}::DOUBLE * line + {h[5]}::DOUBLE) / w AS sy FROM w),
c AS (SELECT line, sample, CAST(floor(sy) AS INTEGER) + dy AS cl, CAST(floor(sx) AS INTEGER) + dx AS cs, (1 - abs(sy - floor(sy) - dy)) * (1 - abs(sx - floor(sx) - dx)) AS k FROM p, (SELECT 0 AS dy UNION ALL SELECT 1), (SELECT 0 AS dx UNION ALL SELECT 1)),
g AS (SELECT i.product_id AS product_id, c.line AS line, c.sample AS sample, sum(k * value) AS value, sum(k) AS k, bool_and(valid) AS valid FROM c JOIN image i ON i.line = c.cl AND i.sample = c.cs WHERE k > 0 GROUP BY ALL)
SELECT product_id, line, sample, round(value, 6) AS value, valid AND k > 1 - 1e-9 AS valid FROM g"""


@query(_warp_sql())
def perspective_warp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.warp(_dense(spark, sf_dir), _WARP, 64, 64), 6, "value")


@query(f"""WITH {roles.IMAGE}, z AS (SELECT product_id, line, sample, CAST(value AS INTEGER) AS v FROM image), e AS (SELECT product_id, (max(line) + 8) // 8 AS fy, (max(sample) + 8) // 8 AS fx, max(line) AS ml, max(sample) AS ms FROM z GROUP BY product_id),
f AS (SELECT z.*, fy, fx, ml // fy AS my, ms // fx AS mx, line // fy AS i, sample // fx AS j FROM z JOIN e ON e.product_id = z.product_id),
n AS (SELECT product_id, i, j, count(*) AS n, greatest(1.0, 2.0 * count(*) / 256) AS most FROM f GROUP BY ALL), h AS (SELECT product_id, i, j, v, count(*) AS c FROM f GROUP BY ALL),
o AS (SELECT h.product_id, h.i, h.j, sum(greatest(c - most, 0)) / 256 AS extra FROM h JOIN n ON n.product_id = h.product_id AND n.i = h.i AND n.j = h.j GROUP BY ALL),
m AS (SELECT n.product_id, n.i, n.j, CAST(x.v AS INTEGER) AS v, sum(least(coalesce(c, 0), most) + extra) OVER (PARTITION BY n.product_id, n.i, n.j ORDER BY x.v) * 255 / n AS mapped
 FROM n JOIN o ON o.product_id = n.product_id AND o.i = n.i AND o.j = n.j, (SELECT range AS v FROM range(256)) x LEFT JOIN h ON h.product_id = n.product_id AND h.i = n.i AND h.j = n.j AND h.v = x.v),
y AS (SELECT *, (line + 0.5::DOUBLE) / fy - 0.5 AS y, (sample + 0.5::DOUBLE) / fx - 0.5 AS x FROM f),
q AS (SELECT *, least(my, greatest(0, CAST(floor(y) AS INTEGER))) AS i0, least(mx, greatest(0, CAST(floor(x) AS INTEGER))) AS j0 FROM y),
t AS (SELECT *, least(1.0, greatest(0.0, y - i0)) AS ty, least(1.0, greatest(0.0, x - j0)) AS tx FROM q),
a AS (SELECT product_id, line, sample, v, least(my, i0 + dy) AS i, least(mx, j0 + dx) AS j, CASE dy WHEN 0 THEN 1 - ty ELSE ty END * CASE dx WHEN 0 THEN 1 - tx ELSE tx END AS k FROM t, (SELECT 0 AS dy UNION ALL SELECT 1), (SELECT 0 AS dx UNION ALL SELECT 1))
SELECT a.product_id AS product_id, a.line AS line, a.sample AS sample, CAST(round_even(round(greatest(0.0, least(255.0, sum(k * mapped))), 6), 0) AS INTEGER) AS value FROM a JOIN m ON m.product_id = a.product_id AND m.i = a.i AND m.j = a.j AND m.v = a.v GROUP BY ALL""")
def adaptive_equalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.equalise(_dense(spark, sf_dir))


# ---- footprints ----

_PAIRS = f"""WITH s AS ({roles.footprints_sql('supplier', 's_suppkey')}), r AS ({roles.footprints_sql('customer', 'c_custkey')}),
p AS (SELECT s.id AS s_id, r.id AS r_id, (s.max_a - s.min_a) * (s.max_b - s.min_b) AS sa, (r.max_a - r.min_a) * (r.max_b - r.min_b) AS ra, greatest(0.0, least(s.max_a, r.max_a) - greatest(s.min_a, r.min_a)) * greatest(0.0, least(s.max_b, r.max_b) - greatest(s.min_b, r.min_b)) AS oa
 FROM s JOIN r ON s.min_a <= r.max_a AND r.min_a <= s.max_a AND s.min_b <= r.max_b AND r.min_b <= s.max_b AND s.id <> r.id)
"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.candidates(roles.footprints(spark, sf_dir, "supplier", "s_suppkey"), roles.footprints(spark, sf_dir, "customer", "c_custkey"))


@query(_PAIRS + f"SELECT s_id, r_id, round(oa, 6) AS overlap_area, round(oa / least(sa, ra) * 100.0, 6) AS pct_smaller, round(oa * {G.KM2_PER_SQ_DEG!r}, 4) AS overlap_km2 FROM p")
def footprint_bbox_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.box_overlap(_pairs(spark, sf_dir)).select("s_id", "r_id", F.round("overlap_area", 6).alias("overlap_area"), F.round("pct_smaller", 6).alias("pct_smaller"), F.round("overlap_km2", 4).alias("overlap_km2"))


@query(_PAIRS + "SELECT CASE WHEN oa <= 0 THEN 'rejected' WHEN oa / least(sa, ra) * 100.0 < 0.1 THEN 'insufficient_overlap' ELSE 'validated' END AS status, count(*) AS pairs, round(sum(oa), 4) AS area FROM p GROUP BY 1")
def footprint_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.box_overlap(_pairs(spark, sf_dir)).groupBy("status").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.sum("overlap_area"), 4).alias("area"))


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = lambda p: G.box(F.col(f"{p}_min_a"), F.col(f"{p}_max_a"), F.col(f"{p}_min_b"), F.col(f"{p}_max_b"))
    return _pairs(spark, sf_dir).select("s_id", "r_id", ring("s").alias("source_ring"), ring("r").alias("reference_ring"), F.lit(None).cast("string").alias("source_projection"), F.lit(None).cast("string").alias("reference_projection"))


@query(_PAIRS + "SELECT s_id, r_id, CASE WHEN oa <= 1e-12 THEN 'rejected' WHEN oa / least(sa, ra) * 100.0 < 0.1 THEN 'insufficient_overlap' ELSE 'validated' END AS status, round(oa, 6) AS overlap_area FROM p")
def polygon_clip_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.evaluate(_rings(spark, sf_dir)).select("s_id", "r_id", "status", F.round("overlap_area", 6).alias("overlap_area"))


@query(f"""SELECT CAST(c_custkey AS BIGINT) AS id, round(2 * {G.RADIUS_KM} * tan(radians((90.0 + lat) / 2.0)) * sin(radians(lon)), 6) AS x, round(2 * {G.RADIUS_KM} * tan(radians((90.0 + lat) / 2.0)) * cos(radians(lon)), 6) AS y, round(lat, 6) AS lat, round(lon, 6) AS lon
FROM (SELECT c_custkey, CAST(-90 AS DOUBLE) + (c_custkey % 299 + 1) * CAST(0.1 AS DOUBLE) AS lat, (c_custkey % 3590) * CAST(0.1 AS DOUBLE) + CAST(0.05 AS DOUBLE) AS lon FROM customer)""")
def polar_project_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = roles.table(spark, sf_dir, "customer")
    p = c.select(F.col("c_custkey").cast("long").alias("id"), G.polar(-90.0 + (F.col("c_custkey") % 299 + 1) * 0.1, (F.col("c_custkey") % 3590) * 0.1 + 0.05).alias("p"))
    back = G.from_polar(F.col("p.a"), F.col("p.b"))
    return p.select("id", F.round("p.a", 6).alias("x"), F.round("p.b", 6).alias("y"), F.round(back["a"], 6).alias("lat"), F.round(back["b"], 6).alias("lon"))


_WINDOW = "CAST(round_even({v}, 0) AS INTEGER)"


@query(_PAIRS.replace("AS oa\n", "AS oa, s.min_a AS s1, s.max_a AS n1, s.min_b AS w1, s.max_b AS e1, greatest(s.min_a, r.min_a) AS s2, least(s.max_a, r.max_a) AS n2, greatest(s.min_b, r.min_b) AS w2, least(s.max_b, r.max_b) AS e2\n") + """,
f AS (SELECT s_id, r_id, (n1 - n2) / greatest(n1 - s1, 1e-9) AS t, (n1 - s2) / greatest(n1 - s1, 1e-9) AS b, (w2 - w1) / greatest(e1 - w1, 1e-9) AS l, (e2 - w1) / greatest(e1 - w1, 1e-9) AS r FROM p),
x AS (SELECT s_id, r_id, greatest(0, CAST(round_even((t - (b - t) * 0.05) * 1000, 0) AS INTEGER)) AS y0, least(1000, CAST(round_even((b + (b - t) * 0.05) * 1000, 0) AS INTEGER)) AS y1, greatest(0, CAST(round_even((l - (r - l) * 0.05) * 800, 0) AS INTEGER)) AS x0, least(800, CAST(round_even((r + (r - l) * 0.05) * 800, 0) AS INTEGER)) AS x1 FROM f)
SELECT s_id, r_id, CASE WHEN y1 <= y0 THEN 0 ELSE y0 END AS y0, CASE WHEN y1 <= y0 THEN 1000 ELSE y1 END AS y1, CASE WHEN x1 <= x0 THEN 0 ELSE x0 END AS x0, CASE WHEN x1 <= x0 THEN 800 ELSE x1 END AS x1 FROM x""")
def pixel_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    shared = (F.greatest("s_min_a", "r_min_a"), F.least("s_max_a", "r_max_a"), F.greatest("s_min_b", "r_min_b"), F.least("s_max_b", "r_max_b"))
    w = G.pixel_window(F.lit(1000), F.lit(800), (c("s_min_a"), c("s_max_a"), c("s_min_b"), c("s_max_b")), shared)
    return _pairs(spark, sf_dir).select("s_id", "r_id", w.alias("w")).select("s_id", "r_id", "w.*")


# ---- names, labels, states ----

_KIND = """CASE WHEN ends_with(n, '.xml') OR ends_with(n, '.lbl') OR ends_with(n, '.txt') THEN 'METADATA_LABEL' WHEN ends_with(n, '.tif') OR ends_with(n, '.tiff') THEN 'GEOTIFF' WHEN regexp_matches(n, '\\.(png|jpg|jpeg|webp|bmp)$') THEN 'STANDARD_IMAGE'
 WHEN regexp_matches(n, '\\.(img|raw|dat|bin)$') THEN CASE WHEN regexp_matches(base, '^m[0-9]+[lr]e') OR contains(base, 'lroc') OR contains(base, 'nac') OR contains(base, 'lro') THEN 'LRO_PDS3_BINARY' WHEN regexp_matches(base, 'ch2_|ohrc|tmc|iir') THEN 'CHANDRAYAAN_PDS4_BINARY' ELSE 'SCIENTIFIC_BINARY' END ELSE 'UNKNOWN' END"""
_NAMES = """names AS (SELECT page_id, url || CASE page_id % 9 WHEN 0 THEN '/M1' || page_id || 'LE.IMG' WHEN 1 THEN '/ch2_ohr_1.img' WHEN 2 THEN '/a.xml' WHEN 3 THEN '/b.TIFF' WHEN 4 THEN '/c.jpeg' WHEN 5 THEN '/d.raw' WHEN 6 THEN '/ch2_iir_n.dat' ELSE '' END AS name FROM pages)"""


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 9
    end = F.when(k == 0, F.concat(F.lit("/M1"), F.col("page_id").cast("string"), F.lit("LE.IMG")))
    for i, t in enumerate(("/ch2_ohr_1.img", "/a.xml", "/b.TIFF", "/c.jpeg", "/d.raw", "/ch2_iir_n.dat")):
        end = end.when(k == i + 1, t)
    return roles.table(spark, sf_dir, "pages").select("page_id", F.concat("url", end.otherwise("")).alias("name"))


@query(f"WITH {_NAMES}, l AS (SELECT page_id, lower(trim(name)) AS n, list_last(string_split(lower(trim(name)), '/')) AS base FROM names) SELECT page_id, {_KIND} AS product_type FROM l")
def classify_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("page_id", X.product_type(F.col("name")).alias("product_type"))


_SENSOR = "CASE WHEN regexp_matches(n, 'iirs|ch2_iir|_iir') THEN 'IIRS' WHEN regexp_matches(n, 'ohrc|ch2_ohr') THEN 'OHRC' WHEN contains(n, 'tmc') THEN 'TMC' WHEN regexp_matches(n, 'm1|nac|lro') THEN 'LROC_NAC' ELSE 'Unknown' END"


@query(f"WITH {_NAMES}, l AS (SELECT page_id, lower(name) AS n FROM names), s AS (SELECT page_id, {_SENSOR} AS sensor FROM l) SELECT page_id, sensor, CASE WHEN sensor = 'OHRC' THEN 'same' ELSE 'different' END AS route FROM s")
def sensor_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _names(spark, sf_dir).select("page_id", X.sensor_from_name(F.col("name")).alias("sensor"))
    return s.withColumn("route", X.sensor_route(F.col("sensor"), F.lit("OHRC")))


@query(f"WITH {_NAMES}, l AS (SELECT page_id, upper(regexp_replace(list_last(string_split(name, '/')), '(?i)\\.(img|lbl|xml)$', '')) AS id FROM names) SELECT page_id, CASE WHEN id <> '' THEN id END AS product_id, CASE WHEN id = 'M1' || page_id || 'LE' THEN 'VERIFIED' ELSE 'MISMATCH' END AS id_status FROM l")
def product_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(F.lit("m1"), F.col("page_id").cast("string"), F.lit("le.lbl"))
    return _names(spark, sf_dir).select("page_id", X.product_id(F.col("name")).alias("product_id"), X.id_match(F.col("name"), label).alias("id_status"))


def _keyword_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit('PDS_VERSION_ID = PDS3\r\nPRODUCT_ID   = "M'), k, F.lit('LE"\r\n RECORD_BYTES = 5064\n^IMAGE = ("A.IMG", '), (F.col("p_partkey") % 7 + 1).cast("string"), F.when(F.col("p_partkey") % 3 == 0, " <BYTES>)").otherwise(")"), F.lit("\nOBJECT = IMAGE\n  LINES = "), (F.col("p_partkey") % 1000 + 1).cast("string"), F.lit("\n  LINE_SAMPLES = 64\n SAMPLE_BITS = "), F.when(F.col("p_partkey") % 2 == 0, "8").otherwise("16"), F.lit("\n SAMPLE_TYPE = LSB_UNSIGNED_INTEGER\n RESOLUTION = "), (F.col("p_size") / 10).cast("string"), F.lit(" <METERS/PIXEL>\nINCIDENCE_ANGLE = 60.5 <DEG>\nEND\n"))
    return roles.table(spark, sf_dir, "part").select(k.alias("path"), text.alias("text"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS path, 'M' || p_partkey || 'LE' AS product_id, CAST(p_partkey % 1000 + 1 AS INTEGER) AS lines, CAST(64 AS INTEGER) AS samples, CAST(CASE WHEN p_partkey % 2 = 0 THEN 8 ELSE 16 END AS INTEGER) AS sample_bits,
 round(p_size / 10.0, 4) AS gsd_m_per_pixel, CAST(29.5 AS DOUBLE) AS sun_elevation_deg FROM part""")
def label_kv_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.parse_keyword_labels(_keyword_labels(spark, sf_dir)).select("path", "product_id", "lines", "samples", "sample_bits", F.round("gsd_m_per_pixel", 4).alias("gsd_m_per_pixel"), F.round("sun_elevation_deg", 4).alias("sun_elevation_deg"))


def _xml_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    text = F.concat(F.lit('<?xml version="1.0"?><Product_Observational xmlns="http://example.org/ns"><Identification_Area><logical_identifier>urn:'), k, F.lit("</logical_identifier></Identification_Area><processingLevel>Calibrated</processingLevel><spacecraft_altitude>"), (F.col("o_orderkey") % 90 + 10).cast("string"), F.lit(' km</spacecraft_altitude><Axis_Array><axis_name>Line</axis_name><elements>'), (F.col("o_orderkey") % 500 + 1).cast("string"), F.lit('</elements></Axis_Array><Axis_Array axis_name="Sample"><elements>64</elements></Axis_Array><pixelResolution>0.25 m/pixel</pixelResolution></Product_Observational>'))
    return roles.table(spark, sf_dir, "orders").select(k.alias("path"), text.alias("text"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS path, 'urn:' || o_orderkey AS product_id, 'Calibrated' AS processing_level, CAST(o_orderkey % 90 + 10 AS DOUBLE) AS altitude_km, CAST(o_orderkey % 500 + 1 AS INTEGER) AS lines, CAST(64 AS INTEGER) AS samples, CAST(0.25 AS DOUBLE) AS gsd_m_per_pixel FROM orders")
def xml_tag_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.parse_xml_labels(_xml_labels(spark, sf_dir), spark.sparkContext.defaultParallelism).select("path", "product_id", "processing_level", "altitude_km", "lines", "samples", "gsd_m_per_pixel")


_MISSING = "list_filter([" + ", ".join(
    f"CASE WHEN {cond} THEN '{name}' END" for name, cond in (
        ("sensor", "sensor_type = 'Unknown' AND instrument IS NULL"), ("processing_level", "processing_level IS NULL"), ("start_time", "start_time IS NULL"), ("stop_time", "stop_time IS NULL"), ("altitude", "altitude_km IS NULL"), ("sun", "sun IS NULL OR incidence IS NULL"),
        ("camera", "camera IS NULL"), ("footprint", "corners IS NULL"), ("projection", "projection IS NULL"), ("dimensions", "lines IS NULL"))
) + "], lambda x: x IS NOT NULL)"


@query(f"WITH {roles.METADATA}, v AS (SELECT *, {_MISSING} AS missing FROM meta) SELECT product_id, array_to_string(missing, ',') AS missing, len(missing) = 0 AS valid, gsd IS NULL AS warned FROM v")
def metadata_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = roles.metadata(spark, sf_dir).withColumn("missing", S.missing_fields())
    return m.select("product_id", F.array_join("missing", ",").alias("missing"), (F.size("missing") == 0).alias("valid"), (F.size(S.warnings()) > 0).alias("warned"))


@query(f"""WITH {roles.METADATA}, v AS (SELECT *, len({_MISSING}) = 0 AS valid FROM meta),
t AS (SELECT product_id, corners, CASE WHEN source = 'NOT_PROVIDED' THEN source WHEN source = 'DEMO' THEN source WHEN NOT valid THEN 'INCOMPLETE' WHEN lines = 0 OR (sensor_type = 'LROC_NAC' AND gsd IS NULL) THEN 'INCOMPLETE' WHEN source = 'ELSEWHERE' THEN 'INCOMPLETE' ELSE source END AS status FROM v),
f AS (SELECT product_id, status, CASE WHEN status = 'NOT_PROVIDED' THEN 'PENDING' WHEN corners IS NOT NULL THEN 'AVAILABLE' ELSE 'UNAVAILABLE' END AS footprint FROM t)
SELECT product_id, status, footprint, CASE WHEN footprint <> 'AVAILABLE' THEN 'PENDING' WHEN product_id % 4 = 0 THEN 'REJECTED' WHEN product_id % 4 = 1 THEN 'INSUFFICIENT_OVERLAP' WHEN product_id % 4 = 2 THEN 'VALID' ELSE 'PENDING' END AS pair FROM f""")
def status_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = roles.metadata(spark, sf_dir)
    status = S.metadata_status(F.size(S.missing_fields()) == 0, F.col("source"))
    m = m.withColumn("status", status).withColumn("footprint", S.footprint_status(F.col("status")))
    k = F.col("product_id") % 4
    evaluated = F.when(k == 0, "rejected").when(k == 1, "insufficient_overlap").when(k == 2, "validated").otherwise("pending")
    return m.select("product_id", "status", "footprint", S.pair_status(F.col("footprint"), F.lit("AVAILABLE"), evaluated, F.lit(None).cast("boolean")).alias("pair"))


@query("""WITH n AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'M' || s_suppkey || 'LE.IMG' WHEN 1 THEN 'N' || (s_suppkey % 40) || '.lbl' ELSE 'other' || s_suppkey END AS name, s_nationkey FROM supplier),
k AS (SELECT s_suppkey, upper(regexp_replace(name, '(?i)\\.(img|lbl|xml)$', '')) AS pid FROM n)
SELECT CAST(s_suppkey AS BIGINT) AS id, pid, coalesce(n_name, CASE WHEN regexp_matches(pid, '^M[0-9]+[LR]E$') THEN 'FAMILY' END) AS title, CASE WHEN n_name IS NOT NULL THEN 'catalog' WHEN regexp_matches(pid, '^M[0-9]+[LR]E$') THEN 'family' ELSE 'none' END AS record_source FROM k LEFT JOIN nation ON pid = 'N' || n_nationkey""")
def catalog_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = roles.table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("M"), k.cast("string"), F.lit("LE.IMG"))).when(k % 3 == 1, F.concat(F.lit("N"), (k % 40).cast("string"), F.lit(".lbl"))).otherwise(F.concat(F.lit("other"), k.cast("string")))
    catalog = roles.table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(".img")).alias("product_id"), F.col("n_name").alias("title"))
    family = spark.createDataFrame([("FAMILY",)], "title string")
    return C.look_up(s.select(k.cast("long").alias("id"), name.alias("name")), catalog, family).select("id", "pid", "title", "record_source")


@query("""WITH p AS (SELECT 'N' || n_nationkey AS product_id, n_name AS title, 1 AS priority FROM nation UNION ALL SELECT 'N' || (s_suppkey % 30), s_name, 2 FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey % 30 ORDER BY s_suppkey) AS rn FROM supplier) WHERE rn = 1)
SELECT product_id, title, CASE priority WHEN 1 THEN 'label' ELSE 'catalog_file' END AS provider FROM p QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY priority DESC) = 1""")
def provider_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = roles.table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("product_id"), F.col("n_name").alias("title"))
    first = roles.table(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 30).alias("k")).agg(F.min_by("s_name", "s_suppkey").alias("title"))
    other = first.select(F.concat(F.lit("N"), F.col("k").cast("string")).alias("product_id"), "title")
    return C.resolve({"label": (1, label), "catalog_file": (2, other)}).select("product_id", "title", "provider")


@query("""WITH i AS (SELECT n_name || '_north.img' AS image, lower(n_name || '_north') AS si, upper(n_name || '_north') AS ii FROM nation UNION ALL SELECT 'q' || n_nationkey || '.img', 'q' || n_nationkey, 'Q' || n_nationkey FROM nation),
l AS (SELECT n_name || '.lbl' AS label, lower(n_name) AS sl, NULL AS pid FROM nation UNION ALL SELECT 'old_' || n_name || '_north_2.xml', lower('old_' || n_name || '_north_2'), NULL FROM nation WHERE n_nationkey % 2 = 0
 UNION ALL SELECT substr(n_name, 1, 2) || '.lbl', lower(substr(n_name, 1, 2)), NULL FROM nation UNION ALL SELECT 'zz' || n_nationkey || 'zz.xml', 'zz' || n_nationkey || 'zz', 'Q' || (n_nationkey + 1) FROM nation)
SELECT DISTINCT image, label FROM i JOIN l ON si = sl OR contains(si, sl) OR contains(sl, si) OR ii = pid""")
def label_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = roles.table(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("string")
    images = n.select(F.concat("n_name", F.lit("_north.img")).alias("name")).unionByName(n.select(F.concat(F.lit("q"), key, F.lit(".img")).alias("name")))
    none = F.lit(None).cast("string").alias("product_id")
    labels = n.select(F.concat("n_name", F.lit(".lbl")).alias("name"), none).unionByName(n.filter("n_nationkey % 2 = 0").select(F.concat(F.lit("old_"), "n_name", F.lit("_north_2.xml")).alias("name"), none))
    labels = labels.unionByName(n.select(F.concat(F.substring("n_name", 1, 2), F.lit(".lbl")).alias("name"), none))
    labels = labels.unionByName(n.select(F.concat(F.lit("zz"), key, F.lit("zz.xml")).alias("name"), F.concat(F.lit("q"), (F.col("n_nationkey") + 1).cast("string"), F.lit(".lbl")).alias("product_id")))
    return C.associate(images, labels)


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.table(spark, sf_dir, "documents").select("doc_id", X.content_hash(F.col("text").cast("binary")).alias("content_hash"))


# ---- raster contract ----

_SPEC = """spec AS (SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_orderkey % 400 AS BIGINT) AS lines, CAST(l_partkey % 300 AS BIGINT) AS samples, CASE l_linenumber % 3 WHEN 0 THEN 8 WHEN 1 THEN 16 END AS bits, CASE WHEN l_suppkey % 4 <> 0 THEN (l_suppkey % 3) * 512 END AS off, CASE WHEN l_suppkey % 5 = 0 THEN 512 END AS record,
 CAST(l_orderkey % 400 AS BIGINT) * (l_partkey % 300) + (l_linenumber - 3) * 256 AS size FROM lineitem)"""


def _spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    lines, samples = (c("l_orderkey") % 400).cast("long"), (c("l_partkey") % 300).cast("long")
    return roles.table(spark, sf_dir, "lineitem").select(
        (c("l_orderkey") * 10 + c("l_linenumber")).cast("long").alias("id"), lines.alias("lines"), samples.alias("samples"), F.when(c("l_linenumber") % 3 == 0, 8).when(c("l_linenumber") % 3 == 1, 16).cast("long").alias("bits"),
        F.when(c("l_suppkey") % 4 != 0, (c("l_suppkey") % 3) * 512).cast("long").alias("off"), F.when(c("l_suppkey") % 5 == 0, 512).cast("long").alias("record"), (lines * samples + (c("l_linenumber") - 3) * 256).cast("long").alias("size"),
    )


_STATUS = """SELECT id, want, CASE WHEN want IS NULL THEN 'UNKNOWN' WHEN record IS NULL AND there = want THEN 'VERIFIED' WHEN record IS NOT NULL AND size = (pos // record + lines) * record THEN 'VERIFIED' WHEN record IS NOT NULL AND size >= pos + want - record THEN 'PARTIAL' WHEN there < want THEN 'MISMATCH' ELSE 'PARTIAL' END AS status, lines, samples, bits, off, record
 FROM (SELECT *, CASE WHEN lines > 0 AND samples > 0 AND bits > 0 THEN lines * samples * bits // 8 END AS want, coalesce(off, 0) AS pos, greatest(size - coalesce(off, 0), 0) AS there FROM spec)"""


@query(f"WITH {_SPEC}, s AS ({_STATUS}) SELECT CAST(id AS BIGINT) AS id, CAST(want AS BIGINT) AS expected_bytes, status FROM s")
def size_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return _spec(spark, sf_dir).select("id", R.payload(c("lines"), c("samples"), c("bits")).alias("expected_bytes"), R.size_status(c("size"), c("lines"), c("samples"), c("bits"), c("off"), c("record")).alias("status"))


_CHECKS_SQL = ["lines > 0 AND samples > 0", "bits IS NOT NULL", "off IS NOT NULL", "record IS NOT NULL AND id % 2 = 0", "status IN ('VERIFIED', 'PARTIAL')", "id % 3 > 0 OR status = 'MISMATCH'", "id % 3 > 0 AND id % 7 > 0", "id % 3 > 0", "id % 3 > 0 AND id % 11 > 0"]


@query(f"WITH {_SPEC}, s AS ({_STATUS}) SELECT CAST(id AS BIGINT) AS id, name, CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS status FROM (" + " UNION ALL ".join(f"SELECT id, '{n}' AS name, coalesce({cond}, false) AS ok FROM s" for n, cond in zip(R.CHECKS, _CHECKS_SQL, strict=True)) + ")")
def sanity_checks_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    s = _spec(spark, sf_dir).select(
        "id", "lines", "samples", F.when(c("bits").isNotNull(), "uint8").alias("dtype"), F.lit(None).cast("string").alias("sample_type"), c("off").alias("image_offset"), c("record").alias("record_bytes"), F.when(c("id") % 2 == 0, 2).alias("image_pointer"),
        R.size_status(c("size"), c("lines"), c("samples"), c("bits"), c("off"), c("record")).alias("size_status"), F.when(c("id") % 3 > 0, 3).alias("n_reads"), (c("id") % 7 > 0).alias("all_nonempty"), F.lit(True).alias("all_in_range"), (c("id") % 11 > 0).alias("all_finite"),
    )
    return s.select("id", F.explode(R.sanity_checks()).alias("x")).select("id", "x.name", "x.status")


@query("SELECT CAST(p_partkey AS BIGINT) AS id, round(p_retailprice / p_size, 6) AS ratio, round(round_even(p_size / p_retailprice, 3), 3) AS inverse, CASE WHEN p_size > p_retailprice THEN 'source' WHEN p_size < p_retailprice THEN 'reference' ELSE 'equal' END AS coarser, CAST(abs(round_even(log2(p_size / p_retailprice), 0)) AS INTEGER) AS octaves FROM (SELECT p_partkey, CAST(p_retailprice AS DOUBLE) AS p_retailprice, CAST(p_size AS DOUBLE) AS p_size FROM part)")
def scale_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = roles.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_size").cast("double").alias("s"), F.col("p_retailprice").cast("double").alias("r"))
    x = G.scale_summary(F.col("s"), F.col("r"))
    return p.select("id", F.round(G.scale_ratio(F.col("s"), F.col("r")), 6).alias("ratio"), x["ratio"].alias("inverse"), x["coarser"].alias("coarser"), x["octaves"].alias("octaves"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CAST(n_chars AS DOUBLE) / 4 END AS metres, CAST(n_chars AS INTEGER) AS whole FROM documents")
def unit_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = roles.table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 2 == 0, F.concat((F.col("n_chars") / 4).cast("string"), F.lit(" m/pixel"))).otherwise("n/a")
    return d.select("doc_id", X.number(text).alias("metres"), X.whole(F.concat(F.col("n_chars").cast("string"), F.lit(".75"))).alias("whole"))


# ---- reports ----


@query("SELECT CAST(p_partkey AS BIGINT) AS id, least(p_size * 1000.0::DOUBLE, p_retailprice) / greatest(p_size * 1000.0::DOUBLE, p_retailprice, 1) AS ratio, least(p_size * 1000.0::DOUBLE, p_retailprice) / greatest(p_size * 1000.0::DOUBLE, p_retailprice, 1) > 0.15 AS plausible FROM (SELECT p_partkey, p_size, CAST(p_retailprice AS DOUBLE) AS p_retailprice FROM part)")
def size_plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = roles.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), (F.col("p_size") * 1000.0).alias("s"), F.col("p_retailprice").cast("double").alias("r"))
    ratio, plausible = T.size_plausibility(F.col("s"), F.col("r"))
    return p.select("id", ratio.alias("ratio"), plausible.alias("plausible"))


@query(f"WITH {roles.POINTS} SELECT pair_id, round(avg(sqrt((rx - sx) ** 2 + (ry - sy) ** 2)), 6) AS mean_shift FROM points GROUP BY pair_id")
def refinement_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = roles.points(spark, sf_dir).withColumnsRenamed({"rx": "tx", "ry": "ty"})
    return rounded(T.refinement_shift(p, ["pair_id"]), 6, "mean_shift")


@query(f"WITH {roles.METADATA} SELECT product_id, CASE WHEN gsd IS NULL THEN 'pending' WHEN product_id % 90 = 0 THEN 'unavailable' ELSE 'ratio' END AS scale, CASE WHEN lines IS NULL THEN '{T.MISSING}' ELSE CAST(lines AS VARCHAR) || '.0 px' END AS lines FROM meta")
def report_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = roles.metadata(spark, sf_dir)
    scale = T.scale_text(F.lit(0.5), F.col("gsd_m_per_pixel"))
    return m.select("product_id", F.when(scale.isin("pending", "unavailable"), scale).otherwise("ratio").alias("scale"), T.figure(F.col("lines"), 1, " px").alias("lines"))


@query()
def subpixel_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different source ends of all matches are the corners to refine."""
    i = roles.image(spark, sf_dir)
    ends = roles.points(spark, sf_dir).select(F.col("sx").alias("x"), F.col("sy").alias("y")).distinct()
    corners = ends.select(F.lit(0).cast("long").alias("product_id"), (F.col("x") * 1000 + F.col("y")).cast("long").alias("id"), "x", "y")
    return rounded(P.refined(i, corners), 6, "tx", "ty")


# ---- gates, reasons, contracts, look-ups ----

_GATE = """g AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 17 <> 0 THEN 's' END AS source_file, CASE WHEN o_orderkey % 19 <> 0 THEN 'r' END AS reference_file, CASE o_orderkey % 5 WHEN 0 THEN 'INCOMPLETE' WHEN 1 THEN 'UPLOADED_LABEL' WHEN 2 THEN 'DEMO' WHEN 3 THEN 'NOT_PROVIDED' ELSE 'CATALOG_METADATA' END AS source_status,
 CASE WHEN o_orderkey % 13 = 0 THEN 'INCOMPLETE' ELSE 'UPLOADED_LABEL' END AS reference_status, CASE WHEN o_orderkey % 7 = 0 THEN 'PARTIAL' WHEN o_orderkey % 7 = 1 THEN NULL ELSE 'READY' END AS source_decoding, 'READY' AS reference_decoding, CASE WHEN o_orderkey % 11 = 0 THEN 'NOT_PROVIDED' ELSE 'VALID' END AS source_projection, 'VALID' AS reference_projection,
 CASE o_orderkey % 4 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'MISMATCH' END AS id_status, CASE WHEN o_orderkey % 3 = 0 THEN 'PENDING' ELSE 'VALID' END AS pair_status, CASE o_orderkey % 6 WHEN 0 THEN 'LRO_PDS3_BINARY' WHEN 1 THEN 'SCIENTIFIC_BINARY' WHEN 2 THEN NULL ELSE 'GEOTIFF' END AS reference_type, CASE WHEN o_orderkey % 9 > 0 THEN o_orderkey % 9 - 1 END AS reference_lines FROM orders)"""


@query(f"""WITH {_GATE} SELECT id, source_file IS NOT NULL AND reference_file IS NOT NULL AND source_status NOT IN ('INCOMPLETE', 'NOT_PROVIDED') AND reference_status NOT IN ('INCOMPLETE', 'NOT_PROVIDED') AND coalesce(source_decoding = 'READY', false)
 AND reference_decoding = 'READY' AND source_projection = 'VALID' AND reference_projection = 'VALID' AND coalesce(id_status, '') <> 'MISMATCH' AND pair_status = 'VALID' AS scientific_ready,
 source_file IS NOT NULL AND reference_file IS NOT NULL AND (coalesce(reference_type, '') NOT IN ('LRO_PDS3_BINARY', 'SCIENTIFIC_BINARY') OR coalesce(reference_lines, 0) > 0) AS image_only_ready FROM g""")
def run_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pick = lambda n, *names: F.element_at(F.array(*[F.lit(x) for x in names]), (k % n + 1).cast("int"))
    rows = roles.table(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 17 != 0, "s").alias("source_file"), F.when(k % 19 != 0, "r").alias("reference_file"), pick(5, "INCOMPLETE", "UPLOADED_LABEL", "DEMO", "NOT_PROVIDED", "CATALOG_METADATA").alias("source_status"), F.when(k % 13 == 0, "INCOMPLETE").otherwise("UPLOADED_LABEL").alias("reference_status"),
        pick(7, "PARTIAL", None, *["READY"] * 5).alias("source_decoding"), F.lit("READY").alias("reference_decoding"), F.when(k % 11 == 0, "NOT_PROVIDED").otherwise("VALID").alias("source_projection"), F.lit("VALID").alias("reference_projection"), pick(4, "VERIFIED", "MISMATCH", None, None).alias("id_status"),
        F.when(k % 3 == 0, "PENDING").otherwise("VALID").alias("pair_status"), pick(6, "LRO_PDS3_BINARY", "SCIENTIFIC_BINARY", None, *["GEOTIFF"] * 3).alias("reference_type"), F.when(k % 9 > 0, k % 9 - 1).alias("reference_lines"),
    )
    return rows.select("id", S.scientific_ready().alias("scientific_ready"), S.image_only_ready().alias("image_only_ready"))


@query("""WITH s AS (SELECT o_orderkey AS id, ['VALID', 'REJECTED', 'INSUFFICIENT_OVERLAP', 'PENDING'][o_orderkey % 4 + 1] AS status, CASE WHEN o_orderkey % 8 = 3 THEN 'PENDING' ELSE 'AVAILABLE' END AS s, CASE WHEN o_orderkey % 16 = 3 THEN 'UNAVAILABLE' ELSE 'AVAILABLE' END AS r, (o_orderkey % 997) / 7.0::DOUBLE AS pct, (o_orderkey % 89) / 13.0::DOUBLE AS area FROM orders)
SELECT id, CASE WHEN status = 'PENDING' AND (s <> 'AVAILABLE' OR r <> 'AVAILABLE') THEN 'waiting for the ' || concat_ws(' and ', CASE WHEN s <> 'AVAILABLE' THEN 'source footprint' END, CASE WHEN r <> 'AVAILABLE' THEN 'reference footprint' END)
 WHEN status = 'REJECTED' THEN 'the footprints don''t overlap; nothing was matched' WHEN status = 'INSUFFICIENT_OVERLAP' THEN printf('overlap is %.3f%% of the smaller footprint, at least %.3f%% is needed', pct, 0.1::DOUBLE)
 WHEN status = 'VALID' THEN printf('overlap is %.3f%% of the smaller footprint, %.6f square degrees', pct, area) ELSE 'the overlap isn''t evaluated yet' END AS reason,
 CASE status WHEN 'VALID' THEN 'Valid' WHEN 'REJECTED' THEN 'Rejected' WHEN 'INSUFFICIENT_OVERLAP' THEN 'Too little overlap' ELSE 'Pending' END AS label, CASE status WHEN 'VALID' THEN 'ok' WHEN 'PENDING' THEN 'warning' ELSE 'error' END AS display FROM s""")
def pair_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*[F.lit(x) for x in ("VALID", "REJECTED", "INSUFFICIENT_OVERLAP", "PENDING")]), (k % 4 + 1).cast("int"))
    ends = F.when(k % 8 == 3, "PENDING").otherwise("AVAILABLE"), F.when(k % 16 == 3, "UNAVAILABLE").otherwise("AVAILABLE")
    reason = T.pair_reason(status, *ends, (k % 997) / 7.0, F.lit(0.1), (k % 89) / 13.0)
    record = T.status_record(status)
    return roles.table(spark, sf_dir, "orders").select(k.alias("id"), reason.alias("reason"), record["label"].alias("label"), record["display"].alias("display"))


@query("""WITH c AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 10 > 0 THEN p_size END AS lines, CAST(p_partkey % 7 * 10 AS INTEGER) AS samples, CASE WHEN p_partkey % 4 = 0 THEN 16 ELSE 8 END AS bits, CASE WHEN p_partkey % 9 > 0 THEN 'uint8' END AS dtype, CASE WHEN p_partkey % 11 > 0 THEN p_partkey % 3 * 100 END AS off FROM part),
w AS (SELECT *, CASE WHEN lines > 0 AND samples > 0 THEN CAST(lines AS BIGINT) * samples * bits // 8 END AS want FROM c), z AS (SELECT *, coalesce(want, 50) + coalesce(off, 0) + (id % 3 - 1) AS size FROM w)
SELECT id, CASE WHEN lines > 0 AND samples > 0 THEN lines || ' x ' || samples END AS dimensions, want AS expected_payload_bytes, CASE WHEN want IS NULL THEN 'UNKNOWN' WHEN id % 3 = 1 THEN 'VERIFIED' WHEN id % 3 = 0 THEN 'MISMATCH' ELSE 'PARTIAL' END AS size_status,
 concat_ws(',', CASE WHEN want IS NULL THEN 'dimensions' END, CASE WHEN dtype IS NULL THEN 'sample_type' END, CASE WHEN off IS NULL THEN 'image_offset' END) AS missing, want IS NOT NULL AND dtype IS NOT NULL AND off IS NOT NULL AS resolved,
 CASE WHEN want IS NULL OR dtype IS NULL OR off IS NULL THEN 'PENDING_METADATA' WHEN id % 3 = 0 THEN 'MISMATCH' WHEN id % 5 = 0 THEN 'FAILED' WHEN id % 3 = 2 THEN 'PARTIAL' ELSE 'READY' END AS readiness FROM z""")
def raster_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = roles.table(spark, sf_dir, "part").select(
        k.alias("id"), F.when(k % 10 > 0, F.col("p_size")).alias("lines"), (k % 7 * 10).cast("int").alias("samples"), F.when(k % 4 == 0, 16).otherwise(8).alias("sample_bits"), F.when(k % 9 > 0, "uint8").alias("dtype"), F.when(k % 11 > 0, k % 3 * 100).alias("image_offset"),
        F.lit(None).cast("int").alias("record_bytes"), F.lit(None).cast("int").alias("image_pointer"), F.lit(None).cast("string").alias("image_pointer_unit"),
    )
    sized = rows.withColumn("length", F.coalesce(R.payload(F.col("lines"), F.col("samples"), F.col("sample_bits")), F.lit(50)) + F.coalesce(F.col("image_offset"), F.lit(0)) + (F.col("id") % 3 - 1))
    ready = R.readiness(F.lit("SCIENTIFIC_BINARY"), F.col("size_status"), F.col("missing"), F.col("id") % 5 != 0)
    return R.contract(sized).select("id", "dimensions", "expected_payload_bytes", "size_status", F.array_join("missing", ",").alias("missing"), "resolved", ready.alias("readiness"))


@query(f"WITH {roles.IMAGE} SELECT product_id, max(line) + 1 AS lines, max(sample) + 1 AS samples, min(value) AS least, max(value) AS largest, round(avg(value), 6) AS mean FROM image GROUP BY product_id")
def display_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.display_stats(_dense(spark, sf_dir)), 6, "mean")


@query(f"""WITH {roles.POINTS}, {roles.IMAGE}, k AS (SELECT CAST(line % 3 AS BIGINT) AS pair_id, CAST(line // 3 AS INTEGER) AS line, sample, valid FROM image), e AS (SELECT pair_id, max(line) AS ml, max(sample) AS ms FROM k GROUP BY pair_id),
p AS (SELECT p.pair_id, p.id, e.pair_id IS NULL AS free, greatest(0, least(ml, CAST(round_even(sy, 0) AS INTEGER))) AS l, greatest(0, least(ms, CAST(round_even(sx * 1.5, 0) AS INTEGER))) AS s FROM points p LEFT JOIN e ON e.pair_id = p.pair_id)
SELECT p.pair_id AS pair_id, id, free OR coalesce(valid, false) AS s_valid FROM p LEFT JOIN k ON k.pair_id = p.pair_id AND k.line = l AND k.sample = s""")
def mask_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = roles.image(spark, sf_dir).select((F.col("line") % 3).cast("long").alias("pair_id"), F.floor(F.col("line") / 3).cast("int").alias("line"), "sample", "valid")
    points = roles.points(spark, sf_dir).withColumn("sx", F.col("sx") * 1.5)
    return P.on_mask(points, mask, "sx", "sy", "s_valid").select("pair_id", "id", "s_valid")


@query("""SELECT n_name AS path, CAST(n_nationkey + 1 AS INTEGER) AS lines, CAST(n_nationkey * 2 AS INTEGER) AS samples, CASE WHEN n_nationkey % 2 = 0 THEN 3 END AS bands, CAST(800.5 + n_nationkey AS DOUBLE) AS wavelength_min, CAST(1000.0 + n_nationkey AS DOUBLE) AS wavelength_max FROM nation""")
def header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    text = F.concat(F.lit("ENVI\nsamples = "), k * 2, F.lit("\nLines   = "), k + 1, F.when(k % 2 == 0, "\nbands = 3").otherwise(""), F.lit("\nwavelength = {\n "), 800.5 + k, F.lit(", "), 1000.0 + k, F.lit(",\n "), 900.25 + k, F.lit("}\n"))
    return L.parse_headers(roles.table(spark, sf_dir, "nation").select(F.col("n_name").alias("path"), text.alias("text"))).drop("wavelengths")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500")
def preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 of a table in its order; the limit is the feature."""
    o = roles.table(spark, sf_dir, "orders").withColumn("rank", -F.col("o_totalprice"))
    return K.preview(o, ["rank", "o_orderkey"]).select("o_orderkey", "o_totalprice")


# ---- labels that need each fall-back ----


def _fallback_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    line = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts], F.lit("\n"))
    pick = lambda n, *texts: F.element_at(F.array(*[line(t) if isinstance(t, str) else line(*t) for t in texts]), (k % n + 1).cast("int"))
    sides = ("UPPER_LEFT", "UPPER_RIGHT", "LOWER_RIGHT", "LOWER_LEFT")
    named = F.concat(*[line(f"{n}_LATITUDE = -", (k % 80 + 1 + i).cast("string")) for i, n in enumerate(sides)], *[line(f"{n}_LONGITUDE = ", (k % 300 + i).cast("string"), " <DEG>") for i, n in enumerate(sides)])
    numbered = F.concat(*[line(f"CORNER{i + 1}_LATITUDE = -", (k % 80 + 1 + i).cast("string")) for i in range(4)], *[line(f"CORNER{i + 1}_LONGITUDE = ", (k % 300 + i).cast("string")) for i in range(4)])
    box = F.concat(line("MAXIMUM_LATITUDE = ", (k % 80 + 1).cast("string")), line("MINIMUM_LATITUDE = -", (k % 80 + 1).cast("string")), line("WESTERNMOST_LONGITUDE = 10"), line("EASTERNMOST_LONGITUDE = 20.5"))
    corners = F.when(k % 4 == 0, F.concat(named, box)).when(k % 4 == 1, F.concat(numbered, box)).when(k % 4 == 2, box).otherwise("")
    text = F.concat(
        F.lit("PDS_VERSION_ID = PDS3\n"), line("PRODUCT_ID = 'P", k.cast("string"), "'"), line("product_id = \"later\""), pick(2, 'INSTRUMENT_ID = "LROC"', 'INSTRUMENT_NAME = "NARROW CAMERA"'), pick(3, "INSTRUMENT_HOST_NAME = LRO", "MISSION_NAME = M2", "NOTE = none"),
        pick(2, "TARGET = MOON", "TARGET_NAME = MOON\nTARGET = OTHER"), line("  Record_Bytes = 100"), pick(3, "^IMAGE = 3", '^IMAGE = ("F.IMG", 5)', "^IMAGE = 1000 <BYTES>"), pick(2, "SAMPLE_TYPE = UNSIGNED_INTEGER\nSAMPLE_BITS = 16\nMSB = MSB", "SAMPLE_TYPE = IEEE_REAL\nSAMPLE_BITS = 32\nBYTE_ORDER = LSB"),
        pick(2, "LINE_PREFIX_BYTES = 0\nLINE_PREFIX = 4", "LINE_PREFIX_BYTES = 8"), pick(3, "SCALED_PIXEL_WIDTH = 0\nRESOLUTION = 2.5 <METERS/PIXEL>", "SCALED_PIXEL_WIDTH = 1.25", "RESOLUTION = 0"), pick(2, "SUB_SOLAR_AZIMUTH = 12.5", "SOLAR_AZIMUTH = 13.5"), pick(2, "ALTITUDE = 50.5 <KM>", "SPACECRAFT_ALTITUDE = 60.5 <KM>\nALTITUDE = 1"), corners,
    )
    return roles.table(spark, sf_dir, "part").select(k.cast("string").alias("path"), text.alias("text"))


_CORNER_SQL = ", ".join(
    f"CAST(CASE k % 4 WHEN 0 THEN -(k % 80 + 1 + {i}) WHEN 1 THEN -(k % 80 + 1 + {i}) WHEN 2 THEN {'' if c[0] == 'u' else '-'}(k % 80 + 1) END AS DOUBLE) AS {c}_lat, CAST(CASE WHEN k % 4 < 2 THEN k % 300 + {i} WHEN k % 4 = 2 THEN {10 if c[1] == 'l' else 20.5} END AS DOUBLE) AS {c}_lon"
    for i, c in enumerate(("ul", "ur", "lr", "ll"))
)


@query(f"""WITH p AS (SELECT p_partkey AS k FROM part) SELECT CAST(k AS VARCHAR) AS path, 'P' || k AS product_id, CASE k % 2 WHEN 0 THEN 'LROC' ELSE 'NARROW CAMERA' END AS instrument, CASE k % 3 WHEN 0 THEN 'LRO' WHEN 1 THEN 'M2' END AS mission, 'MOON' AS target, CAST(100 AS INTEGER) AS record_bytes,
 CAST(CASE k % 3 WHEN 0 THEN 3 WHEN 1 THEN 5 ELSE 1000 END AS BIGINT) AS image_pointer, CASE WHEN k % 3 = 2 THEN 'BYTES' ELSE 'RECORDS' END AS image_pointer_unit, CAST(CASE k % 3 WHEN 0 THEN 200 WHEN 1 THEN 400 ELSE 1000 END AS BIGINT) AS image_offset, CASE k % 2 WHEN 0 THEN '>u2' ELSE '<f4' END AS dtype,
 CAST(CASE k % 2 WHEN 0 THEN 4 ELSE 8 END AS INTEGER) AS line_prefix_bytes, CAST(CASE k % 3 WHEN 0 THEN 2.5 WHEN 1 THEN 1.25 END AS DOUBLE) AS gsd_m_per_pixel, CAST(CASE k % 2 WHEN 0 THEN 12.5 ELSE 13.5 END AS DOUBLE) AS sun_azimuth_deg, CAST(CASE k % 2 WHEN 0 THEN 50.5 ELSE 60.5 END AS DOUBLE) AS altitude_km, {_CORNER_SQL} FROM p""")
def label_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.parse_keyword_labels(_fallback_labels(spark, sf_dir))
    return out.select("path", "product_id", "instrument", "mission", "target", "record_bytes", "image_pointer", "image_pointer_unit", F.col("image_offset").cast("long").alias("image_offset"), "dtype", "line_prefix_bytes", "gsd_m_per_pixel", "sun_azimuth_deg", "altitude_km", *[f"{c}_{a}" for c in L.CORNERS for a in ("lat", "lon")])


def _fallback_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    n = k.cast("string")
    put = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    pick = lambda m, *texts: F.element_at(F.array(*[put(t) if isinstance(t, str) else put(*t) for t in texts]), (k % m + 1).cast("int"))
    gsd = pick(
        6, "<pixelResolution>0.5 m/pixel</pixelResolution><pixel_size_x>9</pixel_size_x>", "<pixel_size_x>2</pixel_size_x><pixel_size_y>4</pixel_size_y>", "<comment>Images of 7.5 meter resolution.</comment>",
        "<spacecraft_altitude>100 km</spacecraft_altitude><focal_length>140</focal_length><detector_pixel_width>7</detector_pixel_width>", "<x_min>0</x_min><x_max>640</x_max><y_min>-100</y_min><y_max>900</y_max>", "<title>none</title>",
    )
    axes = pick(
        3, "<Axis_Array><axis_name>Line</axis_name><elements>100</elements></Axis_Array><Axis_Array><axis_name>Sample</axis_name><elements>64</elements></Axis_Array>",
        '<Axis axis_name="line" elements="100"/><Axis axis_name="sample" elements="64"/>', "<imageHeight>100</imageHeight><image_width>64</image_width>",
    )
    sides = ("upper_left", "upper_right", "lower_left", "lower_right")
    named = F.concat(*[put(f"<{c}_latitude>-", (k % 80 + 1 + i).cast("string"), f"</{c}_latitude><{c}_longitude>", (k % 300 + i).cast("string"), f"</{c}_longitude>") for i, c in enumerate(sides)])
    numbered = F.concat(*[put(f"<Corner{i + 1}>-", (k % 80 + 1 + i).cast("string"), ", ", (k % 300 + i).cast("string"), f"</Corner{i + 1}>") for i in (2, 0, 3, 1)])
    box = put("<west_bounding_coordinate>10</west_bounding_coordinate><east_bounding_coordinate>20.5</east_bounding_coordinate><south_bounding_coordinate>-", (k % 80 + 1).cast("string"), "</south_bounding_coordinate><north_bounding_coordinate>", (k % 80 + 1).cast("string"), "</north_bounding_coordinate>")
    corners = F.when(k % 4 == 0, F.concat(box, named)).when(k % 4 == 1, F.concat(box, numbered)).when(k % 4 == 2, box).otherwise("")
    who = pick(2, "<Observing_System_Component><type>Instrument</type><name>orbiter high resolution camera</name></Observing_System_Component>", '<Observing_System_Component type="Spacecraft"><name>x</name></Observing_System_Component><instrumentName>terrain mapping camera</instrumentName>')
    text = F.concat(put('<p xmlns="urn:a" xmlns:b="urn:b"><b:productId>', n, "</b:productId>"), who, put("<Investigation_Area><name>M", n, "</name></Investigation_Area><orbitNumber>"), (k % 900).cast("string"), F.lit(".9</orbitNumber>"), gsd, axes, corners, F.lit("</p>"))
    return roles.table(spark, sf_dir, "part").select(n.alias("path"), F.when(k % 50 == 0, F.lit("<p><broken></p>")).otherwise(text).alias("text"))


_XML_CORNERS = ", ".join(
    f"CAST(CASE WHEN k % 50 = 0 THEN NULL WHEN k % 4 < 2 THEN -(k % 80 + 1 + {i}) WHEN k % 4 = 2 THEN {'' if c[0] == 'u' else '-'}(k % 80 + 1) END AS DOUBLE) AS {c}_lat, CAST(CASE WHEN k % 50 = 0 THEN NULL WHEN k % 4 < 2 THEN k % 300 + {i} WHEN k % 4 = 2 THEN {10 if c[1] == 'l' else 20.5} END AS DOUBLE) AS {c}_lon"
    for c, i in (("ul", 0), ("ur", 1), ("ll", 2), ("lr", 3))
)


@query(f"""WITH p AS (SELECT p_partkey AS k, p_partkey % 50 <> 0 AS ok FROM part) SELECT CAST(k AS VARCHAR) AS path, CASE WHEN ok THEN CAST(k AS VARCHAR) END AS product_id, CASE WHEN ok THEN CASE k % 2 WHEN 0 THEN 'orbiter high resolution camera' ELSE 'terrain mapping camera' END END AS instrument,
 CASE WHEN NOT ok THEN 'Unknown' WHEN k % 2 = 0 THEN 'OHRC' ELSE 'TMC' END AS sensor_type, CASE WHEN ok THEN 'M' || k END AS mission, CASE WHEN ok THEN CAST(k % 900 AS INTEGER) END AS orbit_number, CASE WHEN ok THEN CAST(100 AS INTEGER) END AS lines, CASE WHEN ok THEN CAST(64 AS INTEGER) END AS samples,
 CAST(CASE WHEN ok THEN CASE k % 6 WHEN 0 THEN 0.5 WHEN 1 THEN 3 WHEN 2 THEN 7.5 WHEN 3 THEN 5 WHEN 4 THEN 10 END END AS DOUBLE) AS gsd_m_per_pixel, CASE WHEN ok THEN CASE k % 6 WHEN 0 THEN 'tag' WHEN 1 THEN 'pixel_size' WHEN 2 THEN 'comment' WHEN 3 THEN 'optics' WHEN 4 THEN 'extent' END END AS gsd_source,
 NOT ok AS failed, {_XML_CORNERS} FROM p""")
def xml_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.parse_xml_labels(_fallback_xml(spark, sf_dir))
    return out.select("path", "product_id", "instrument", "sensor_type", "mission", "orbit_number", "lines", "samples", "gsd_m_per_pixel", "gsd_source", F.col("error_message").isNotNull().alias("failed"), *[f"{c}_{a}" for c in L.CORNERS for a in ("lat", "lon")])
