"""The driver's tables in the roles of the engine's own: keypoints, points, cubes, footprints, labels. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keypoints(spark: SparkSession, sf_dir: str, odd: int) -> DataFrame:
    """Embeddings of even (source) or odd (reference) ids as descriptors of one pair."""
    e = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") % 2 == odd)
    return e.select(F.lit(1).cast("long").alias("pair_id"), F.col("vec_id").alias("kp_id"), F.col("embedding").alias("descriptor"))


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as matches of several runs: a run per return flag, a pair per 100 orders."""
    line = table(spark, sf_dir, "lineitem")
    run = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return line.select(
        F.floor(F.col("l_orderkey") / 100).cast("long").alias("pair_id"), F.col("l_returnflag").alias("method"), run.alias("run_ord"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("row_ord"),
        F.col("l_quantity").cast("double").alias("sx"), (F.col("l_discount").cast("double") * 100).alias("sy"), F.col("l_linenumber").cast("double").alias("rx"), (F.col("l_tax").cast("double") * 100).alias("ry"), F.col("l_extendedprice").cast("double").alias("score"),
    )


MATCHES = """matches AS (SELECT CAST(floor(l_orderkey / 100.0) AS BIGINT) AS pair_id, l_returnflag AS method, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS run_ord, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS row_ord,
 CAST(l_quantity AS DOUBLE) AS sx, CAST(l_discount AS DOUBLE) * 100 AS sy, CAST(l_linenumber AS DOUBLE) AS rx, CAST(l_tax AS DOUBLE) * 100 AS ry, CAST(l_extendedprice AS DOUBLE) AS score FROM lineitem)"""


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a cube: band by line number, pixel by order, two products; some values unusable."""
    line = table(spark, sf_dir, "lineitem")
    v = F.col("l_extendedprice").cast("double")
    return line.select(
        (F.col("l_orderkey") % 2).cast("long").alias("product_id"), F.col("l_linenumber").cast("int").alias("band"), F.floor(F.col("l_orderkey") / 64).cast("int").alias("line"), (F.col("l_orderkey") % 64).cast("int").alias("sample"),
        F.when(F.col("l_partkey") % 11 == 0, -9999.0).otherwise(v).alias("value"),
    )


CUBE = """raw AS (SELECT CAST(l_orderkey % 2 AS BIGINT) AS product_id, CAST(l_linenumber AS INTEGER) AS band, CAST(floor(l_orderkey / 64.0) AS INTEGER) AS line, CAST(l_orderkey % 64 AS INTEGER) AS sample,
 CASE WHEN l_partkey % 11 = 0 THEN -9999.0 ELSE CAST(l_extendedprice AS DOUBLE) END AS value FROM lineitem),
cube AS (SELECT *, value > -1e4 AND value < 1e6 AND value <> -9999.0 AS valid FROM raw)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of line items as points of a pair, with nothing rounded."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        (F.col("l_suppkey") % 7).cast("long").alias("pair_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("id"), F.col("l_quantity").cast("double").alias("sx"), (F.col("l_partkey") % 101).cast("double").alias("sy"),
        (F.col("l_quantity").cast("double") + F.col("l_tax").cast("double") * 10).alias("rx"), ((F.col("l_partkey") % 101).cast("double") + F.col("l_discount").cast("double") * 10).alias("ry"),
    )


POINTS = """points AS (SELECT CAST(l_suppkey % 7 AS BIGINT) AS pair_id, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS id, CAST(l_quantity AS DOUBLE) AS sx, CAST(l_partkey % 101 AS DOUBLE) AS sy,
 CAST(l_quantity AS DOUBLE) + CAST(l_tax AS DOUBLE) * 10 AS rx, CAST(l_partkey % 101 AS DOUBLE) + CAST(l_discount AS DOUBLE) * 10 AS ry FROM lineitem)"""

#: A transform with a slight perspective.
H = (1.01, 0.02, 0.3, -0.015, 0.99, 0.2, 0.0001, -0.0002, 1.0)


def footprints(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """Customers or suppliers as boxes on a grid of degrees."""
    k = F.col(key)
    a, b = (k * 37 % 160 - 80).cast("double"), (k * 91 % 340).cast("double")
    return table(spark, sf_dir, name).select(k.cast("long").alias("id"), a.alias("min_a"), (a + 1 + k % 4).alias("max_a"), b.alias("min_b"), (b + 1 + k % 5).alias("max_b"))


def footprints_sql(name: str, key: str) -> str:
    return f"SELECT CAST({key} AS BIGINT) AS id, CAST({key} * 37 % 160 - 80 AS DOUBLE) AS min_a, CAST({key} * 37 % 160 - 80 AS DOUBLE) + 1 + {key} % 4 AS max_a, CAST({key} * 91 % 340 AS DOUBLE) AS min_b, CAST({key} * 91 % 340 AS DOUBLE) + 1 + {key} % 5 AS max_b FROM {name}"


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a picture 64 pixels wide, by the place of the key."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.lit(0).cast("long").alias("product_id"), F.floor(F.col("o_orderkey") / 64).cast("int").alias("line"), (F.col("o_orderkey") % 64).cast("int").alias("sample"), (F.floor(F.col("o_totalprice").cast("double")) % 256).cast("double").alias("value"), (F.col("o_custkey") % 13 != 0).alias("valid"))


IMAGE = """image AS (SELECT CAST(0 AS BIGINT) AS product_id, CAST(floor(o_orderkey / 64.0) AS INTEGER) AS line, CAST(o_orderkey % 64 AS INTEGER) AS sample, CAST(floor(CAST(o_totalprice AS DOUBLE)) % 256 AS DOUBLE) AS value, o_custkey % 13 <> 0 AS valid FROM orders)"""


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customers as metadata rows in which fields are missing now and then."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    opt = lambda n, v: F.when(k % n != 0, v)
    num = lambda n: opt(n, (k % 90).cast("double"))
    corners = {f"{c}_{a}": opt(31, (k % 60).cast("double")) for c in ("ul", "ur", "lr", "ll") for a in ("lat", "lon")}
    return j.select(
        k.cast("long").alias("product_id"), F.when(k % 5 == 0, "Unknown").when(k % 3 == 0, "LROC_NAC").otherwise("OHRC").alias("sensor_type"), opt(10, F.col("c_mktsegment")).alias("instrument"), opt(17, F.col("o_orderpriority")).alias("processing_level"),
        opt(19, F.col("o_orderdate").cast("string")).alias("start_time"), opt(23, F.col("o_orderdate").cast("string")).alias("stop_time"), num(29).alias("altitude_km"), num(37).alias("sun_azimuth_deg"), num(37).alias("sun_elevation_deg"), num(41).alias("solar_incidence_deg"),
        num(43).alias("roll_deg"), num(43).alias("pitch_deg"), num(43).alias("yaw_deg"), opt(47, F.lit("Equirectangular")).alias("projection"), opt(53, (k % 700).cast("int")).alias("lines"), opt(53, (k % 300 + 1).cast("int")).alias("samples"), num(13).alias("gsd_m_per_pixel"),
        F.when(k % 8 == 0, "NOT_PROVIDED").when(k % 8 == 1, "DEMO").when(k % 8 == 2, "CATALOG_METADATA").when(k % 8 == 3, "ELSEWHERE").otherwise("UPLOADED_LABEL").alias("source"), *[v.alias(n) for n, v in corners.items()],
    )


def _sql_opt(n: int, v: str) -> str:
    return f"CASE WHEN o_orderkey % {n} <> 0 THEN {v} END"


METADATA = "meta AS (SELECT CAST(o_orderkey AS BIGINT) AS product_id, CASE WHEN o_orderkey % 5 = 0 THEN 'Unknown' WHEN o_orderkey % 3 = 0 THEN 'LROC_NAC' ELSE 'OHRC' END AS sensor_type, " + ", ".join(
    [f"{_sql_opt(10, 'c_mktsegment')} AS instrument", f"{_sql_opt(17, 'o_orderpriority')} AS processing_level", f"{_sql_opt(19, '1')} AS start_time", f"{_sql_opt(23, '1')} AS stop_time", f"{_sql_opt(29, '1')} AS altitude_km", f"{_sql_opt(37, '1')} AS sun",
     f"{_sql_opt(41, '1')} AS incidence", f"{_sql_opt(43, '1')} AS camera", f"{_sql_opt(47, '1')} AS projection", f"{_sql_opt(53, 'o_orderkey % 700')} AS lines", f"{_sql_opt(53, 'o_orderkey % 300 + 1')} AS samples", f"{_sql_opt(13, '1')} AS gsd", f"{_sql_opt(31, '1')} AS corners"]
) + ", CASE o_orderkey % 8 WHEN 0 THEN 'NOT_PROVIDED' WHEN 1 THEN 'DEMO' WHEN 2 THEN 'CATALOG_METADATA' WHEN 3 THEN 'ELSEWHERE' ELSE 'UPLOADED_LABEL' END AS source FROM orders JOIN customer ON o_custkey = c_custkey)"


def ring_of(t: DataFrame) -> DataFrame:
    return t.withColumn("ring", G.box(F.col("min_a"), F.col("max_a"), F.col("min_b"), F.col("max_b")))
