"""Working images: from a raster or a cube to the pictures that detectors and matchers get, for all products of a table at once.

Result: product_id, representation (intensity, local, structure, gradient), line, sample, value (0 to 255), valid; and per product the
working size, the scale back to original pixels, and a status: products that fail a check have a message and no pixels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import pixels as P
from ..operators import spectral as H
from ..session import settled

MOST_SIDE = 2048
KEY = list(P.KEY)


def working_size(height: int, width: int, most: int = MOST_SIDE) -> tuple[int, int]:
    """Lines and samples within a budget of the longer side; never enlarged."""
    factor = min(1.0, most / max(height, width, 1))
    return max(1, round(height * factor)), max(1, round(width * factor))


def to_original(height: int, width: int, rows: int, columns: int) -> list[float]:
    """The transform of working pixels to original ones, pixel centres on pixel centres."""
    sx, sy = width / max(columns, 1), height / max(rows, 1)
    return [sx, 0.0, (sx - 1) / 2, 0.0, sy, (sy - 1) / 2, 0.0, 0.0, 1.0]


def representations(pictures: DataFrame) -> DataFrame:
    """All representations of 8-bit pictures (product_id, line, sample, value, valid); values are 0 where not valid."""
    valid = pictures.select(*KEY, "valid")
    local = settled(P.equalise(pictures).join(valid, KEY))
    edges = P.gradient(local).select(*KEY, F.col("value").cast("double").alias("edge"))
    second = P.stencil(local, P.LAPLACE).select(*KEY, F.least(F.abs("lap"), F.lit(255.0)).alias("second"))
    both = local.join(edges, KEY, "left").join(second, KEY, "left").withColumns({"edge": F.coalesce("edge", F.lit(0.0)), "second": F.coalesce("second", F.lit(0.0))})
    mixed = F.bround(F.least(F.lit(255.0), F.col("edge") * 0.7 + F.col("second") * 0.3), 0)
    named = F.array(*[F.struct(F.lit(n).alias("representation"), F.when(F.col("valid"), v.cast("int")).otherwise(0).alias("value")) for n, v in (("local", F.col("value")), ("structure", mixed), ("gradient", F.col("edge")))])
    derived = both.select(*KEY, "valid", F.explode(named).alias("r")).select("product_id", "r.representation", "line", "sample", "r.value", "valid")
    return pictures.select("product_id", F.lit("intensity").alias("representation"), "line", "sample", F.when(F.col("valid"), F.col("value").cast("int")).otherwise(0).alias("value"), "valid").unionByName(derived)


def standard(pixels: DataFrame, height: int, width: int, most: int = MOST_SIDE) -> dict[str, DataFrame]:
    """pictures and status of single-band products of one size: stretch, resize by area, representations."""
    rows, columns = working_size(height, width, most)
    stretched = P.stretch(pixels)
    failed = F.max(F.col("status") != "OK")
    status = stretched.groupBy("product_id").agg(failed.alias("failed"))
    good = stretched.filter("status = 'OK'").drop("status")
    small = good if (rows, columns) == (height, width) else P.resize(good, rows, columns, "area").withColumn("value", F.col("value").cast("int"))
    return {"pictures": representations(small), "status": _status(status, F.when(F.col("failed"), "too few valid pixels or no contrast"), (height, width), (rows, columns))}


def hyperspectral(cube: DataFrame, bands: int, height: int, width: int, most: int = MOST_SIDE, mode: str = "automatic", how: str = "percentile", component: int = 1) -> dict[str, DataFrame]:
    """pictures and status of cubes of one shape: clean, validate, normalise, represent, equalise, resize, representations.

    A cube whose check says `error` fails and is dropped before anything is computed from it.
    """
    rows, columns = working_size(height, width, most)
    clean = settled(H.clean(cube))
    checked = H.validate(clean)
    good = clean.join(checked.filter("status <> 'error'").select("product_id"), "product_id", "left_semi")
    picture = H.representation(H.normalise(good, how), bands, mode, component=component)
    even = P.equalise(picture).join(picture.select(*KEY, "valid"), KEY)
    small = even
    if (rows, columns) != (height, width):
        small = P.resize(even, rows, columns, "linear").drop("valid").join(P.resize(even, rows, columns, "nearest").select(*KEY, "valid"), KEY).withColumn("value", F.bround("value", 0).cast("int"))
    return {"pictures": representations(small), "status": _status(checked.select("product_id", "valid_pct", F.col("status").alias("check")), F.when(F.col("check") == "error", "the cube has too few valid values or no range"), (height, width), (rows, columns))}


def _status(rows: DataFrame, message, size: tuple[int, int], working: tuple[int, int]) -> DataFrame:  # noqa: ANN001
    matrix = F.array(*[F.lit(v) for v in to_original(*size, *working)])
    named = rows.withColumns({"error_message": message, "lines": F.lit(working[0]), "samples": F.lit(working[1]), "to_original": matrix})
    return named.withColumn("status", F.when(F.col("error_message").isNull(), "OK").otherwise("FAILED"))
