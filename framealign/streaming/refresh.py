"""Products that changed: only files whose content hash is new are worked on again, as a batch or as a stream of arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

FILES = "path string, modificationTime timestamp, length long, content binary"


def changed(products: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows whose (path, content_hash) isn't among those seen."""
    return products.join(seen.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def arriving(spark: SparkSession, path: str, glob: str = "*", wait: str = "1 hour") -> DataFrame:
    """A stream of files with product type and hash; the same content at the same path comes once within the watermark."""
    raw = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).load(path)
    rows = raw.select("path", "modificationTime", "length", X.content_hash(F.col("content")).alias("content_hash"), X.product_type(F.col("path")).alias("product_type"))
    return rows.withWatermark("modificationTime", wait).dropDuplicatesWithinWatermark(["path", "content_hash"])
