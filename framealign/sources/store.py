"""Results of runs as files: partitioned Parquet by pair, CSV of correspondences, JSON reports, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def save_experiment(rows: DataFrame, path: str) -> None:
    """Rows (pair_id, ...) under a folder per pair; pairs that come again replace theirs and leave the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pair_id").parquet(path)


def save_run(parts: dict[str, DataFrame], path: str) -> None:
    """The parts of runs (metadata, config, metrics ...; each with pair_id) as JSON, each under its own folder and a folder per pair."""
    for name, rows in parts.items():
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false").partitionBy("pair_id").json(f"{path}/{name}")


def load_run(spark: SparkSession, path: str, name: str, schema: str, pair_id) -> DataFrame:  # noqa: ANN001
    """One part of a pair's run; only its folder is read."""
    return spark.read.schema(schema).json(f"{path}/{name}").filter(F.col("pair_id") == pair_id)


def list_experiments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("pair_id").distinct().orderBy("pair_id")


def load_experiment(spark: SparkSession, path: str, pair_id) -> DataFrame:  # noqa: ANN001
    """One pair's rows (none if it isn't there); only its folder is read."""
    return spark.read.parquet(path).filter(F.col("pair_id") == pair_id)


def write_correspondences(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def report_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def preview(rows: DataFrame, order: list[str], n: int = 500) -> DataFrame:
    """The first rows in selection order; the limit is the feature."""
    return rows.orderBy(*order).limit(n)
