"""Session helper for scripts and tests; operators take whatever session their input has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with adaptive execution; `conf` uses `__` for dots."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("framealign")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def settled(df: DataFrame) -> DataFrame:
    """A table that several later steps read: a reliable checkpoint where spark.checkpoint.dir is set, else kept in memory and on disk."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return df.persist()
    if folder and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
