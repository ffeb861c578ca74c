"""The corpus pipeline: quality classifier, exact dedup, near-dedup (0.8 over five-word shingles), benchmark decontamination, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. Each stage's rows are
written as Parquet and read again as the next one's docs, so a stage works on all that the one before kept, and a lost
executor costs no more than a stage's tasks. All but the last return the columns of `documents`.

Filters decide by row, not by doc_id: rows that share a doc_id, or have none, are documents of their own. A row's number is
its place in the stage's input, which both sides of a stage's join read from the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framealign.llm import common, decontaminate, exact_dedup, huffman, jaccard, packing, quality, simhash

#: A document goes if the probability of label 1 is below this: it is likelier junk than not.
LEAST_SCORE = 0.5


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column that numbers the rows, and its name, which no other column has."""
    name = "_row"
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return docs.withColumn(name, F.monotonically_increasing_id()), name


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, common.table(spark, sf_dir, "labels")), LEAST_SCORE)


def exact_dedup_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, the last of several with it."""
    rows, name = _numbered(docs)
    kept = exact_dedup.dedup_table(rows, name).filter("row = keep_row").select(F.col("row").alias("kept_row"))
    return rows.join(kept, rows[name] == kept["kept_row"], "left_semi").drop(name)


def near_dedup_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least doc_id of each component stays (rows without one come last); links are similarities of 0.8 over five-word shingles."""
    rows, name = _numbered(docs)
    found = simhash.similar_documents(rows, name)
    named = rows.select(F.col(name).alias("row"), F.col("doc_id").alias("id")).join(found, "row")
    first = named.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first")).select("component", F.col("first.row").alias("kept"))
    gone = common.cut(named.join(first, "component").filter("row <> kept").select(F.col("row").alias("gone_row")))
    gone = F.broadcast(gone) if gone.count() <= jaccard.MOST_BROADCAST else gone  # else the texts would be dealt out once more
    return rows.join(gone, rows[name] == gone["gone_row"], "left_anti").drop(name)


def decontamination_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return decontaminate.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(common.cut(packing.pieces(docs, huffman.vocabulary_path("word_bpe_49k.json"))))


STAGES = [
    ("quality_classifier", quality_filter),
    ("exact_dedup", exact_dedup_filter),
    ("simhash_neardup", near_dedup_filter),
    ("benchmark_decontamination", decontamination_filter),
    ("best_fit_packing", packed),
]

#: Fingerprints and a trained network can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
