import random

import pytest

import corpus_pipeline as P
from framealign.llm import quality

from test_decontaminate import brute as leaks
from test_exact_dedup import brute as copies
from test_jaccard import brute as near


@pytest.fixture
def tables(spark, tmp_path):
    rng = random.Random(9)
    words = ["w%d" % i for i in range(400)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    items = [(i, make(20)) for i in range(5)]
    docs, labels = [], []
    for i in range(240):
        kind = i % 8
        if kind == 0:
            text, good = " ".join(w.upper() + "!!" for w in make(40).split()), 0
        elif kind == 1:
            text, good = " ".join(w + "%%%" for w in make(40).split()), 0
        elif kind == 2 and i > 20:
            text, good = docs[i - 16 - i % 8 + 3][1].upper() if i % 16 == 2 else docs[i - 16 - i % 8 + 3][1], 1
        elif kind == 3 and i > 40 and i % 16 == 3:
            text, good = docs[i - 16 - 5][1] + " " + items[i % 5][1] + " tail", 1
        elif kind == 4 and i > 40:
            w = docs[i - 16][1].split()
            text, good = " ".join([*w[:-1], "changed"]), 1
        else:
            text, good = make(rng.choice([60, 150, 400])), 1
        docs.append((i, text, "en", "src%d" % (i % 3), len(text)))
        labels.append((i, good, 0))
    docs += [(1000, "", "en", "s", 0), (1001, None, None, None, None), (1002, make(6000), "de", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), items


def test_stages_against_brute_force(spark, tables):
    folder, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in P.STAGES] == ["quality_classifier", "exact_dedup", "simhash_neardup", "benchmark_decontamination", "best_fit_packing"]
    kept = docs
    for k, (_, stage) in enumerate(P.STAGES[:-1]):
        rows = [(r.doc_id, r.text) for r in kept.collect()]
        out = stage(spark, kept, folder)
        assert out.columns == docs.columns
        got = sorted(r.doc_id for r in out.collect())
        if k == 0:
            model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
            want = [r.doc_id for r in quality.score_documents(docs, model).collect() if r.score >= 0.5]
            assert not any(i % 8 < 2 and i < 240 for i in got) and sum(i % 8 > 1 for i in got if i < 240) >= 175
        elif k == 1:
            want = [r[0] for r in copies(rows) if r[3]]
        elif k == 2:
            want = [d for d, c in near(rows).items() if d == c]
        else:
            want = [r[0] for r in leaks(rows, items) if not r[2]]
        assert got == sorted(want) and len(got) < len(rows)
        kept = spark.createDataFrame(out.collect(), docs.schema)
    pieces = P.STAGES[-1][1](spark, kept, folder).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in kept.collect()}
    whole = P.run(spark, folder).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in pieces)


def test_stages_decide_by_row(spark):
    docs = spark.createDataFrame(
        [(7, "twice", 1), (7, "twice", 1), (5, "copy", 2), (5, "another one", 2), (9, "copy", 3), (None, "copy", 4), (None, "alone", 5), (None, "Alone", 5), (None, None, 6), (8, "", 7)],
        "doc_id long, text string, _row int",
    )
    kept = P.exact_dedup_filter(spark, docs, "")
    assert kept.columns == docs.columns
    texts = sorted(((r.doc_id, (r.text or "").lower()) for r in kept.collect()), key=repr)
    assert texts == sorted([(7, "twice"), (5, "another one"), (9, "copy"), (None, "alone"), (8, "")], key=repr)
    words = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(3, words, 1), (3, words + " x", 2), (None, "y " + words, 3), (None, "other text", 4), (3, "third", 5)], "doc_id long, text string, _row int")
    assert sorted(r._row for r in P.near_dedup_filter(spark, docs, "").collect()) == [1, 4, 5]


def test_empty_tables_go_through_every_stage(spark, tmp_path):
    for name, columns in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], columns).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []


def test_extra_columns_and_odd_rows_go_through_every_stage(spark, tables):
    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    from pyspark.sql import functions as F

    odd = docs.limit(60).withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") % 3 == 1, 7).otherwise(F.col("doc_id")))
    for extra in ("row", "digest", "fp", "u", "key", "kept_row", "score", "ids"):
        odd = odd.withColumn(extra, F.lit("x"))
    rows = odd.collect()
    for _, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(rows, odd.schema)
        out = stage(spark, docs, folder)
        assert out.schema.names == odd.schema.names
        rows = out.collect()
    assert rows and P.STAGES[-1][1](spark, spark.createDataFrame(rows, odd.schema), folder).count() >= len(rows)
