import random
import zlib

import numpy as np

from framealign.llm import quality as Q


def corpus(n=400):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "river", "stone", "paper", "light"]
    rows, labels = [], []
    for i in range(n):
        good = i % 3 != 0
        w = [rng.choice(words) for _ in range(rng.randrange(20, 80))]
        text = " ".join(w).capitalize() + "." if good else rng.choice([" ".join(x.upper() + "!!" for x in w), " ".join(x + rng.choice(["###", "%%%"]) for x in w), " ".join(x for x in w for _ in range(9))])
        rows.append((i, text))
        labels.append((i, int(good)))
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id long, text string, score double, quality string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy_and_calibration(spark):
    rows, labels = corpus()
    docs, known = frames(spark, [*rows, (None, "alpha beta"), (9999, ""), (9998, None), (9997, "word " * 50000)], [*labels, (1, None)])
    got = Q.score_documents(docs, Q.fit(docs, known)).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 for r in got)
    truth = dict(labels)
    held = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in held]) > 0.95


def test_labels_of_held_out_rows_are_not_used(spark):
    rows, labels = corpus(200)
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    scores = []
    for some in (labels, turned):
        docs, known = frames(spark, rows, some)
        scores.append(sorted((r.doc_id, r.score) for r in Q.score_documents(docs, Q.fit(docs, known)).collect()))
    assert scores[0] == scores[1]


def test_filter_keeps_rows_and_columns(spark):
    rows, labels = corpus(200)
    docs, known = frames(spark, rows, labels)
    model = Q.fit(docs, known)
    kept = Q.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in Q.score_documents(docs, model).collect() if r.score >= 0.5}


def test_no_labels_and_empty_tables(spark):
    docs, known = frames(spark, [(1, "a b")], [(1, 1)])
    assert [r.score for r in Q.score_documents(docs, Q.fit(docs, known.limit(0))).collect()] == [0.5]
    assert Q.score_documents(docs.limit(0), Q.fit(docs.limit(0), known)).collect() == []


def test_word_vectors_do_not_depend_on_partitions(spark):
    docs, _ = frames(spark, corpus(60)[0], [(1, 1)])
    assert (Q.word_vectors(docs.repartition(1)) == Q.word_vectors(docs.repartition(4))).all()


def test_repeated_doc_ids_ties_and_a_bound(spark):
    rows, labels = corpus(120)
    docs, known = frames(spark, rows + rows[:50] + [(0, "alpha beta")] * 30, labels + [(i, 1 - y) for i, y in labels[:20]] + labels[:5])
    for most in (40, 10_000):
        got = Q.score_documents(docs, Q.fit(docs, known, most)).collect()
        assert len(got) == len(rows) + 80 and all(0 <= r.score <= 1 for r in got)
    again = Q.score_documents(docs.repartition(5), Q.fit(docs.repartition(5), known, most)).collect()
    one, two = (np.array(sorted((r.doc_id, r.score) for r in x)) for x in (got, again))
    assert np.allclose(one, two, rtol=0, atol=1e-9)


def test_scores_are_calibrated_probabilities():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 4))
    y = (rng.random(6000) < 1 / (1 + np.exp(-1.5 * x[:, 0]))).astype(float)
    p = Q.Network(x[:3000], y[:3000]).score(x[3000:])
    for low in (0.1, 0.3, 0.5, 0.7):
        some = (p >= low) & (p < low + 0.2)
        assert abs(y[3000:][some].mean() - p[some].mean()) < 0.1


def test_shapes_differ():
    words = [b"word", b"Word", b"WORD", b"word.", b"word!!", b"word##", b"w0rd", b"&&", b"Word0,"]
    assert len({Q.shape_of(w) for w in words}) == len(words) and max(map(Q.shape_of, words)) < Q.REPEAT
