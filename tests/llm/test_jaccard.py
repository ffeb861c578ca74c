import random
import re

import pytest

import corpus_pipeline as P
from framealign.llm import jaccard as J


def brute_set(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(low))
    return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("frequent", [3, 1])
def test_stage_against_brute_force_jaccard(spark, monkeypatch, frequent):
    monkeypatch.setattr(J, "FREQUENT", frequent)
    monkeypatch.setattr(J, "SAMPLE", 4)
    rng = random.Random(5)
    words = ["w%d" % i for i in range(500)]
    texts = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 12, 40, 120, 300]))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):  # near copies on both sides of 0.8
            w = list(base)
            for _ in range(rng.randrange(1, 2 + len(w) // 25)):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w).upper() if rng.random() < 0.3 else "  ".join(w))
    passage = [rng.choice(words) for _ in range(100)]  # a passage in many texts, and a large group of near copies
    texts += [" ".join([*passage, *(rng.choice(words) for _ in range(rng.choice([5, 20, 25, 26, 40, 90])))]) for _ in range(40)]
    for _ in range(40):
        w = list(passage)
        w[rng.randrange(100)] = "x%d" % rng.randrange(10**6)
        texts.append(" ".join(w))
    texts += ["", " \n", None, "a b c d e", "A B\tC D e"]
    rng.shuffle(texts)
    rows = list(enumerate(texts, 7))
    docs = spark.createDataFrame([*rows, (None, texts[0]), (None, texts[0])], "doc_id long, text string")
    want = brute(rows)
    found = {r.doc_id: r.component_id for r in J.near_duplicates(docs).collect()}
    assert {d: found.get(d, d) for d, _ in rows} == want
    # in the stage rows without a doc_id are documents like others
    kept = [r.doc_id for r in P.near_dedup_filter(spark, docs, "").collect()]
    assert sorted(kept) == sorted(d for d, c in want.items() if d == c)


def test_empty_table(spark):
    assert J.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sketches_rule_out_no_similar_pair(spark):
    rng = random.Random(8)
    words = ["v%d" % i for i in range(3000)]
    ruled = []
    for _ in range(400):
        base = [rng.choice(words) for _ in range(rng.choice([1, 4, 30, 63, 64, 70, 130, 500, 1030]))]
        other = [rng.choice(words) if rng.random() < rng.choice([0.005, 0.02, 0.1]) else w for w in base] + [rng.choice(words) for _ in range(rng.randrange(1 + len(base) // 8))]
        a, b = (" ".join(x).encode() for x in (base, other))
        (i, j), (x, y) = (J._hashes(a), J._hashes(b)), (J.shingles(a), J.shingles(b))
        may = J._may_be(J._sketch(i), len(i), J._sketch(j), len(j))
        assert may == J._may_be(J._sketch(j), len(j), J._sketch(i), len(i)) and (may or not J.similar(x, y))
        ruled.append((len(x & y) / len(x | y), may))
    assert sum(s >= 0.8 for s, _ in ruled) > 50
    far = [may for s, may in ruled if s < 0.6]
    assert len(far) > 50 and sum(far) < len(far) / 20


def test_texts_are_read_of_likely_pairs_only(spark, monkeypatch):
    """Texts of pairs that share a passage, but are far from similar, were all sent to be compared."""
    rng = random.Random(9)
    words = lambda n: " ".join("u%d" % rng.randrange(10**6) for _ in range(n))
    passage = words(60)
    rows = [(k, f"{passage} {words(50)}") for k in range(60)]
    rows += [(100, rows[3][1] + " end")]
    sent = []
    rest = J._alike
    monkeypatch.setattr(J, "_alike", lambda *a: (lambda out: sent.append(out.count()) or out)(rest(*a)))
    found = {(r.doc_id, r.component_id) for r in J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(3, 3), (100, 3)} and 1 <= sum(sent) < 10


def test_one_id_with_two_texts_links_by_either(spark):
    texts = [" ".join(f"{c}{k}" for k in range(40)) for c in "ab"]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[0] + " z"), (3, texts[1] + " z")]
    assert {(r.doc_id, r.component_id) for r in J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {(1, 1), (2, 1), (3, 1)}
