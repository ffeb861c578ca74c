import random
import re

import numpy as np
import pytest

from framealign.llm import decontaminate as D

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOW))


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    for d, t in docs:
        w = words(t)
        hit, got = set(), set()
        for win, ids in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    got |= ids
        out.append((d, len(w), len(hit), sorted(str(x) for x in got if x is not None)))
    return sorted(out, key=repr)


def tables(spark):
    rng = random.Random(2)
    vocab = ["w%d" % i for i in range(12)] + ["é", "ü9"]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, make(rng.choice([10, 11, 14, 30]))) for i in range(15)] + [(90, "rare pair"), (91, "solo9"), (92, ""), (93, None), (None, make(12)), (94, "RARE, pair!")]
    docs = []
    for i in range(60):
        t = make(rng.choice([0, 5, 40, 300]))
        if rng.random() < 0.5:
            t = t + "; " + (rng.choice(items)[1] or "").upper() + "\n" + make(4)
        docs.append((i, t))
    docs += [(100, None), (101, "rare   PAIR rare pair"), (102, "solo9"), (None, items[0][1]), (103, (items[1][1] + " ") * 400)]
    a = spark.createDataFrame([(*d, 1, "q") for d in docs], "doc_id long, text string, n_hit int, items string").repartition(3)
    b = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    return docs, items, a, b


@pytest.mark.parametrize("shard,block", [(16_000_000, 8_000_000), (500, 8_000_000), (16_000_000, 300)])
def test_against_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(D, "SHARD_BYTES", shard)
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    docs, items, a, b = tables(spark)
    rows = D.find_leaks(a, b).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r.items)) for r in rows), key=repr) == brute(docs, items)
    texts = {d: t or "" for d, t in docs}
    for r in rows:  # cutting the spans removes the hit words and no others
        left = D.without_spans(texts[r.doc_id], [(s.start, s.end) for s in r.spans])
        assert len(words(left)) <= r.n_words - r.n_hit
        assert sum(len(words(texts[r.doc_id][s.start : s.end])) for s in r.spans) == r.n_hit
    kept = D.keep_clean(a, b)
    assert kept.columns == a.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((x[0] for x in brute(docs, items) if not x[2]), key=repr)


def test_empty_tables(spark):
    _, _, a, b = tables(spark)
    assert D.find_leaks(a.limit(0), b).collect() == []
    assert all(r.n_hit == 0 and r.items == [] for r in D.find_leaks(a, b.limit(0)).collect())


def test_index_finds_all_occurrences():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 4, 2000)
    text[0] = text[-1] = 0
    index = D.FMIndex(text, 3)
    rows = np.array([[1, 2, 3, 0], [2, 2, 0, 0], [3, 0, 0, 0], [1, 1, 1, 1]])
    sizes = np.array([3, 2, 1, 4])
    lo, hi = index.search(rows, sizes)
    for r, n, a, b in zip(rows, sizes, lo, hi):
        want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == r[:n]).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want
