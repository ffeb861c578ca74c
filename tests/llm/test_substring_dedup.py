import hashlib
import random

import numpy as np
import pytest

from framealign.llm import substring_dedup as S

K = S.LENGTH


def brute(rows):
    seen = {}
    texts = [(t or "").encode() for _, t in rows]
    for d, t in enumerate(texts):
        for i in range(len(t) - K + 1):
            seen.setdefault(t[i : i + K], []).append((d, i))
    gone = [np.zeros(len(t), bool) for t in texts]
    for held in seen.values():
        if len(held) > 1:
            for d, i in held:
                gone[d][i : i + K] = True
    out = []
    for (doc, _), t, g in zip(rows, texts, gone):
        kept = bytes(b for b, x in zip(t, g) if not x)
        n_spans = int(np.sum(np.diff(np.r_[0, g.astype(int)]) == 1))
        out.append((doc, len(t), int(g.sum()), n_spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    syl = ["ab", "cé", "do", "en ", "fu ", "ga", " hi", "\n"]
    make = lambda n: "".join(rng.choice(syl) for _ in range(n))
    passages = [make(rng.choice([60, 90, 110, 200, 400])) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.choice([1, 2, 4])):
            parts.append(make(rng.choice([3, 40, 150])))
            if rng.random() < 0.7:
                p = rng.choice(passages)
                cut = rng.randrange(len(p) // 2)
                parts.append(p[cut : len(p) - rng.randrange(len(p) // 3)])
        texts.append("".join(parts))
    base = make(500)
    for _ in range(20):  # near copies
        t = list(base)
        for _ in range(rng.choice([1, 3, 6])):
            t[rng.randrange(len(t))] = "X"
        texts.append("".join(t))
    texts += [make(30) + "du " * 120 + make(10), "du " * 300, "du " * 67, "a" * 199, "a" * 200, "b" * 201, "b" * 200, None, "", "short", "short", base, base, "xyz" * 3000, make(4000)]
    texts.append(texts[-1][:250] + texts[-1][100:900])
    return [(i if i % 17 else None, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,most", [(1, 1 << 15), (2, 1 << 15), (3, 3)])
def test_against_brute_force(spark, seed, most):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, uid string, anchors int").repartition(3)
    got = sorted(map(tuple, S.dedup_substrings(df, most).collect()), key=repr)
    assert got == brute(rows)


def test_empty_table(spark):
    assert S.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_merge_sort_orders_within_groups():
    rng = random.Random(4)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(500)]
    groups = np.sort(np.array([rng.randrange(9) for _ in strings]))
    order = S.merge_sorted(S.Suffixes(strings), groups)
    want = sorted(range(len(strings)), key=lambda i: (groups[i], strings[i], i))
    assert order.tolist() == want


def test_collisions_of_hashes_are_found_by_bytes(monkeypatch):
    monkeypatch.setattr(S.Prefixes, "of", lambda self, start, size: np.zeros(len(start), np.uint64))
    left = [b"l" * 160, b"l" * 160, b"m" * 160]
    right = [b"r" * 200, b"r" * 150 + b"q" * 50, b"s" * 200]
    before, after = S.reach(np.zeros(3, np.int64), left, right)
    assert before.tolist() == [160, 160, -1] and after.tolist() == [150, 150, -1]


def test_removed_runs_that_touch_are_one():
    assert S.remove(b"0123456789", [(5, 7), (2, 5), (8, 9), (3, 4)]) == (b"0179", 6, 2)
