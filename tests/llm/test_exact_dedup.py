import hashlib

import numpy as np
import pytest

from framealign.llm import exact_dedup as X

AWKWARD = [
    (1, "Same Text"), (2, "same text"), (3, "SAME TEXT"), (4, None), (5, ""), (6, "Ä x"), (7, "ä x"),
    (8, "long " * 60000), (9, "LONG " * 60000), (10, "alone"), (10, "alone"), (None, "alone"), (None, "nobody"),
]


def brute(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    norm = [(i, (t or "").translate(low)) for i, t in rows]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    out = []
    for i, t in norm:
        keep = max((x for x in groups[t] if x is not None), default=None)
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    df = spark.createDataFrame([(*r, "junk", 1) for r in AWKWARD], "doc_id long, text string, digest string, row int")
    got = sorted(map(tuple, X.dedup_table(df).drop("row", "keep_row").collect()), key=repr)
    assert got == brute(AWKWARD)


def test_empty_table(spark):
    assert X.dedup_table(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("n", [1, 2, 50, 5000])
def test_perfect_hash_is_minimal_and_rejects_strangers(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 256, (n, 32), dtype=np.uint8), axis=0)
    ids = np.arange(len(keys), dtype=np.int64)
    b = X.Bucket(X.build_bucket(keys, ids, ids + 2, ids + 1))
    slot = b.find(keys)
    assert sorted(slot) == list(range(len(keys)))
    assert (b.winners[slot] == ids).all() and (b.counts[slot] == ids + 1).all() and (b.rows[slot] == ids + 2).all()
    assert (b.find(rng.integers(0, 256, (1000, 32), dtype=np.uint8)) == -1).all()


def test_history_wins_over_a_larger_id_in_the_batch(spark):
    old = X.digests(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"))
    new = X.digests(spark.createDataFrame([(7, "A"), (8, "c"), (9, "C")], "doc_id long, text string"))
    got = {(r.doc_id, r.keep_id, r.group_size) for r in X.exact_dedup(new, old).collect()}
    assert got == {(1, 1, 2), (7, 1, 2), (8, 9, 2), (9, 9, 2), (2, 2, 1)}


def test_one_row_of_each_text_is_the_kept_one(spark):
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string")
    rows = X.dedup_table(df).collect()
    assert len({r.row for r in rows}) == len(rows)
    kept = [r for r in rows if r.row == r.keep_row]
    assert len(kept) == len({r.text_sha256 for r in rows}) and all(r.kept for r in kept)


def test_history_without_a_number_takes_the_batch_s(spark):
    old = X.digests(spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string"))
    new = X.digests(spark.createDataFrame([(7, "A"), (8, "a")], "doc_id long, text string"))
    assert {(r.doc_id, r.keep_id, r.group_size) for r in X.exact_dedup(new, old).collect()} == {(None, 8, 4), (7, 8, 4), (8, 8, 4)}


def test_the_result_comes_from_the_look_up(spark, monkeypatch):
    rows = [(i, f"text {i % 40}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, X.dedup_table(df).drop("row", "keep_row").collect()), key=repr) == brute(rows)

    def without_index(asked, index):
        return X._look_up(asked, index.slice(0, 0))

    def wrong_slot(asked, index):  # as if the perfect hash answered with the next slot
        find = X.Bucket.find
        X.Bucket.find = lambda self, keys: np.where(find(self, keys) >= 0, (find(self, keys) + 1) % self.n, -1)
        try:
            return X._look_up(asked, index)
        finally:
            X.Bucket.find = find

    def nobody(asked, index):
        find = X.Bucket.find
        X.Bucket.find = lambda self, keys: np.full(len(keys), -1, np.int64)
        try:
            return X._look_up(asked, index)
        finally:
            X.Bucket.find = find

    for broken in (without_index, wrong_slot, nobody):
        made = {"X": X, "np": np}
        with monkeypatch.context() as m:
            m.setattr(X, "_look_up", _by_value(broken, made))
            assert sorted(map(tuple, X.dedup_table(df).drop("row", "keep_row").collect()), key=repr) != brute(rows)


def _by_value(function, names):
    """The function as one that workers get with its code, not by its name in a test module they can't import."""
    import types

    return types.FunctionType(function.__code__, {**names, "__name__": "__main__"}, function.__name__, function.__defaults__, function.__closure__)
