import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framealign.llm import huffman as H
from framealign.llm import packing as P
from framealign.llm import tokens as T
from framealign.llm.tokens import PieceEncoder
from tokenizers import Tokenizer

TEXTS = [
    "Plain words, and more words.\nA line.", "", " a", "a ", "a  b\n\nc", "x\ty", "0 0\n0", "it's 're   b", "\0x \0y", "é ́", "日本 語\n한국", "a\r\nb",
    "<|endoftext|> hi", "ΑΣ ΣΑΣ", "  ", "\n", "10 20\n 30", "a\x1cb \x1c c", "ab\n cd", "ab \ncd", "w" * 3000, "long text " * 20000, None,
    "hi <|ENDOFTEXT|> there<|startoftext|>", "<|endoftext", "İstanbul ȺB ǅ ŉa ßen Übung!! (x) l'eau, don't. U.S. a_b c-d", "it's!! 's 'S x' ''y", "ªº ǆǅ ﬁ Ǆ", "a. b.\nc!\n!d", "x.\u00a0y z\u2003",
]


def library(name):
    """Ids by a tokenizer that nothing has touched."""
    made = Tokenizer.from_file(H.vocabulary_path(name))
    return lambda text: made.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_library_s_ids(name, monkeypatch):
    own, plain = PieceEncoder(H.vocabulary_path(name)), library(name)
    texts = [t for t in TEXTS if t is not None]
    for block, stretch in ((T.BLOCK, T.STRETCH), (40, 3), (2000, 500)):
        monkeypatch.setattr(T, "BLOCK", block)
        monkeypatch.setattr(T, "STRETCH", stretch)
        for _ in range(2):  # the second time pieces are known
            for text, ids in zip(texts, own.encode(texts), strict=True):
                assert np.frombuffer(ids, own.dtype).tolist() == plain(text), repr(text[:40])
    own.forget()
    assert own.kept == {} and own.encode([]) == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_random_texts_give_the_library_s_ids(name, monkeypatch):
    rng = random.Random(3)
    own, plain = PieceEncoder(H.vocabulary_path(name)), library(name)
    letters = "abcdeABCé Éßıİ 'ſ.,!?-<|>\n\t 019äʼnǅ̈\u0301日\u200d"
    for kept in (T.KEPT, 20):
        monkeypatch.setattr(T, "KEPT", kept)
        texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(2000)]
        for text, ids in zip(texts, own.encode(texts), strict=True):
            assert np.frombuffer(ids, own.dtype).tolist() == plain(text), repr(text)


@pytest.mark.parametrize("n,limit", [(1, 16), (2, 16), (40, 6), (3000, 16)])
def test_code_lengths_are_bounded_complete_and_best(n, limit):
    rng = np.random.default_rng(n)
    counts = np.r_[0, (1.5 ** rng.integers(0, 40, n)).astype(np.int64), 0]
    lengths = H.code_lengths(counts, limit)
    used = lengths[counts > 0].astype(int)
    assert (lengths[counts == 0] == 0).all() and used.max() <= limit
    if n > 1:
        assert sum(2.0 ** -x for x in used) == 1
    if n == 40:  # no pair can be swapped for a gain, and plain Huffman isn't better where it keeps the limit
        order = np.argsort(counts[counts > 0])
        assert (np.diff(used[order]) <= 0).all() or len(set(counts[counts > 0])) < n
        import heapq

        heap = [(int(c), 1) for c in counts if c]
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            cost += a[0] + b[0]
            heapq.heappush(heap, (a[0] + b[0], 0))
        assert int((counts * H.code_lengths(counts, 16)).sum()) >= cost


def test_blocks_round_trip():
    rng = np.random.default_rng(5)
    ids = (rng.zipf(1.3, 100_000) % 5000).astype(np.uint16)
    book = H.Codebook(H.code_lengths(np.bincount(ids, minlength=5001)))
    for n in (0, 1, 255, 256, 257, 100_000):
        back, end = book.decode_block(memoryview(book.encode_block(ids[:n])), 0)
        assert (back == ids[:n]).all() and end == len(book.encode_block(ids[:n]))
    docs, counts, back = H.read_segment(book, H.write_segment(book, [None, 7, 9], np.array([3, 0, 97]), ids[:100]))
    assert docs == [None, 7, 9] and counts.tolist() == [3, 0, 97] and (back == ids[:100]).all()


def test_more_ids_than_codes_of_sixteen_bits():
    counts = np.r_[np.ones(70_000, np.int64), 1 << 40]
    book = H.Codebook(H.code_lengths(counts))
    assert book.most == 17
    ids = np.r_[np.arange(70_001), 70_000].astype(np.uint32)
    assert (book.decode_block(memoryview(book.encode_block(ids)), 0)[0] == ids).all()


def test_token_output_against_the_library(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(H, "RANGE_IDS", 4000)
    rows = [(i * 2 if i else None, t, "x", 3) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, part int").repartition(3)
    H.write_tokens(df, H.vocabulary_path("byte_bpe_50k.json"), f"{tmp_path}/file")
    # another session has nothing but the file
    got = [tuple(r) for r in H.read_tokens(spark.newSession(), f"{tmp_path}/file").orderBy(F.col("doc_id").asc_nulls_first()).collect()]
    plain, start, want = library("byte_bpe_50k.json"), 0, []
    for doc, text, *_ in rows:
        ids = [*plain(text), 2]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    H.write_tokens(df.limit(0), H.vocabulary_path("byte_bpe_50k.json"), f"{tmp_path}/empty")
    assert H.read_tokens(spark, f"{tmp_path}/empty").collect() == []


def test_one_doc_id_is_split_and_stays_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(H, "RANGE_IDS", 100)
    rows = [(5, f"word{i} again") for i in range(200)] + [(None, "none")] * 50 + [(1, "first")]
    H.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), H.vocabulary_path("byte_bpe_50k.json"), f"{tmp_path}/file")
    assert spark.read.parquet(f"{tmp_path}/file/segments").count() > 5
    got = H.read_tokens(spark, f"{tmp_path}/file").orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 50 + [1] + [5] * 200
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()


def check_packing(rows, length):
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in seqs.values():
        at = 0
        for offset, size in sorted(held):
            assert offset == at
            at += size
        assert at <= length
    return len(seqs)


def test_packing(spark):
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(TEXTS)], "doc_id long, text string, piece int")
    path = H.vocabulary_path("word_bpe_49k.json")
    rows = P.pack(P.pieces(df, path)).collect()
    plain = library("word_bpe_49k.json")
    want = []
    for i, t in enumerate(TEXTS):
        ids = [*plain(t), 0]
        for k in range(0, len(ids), P.LENGTH):
            part = ids[k : k + P.LENGTH]
            want.append((i, k // P.LENGTH, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    total = sum(r.length for r in rows)
    assert check_packing(rows, P.LENGTH) <= -(-total // P.LENGTH) + 1
    assert P.pack(P.pieces(df.limit(0), path)).collect() == []


def test_packing_over_several_passes_stays_near_the_bound(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(P, "TASK_SEQUENCES", 64)
    # one doc_id on a third of all rows
    items = [(i, i if i % 3 else 7, 0, 0, min(2048, int(rng.lognormvariate(6, 1)) + 1), i) for i in range(3000)]
    df = spark.createDataFrame(items, "row long, doc_id long, piece int, start long, length long, ids_crc32 long")
    for settle in (True, False):
        rows = P.pack(df, places=32, settle=settle).collect()
        assert sorted((r.doc_id, r.length) for r in rows) == sorted((i[1], i[4]) for i in items)
        assert check_packing(rows, 2048) <= 1.03 * sum(i[4] for i in items) / 2048 + 1


def test_best_fit_closes_the_fullest():
    bins = P.Bins(10, 2)
    assert bins.put("a", 6) == [] and bins.put("b", 7) == []
    assert bins.put("c", 8) == [["b"]]
    assert bins.put("d", 2) == [["c", "d"]]
    assert bins.put("e", 4) == [["a", "e"]]
    assert bins.rest() == []
