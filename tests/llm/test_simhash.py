import random

import numpy as np
import xxhash

from framealign.llm import simhash as S


def brute_fp(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    import re

    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(low))
    if not w:
        return 0
    sh = [" ".join(w)] if len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    fps = [brute_fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, f"{fps[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows))


def shown(df):
    from pyspark.sql import functions as F

    return sorted(map(tuple, df.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id").collect()))


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = ["w%d" % i for i in range(300)]
    rows = []
    for g in range(30):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 40, 200]))]
        for _ in range(rng.choice([1, 2, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(words).upper()
            rows.append(" ".join(w))
    rows += [None, "", " \t\n", "ÀÉ\x0b x", "a b c d", "long word " * 30000]
    rows = [(i * 3, t) for i, t in enumerate(rows)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, fp string, key int")
    assert shown(S.near_duplicates(df)) == brute(rows)


def test_chain_of_links_is_one_component(spark):
    fps = [0, 0b111, 0b111111, 0b111111111, 0xFFFFFF << 40]
    u, v = S._stars(np.array(fps, np.uint64), np.array([50, 40, 30, 20, 10]))
    assert sorted(zip(u, v)) == [(30, 20), (40, 20), (50, 20)]


def test_every_pair_within_three_bits_is_found(spark):
    rng = random.Random(5)
    rows, k = [], 0
    for _ in range(60):
        f = rng.getrandbits(64)
        rows.append((k, f)); k += 1
        g = f
        for b in rng.sample(range(64), 3):
            g ^= 1 << b
        rows.append((k, g)); k += 1
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in rows]
    from framealign.llm.components import components

    classes = spark.createDataFrame(signed, "id long, fp long")
    filed = S._filed(classes).repartition(3, "key").sortWithinPartitions("key")
    got = {r.node: r.root for r in components(filed.mapInArrow(S._links, "u long, v long")).collect()}
    assert all(got[i] == i - i % 2 for i, _ in rows)


def test_empty_and_null_ids(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = {(r.doc_id, r.component_id) for r in S.near_duplicates(spark.createDataFrame([(None, "a b"), (4, "a b"), (None, "zz")], "doc_id long, text string")).collect()}
    assert got == {(None, 4), (4, 4), (None, None)}
