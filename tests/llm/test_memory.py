import json
import random
import subprocess
import sys
import time
from pathlib import Path

import pyarrow as pa
import pytest

from framealign.llm import common

ROOT = Path(__file__).resolve().parents[2]

#: A worker of its own: base, peak and rest of its memory in MB.
WORKER = """
import gc, json, re, sys, threading, time
import numpy as np, pyarrow as pa, pyspark.sql
from framealign.llm import decontaminate, huffman, packing, quality
now = lambda: int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) // 1024
packing.TaskContext = type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})())})
what, sent, items = sys.argv[1:]
shared = type("S", (), {"value": decontaminate.Phrases([(k, x.encode()) for k, x in enumerate(json.loads(items))])})()
run = {
    "contexts": quality._contexts,
    "leaks": decontaminate._search([shared]),
    "pieces": packing._pieces(huffman.vocabulary_path("word_bpe_49k.json"), 0, 2048),
}[what]
peak, base = [0], now()
def look():
    while True:
        peak[0] = max(peak[0], now())
        time.sleep(0.002)
threading.Thread(target=look, daemon=True).start()
with pa.OSFile(sent) as f:
    for x in run(iter(pa.ipc.open_stream(f))):
        pass
del x, run
gc.collect()
print(base, peak[0], now())
"""


@pytest.fixture(scope="module")
def sent(tmp_path_factory):
    """Batches of 8 MB, as Spark sends them, and some items."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 11))) + rng.choice(["", "", ",", "."]) for _ in range(60_000)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(2800)]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    path = str(tmp_path_factory.mktemp("sent") / "batches")
    with pa.OSFile(path, "wb") as f, pa.ipc.new_stream(f, batch.schema) as out:
        for _ in range(4):
            out.write_batch(batch)
    return path, [" ".join(rng.choices(words, k=30)) for _ in range(200)]


@pytest.mark.skipif(not Path("/proc/self/status").exists(), reason="memory can't be read")
@pytest.mark.parametrize(("what", "most", "left"), [("contexts", 128, 60), ("leaks", 120, 65), ("pieces", 122, 92)])
def test_worker_holds_little_and_leaves_less(sent, what, most, left):
    env = {"PYTHONPATH": str(ROOT), "PATH": "/usr/bin:/bin", "OMP_NUM_THREADS": "1"}
    out = subprocess.run([sys.executable, "-c", WORKER, what, sent[0], json.dumps(sent[1])], cwd=ROOT, env=env, capture_output=True, text=True, timeout=120, check=True)
    base, peak, rest = map(int, out.stdout.split())
    assert peak - base < most, (base, peak, rest)
    assert rest - base < left, (base, peak, rest)


def test_shuffles_that_nothing_refers_to_go_while_cuts_are_made(spark):
    held = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    common.cut(spark.range(10).repartition(3, "id"))
    before, df = held(), spark.range(100)
    for _ in range(5 * common.COLLECT):
        df = common.cut(df.repartition(3, "id"))
    time.sleep(2)
    assert held() - before < 2 * common.COLLECT
