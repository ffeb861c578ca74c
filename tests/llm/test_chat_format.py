import json

from framealign.llm import chat_format as C

CALL = lambda *calls: json.dumps({"tool_calls": [dict(zip(("id", "name", "arguments"), c)) for c in calls], "content": "x"})
RESULT = lambda i, c="ok": json.dumps({"tool_call_id": i, "content": c})

ROWS = [
    (1, 0, "user", 'He said "hi"\n\tüñ'),
    (1, 1, "assistant", CALL(("a", "search", {"query": "q", "limit": 3}), ("b", "search", {"limit": 3}))),
    (1, 2, "tool", RESULT("b")),
    (1, 3, "tool", RESULT("a", {"z": 1, "a": [1, 2.5, None]})),
    (1, 4, "assistant", CALL(("c", "fetch", {"url": "$d"}))),  # needs the result of d, which stands later
    (1, 5, "tool", RESULT("c")),
    (1, 6, "assistant", CALL(("d", "store", {"key": "k", "value": {"b": 1, "a": 2}, "tags": [], "force": True, "weight": 1.5}))),
    (1, 7, "tool", RESULT("d")),
    (1, 8, "tool", RESULT("nobody")),
    (2, 0, "assistant", CALL(("a", "nosuch", {}))),
    (3, 0, "tool", RESULT("x")),  # the result stands before its call
    (3, 1, "assistant", CALL(("x", "calculate", {"expression": 5}))),
    (4, 0, "assistant", CALL(("p", "fetch", {"url": "$q"}))),
    (4, 1, "tool", RESULT("p")),
    (4, 2, "assistant", CALL(("q", "fetch", {"url": "$p"}))),
    (4, 3, "tool", RESULT("q")),
    (5, 0, None, None), (5, 1, "user", ""), (5, 2, "user", "{broken"), (5, 3, "user", '{"a":1,"a":2}'), (5, 4, "user", "x" * 200_000),
    (None, 0, "assistant", CALL(("n", "fetch", {"url": "u"}))), (5, 1, "user", ""), (6, None, "user", "no turn"),
    (7, 0, "assistant", '{"tool_calls": "none"}'),
]


def run(spark, rows=ROWS):
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, json string, place int").repartition(3)
    return C.format_chats(df).collect()


def test_links_order_and_validation(spark):
    rows = run(spark)
    assert len(rows) == len(ROWS)
    by = {(r.conv_id, r.turn): r for r in rows if r.conv_id != 5}
    assert (by[1, 1].n_calls, by[1, 1].n_linked, by[1, 1].n_valid) == (2, 2, 1)
    assert by[1, 4].n_valid == 1 and by[1, 6].n_valid == 1 and by[2, 0].n_valid == 0 and by[3, 1].n_valid == 0
    assert (by[2, 0].n_calls, by[2, 0].n_linked) == (1, 0)
    order = sorted((r for r in rows if r.conv_id == 1), key=lambda r: (r.place, r.depth, r.turn))
    assert [r.turn for r in order] == [0, 1, 2, 3, 6, 7, 4, 5, 8]
    order = sorted((r for r in rows if r.conv_id == 3), key=lambda r: (r.place, r.depth, r.turn))
    assert [r.turn for r in order] == [1, 0]
    assert all(by[4, t].cyclic for t in range(4)) and not any(r.cyclic for r in rows if r.conv_id != 4)
    assert (by[None, 0].n_calls, by[None, 0].n_linked) == (1, 0)


def test_json_is_canonical(spark):
    rows = run(spark)
    for r in rows:
        body = json.loads(r.json)
        assert list(body) == sorted(body)
        assert r.json == json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    by = {(r.conv_id, r.turn): json.loads(r.json) for r in rows}
    assert by[1, 0] == {"content": ROWS[0][3], "role": "user"}
    assert by[1, 1]["tool_calls"][0] == {"arguments": {"limit": 3, "query": "q"}, "id": "a", "name": "search", "result_turn": 3, "valid": True}
    assert by[1, 3] == {"content": {"a": [1, 2.5, None], "z": 1}, "linked": True, "role": "tool", "tool_call_id": "a"}
    assert by[1, 8]["linked"] is False
    assert by[5, 0] == {"content": "", "role": None} and by[5, 3]["content"] == '{"a":1,"a":2}'


def test_plain_and_empty_tables(spark):
    assert [r.place for r in run(spark, [(1, 4, "user", "a")])] == [4]
    assert run(spark, []) == []


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    plan = C.format_chats(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_query_against_its_sql(spark, tmp_path):
    import random

    import duckdb

    rng = random.Random(7)
    rows = []
    for conv in range(60):
        turn = 0
        for k in range(rng.randrange(2, 9)):
            role = ("system" if k == 0 and rng.random() < 0.3 else "user" if (k + conv) % 2 else "assistant") if rng.random() < 0.9 else "user"
            rows.append((conv, turn, role, "".join(rng.choice('ab cé"\\\n.') for _ in range(rng.randrange(1, 40)))))
            turn += 1
    rows.append((99, 0, "user", None))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    found = C.op6_chat_formatting(spark, str(tmp_path))
    want = db.execute(C.OP6_SQL)
    names = [d[0] for d in want.description]
    got = found.select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and len(got) == len(rows)
    # the rows do reach linking, ordering and validation
    assert any(r.cyclic for r in got) and any(r.depth > 0 and r.place > r.turn for r in got) and any(not r.cyclic for r in got)
    assert {(r.n_calls, r.n_linked, r.n_valid) for r in got} >= {(0, 0, 0), (1, 0, 0), (1, 0, 1), (1, 1, 0), (1, 1, 1)}
