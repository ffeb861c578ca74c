"""Chat formatting: tool calls linked to results, ordered, validated and written as canonical JSON, by SQL functions only.

Message texts. A text that is a JSON object with `tool_calls` (a list of objects with id, name, arguments) makes calls; one
with `tool_call_id` is the result of that call; all others are plain content. `$id` as a string value in the arguments of
a call refers to the result of another call of the conversation.

Linking. Calls and results meet in a hash join on (conv_id, id). Of several results of a call, the first by turn counts;
a result without a call and a call without a result are marked.

Order. A message keeps its turn unless something it needs (a result its call, a call the results it refers to) stands
later; then it follows that at once. Messages of which all needs are placed are placed, round by round; messages on a
cycle keep their turn and are marked. Sorting by (conv_id, place, depth, turn) is a topological order, so no conversation
is ever collected in one row or task.

Validation. `schemas` gives per tool the required arguments and the types of arguments (string, number, integer, boolean,
array, object). A call is valid if its tool is known, its arguments are an object, all required ones are there and the
known ones have their type; others are allowed.

Canonical JSON: keys sorted, no white space, numbers in shortest form. Objects with a key twice don't parse and count as
plain content or invalid arguments.

Cases: null text is empty content, null roles and turns stay null (a null turn sorts first); rows that repeat a
(conv_id, turn) are separate messages. A null conv_id links nothing. An empty table gives an empty result. Columns other
than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Schemas of the query's tools: required arguments, types of arguments.
SCHEMAS = {
    "search": (("query",), {"query": "string", "limit": "integer"}),
    "fetch": (("url",), {"url": "string", "headers": "object"}),
    "calculate": (("expression",), {"expression": "string", "precision": "integer"}),
    "store": (("key", "value"), {"key": "string", "value": "object", "tags": "array", "force": "boolean", "weight": "number"}),
}

_CALLS = "array<struct<id:string,name:string,arguments:string>>"
_TYPES = {"string": "^STRING$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "integer": "^BIGINT$|^DECIMAL\\(\\d+,0\\)$", "boolean": "^BOOLEAN$", "array": "^ARRAY<.*$", "object": "^OBJECT<.*$"}


def _messages(talks: DataFrame) -> DataFrame:
    """Messages with their calls and the id of the call they answer."""
    read = talks.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shaped = F.when(F.ltrim("text").startswith("{"), F.expr("try_parse_json(text)"))
    calls = F.when(F.expr("schema_of_variant(variant_get(parsed, '$.tool_calls', 'variant')) like 'ARRAY<%'"), F.from_json(F.get_json_object("text", "$.tool_calls"), _CALLS))
    answers = F.when(F.col("parsed").isNotNull(), F.get_json_object("text", "$.tool_call_id"))
    return read.withColumn("parsed", shaped).select("conv_id", "turn", "role", "text", F.coalesce(calls, F.array().cast(_CALLS)).alias("calls"), answers.alias("answers"))


def _valid(schemas: dict) -> Column:
    """Whether (name, parsed arguments `args`) fit the tool's schema."""
    out = F.lit(False)
    kind = F.expr("schema_of_variant(args)")
    for name, (required, types) in schemas.items():
        fits = kind.like("OBJECT<%")
        for key in required:
            fits = fits & F.expr(f"schema_of_variant(variant_get(args, '$.{key}', 'variant')) is not null")
        for key, want in types.items():
            found = F.expr(f"schema_of_variant(variant_get(args, '$.{key}', 'variant'))")
            fits = fits & F.coalesce(found.rlike(_TYPES[want]), F.lit(True))
        out = F.when(F.col("name") == name, F.coalesce(fits, F.lit(False))).otherwise(out)
    return out


def _linked(messages: DataFrame, schemas: dict) -> DataFrame:
    """One row per call: row (of its message), conv_id, turn, k, id, name, arguments (canonical), valid, result_turn."""
    calls = messages.filter(F.size("calls") > 0).select("row", "conv_id", "turn", F.posexplode("calls").alias("k", "c")).select("row", "conv_id", "turn", "k", "c.id", "c.name", "c.arguments")
    results = messages.filter("answers is not null").groupBy("conv_id", F.col("answers").alias("id")).agg(F.min("turn").alias("result_turn"))
    joined = calls.join(results.hint("shuffle_hash"), ["conv_id", "id"], "left")
    parsed = joined.withColumn("args", F.expr("try_parse_json(arguments)"))
    return parsed.select("row", "conv_id", "turn", "k", "id", "name", F.coalesce(F.expr("to_json(args)"), "arguments").alias("arguments"), _valid(schemas).alias("valid"), "result_turn")


def _needs(messages: DataFrame, calls: DataFrame) -> DataFrame:
    """conv_id, turn (of a message), needs (turn of a message it must follow)."""
    answered = calls.filter("result_turn is not null").select("conv_id", F.col("result_turn").alias("turn"), F.col("turn").alias("needs"))
    refs = calls.select("conv_id", "turn", F.explode(F.regexp_extract_all("arguments", F.lit('"\\$([A-Za-z0-9_.:-]+)"'), F.lit(1))).alias("id"))
    sources = calls.filter("result_turn is not null").groupBy("conv_id", "id").agg(F.min("result_turn").alias("needs"))
    referred = refs.join(sources.hint("shuffle_hash"), ["conv_id", "id"]).select("conv_id", "turn", "needs")
    return answered.unionByName(referred).filter("turn <> needs").distinct()


#: Rounds after which the placed messages are written as one table again.
COMPACT = 8


def _placed(needs: DataFrame) -> DataFrame:
    """conv_id, turn, place, depth, cyclic of the messages that need others or are needed; one job a round."""
    nodes = needs.select("conv_id", "turn").unionByName(needs.select("conv_id", F.col("needs").alias("turn"))).distinct()
    shape = "conv_id", "turn", "place", "depth"
    parts = [common.cut(nodes.join(needs.select("conv_id", "turn").distinct(), ["conv_id", "turn"], "left_anti").select("conv_id", "turn", F.col("turn").alias("place"), F.lit(0).alias("depth")))]
    while True:
        known = parts[0]
        for part in parts[1:]:
            known = known.unionByName(part)
        if len(parts) > COMPACT:
            known = common.cut(known)
            parts = [known]
        # a message that isn't placed is ready if all that it needs are
        waiting = needs.join(known.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti")
        asked = waiting.join(known.select("conv_id", F.col("turn").alias("needs"), F.col("place").alias("p"), F.col("depth").alias("d")), ["conv_id", "needs"], "left")
        ready = asked.groupBy("conv_id", "turn").agg(F.count(F.when(F.col("p").isNull(), 1)).alias("missing"), F.max(F.struct("p", "d")).alias("last")).filter("missing = 0")
        later = F.col("last.p") >= F.col("turn")
        ready = common.cut(ready.select("conv_id", "turn", F.when(later, F.col("last.p")).otherwise(F.col("turn")).alias("place"), F.when(later, F.col("last.d") + 1).otherwise(F.lit(0)).alias("depth")))
        if ready.isEmpty():  # what is left stands on a cycle or after one
            left = waiting.select("conv_id", "turn").distinct().select("conv_id", "turn", F.col("turn").alias("place"), F.lit(0).alias("depth"), F.lit(True).alias("cyclic"))
            return known.select(*shape, F.lit(False).alias("cyclic")).unionByName(left)
        parts.append(ready)


def format_chats(talks: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """conv_id, turn, place, depth, n_calls, n_linked, n_valid, cyclic, json for every message."""
    messages = _messages(talks)
    # messages without calls and results go straight through; the others are few and kept for the joins
    special = common.cut(messages.filter("size(calls) > 0 or answers is not null").withColumn("row", F.monotonically_increasing_id()))
    plain = messages.filter("not (size(calls) > 0 or answers is not null)")
    shape = "conv_id", "turn", "place", "depth", "n_calls", "n_linked", "n_valid", "cyclic", "json"
    content = F.to_json(F.struct(F.col("text").alias("content"), "role"), {"ignoreNullFields": "false"})
    zero = F.lit(0).cast("long")
    kinds = dict(talks.dtypes)
    out = plain.select("conv_id", "turn", F.col("turn").alias("place"), F.lit(0).alias("depth"), zero.alias("n_calls"), zero.alias("n_linked"), zero.alias("n_valid"), F.lit(False).alias("cyclic"), content.alias("json"))
    if special.isEmpty():
        return out.select(*shape)
    calls = common.cut(_linked(special, schemas))
    where = _placed(common.cut(_needs(special, calls)))
    call = F.concat(F.lit('{"arguments":'), F.coalesce("arguments", F.lit("null")), F.lit(',"id":'), _text("id"), F.lit(',"name":'), _text("name"), F.lit(',"result_turn":'), F.coalesce(F.col("result_turn").cast("string"), F.lit("null")), F.lit(',"valid":'), F.col("valid").cast("string"), F.lit("}"))
    listed = calls.select("row", "result_turn", "valid", F.struct("k", call.alias("c")).alias("x"))
    # calls of one message, as many as the message's own text holds
    grouped = listed.groupBy("row").agg(F.count(F.lit(1)).alias("n_calls"), F.count("result_turn").alias("n_linked"), F.count(F.when(F.col("valid"), 1)).alias("n_valid"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["c"]), ",").alias("listed"))
    known = calls.filter("id is not null").select("conv_id", F.col("id").alias("answers")).distinct().withColumn("has_call", F.lit(True))
    joined = special.join(grouped, "row", "left").join(where, ["conv_id", "turn"], "left").join(known.hint("shuffle_hash"), ["conv_id", "answers"], "left")
    body = F.coalesce(F.expr("to_json(variant_get(try_parse_json(text), '$.content', 'variant'))"), F.lit("null"))
    as_calls = F.concat(F.lit('{"content":'), body, F.lit(',"role":'), _text("role"), F.lit(',"tool_calls":['), F.coalesce("listed", F.lit("")), F.lit("]}"))
    as_result = F.concat(F.lit('{"content":'), body, F.lit(',"linked":'), F.coalesce("has_call", F.lit(False)).cast("string"), F.lit(',"role":'), _text("role"), F.lit(',"tool_call_id":'), _text("answers"), F.lit("}"))
    done = joined.select(
        "conv_id", "turn", F.coalesce("place", "turn").cast(kinds["turn"]).alias("place"), F.coalesce("depth", F.lit(0)).alias("depth"),
        F.coalesce("n_calls", zero).alias("n_calls"), F.coalesce("n_linked", zero).alias("n_linked"), F.coalesce("n_valid", zero).alias("n_valid"),
        F.coalesce("cyclic", F.lit(False)).alias("cyclic"), F.when(F.size("calls") > 0, as_calls).otherwise(as_result).alias("json"),
    )
    return out.unionByName(done).select(*shape)


def _text(column: str) -> Column:
    """A string column as a JSON string, null as null."""
    return F.coalesce(F.expr(f"to_json(to_variant_object(named_struct('x', {column})))"), F.lit('{"x":null}')).substr(F.lit(6), F.lit(1 << 30)).substr(F.lit(1), F.length(F.coalesce(F.expr(f"to_json(to_variant_object(named_struct('x', {column})))"), F.lit('{"x":null}'))) - 6)


def tool_turns(talks: DataFrame) -> DataFrame:
    """Talks of users and an assistant as talks with tool calls, by fixed rules, so that a table without calls exercises the method.

    With n the characters of a text, w its first run of ASCII letters and t its turn: a user's turn becomes the call c<t> of
    search, fetch, calculate, store or an unknown tool (n mod 5); its main argument is w, or refers to the call c<t+2>
    (n mod 3 = 0) or c<t-2> (n mod 3 = 1), so that some calls need later ones and some need each other. Odd n give search a
    limit of the wrong type, n mod 7 = 0 leaves fetch without its url. An assistant's turn becomes the result of c<t-1>.
    All other rows stay as they are. Keys and white space are not canonical here.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = talks.withColumn("_text", text).withColumn("_n", F.length("_text")).withColumn("_t", F.col("turn").cast("long"))
    main = "case when _n % 3 = 0 then concat('$c', _t + 2) when _n % 3 = 1 then concat('$c', _t - 2) else regexp_extract(_text, '[A-Za-z]+', 0) end"
    arguments = f"""case _n % 5
        when 0 then concat('{{"query": "', {main}, '", "limit": ', if(_n % 2 = 0, string(_n), '"many"'), '}}')
        when 1 then if(_n % 7 = 0, '{{"headers": {{}}}}', concat('{{"url": "', {main}, '", "headers": {{"n": ', _n, '}}}}'))
        when 2 then concat('{{"precision": ', _n % 10, ', "expression": "', {main}, '"}}')
        when 3 then concat('{{"value": {{"b": ', _n, ', "a": [1, 2]}}, "key": "', {main}, '", "force": ', string(_n % 2 = 0), '}}')
        else concat('{{"x": "', {main}, '"}}') end"""
    content = "substring(to_json(named_struct('x', _text)), 6, length(to_json(named_struct('x', _text))) - 6)"
    call = f"""concat('{{"tool_calls": [{{"name": "', element_at(array('search', 'fetch', 'calculate', 'store', 'other'), _n % 5 + 1), '", "id": "c', _t, '", "arguments": ', {arguments}, '}}], "content": ', {content}, '}}')"""
    result = f"""concat('{{"tool_call_id": "c', _t - 1, '", "content": ', {content}, '}}')"""
    shaped = F.expr(f"case when _t is not null and role = 'user' then {call} when _t is not null and role = 'assistant' then {result} else _text end")
    return named.select("conv_id", "turn", "role", shaped.alias("text"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(tool_turns(common.table(spark, sf_dir, "conversations")))


OP6_SQL = """
WITH RECURSIVE d AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM conversations),
calls AS (
  SELECT conv_id, turn, role, text, n, 'c' || turn AS id, ['search', 'fetch', 'calculate', 'store', 'other'][n % 5 + 1] AS name,
         CASE n % 3 WHEN 0 THEN '$c' || (turn + 2) WHEN 1 THEN '$c' || (turn - 2) ELSE regexp_extract(text, '[A-Za-z]+') END AS main
  FROM d WHERE role = 'user'),
written AS (
  SELECT *, CASE name
    WHEN 'search' THEN '{"limit":' || CASE WHEN n % 2 = 0 THEN CAST(n AS VARCHAR) ELSE '"many"' END || ',"query":"' || main || '"}'
    WHEN 'fetch' THEN CASE WHEN n % 7 = 0 THEN '{"headers":{}}' ELSE '{"headers":{"n":' || n || '},"url":"' || main || '"}' END
    WHEN 'calculate' THEN '{"expression":"' || main || '","precision":' || (n % 10) || '}'
    WHEN 'store' THEN '{"force":' || CASE WHEN n % 2 = 0 THEN 'true' ELSE 'false' END || ',"key":"' || main || '","value":{"a":[1,2],"b":' || n || '}}'
    ELSE '{"x":"' || main || '"}' END AS arguments
  FROM calls),
schemas(name, key, kinds, required) AS (VALUES
  ('search', 'query', ['VARCHAR'], true), ('search', 'limit', ['UBIGINT', 'BIGINT'], false),
  ('fetch', 'url', ['VARCHAR'], true), ('fetch', 'headers', ['OBJECT'], false),
  ('calculate', 'expression', ['VARCHAR'], true), ('calculate', 'precision', ['UBIGINT', 'BIGINT'], false),
  ('store', 'key', ['VARCHAR'], true), ('store', 'value', ['OBJECT'], true), ('store', 'tags', ['ARRAY'], false),
  ('store', 'force', ['BOOLEAN'], false), ('store', 'weight', ['UBIGINT', 'BIGINT', 'DOUBLE'], false)),
checked AS (
  SELECT w.conv_id, w.turn, count(s.key) > 0 AND bool_and(s.key IS NULL OR (json_extract(w.arguments, '$.' || s.key) IS NULL AND NOT s.required)
         OR coalesce(list_contains(s.kinds, json_type(json_extract(w.arguments, '$.' || s.key))), false)) AS valid
  FROM written w LEFT JOIN schemas s ON s.name = w.name GROUP BY w.conv_id, w.turn),
results AS (SELECT conv_id, turn, 'c' || (turn - 1) AS id FROM d WHERE role = 'assistant'),
linked AS (SELECT w.*, c.valid, (SELECT min(r.turn) FROM results r WHERE r.conv_id = w.conv_id AND r.id = w.id) AS result_turn
           FROM written w JOIN checked c ON c.conv_id = w.conv_id AND c.turn = w.turn),
needs AS (
  SELECT conv_id, result_turn AS turn, turn AS need FROM linked WHERE result_turn IS NOT NULL
  UNION SELECT a.conv_id, a.turn, b.result_turn FROM linked a JOIN linked b ON b.conv_id = a.conv_id AND contains(a.arguments, '"$' || b.id || '"') WHERE b.result_turn IS NOT NULL),
paths AS (
  SELECT conv_id, need AS a, turn AS m, 1 AS k FROM needs WHERE need <> turn
  UNION SELECT p.conv_id, p.a, n.turn, p.k + 1 FROM paths p JOIN needs n ON n.conv_id = p.conv_id AND n.need = p.m AND n.need <> n.turn
        WHERE p.k < (SELECT count(*) FROM d WHERE d.conv_id = p.conv_id)),
rings AS (SELECT DISTINCT conv_id, a FROM paths WHERE a = m),
cyclic AS (SELECT conv_id, a AS m FROM rings UNION SELECT p.conv_id, p.m FROM paths p JOIN rings r ON r.conv_id = p.conv_id AND r.a = p.a),
places AS (
  SELECT d.conv_id, d.turn, max({'p': coalesce(p.a, d.turn), 'd': coalesce(p.k, 0)}) AS best
  FROM d LEFT JOIN paths p ON p.conv_id = d.conv_id AND p.m = d.turn AND p.a >= d.turn GROUP BY d.conv_id, d.turn)
SELECT d.conv_id AS conv_id, d.turn AS turn, CASE WHEN c.m IS NULL THEN x.best.p ELSE d.turn END AS place, CAST(CASE WHEN c.m IS NULL THEN x.best.d ELSE 0 END AS INTEGER) AS depth,
       CAST(CASE WHEN l.id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_calls, CAST(CASE WHEN l.result_turn IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_linked,
       CAST(CASE WHEN l.valid THEN 1 ELSE 0 END AS BIGINT) AS n_valid, c.m IS NOT NULL AS cyclic,
       '{"content":' || CAST(to_json(d.text) AS VARCHAR) || CASE
         WHEN d.role = 'user' THEN ',"role":"user","tool_calls":[{"arguments":' || l.arguments || ',"id":"' || l.id || '","name":"' || l.name || '","result_turn":' || coalesce(CAST(l.result_turn AS VARCHAR), 'null')
              || ',"valid":' || CASE WHEN l.valid THEN 'true' ELSE 'false' END || '}]}'
         WHEN d.role = 'assistant' THEN ',"linked":' || CASE WHEN EXISTS (SELECT 1 FROM linked q WHERE q.conv_id = d.conv_id AND q.id = 'c' || (d.turn - 1)) THEN 'true' ELSE 'false' END
              || ',"role":"assistant","tool_call_id":"c' || (d.turn - 1) || '"}'
         ELSE ',"role":' || coalesce(CAST(to_json(d.role) AS VARCHAR), 'null') || '}' END AS json
FROM d LEFT JOIN linked l ON l.conv_id = d.conv_id AND l.turn = d.turn LEFT JOIN cyclic c ON c.conv_id = d.conv_id AND c.m = d.turn
JOIN places x ON x.conv_id = d.conv_id AND x.turn = d.turn
"""
