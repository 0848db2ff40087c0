"""Tool calls of conversations: linking, order, validation and canonical JSON."""

from __future__ import annotations

import heapq
import json
import math
import re

from pyspark.sql import DataFrame, functions as F

from eventloom.llm.common import scratch, stored

#: A call as canonical JSON texts, whether its arguments fit the tool's schema, and the calls it waits for.
CALLS = "array<struct<id:string,name:string,arguments:string,valid:boolean,needs:array<string>>>"
MESSAGE = f"conv_id long, turn long, role string, text string, content string, calls {CALLS}, answers string, spoken string"


def problems(value, schema: dict, path: str = "$") -> list[str]:
    """Violations of a JSON schema (type, enum, const, properties, required, additionalProperties, items, bounds, lengths, pattern, anyOf)."""
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
    wanted = schema.get("type")
    if wanted:
        def fits(kind):
            if kind == "integer":
                return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
            if kind == "number":
                return isinstance(value, (int, float)) and not isinstance(value, bool)
            return isinstance(value, kinds.get(kind, object))

        if not any(map(fits, [wanted] if isinstance(wanted, str) else wanted)):
            return [f"{path}: not of type {wanted}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path}: not one of the values")
    if "const" in schema and value != schema["const"]:
        out.append(f"{path}: not the value")
    if "anyOf" in schema and all(problems(value, s, path) for s in schema["anyOf"]):
        out.append(f"{path}: fits none")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in known:
                out += problems(v, known[k], f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{path}.{k}: not allowed")
            elif isinstance(schema.get("additionalProperties"), dict):
                out += problems(v, schema["additionalProperties"], f"{path}.{k}")
    if isinstance(value, list):
        if "items" in schema:
            out += [p for i, v in enumerate(value) for p in problems(v, schema["items"], f"{path}[{i}]")]
        size, low, high = len(value), "minItems", "maxItems"
    elif isinstance(value, str):
        size, low, high = len(value), "minLength", "maxLength"
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{path}: doesn't match")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        size, low, high = value, "minimum", "maximum"
    else:
        return out
    if low in schema and size < schema[low] or high in schema and size > schema[high]:
        out.append(f"{path}: out of bounds")
    return out


def canonical(value) -> str:
    """JSON with sorted keys, no spaces and unescaped characters, but for halves of surrogate pairs, which have no UTF-8."""
    out = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", out)


def _number(text: str) -> float:
    if not math.isfinite(value := float(text)):
        raise ValueError("a number that JSON readers can't hold")
    return value


def _constant(text: str):
    raise ValueError(f"{text} is not JSON")


def read_json(text: str):
    """The value of a JSON text; a ValueError for one that is malformed, nested too deeply or holds a number out of range."""
    try:
        return json.loads(text, parse_float=_number, parse_constant=_constant)
    except RecursionError:
        raise ValueError("nested too deeply") from None


def parse_message(role: str | None, text: str | None, schemas: dict[str, dict]) -> tuple:
    """(content, calls, answers) of a message, as canonical JSON texts.

    An assistant's text may be a JSON object with ``tool_calls`` ([{id, name, arguments,
    depends_on}]) and ``content``; a tool's text one with ``tool_call_id`` and ``content``. Any
    other text is content as it stands. Arguments may be JSON or a text that holds JSON.
    """
    plain = canonical(text), [], None
    if role not in ("assistant", "tool") or not text or not text.lstrip().startswith("{"):
        return plain
    try:
        found = read_json(text)
    except ValueError:
        return plain
    named = lambda v: canonical(v if isinstance(v, str) else canonical(v))
    content = canonical(found.get("content"))
    if role == "tool":
        answered = found.get("tool_call_id")
        return plain if answered is None else (content, [], named(answered))
    calls = []
    for c in found.get("tool_calls") if isinstance(found.get("tool_calls"), list) else []:
        if not isinstance(c, dict) or c.get("id") is None:
            continue
        arguments = c.get("arguments")
        if isinstance(arguments, str):
            try:
                arguments = read_json(arguments)
            except ValueError:  # a text that is no JSON stays a text
                pass
        try:
            written = canonical(arguments)
        except RecursionError:
            arguments, written = c["arguments"], canonical(c["arguments"])
        rule = schemas.get(c.get("name")) if isinstance(c.get("name"), str) else None
        needs = c.get("depends_on") if isinstance(c.get("depends_on"), list) else []
        calls.append({"id": named(c["id"]), "name": canonical(c.get("name")), "arguments": written, "valid": None if rule is None else not problems(arguments, rule), "needs": [named(x) for x in needs if x is not None]})
    return (content, calls, None) if calls else plain


def parsed(conversations: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Messages with what their texts say (see ``parse_message``), and the role as JSON."""
    rows = conversations.select(*[F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))])
    from pyspark.sql.pandas.types import to_arrow_type

    calls_type = rows.sparkSession.createDataFrame([], f"x {CALLS}").schema["x"].dataType

    def run(batches):
        import pyarrow as pa

        kind = to_arrow_type(calls_type)
        for batch in batches:
            roles, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            found = [parse_message(r, t, schemas) for r, t in zip(roles, texts)]
            content, calls, answers = zip(*found) if found else ((), (), ())
            columns = [pa.array(content, pa.string()), pa.array(calls, kind), pa.array(answers, pa.string()), pa.array([canonical(r) for r in roles], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(4)] + columns, ["conv_id", "turn", "role", "text", "content", "calls", "answers", "spoken"])

    return rows.mapInArrow(run, MESSAGE)


PLACES = "conv_id long, node long, order_turn long, order_depth long, cyclic boolean"


def place_conversation(turns: dict[int, int | None], edges: list[tuple[int, int]]):
    """(node, order_turn, order_depth, cyclic) of the nodes of one conversation by Kahn's algorithm.

    turns: the turn of each message, None for a call's "all results are there". A message is
    placed once all it waits for are; its place is its own turn, or right after the latest of
    those. What lies on a cycle, or behind one, keeps its own turn and is marked.
    """
    waits, after = dict.fromkeys(turns, 0), {}
    for source, target in edges:
        waits[target] += 1
        after.setdefault(source, []).append(target)
    latest: dict[int, tuple] = {}
    ready = [n for n, k in waits.items() if not k]
    heapq.heapify(ready)
    placed = {}
    while ready:
        node = heapq.heappop(ready)
        turn, before = turns[node], latest.get(node)
        if turn is None:
            place = before
        else:
            place = (before[0], before[1] + 1) if before is not None and before[0] >= turn else (turn, 0)
        placed[node] = place
        for target in after.get(node, ()):
            latest[target] = max(latest.get(target, place), place)
            waits[target] -= 1
            if not waits[target]:
                heapq.heappush(ready, target)
    for node, turn in turns.items():
        yield (node, *placed[node], False) if node in placed else (node, turn, 0, True)


def ordered(edges: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Places (see ``place_conversation``) of the messages with edges: conv_id, node, order_turn, order_depth, cyclic.

    edges: (conv_id, source, source_turn, target, target_turn), the only rows that are gathered by
    conversation. Conversations of more than ``most`` edges are ordered by rounds of joins.
    """
    sizes = edges.groupBy("conv_id").agg(F.count("*").alias("n")).filter(F.col("n") > most).select(F.col("conv_id").alias("huge"))
    sizes = stored(sizes, "huge-conversations")
    small = edges.join(sizes, edges["conv_id"] == sizes["huge"], "left_anti").repartition("conv_id").sortWithinPartitions("conv_id")

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]

        def solve(conv, rows):
            turns = {r[1]: r[2] for r in rows} | {r[3]: r[4] for r in rows}
            out = [(conv, *x) for x in place_conversation(turns, [(r[1], r[3]) for r in rows])]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["conv_id", "node", "order_turn", "order_depth", "cyclic"])

        now, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if held and row[0] != now:
                    yield solve(now, held)
                    held = []
                now = row[0]
                held.append(row)
        if held:
            yield solve(now, held)

    out = small.mapInArrow(run, PLACES)
    return out if sizes.isEmpty() else out.union(ordered_by_joins(edges.join(sizes, edges["conv_id"] == sizes["huge"], "left_semi")))


def ordered_by_joins(edges: DataFrame) -> DataFrame:
    """As ``ordered``, a join of the whole edges for every message on the longest chain."""
    ends = [F.struct(F.col(f"{s}").alias("node"), F.col(f"{s}_turn").alias("turn")) for s in ("source", "target")]
    waiting = stored(edges.select("conv_id", F.explode(F.array(*ends)).alias("x")).select("conv_id", "x.*").distinct(), "tool-nodes")
    edges = stored(edges, "tool-edges")
    placed = waiting.limit(0).select("conv_id", "node", F.col("turn").alias("order_turn"), F.lit(0).cast("long").alias("order_depth"))
    while True:
        before = placed.select(F.col("conv_id").alias("c"), F.col("node").alias("from"), "order_turn", "order_depth")
        state = edges.join(before, (edges["conv_id"] == before["c"]) & (edges["source"] == before["from"]), "left")
        state = state.groupBy(F.col("conv_id").alias("c"), F.col("target").alias("t")).agg(
            F.count("*").alias("n"), F.count("from").alias("ready"), F.max(F.struct("order_turn", "order_depth")).alias("after")
        )
        free = waiting.join(state, (waiting["conv_id"] == state["c"]) & (waiting["node"] == state["t"]), "left").filter("n is null or n = ready")
        late = F.coalesce(F.col("after.order_turn") >= F.col("turn"), F.col("turn").isNull())
        step = F.when(F.col("turn").isNull(), 0).otherwise(1)
        free = stored(free.select(
            "conv_id", "node",
            F.when(late, F.col("after.order_turn")).otherwise(F.col("turn")).alias("order_turn"),
            F.when(late, F.col("after.order_depth") + step).otherwise(F.lit(0)).cast("long").alias("order_depth"),
        ), "tool-free")
        if free.isEmpty():
            break
        placed = stored(placed.union(free), "tool-placed")
        waiting = stored(waiting.join(free.select("conv_id", "node"), ["conv_id", "node"], "left_anti"), "tool-waiting")
    cyclic = waiting.select("conv_id", "node", F.col("turn").alias("order_turn"), F.lit(0).cast("long").alias("order_depth"), F.lit(True).alias("cyclic"))
    return placed.withColumn("cyclic", F.lit(False)).union(cyclic)


#: The message as canonical JSON, its keys in order.
JSON = """concat('{"content":', content, ',"role":', spoken, coalesce(concat(',"tool_call_id":', answers), ''),
  IF(size(calls) = 0, '', concat(',"tool_calls":[', array_join(transform(calls, c -> concat('{"answered":', CAST(array_contains(answered, c.id) AS STRING), ',"arguments":', c.arguments,
    IF(size(c.needs) = 0, '', concat(',"depends_on":[', array_join(c.needs, ','), ']')), ',"id":', c.id, ',"name":', c.name, ',"valid":', coalesce(CAST(c.valid AS STRING), 'null'), '}')), ','), ']')), '}')"""


def link_calls(conversations: DataFrame, schemas: dict[str, dict] | None = None, most: int = 1_000_000) -> DataFrame:
    """One row per message: conv_id, turn, role, order_turn, order_depth, n_calls, n_answered, n_invalid, status, json.

    Calls and results are hash-joined on (conv_id, call id); calls that repeat an id are answered
    together, and results follow the first of them. status is "plain" for a message without calls
    or results, else "linked", "pending" (a call without result), "orphan" (a result without call)
    or "cyclic". Messages are in topological order within a conversation by (order_turn,
    order_depth, turn): a result follows its call and a call follows the results it names in
    depends_on. json is the message as canonical JSON, with each call's arguments, whether they
    fit the schema of their tool (null without one) and whether a result came. Texts stay apart:
    only the edges between messages are gathered by conversation, up to ``most`` of them, and a
    longer conversation is ordered by joins. ``schemas`` maps tool names to JSON schemas and is
    shipped with the tasks: it has to be a stated, small catalogue.

    Rows that repeat are kept, each with the same links. Null texts and roles are JSON nulls,
    null conv_ids and turns are kept and link with nothing. Malformed JSON, and JSON nested beyond
    the parser's depth or with a number beyond a double's range, is plain text. An empty table
    gives an empty result; other columns are not read.
    """
    schemas = schemas or {}
    if len(json.dumps(schemas)) > 8 << 20:
        raise ValueError("the catalogue of schemas is too large to ship with every task")
    with scratch(conversations.sparkSession):
        messages = stored(parsed(conversations, schemas).withColumn("node", F.xxhash64("turn", "role", "text")), "messages", kept=True)
        linkable = messages.filter("conv_id is not null and turn is not null")
        calls = linkable.filter("size(calls) > 0").select("conv_id", F.col("node").alias("caller"), F.col("turn").alias("caller_turn"), F.explode("calls").alias("call"))
        calls = calls.select("conv_id", "caller", "caller_turn", F.col("call.id").alias("id"), F.col("call.needs").alias("needs"))
        first = calls.groupBy("conv_id", "id").agg(F.min(F.struct("caller_turn", "caller")).alias("first"))
        first = first.select(F.col("conv_id").alias("c"), F.col("id").alias("called"), "first.*")
        results = linkable.filter("answers is not null").select("conv_id", F.col("node").alias("result"), F.col("turn").alias("result_turn"), F.col("answers").alias("id")).distinct()
        links = results.join(first, (results["conv_id"] == first["c"]) & (results["id"] == first["called"]), "left")
        links = stored(links.select("conv_id", "id", "result", "result_turn", "caller", "caller_turn"), "tool-links")
        got = links.filter("caller is not null")
        answered = calls.select("conv_id", "caller", "id").distinct().join(got.select("conv_id", "id").distinct(), ["conv_id", "id"])
        answered = answered.groupBy("conv_id", F.col("caller").alias("node")).agg(F.collect_set("id").alias("answered"))  # ids of one message
        orphans = links.filter("caller is null").select("conv_id", F.col("result").alias("node")).distinct()
        # "all results of a call are there" is a node of its own, so that its results and those who wait don't pair up
        done = F.xxhash64(F.lit("results"), F.col("id"))
        none = F.lit(None).cast("long")
        needs = calls.select("conv_id", "caller", "caller_turn", F.explode("needs").alias("id")).distinct().join(got.select("conv_id", "id").distinct(), ["conv_id", "id"])
        edges = got.select("conv_id", F.col("caller").alias("source"), F.col("caller_turn").alias("source_turn"), F.col("result").alias("target"), F.col("result_turn").alias("target_turn"))
        edges = edges.union(got.select("conv_id", "result", "result_turn", done, none)).union(needs.select("conv_id", done, none, "caller", "caller_turn")).distinct()
        places = ordered(stored(edges, "tool-edges"), most).join(orphans.withColumn("orphan", F.lit(True)), ["conv_id", "node"], "full")
        facts = stored(places.join(answered, ["conv_id", "node"], "left"), "tool-facts", kept=True).withColumnsRenamed({"conv_id": "of", "node": "at"})
    out = messages.join(facts, (messages["conv_id"] == facts["of"]) & (messages["node"] == facts["at"]), "left")
    out = out.withColumns({
        "order_turn": F.coalesce("order_turn", "turn"), "order_depth": F.coalesce("order_depth", F.lit(0)).cast("long"), "cyclic": F.coalesce("cyclic", F.lit(False)),
        "answered": F.coalesce("answered", F.array().cast("array<string>")), "orphan": F.coalesce("orphan", F.col("answers").isNotNull() & F.col("at").isNull()),
    })
    count = lambda test: F.expr(f"CAST(size(filter(calls, c -> {test})) AS BIGINT)")
    out = out.withColumns({"n_calls": F.size("calls").cast("long"), "n_answered": count("array_contains(answered, c.id)"), "n_invalid": count("NOT c.valid"), "json": F.expr(JSON)})
    status = F.when((F.size("calls") == 0) & F.col("answers").isNull(), "plain").when(F.col("cyclic"), "cyclic").when(F.col("orphan"), "orphan").when(F.col("n_answered") < F.col("n_calls"), "pending").otherwise("linked")
    return out.select("conv_id", "turn", "role", "order_turn", "order_depth", "n_calls", "n_answered", "n_invalid", status.alias("status"), "json")


#: The tool that ``as_tool_use`` calls, and the bounds of its argument.
CATALOGUE = {"reply": {"type": "object", "required": ["length"], "additionalProperties": False, "properties": {"length": {"type": "integer", "minimum": 1, "maximum": 200}, "question": {"type": "boolean"}}}}


def as_tool_use(conversations: DataFrame) -> DataFrame:
    """``conversations`` read as the use of a tool "reply": (conv_id, turn, role, text), a row per row.

    What a user says in turn t is the call "t", which waits for the results of call "t + 2" where
    t is odd and "t - 2" where it is even; what the assistant says in turn t is the result of
    call "t - 1". Other messages stay as they are.
    """
    call = lambda k: F.concat(F.lit("call "), (F.col("turn") + k).cast("string"))
    arguments = F.struct(F.length("text").alias("length"), F.col("text").rlike("[?]").alias("question"))
    waits = F.array(F.when(F.pmod("turn", F.lit(2)) == 1, call(2)).otherwise(call(-2)))
    asked = F.to_json(F.struct(F.array(F.struct(call(0).alias("id"), F.lit("reply").alias("name"), arguments.alias("arguments"), waits.alias("depends_on"))).alias("tool_calls")))
    told = F.to_json(F.struct(call(-1).alias("tool_call_id"), F.col("text").alias("content")))
    known = F.col("turn").isNotNull()
    return conversations.select(
        "conv_id", "turn",
        F.when((F.col("role") == "user") & known, "assistant").when((F.col("role") == "assistant") & known, "tool").otherwise(F.col("role")).alias("role"),
        F.when((F.col("role") == "user") & known, asked).when((F.col("role") == "assistant") & known, told).otherwise(F.col("text")).alias("text"),
    )


def op9_tool_calls(spark, sf_dir: str) -> DataFrame:
    """Every message of ``conversations``, read as the use of a tool (the table holds no calls of its own), with its place, its links and its canonical JSON."""
    return link_calls(as_tool_use(spark.read.parquet(f"{sf_dir}/conversations.parquet")), CATALOGUE)


OP9_SQL = """
WITH RECURSIVE m AS (
  SELECT conv_id, turn, text, role AS said, CASE WHEN turn IS NULL THEN role WHEN role = 'user' THEN 'assistant' WHEN role = 'assistant' THEN 'tool' ELSE role END AS role,
    turn IS NOT NULL AND coalesce(role = 'user', false) AS asks, turn IS NOT NULL AND coalesce(role = 'assistant', false) AS tells
  FROM conversations),
asked AS (SELECT DISTINCT conv_id, turn FROM m WHERE asks AND conv_id IS NOT NULL),
told AS (SELECT DISTINCT conv_id, turn, turn - 1 AS call FROM m WHERE tells AND conv_id IS NOT NULL),
linked AS (SELECT DISTINCT t.conv_id, t.call FROM told t JOIN asked a ON a.conv_id = t.conv_id AND a.turn = t.call),
waits AS (SELECT a.conv_id, a.turn, CASE WHEN a.turn % 2 = 1 THEN a.turn + 2 ELSE a.turn - 2 END AS needs FROM asked a),
chain AS (SELECT w.conv_id, w.turn, w.needs FROM waits w JOIN linked l ON l.conv_id = w.conv_id AND l.call = w.needs),
-- the place of a call: its turn, or behind the result of the call it waits for
p(conv_id, call, o, d) AS (
  SELECT a.conv_id, a.turn, a.turn, CAST(0 AS BIGINT) FROM asked a WHERE NOT EXISTS (SELECT 1 FROM chain c WHERE c.conv_id = a.conv_id AND c.turn = a.turn)
  UNION ALL
  SELECT x.conv_id, x.call, CASE WHEN x.ro >= x.call THEN x.ro ELSE x.call END, CASE WHEN x.ro >= x.call THEN x.rd + 1 ELSE 0 END
  FROM (SELECT c.conv_id, c.turn AS call, CASE WHEN p.o >= c.needs + 1 THEN p.o ELSE c.needs + 1 END AS ro, CASE WHEN p.o >= c.needs + 1 THEN p.d + 1 ELSE 0 END AS rd
        FROM chain c JOIN p ON p.conv_id = c.conv_id AND p.call = c.needs) x)
SELECT m.conv_id, m.turn, m.role,
  CASE WHEN m.asks AND p.o IS NOT NULL THEN p.o WHEN m.tells AND q.o IS NOT NULL AND q.o >= m.turn THEN q.o ELSE m.turn END AS order_turn,
  CAST(CASE WHEN m.asks AND p.o IS NOT NULL THEN p.d WHEN m.tells AND q.o IS NOT NULL AND q.o >= m.turn THEN q.d + 1 ELSE 0 END AS BIGINT) AS order_depth,
  CAST(m.asks AS BIGINT) AS n_calls, CAST(m.asks AND l.call IS NOT NULL AS BIGINT) AS n_answered,
  CAST(m.asks AND NOT coalesce(length(m.text) BETWEEN 1 AND 200, false) AS BIGINT) AS n_invalid,
  CASE WHEN m.asks THEN CASE WHEN l.call IS NULL THEN 'pending' ELSE 'linked' END WHEN m.tells THEN CASE WHEN q.call IS NULL THEN 'orphan' ELSE 'linked' END ELSE 'plain' END AS status,
  CASE WHEN m.asks THEN '{"content":null,"role":"assistant","tool_calls":[{"answered":' || CASE WHEN l.call IS NULL THEN 'false' ELSE 'true' END || ',"arguments":{'
      || CASE WHEN m.text IS NULL THEN '' ELSE '"length":' || length(m.text) || ',"question":' || CASE WHEN contains(m.text, '?') THEN 'true' ELSE 'false' END END
      || '},"depends_on":["call ' || (m.turn + CASE WHEN m.turn % 2 = 1 THEN 2 ELSE -2 END) || '"],"id":"call ' || m.turn || '","name":"reply","valid":' || CASE WHEN coalesce(length(m.text) BETWEEN 1 AND 200, false) THEN 'true' ELSE 'false' END || '}]}'
    WHEN m.tells THEN '{"content":' || coalesce(CAST(to_json(m.text) AS VARCHAR), 'null') || ',"role":"tool","tool_call_id":"call ' || (m.turn - 1) || '"}'
    ELSE '{"content":' || coalesce(CAST(to_json(m.text) AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(m.role) AS VARCHAR), 'null') || '}' END AS json
FROM m LEFT JOIN linked l ON l.conv_id = m.conv_id AND l.call = m.turn AND m.asks
LEFT JOIN p ON p.conv_id = m.conv_id AND p.call = m.turn AND m.asks
LEFT JOIN p q ON q.conv_id = m.conv_id AND q.call = m.turn - 1 AND m.tells
"""
