"""One query per operator over the driver's tables, and its SQL."""

from __future__ import annotations

from xml.etree import ElementTree

from pyspark.sql import DataFrame, functions as F

from eventloom.operators import analyse, compare, index, indexing, mine, model, query
from eventloom.operators.log import events_log, orders_log, sessions_log
from eventloom.plans import cep
from eventloom.plans.matcher import Bound
from eventloom.sources import readers
from eventloom.sources.store import LogStore, scratch
from eventloom.streaming.index_stream import index_stream

LOG = """log AS (SELECT CAST(user_id AS VARCHAR) AS t, event_type AS a,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS pos,
  CAST(floor(epoch(ts)) AS BIGINT) AS s, value, json_extract_string(props, '$.k') AS k FROM events)"""
SHARE = "(SELECT count(DISTINCT t) FROM log)"
PAIRS = """acts AS (SELECT DISTINCT a FROM log),
m AS (SELECT e.t, x.a AS src, y.a AS tgt, e.a, e.pos, e.s FROM log e JOIN acts x ON true JOIN acts y ON x.a <> y.a WHERE e.a IN (x.a, y.a)),
nx AS (SELECT *, min(CASE WHEN a = tgt THEN pos END) OVER (PARTITION BY t, src, tgt ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS np FROM m),
hit AS (SELECT nx.t, nx.src, nx.tgt, nx.pos AS sp, nx.np AS tp, nx.s AS ss, l.s AS ts FROM nx JOIN log l ON l.t = nx.t AND l.pos = nx.np WHERE nx.a = nx.src AND nx.np IS NOT NULL
  UNION ALL SELECT t, a, a, pos, np, s, ns FROM (SELECT *, lead(pos) OVER w AS np, lead(s) OVER w AS ns FROM log WINDOW w AS (PARTITION BY t, a ORDER BY pos)) WHERE np IS NOT NULL),
pairs AS (SELECT t, src, tgt, min(sp) AS sp, tp, min(ss) AS ss, min(ts) AS ts FROM hit WHERE {limit} GROUP BY t, src, tgt, tp)"""
COUNTS = """counts AS (SELECT src AS source, tgt AS target, CAST(sum(ts - ss) AS BIGINT) AS total_duration, count(*) AS total_completions,
  min(ts - ss) AS min_duration, max(ts - ss) AS max_duration, CAST(sum(CAST((ts - ss) * (ts - ss) AS HUGEINT)) AS DOUBLE) AS sum_squared_duration
  FROM pairs GROUP BY src, tgt)"""
FACTS = """fl AS (SELECT t, a, min(pos) AS f, max(pos) AS l, count(*) AS c FROM log GROUP BY t, a),
n AS (SELECT t, count(*) AS n FROM log GROUP BY t),
dfc AS (SELECT t, a, b, count(*) AS d FROM (SELECT t, a, lead(a) OVER (PARTITION BY t ORDER BY pos) AS b FROM log) WHERE b IS NOT NULL GROUP BY t, a, b),
mm AS (SELECT e.t, x.a AS src, y.a AS tgt, e.a, e.pos FROM log e JOIN fl x ON x.t = e.t JOIN fl y ON y.t = e.t AND y.a <> x.a WHERE e.a IN (x.a, y.a)),
rn AS (SELECT t, src, tgt, count(*) AS r FROM (SELECT *, lead(a) OVER (PARTITION BY t, src, tgt ORDER BY pos) AS nx FROM mm) WHERE a = src AND nx = tgt GROUP BY t, src, tgt),
p AS (SELECT x.t, x.a AS source, y.a AS target, x.f AS af, x.l AS al, x.c AS ac, y.f AS bf, y.l AS bl, y.c AS bc, coalesce(d, 0) AS df, coalesce(r, 0) AS runs
  FROM fl x JOIN fl y USING (t) JOIN n USING (t) LEFT JOIN dfc ON dfc.t = x.t AND dfc.a = x.a AND dfc.b = y.a LEFT JOIN rn ON rn.t = x.t AND rn.src = x.a AND rn.tgt = y.a WHERE n.n >= 2)"""
ORDERED_ROWS = "ord AS (" + " UNION ALL ".join(f"SELECT '{t}' AS template, source, target, t FROM p WHERE {c}" for t, c in mine.ORDERED.items()) + ")"
SESSIONS = LOG.replace("CAST(user_id AS VARCHAR) AS t", "CAST(user_id AS VARCHAR) || ':' || strftime(ts, '%Y-%m-%d') AS t").replace("PARTITION BY user_id", "PARTITION BY user_id, CAST(ts AS DATE)")
LABELS = "lab AS (SELECT t, max(CASE WHEN a = 'purchase' THEN 1 ELSE 0 END) AS label FROM log GROUP BY t)"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, run, sql: str | None = None) -> None:
    """Register ``run(log)`` over the events log."""
    QUERIES[name] = lambda spark, sf_dir: run(events_log(spark, sf_dir))
    if sql:
        SQL[name] = sql


def add_sessions(name: str, run, sql: str) -> None:
    """Register ``run(log)`` over the log of sessions; its SQL is written for LOG."""
    QUERIES[name] = lambda spark, sf_dir: run(sessions_log(spark, sf_dir))
    SQL[name] = sql.replace(LOG, SESSIONS)


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join([LOG, *parts]) + "\n"


# index tables

add("sequence_table", lambda log: log.select("activity", "trace_id", "position", "start_timestamp", F.col("attributes")["k"].alias("k")),
    with_() + "SELECT a AS activity, t AS trace_id, pos AS position, s AS start_timestamp, k FROM log")
QUERIES["sequence_table_ties"] = lambda spark, d: orders_log(spark, d).select("activity", "trace_id", "position", "start_timestamp", F.col("attributes")["status"].alias("status"))
SQL["sequence_table_ties"] = """SELECT o_orderpriority AS activity, CAST(o_custkey AS VARCHAR) AS trace_id,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INTEGER) AS position, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS start_timestamp, o_orderstatus AS status FROM orders"""


def activity_index(spark, sf_dir: str) -> DataFrame:
    """All activities of the stored index."""
    store = LogStore(spark, scratch(spark, "store"))
    indexing.ingest(store, events_log(spark, sf_dir))
    return store.read("activity_index").select("activity", "trace_id", "position", "start_timestamp")


QUERIES["activity_index"] = activity_index
SQL["activity_index"] = with_() + "SELECT a AS activity, t AS trace_id, pos AS position, s AS start_timestamp FROM log"
add("trace_metadata", index.trace_metadata, with_() + "SELECT t AS trace_id, max(pos) AS max_pos FROM log GROUP BY t")
add("log_metadata", index.log_metadata, with_() + "SELECT count(DISTINCT t) AS trace_count, count(*) AS event_count, min(s) AS start_ts, max(s) AS last_ts FROM log")
PAIR_SELECT = "SELECT src AS source, tgt AS target, t AS trace_id, sp AS source_position, tp AS target_position, ss AS source_timestamp, ts AS target_timestamp FROM pairs"
add("pairs_index", index.event_pairs, with_(PAIRS.format(limit="true")) + PAIR_SELECT)
add("pairs_lookback_time", lambda log: index.event_pairs(log, "1d12h"), with_(PAIRS.format(limit="ts - ss <= 129600")) + PAIR_SELECT)
add("pairs_lookback_positions", lambda log: index.event_pairs(log, "3i"), with_(PAIRS.format(limit="tp - sp <= 3")) + PAIR_SELECT)
add("count_table", lambda log: index.count_table(index.event_pairs(log)), with_(PAIRS.format(limit="true"), COUNTS) + "SELECT * FROM counts")
add("last_checked", lambda log: index.last_checked(index.event_pairs(log)), with_(PAIRS.format(limit="true")) + "SELECT t AS trace_id, src AS source, tgt AS target, max(ts) AS last_checked FROM pairs GROUP BY t, src, tgt")


def incremental(log: DataFrame) -> DataFrame:
    """Two batches indexed one after the other: the pairs of the traces that continue are replaced."""
    first = log.filter("position < 20")
    later = log.filter("position >= 20")
    renumbered = later.withColumn("position", (F.col("position") - 20).cast("int"))
    whole = first.unionByName(index.continue_positions(renumbered, index.trace_metadata(first)))
    touched = later.select("trace_id").distinct()
    old = index.event_pairs(first)
    new = index.event_pairs(whole.join(touched, "trace_id", "left_semi"))
    return old.join(touched, "trace_id", "left_anti").unionByName(new).select("source", "target", "trace_id", "source_position", "target_position")


add("incremental_pairs", incremental, with_(PAIRS.format(limit="true")) + "SELECT src AS source, tgt AS target, t AS trace_id, sp AS source_position, tp AS target_position FROM pairs")

# pattern queries

add("statistics", lambda log: query.statistics(index.count_table(index.event_pairs(log)), "view click purchase"),
    with_(PAIRS.format(limit="true"), COUNTS) + """SELECT *, round(total_duration / total_completions, 6) AS avg_duration,
    round(sqrt(greatest(sum_squared_duration / total_completions - (total_duration / total_completions) * (total_duration / total_completions), 0.0)), 3) AS std_duration
    FROM counts WHERE (source = 'view' AND target IN ('click', 'purchase')) OR (source = 'click' AND target = 'purchase')""")


def detection(name: str, pattern: str, found_sql: str) -> None:
    """``found_sql`` selects t and positions (a list) of one match per trace."""
    add(name, lambda log: query.detect(log, pattern).select("trace_id", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"), "support"),
        with_(f"found AS ({found_sql})") + f"SELECT t AS trace_id, array_to_string(positions, ',') AS positions, round((SELECT count(*) FROM found) / {SHARE}, 6) AS support FROM found")


def chain(*steps: str) -> str:
    """CTEs c1, c2, ... with the earliest position of each step after the one before."""
    out = ["c0 AS (SELECT t, -1 AS p0 FROM log GROUP BY t)"]
    for i, test in enumerate(steps, 1):
        out.append(f"c{i} AS (SELECT c.t, {', '.join(f'c.p{j}' for j in range(1, i))}{', ' if i > 1 else ''}min(l.pos) AS p{i} FROM c{i - 1} c JOIN log l ON l.t = c.t AND l.pos > c.p{i - 1} AND {test} GROUP BY ALL)")
    return "WITH " + ", ".join(out) + " "


A = {x: f"l.a = '{x}'" for x in ("signup", "error", "click", "view", "purchase")}
detection("detect_sequence", "signup view purchase", chain(A["signup"], A["view"], A["purchase"]) + "SELECT t, [p1, p2, p3] AS positions FROM c3")
detection("detect_single", "error", chain(A["error"]) + "SELECT t, [p1] AS positions FROM c1")
detection("detect_or", "(signup||error) purchase",
          "SELECT t, [min((a * 1000000 + b)) // 1000000, min((a * 1000000 + b)) % 1000000] AS positions FROM ("
          + chain(A["signup"], A["purchase"]) + "SELECT t, p1 AS a, p2 AS b FROM c2 UNION ALL (" + chain(A["error"], A["purchase"]) + "SELECT t, p1, p2 FROM c2)) GROUP BY t")
detection("detect_plus", "view click+ purchase",
          chain(A["view"], A["click"], A["purchase"]) + "SELECT c3.t, list_concat([p1], list_concat((SELECT list(l.pos ORDER BY l.pos) FROM log l WHERE l.t = c3.t AND l.a = 'click' AND l.pos >= p2 AND l.pos < p3), [p3])) AS positions FROM c3")
detection("detect_star", "signup* purchase",
          "SELECT q.t, list_concat(coalesce((SELECT list(l.pos ORDER BY l.pos) FROM log l WHERE l.t = q.t AND l.a = 'signup' AND l.pos < CASE WHEN q.f < q.p THEN q.p ELSE -1 END), []), [q.p]) AS positions"
          " FROM (SELECT t, min(CASE WHEN a = 'purchase' THEN pos END) AS p, min(CASE WHEN a = 'signup' THEN pos END) AS f FROM log GROUP BY t) q WHERE q.p IS NOT NULL")
FIRST_PAIR = "SELECT t, [min(v * 1000000 + p) // 1000000, min(v * 1000000 + p) % 1000000] AS positions FROM (SELECT x.t, x.pos AS v, y.pos AS p FROM log x JOIN log y ON x.t = y.t AND y.pos > x.pos WHERE {where}) GROUP BY t"
detection("detect_negation", "view !error purchase", FIRST_PAIR.format(where="x.a = 'view' AND y.a = 'purchase' AND NOT EXISTS (SELECT 1 FROM log e WHERE e.t = x.t AND e.a = 'error' AND e.pos > x.pos AND e.pos < y.pos)"))
detection("detect_attribute", 'view[k="3"] purchase', FIRST_PAIR.format(where="x.a = 'view' AND x.k = '3' AND y.a = 'purchase'"))
detection("detect_variable", "view purchase[k=$1]", FIRST_PAIR.format(where="x.a = 'view' AND y.a = 'purchase' AND x.k = y.k"))
detection("detect_variable_offset", "view purchase[k=$1+2]", FIRST_PAIR.format(where="x.a = 'view' AND y.a = 'purchase' AND CAST(y.k AS DOUBLE) = CAST(x.k AS DOUBLE) + 2"))


def every(name: str, pattern: str, found_sql: str, bounds=None, all_=False) -> None:
    """As ``detection``, with bounds, or with a row for each match."""
    add(name, lambda log: query.detect(log, pattern, bounds=bounds, every=all_).select("trace_id", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"), "support"),
        with_(f"found AS ({found_sql})").replace("WITH", "WITH RECURSIVE", 1) + f"SELECT t AS trace_id, array_to_string(positions, ',') AS positions, round((SELECT count(DISTINCT t) FROM found) / {SHARE}, 6) AS support FROM found")


every("detect_within_time", "view purchase", FIRST_PAIR.format(where="x.a = 'view' AND y.a = 'purchase' AND y.s - x.s BETWEEN 3600 AND 86400"), [Bound(0, 1, 3600, 86400)])
every("detect_within_gap", "view purchase", FIRST_PAIR.format(where="x.a = 'view' AND y.a = 'purchase' AND y.pos - x.pos - 1 BETWEEN 1 AND 3"), [Bound(0, 1, 1, 3, "gap")])
every("detect_all", "view purchase", """WITH RECURSIVE nx AS (SELECT t, pos, min(CASE WHEN a = 'view' THEN pos END) OVER w AS nv, min(CASE WHEN a = 'purchase' THEN pos END) OVER w AS np
  FROM (SELECT t, pos, a FROM log UNION ALL SELECT DISTINCT t, -1, '' FROM log) WINDOW w AS (PARTITION BY t ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
  m(t, v, p) AS (SELECT x.t, x.nv, y.np FROM nx x JOIN nx y ON y.t = x.t AND y.pos = x.nv WHERE x.pos = -1 AND y.np IS NOT NULL
    UNION ALL SELECT m.t, x.nv, y.np FROM m JOIN nx x ON x.t = m.t AND x.pos = m.p JOIN nx y ON y.t = m.t AND y.pos = x.nv WHERE y.np IS NOT NULL)
  SELECT t, [v, p] AS positions FROM m""", all_=True)
TWELVE = [f'view[k="{i}"]' for i in range(10)] + ["signup", "error", "purchase"]
every("detect_many_events", f"({'||'.join(TWELVE[:10])}) signup error purchase",
      "SELECT t, [min(p1), min(p2), min(p3), min(p4)] AS positions FROM (" + chain(A["view"] + " AND l.k IN ('0', '1', '2', '3', '4', '5', '6', '7', '8', '9')", A["signup"], A["error"], A["purchase"]) + "SELECT t, p1, p2, p3, p4 FROM c4) GROUP BY t")
add("detect_pruned", lambda log: query.detect(log, "signup view purchase", index.event_pairs(log)).select("trace_id", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"), "support"), SQL["detect_sequence"])
AFTER = with_("c AS (" + chain(A["view"], A["click"]) + "SELECT t, p2 FROM c2)", f"acc AS (SELECT l.a AS next_activity, round(count(DISTINCT l.t) / {SHARE}, 6) AS support FROM log l JOIN c ON c.t = l.t AND l.pos > c.p2 GROUP BY l.a)", PAIRS.format(limit="true"), COUNTS,
              f"fast AS (SELECT target AS next_activity, round(least(total_completions, (SELECT min(total_completions) FROM counts WHERE source = 'view' AND target = 'click')) / {SHARE}, 6) AS support FROM counts WHERE source = 'click')")
counted = lambda log: index.count_table(index.event_pairs(log))
add("explore_accurate", lambda log: query.explore_accurate(log, "view click"), AFTER + "SELECT * FROM acc")

add("explore_variable", lambda log: query.explore_accurate(log, "view purchase[k=$1]"),
    with_("c AS (SELECT x.t, min(y.pos) AS p FROM log x JOIN log y ON y.t = x.t AND y.pos > x.pos AND y.k = x.k WHERE x.a = 'view' AND y.a = 'purchase' GROUP BY x.t)")
    + f"SELECT l.a AS next_activity, round(count(DISTINCT l.t) / {SHARE}, 6) AS support FROM log l JOIN c ON c.t = l.t AND l.pos > c.p GROUP BY l.a")
add("explore_after_negation", lambda log: query.explore_accurate(log, 'view[k="3"] !click'),
    with_() + f"""SELECT y.a AS next_activity, round(count(DISTINCT y.t) / {SHARE}, 6) AS support FROM log x JOIN log y ON y.t = x.t AND y.pos > x.pos
    WHERE x.a = 'view' AND x.k = '3' AND NOT EXISTS (SELECT 1 FROM log e WHERE e.t = x.t AND e.a = 'click' AND e.pos > x.pos AND e.pos < y.pos) GROUP BY y.a""")
add("explore_fast", lambda log: query.explore_fast(counted(log), log, "view click"), AFTER + "SELECT * FROM fast")
add("explore_hybrid", lambda log: query.explore_hybrid(counted(log), log, "view click", 2), AFTER + "SELECT acc.* FROM acc JOIN (SELECT next_activity FROM fast ORDER BY support DESC, next_activity LIMIT 2) USING (next_activity)")

# constraints

SUPPORT = f"round(count(*) / {SHARE}, 6) AS support"
add("mine_positional", lambda log: mine.supported(mine.positional(log), log).select("template", "source", "support"),
    with_() + f"SELECT template, source, {SUPPORT} FROM (SELECT 'init' AS template, a AS source FROM log WHERE pos = 0 UNION ALL SELECT 'end', a FROM log l WHERE pos = (SELECT max(pos) FROM log x WHERE x.t = l.t)) GROUP BY ALL")
add("mine_existential", lambda log: mine.supported(mine.existential(log), log).select("template", "source", "occurrences", "support"),
    with_() + f"SELECT template, source, CAST(n + k AS INTEGER) AS occurrences, {SUPPORT} FROM (SELECT t, a AS source, count(*) AS n FROM log GROUP BY t, a) JOIN (VALUES ('exactly', 0), ('existence', 0), ('absence', 1)) v(template, k) ON true GROUP BY ALL")
for _t, _c in mine.ORDERED.items():
    add_sessions(f"mine_{_t}", lambda log, t=_t: mine.supported(mine.ordered(log, [t]), log).select("template", "source", "target", "support"),
        with_(FACTS) + f"SELECT '{_t}' AS template, source, target, {SUPPORT} FROM p WHERE {_c} GROUP BY source, target")
add("mine_ordered_users", lambda log: mine.supported(mine.ordered(log), log).select("template", "source", "target", "support"), with_(FACTS, ORDERED_ROWS) + f"SELECT template, source, target, {SUPPORT} FROM ord GROUP BY ALL")
BOTH = "acts AS (SELECT DISTINCT a FROM log), ab AS (SELECT x.a AS source, y.a AS target FROM acts x JOIN acts y ON x.a < y.a), own AS (SELECT DISTINCT t, a FROM log), tr AS (SELECT DISTINCT t FROM log), seen AS (SELECT tr.t, source, target, EXISTS (SELECT 1 FROM own o WHERE o.t = tr.t AND o.a = source) AS x, EXISTS (SELECT 1 FROM own o WHERE o.t = tr.t AND o.a = target) AS y FROM tr JOIN ab ON true)"
for _t, _c in {"coexistence": "x AND y", "choice": "x OR y", "exclusive_choice": "x <> y"}.items():
    add_sessions(f"mine_{_t}", lambda log, t=_t: mine.supported(mine.unordered(log).filter(F.col("template") == t), log).select("template", "source", "target", "support"),
        f"WITH {LOG}, {BOTH} SELECT '{_t}' AS template, source, target, {SUPPORT} FROM seen WHERE {_c} GROUP BY source, target")
add_sessions("mine_not_coexistence", lambda log: mine.negation(log).select("template", "source", "target", "trace_id"),
    f"WITH {LOG}, {BOTH} SELECT 'not_coexistence' AS template, source, target, t AS trace_id FROM seen WHERE NOT (x AND y)")
add_sessions("mine_not_coexistence_support", lambda log: mine.negation_support(log),
    f"WITH {LOG}, {BOTH} SELECT source, target, CAST(sum(CASE WHEN x AND y THEN 0 ELSE 1 END) AS BIGINT) AS n_traces FROM seen GROUP BY source, target")
add_sessions("mine_trace_lists", lambda log: mine.supported(mine.ordered(log, ["chain_response", "response"]), log, 0.01, True).select("template", "source", "target", "support", "trace_ids"),
    with_(FACTS, ORDERED_ROWS) + f"SELECT template, source, target, {SUPPORT}, string_agg(t, '|' ORDER BY t) AS trace_ids FROM ord WHERE template IN ('chain_response', 'response') GROUP BY template, source, target HAVING round(count(*) / {SHARE}, 6) >= 0.01")

# analysis

DF = f"""dfw AS (SELECT t, a, s, lead(a) OVER w AS b, lead(s) OVER w AS ns FROM log WINDOW w AS (PARTITION BY t ORDER BY pos)),
dfr AS (SELECT a AS activity, b AS next_activity, round(count(DISTINCT t) / {SHARE}, 6) AS support, count(*) AS n, round(avg(ns - s), 6) AS avg_duration,
  CAST(min(ns - s) AS DOUBLE) AS min_duration, CAST(max(ns - s) AS DOUBLE) AS max_duration FROM dfw WHERE b IS NOT NULL GROUP BY a, b)"""
add("directly_follows", analyse.directly_follows, with_(DF) + "SELECT * FROM dfr")
add("directly_follows_rare", lambda log: analyse.directly_follows(log, 0.9, True), with_(DF) + "SELECT * FROM dfr WHERE support <= 0.9")
ENDED = lambda log: log.withColumn("attributes", F.map_concat("attributes", F.create_map(F.lit("end"), (F.col("start_timestamp") + F.col("attributes")["k"].cast("long") + 1).cast("string"))))
add("directly_follows_end_time", lambda log: analyse.directly_follows(ENDED(log), end_time="end"),
    with_(DF.replace("lead(s) OVER w AS ns", "s + CAST(k AS BIGINT) + 1 AS ns")) + "SELECT * FROM dfr")
add("since_timestamp", lambda log: analyse.since(log, "2024-01-10 12:00:00").groupBy("activity").agg(F.count("*").alias("n"), F.min("start_timestamp").alias("first")),
    with_() + "SELECT a AS activity, count(*) AS n, min(s) AS first FROM log WHERE s >= epoch(TIMESTAMP '2024-01-10 12:00:00') GROUP BY a")
DUR = "round(avg(d), 6) AS avg_duration_sec, CAST(min(d) AS DOUBLE) AS min_duration_sec, CAST(max(d) AS DOUBLE) AS max_duration_sec, count(*) AS occurrence_count"
STEP = "st AS (SELECT t, a, k, s, lead(s) OVER (PARTITION BY t ORDER BY pos) - s AS d FROM log)"
add("durations_activity", analyse.activity_durations, with_(STEP) + f"SELECT a AS activity, {DUR} FROM st WHERE d IS NOT NULL GROUP BY a")
add("durations_per_group", lambda log: analyse.activity_durations(log, grouping_key="k", per_group=True), with_(STEP) + f"SELECT k AS group_k, a AS activity, {DUR} FROM st WHERE d IS NOT NULL GROUP BY k, a")
add("durations_group", analyse.group_durations, with_() + "SELECT t AS trace_id, CAST(max(s) - min(s) AS DOUBLE) AS duration_sec FROM log GROUP BY t")
LOOP = f"""oc AS (SELECT t, a, pos, lead(pos) OVER (PARTITION BY t, a ORDER BY pos) AS nx FROM log),
lp AS (SELECT DISTINCT o.t, CASE WHEN nx = o.pos + 1 THEN o.a ELSE (SELECT string_agg(l.a, ' -> ' ORDER BY l.pos) FROM log l WHERE l.t = o.t AND l.pos BETWEEN o.pos AND o.nx) END AS pattern,
  CASE WHEN nx = o.pos + 1 THEN 'self_loop' ELSE 'non_self_loop' END AS loop_type FROM oc o WHERE nx IS NOT NULL)
SELECT pattern, loop_type, count(*) AS group_count, round(count(*) / {SHARE}, 6) AS support FROM lp GROUP BY pattern, loop_type"""
add("loops", analyse.loops, with_(LOOP))
add("self_loops_frequent", lambda log: analyse.loops(log, threshold=0.5).filter("loop_type = 'self_loop'"), f"SELECT * FROM ({with_(LOOP)}) WHERE loop_type = 'self_loop' AND support >= 0.5")

ATTR = "att AS (SELECT t, pos, a, 'k' AS attr_key, k AS attr_value FROM log WHERE k IS NOT NULL)"
DEV = ["trace_id", "position", "activity", "attr_key", "attr_value", "step", "context", "score", "is_deviation"]
only_k = lambda log: log.withColumn("attributes", F.create_map(F.lit("k"), F.concat(F.lit("v"), F.col("attributes")["k"])))
only_value = lambda log: log.withColumn("attributes", F.create_map(F.lit("k"), F.col("attributes")["k"]))
WORDS = ATTR.replace("k AS attr_value", "'v' || k AS attr_value")


def rounded(column: str, digits: int):
    """``column`` rounded as SQL rounds a double: to a whole number of its multiple; F.round takes the double's decimal text."""
    return F.round(F.col(column) * 10.0**digits, 0) / 10.0**digits


def deviation(name: str, step: str, run, sql: str) -> None:
    add(name, lambda log: analyse.deviations(run(log), [step], surprise_threshold=4.0, z_threshold=1.5).select(*DEV).withColumn("score", rounded("score", 10)), sql)


def dev_select(step: str, context: str, score: str, limit: float, source: str) -> str:
    return f"SELECT t AS trace_id, pos AS position, a AS activity, attr_key, attr_value, '{analyse.STEPS[step]}' AS step, {context} AS context, round({score}, 10) AS score, {score} >= {limit} AS is_deviation FROM {source}"


def surprise_sql(keys: str) -> str:
    return f"sc AS (SELECT *, -log2((count(*) OVER (PARTITION BY {keys}, attr_value) + 1.0) / (count(*) OVER (PARTITION BY {keys}) + 1.0 * ((SELECT count(DISTINCT attr_value) FROM src z WHERE {' AND '.join(f'z.{k.strip()} = src.{k.strip()}' for k in keys.split(','))}) + 1))) AS score FROM src)"


def z_sql(keys: str) -> str:
    return (f"md AS (SELECT {keys}, quantile_disc(CAST(attr_value AS DOUBLE), 0.5) AS med FROM src GROUP BY {keys}), ad AS (SELECT src.*, med, abs(CAST(attr_value AS DOUBLE) - med) AS ad FROM src JOIN md USING ({keys})), "
            f"mx AS (SELECT {keys}, quantile_disc(ad, 0.5) AS mad FROM ad GROUP BY {keys}), sc AS (SELECT ad.*, CASE WHEN mad = 0 THEN 0.0 ELSE abs(0.6745 * (CAST(attr_value AS DOUBLE) - med) / mad) END AS score FROM ad JOIN mx USING ({keys}))")


BUCKET = "src AS (SELECT att.*, least(CAST(floor(CASE WHEN mp = 0 THEN 0.0 ELSE pos / mp END * 5) AS INTEGER), 4) AS bucket FROM att JOIN (SELECT t, max(pos) AS mp FROM log GROUP BY t) USING (t))"
GRAM = "gr AS (SELECT t, pos, lag(a) OVER (PARTITION BY t ORDER BY pos) || '->' || a AS ngram FROM log), g2 AS (SELECT att.*, ngram, count(*) OVER (PARTITION BY ngram, attr_key) AS gc FROM att JOIN gr USING (t, pos) WHERE ngram IS NOT NULL), src AS (SELECT * FROM g2 WHERE gc >= 5)"
deviation("deviation_inter_trace", "0a", only_k, with_(WORDS, f"sc AS (SELECT att.*, -log2(greatest(n / {SHARE}, 1e-9)) AS score FROM att JOIN (SELECT attr_key, attr_value, count(DISTINCT t) AS n FROM att GROUP BY ALL) USING (attr_key, attr_value))") + dev_select("0a", "'inter_trace_support'", "score", 4.0, "sc"))
deviation("deviation_intra_trace", "0b", only_k, with_(WORDS, "it AS (SELECT t, attr_key, attr_value, count(*) AS cnt FROM att GROUP BY ALL), md AS (SELECT attr_key, attr_value, quantile_disc(cnt, 0.5) AS med FROM it GROUP BY ALL), ad AS (SELECT *, abs(cnt - med) AS ad FROM it JOIN md USING (attr_key, attr_value)), mx AS (SELECT attr_key, attr_value, quantile_disc(ad, 0.5) AS mad FROM ad GROUP BY ALL), sc AS (SELECT att.*, CASE WHEN mad = 0 THEN 0.0 ELSE abs(0.6745 * (cnt - med) / mad) END AS score FROM att JOIN ad USING (t, attr_key, attr_value) JOIN mx USING (attr_key, attr_value))") + dev_select("0b", "'intra_trace_count'", "score", 1.5, "sc"))
deviation("deviation_activity_category", "1", only_k, with_(WORDS, "src AS (SELECT * FROM att)", surprise_sql("a, attr_key")) + dev_select("1", "a", "score", 4.0, "sc"))
deviation("deviation_activity_number", "1", only_value, with_(ATTR, "src AS (SELECT * FROM att)", z_sql("a, attr_key")) + dev_select("1", "a", "score", 1.5, "sc"))
deviation("deviation_position", "2", only_k, with_(WORDS, BUCKET, surprise_sql("a, bucket, attr_key")) + dev_select("2", "'act=' || a || '|bucket=' || bucket", "score", 4.0, "sc"))
deviation("deviation_ngram", "3", only_k, with_(WORDS, GRAM, surprise_sql("ngram, attr_key")) + dev_select("3", "ngram", "score", 4.0, "sc"))
deviation("deviation_transition", "4", only_k, with_(WORDS, "mv AS (SELECT *, lag(attr_value) OVER (PARTITION BY t, attr_key ORDER BY pos) AS prev FROM att), m2 AS (SELECT *, prev || '->' || attr_value AS mv FROM mv WHERE prev IS NOT NULL), sc AS (SELECT *, -log2((count(*) OVER (PARTITION BY attr_key, mv) + 1.0) / (count(*) OVER (PARTITION BY attr_key) + 1.0 * ((SELECT count(DISTINCT mv) FROM m2 z WHERE z.attr_key = m2.attr_key) + 1))) AS score, count(*) OVER (PARTITION BY attr_key) AS tot FROM m2)") + dev_select("4", "prev", "score", 4.0, "sc WHERE tot >= 5"))
MOVES = "mv AS (SELECT *, lag(attr_value) OVER (PARTITION BY t, attr_key ORDER BY pos) AS prev FROM att), m2 AS (SELECT *, prev || '->' || attr_value AS mv FROM mv WHERE prev IS NOT NULL)"
add("deviation_records", lambda log: analyse.deviation_records(analyse.deviations(only_k(log), ["0a", "1", "4"], surprise_threshold=3.5), only_k(log)).select("trace_id", "position", "activity", "attr_key", "attr_value", "inter_trace_support", "intra_trace_support", F.array_join("flagged_by", ",").alias("flagged_by")),
    with_(WORDS, "src AS (SELECT * FROM att)", MOVES, surprise_sql("a, attr_key"),
          f"inter AS (SELECT attr_key, attr_value, count(DISTINCT t) / {SHARE} AS sup FROM att GROUP BY ALL)",
          "cell AS (SELECT t, a, attr_key, attr_value, round(count(*) / sum(count(*)) OVER (PARTITION BY t, a, attr_key), 4) AS sup FROM att GROUP BY t, a, attr_key, attr_value)",
          "tr AS (SELECT *, -log2((count(*) OVER (PARTITION BY attr_key, mv) + 1.0) / (count(*) OVER (PARTITION BY attr_key) + 1.0 * ((SELECT count(DISTINCT mv) FROM m2) + 1))) AS score FROM m2)",
          f"hits AS (SELECT t, pos, '{analyse.STEPS['1']}' AS step FROM sc WHERE score >= 3.5 UNION SELECT t, pos, '{analyse.STEPS['4']}' FROM tr WHERE score >= 3.5 UNION SELECT t, pos, '{analyse.STEPS['0a']}' FROM att JOIN inter USING (attr_key, attr_value) WHERE -log2(greatest(sup, 1e-9)) >= 3.5)",
          "flags AS (SELECT t, pos, string_agg(step, ',' ORDER BY step) AS flagged_by FROM hits GROUP BY t, pos)")
    + "SELECT att.t AS trace_id, att.pos AS position, att.a AS activity, attr_key, attr_value, round(inter.sup, 4) AS inter_trace_support, cell.sup AS intra_trace_support, flagged_by FROM att JOIN flags USING (t, pos) JOIN inter USING (attr_key, attr_value) JOIN cell ON cell.t = att.t AND cell.a = att.a AND cell.attr_key = att.attr_key AND cell.attr_value = att.attr_value".replace("JOIN inter USING (attr_key, attr_value) JOIN cell", "JOIN inter USING (attr_key, attr_value) JOIN cell").replace("attr_key, attr_value, round", "att.attr_key, att.attr_value, round"))
mixed = lambda log: log.withColumn("attributes", F.create_map(F.lit("k"), F.concat(F.lit("v"), F.col("attributes")["k"]), F.lit("value"), F.col("attributes")["value"]))
add("deviation_both_kinds", lambda log: analyse.deviations(mixed(log), ["1", "3"], surprise_threshold=4.0, z_threshold=1.5).select(*[c for c in DEV if c != "attr_value"]).withColumn("score", rounded("score", 6)),
    with_("va AS (SELECT t, pos, a, 'value' AS attr_key, value AS v FROM log WHERE value IS NOT NULL)", WORDS, "gr AS (SELECT t, pos, lag(a) OVER (PARTITION BY t ORDER BY pos) || '->' || a AS ngram FROM log)",
          "ctx AS (SELECT t, pos, a, '1' AS step, a AS context FROM log UNION ALL SELECT l.t, l.pos, l.a, '3', ngram FROM log l JOIN gr USING (t, pos) WHERE ngram IS NOT NULL)",
          "num AS (SELECT c.*, attr_key, v FROM ctx c JOIN va ON va.t = c.t AND va.pos = c.pos)", "cat AS (SELECT c.*, attr_key, attr_value FROM ctx c JOIN att ON att.t = c.t AND att.pos = c.pos)",
          "md AS (SELECT step, context, quantile_disc(v, 0.5) AS med, count(*) AS total FROM num GROUP BY ALL)", "ad AS (SELECT step, context, quantile_disc(abs(v - med), 0.5) AS mad FROM num JOIN md USING (step, context) GROUP BY ALL)",
          "cc AS (SELECT step, context, attr_value, count(*) AS n FROM cat GROUP BY ALL)", "ct AS (SELECT step, context, sum(n) AS total, count(*) AS voc FROM cc GROUP BY ALL)",
          "sc AS (SELECT t, pos, a, attr_key, step, context, CASE WHEN mad = 0 THEN 0.0 ELSE abs(0.6745 * (v - med) / mad) END AS score, 1.5 AS lim, total FROM num JOIN md USING (step, context) JOIN ad USING (step, context)"
          " UNION ALL SELECT t, pos, a, attr_key, step, context, -log2((n + 1.0) / (total + 1.0 * (voc + 1))), 4.0, total FROM cat JOIN cc USING (step, context, attr_value) JOIN ct USING (step, context))")
    + f"SELECT t AS trace_id, pos AS position, a AS activity, attr_key, CASE step WHEN '1' THEN '{analyse.STEPS['1']}' ELSE '{analyse.STEPS['3']}' END AS step, context, round(score, 6) AS score, score >= lim AS is_deviation FROM sc WHERE step = '1' OR total >= 5")
add_sessions("deviation_on_rare", lambda log: analyse.on_rare(log, mine.ordered(log), 0.1).select("trace_id", "position", "activity"),
    with_(FACTS, ORDERED_ROWS, f"rules AS (SELECT template, source, target FROM ord GROUP BY ALL HAVING count(*) >= 0.1 * {SHARE}), ok AS (SELECT t, count(*) AS n FROM ord JOIN rules USING (template, source, target) GROUP BY t)")
    + "SELECT t AS trace_id, pos AS position, a AS activity FROM log LEFT JOIN ok USING (t) WHERE coalesce(n, 0) < (SELECT count(*) FROM rules)")

# comparison

labelled = lambda log: compare.trace_labels(log, ["purchase"])
add_sessions("trace_labels", lambda log: compare.trace_labels(log, ["purchase", "signup"]), f"WITH {LOG} SELECT t AS trace_id, max(CASE WHEN a IN ('purchase', 'signup') THEN 1 ELSE 0 END) AS label FROM log GROUP BY t")


def gram_sql(n: int) -> str:
    parts = " || ' -> ' || ".join(["a"] + [f"lead(a, {i}) OVER w" for i in range(1, n)])
    tot = "(SELECT greatest(sum(label), 1) FROM lab)", "(SELECT greatest(sum(1 - label), 1) FROM lab)"
    bal = f"(count_1 / {tot[0]} - count_0 / {tot[1]})"
    return with_(LABELS, f"g AS (SELECT DISTINCT t, ngram FROM (SELECT t, {parts} AS ngram FROM log WINDOW w AS (PARTITION BY t ORDER BY pos)) WHERE ngram IS NOT NULL)",
                 "c AS (SELECT ngram, CAST(sum(label) AS BIGINT) AS count_1, CAST(sum(1 - label) AS BIGINT) AS count_0 FROM g JOIN lab USING (t) GROUP BY ngram)") + f"""SELECT ngram, count_1, count_0, round({bal}, 6) AS balance,
      round(count_1 / (count_1 + count_0), 6) AS confidence_1, round(count_0 / (count_1 + count_0), 6) AS confidence_0, round(count_1 / {tot[0]}, 6) AS support_1, round(count_0 / {tot[1]}, 6) AS support_0,
      round((count_1 + count_0) / ({tot[0]} + {tot[1]}), 6) AS support, CASE WHEN {bal} > 0 THEN 'label_1' WHEN {bal} < 0 THEN 'label_0' ELSE 'neutral' END AS direction FROM c"""


add_sessions("ngrams_2", lambda log: compare.ngrams(log, labelled(log), 2), gram_sql(2))
add_sessions("ngrams_3", lambda log: compare.filtered(compare.ngrams(log, labelled(log), 3), {"balance": {"abs_gt": 0.002}}), f"SELECT * FROM ({gram_sql(3)}) WHERE abs(balance) > 0.002")
add_sessions("rare_rules", lambda log: compare.rare_rules(mine.ordered(log, ["response", "precedence", "chain_response"]), labelled(log), log, 0.6).select("template", "source", "target", F.array_join("trace_ids", ",").alias("trace_ids")),
    with_(FACTS, LABELS, ORDERED_ROWS.replace("ord AS (", "ord0 AS ("), "ord AS (SELECT * FROM ord0 WHERE template IN ('response', 'precedence', 'chain_response'))", f"rare AS (SELECT source, target FROM ord GROUP BY ALL HAVING count(DISTINCT t) <= 0.6 * {SHARE})")
    + "SELECT template, source, target, string_agg(t, ',' ORDER BY t) AS trace_ids FROM ord JOIN rare USING (source, target) JOIN lab USING (t) WHERE label = 1 GROUP BY template, source, target")
add_sessions("targeted_rules", lambda log: compare.targeted_rules(mine.ordered(log, ["response", "precedence"]), labelled(log), 1, 0.05, 0.3).select("template", "source", "target", F.expr("array_join(transform(trace_ids, x -> concat(x.trace_id, ':', x.label)), ',')").alias("trace_ids")),
    with_(FACTS, LABELS, ORDERED_ROWS.replace("ord AS (", "ord0 AS ("), "ord AS (SELECT * FROM ord0 WHERE template IN ('response', 'precedence'))",
          "kept AS (SELECT source, target FROM (SELECT DISTINCT source, target, t FROM ord) JOIN lab USING (t) GROUP BY ALL HAVING avg(label) >= 0.3 AND sum(label) >= 0.05 * (SELECT sum(label) FROM lab) AND sum(label) > 0)")
    + "SELECT template, source, target, string_agg(t || ':' || label, ',' ORDER BY t) AS trace_ids FROM ord JOIN kept USING (source, target) JOIN lab USING (t) GROUP BY template, source, target")

# models

GRAPH = """gw AS (SELECT a, lead(a) OVER w AS b, lag(a) OVER w AS before FROM log WINDOW w AS (PARTITION BY t ORDER BY pos)),
graph AS (SELECT kind, source, target, count(*) AS frequency FROM (SELECT 'edge' AS kind, a AS source, b AS target FROM gw WHERE b IS NOT NULL UNION ALL SELECT 'start', NULL, a FROM gw WHERE before IS NULL UNION ALL SELECT 'end', a, NULL FROM gw WHERE b IS NULL) GROUP BY ALL)"""
add("dfg", model.dfg, with_(GRAPH) + "SELECT * FROM graph")
add("dfg_without_noise", lambda log: model.without_noise(model.dfg(log), 0.2), with_(GRAPH, "e AS (SELECT *, coalesce(sum(frequency) OVER (ORDER BY frequency DESC, source, target ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(frequency) OVER () AS total FROM graph WHERE kind = 'edge')")
    + "SELECT kind, source, target, frequency FROM e WHERE before < 0.8 * total UNION ALL SELECT * FROM graph WHERE kind <> 'edge'")
VAR = "va AS (SELECT t, string_agg(a, ' ' ORDER BY pos) AS variant FROM log GROUP BY t)"
add_sessions("trace_variants", lambda log: model.variants(log).withColumn("variant", F.array_join("variant", " ")), f"WITH {LOG}, {VAR} SELECT variant, count(*) AS n_traces, round(count(*) / {SHARE}, 6) AS share FROM va GROUP BY variant")
add_sessions("frequent_variants", lambda log: model.frequent_variants(log, 0.5).select("trace_id", "position", "activity"),
    f"WITH {LOG}, {VAR}, f AS (SELECT variant, count(*) AS n FROM va GROUP BY variant), z AS (SELECT n, coalesce(sum(sum(n)) OVER (ORDER BY n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f GROUP BY n) SELECT t AS trace_id, pos AS position, a AS activity FROM log JOIN va USING (t) JOIN f USING (variant) JOIN z USING (n) WHERE z.before < 0.5 * {SHARE}")
add("model_annotations", model.annotations, with_(STEP) + "SELECT a AS activity, count(*) AS frequency, round(avg(d), 6) AS avg_duration FROM st GROUP BY a")
QUERIES["bpmn"] = lambda spark, d: spark.createDataFrame([(model.bpmn_xml(model.discover(sessions_log(spark, d), 0.2)),)], "bpmn string")


def exported_graph(spark, sf_dir: str) -> DataFrame:
    """The graph's edges as read back from its XML."""
    root = ElementTree.fromstring(model.dfg_xml(model.dfg(events_log(spark, sf_dir))))
    rows = [(e.tag, e.get("source"), e.get("target"), int(e.get("frequency"))) for e in root if e.tag != "node"]
    return spark.createDataFrame(rows, "kind string, source string, target string, frequency long")


QUERIES["dfg_xml"], SQL["dfg_xml"] = exported_graph, SQL["dfg"]


# sources, the store, streams, composite patterns

PLAIN = "SELECT a AS activity, t AS trace_id, pos AS position, s AS start_timestamp FROM log"
SOURCE = readers.Mapping({"trace_id": "user", "activity": "kind", "position": "event_id", "start_timestamp": "at", "attributes": ["k"]})


def source_rows(spark, sf_dir: str) -> DataFrame:
    """``events`` as a source table of texts."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").cast("string").alias("user"), F.col("event_type").alias("kind"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("at"), F.get_json_object("props", "$.k").alias("k"), F.col("event_id").cast("string").alias("event_id"))


def through(kind: str):
    """The log as read back from files of a kind."""

    def run(spark, sf_dir: str) -> DataFrame:
        path, rows = f"{scratch(spark, kind)}/log.{kind}", source_rows(spark, sf_dir)
        if kind == "csv":
            rows.write.csv(path, header=True)
        elif kind == "jsonl":
            rows.write.json(path)
        elif kind == "json":  # an array of objects in each file
            rows.groupBy(F.spark_partition_id()).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value")).select("value").write.text(path)
        else:
            tag = lambda name, key, value: F.concat(F.lit(f'<{name} key="{key}" value="'), value, F.lit('"/>'))
            event = F.concat(F.lit("<event>"), tag("string", "concept:name", F.col("kind")), tag("date", "time:timestamp", F.col("at")), tag("int", "k", F.col("k")), F.lit("</event>"))
            traces = rows.select("user", F.struct("at", F.col("event_id").cast("long").alias("id"), event.alias("x")).alias("e")).groupBy("user").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["x"]), "\n").alias("body"))
            traces = traces.select(F.lit(1).alias("o"), F.concat(F.lit("<trace>"), tag("string", "concept:name", F.col("user")), F.col("body"), F.lit("</trace>")).alias("value"))
            ends = spark.createDataFrame([(0, "<log>"), (2, "</log>")], "o int, value string")
            traces.union(ends).repartition(1).sortWithinPartitions("o").select("value").write.text(path)  # one document
        mapping = None if kind == "xes" else SOURCE
        # files keep whole seconds, events of one second keep their order by event_id
        return readers.read_log(spark, path, mapping, kind).select("activity", "trace_id", "position", "start_timestamp")

    return run


for _k in ("csv", "jsonl", "json", "xes"):
    QUERIES[f"read_{_k}"] = through(_k)
    SQL[f"read_{_k}"] = with_() + PLAIN


def stored_index(spark, sf_dir: str) -> DataFrame:
    """The stored pairs after two batches, each trace being continued by the second."""
    log, store = events_log(spark, sf_dir), LogStore(spark, scratch(spark, "store"))
    early = F.col("position") < 20
    indexing.ingest(store, log.filter(early))
    indexing.ingest(store, log.filter(~early).withColumn("position", (F.col("position") - 20).cast("int")))
    return store.read("pairs_index").select(*index.PAIR_COLUMNS[:7])


QUERIES["stored_index"], SQL["stored_index"] = stored_index, SQL["pairs_index"]


def streamed_index(spark, sf_dir: str) -> DataFrame:
    """The count table after the log came as a stream of JSON files."""
    root = scratch(spark, "stream")
    source_rows(spark, sf_dir).write.json(f"{root}/in")
    store = LogStore(spark, root)
    index_stream(readers.json_stream(spark, f"{root}/in", SOURCE), store, f"{root}/checkpoint", SOURCE).awaitTermination()
    return store.read("count_table").select("source", "target", "total_duration", "total_completions", "min_duration", "max_duration", "sum_squared_duration")


QUERIES["streamed_index"], SQL["streamed_index"] = streamed_index, SQL["count_table"]
NEAR = cep.Composite(cep.Seq((cep.Prim("view", "v"), cep.Prim("purchase", "p"))), within=86400)
ANY_ORDER = cep.Composite(cep.And((cep.Prim("signup", "s"), cep.Prim("error", "e"))), contiguous=("s", "e"))
add("composite_patterns", lambda log: cep.detect_composite(log, {"near": NEAR, "any_order": ANY_ORDER}).withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ",")),
    with_() + """SELECT 'near' AS pattern, x.t AS trace_id, x.pos || ',' || y.pos AS positions FROM log x JOIN log y ON x.t = y.t AND y.pos > x.pos AND y.s - x.s <= 86400 WHERE x.a = 'view' AND y.a = 'purchase'
UNION ALL SELECT 'any_order', x.t, x.pos || ',' || y.pos FROM log x JOIN log y ON x.t = y.t AND y.pos = x.pos + 1 WHERE (x.a = 'signup' AND y.a = 'error') OR (x.a = 'error' AND y.a = 'signup')""")
