"""Pairs, batches, sources, the store, streams, models and endpoints."""

import json
import random
import threading
import urllib.request

import pytest

from eventloom.api import Engine, serve
from eventloom.functions.lookback import Lookback, lookback
from eventloom.operators import compare, index, indexing, mine, model
from eventloom.operators.log import SCHEMA
from eventloom.sources import readers, sinks
from eventloom.sources.store import LogStore


def make(spark, traces):
    return spark.createDataFrame([(a, t, p, p * 10, {}) for t, s in traces.items() for p, a in enumerate(s)], SCHEMA)


def walk(seq, a, b, limit=None):
    """Pointer walk: each source takes the next unused target; one out of the lookback stays for the next source."""
    out, free = [], 0
    targets = [i for i, x in enumerate(seq) if x == b]
    previous = -1
    for i, x in enumerate(seq):
        if x != a or i < previous:
            continue
        while free < len(targets) and targets[free] <= i:
            free += 1
        if free < len(targets) and (limit is None or targets[free] - i <= limit):
            out.append((i, targets[free]))
            previous = targets[free]
            free += 1
    return out


@pytest.mark.parametrize("limit", [None, 1, 2, 4])
def test_pairs_equal_a_pointer_walk(spark, limit):
    rng = random.Random(limit)
    traces = {str(i): "".join(rng.choice("ABC") for _ in range(rng.randint(1, 12))) for i in range(120)}
    got = {(r.trace_id, r.source, r.target, r.source_position, r.target_position) for r in index.event_pairs(make(spark, traces), f"{limit}i" if limit else None).collect()}
    assert got == {(t, a, b, i, j) for t, s in traces.items() for a in set(s) for b in set(s) for i, j in walk(s, a, b, limit)}


def test_lookback():
    assert lookback("25d16m0.5s") == Lookback(seconds=25 * 86400 + 16 * 60 + 0.5)
    assert lookback("255i") == Lookback(positions=255) and lookback(None) == Lookback()
    with pytest.raises(ValueError):
        lookback("7 weeks")


def test_batches(spark, tmp_path):
    first, second = {"t1": "ABC", "t2": "AD", "t3": "BCDE"}, {"t1": "DE", "t4": "CAB"}
    store = LogStore(spark, f"file://{tmp_path}")
    assert not store.exists()
    meta = indexing.ingest(store, make(spark, first))
    assert (meta["event_count"], meta["pair_count"], meta["trace_count"]) == (9, 10, 3)
    meta = indexing.ingest(store, make(spark, second))
    assert (meta["event_count"], meta["pair_count"], meta["trace_count"]) == (14, 20, 4)
    per = dict(store.read("pairs_index").groupBy("trace_id").count().collect())
    assert per == {"t1": 10, "t2": 1, "t3": 6, "t4": 3}
    assert sum(r.total_completions for r in store.read("count_table").collect()) == 20
    assert store.read("activity_index").filter("activity = 'A'").count() == 3
    store.clear()
    assert not store.exists() and store.read("sequence_table", SCHEMA).count() == 0


def tables(store):
    out = {t: sorted(map(str, store.read(t).select(*sorted(store.read(t).columns)).collect())) for t in ("sequence_table", "activity_index", "pairs_index", "count_table")}
    out["last_checked"] = sorted(map(str, indexing.last_checked(store).collect()))
    out["trace_metadata"] = sorted(map(tuple, store.read("trace_metadata").groupBy("trace_id").max("max_pos").collect()))
    return out, {k: v for k, v in store.facts().items() if k != "mined"}


def batches(rng, n):
    return [{f"t{rng.randint(0, 9)}": "".join(rng.choices("ABCD", k=rng.randint(1, 4))) for _ in range(4)} for _ in range(n)]


def timed(spark, traces, number):
    return make(spark, traces).selectExpr("activity", "trace_id", "position", f"start_timestamp + {number} * 1000L as start_timestamp", "attributes")


@pytest.mark.parametrize("lookback", [None, "3i"])
def test_batches_equal_one_load(spark, tmp_path, monkeypatch, lookback):
    monkeypatch.setattr(indexing, "MOST_PARTS", 2)
    parts = batches(random.Random(3), 5)
    store, one = LogStore(spark, f"file://{tmp_path}/a", buckets=3), LogStore(spark, f"file://{tmp_path}/b")
    for i, b in enumerate(parts):
        indexing.ingest(store, timed(spark, b, i), lookback, number=i)
        indexing.ingest(store, timed(spark, b, i), lookback, number=i)  # a batch that comes again
    whole = {}
    for i, b in enumerate(parts):
        for t, s in b.items():
            whole.setdefault(t, []).extend((a, p * 10 + i * 1000) for p, a in enumerate(s))
    rows = [(a, t, p, at, {}) for t, s in whole.items() for p, (a, at) in enumerate(s)]
    indexing.ingest(one, spark.createDataFrame(rows, SCHEMA), lookback, number=4)
    assert tables(store) == tables(one)
    assert max(map(len, store.manifest()["tables"].values())) <= 3
    with pytest.raises(ValueError):
        indexing.ingest(store, timed(spark, parts[0], 9), "9i")
    indexing.ingest(one, spark.createDataFrame([("D", "t0", 0, 5, {}), ("Z", "t99", 0, 5, {})], SCHEMA), lookback, continued=False)
    assert one.facts()["trace_count"] == len(whole) + 1 and one.read("pairs_index").count() == one.facts()["pair_count"]


def test_a_batch_that_fails_anywhere_leaves_the_log_as_it_was(spark, tmp_path, monkeypatch):
    first, second = batches(random.Random(4), 2)
    want = LogStore(spark, f"file://{tmp_path}/want")
    for i, b in enumerate((first, second)):
        indexing.ingest(want, timed(spark, b, i))
    want = tables(want)
    store = LogStore(spark, f"file://{tmp_path}/a")
    indexing.ingest(store, timed(spark, first, 0))
    before, whole, n = tables(store), LogStore.part, 0
    while True:
        calls = iter(range(n + 1))

        def part(self, *args):
            if next(calls, None) is None:
                raise RuntimeError("lost")
            return whole(self, *args)

        monkeypatch.setattr(LogStore, "part", part)
        try:
            indexing.ingest(store, timed(spark, second, 1))
            break
        except RuntimeError:
            n += 1
        if n == 3:  # a call in the middle is enough to look at
            assert tables(store) == before
    assert n >= 5 and tables(store) == want
    monkeypatch.setattr(LogStore, "part", whole)
    manifest = store.manifest()
    store.write("constraints", mine.positional(store.read("sequence_table")))
    with pytest.raises(OSError):
        store.publish(manifest)


def test_readers_outlive_writes(spark, tmp_path):
    store = LogStore(spark, f"file://{tmp_path}")
    indexing.ingest(store, make(spark, {"a": "AB"}))
    counts, sequence = store.read("count_table"), store.read("sequence_table")
    for _ in range(2):
        indexing.ingest(store, make(spark, {"a": "AB"}))
    assert sequence.count() == 2 and sum(r.total_completions for r in counts.collect()) == 1
    assert store.read("sequence_table").count() == 6
    store.retention = 0
    indexing.ingest(store, make(spark, {"a": "A"}))
    with pytest.raises(Exception):
        counts.collect()
    assert store.read("sequence_table").count() == 7


def test_constraints_are_kept_up(spark, tmp_path, monkeypatch):
    store, seen = LogStore(spark, f"file://{tmp_path}"), []
    whole = mine.constraints
    monkeypatch.setattr(mine, "constraints", lambda log, families=None: (seen.append(log.select("trace_id").distinct().count()), whole(log, families))[1])
    from eventloom.operators import mining

    for traces in ({"a": "ABC", "b": "BA", "c": "C"}, {"b": "CA", "d": "AB"}, None):
        if traces:
            indexing.ingest(store, make(spark, traces))
        got = mining.refresh(store, sorted(mine.FAMILIES))
        assert sorted(map(str, got.collect())) == sorted(map(str, whole(store.read("sequence_table"), sorted(mine.FAMILIES)).select(*got.columns).collect()))
    assert seen == [3, 2, 4]  # all; the grown ones for rows of their own; all for the families of the alphabet


def test_upsert_replaces_equal_keys(spark):
    old, new = make(spark, {"a": "AB"}), spark.createDataFrame([("B", "a", 1, 99, {}), ("C", "a", 2, 100, {})], SCHEMA)
    assert sorted((r.position, r.start_timestamp) for r in index.upsert(old, new, ["trace_id", "activity", "position"]).collect()) == [(0, 0), (1, 99), (2, 100)]


XES = """<?xml version="1.0"?><log xmlns="http://www.xes-standard.org/"><trace><string key="concept:name" value="t1"/>
<event><string key="concept:name" value="B"/><date key="time:timestamp" value="2024-01-01T02:00:00+01:00"/><float key="cost" value="2.5"/></event>
<event><string key="concept:name" value="A"/><date key="time:timestamp" value="2024-01-01T00:30:00.000+00:00"/><boolean key="ok" value="true"/></event></trace></log>"""


def test_sources(spark, tmp_path):
    (tmp_path / "l.xes").write_text(XES)
    rows = readers.read_log(spark, f"{tmp_path}/l.xes").orderBy("position").collect()
    assert [(r.activity, r.trace_id, r.position, r.start_timestamp, r.attributes) for r in rows] == [("A", "t1", 0, 1704069000, {"ok": "true"}), ("B", "t1", 1, 1704070800, {"cost": "2.5"})]
    (tmp_path / "l.csv").write_text("trace_id,activity,position,timestamp,resource\nx,A,1,2024-01-01T00:00:00,r1\nx,B,0,2024-01-01T00:00:00,\n,C,0,2024-01-01,r\n")
    rows = readers.read_log(spark, f"{tmp_path}/l.csv").orderBy("position").collect()
    assert [(r.activity, r.position, r.attributes) for r in rows] == [("B", 0, {}), ("A", 1, {"resource": "r1"})]
    (tmp_path / "l.json").write_text(json.dumps([{"c": "x", "a": "A", "w": 5, "z": 1}, {"c": "x", "a": "B", "w": 3, "z": 2}]))
    mapping = readers.Mapping({"trace_id": "c", "activity": "a", "start_timestamp": "w", "attributes": ["z"]})
    rows = readers.read_log(spark, f"{tmp_path}/l.json", mapping).orderBy("position").collect()
    assert [(r.activity, r.start_timestamp, r.attributes) for r in rows] == [("B", 3, {"z": "2"}), ("A", 5, {"z": "1"})]
    typed = readers.Mapping({**mapping.columns, "attributes": ["z", "y"]}, types={"z": "int", "y": "float"})
    (tmp_path / "t.json").write_text(json.dumps([{"c": "x", "a": "A", "w": 5, "z": "one", "y": "2"}, {"c": "x", "a": "B", "w": 6, "z": "7", "y": None}]))
    assert [r.attributes for r in readers.read_log(spark, f"{tmp_path}/t.json", typed).orderBy("position").collect()] == [{"y": "2.0"}, {"z": "7"}]
    with pytest.raises(ValueError):
        readers.read_log(spark, "x.pdf")
    with pytest.raises(ValueError):
        readers.Mapping({"tracer": "c"})
    out = make(spark, {"t": "AB"}).select("activity", "position")
    sinks.write_csv(out, f"{tmp_path}/o.csv")
    sinks.write_json(out, f"{tmp_path}/o.json")
    assert (tmp_path / "o.csv").read_text().splitlines() == ["activity,position", "A,0", "B,1"]
    assert json.loads((tmp_path / "o.json").read_text())[1] == {"activity": "B", "position": 1}
    assert "<td>A</td>" in sinks.table_page(out, "x") and "<svg" in sinks.graph_page(out.selectExpr("activity a", "activity b", "position w"), "a", "b", "w", "x")


def test_empty_log(spark):
    log = make(spark, {"t": "A"}).limit(0)
    assert index.event_pairs(log).collect() == [] and mine.supported(mine.constraints(log), log).collect() == []
    assert model.dfg(log).collect() == [] and compare.trace_labels(log, ["A"]).collect() == []
    with pytest.raises(ValueError):
        compare.trace_labels(log, [])


def test_refreshed_constraints(spark):
    before, after = {"a": "AB", "b": "BA"}, {"a": "ABAC", "b": "BA"}
    families = ["positional", "existential", "ordered"]
    touched = spark.createDataFrame([("a",)], "trace_id string")
    got = mine.refreshed(mine.constraints(make(spark, before), families), make(spark, after), touched, families)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, mine.constraints(make(spark, after), families).collect()), key=str)


@pytest.mark.parametrize("traces,tree", [
    (["AB", "AB"], ("seq", [("act", "A"), ("act", "B")])),
    (["A", "B"], ("xor", [("act", "A"), ("act", "B")])),
    (["AB", "BA"], ("par", [("act", "A"), ("act", "B")])),
    (["A", "ABA", "ABABA"], ("loop", [("act", "A"), ("act", "B")])),
    (["ABC", "AC"], ("seq", [("act", "A"), ("xor", [("act", "B"), ("tau",)]), ("act", "C")])),
    (["AAA"], ("loop", [("act", "A"), ("tau",)])),
])
def test_process_trees(spark, traces, tree):
    found = model.discover(make(spark, dict(enumerate_names(traces))))
    assert found == tree
    assert model.bpmn_xml(found).count("<bpmn:task") == sum(map(len, [set("".join(traces))]))


def test_noise_within_a_part(spark):
    clear = ["ABCD"] * 20 + ["ACBD"] * 20
    assert model.discover(make(spark, dict(enumerate_names([*clear, "ABCDACBD"]))), 0.2) == model.discover(make(spark, dict(enumerate_names(clear))), 0.2)
    nodes, edges = set("ABC"), {("A", "B"): 90, ("B", "C"): 90, ("C", "A"): 1, ("B", "A"): 1, ("C", "B"): 1, ("A", "C"): 1, ("C", None): 90}
    links = {e for e in edges if e[1]}
    flower = model.process_tree(links, nodes, {"A"}, {"C"}, edges, 0.0)
    assert model.process_tree(links, nodes, {"A"}, {"C"}, edges, 0.2) == ("seq", [("act", "A"), ("act", "B"), ("act", "C")]) and flower[0] == "loop"


def test_places_in_bpmn():
    from xml.etree import ElementTree

    tree = ("seq", [("act", "A"), ("xor", [("par", [("act", "B"), ("act", "C")]), ("tau",), ("act", "D")]), ("loop", [("act", "E"), ("tau",)])])
    root = ElementTree.fromstring(model.bpmn_xml(tree))
    bounds = [tuple(int(e.get(k)) for k in ("x", "y", "width", "height")) for e in root.iter(f"{{{model.DC}}}Bounds")]
    assert len(bounds) == 5 + 6 + 2 and len(set(bounds)) == len(bounds)
    apart = lambda a, b: a[0] + a[2] <= b[0] or b[0] + b[2] <= a[0] or a[1] + a[3] <= b[1] or b[1] + b[3] <= a[1]
    assert all(apart(a, b) for i, a in enumerate(bounds) for b in bounds[:i])
    assert len(list(root.iter(f"{{{model.SHAPES}}}BPMNEdge"))) == len(list(root.iter(f"{{{model.BPMN}}}sequenceFlow")))


def enumerate_names(traces):
    return [(str(i), t) for i, t in enumerate(traces)]


def test_endpoints(spark, tmp_path):
    (tmp_path / "l.csv").write_text("trace_id,activity,timestamp\n" + "".join(f"{t},{a},2024-01-01T00:00:{i:02d}\n" for t, s in {"1": "ABC", "2": "AC", "3": "BCD"}.items() for i, a in enumerate(s)))
    engine = Engine(spark, f"file://{tmp_path}/store")
    server = serve(engine, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"

    def post(name, **c):
        with urllib.request.urlopen(urllib.request.Request(f"{at}/{name}", json.dumps(c).encode(), method="POST")) as r:
            return json.loads(r.read())["result"]

    try:
        assert json.loads(urllib.request.urlopen(f"{at}/health").read()) == {"status": "ok"}
        assert post("indexing/run", path=f"{tmp_path}/l.csv", clear_existing=True)["event_count"] == 8
        assert sorted(r["trace_id"] for r in post("querying/detection", pattern="B C", use_index=True)) == ["1", "3"]
        assert post("querying/statistics", pattern="B C")[0]["total_completions"] == 2
        for mode in ("accurate", "fast", "hybrid"):
            assert post("querying/exploration", pattern="B C", explore_mode=mode, explore_k=1)[0]["next_activity"] == "D"
        assert any(r["template"] == "response" for r in post("mining/run", support_threshold=0.3, trace_ids=True))
        for name in ("directly_follows", "loop_detection", "durations", "attribute_deviations"):
            post(f"analysing/{name}")
        for name in ("ngrams", "rare_rules", "targeted_rules"):
            post(f"comparing/{name}", separating_group=["D"])
        assert post("modeling/directly_follows", as_xml=True).startswith("<dfg>") and "definitions" in post("modeling/bpmn")
        with pytest.raises(urllib.error.HTTPError):
            post("modeling/nothing")
        for bad in ({"pattern": "B C", "patern": 1}, {"pattern": "B ("}, {}):
            with pytest.raises(urllib.error.HTTPError):
                post("querying/detection", **bad)
        assert sorted(r["positions"] for r in post("querying/detection", pattern="B C", return_all=True, constraints=[{"from": 0, "to": 1, "most": 1}])) == [[0, 1], [1, 2]]
        assert [r["trace_id"] for r in post("querying/detection", pattern="BCD", compact=True)] == ["3"]
        assert {(r["source"], r["target"]) for r in post("querying/statistics", pattern="A !B C", info=True)} == {("A", "C"), ("A", "B")}
        assert post("querying/detection", pattern="B C", constraints=[{"kind": "gap", "from": 0, "to": 1, "least": 1}]) == []
        assert "<svg" in post("comparing/ngrams", separating_group=["D"], as_page=True) and "<table" in post("analysing/attribute_deviations", as_page=True)
        assert post("analysing/directly_follows", write_to=f"{tmp_path}/df") == {"path": f"{tmp_path}/df"} and spark.read.json(f"{tmp_path}/df").count() == 4
        (tmp_path / "in").mkdir()
        (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"trace_id": "9", "activity": a, "timestamp": f"2024-01-02T00:00:0{i}"}) for i, a in enumerate("AB")))
        for _ in range(2):
            out = post("indexing/stream", path=f"{tmp_path}/in", checkpoint=f"{tmp_path}/cp", mapping={"trace_id": "trace_id", "activity": "activity", "start_timestamp": "timestamp"})
            assert out["facts"]["event_count"] == 10 and out["facts"]["trace_count"] == 4
    finally:
        server.shutdown()
