"""The pattern language and its matchers."""

import itertools
import random

import pytest

from eventloom.operators import index, query
from eventloom.operators.log import SCHEMA
from eventloom.plans import cep, matcher, pattern

ROWS = [("1", "A", 0, "r1", "5"), ("1", "B", 1, "r2", "7"), ("1", "C", 2, "r3", "2"), ("2", "A", 0, "r1", "5"), ("2", "C", 1, "r3", "2"),
        ("3", "B", 0, "r2", "7"), ("3", "C", 1, "r3", "2"), ("3", "D", 2, "r4", "12"), ("4", "A", 0, "r1", "5"), ("4", "D", 1, "r4", "12")]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame([(a, t, p, p * 60, {"resource": r, "cost": c}) for t, a, p, r, c in ROWS], SCHEMA).cache()


@pytest.mark.parametrize("text,traces", {
    "A B": "1", "A C": "12", "A D": "4", "B D": "3", "X E": "", "(A||B) C": "123", "(A||C) D": "34", "(X||Y) C": "", "B+ C": "13", "A+ C": "12", "A* B": "13", "A* C": "123",
    'A[resource="r1"] B': "1", 'A[resource="r1"] C': "12", 'A[resource="r2"] C': "", '(A[resource="r2"]||B[resource="r2"]) C': "13", '(A[resource="r1"]||B[resource="r2"]) C': "123",
    "A !B C": "2", "!A C": "3", "A !D": "12", "C": "123", "A? C": "123", "(A||B)* C": "123", "A !(B||D) C": "2", "A C[cost=$1-3]": "12", 'A[cost="5"] !B D[cost=$1+7]': "4", "A B[cost=$1]": ""}.items())
def test_detection(log, text, traces):
    for pairs in (None, index.event_pairs(log)):
        assert "".join(sorted(r.trace_id for r in query.detect(log, text, pairs).collect())) == traces


def test_positions_and_support(log):
    rows = {r.trace_id: (r.positions, r.support) for r in query.detect(log, "B C").collect()}
    assert rows == {"1": ([1, 2], 0.5), "3": ([0, 1], 0.5)}
    assert query.detect(log, "B C", threshold=0.6).collect() == []


def brute(trace, branch):
    """Least (first, last, all) of all choices of events; no two groups interleave; a closing group has one event."""
    best = None
    positive = [k for k, e in enumerate(branch) if not e.negated]
    for n in range(len(positive), len(trace) + 1):
        for places in itertools.combinations(range(len(trace)), n):
            for cuts in itertools.combinations(range(1, n), len(positive) - 1):
                groups = [places[a:b] for a, b in zip((0, *cuts), (*cuts, n))]
                if any(len(g) > 1 and branch[k].quantifier != "+" for g, k in zip(groups, positive)):
                    continue
                if any(trace[i] != branch[k].label for g, k in zip(groups, positive) for i in g):
                    continue
                bounds = [(-1 if not p else groups[p - 1][-1], groups[p][0]) for p in range(len(positive))] + [(groups[-1][-1], len(trace))]
                edges = [-1, *positive, len(branch)]
                ok = all(not any(branch[k].negated and trace[i] == branch[k].label for k in range(edges[p] + 1, edges[p + 1]) for i in range(lo + 1, hi)) for p, (lo, hi) in enumerate(bounds))
                if ok and (best is None or (places[0], places[-1], places) < best):
                    best = (places[0], places[-1], places)
    return best and list(best[2])


@pytest.mark.parametrize("text", ["A B", "A+ B", "A B+ C", "A+ B+ C", "A !C B", "!B A", "A !B", "A !C B+ C", "A A", "A+ A B", "A !B C !A"])
def test_both_matchers_equal_brute_force(spark, text):
    rng = random.Random(text)
    traces = {str(i): [rng.choice("ABCD") for _ in range(rng.randint(1, 7))] for i in range(150)}
    branch = pattern.linear(text)[0]
    want = {t: m for t, s in traces.items() if (m := brute(s, branch))}
    assert want
    df = spark.createDataFrame([(a, t, p, p, {}) for t, s in traces.items() for p, a in enumerate(s)], SCHEMA)
    if matcher.is_regular(branch):
        assert {r.trace_id: r.positions for r in matcher.plan(df, branch).collect()} == want
    assert {r.trace_id: r.positions for r in matcher.matches(df, text).collect()} == want
    assert {r.trace_id: r.positions for r in matcher.match_all(df, [branch]).collect()} == want


def all_matches(trace, branch):
    out = []
    positive = [k for k, e in enumerate(branch) if not e.negated]
    for n in range(len(positive), len(trace) + 1):
        for places in itertools.combinations(range(len(trace)), n):
            for cuts in itertools.combinations(range(1, n), len(positive) - 1):
                groups = [places[a:b] for a, b in zip((0, *cuts), (*cuts, n))]
                if any(len(g) > 1 and branch[k].quantifier != "+" for g, k in zip(groups, positive)) or any(trace[i] != branch[k].label for g, k in zip(groups, positive) for i in g):
                    continue
                edges = [-1, *positive, len(branch)]
                bounds = [(-1 if not p else groups[p - 1][-1], groups[p][0]) for p in range(len(positive))] + [(groups[-1][-1], len(trace))]
                if all(not any(branch[k].negated and trace[i] == branch[k].label for k in range(edges[p] + 1, edges[p + 1]) for i in range(lo + 1, hi)) for p, (lo, hi) in enumerate(bounds)):
                    out.append((groups, places))
    return out


def log_of(spark, traces, step=1):
    return spark.createDataFrame([(a, t, p, p * step, {}) for t, s in traces.items() for p, a in enumerate(s)], SCHEMA)


def random_traces(seed, n, most=7):
    rng = random.Random(seed)
    return {str(i): [rng.choice("ABCD") for _ in range(rng.randint(1, most))] for i in range(n)}


def closing(groups):
    return len(groups[-1]) == 1


@pytest.mark.parametrize("text", ["A B", "A !C B", "!B A", "A B+ C", "A !B", "A A"])
def test_all_matches_that_do_not_overlap(spark, text):
    traces, branch = random_traces(text, 80, 9), pattern.linear(text)[0]
    want = []
    for t, s in traces.items():
        end = -1
        for m in sorted((p[0], p[-1], p) for g, p in all_matches(s, branch) if closing(g)):
            if m[0] > end:
                want.append((t, list(m[2])))
                end = m[1]
    assert len(want) > 9
    assert sorted((r.trace_id, r.positions) for r in matcher.matches(log_of(spark, traces), text, every=True).collect()) == sorted(want)


def test_bounds(spark):
    traces, text = random_traces(2, 150, 8), "A B+ C"
    branch = pattern.linear(text)[0]
    for bounds in ([matcher.Bound(0, 2, 3, 5)], [matcher.Bound(0, 1, None, 1, "gap"), matcher.Bound(1, 2, 10, None)], [matcher.Bound(0, 2, 2, 2, "gap")]):
        step = 1 if bounds[0].most == 5 else 10
        ok = lambda g, b: b.allows(*[{"position": g[k][0], "start_timestamp": g[k][0] * step} for k in (b.a, b.b)])
        want = {}
        for t, s in traces.items():
            if found := sorted((p[0], p[-1], p) for g, p in all_matches(s, branch) if closing(g) and all(ok(g, b) for b in bounds)):
                want[t] = list(found[0][2])
        assert len(want) > 2
        assert {r.trace_id: r.positions for r in query.detect(log_of(spark, traces, step), text, bounds=bounds).collect()} == want
    assert query.detect(log_of(spark, traces), "A B? C", bounds=[matcher.Bound(1, 2, 5, None)]).count() == query.detect(log_of(spark, traces), "A C").count()
    with pytest.raises(ValueError):
        matcher.Bound(2, 1)


@pytest.mark.parametrize("text", ["A", "A B", "A !C B", "!B A", "A !B", "A+ !C !D", "(A||B !A) C*", "A B+ !A"])
def test_what_follows_a_pattern(spark, text):
    traces = random_traces(text, 120)
    log = log_of(spark, traces)
    want = {(t, x) for x in "ABCD" for t in [r.trace_id for r in matcher.match_all(log, matcher.branches_of(f"({text}) {x}")).collect()]}
    assert want and {tuple(r) for r in matcher.followers(log, text).collect()} == want


def test_what_follows_a_pattern_with_variables(spark):
    rows = [("view", "1", 0), ("view", "2", 1), ("purchase", "2", 2), ("click", "0", 3), ("purchase", "1", 4)]
    log = spark.createDataFrame([(a, "t", p, p, {"k": k}) for a, k, p in rows], SCHEMA)
    got = {r.next_activity: r.support for r in query.explore_accurate(log, "view purchase[k=$1]").collect()}
    assert got == {"click": 1.0, "purchase": 1.0}


@pytest.mark.parametrize("text", ["A B[k=$1]", "A A[k=$1+1]", 'A[j="0"] B[k=$1,j=$1]', 'A B[k=$1-2,j="1"]', "A B[k=$2,j=$1]"])
def test_pairs_with_variables(spark, text):
    rng = random.Random(text)
    rows = [(rng.choice("ABC"), str(t), p, p, {"k": rng.choice(["0", "1", "2", "x", "2.0"]), **({"j": rng.choice("01")} if rng.random() < 0.8 else {})}) for t in range(150) for p in range(rng.randint(1, 9))]
    log = spark.createDataFrame(rows, SCHEMA)
    branch = pattern.linear(text)[0]
    assert matcher.is_pair(branch)
    got = {r.trace_id: r.positions for r in matcher.matches(log, text).collect()}
    assert got and got == {r.trace_id: r.positions for r in matcher.match_all(log, [branch]).collect()}


def test_many_events_in_a_branch(spark):
    names = [f"e{i}" for i in range(40)]
    log = spark.createDataFrame([(a, t, p, p, {"k": str(p)}) for t, s in {"x": names, "y": names[::-1]}.items() for p, a in enumerate(s)], SCHEMA)
    assert [r.trace_id for r in query.detect(log, " ".join(names)).collect()] == ["x"]
    many = " ".join(f'e{i % 2}[k="{i}"]' for i in range(26))  # more kinds of one label than there are symbols
    assert not matcher.is_regular(pattern.linear(many)[0]) and query.detect(log, many).collect() == []


def test_reading():
    assert pattern.activities('A "b \\" c"+ !D[k="v", n=$1-2]')[1:] == [
        {"label": 'b " c', "quantifier": "+", "negated": False, "attributes": {}},
        {"label": "D", "quantifier": "", "negated": True, "attributes": {"k": "v", "n": pattern.Variable(1, -2)}}]
    for bad in ("", "A (B", "A %", "A[k=]", "|| A", "A)", "*"):
        with pytest.raises(SyntaxError):
            pattern.parse(bad)


def test_pairs():
    pairs = lambda t: [(p["source"], p["target"]) for p in pattern.responded_pairs(t)]
    assert pairs("a b*(c||d)") == [("a", "b"), ("a", "c"), ("b", "c"), ("a", "b"), ("a", "d"), ("b", "d")]
    assert pairs("A A") == [("A", "A")]
    forbidden = {(p["source"], p["target"]): p["forbidden_between"] for p in pattern.responded_pairs("a !b c d")}
    assert forbidden == {("a", "c"): ["b"], ("a", "d"): ["b"], ("c", "d"): []}
    assert pattern.responded_pairs("a !(b||c) d")[0]["forbidden_between"] == ["b", "c"]
    assert pattern.info_pairs("a+ !b c") == [("a", "a"), ("b", "b"), ("a", "b")]
    assert pattern.expand_compact("ab*(c||d)") == "a b* ( c || d )"


def events(text, step=1):
    return [{"activity": a, "position": i, "start_timestamp": i * step, "attributes": {"n": str(i), "p": "0.5"}} for i, a in enumerate(text)]


def test_composite():
    P = cep.Prim
    seq = cep.Seq((P("A", "a"), P("B", "b")))
    assert cep.find(events("ABAB"), cep.Composite(seq)) == [[0, 1], [0, 3], [2, 3]]
    assert cep.find(events("ABAB"), cep.Composite(seq, strategy="single")) == [[0, 1], [2, 3]]
    assert cep.find(events("ABAB"), cep.Composite(seq, strategy="next")) == [[0, 1]]
    assert cep.find(events("AXXB", 10), cep.Composite(seq, within=20)) == []
    assert cep.find(events("AXBAB"), cep.Composite(seq, contiguous=("a", "b"))) == [[3, 4]]
    assert cep.find(events("BA"), cep.Composite(cep.And((P("A", "a"), P("B", "b"))))) == [[0, 1]]
    assert cep.find(events("ACB"), cep.Composite(cep.Seq((P("A", "a"), cep.Not(P("C", "c")), P("B", "b"))))) == []
    assert cep.find(events("AAAB"), cep.Composite(cep.Seq((cep.Repeat(P("A", "a"), 2), P("B", "b"))), cep.neighbours("a", lambda x, y: float(x["attributes"]["n"]) < float(y["attributes"]["n"])))) == [[0, 1, 2, 3], [1, 2, 3]]
    condition = cep.relation("<", cep.attribute("a", "n", True), cep.attribute("b", "n", True))
    assert cep.find(events("AB"), cep.Composite(seq, cep.all_of(condition, lambda b: True))) == [[0, 1]]
    assert cep.find(events("AB"), cep.Composite(seq, confidence_key="p", least_confidence=0.3)) == []
    assert cep.find(events("AC"), cep.Composite(cep.Or((seq, cep.Seq((P("A", "a"), P("C", "c"))))))) == [[0, 1]]
