"""Directly-follows graphs, variants, process trees and BPMN."""

from __future__ import annotations

from xml.etree import ElementTree as X

from pyspark.sql import DataFrame, Window, functions as F

from eventloom.functions.scores import ratio
from eventloom.operators.analyse import event_end
from eventloom.operators.index import by_trace


def dfg(log: DataFrame) -> DataFrame:
    """kind (edge, start, end), source, target, frequency."""
    nxt = log.select("trace_id", F.col("activity").alias("source"), F.lead("activity").over(by_trace()).alias("target"), F.lag("activity").over(by_trace()).alias("before"))
    kinds = F.array(
        F.when(F.col("target").isNotNull(), F.struct(F.lit("edge").alias("kind"), F.col("source").alias("s"), F.col("target").alias("t"))),
        F.when(F.col("before").isNull(), F.struct(F.lit("start").alias("kind"), F.lit(None).cast("string").alias("s"), F.col("source").alias("t"))),
        F.when(F.col("target").isNull(), F.struct(F.lit("end").alias("kind"), F.col("source").alias("s"), F.lit(None).cast("string").alias("t"))),
    )
    rows = nxt.select(F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k"))
    return rows.groupBy(F.col("k.kind").alias("kind"), F.col("k.s").alias("source"), F.col("k.t").alias("target")).agg(F.count("*").alias("frequency"))


def without_noise(graph: DataFrame, noise: float) -> DataFrame:
    """The most frequent edges that together have 1 - noise of the edges' frequency; starts and ends stay.

    The window runs over the edge list, of at most the square of the alphabet's size.
    """
    edges = graph.filter("kind = 'edge'")
    w = Window.orderBy(F.desc("frequency"), "source", "target")
    before = F.coalesce(F.sum("frequency").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("frequency").over(Window.partitionBy())
    return edges.withColumn("before", before).withColumn("total", total).filter(F.col("before") < (1 - noise) * F.col("total")).select(*graph.columns).union(graph.filter("kind <> 'edge'"))


def variants(log: DataFrame) -> DataFrame:
    """variant (activities in order), n_traces, share."""
    per = log.groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "activity"))), lambda x: x["activity"]).alias("variant"))
    n = per.groupBy("variant").agg(F.count("*").alias("n_traces"))
    return n.crossJoin(F.broadcast(per.agg(F.count("*").alias("total")))).select("variant", "n_traces", ratio(F.col("n_traces"), F.col("total")).alias("share"))


def frequent_variants(log: DataFrame, share: float) -> DataFrame:
    """Events of the traces whose variants, most frequent first, make up ``share`` of the traces."""
    per = log.groupBy("trace_id").agg(F.sha2(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("position", "activity"))), lambda x: x["activity"])), 256).alias("variant"))
    n = per.groupBy("variant").agg(F.count("*").alias("n"))
    sizes = n.groupBy("n").agg(F.count("*").alias("variants"))  # one row per frequency: variants of one frequency stay or go together
    w = Window.orderBy(F.desc("n"))
    before = F.coalesce(F.sum(F.col("n") * F.col("variants")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = sizes.withColumn("before", before).withColumn("total", F.sum(F.col("n") * F.col("variants")).over(Window.partitionBy()))
    kept = kept.filter(F.col("before") < share * F.col("total")).select("n")
    ids = per.join(n.join(kept, "n", "left_semi").select("variant"), "variant", "left_semi").select("trace_id")
    return log.join(ids, "trace_id", "left_semi")


def annotations(log: DataFrame, end_time: str | None = None) -> DataFrame:
    """activity, frequency, avg_duration: to the event's own end if there is one, else to the next event."""
    nxt = F.lead("start_timestamp").over(by_trace()).cast("double")
    rows = log.withColumn("d", (event_end(end_time) if end_time else nxt) - F.col("start_timestamp"))
    return rows.groupBy("activity").agg(F.count("*").alias("frequency"), F.round(F.avg("d"), 6).alias("avg_duration"))


# process trees, on the driver: the graph has a node per activity


def graph_of(edges: DataFrame) -> tuple[dict, set, set]:
    """({(source, target): frequency}, starts, ends) of a dfg; the target None stands for the end of a trace."""
    out, starts, ends = {}, set(), set()
    for r in edges.collect():  # at most the square of the alphabet
        if r.kind != "start":
            out[r.source, r.target] = r.frequency
        if r.kind != "edge":
            (starts if r.kind == "start" else ends).add(r.target if r.kind == "start" else r.source)
    return out, starts, ends


def reachable(nodes: set, edges: set) -> dict:
    out = {n: {n} for n in nodes}
    following = {n: {b for a, b in edges if a == n} for n in nodes}
    for n in nodes:
        todo = [n]
        while todo:
            for m in following[todo.pop()] - out[n]:
                out[n].add(m)
                todo.append(m)
    return out


def connected(nodes: set, edges: set) -> list[set]:
    left, out = set(nodes), []
    while left:
        part, todo = set(), [min(left)]
        while todo:
            n = todo.pop()
            if n in part:
                continue
            part.add(n)
            todo += [m for m in left - part if (n, m) in edges or (m, n) in edges]
        out.append(part)
        left -= part
    return sorted(out, key=min)


def process_tree(edges: set, nodes: set, starts: set, ends: set, frequency: dict | None = None, noise: float = 0.0):
    """Inductive discovery on a directly-follows graph: ("act", a) or (operator, children) with xor, seq, par, loop; a flower where no cut applies.

    With ``noise``, a part of the graph that has no cut is tried again without the edges below that
    share of the strongest edge that leaves their source within the part.
    """
    if not nodes:
        return ("tau",)
    if len(nodes) == 1:
        a = next(iter(nodes))
        return ("loop", [("act", a), ("tau",)]) if (a, a) in edges else ("act", a)
    sub = lambda part: {(a, b) for a, b in edges if a in part and b in part}

    def child(part):
        into = {b for a, b in edges if a not in part and b in part} | starts & part
        out = {a for a, b in edges if a in part and b not in part} | ends & part
        return process_tree(sub(part), part, into or set(part), out or set(part), frequency, noise)

    parts = connected(nodes, edges)
    if len(parts) > 1:
        return ("xor", [child(p) for p in parts])
    reach = reachable(nodes, edges)
    groups: list[set] = []
    for n in sorted(nodes):  # nodes that reach each other, or don't reach at all, belong together
        joined = {n}
        for g in [g for g in groups if any((m in reach[n]) == (n in reach[m]) for m in g)]:
            joined |= g
            groups.remove(g)
        groups.append(joined)
    merged = True
    while merged:
        merged = False
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                ab = [(b in reach[a], a in reach[b]) for a in groups[i] for b in groups[j]]
                if not (all(x == (True, False) for x in ab) or all(x == (False, True) for x in ab)):
                    groups[i] |= groups.pop(j)
                    merged = True
                    break
            if merged:
                break
    if len(groups) > 1:
        groups.sort(key=lambda g: -len(reach[min(g)] - g))
        groups.sort(key=lambda g: sum(min(g) in reach[min(h)] for h in groups if h is not g))
        children = []
        for k, g in enumerate(groups):
            before, after = set().union(*groups[:k]), set().union(*groups[k + 1 :])
            skipped = any(a in before and b in after for a, b in edges) or k == 0 and starts & after or not after and ends & before
            tree = child(g)
            children.append(("xor", [tree, ("tau",)]) if skipped else tree)
        return ("seq", children)
    other = {(a, b) for a in nodes for b in nodes if a != b and not ((a, b) in edges and (b, a) in edges)}
    parts = connected(nodes, other)
    if len(parts) > 1 and all(p & starts and p & ends for p in parts):
        return ("par", [child(p) for p in parts])
    body = starts | ends
    inner = {(a, b) for a, b in edges if a not in body and b not in body}
    redo = connected(nodes - body, inner) if nodes - body else []
    loops = []
    for p in redo:
        outs, ins = {b for a, b in edges if a in p and b in body}, {a for a, b in edges if b in p and a in body}
        if outs <= starts and ins <= ends:
            loops.append(p)
        else:
            body |= p
    if loops:
        return ("loop", [process_tree(sub(body), body, starts, ends, frequency, noise), *[child(p) for p in loops]])
    strong = frequent(edges, frequency or {}, noise)
    if strong != edges:
        return process_tree(strong, nodes, starts, ends, frequency, noise)
    return ("loop", [("tau",), *[("act", a) for a in sorted(nodes)]])


def frequent(edges: set, frequency: dict, noise: float) -> set:
    """The edges with at least ``noise`` of the frequency of the strongest one from their source, ends of traces included."""
    best: dict = {}
    for e in edges:
        best[e[0]] = max(best.get(e[0], frequency.get((e[0], None), 0)), frequency.get(e, 0))
    return {e for e in edges if frequency.get(e, 0) >= noise * best[e[0]]}


def discover(log: DataFrame, noise: float = 0.0):
    """Process tree of a log (see ``process_tree`` for ``noise``)."""
    frequency, starts, ends = graph_of(dfg(log))
    edges = {e for e in frequency if e[1] is not None}
    return process_tree(edges, {n for e in edges for n in e} | starts | ends, starts, ends, frequency, noise)


def dfg_xml(graph: DataFrame) -> str:
    """The graph as XML: nodes, edges with frequency, starts and ends."""
    root = X.Element("dfg")
    rows = sorted(graph.collect(), key=str)
    for a in sorted({x for r in rows for x in (r.source, r.target) if x is not None}):
        X.SubElement(root, "node", id=a)
    for r in rows:
        X.SubElement(root, r.kind, {k: str(v) for k, v in (("source", r.source), ("target", r.target), ("frequency", r.frequency)) if v is not None})
    return X.tostring(root, encoding="unicode")


BPMN = "http://www.omg.org/spec/BPMN/20100524/MODEL"
SHAPES, DC, DI = "http://www.omg.org/spec/BPMN/20100524/DI", "http://www.omg.org/spec/DD/20100524/DC", "http://www.omg.org/spec/DD/20100524/DI"
#: Width and height of a node by kind, and of a cell of the grid they are placed on.
SIZES, CELL = {"task": (100, 80), "startEvent": (36, 36), "endEvent": (36, 36)}, (150, 110)
GATEWAY = (50, 50)


def extent(tree) -> tuple[int, int]:
    """Columns and rows of the grid that a process tree takes: sequences lie side by side, alternatives one below the other between two gateways."""
    if tree[0] in ("tau", "act"):
        return int(tree[0] == "act"), 1
    sizes = [extent(c) for c in tree[1]]
    if tree[0] == "seq":
        return sum(w for w, _ in sizes), max(h for _, h in sizes)
    return 2 + max(w for w, _ in sizes), sum(h for _, h in sizes)


def bpmn_xml(tree) -> str:
    """BPMN 2.0 of a process tree with the places of its nodes."""
    for prefix, uri in (("bpmn", BPMN), ("bpmndi", SHAPES), ("dc", DC), ("di", DI)):
        X.register_namespace(prefix, uri)
    q = lambda t, space=BPMN: f"{{{space}}}{t}"
    root = X.Element(q("definitions"), targetNamespace="http://bpmn.io/schema/bpmn")
    process = X.SubElement(root, q("process"), id="process", isExecutable="false")
    plane = X.SubElement(X.SubElement(root, q("BPMNDiagram", SHAPES), id="diagram"), q("BPMNPlane", SHAPES), id="plane", bpmnElement="process")
    number, middle = [0], {}

    def node(kind: str, column: int, row: int, **attrs) -> str:
        number[0] += 1
        name, (w, h) = f"n{number[0]}", SIZES.get(kind, GATEWAY)
        X.SubElement(process, q(kind), id=name, **attrs)
        x, y = column * CELL[0] + CELL[0] // 2, row * CELL[1] + CELL[1] // 2
        middle[name] = x, y, w // 2
        shape = X.SubElement(plane, q("BPMNShape", SHAPES), id=f"{name}_shape", bpmnElement=name)
        X.SubElement(shape, q("Bounds", DC), x=str(x - w // 2), y=str(y - h // 2), width=str(w), height=str(h))
        return name

    def flow(a: str, b: str) -> None:
        number[0] += 1
        X.SubElement(process, q("sequenceFlow"), id=f"f{number[0]}", sourceRef=a, targetRef=b)
        edge = X.SubElement(plane, q("BPMNEdge", SHAPES), id=f"f{number[0]}_edge", bpmnElement=f"f{number[0]}")
        side = 1 if middle[a][0] <= middle[b][0] else -1  # a flow that goes back leaves on the left
        for (x, y, half), way in ((middle[a], side), (middle[b], -side)):
            X.SubElement(edge, q("waypoint", DI), x=str(x + way * half), y=str(y))

    def build(t, entry: str, column: int, row: int) -> str:
        kind = t[0]
        if kind == "tau":
            return entry
        if kind == "act":
            task = node("task", column, row, name=t[1])
            flow(entry, task)
            return task
        if kind == "seq":
            for c in t[1]:
                entry = build(c, entry, column, row)
                column += extent(c)[0]
            return entry
        gateway = "parallelGateway" if kind == "par" else "exclusiveGateway"
        split, join = node(gateway, column, row), node(gateway, column + extent(t)[0] - 1, row)
        flow(entry, split)
        for k, c in enumerate(t[1]):
            back = kind == "loop" and k > 0
            flow(build(c, join if back else split, column + 1, row), split if back else join)
            row += extent(c)[1]
        return join

    start = node("startEvent", 0, 0)
    last = build(tree, start, 1, 0)
    flow(last, node("endEvent", extent(tree)[0] + 1, 0))
    return X.tostring(root, encoding="unicode")
