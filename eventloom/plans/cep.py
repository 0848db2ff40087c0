"""Composite event patterns beyond the pattern language: any order, bounded repetition, windows, contiguity, probabilities.

A pattern is a tree of ``Prim``, ``Seq``, ``And``, ``Or``, ``Not`` and ``Repeat`` with a condition on
the bound events. It is evaluated per trace by a search that binds events in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import permutations

from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Prim:
    activity: str
    name: str


@dataclass(frozen=True)
class Not:
    item: Prim


@dataclass(frozen=True)
class Seq:
    items: tuple


@dataclass(frozen=True)
class And:
    items: tuple


@dataclass(frozen=True)
class Or:
    items: tuple


@dataclass(frozen=True)
class Repeat:
    """``low`` to ``high`` events in a row of the pattern's reading order; a match takes as many as come before the next item."""

    item: Prim
    low: int = 1
    high: int | None = None


@dataclass(frozen=True)
class Composite:
    """condition: a function of {name: event, or list of events for a Repeat}; within: seconds; contiguous: names bound to neighbouring positions;
    strategy: any (all matches), single (no event in two matches), next (each item takes the next event that fits); least_confidence: the product of
    the events' attribute ``confidence_key`` has to reach it."""

    structure: object
    condition: Callable[[dict], bool] | None = None
    within: float | None = None
    contiguous: tuple[str, ...] = ()
    strategy: str = "any"
    confidence_key: str | None = None
    least_confidence: float = 0.0


def relation(op: str, left: Callable, right: Callable) -> Callable[[dict], bool]:
    """Comparison (=, !=, <, <=, >, >=) of two functions of the bound events; false where a side is null."""
    import operator

    test = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}[op]

    def check(bound: dict) -> bool:
        a, b = left(bound), right(bound)
        return a is not None and b is not None and test(a, b)

    return check


def attribute(name: str, key: str, number: bool = False, place: int | None = None) -> Callable[[dict], object]:
    """An attribute of a bound event, or of the event at ``place`` of a repetition."""

    def value(bound: dict):
        event = bound[name] if place is None else bound[name][place]
        v = event["attributes"].get(key)
        return float(v) if number and v is not None else v

    return value


def all_of(*conditions) -> Callable[[dict], bool]:
    return lambda bound: all(c(bound) for c in conditions)


def any_of(*conditions) -> Callable[[dict], bool]:
    return lambda bound: any(c(bound) for c in conditions)


def each(name: str, test: Callable[[dict], bool]) -> Callable[[dict], bool]:
    """All events of a repetition pass."""
    return lambda bound: all(test(e) for e in bound[name])


def neighbours(name: str, test: Callable[[dict, dict], bool], offset: int = 1) -> Callable[[dict], bool]:
    """All events of a repetition pass together with the one ``offset`` places on."""
    return lambda bound: all(test(a, b) for a, b in zip(bound[name], bound[name][offset:]))


def alternatives(node) -> list[tuple]:
    """Sequences of Prim, Not and Repeat that the tree stands for."""
    if isinstance(node, Or):
        return [s for item in node.items for s in alternatives(item)]
    if isinstance(node, And):
        return [s for order in permutations(node.items) for s in alternatives(Seq(order))]
    if isinstance(node, Seq):
        out = [()]
        for item in node.items:
            out = [a + b for a in out for b in alternatives(item)]
        return out
    return [(node,)]


def bindings(events: list[dict], items: tuple, pattern: Composite) -> Iterator[dict]:
    def go(k: int, start: int, since: int, bound: dict, forbidden: list[str], first: float | None) -> Iterator[dict]:
        clear = lambda stop: not any(events[i]["activity"] in forbidden for i in range(since, stop))
        if k == len(items):
            limit = len(events)
            if forbidden and pattern.within is not None and first is not None:
                limit = sum(e["start_timestamp"] - first <= pattern.within for e in events)
            if not forbidden or clear(max(limit, since)):
                yield bound
            return
        item = items[k]
        if isinstance(item, Not):
            yield from go(k + 1, start, since, bound, [*forbidden, item.item.activity], first)
            return
        prim, low, high = (item.item, item.low, item.high) if isinstance(item, Repeat) else (item, 1, 1)
        for i in range(start, len(events)):
            e = events[i]
            if first is not None and pattern.within is not None and e["start_timestamp"] - first > pattern.within:
                return
            if e["activity"] != prim.activity:
                continue
            if not clear(i):
                return
            origin = e["start_timestamp"] if first is None else first
            if not isinstance(item, Repeat):
                yield from go(k + 1, i + 1, i + 1, {**bound, prim.name: e}, [], origin)
            else:
                stop = items[k + 1].activity if k + 1 < len(items) and isinstance(items[k + 1], Prim) else None
                group = []
                for j in range(i, len(events)):
                    if events[j]["activity"] == stop and stop != prim.activity and len(group) >= low:
                        break
                    if pattern.within is not None and events[j]["start_timestamp"] - origin > pattern.within:
                        break
                    if events[j]["activity"] == prim.activity:
                        group.append(events[j])
                        if high is not None and len(group) == high:
                            break
                if len(group) >= low:
                    after = events.index(group[-1]) + 1
                    yield from go(k + 1, after, after, {**bound, prim.name: group}, [], origin)
            if pattern.strategy == "next":
                return

    yield from go(0, 0, 0, {}, [], None)


def find(events: list[dict], pattern: Composite) -> list[list[int]]:
    """Positions of the matches in a trace, in order of (first, last, all)."""
    found = []
    for items in alternatives(pattern.structure):
        for bound in bindings(events, items, pattern):
            if pattern.condition is not None and not pattern.condition(bound):
                continue
            flat = [e for v in bound.values() for e in (v if isinstance(v, list) else [v])]
            at = sorted(e["position"] for e in flat)
            names = [bound[n] for n in pattern.contiguous if n in bound]
            spots = sorted(e["position"] for v in names for e in (v if isinstance(v, list) else [v]))
            if any(b != a + 1 for a, b in zip(spots, spots[1:])):
                continue
            if pattern.confidence_key:
                p = 1.0
                for e in flat:
                    p *= float(e["attributes"].get(pattern.confidence_key) or 1.0)
                if p < pattern.least_confidence:
                    continue
            if at:
                found.append(at)
    found = [list(x) for x in sorted({tuple(a) for a in found}, key=lambda m: (m[0], m[-1], m))]
    if pattern.strategy != "single":
        return found
    used, out = set(), []
    for m in found:
        if not used & set(m):
            used |= set(m)
            out.append(m)
    return out


def detect_composite(log: DataFrame, patterns: dict[str, Composite]) -> DataFrame:
    """pattern, trace_id, positions of all matches; the patterns share one scan and one shuffle by trace."""
    def activities(node) -> set[str]:
        if isinstance(node, Prim):
            return {node.activity}
        return set().union(*(activities(i) for i in node.items)) if hasattr(node, "items") else activities(node.item)

    wanted = sorted(set().union(*(activities(p.structure) for p in patterns.values())))
    event = F.struct("position", "activity", "start_timestamp", F.map_entries("attributes").alias("attributes"))
    traces = log.filter(F.col("activity").isin(wanted)).groupBy("trace_id").agg(F.array_sort(F.collect_list(event)).alias("events"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            names, ids, out = [], [], []
            for row in batch.to_pylist():
                events = [{**e, "attributes": {x["key"]: x["value"] for x in e["attributes"] or []}} for e in row["events"]]
                for name, pattern in patterns.items():
                    for m in find(events, pattern):
                        names.append(name)
                        ids.append(row["trace_id"])
                        out.append(m)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(ids), pa.array(out, pa.list_(pa.int32()))], ["pattern", "trace_id", "positions"])

    return traces.mapInArrow(run, "pattern string, trace_id string, positions array<int>")
