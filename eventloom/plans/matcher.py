"""Patterns as Spark plans.

A branch without variables becomes a regular expression over one symbol per event: the events
whose labels occur in the pattern are collected in order per trace as a string, and the groups
between the elements give the places of the match. Branches with variables, and composite
patterns of other kinds, go through the backtracking matcher, one trace at a time.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window, functions as F

from eventloom.plans.pattern import ONE, OPT, PLUS, STAR, Event, Variable, linear

FIRST_SYMBOL, MOST_SYMBOLS = 0xE000, 1024  # in the private use area


def predicates(branch: list[Event]) -> dict[str, list[tuple]]:
    """The different literal attributes that the branch asks for, by label."""
    out: dict[str, list[tuple]] = {}
    for e in branch:
        if e.attributes not in out.setdefault(e.label, []):
            out[e.label].append(e.attributes)
    return out


def holds(attributes: tuple) -> Column:
    """Whether an event has the literal attributes."""
    ok = F.lit(True)
    for key, value in attributes:
        ok = ok & F.coalesce(F.col("attributes").getItem(key) == value, F.lit(False))
    return ok


def has_variables(branch: list[Event]) -> bool:
    return any(isinstance(v, Variable) for e in branch for _, v in e.attributes)


def is_regular(branch: list[Event]) -> bool:
    """Whether ``plan`` serves the branch: no variables, no repeated event before one of the same label, and a symbol for every kind of event."""
    positive = [e for e in branch if not e.negated]
    if has_variables(branch) or any(a.quantifier == PLUS and a.label == b.label for a, b in zip(positive, positive[1:])):
        return False
    return sum(1 << len(found) for found in predicates(branch).values()) <= MOST_SYMBOLS


def alphabet(branch: list[Event]) -> tuple[dict[str, int], dict[tuple, str]]:
    """(first number of each label, characters of the symbols that satisfy each event of the branch).

    An event's number is its label's first number plus a bit for each of the label's predicates
    that hold; its symbol is the character of that number.
    """
    first, chars, n = {}, {}, 0
    for label, found in predicates(branch).items():
        first[label] = n
        for i, attributes in enumerate(found):
            chars[label, attributes] = "".join(chr(FIRST_SYMBOL + n + m) for m in range(1, 1 << len(found)) if m >> i & 1)
        n += 1 << len(found)
    return first, chars


def expression(branch: list[Event], chars: dict[tuple, str]) -> str:
    """Regular expression with a group before each positive element (and one at the end after a trailing negation).

    Without negation each gap excludes the element it leads to and is possessive: one pass. With
    negation gaps are lazy, so that a later element is tried where an earlier one is blocked.
    """
    negations = any(e.negated for e in branch)
    out, forbidden = "", ""
    for e in branch:
        own = chars[(e.label, e.attributes)]
        if e.negated:
            forbidden += own
        elif not negations:
            out += f"([^{own}]*+)[{own}]"
        else:
            out += (f"([^{forbidden}]*?)" if forbidden else "(.*?)") + f"[{own}]"
            forbidden = ""
    return "(?s)" + out + (f"[^{forbidden}]*$" if forbidden else "")


def plan(log: DataFrame, branch: list[Event]) -> DataFrame:
    """(trace_id, positions) of the traces with a match of a regular ONE/PLUS branch.

    The match is the one with the least first, then least last position; between them, elements
    with PLUS take all their events before the next element.
    """
    first, chars = alphabet(branch)
    number = F.coalesce(*[F.when(F.col("activity") == label, sum((F.when(holds(a), 1 << i).otherwise(0) for i, a in enumerate(found)), F.lit(0)) * 4096 + first[label]) for label, found in predicates(branch).items()])
    rows = log.filter(F.col("activity").isin(list(first))).select("trace_id", "position", number.alias("number")).filter("number >= 4096")
    rows = rows.select("trace_id", "position", F.expr("number DIV 4096 + number % 4096").cast("int").alias("mask"))
    seq = rows.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("position", "mask"))).alias("seq"))
    last = max(ord(c) for cs in chars.values() for c in cs)
    table = F.array(*[F.lit(chr(c)) for c in range(FIRST_SYMBOL, last + 1)])
    seq = seq.withColumn("line", F.array_join(F.transform("seq", lambda x: F.element_at(table, x["mask"] + 1)), ""))
    pattern = expression(branch, chars).replace("(?s)", "(?s)^", 1)
    hit = seq.filter(F.col("line").rlike(pattern))
    positive = [e for e in branch if not e.negated]
    hit = hit.withColumn("gaps", F.array(*[F.length(F.regexp_extract("line", pattern, i + 1)) for i in range(len(positive))]))
    # the i-th element lies behind the gaps up to it and the elements before it
    hit = hit.withColumn("places", F.expr("transform(gaps, (g, i) -> i + aggregate(slice(gaps, 1, i + 1), 0, (s, x) -> s + x))"))
    parts = []
    for i, e in enumerate(positive):
        own = F.array(F.expr(f"places[{i}]"))
        if e.quantifier == PLUS and i + 1 < len(positive):
            bits = [ord(c) - FIRST_SYMBOL for c in chars[(e.label, e.attributes)]]
            own = F.expr(f"filter(sequence(places[{i}], places[{i + 1}] - 1), k -> array_contains(array({', '.join(map(str, bits))}), seq[k].mask))")
        parts.append(own)
    return hit.select("trace_id", F.transform(F.concat(*parts), lambda k: F.col("seq")[k]["position"]).alias("positions"))


def is_pair(branch: list[Event]) -> bool:
    """Whether ``pair_plan`` serves the branch: two single events, the second with variables of the first."""
    if len(branch) != 2 or any(e.negated or e.quantifier == PLUS for e in branch) or has_variables(branch[:1]):
        return False
    return any(isinstance(v, Variable) and v.n == 1 for _, v in branch[1].attributes)


def pair_plan(log: DataFrame, branch: list[Event]) -> DataFrame:
    """(trace_id, positions) of the least match of a pair: the events of equal values of a trace in order, and the next second event of each first one."""
    a, b = branch
    literal = lambda e: tuple((k, v) for k, v in e.attributes if not isinstance(v, Variable))
    is_a, is_b = ((F.col("activity") == e.label) & holds(literal(e)) for e in (a, b))
    asked = [(k, v) for k, v in b.attributes if isinstance(v, Variable) and v.n == 1]  # places beyond the pattern are ignored
    value = lambda k, v, shift: F.col("attributes").getItem(k) if v.offset is None else (F.col("attributes").getItem(k).try_cast("double") + F.lit(float(shift * v.offset))).cast("string")
    roles = F.array(*[F.when(test, F.struct(F.lit(first).alias("first"), F.array(*[value(k, v, first) for k, v in asked]).alias("values"))) for first, test in ((1, is_a), (0, is_b))])
    rows = log.filter(F.col("activity").isin(a.label, b.label)).select("trace_id", "position", F.explode(F.filter(roles, lambda r: r.isNotNull())).alias("r")).select("trace_id", "position", "r.*")
    rows = rows.filter(F.forall("values", lambda v: v.isNotNull()))
    later = Window.partitionBy("trace_id", "values").orderBy(F.desc("position")).rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("next", F.min(F.when(F.col("first") == 0, F.col("position"))).over(later)).filter("first = 1 and next is not null")
    return rows.groupBy("trace_id").agg(F.min(F.struct("position", "next")).alias("m")).select("trace_id", F.array("m.position", "m.next").alias("positions"))


# backtracking over one trace


def variable_ok(event: dict, chosen: list[list[dict]], attributes: tuple) -> bool:
    """Whether all variables hold: against every event of the place a variable names; places beyond the pattern are ignored."""
    for key, value in attributes:
        if not isinstance(value, Variable):
            if event["attributes"].get(key) != value:
                return False
            continue
        if value.n > len(chosen):
            continue
        for other in chosen[value.n - 1]:
            a, b = event["attributes"].get(key), other["attributes"].get(key)
            if value.offset is None:
                if a is None or a != b:
                    return False
            else:
                try:
                    if float(a) != float(b) + value.offset:
                        return False
                except (TypeError, ValueError):
                    return False
    return True


def match_trace(events: list[dict], branch: list[Event], bounds: tuple = (), start: int = 0, by_end: bool = False, last: int | None = None) -> list[int] | None:
    """Places in ``events`` of the least match (first, last, all places) of a ONE/PLUS branch, or None.

    Places with PLUS take events greedily from the left but may take fewer. The first event is
    sought from ``start`` on. bounds: see ``Bound``. With ``by_end`` the match that ends first is
    the least; ``last`` asks for a match that ends there.
    """
    positive = [k for k, e in enumerate(branch) if not e.negated]
    best: list = []

    def blocked(k_from: int, k_to: int, lo: int, hi: int, chosen) -> bool:
        return any(
            branch[k].negated and any(events[i]["activity"] == branch[k].label and variable_ok(events[i], chosen, branch[k].attributes) for i in range(lo, hi))
            for k in range(k_from, k_to)
        )

    def step(p: int, begin: int, chosen: list[list[int]]) -> None:
        groups = [[events[i] for i in g] for g in chosen]
        if p == len(positive):
            end = chosen[-1][-1]
            if (last is None or end == last) and not blocked(positive[-1] + 1, len(branch), end + 1, len(events), groups):
                flat = [i for g in chosen for i in g]
                key = (end, flat[0], flat) if by_end else (flat[0], end, flat)
                if not best or key < best[0]:
                    best[:] = [key]
            return
        e = branch[positive[p]]
        from_k = positive[p - 1] + 1 if p else 0
        free = begin if p else 0
        for i in range(begin, len(events) if last is None else last + 1):
            if best and (i > best[0][0] if by_end or not chosen else i > best[0][1]):
                break
            if events[i]["activity"] != e.label or not variable_ok(events[i], groups, e.attributes):
                continue
            if blocked(from_k, positive[p], free, i, groups):
                break  # a later event leaves at least as many between
            if not all(b.allows(groups[b.a][0], events[i]) for b in bounds if b.b == p):
                continue
            step(p + 1, i + 1, [*chosen, [i]])
            if e.quantifier == PLUS and p + 1 < len(positive) and not by_end:
                group = [i]
                for j in range(i + 1, len(events)):
                    if events[j]["activity"] == e.label and variable_ok(events[j], groups, e.attributes):
                        group = [*group, j]
                        step(p + 1, j + 1, [*chosen, group])

    step(0, start, [])
    return best[0][2] if best else None


@dataclass(frozen=True)
class Bound:
    """Least and greatest time (seconds), or number of events between, from the first event of place ``a`` to that of place ``b`` > ``a``.

    Places are those of the pattern's positive events, from 0. Where a place is optional and left
    out of a match, its bounds don't apply.
    """

    a: int
    b: int
    least: float | None = None
    most: float | None = None
    kind: str = "time"

    def __post_init__(self):
        if self.kind not in ("time", "gap") or not 0 <= self.a < self.b:
            raise ValueError(f"not a bound: {self}")

    def allows(self, x: dict, y: dict) -> bool:
        d = y["start_timestamp"] - x["start_timestamp"] if self.kind == "time" else y["position"] - x["position"] - 1
        return (self.least is None or d >= self.least) and (self.most is None or d <= self.most)


def branches_of(text: str, bounds: list[Bound] | None = None) -> list[tuple[list[Event], tuple]]:
    """ONE/PLUS branches of a pattern, each with the bounds between the places it keeps."""
    out, known = [], []
    for branch in linear(text):
        places = iter(range(len(branch)))
        numbered = [(e, None if e.negated else next(places)) for e in branch]
        options = [[None] if not e.negated and e.quantifier in (STAR, OPT) else [] for e, _ in numbered]
        for choice in product(*[[(replace(e, quantifier=PLUS if e.quantifier in (PLUS, STAR) and not e.negated else ONE), n), *gone] for (e, n), gone in zip(numbered, options)]):
            kept = [c for c in choice if c is not None]
            at = {n: k for k, n in enumerate(n for _, n in kept if n is not None)}
            own = tuple(replace(b, a=at[b.a], b=at[b.b]) for b in bounds or [] if b.a in at and b.b in at)
            found = ([e for e, _ in kept], own)
            if at and found not in known:
                known.append(found)
                out.append(found)
    return out


def gathered(log: DataFrame, labels: list[str] | None) -> DataFrame:
    """(trace_id, events): the events of those labels, or all, of each trace in order."""
    event = F.struct("position", "activity", "start_timestamp", F.map_entries("attributes").alias("attributes"))
    rows = log if labels is None else log.filter(F.col("activity").isin(labels))
    return rows.groupBy("trace_id").agg(F.array_sort(F.collect_list(event)).alias("events"))


def per_trace(traces: DataFrame, solve, schema: str) -> DataFrame:
    """Rows (trace_id, value) for the values that ``solve(events)`` yields of each trace, a trace at a time."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, out = [], []
            for row in batch.to_pylist():
                events = [{**e, "attributes": {x["key"]: x["value"] for x in e["attributes"] or []}} for e in row["events"]]
                for value in solve(events):
                    ids.append(row["trace_id"])
                    out.append(value)
            if ids:
                kind = pa.list_(pa.int32()) if "array" in schema else pa.int32() if "int" in schema else pa.string()
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, kind)], ["trace_id", schema.split()[0]])

    return traces.mapInArrow(run, f"trace_id string, {schema}")


def searches(found: list[tuple[list[Event], tuple]]) -> list:
    """For each branch a function of (events, start) that gives the places of the least match with its first event from ``start`` on."""
    import re

    out = []
    for branch, bounds in found:
        leading = branch[0].negated
        if bounds or leading or not is_regular(branch):
            needed = {e.label for e in branch if not e.negated}
            out.append(lambda events, start, branch=branch, bounds=bounds, needed=needed: match_trace(events, branch, bounds, start) if needed <= {e["activity"] for e in events[start:]} else None)
            continue
        first, chars = alphabet(branch)
        pattern, kinds = re.compile(expression(branch, chars)), predicates(branch)
        positive = [e for e in branch if not e.negated]

        def search(events, start, first=first, chars=chars, pattern=pattern, kinds=kinds, positive=positive):
            line = "".join(chr(FIRST_SYMBOL + first[e["activity"]] + sum(all(e["attributes"].get(k) == v for k, v in a) << i for i, a in enumerate(kinds[e["activity"]]))) if e["activity"] in first else " " for e in events)
            if not (m := pattern.match(line, start)):
                return None
            ends = [m.end(k + 1) for k in range(len(positive))]
            places = []
            for k, (e, i) in enumerate(zip(positive, ends)):
                own = chars[e.label, e.attributes]
                places += [j for j in range(i, ends[k + 1]) if line[j] in own] if e.quantifier == PLUS and k + 1 < len(positive) else [i]
            return places

        out.append(search)
    return out


def match_all(log: DataFrame, found: list, every: bool = False) -> DataFrame:
    """(trace_id, positions) of the least match of any branch, or of ``every`` one that begins after the one before has ended."""
    found = [b if isinstance(b, tuple) else (b, ()) for b in found]
    labels = list(dict.fromkeys(e.label for b, _ in found for e in b))

    def solve(events):
        start, tries = 0, searches(found)
        while start < len(events):
            hits = [m for search in tries if (m := search(events, start))]
            if not hits:
                return
            least = min(hits, key=lambda m: (m[0], m[-1], m))
            yield [events[i]["position"] for i in least]
            if not every:
                return
            start = least[-1] + 1

    return per_trace(gathered(log, labels), solve, "positions array<int>")


def matches(log: DataFrame, text: str, bounds: list[Bound] | None = None, every: bool = False) -> DataFrame:
    """(trace_id, positions): the least match of a pattern in each trace that has one, or with ``every`` all matches that don't overlap, the least first."""
    found = branches_of(text, bounds)
    if not found:
        raise ValueError("a pattern has to have a positive event")
    if every:
        return match_all(log, found, True)
    regular = [b for b, own in found if not own and is_regular(b)]
    pairs = [b for b, own in found if not own and is_pair(b)]
    hard = [(b, own) for b, own in found if own or not is_regular(b) and not is_pair(b)]
    parts = [plan(log, b) for b in regular] + [pair_plan(log, b) for b in pairs]
    if hard:
        parts.append(match_all(log, hard))
    out = reduce(DataFrame.union, parts)
    if len(parts) == 1:
        return out
    least = F.min(F.struct(F.element_at("positions", 1).alias("a"), F.element_at("positions", -1).alias("b"), "positions")).alias("m")
    return out.groupBy("trace_id").agg(least).select("trace_id", "m.positions")


def followers(log: DataFrame, text: str) -> DataFrame:
    """(trace_id, next_activity): the activities with which the pattern, followed by them, matches the trace.

    What counts is the match that ends first. Behind a trailing negation, which then stands
    before the next activity, all ends of matches count.
    """
    found = branches_of(text)
    if not found:
        raise ValueError("a pattern has to have a positive event")
    parts = []
    simple = [b for b, _ in found if is_regular(b) and not any(e.negated for e in b)]
    early = [b for b, _ in found if b not in simple and not b[-1].negated]
    late = [b for b, _ in found if b[-1].negated]
    ends = [plan(log, b).select("trace_id", F.element_at("positions", -1).alias("end")) for b in simple]
    if early:
        def first_end(events):
            hits = [m for b in early if (m := match_trace(events, b, by_end=True))]
            if hits:
                yield events[min(m[-1] for m in hits)]["position"]

        ends.append(per_trace(gathered(log, list(dict.fromkeys(e.label for b in early for e in b))), first_end, "end int"))
    if ends:
        end = reduce(DataFrame.union, ends).groupBy("trace_id").agg(F.min("end").alias("end"))
        parts.append(log.join(end, "trace_id").filter(F.col("position") > F.col("end")).select("trace_id", F.col("activity").alias("next_activity")))
    if late:
        def behind(events):
            seen = set()
            for b in late:
                core = list(b)
                while core[-1].negated:
                    core.pop()
                forbidden = b[len(core) :]
                open_ = False
                for i, e in enumerate(events):
                    if open_ and e["activity"] not in seen:
                        seen.add(e["activity"])
                        yield e["activity"]
                    if any(e["activity"] == x.label and variable_ok(e, [], x.attributes) for x in forbidden):
                        open_ = False
                    if e["activity"] == core[-1].label and not open_ and match_trace(events, core, last=i):
                        open_ = True

        parts.append(per_trace(gathered(log, None), behind, "next_activity string"))
    return reduce(DataFrame.union, parts).distinct()
