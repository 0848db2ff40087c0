"""The sequence pattern language: reading, alternatives, and the pairs a match needs.

    pattern  := sequence ("||" sequence)*
    sequence := item+
    item     := ("!" | "^")? (label attributes? | "(" pattern ")") ("*" | "+" | "?")?
    label    := name | "quoted name"
    attributes := "[" key "=" value ("," key "=" value)* "]"
    value    := "text" | $n | $n+k | $n-k        (n counts the positive events from 1)
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from itertools import product

ONE, PLUS, STAR, OPT = "", "+", "*", "?"
_TOKEN = re.compile(r'\s*(?:(\|\|)|("(?:[^"\\]|\\.)*")|(\$\d+)|([A-Za-z_][A-Za-z0-9_:\\]*)|(\d+)|([!^()\[\]*+?=,-]))')


@dataclass(frozen=True)
class Variable:
    """The attribute of the n-th positive event, plus an offset if there is one."""

    n: int
    offset: int | None = None


@dataclass(frozen=True)
class Event:
    """One place of a linear pattern."""

    label: str
    quantifier: str = ONE
    negated: bool = False
    attributes: tuple[tuple[str, str | Variable], ...] = ()


@dataclass(frozen=True)
class Group:
    """Alternatives of sequences."""

    branches: tuple[tuple, ...]
    quantifier: str = ONE
    negated: bool = False


def tokens(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxError(f"unexpected character at {at}: {text[at:at + 10]!r}")
        out.append(m[0].strip())
        at = m.end()
    return out


class Reader:
    def __init__(self, text: str):
        self.tokens, self.at = tokens(text), 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, expected: str | None = None) -> str:
        t = self.peek()
        if not t or expected is not None and t != expected:
            raise SyntaxError(f"expected {expected or 'more'}, found {t or 'the end'}")
        self.at += 1
        return t

    def pattern(self) -> Group:
        branches = [self.sequence()]
        while self.peek() == "||":
            self.take()
            branches.append(self.sequence())
        return Group(tuple(branches))

    def sequence(self) -> tuple:
        items = []
        while self.peek() not in ("", "||", ")"):
            items.append(self.item())
        if not items:
            raise SyntaxError("an empty sequence")
        return tuple(items)

    def item(self):
        negated = self.peek() in ("!", "^")
        if negated:
            self.take()
        if self.peek() == "(":
            self.take()
            found = self.pattern()
            self.take(")")
        else:
            found = Event(self.label(), attributes=self.attributes())
        quantifier = self.take() if self.peek() in ("*", "+", "?") else ONE
        if negated and quantifier not in (ONE, PLUS):
            quantifier = ONE
        return replace(found, quantifier=quantifier, negated=negated)

    def label(self) -> str:
        t = self.take()
        if t.startswith('"'):
            return re.sub(r"\\(.)", r"\1", t[1:-1])
        if not re.match(r"[A-Za-z_]", t):
            raise SyntaxError(f"not a label: {t}")
        return t

    def attributes(self) -> tuple:
        if self.peek() != "[":
            return ()
        self.take()
        out = []
        while True:
            key = self.label()
            self.take("=")
            t = self.take()
            if t.startswith('"'):
                out.append((key, re.sub(r"\\(.)", r"\1", t[1:-1])))
            elif t.startswith("$"):
                offset = None
                if self.peek() in ("+", "-"):
                    sign = 1 if self.take() == "+" else -1
                    offset = sign * int(self.take())
                out.append((key, Variable(int(t[1:]), offset)))
            else:
                raise SyntaxError(f"not a value: {t}")
            if self.peek() != ",":
                break
            self.take()
        self.take("]")
        return tuple(out)


def parse(text: str) -> Group:
    reader = Reader(text)
    found = reader.pattern()
    if reader.peek():
        raise SyntaxError(f"unexpected {reader.peek()}")
    return found


def combined(outer: str, inner: str) -> str:
    """Quantifier of an item that stands in a quantified group."""
    for q in (STAR, PLUS, OPT):
        if q in (outer, inner):
            return STAR if {outer, inner} == {PLUS, OPT} else q
    return ONE


def branches(group: Group, quantifier: str = ONE, negated: bool = False) -> list[list]:
    """Linear alternatives: sequences of events; a negated group is one place that forbids all its labels."""
    out = []
    for sequence in group.branches:
        options = []
        for item in sequence:
            if isinstance(item, Event):
                options.append([[replace(item, quantifier=combined(quantifier, item.quantifier), negated=negated or item.negated)]])
            elif item.negated or negated:
                inner = branches(item, ONE, True)
                options.append([[e for b in inner for e in b]])
            else:
                options.append(branches(item, combined(quantifier, item.quantifier)))
        out += [[e for part in choice for e in part] for choice in product(*options)]
    return out


def linear(text: str) -> list[list[Event]]:
    """Branches of a pattern text, each a sequence of positive and negated events."""
    return branches(parse(text))


def responded_pairs(text: str) -> list[dict]:
    """Per branch and two positive places in order: source, target, quantifiers, labels forbidden between them."""
    out = []
    for b, branch in enumerate(linear(text)):
        at = [k for k, e in enumerate(branch) if not e.negated]
        for i, s in enumerate(at):
            for t in at[i + 1 :]:
                forbidden = sorted({e.label for e in branch[s + 1 : t] if e.negated})
                out.append({"branch": b, "source": branch[s].label, "target": branch[t].label, "source_quantifier": branch[s].quantifier, "target_quantifier": branch[t].quantifier, "forbidden_between": forbidden})
    return out


def info_pairs(text: str) -> list[tuple[str, str]]:
    """Pairs beyond the responded ones: of an activity with itself where it is constrained, repeated or negated, and of a negated one with a positive neighbour."""
    out = []
    for branch in linear(text):
        for k, e in enumerate(branch):
            if e.negated or e.attributes or e.quantifier in (PLUS, STAR):
                out.append((e.label, e.label))
            if e.negated:
                before = [x.label for x in branch[:k] if not x.negated]
                after = [x.label for x in branch[k + 1 :] if not x.negated]
                if before:
                    out.append((before[-1], e.label))
                elif after:
                    out.append((e.label, after[0]))
    return list(dict.fromkeys(out))


def activities(text: str) -> list[dict]:
    """Flat list of label, quantifier, negated and attributes in the order of the text."""
    def walk(group):
        for sequence in group.branches:
            for item in sequence:
                if isinstance(item, Event):
                    yield {"label": item.label, "quantifier": item.quantifier, "negated": item.negated, "attributes": dict(item.attributes)}
                else:
                    yield from walk(item)

    return list(walk(parse(text)))


def expand_compact(text: str) -> str:
    """``"ab*"`` as ``"a b*"``: every letter is an activity of its own."""
    return " ".join(re.findall(r"[!^]?[A-Za-z_][*+?]?|\(|\)|\|\|", text))
