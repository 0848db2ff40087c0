"""Lookback limits of pairs."""

from __future__ import annotations

import re
from dataclasses import dataclass

UNITS = {"d": 86400.0, "h": 3600.0, "m": 60.0, "s": 1.0}


@dataclass(frozen=True)
class Lookback:
    """At most ``seconds`` or ``positions`` between the two events of a pair; no limit if both are None."""

    seconds: float | None = None
    positions: int | None = None


def lookback(text: str | Lookback | None) -> Lookback:
    """``"7d"``, ``"25d16m0.5s"`` (seconds) or ``"255i"`` (positions); empty or None sets no limit."""
    if isinstance(text, Lookback):
        return text
    if text is None or not text.strip():
        return Lookback()
    text = text.strip().lower()
    if m := re.fullmatch(r"(\d+)i", text):
        return Lookback(positions=int(m[1]))
    parts = re.findall(r"(\d+(?:\.\d+)?)([dhms])", text)
    if not parts or "".join(n + u for n, u in parts) != text:
        raise ValueError(f"not a lookback: {text!r}")
    return Lookback(seconds=sum(float(n) * UNITS[u] for n, u in parts))
