"""Questions about patterns: statistics, detection, exploration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from eventloom.functions.scores import ratio
from eventloom.operators.log import with_trace_count
from eventloom.plans.matcher import Bound, followers, matches
from eventloom.plans.pattern import STAR, OPT, activities, info_pairs, responded_pairs


def exact_pairs(pairs: set[tuple[str, str]]):
    """Column: (source, target) is one of the pairs; one IN list per source, so partitions of a store by source are pruned."""
    by: dict[str, list[str]] = {}
    for s, t in sorted(pairs):
        by.setdefault(s, []).append(t)
    tests = [(F.col("source") == s) & F.col("target").isin(ts) for s, ts in by.items()]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def statistics(counts: DataFrame, pattern: str, info: bool = False) -> DataFrame:
    """Rows of the count table for the pairs that the pattern needs, and with ``info`` those that say something of its other events, with their average and deviation."""
    wanted = {(p["source"], p["target"]) for p in responded_pairs(pattern)} | set(info_pairs(pattern) if info else [])
    n = F.col("total_completions")
    mean = F.col("total_duration") / n
    var = F.greatest(F.col("sum_squared_duration") / n - mean * mean, F.lit(0.0))
    return counts.filter(exact_pairs(wanted)).select("*", F.round(mean, 6).alias("avg_duration"), F.round(F.sqrt(var), 3).alias("std_duration"))


def candidates(pairs: DataFrame, pattern: str) -> DataFrame:
    """trace_id of the traces that hold all pairs some branch can't do without. Only for pairs without a lookback."""
    by: dict[int, set] = {}
    for p in responded_pairs(pattern):
        by.setdefault(p["branch"], set())
        if not {p["source_quantifier"], p["target_quantifier"]} & {STAR, OPT}:
            by[p["branch"]].add((p["source"], p["target"]))
    out = []
    for wanted in by.values():
        if not wanted:
            return pairs.select("trace_id").distinct()
        found = pairs.filter(exact_pairs(wanted)).select("trace_id", "source", "target").distinct()
        out.append(found.groupBy("trace_id").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted)).select("trace_id"))
    return reduce(DataFrame.union, out).distinct()


def detect(log: DataFrame, pattern: str, pairs: DataFrame | None = None, threshold: float = 0.0, bounds: list[Bound] | None = None, every: bool = False, n_traces: int | None = None) -> DataFrame:
    """trace_id, positions (of the least match), support (share of traces with a match, equal in all rows).

    With ``every``, a row for each of a trace's matches that don't overlap. ``bounds`` limit the
    time or the number of events between places. With an index of pairs (without lookback,
    patterns of two events or more) only the traces that can match are read from the log.
    Nothing is returned below the threshold.
    """
    rows = log
    if pairs is not None and responded_pairs(pattern) and not any(a["negated"] for a in activities(pattern)):
        star = any(a["quantifier"] in (STAR, OPT) for a in activities(pattern))
        rows = log if star else log.join(candidates(pairs, pattern), "trace_id", "left_semi")
    found = matches(rows, pattern, bounds, every)
    traces = found.select("trace_id").distinct() if every else found
    total = with_trace_count(traces.agg(F.count("*").alias("n")), log, n_traces).select(ratio(F.col("n"), F.col("n_traces")).alias("support"))
    return found.crossJoin(F.broadcast(total)).filter(F.col("support") >= threshold)


def explore_accurate(log: DataFrame, pattern: str, targets: list[str] | None = None, n_traces: int | None = None) -> DataFrame:
    """next_activity, support: the share of traces that match the pattern followed by the activity.

    The pattern is matched once for all activities: what lies behind the match that ends first
    follows it (see ``followers``).
    """
    later = followers(log, pattern)
    if targets is not None:
        later = later.filter(F.col("next_activity").isin(targets))
    out = with_trace_count(later.groupBy("next_activity").agg(F.count("*").alias("n")), log, n_traces)
    return out.select("next_activity", ratio(F.col("n"), F.col("n_traces")).alias("support"))


def explore_fast(counts: DataFrame, log: DataFrame, pattern: str, n_traces: int | None = None) -> DataFrame:
    """next_activity, support: an upper bound from the count table, the least number of completions of the pattern's consecutive pairs and of (last, next), by traces."""
    labels = [a["label"] for a in activities(pattern) if not a["negated"]]
    consecutive = set(zip(labels, labels[1:]))
    bound = counts.filter(exact_pairs(consecutive)).agg(F.min("total_completions").alias("bound"), F.count("*").alias("found"))
    limit = F.when(F.col("found") < len(consecutive), F.lit(0)).otherwise(F.coalesce("bound", F.lit(1 << 62)))
    out = counts.filter(F.col("source") == labels[-1]).crossJoin(F.broadcast(bound))
    out = with_trace_count(out.select(F.col("target").alias("next_activity"), F.least("total_completions", limit).alias("n")), log, n_traces)
    return out.select("next_activity", ratio(F.col("n"), F.col("n_traces")).alias("support"))


def explore_hybrid(counts: DataFrame, log: DataFrame, pattern: str, k: int, n_traces: int | None = None) -> DataFrame:
    """The fast answer for k = 0, else the accurate one for the k best of the fast answer."""
    fast = explore_fast(counts, log, pattern, n_traces)
    if k <= 0:
        return fast
    best = fast.orderBy(F.desc("support"), "next_activity").limit(k).select("next_activity")
    return explore_accurate(log, pattern, None, n_traces).join(best, "next_activity", "left_semi")


def explore(log: DataFrame, counts: DataFrame, pattern: str, mode: str = "accurate", k: int = 0, threshold: float = 0.0, n_traces: int | None = None) -> DataFrame:
    if mode not in ("accurate", "fast", "hybrid"):
        raise ValueError(f"no such mode: {mode}")
    out = explore_accurate(log, pattern, None, n_traces) if mode == "accurate" else explore_fast(counts, log, pattern, n_traces) if mode == "fast" else explore_hybrid(counts, log, pattern, k, n_traces)
    return out.filter(F.col("support") >= threshold).orderBy(F.desc("support"), "next_activity")
