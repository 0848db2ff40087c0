"""Declarative constraints from small per-trace aggregates; rows are (template, source, target, occurrences, trace_id)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from eventloom.functions.scores import ratio
from eventloom.operators.index import by_trace, event_pairs
from eventloom.operators.log import trace_count, with_trace_count

FAMILIES = ("positional", "existential", "ordered", "unordered", "negation")


def rows(df: DataFrame, template: str, source: str = "source", target: Column | None = None, occurrences: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(template).alias("template"), F.col(source).alias("source"), (target if target is not None else F.lit(None)).cast("string").alias("target"),
        (occurrences if occurrences is not None else F.lit(None)).cast("int").alias("occurrences"), "trace_id",
    )


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def positional(log: DataFrame) -> DataFrame:
    """init: the first event of a trace; end: the last one."""
    ends = log.groupBy("trace_id").agg(F.min_by("activity", "position").alias("init"), F.max_by("activity", "position").alias("end"))
    return union([rows(ends, t, t) for t in ("init", "end")])


def existential(log: DataFrame) -> DataFrame:
    """exactly(a, n) and existence(a, n) for n occurrences of a in the trace, absence(a, n + 1)."""
    n = log.groupBy("trace_id", F.col("activity").alias("source")).agg(F.count("*").alias("n"))
    return union([rows(n, t, occurrences=F.col("n") + k) for t, k in (("exactly", 0), ("existence", 0), ("absence", 1))])


def facts(log: DataFrame, needed: set[str] | None = None) -> DataFrame:
    """Per trace of two events or more and two of its activities: first, last and number of each, df (source directly
    followed by target) and runs (transitions from source to target once other activities are left out); these two only where ``needed``."""
    needed = {"df", "runs"} if needed is None else needed
    own = log.groupBy("trace_id", "activity").agg(F.min("position").alias("f"), F.max("position").alias("l"), F.count("*").alias("c"))
    size = log.groupBy("trace_id").agg(F.count("*").alias("n")).filter("n >= 2").select("trace_id")
    own = own.join(size, "trace_id", "left_semi")
    side = lambda p, a: own.select("trace_id", F.col("activity").alias(a), *[F.col(c).alias(p + c) for c in "flc"])
    keys = ["trace_id", "source", "target"]
    out = side("a", "source").join(side("b", "target"), "trace_id")
    if "df" in needed:
        nxt = log.select("trace_id", F.col("activity").alias("source"), F.lead("activity").over(by_trace()).alias("target")).filter("target is not null")
        out = out.join(nxt.groupBy(*keys).agg(F.count("*").alias("df")), keys, "left").fillna(0, ["df"])
    if "runs" in needed:
        runs = event_pairs(log).filter("source <> target").groupBy(*keys).agg(F.count("*").alias("runs"))
        out = out.join(runs, keys, "left").fillna(0, ["runs"])
    return out


#: Ordered templates as conditions on ``facts``.
ORDERED = {
    "response": "source <> target and al < bl",
    "precedence": "source <> target and af < bf",
    "succession": "source <> target and al < bl and af < bf",
    "alternate_response": "source <> target and runs = ac",
    "alternate_precedence": "source <> target and runs = bc",
    "alternate_succession": "source <> target and runs = ac and runs = bc",
    "chain_response": "source <> target and df = ac",
    "chain_precedence": "source <> target and df = bc",
    "chain_succession": "source <> target and df = ac and df = bc",
    "not_succession": "not af < bl",
    "not_chain_succession": "df = 0",
}


def ordered(log: DataFrame, templates: list[str] | None = None) -> DataFrame:
    """All ordered templates in one pass over the facts: a row per trace, pair and template that holds."""
    names = templates or list(ORDERED)
    held = F.array(*[F.when(F.expr(ORDERED[t]), F.lit(t)) for t in names])
    needed = {f for f in ("df", "runs") if any(f"{f} =" in ORDERED[t] for t in names)}
    out = facts(log, needed).select("trace_id", "source", "target", F.explode(F.filter(held, lambda t: t.isNotNull())).alias("template"))
    return out.select("template", "source", "target", F.lit(None).cast("int").alias("occurrences"), "trace_id")


def activity_pairs(log: DataFrame) -> DataFrame:
    """All (source, target) with source < target; the alphabet is small and has one row per activity."""
    a = log.select(F.col("activity").alias("source")).distinct()
    return a.join(a.select(F.col("source").alias("target")), F.col("source") < F.col("target"))


def alphabet_of(log: DataFrame, most: int = 100_000) -> DataFrame:
    """One row: the sorted activities of the log; an error beyond ``most``, so that the row can be broadcast. Templates over all pairs give more rows than anyone reads long before that."""
    names = log.select("activity").distinct().agg(F.array_sort(F.collect_list("activity")).alias("alphabet"))
    fits = F.when(F.size("alphabet") <= most, F.col("alphabet")).otherwise(F.raise_error(F.lit(f"more than {most} activities")))
    return F.broadcast(names.select(fits.alias("alphabet")))


def unordered(log: DataFrame) -> DataFrame:
    """coexistence, choice and exclusive_choice of every two activities of the log, for each trace with one of them."""
    sets = log.groupBy("trace_id").agg(F.collect_set("activity").alias("own")).crossJoin(alphabet_of(log))
    both = sets.select("trace_id", "own", "alphabet", F.explode("own").alias("a")).select("trace_id", "own", "a", F.explode("alphabet").alias("b")).filter("a <> b")
    both = both.withColumn("other", F.array_contains("own", F.col("b"))).filter("not other or a < b")
    both = both.select("trace_id", F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target"), "other")
    held = F.when(F.col("other"), F.array(F.lit("coexistence"), F.lit("choice"))).otherwise(F.array(F.lit("choice"), F.lit("exclusive_choice")))
    out = both.select("trace_id", "source", "target", F.explode(held).alias("template"))
    return out.select("template", "source", "target", F.lit(None).cast("int").alias("occurrences"), "trace_id")


def negation(log: DataFrame) -> DataFrame:
    """not_coexistence: every two activities and trace that holds at most one of them.

    The rows are the answer, one for each trace and pair; ``negation_support`` counts them without making them.
    """
    traces = log.groupBy("trace_id").agg(F.collect_set("activity").alias("own")).crossJoin(alphabet_of(log))
    out = traces.withColumn("source", F.explode("alphabet")).withColumn("held", F.array_contains("own", F.col("source")))
    targets = F.expr("filter(alphabet, b -> b > source AND NOT (held AND array_contains(own, b)))")
    return rows(out.select("trace_id", "source", F.explode(targets).alias("target")), "not_coexistence", target=F.col("target"))


def negation_support(log: DataFrame) -> DataFrame:
    """source, target, n_traces without both, from counts only."""
    n = unordered(log).filter("template = 'coexistence'").groupBy("source", "target").agg(F.count("*").alias("both"))
    out = activity_pairs(log).join(n, ["source", "target"], "left").crossJoin(F.broadcast(trace_count(log)))
    return out.select("source", "target", (F.col("n_traces") - F.coalesce("both", F.lit(0))).alias("n_traces"))


def constraints(log: DataFrame, families: list[str] | None = None) -> DataFrame:
    """Union of the families' rows."""
    made = {"positional": positional, "existential": existential, "ordered": ordered, "unordered": unordered, "negation": negation}
    return union([made[f](log) for f in families or FAMILIES])


def supported(found: DataFrame, log: DataFrame, threshold: float = 0.0, trace_ids: bool = False, separator: str = "|", n_traces: int | None = None) -> DataFrame:
    """Constraints with the share of traces they hold in, from ``threshold`` on, optionally with the joined trace ids."""
    listed = [F.array_join(F.sort_array(F.collect_list("trace_id")), separator).alias("trace_ids")] if trace_ids else []
    out = found.groupBy("template", "source", "target", "occurrences").agg(F.count("*").alias("n"), *listed)
    out = with_trace_count(out, log, n_traces).withColumn("support", ratio(F.col("n"), F.col("n_traces"))).drop("n", "n_traces")
    return out.filter(F.col("support") >= threshold)


def refreshed(old: DataFrame, log: DataFrame, touched: DataFrame, families: list[str]) -> DataFrame:
    """Stored rows of other traces with new rows of the traces in ``touched`` (trace_id); only for families whose rows depend on their own trace."""
    if set(families) - {"positional", "existential", "ordered"}:
        raise ValueError("unordered and negative rows depend on the whole alphabet: mine them again")
    own = log.join(touched, "trace_id", "left_semi")
    return old.join(touched, "trace_id", "left_anti").select(*old.columns).unionByName(constraints(own, families))
