"""Comparison of two groups of traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from eventloom.functions.scores import ratio
from eventloom.operators.index import by_trace
from eventloom.operators.log import with_trace_count


def trace_labels(log: DataFrame, separating: list[str]) -> DataFrame:
    """trace_id, label: 1 if one of the activities occurs in the trace, else 0."""
    if not separating:
        raise ValueError("the separating group has to name an activity")
    return log.groupBy("trace_id").agg(F.max(F.col("activity").isin(separating).cast("int")).alias("label"))


def ngrams(log: DataFrame, labels: DataFrame, n: int = 2, display: str = "DISPLAY_NAME") -> DataFrame:
    """n-grams of activities with the numbers of label-1 and label-0 traces that hold them and what follows from these.

    balance = support_1 - support_0; direction names the label with the larger support. An
    activity's display name, if its attributes have one, is appended to it.
    """
    name = F.concat_ws(" ", F.col("activity"), F.col("attributes").getItem(display))
    parts = [F.lead("name", i).over(by_trace()) if i else F.col("name") for i in range(n)]
    rows = log.select("trace_id", "position", name.alias("name"))
    rows = rows.select("trace_id", parts[-1].alias("last"), F.concat_ws(" -> ", *parts).alias("ngram")).filter("last is not null")
    per_trace = rows.select("trace_id", "ngram").distinct().join(labels, "trace_id")
    out = per_trace.groupBy("ngram").agg(F.sum("label").alias("count_1"), F.sum(1 - F.col("label")).alias("count_0"))
    totals = labels.agg(F.greatest(F.sum("label"), F.lit(1)).alias("total_1"), F.greatest(F.sum(1 - F.col("label")), F.lit(1)).alias("total_0"))
    out = out.crossJoin(F.broadcast(totals))
    one, zero = F.col("count_1"), F.col("count_0")
    balance = one / F.col("total_1") - zero / F.col("total_0")
    return out.select(
        "ngram", "count_1", "count_0", F.round(balance, 6).alias("balance"), ratio(one, one + zero).alias("confidence_1"), ratio(zero, one + zero).alias("confidence_0"),
        ratio(one, F.col("total_1")).alias("support_1"), ratio(zero, F.col("total_0")).alias("support_0"), ratio(one + zero, F.col("total_1") + F.col("total_0")).alias("support"),
        F.when(balance > 0, "label_1").when(balance < 0, "label_0").otherwise("neutral").alias("direction"),
    )


def filtered(grams: DataFrame, conditions: dict[str, dict[str, float]]) -> DataFrame:
    """Rows that meet all conditions: {column: {gt | lt | gte | lte | abs_gt | abs_lt: bound}}."""
    tests = {"gt": lambda c, v: c > v, "lt": lambda c, v: c < v, "gte": lambda c, v: c >= v, "lte": lambda c, v: c <= v, "abs_gt": lambda c, v: F.abs(c) > v, "abs_lt": lambda c, v: F.abs(c) < v}
    for column, bounds in conditions.items():
        for test, bound in bounds.items():
            grams = grams.filter(tests[test](F.col(column), bound))
    return grams


def held_rules(ordered: DataFrame, labels: DataFrame) -> DataFrame:
    """Per pair of activities and trace with a rule between them: source, target, trace_id, templates, label (0 where there is none)."""
    rules = ordered.groupBy("source", "target", "trace_id").agg(F.collect_set("template").alias("templates"))
    known = labels.select(F.col("trace_id").alias("of"), F.col("label").cast("int").alias("label"))
    return rules.join(known, rules["trace_id"] == known["of"], "left").drop("of").fillna(0, ["label"])


def listed(rules: DataFrame, pairs: DataFrame, member: Column) -> DataFrame:
    """The rules between ``pairs``, each with the sorted list of ``member`` over its traces."""
    chosen = pairs.select(F.col("source").alias("a"), F.col("target").alias("b"))
    kept = rules.join(chosen, (rules["source"] == chosen["a"]) & (rules["target"] == chosen["b"]), "left_semi")
    return kept.select("source", "target", F.explode("templates").alias("template"), member.alias("member")).groupBy("source", "target", "template").agg(F.sort_array(F.collect_list("member")).alias("trace_ids"))


def rare_rules(ordered: DataFrame, labels: DataFrame, log: DataFrame, support_pct: float = 0.1) -> DataFrame:
    """Rules between activities that at most that share of traces have any rule of, in label-1 traces: template, source, target, trace_ids."""
    rules = held_rules(ordered, labels)
    pairs = with_trace_count(rules.groupBy("source", "target").agg(F.count("*").alias("n")), log).filter(F.col("n") <= support_pct * F.col("n_traces"))
    return listed(rules.filter("label = 1"), pairs, F.col("trace_id"))


def targeted_rules(ordered: DataFrame, labels: DataFrame, target_label: int = 1, support_threshold: float = 0.8, filtering_support: float = 1.0) -> DataFrame:
    """Rules whose traces mostly have the target label and which most target traces have: source, target, template, trace_ids (trace_id, label)."""
    rules = held_rules(ordered, labels)
    hit = (F.col("label") == target_label).cast("int")
    pairs = rules.groupBy("source", "target").agg(F.avg(hit).alias("share"), F.sum(hit).alias("hits"))
    pairs = pairs.crossJoin(F.broadcast(labels.agg(F.sum(hit).alias("wanted"))))  # one row
    pairs = pairs.filter((F.col("hits") > 0) & (F.col("share") >= filtering_support) & (F.col("hits") >= support_threshold * F.col("wanted")))
    return listed(rules, pairs, F.struct("trace_id", "label"))
