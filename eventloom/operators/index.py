"""Index tables of a log: activities, traces, event pairs and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from eventloom.functions.lookback import Lookback, lookback


def by_trace() -> WindowSpec:
    """Events of a trace in order."""
    return Window.partitionBy("trace_id").orderBy("position")


PAIR_COLUMNS = ["source", "target", "trace_id", "source_position", "target_position", "source_timestamp", "target_timestamp", "source_attributes", "target_attributes"]


def trace_metadata(log: DataFrame) -> DataFrame:
    """trace_id, max_pos."""
    return log.groupBy("trace_id").agg(F.max("position").alias("max_pos"))


def log_metadata(log: DataFrame) -> DataFrame:
    """One row: trace_count, event_count, start_ts, last_ts."""
    return log.agg(
        F.count_distinct("trace_id").alias("trace_count"),
        F.count("*").alias("event_count"),
        F.min("start_timestamp").alias("start_ts"),
        F.max("start_timestamp").alias("last_ts"),
    )


def memberships(log: DataFrame, attributes: bool = False) -> DataFrame:
    """Each event once for every other activity of its trace: (trace_id, mine, other, position, time, attributes).

    The activities of a trace come from an aggregate by trace, whose partitioning the join, the
    windows and the groups that follow reuse: one shuffle by trace.
    """
    kept = ["trace_id", "activity", "position", "start_timestamp", *(["attributes"] if attributes else [])]
    present = log.groupBy("trace_id").agg(F.collect_set("activity").alias("present"))  # one entry per activity
    rows = log.select(*kept).join(present, "trace_id")
    return rows.withColumn("other", F.explode("present")).drop("present").filter("other <> activity")


def within(limit: Lookback) -> Column:
    ok = F.lit(True)
    if limit.seconds is not None:
        ok = ok & (F.col("target_timestamp") - F.col("source_timestamp") <= F.lit(limit.seconds))
    if limit.positions is not None:
        ok = ok & (F.col("target_position") - F.col("source_position") <= F.lit(limit.positions))
    return ok


def event_pairs(log: DataFrame, limit: str | Lookback | None = None, attributes: bool = False) -> DataFrame:
    """Skip-till-next-match, non-overlapping pairs of every two activities of a trace, an activity with itself included.

    For two activities, every target that follows a run of sources makes one pair with the
    first source of the run that is within the lookback; equal activities pair up one after
    the other. Order is by position.
    """
    limit = lookback(limit)
    event = F.struct(F.col("position"), F.col("start_timestamp"), *([F.col("attributes")] if attributes else [])).alias("event")
    both = memberships(log, attributes)
    # the same events seen as sources of (mine, other) and as targets of (other, mine)
    seen = both.select("trace_id", F.explode(F.array(F.struct(F.col("activity").alias("source"), F.col("other").alias("target"), F.lit(True).alias("is_source")), F.struct(F.col("other").alias("source"), F.col("activity").alias("target"), F.lit(False).alias("is_source")))).alias("as"), event)
    seen = seen.select("trace_id", "as.*", "event")
    # backwards, so that the frame only ever grows
    later = Window.partitionBy("trace_id", "source", "target").orderBy(F.desc("event.position")).rowsBetween(Window.unboundedPreceding, -1)
    hits = seen.withColumn("next", F.last(F.when(~F.col("is_source"), F.col("event")), ignorenulls=True).over(later)).filter("is_source and next is not null")
    flat = lambda df, a, b: df.select(
        "source", "target", "trace_id",
        F.col(f"{a}.position").alias("source_position"), F.col(f"{b}.position").alias("target_position"),
        F.col(f"{a}.start_timestamp").alias("source_timestamp"), F.col(f"{b}.start_timestamp").alias("target_timestamp"),
        *([F.col(f"{a}.attributes").alias("source_attributes"), F.col(f"{b}.attributes").alias("target_attributes")] if attributes else []),
    )
    near = flat(hits, "event", "next").filter(within(limit))
    first = near.groupBy("trace_id", "source", "target", "target_position").agg(F.min_by(F.struct(*near.columns), "source_position").alias("pair"))
    unlike = first.select("pair.*")
    w = Window.partitionBy("trace_id", "activity").orderBy("position")
    again = log.select("trace_id", F.col("activity").alias("source"), F.col("activity").alias("target"), event, F.lead(event).over(w).alias("next")).filter("next is not null")
    return unlike.union(flat(again, "event", "next").filter(within(limit)))


def count_table(pairs: DataFrame) -> DataFrame:
    """Per source and target: total, number, least, greatest and sum of squares of durations (seconds)."""
    d = F.col("target_timestamp") - F.col("source_timestamp")
    return pairs.groupBy("source", "target").agg(
        F.sum(d).alias("total_duration"),
        F.count("*").alias("total_completions"),
        F.min(d).alias("min_duration"),
        F.max(d).alias("max_duration"),
        F.sum((d * d).cast("decimal(38,0)")).cast("double").alias("sum_squared_duration"),
    )


def merge_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sum of two count tables."""
    return old.unionByName(new).groupBy("source", "target").agg(
        F.sum("total_duration").alias("total_duration"), F.sum("total_completions").alias("total_completions"), F.min("min_duration").alias("min_duration"),
        F.max("max_duration").alias("max_duration"), F.sum("sum_squared_duration").alias("sum_squared_duration"),
    )


def last_checked(pairs: DataFrame, limit: str | None = None, now: int | None = None) -> DataFrame:
    """Time of the last target paired per trace, source and target; entries older than the lookback before ``now`` go."""
    return pruned(pairs.groupBy("trace_id", "source", "target").agg(F.max("target_timestamp").alias("last_checked")), limit, now)


def pruned(checked: DataFrame, limit: str | None, now: int | None) -> DataFrame:
    """Entries that a lookback in time still reaches from ``now``."""
    seconds = lookback(limit).seconds
    return checked if seconds is None or now is None else checked.filter(F.col("last_checked") >= F.lit(now - seconds))


def continue_positions(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """``batch`` with its positions moved behind those of the stored traces (trace_id, max_pos)."""
    offset = F.coalesce(F.col("max_pos"), F.lit(-1)) + 1
    joined = batch.join(stored.select("trace_id", "max_pos"), "trace_id", "left")
    return joined.withColumn("position", (F.col("position") + offset).cast("int")).select(*batch.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` and those of ``old`` with other keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)
