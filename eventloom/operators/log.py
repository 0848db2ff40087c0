"""Event logs: the schema, and views of other tables as logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Columns of a log. Time is in epoch seconds; positions count from 0 within a trace.
SCHEMA = "activity string, trace_id string, position int, start_timestamp bigint, attributes map<string,string>"
COLUMNS = ["activity", "trace_id", "position", "start_timestamp", "attributes"]


def seconds(column: Column) -> Column:
    """Epoch seconds of a timestamp with or without zone, in the session's zone."""
    return F.unix_seconds(column.cast("timestamp"))


def as_log(df: DataFrame, trace: Column, activity: Column, order: list[Column], time: Column, attributes: Column | None = None) -> DataFrame:
    """A log with positions by ``order`` within each trace."""
    position = (F.row_number().over(Window.partitionBy("trace_id").orderBy(*[f"__o{i}" for i in range(len(order))])) - 1).cast("int")
    rows = df.select(
        activity.cast("string").alias("activity"),
        trace.cast("string").alias("trace_id"),
        time.cast("bigint").alias("start_timestamp"),
        (attributes if attributes is not None else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("attributes"),
        *[o.alias(f"__o{i}") for i, o in enumerate(order)],
    )
    return rows.withColumn("position", position).select(*COLUMNS)


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` by user: the event type is the activity, value and props.k are attributes."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    attributes = F.create_map(F.lit("value"), F.col("value").cast("string"), F.lit("k"), F.get_json_object("props", "$.k"))
    return as_log(e, F.col("user_id"), F.col("event_type"), [F.col("ts"), F.col("event_id")], seconds(F.col("ts")), attributes)


def sessions_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` by user and day: many short traces."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    trace = F.concat(F.col("user_id").cast("string"), F.lit(":"), F.date_format("ts", "yyyy-MM-dd"))
    attributes = F.create_map(F.lit("value"), F.col("value").cast("string"), F.lit("k"), F.get_json_object("props", "$.k"))
    return as_log(e, trace, F.col("event_type"), [F.col("ts"), F.col("event_id")], seconds(F.col("ts")), attributes)


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` by customer, the priority being the activity; days give many ties."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    attributes = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("price"), F.col("o_totalprice").cast("string"))
    return as_log(o, F.col("o_custkey"), F.col("o_orderpriority"), [F.col("o_orderdate"), F.col("o_orderkey")], seconds(F.col("o_orderdate")), attributes)


def trace_count(log: DataFrame) -> DataFrame:
    """One row: n_traces."""
    return log.select("trace_id").distinct().agg(F.count("*").alias("n_traces"))


def with_trace_count(df: DataFrame, log: DataFrame, known: int | None = None) -> DataFrame:
    """``df`` with n_traces, a single value, in every row; ``known`` from the log's stored facts spares a pass over the log."""
    return df.crossJoin(F.broadcast(trace_count(log))) if known is None else df.withColumn("n_traces", F.lit(known).cast("long"))
