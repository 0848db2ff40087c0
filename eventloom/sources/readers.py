"""Readers of event logs: CSV, JSON, XES; mapping of source columns to events; streams of JSON."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from eventloom.operators.log import COLUMNS, seconds

FIELDS = ("trace_id", "activity", "position", "start_timestamp", "attributes")
XES_DEFAULTS = {"trace_id": "case:concept:name", "activity": "concept:name", "start_timestamp": "time:timestamp", "attributes": ["*"]}
PLAIN_DEFAULTS = {"trace_id": "trace_id", "activity": "activity", "position": "position", "start_timestamp": "timestamp", "attributes": ["*"]}


@dataclass(frozen=True)
class Mapping:
    """Source column of each event field; attributes: ["*"] for all other columns, a list, or none.

    types: of attributes, int, float, boolean, date or string; a value that isn't of its type is left out.
    """

    columns: dict = field(default_factory=lambda: dict(PLAIN_DEFAULTS))
    timestamp_format: str | None = None
    types: dict = field(default_factory=dict)

    def __post_init__(self):
        if unknown := set(self.columns) - set(FIELDS):
            raise ValueError(f"no such fields: {sorted(unknown)}")

    def source_names(self) -> list[str]:
        plain = [v for k, v in self.columns.items() if k != "attributes" and v]
        return plain + [a for a in self.columns.get("attributes") or [] if a != "*"]


def cast_value(value: Column, kind: str) -> Column:
    """``value`` as the named type (int, float, boolean, date, string), null where it doesn't parse."""
    return {"int": value.try_cast("bigint"), "float": value.try_cast("double"), "boolean": value.try_cast("boolean"), "date": value.try_cast("timestamp"), "string": value.cast("string")}[kind]


def to_events(df: DataFrame, mapping: Mapping, order: list[Column] | None = None) -> DataFrame:
    """Rows as events; positions count from 0 by timestamp, else by the source's position, else by ``order`` or row order.

    Times may be epoch seconds or text; a zone in the text counts, text without one is UTC.
    Rows without trace id or activity are left out.
    """
    c = mapping.columns
    at = lambda k: F.col(f"`{c[k]}`") if c.get(k) and c[k] in df.columns else None
    if at("trace_id") is None or at("activity") is None:
        raise ValueError("the source has no column for the trace or the activity")
    time = at("start_timestamp")
    if time is not None:
        text = time.cast("string")
        parsed = F.try_to_timestamp(text, F.lit(mapping.timestamp_format)) if mapping.timestamp_format else text.try_cast("timestamp")
        time = F.coalesce(text.try_cast("bigint"), F.unix_seconds(parsed)) if dict(df.dtypes)[c["start_timestamp"]] not in ("timestamp", "timestamp_ntz") else seconds(time)
    wanted = c.get("attributes") or []
    used = set(mapping.source_names())
    names = [n for n in df.columns if n not in used and not n.startswith("__")] if wanted == ["*"] else [a for a in wanted if a in df.columns]
    if names:
        attributes = F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[cast_value(F.col(f"`{n}`"), mapping.types.get(n, "string")).cast("string") for n in names])), lambda k, v: v.isNotNull())
    else:
        attributes = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    position = at("position")
    rows = df.select(
        at("activity").cast("string").alias("activity"), at("trace_id").cast("string").alias("trace_id"),
        (time if time is not None else F.lit(None).cast("bigint")).alias("start_timestamp"), attributes.alias("attributes"),
        (position.try_cast("bigint") if position is not None else F.lit(None).cast("bigint")).alias("__position"),
        (F.struct(*order) if order else F.monotonically_increasing_id()).alias("__row"),
    ).filter("trace_id is not null and activity is not null")
    w = Window.partitionBy("trace_id").orderBy("start_timestamp", "__position", "__row")
    return rows.withColumn("position", (F.row_number().over(w) - 1).cast("int")).select(*COLUMNS)


def read_csv(spark: SparkSession, path: str, mapping: Mapping | None = None, **options) -> DataFrame:
    """A CSV log with a header; all columns are read as text, without a pass for inference."""
    return to_events(spark.read.csv(path, header=True, multiLine=options.pop("multiLine", False), **options), mapping or Mapping())


def read_json(spark: SparkSession, path: str, mapping: Mapping | None = None, multi_line: bool = True) -> DataFrame:
    return to_events(spark.read.json(path, multiLine=multi_line, primitivesAsString=True), mapping or Mapping())


_ATTRIBUTE = "array<struct<_key:string,_value:string>>"
_KINDS = ("string", "date", "int", "float", "boolean", "id")
_XES = ", ".join([*[f"`{k}` {_ATTRIBUTE}" for k in _KINDS], "event array<struct<" + ",".join(f"`{k}`:{_ATTRIBUTE}" for k in _KINDS) + ">>"])


def read_xes(spark: SparkSession, path: str, mapping: Mapping | None = None) -> DataFrame:
    """An XES log, read in parallel by its <trace> elements; a trace's attributes are named ``case:...``, events go by time, then by place."""
    mapping = mapping or Mapping(dict(XES_DEFAULTS))
    traces = spark.read.format("xml").options(rowTag="trace", ignoreNamespace=True).schema(_XES).load(path)
    flat = lambda prefix: F.flatten(F.array(*[F.coalesce(F.col(f"{prefix}{k}" if prefix else f"`{k}`"), F.array().cast(_ATTRIBUTE)) for k in _KINDS]))
    as_map = lambda entries, lead: F.map_from_entries(F.transform(entries, lambda e: F.struct(F.concat(F.lit(lead), e["_key"]).alias("key"), e["_value"].alias("value"))))
    rows = traces.select(as_map(flat(""), "case:").alias("__case"), F.posexplode("event").alias("__place", "event"))
    rows = rows.select("__case", "__place", as_map(flat("event."), "").alias("__event")).withColumn("__all", F.map_concat("__case", "__event"))
    c = mapping.columns
    named = [c["trace_id"], c["activity"], c["start_timestamp"]]
    wanted = c.get("attributes") or []
    keep = (lambda k: ~k.isin(named) & ~k.startswith("case:")) if wanted == ["*"] else (lambda k: k.isin(wanted))
    value = lambda n: F.col("__all")[n]
    text = value(c["start_timestamp"])
    rows = rows.select(value(c["activity"]).alias("activity"), value(c["trace_id"]).alias("trace_id"), F.unix_seconds(text.try_cast("timestamp")).alias("start_timestamp"), F.map_filter("__all", lambda k, v: keep(k)).alias("attributes"), "__place")
    w = Window.partitionBy("trace_id").orderBy("start_timestamp", "__place")
    rows = rows.filter("trace_id is not null and activity is not null")
    return rows.withColumn("position", (F.row_number().over(w) - 1).cast("int")).select(*COLUMNS)


def read_jsonl(spark: SparkSession, path: str, mapping: Mapping | None = None) -> DataFrame:
    """A log with one JSON object a line, which is split over tasks."""
    return read_json(spark, path, mapping, multi_line=False)


READERS = {"csv": read_csv, "json": read_json, "jsonl": read_jsonl, "xes": read_xes}


def read_log(spark: SparkSession, path: str, mapping: Mapping | None = None, kind: str | None = None) -> DataFrame:
    """A log of the kind that ``kind`` or the path's extension names."""
    kind = kind or path.rstrip("/").removesuffix(".gz").rsplit(".", 1)[-1].lower()
    if kind not in READERS:
        raise ValueError(f"no reader for {kind!r}; there are {sorted(READERS)}")
    return READERS[kind](spark, path, mapping)


def json_stream(spark: SparkSession, folder: str, mapping: Mapping | None = None) -> DataFrame:
    """A stream of JSON-lines files whose source columns are all text."""
    mapping = mapping or Mapping()
    schema = T.StructType([T.StructField(n, T.StringType()) for n in dict.fromkeys(mapping.source_names())])
    return spark.readStream.schema(schema).json(folder)


def kafka_stream(spark: SparkSession, servers: str, topic: str, mapping: Mapping | None = None, starting: str = "latest") -> DataFrame:
    """A stream of JSON messages of a topic; needs Spark's Kafka connector on the class path."""
    mapping = mapping or Mapping()
    schema = T.StructType([T.StructField(n, T.StringType()) for n in dict.fromkeys(mapping.source_names())])
    source = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting, "failOnDataLoss": "false"})
    return source.load().select(F.from_json(F.col("value").cast("string"), schema).alias("v")).select("v.*")


def collect_json(stream: DataFrame, folder: str, checkpoint: str, every: str = "10 seconds"):
    """Append a stream to JSON-lines files, from which ``json_stream`` reads."""
    return stream.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=every).start()
