"""Versioned Parquet tables of a log on any Hadoop file system."""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

EVENTS = "activity string, trace_id string, position int, start_timestamp bigint, attributes map<string,string>"
PAIRS = "source string, target string, trace_id string, source_position int, target_position int, source_timestamp bigint, target_timestamp bigint"
SCHEMAS = {
    "sequence_table": EVENTS,
    "activity_index": EVENTS,
    "trace_metadata": "trace_id string, max_pos int",
    "pairs_index": PAIRS,
    "last_checked": "trace_id string, source string, target string, last_checked bigint",
    "count_table": "source string, target string, total_duration bigint, total_completions bigint, min_duration bigint, max_duration bigint, sum_squared_duration double",
    "constraints": "template string, source string, target string, occurrences int, trace_id string",
}
#: Folders of a table's parts: by a hash of the trace, so that a batch reads what it continues, and by what is asked for.
FOLDERS = {"sequence_table": ["bucket"], "trace_metadata": ["bucket"], "activity_index": ["activity"], "pairs_index": ["source"], "count_table": ["source"]}
TABLES = tuple(SCHEMAS)


class LogStore:
    """Tables of one log under ``root/namespace/log``.

    A table is a list of parts, each written once to a folder of its own; the lists of all tables,
    with the log's facts, stand in one manifest. ``publish`` writes the next manifest and renames
    it into place: readers and retries see all tables of before, or all of after. Old manifests
    and parts that only they name are deleted ``retention`` seconds after they were replaced, so
    a query that has begun can end.
    """

    def __init__(self, spark: SparkSession, root: str, namespace: str = "default", log: str = "log", buckets: int = 16, retention: float = 3600.0):
        self.spark, self.path, self.retention, self.new_buckets = spark, f"{root.rstrip('/')}/{namespace}/{log}", retention, buckets
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def _manifests(self) -> list:
        """Statuses of the manifests, the newest last."""
        return sorted(self.fs.globStatus(self._path("_MANIFEST-*")) or [], key=lambda f: f.getPath().getName())

    def _load(self, status) -> dict:
        stream = self.fs.open(status.getPath())
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self) -> dict:
        """{number, buckets, tables: {table: [parts]}, facts: {...}} as last published; for a new log an empty one."""
        found = self._manifests()
        return self._load(found[-1]) if found else {"number": -1, "buckets": self.new_buckets, "tables": {}, "facts": {}}

    def facts(self) -> dict:
        """What is known of the log: trace_count, event_count, pair_count, start_ts, last_ts, lookback, batch."""
        return self.manifest()["facts"]

    def exists(self, table: str = "sequence_table") -> bool:
        return table in self.manifest()["tables"]

    def clear(self) -> None:
        """Delete all tables of this log."""
        self.fs.delete(self._path(""), True)

    def bucket(self, manifest: dict):
        return F.pmod(F.xxhash64("trace_id"), F.lit(manifest["buckets"])).cast("int")

    def read(self, table: str, schema: str | None = None, manifest: dict | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The table, only those ``buckets`` of it if given; where there is none, an empty one of that schema, or None without a schema."""
        manifest = manifest or self.manifest()
        if table not in manifest["tables"]:
            return None if schema is None else self.spark.createDataFrame([], schema)
        by = FOLDERS.get(table, [])
        fields = schema or SCHEMAS.get(table)
        extra = [f"{c} {'int' if c == 'bucket' else 'string'}" for c in by if not fields or not re.search(rf"(^|, ){c} ", fields)]
        reader = self.spark.read.option("basePath", f"{self.path}/{table}")
        if fields:
            reader = reader.schema(", ".join([fields, *extra, "v string"]))
        out = reader.parquet(*[f"{self.path}/{table}/v={p}" for p in manifest["tables"][table]])
        if buckets is not None:
            out = out.filter(F.col("bucket").isin(buckets))
        return out.drop("v", "bucket")

    def part(self, table: str, df: DataFrame, manifest: dict) -> str:
        """Write ``df`` as a part of the table that no reader sees yet, and return the part's name.

        Folders are filled by rebalanced tasks: small ones share a task, a large one is split over several.
        """
        name, by = f"p-{uuid.uuid4().hex}", FOLDERS.get(table, [])
        if "bucket" in by:
            df = df.withColumn("bucket", self.bucket(manifest))
        (df.hint("rebalance", *by) if by else df).write.partitionBy(*by).parquet(f"{self.path}/{table}/v={name}")
        return name

    def publish(self, manifest: dict) -> None:
        """Make the tables and facts of ``manifest`` the log's, if no other writer has published since it was read; else an OSError."""
        before = self._manifests()
        number = manifest["number"] + 1
        if before and before[-1].getPath().getName() != f"_MANIFEST-{manifest['number']:010d}":
            raise OSError(f"{self.path} was changed by another writer")
        temporary = self._path(f"_NEXT-{uuid.uuid4().hex}")
        out = self.fs.create(temporary, True)
        out.write(bytearray(json.dumps({**manifest, "number": number}).encode()))
        out.close()
        place = self._path(f"_MANIFEST-{number:010d}")
        if self.fs.exists(place) or not self.fs.rename(temporary, place):
            raise OSError(f"the manifest of {self.path} couldn't be put in place")
        manifest["number"] = number
        self._forget(before, manifest)

    def _forget(self, before: list, manifest: dict) -> None:
        """Delete manifests that were replaced longer than the retention ago, and parts of theirs that no other names."""
        limit = (time.time() - self.retention) * 1000
        gone = [m for m, later in zip(before, before[1:]) if later.getModificationTime() < limit]
        if self.retention <= 0:
            gone = before
        if not gone:
            return
        names = lambda m: {(t, p) for t, parts in m["tables"].items() for p in parts}
        kept = names(manifest).union(*[names(self._load(m)) for m in before if m not in gone])
        for m in gone:
            for table, part in names(self._load(m)) - kept:
                self.fs.delete(self._path(f"{table}/v={part}"), True)
            self.fs.delete(m.getPath(), False)

    def write(self, table: str, df: DataFrame) -> DataFrame:
        """Replace one table and return what was written."""
        manifest = self.manifest()
        manifest["tables"][table] = [self.part(table, df, manifest)]
        self.publish(manifest)
        return self.read(table)


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder beside the checkpoints that all executors share; a local one only where none is set and all runs in one process."""
    import tempfile

    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = "file://" + tempfile.gettempdir()
    return f"{root.rstrip('/')}/eventloom-{what}-{uuid.uuid4().hex}"
