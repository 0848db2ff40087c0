"""The engine's endpoints: as a Python object, over HTTP, and from the command line."""

from __future__ import annotations

import argparse
import json
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession, functions as F

from eventloom.operators import analyse, compare, indexing, mine, mining, model, query
from eventloom.operators.log import SCHEMA
from eventloom.plans.matcher import Bound
from eventloom.plans.pattern import expand_compact
from eventloom.sources import sinks
from eventloom.sources.readers import Mapping, collect_json, json_stream, kafka_stream, read_log
from eventloom.sources.store import LogStore
from eventloom.streaming.index_stream import index_stream


#: What every configuration may hold.
COMMON = "namespace log min_timestamp as_page write_to"


def checked(c: dict, names: str) -> None:
    """A ValueError for a key that an endpoint doesn't know."""
    if unknown := set(c) - set(names.split()) - set(COMMON.split()):
        raise ValueError(f"unknown keys: {sorted(unknown)}")


class Engine:
    """Endpoints take a configuration and return a DataFrame, a text or a dict.

    Every configuration may name ``namespace``, ``log`` and ``min_timestamp``; ``as_page`` asks for
    a page instead of rows, ``write_to`` for the rows as JSON lines in a folder, written by the
    executors. See the methods for the rest; a key that isn't named there is an error.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def store(self, c: dict) -> LogStore:
        return LogStore(self.spark, self.root, c.get("namespace", "default"), c.get("log", "log"))

    def log(self, c: dict, table: str = "sequence_table") -> DataFrame:
        return analyse.since(self.store(c).read(table, SCHEMA), c.get("min_timestamp"))

    def trace_count(self, c: dict) -> int | None:
        """The stored number of traces, where all of the log is asked for."""
        return None if c.get("min_timestamp") else self.store(c).facts().get("trace_count")

    # indexing

    def indexing_run(self, c: dict) -> dict:
        """path, kind, mapping with timestamp_format and types, lookback, clear_existing; batch, a number that makes a repeated call do nothing."""
        checked(c, "path kind mapping timestamp_format types lookback clear_existing batch")
        store = self.store(c)
        if c.get("clear_existing"):
            store.clear()
        mapping = Mapping(c["mapping"], c.get("timestamp_format"), c.get("types", {})) if "mapping" in c else None
        return indexing.ingest(store, read_log(self.spark, c["path"], mapping, c.get("kind")), c.get("lookback"), number=c.get("batch"))

    def indexing_stream(self, c: dict) -> dict:
        """path (a folder of JSON lines) or servers and topic, checkpoint, mapping, timestamp_format, lookback, every; without ``every`` what is there is indexed and the stream ends."""
        checked(c, "path servers topic checkpoint mapping timestamp_format lookback every")
        mapping = Mapping(c["mapping"], c.get("timestamp_format")) if "mapping" in c else Mapping()
        source = json_stream(self.spark, c["path"], mapping) if "path" in c else kafka_stream(self.spark, c["servers"], c["topic"], mapping, "earliest")
        query = index_stream(source, self.store(c), c["checkpoint"], mapping, c.get("lookback"), c.get("every"))
        if not c.get("every"):
            query.awaitTermination()
        return {"id": str(query.id), "facts": self.store(c).facts()}

    def indexing_collect(self, c: dict) -> dict:
        """servers, topic, path, checkpoint, mapping, every: messages are appended to JSON lines in ``path`` until the stream is stopped."""
        checked(c, "servers topic path checkpoint mapping every")
        stream = kafka_stream(self.spark, c["servers"], c["topic"], Mapping(c["mapping"]) if "mapping" in c else None)
        return {"id": str(collect_json(stream, c["path"], c["checkpoint"], c.get("every", "10 seconds")).id)}

    # patterns

    @staticmethod
    def pattern(c: dict) -> str:
        """The pattern; with ``compact`` every letter of it is an activity."""
        return expand_compact(c["pattern"]) if c.get("compact") else c["pattern"]

    def querying_statistics(self, c: dict) -> DataFrame:
        """pattern, compact; info to add the pairs that say something of its repeated, negated and constrained events."""
        checked(c, "pattern compact info")
        return query.statistics(self.store(c).read("count_table"), self.pattern(c), c.get("info", False))

    def querying_detection(self, c: dict) -> DataFrame:
        """pattern, compact, support_threshold; return_all for all matches that don't overlap; constraints, a list of {kind: time or gap, from, to, least, most}
        between the pattern's positive events, counted from 0; use_index to prune by the stored pairs, unless they were limited by a lookback."""
        checked(c, "pattern compact support_threshold return_all constraints use_index")
        store = self.store(c)
        pairs = store.read("pairs_index") if c.get("use_index") and not store.facts().get("lookback") else None
        bounds = [Bound(b["from"], b["to"], b.get("least"), b.get("most"), b.get("kind", "time")) for b in c.get("constraints", [])]
        return query.detect(self.log(c, "activity_index"), self.pattern(c), pairs, c.get("support_threshold", 0.0), bounds, c.get("return_all", False), self.trace_count(c))

    def querying_exploration(self, c: dict) -> DataFrame:
        """pattern, compact, explore_mode (accurate, fast, hybrid), explore_k, support_threshold."""
        checked(c, "pattern compact explore_mode explore_k support_threshold")
        return query.explore(self.log(c, "activity_index"), self.store(c).read("count_table"), self.pattern(c), c.get("explore_mode", "accurate"), c.get("explore_k", 0), c.get("support_threshold", 0.0), self.trace_count(c))

    # constraints

    def mining_run(self, c: dict) -> DataFrame:
        """families, support_threshold, trace_ids; stores the constraint rows, and mines again only the traces that have grown since."""
        checked(c, "families support_threshold trace_ids")
        log, families = self.log(c), sorted(c.get("families") or mine.FAMILIES)
        found = mine.constraints(log, families) if c.get("min_timestamp") else mining.refresh(self.store(c), families)
        return mine.supported(found, log, c.get("support_threshold", 0.0), c.get("trace_ids", False), n_traces=self.trace_count(c))

    # analysis

    def analysing_directly_follows(self, c: dict) -> DataFrame:
        checked(c, "support_threshold filter_out end_time trace_based")
        return analyse.directly_follows(self.log(c), c.get("support_threshold"), c.get("filter_out", False), c.get("end_time"), c.get("trace_based", False))

    def analysing_loop_detection(self, c: dict) -> DataFrame:
        checked(c, "grouping_key grouping_value support_threshold filter_out top_k trace_based")
        return analyse.loops(self.log(c), c.get("grouping_key"), c.get("grouping_value"), c.get("support_threshold"), c.get("filter_out", False), c.get("top_k"), c.get("trace_based", False))

    def analysing_durations(self, c: dict) -> DataFrame:
        """mode: activity or group."""
        checked(c, "mode per_group end_time grouping_key grouping_value")
        keys = {k: c.get(k) for k in ("end_time", "grouping_key", "grouping_value")}
        return analyse.group_durations(self.log(c), **keys) if c.get("mode") == "group" else analyse.activity_durations(self.log(c), per_group=c.get("per_group", False), **keys)

    def analysing_attribute_deviations(self, c: dict) -> DataFrame:
        """steps, thresholds, on_rare with rare_threshold, excluded, support_threshold, filter_out."""
        options = "steps surprise_threshold z_threshold alpha n_buckets ngram min_group_size excluded"
        checked(c, f"{options} on_rare rare_threshold support_threshold filter_out")
        log = self.log(c)
        if c.get("on_rare"):
            log = analyse.on_rare(log, mine.ordered(log), c.get("rare_threshold", 0.9))
        scored = analyse.deviations(log, **{k: c[k] for k in options.split() if k in c})
        return analyse.deviation_records(scored, log, c.get("excluded"), c.get("support_threshold"), c.get("filter_out", False))

    # comparison

    def compared(self, c: dict) -> DataFrame:
        """The log without the events that repeat an activity at the same time of a trace, unless ``deduplicate`` is off."""
        return self.log(c).dropDuplicates(["trace_id", "activity", "start_timestamp"]) if c.get("deduplicate", True) else self.log(c)

    def comparing_ngrams(self, c: dict) -> DataFrame:
        """separating_group, n, conditions, deduplicate."""
        checked(c, "separating_group n conditions deduplicate")
        log = self.compared(c)
        return compare.filtered(compare.ngrams(log, compare.trace_labels(log, c["separating_group"]), c.get("n", 2)), c.get("conditions", {}))

    def comparing_rare_rules(self, c: dict) -> DataFrame:
        checked(c, "separating_group support_pct deduplicate")
        log = self.compared(c)
        return compare.rare_rules(mine.ordered(log), compare.trace_labels(log, c["separating_group"]), log, c.get("support_pct", 0.1))

    def comparing_targeted_rules(self, c: dict) -> DataFrame:
        checked(c, "separating_group target_label support_threshold filtering_support deduplicate")
        log = self.compared(c)
        return compare.targeted_rules(mine.ordered(log), compare.trace_labels(log, c["separating_group"]), c.get("target_label", 1), c.get("support_threshold", 0.8), c.get("filtering_support", 1.0))

    # models

    def modeling_directly_follows(self, c: dict) -> DataFrame | str:
        """noise, variant_share, as_xml."""
        checked(c, "noise variant_share as_xml")
        log = model.frequent_variants(self.log(c), c["variant_share"]) if "variant_share" in c else self.log(c)
        graph = model.without_noise(model.dfg(log), c.get("noise", 0.0))
        return model.dfg_xml(graph) if c.get("as_xml") else graph

    def modeling_bpmn(self, c: dict) -> str:
        checked(c, "noise variant_share")
        log = model.frequent_variants(self.log(c), c["variant_share"]) if "variant_share" in c else self.log(c)
        return model.bpmn_xml(model.discover(log, c.get("noise", 0.0)))

    def call(self, name: str, c: dict):
        """The endpoint ``module/endpoint``."""
        name = name.strip("/")
        method = getattr(self, name.replace("/", "_"), None)
        if method is None or name.count("/") != 1:
            raise KeyError(name)
        result = method(c)
        if isinstance(result, DataFrame) and c.get("write_to"):
            result.write.json(c["write_to"])
            return {"path": c["write_to"]}
        return page(result, name) if isinstance(result, DataFrame) and c.get("as_page") else result


def page(result: DataFrame, name: str) -> str:
    """A page of a small result: a graph for edges and pairs of activities, else a table."""
    if name == "comparing/ngrams":
        parts = result.withColumn("part", F.split("ngram", " -> ", -1))
        if parts.filter("size(part) <> 2").isEmpty():
            return sinks.graph_page(parts.select(F.col("part")[0].alias("source"), F.col("part")[1].alias("target"), "balance"), "source", "target", "balance", name)
    if name == "modeling/directly_follows":
        return sinks.graph_page(result.filter("kind = 'edge'"), "source", "target", "frequency", name)
    return sinks.table_page(result, name)


def serialised(result):
    """A result as pieces of JSON text, rows one at a time."""
    if not isinstance(result, DataFrame):
        yield json.dumps(result)
        return
    lead = "["
    for line in result.toJSON().toLocalIterator():
        yield lead + line
        lead = ","
    yield "[]" if lead == "[" else "]"


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """POST /module/endpoint with a JSON configuration; GET /health."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self, code: int, body) -> None:
            data = json.dumps(body).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            self.answer(200 if self.path == "/health" else 404, {"status": "ok"} if self.path == "/health" else {"error": "not found"})

        def do_POST(self):
            try:
                c = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                start = time.time()
                result = engine.call(self.path, c)
                pieces = serialised(result)
                first = next(pieces)  # what fails, fails mostly here
                self.send_response(200)
                self.send_header("Content-Type", "application/json")
                self.end_headers()
                self.wfile.write(b'{"result": ' + first.encode())
                for piece in pieces:
                    self.wfile.write(piece.encode())
                self.wfile.write(f', "time": {time.time() - start}}}'.encode())
            except KeyError as e:
                self.answer(404, {"error": f"not found or missing: {e}"})
            except (ValueError, SyntaxError) as e:
                self.answer(400, {"error": str(e)})
            except Exception as e:  # the server goes on
                self.answer(500, {"error": str(e)[:2000]})

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)


def main(args: list[str] | None = None) -> None:
    """``python -m eventloom.api ROOT module/endpoint --config FILE [--out FILE]``, or ``serve``."""
    from eventloom.session import session

    p = argparse.ArgumentParser(prog="eventloom")
    p.add_argument("root")
    p.add_argument("endpoint")
    p.add_argument("--config")
    p.add_argument("--out", help="a .csv, .json, .html, .xml or .bpmn file")
    p.add_argument("--port", type=int, default=8000)
    a = p.parse_args(args)
    engine = Engine(session(), a.root)
    if a.endpoint == "serve":
        serve(engine, port=a.port).serve_forever()
        return
    c = json.load(open(a.config)) if a.config else {}
    result = engine.call(a.endpoint, c)
    if isinstance(result, DataFrame) and a.out:
        if a.out.endswith(".csv"):
            sinks.write_csv(result, a.out)
        elif a.out.endswith(".html"):
            sinks.write_text(sinks.table_page(result, a.endpoint), a.out)
        else:
            sinks.write_json(result, a.out)
    elif a.out:
        sinks.write_text(result if isinstance(result, str) else json.dumps(result), a.out)
    else:
        for piece in serialised(result):
            print(piece)


if __name__ == "__main__":
    main()
