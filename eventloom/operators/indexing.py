"""Building and continuing the stored index of a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from eventloom.operators import index
from eventloom.operators.log import COLUMNS, SCHEMA
from eventloom.sources.store import PAIRS, SCHEMAS, LogStore

#: Parts of a table before they are merged into one.
MOST_PARTS = 20


def ingest(store: LogStore, batch: DataFrame, lookback: str | None = None, continued: bool = True, number: int | None = None) -> dict:
    """Add a batch of events to all tables and return the log's facts.

    New events of a known trace get the positions behind its stored ones. Pairs are found from
    the whole sequence of the traces in the batch, of which only the buckets with such traces are
    read; pairs with a target in the batch are new, all others stay as they are, so every table
    grows by a part of the batch's size and counts are added up. With ``continued`` off, events at
    a known position are replaced and the tables are written anew.

    All tables are published at once. A call that fails leaves the log as it was and can be
    repeated; a batch with a ``number`` that was already published is skipped. Batches one after
    the other and all at once give the same tables.
    """
    manifest = store.manifest()
    facts = manifest["facts"]
    if number is not None and facts.get("batch", -1) >= number:
        return facts
    if facts and facts.get("lookback") != lookback:
        raise ValueError(f"the log was indexed with the lookback {facts.get('lookback')!r}")
    batch = batch.select(*COLUMNS)
    if continued:
        _append(store, manifest, batch, lookback)
    else:
        _replace(store, manifest, batch, lookback)
    manifest["facts"] |= {"lookback": lookback} | ({} if number is None else {"batch": number})
    store.publish(manifest)
    return manifest["facts"]


def _add(store: LogStore, manifest: dict, table: str, rows: DataFrame) -> DataFrame:
    """Add a part to a table of the manifest; returns the rows as written. Many parts become one."""
    parts = manifest["tables"].get(table, [])
    new = store.part(table, rows, manifest)
    manifest["tables"][table] = [new]
    written = store.read(table, manifest=manifest)
    manifest["tables"][table] = [*parts, new]
    if len(parts) >= MOST_PARTS:
        merged = store.part(table, store.read(table, manifest=manifest), manifest)
        manifest["tables"][table] = [merged]
    return written


def _append(store: LogStore, manifest: dict, batch: DataFrame, lookback: str | None) -> None:
    known = bool(manifest["facts"])
    before = store.read("trace_metadata", SCHEMAS["trace_metadata"], manifest) if known else None
    if known:
        buckets = [r[0] for r in batch.select(store.bucket(manifest)).distinct().collect()]  # at most the number of buckets
        before = store.read("trace_metadata", manifest=manifest, buckets=buckets).groupBy("trace_id").agg(F.max("max_pos").alias("max_pos"))
        old = store.read("sequence_table", manifest=manifest, buckets=buckets)
        batch = index.continue_positions(batch, before)
    new = _add(store, manifest, "sequence_table", batch)
    _add(store, manifest, "activity_index", new)
    ends = new.groupBy("trace_id").agg(F.max("position").alias("max_pos"), F.min("position").alias("first"), F.count("*").alias("n"), F.min("start_timestamp").alias("lo"), F.max("start_timestamp").alias("hi"))
    _add(store, manifest, "trace_metadata", ends.select("trace_id", "max_pos"))
    totals = ends.agg(F.sum((F.col("first") == 0).cast("long")).alias("traces"), F.sum("n").alias("events"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    if known:
        whole = old.join(new.select("trace_id").distinct(), "trace_id", "left_semi").select(*COLUMNS).unionByName(new)
        firsts = ends.select(F.col("trace_id").alias("of"), "first")
        pairs = index.event_pairs(whole, lookback)
        pairs = pairs.join(firsts, pairs["trace_id"] == firsts["of"]).filter("target_position >= first").select(*index.PAIR_COLUMNS[:7])
    else:
        pairs = index.event_pairs(new, lookback)
    pairs = _add(store, manifest, "pairs_index", pairs)
    _add(store, manifest, "last_checked", index.last_checked(pairs))
    counts = index.count_table(pairs)
    if known:
        counts = index.merge_counts(store.read("count_table", manifest=manifest).select(*counts.columns), counts)
    manifest["tables"]["count_table"] = [store.part("count_table", counts, manifest)]
    least = lambda f, a, b: f(x for x in (a, b) if x is not None) if (a, b) != (None, None) else None
    facts = manifest["facts"]
    manifest["facts"] = facts | {
        "trace_count": facts.get("trace_count", 0) + (totals.traces or 0),
        "event_count": facts.get("event_count", 0) + (totals.events or 0),
        "start_ts": least(min, facts.get("start_ts"), totals.lo),
        "last_ts": least(max, facts.get("last_ts"), totals.hi),
        "pair_count": int(store.read("count_table", manifest=manifest).agg(F.sum("total_completions")).first()[0] or 0),
    }


def _replace(store: LogStore, manifest: dict, batch: DataFrame, lookback: str | None) -> None:
    whole = index.upsert(store.read("sequence_table", SCHEMA, manifest), batch, ["trace_id", "activity", "position"])
    touched = batch.select("trace_id").distinct()
    kept = store.read("pairs_index", PAIRS, manifest).select(*index.PAIR_COLUMNS[:7]).join(touched, "trace_id", "left_anti")
    put = lambda table, rows: manifest["tables"].update({table: [store.part(table, rows, manifest)]})
    put("sequence_table", whole)
    sequence = store.read("sequence_table", manifest=manifest).select(*COLUMNS)
    put("activity_index", sequence)
    put("trace_metadata", index.trace_metadata(sequence))
    put("pairs_index", kept.unionByName(index.event_pairs(sequence.join(touched, "trace_id", "left_semi"), lookback)))
    pairs = store.read("pairs_index", manifest=manifest)
    put("last_checked", index.last_checked(pairs))
    put("count_table", index.count_table(pairs))
    manifest["facts"] |= index.log_metadata(sequence).first().asDict() | {"pair_count": pairs.count()}


def last_checked(store: LogStore) -> DataFrame:
    """Time of the last target paired per trace, source and target; without those that the lookback has left behind."""
    facts = store.facts()
    rows = store.read("last_checked", SCHEMAS["last_checked"])
    rows = rows.groupBy("trace_id", "source", "target").agg(F.max("last_checked").alias("last_checked"))
    return index.pruned(rows, facts.get("lookback"), facts.get("last_ts"))
