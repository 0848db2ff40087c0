"""The index kept up to date from a stream: each micro-batch goes through the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

from eventloom.operators.indexing import ingest
from eventloom.sources.readers import Mapping, to_events
from eventloom.sources.store import LogStore


def index_stream(stream: DataFrame, store: LogStore, checkpoint: str, mapping: Mapping | None = None, lookback: str | None = None, every: str | None = None):
    """Start a query that indexes a stream of source rows.

    Events of a later batch come behind those of earlier ones, whatever their times. A batch that
    fails stops the query and leaves the log as it was; the number of the last batch is published
    together with its tables, and a batch that is delivered again is skipped.
    """
    mapping = mapping or Mapping()

    def batch(df: DataFrame, number: int) -> None:
        if not df.isEmpty():
            ingest(store, to_events(df, mapping), lookback, number=number)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
