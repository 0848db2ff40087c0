"""Constraints kept with the stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from eventloom.operators import mine
from eventloom.operators.log import SCHEMA
from eventloom.sources.store import SCHEMAS, LogStore

#: Families whose rows depend on nothing but their own trace, and the first words of the others' templates.
OWN = ("positional", "existential", "ordered")


def refresh(store: LogStore, families: list[str]) -> DataFrame:
    """The constraint rows of the log, published with it.

    The facts name the parts of the trace table that were mined. Where only parts were added
    since, the rows of the families in OWN are kept but for the traces of the new parts; the
    other families, which depend on all activities of the log, are mined anew.
    """
    manifest = store.manifest()
    parts, mined = manifest["tables"].get("trace_metadata", []), manifest["facts"].get("mined", {})
    log = store.read("sequence_table", SCHEMA, manifest)
    known = mined.get("families") == families and set(mined["parts"]) <= set(parts) and "constraints" in manifest["tables"]
    if known and len(mined["parts"]) == len(parts):
        return store.read("constraints", manifest=manifest)
    own = [f for f in families if f in OWN]
    if known and own:
        new = {**manifest, "tables": {"trace_metadata": [p for p in parts if p not in mined["parts"]]}}
        touched = store.read("trace_metadata", SCHEMAS["trace_metadata"], new).select("trace_id").distinct()
        kept = ["init", "end", "exactly", "existence", "absence", *mine.ORDERED]
        old = store.read("constraints", manifest=manifest).filter(F.col("template").isin(kept))
        found = mine.refreshed(old, log, touched, own)
        others = [f for f in families if f not in OWN]
        found = found.unionByName(mine.constraints(log, others)) if others else found
    else:
        found = mine.constraints(log, families)
    manifest["tables"]["constraints"] = [store.part("constraints", found, manifest)]
    manifest["facts"]["mined"] = {"families": families, "parts": parts}
    store.publish(manifest)
    return store.read("constraints", manifest=manifest)
