"""Connected components of a distributed edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from eventloom.llm.common import stored


def merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of a[i] and b[i] for all i in a forest of depth one, whose roots are the smallest members."""
    while len(a):
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        ra, rb = ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (vertex, smallest vertex of its component) that connect what the edges (a, b) connect."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = merge(np.arange(len(names)), at[: len(a)], at[len(a) :])
    child = parent != np.arange(len(names))
    return names[child], names[parent[child]]


def _local(batches):
    """The edges of a partition as a forest over the vertices it has seen."""
    import pyarrow as pa

    a = b = np.zeros(0, dtype=np.int64)
    for batch in batches:
        a, b = np.concatenate([a, batch.column(0).to_numpy()]), np.concatenate([b, batch.column(1).to_numpy()])
        if len(a) > 500_000:
            a, b = forest(a, b)
    a, b = forest(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["hi", "lo"])


def _hooked(batches):
    """As ``_local``, with 1 as ``again`` if a vertex of the partition had several smaller neighbours."""
    import pyarrow as pa

    again, smallest = 0, None
    a = b = np.zeros(0, dtype=np.int64)
    for batch in batches:
        hi, lo = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not again:  # rows come in the order of hi
            first = np.append(True, hi[1:] != hi[:-1])
            before = np.append(smallest[1] if smallest and smallest[0] == hi[0] else lo[0], lo[:-1]) if len(hi) else lo
            if smallest and len(hi) and smallest[0] == hi[0]:
                first[0] = False
            again = int((~first & (lo != before)).any())
            smallest = (hi[-1], lo[-1]) if len(hi) else smallest
        a, b = np.concatenate([a, hi]), np.concatenate([b, lo])
        if len(a) > 500_000:
            a, b = forest(a, b)
    a, b = forest(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), again, dtype=np.int32))], ["hi", "lo", "again"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): every vertex of an edge and the smallest vertex reachable from it.

    Each partition first replaces its edges by a forest over the vertices it has seen, so a
    vertex has at most one smaller neighbour per partition however many edges it has. Then, a
    shuffle a round, the edges of a vertex meet and are replaced by a forest again, until no
    vertex has two smaller neighbours; at last each vertex follows its parents, twice as far at
    every step. Every second round is written to the shared folder. Null ends and loops are dropped.
    """
    e = edges.select(F.greatest(a, b).cast("long").alias("hi"), F.least(a, b).cast("long").alias("lo"))
    e = e.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).filter("hi <> lo")
    e = e.mapInArrow(_local, "hi long, lo long")
    met = lambda x: x.select("hi", "lo").repartition("hi").sortWithinPartitions("hi").mapInArrow(_hooked, "hi long, lo long, again int")
    while True:
        e = stored(met(met(e)), "edges")
        if not e.agg(F.max("again")).first()[0]:
            break
    parents = e.select("hi", "lo")
    while True:
        up = parents.select(F.col("hi").alias("p"), F.col("lo").alias("q"))
        step = parents.join(up, parents["lo"] == up["p"], "left")
        step = stored(step.select("hi", F.coalesce("q", "lo").alias("lo"), F.col("q").isNotNull().cast("int").alias("moved")), "parents")
        parents = step.select("hi", "lo")
        if not step.agg(F.max("moved")).first()[0]:
            break
    roots = parents.select(F.col("lo").alias("id")).distinct().withColumn("component", F.col("id"))
    return parents.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(roots)
