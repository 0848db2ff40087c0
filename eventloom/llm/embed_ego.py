"""Exact cosine join of embeddings in epsilon grid order."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from eventloom.llm.common import scratch, stored
from eventloom.llm.components import components, merge

#: Vectors of a block, blocks of an interval, children of a node of the tree of partitions.
BLOCK, SUPER, FAN = 512, 16, 16


def basis_of(vectors: DataFrame, sample: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(principal directions as columns, strongest first; mean) from at most 2 * ``sample`` vectors, picked by a hash.

    The join is exact under any orthonormal basis; the basis only decides how much is skipped.
    """
    every = max(1, vectors.count() // sample)
    rows = vectors.filter(F.pmod(F.xxhash64("rep"), F.lit(every)) == 0).select("embedding").limit(2 * sample).collect()
    x = np.array([r[0] for r in rows], dtype=np.float64)
    if not len(x):
        x = np.array([r[0] for r in vectors.select("embedding").limit(1).collect()], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mean = x.mean(axis=0)
    _, v = np.linalg.eigh((x - mean).T @ (x - mean))
    return v[:, ::-1], mean


def ego_blocks(vectors: DataFrame, eps: float, leading: int) -> DataFrame:
    """Blocks of the vectors in epsilon grid order with their boxes on the leading principal dimensions.

    One row per block: part, seq (places in the order), low, high, reps, ids, mults, data (unit vectors).
    """
    basis, mean = basis_of(vectors)
    axes = basis[:, :leading]
    dim = len(mean)
    schema = "cell array<int>, rep long, id long, mult long, spot binary, data binary"

    def project(batches):
        import pyarrow as pa

        for batch in batches:
            flat = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            x = flat / np.abs(flat).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            z = (x - mean) @ axes
            cells = np.floor(z / eps).astype(np.int32)
            offsets = pa.array(np.arange(0, cells.size + 1, leading, dtype=np.int32))
            cell = pa.ListArray.from_arrays(offsets, pa.array(cells.ravel()))
            pack = lambda a: pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(np.arange(len(a) + 1, dtype=np.int32) * (a.shape[1] * 8)), pa.py_buffer(np.ascontiguousarray(a))])
            yield pa.RecordBatch.from_arrays([cell, batch.column(0), batch.column(1), batch.column(2), pack(z), pack(x)], ["cell", "rep", "id", "mult", "spot", "data"])

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq, held = TaskContext.get().partitionId(), 0, []

        def emit(rows):
            z = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.float64).reshape(-1, leading)
            columns = [[part], [seq], [z.min(axis=0).tolist()], [z.max(axis=0).tolist()], *[[[r[k] for r in rows]] for k in range(3)], [b"".join(r[4] for r in rows)]]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "seq", "low", "high", "reps", "ids", "mults", "data"])

        for batch in batches:
            held += zip(*(batch.column(i).to_pylist() for i in range(1, 6)))
            while len(held) >= BLOCK:
                yield emit(held[:BLOCK])
                held, seq = held[BLOCK:], seq + 1
        if held:
            yield emit(held)

    rows = vectors.select("rep", "id", "mult", "embedding").mapInArrow(project, schema)
    rows = stored(rows, "ego-cells")  # the range partitioner reads the cells of what is stored
    rows = rows.repartitionByRange("cell").sortWithinPartitions("cell", "spot")
    out = "part int, seq int, low array<double>, high array<double>, reps array<long>, ids array<long>, mults array<long>, data binary"
    return stored(rows.mapInArrow(cut, out), "ego-blocks")


def box_gap(low_a: str, high_a: str, low_b: str, high_b: str) -> str:
    """SQL for the squared distance of two boxes."""
    gap = f"zip_with(zip_with({low_a}, {high_b}, (x, y) -> x - y), zip_with({low_b}, {high_a}, (x, y) -> x - y), (x, y) -> greatest(x, y, 0D))"
    return f"aggregate({gap}, 0D, (s, x) -> s + x * x)"


def interval_pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """Pairs of intervals of SUPER blocks that may hold vectors within ``eps``: (part_a, sup_a, part_b, sup_b), a <= b.

    The sequence of partitions is a tree of FAN children a node, whose leaves are the intervals.
    The recursion starts from the pair of the root with itself and goes down by joins on the
    parents; a pair whose boxes lie farther apart than ``eps`` is not followed. Nothing of it
    passes the driver but the number of partitions.
    """
    reach = eps * eps * (1 + 1e-9) + 1e-12
    size = len(blocks.select("low").first()[0])
    edges = [f(F.col(c)[i]).alias(f"{c}{i}") for c, f in (("low", F.min), ("high", F.max)) for i in range(size)]
    sup = blocks.withColumn("sup", F.floor(F.col("seq") / SUPER).cast("int")).groupBy("part", "sup").agg(*edges)
    box = [F.array(*[F.col(f"{c}{i}") for i in range(size)]).alias(c) for c in ("low", "high")]
    sup = stored(sup.select("part", "sup", *box), "ego-intervals")
    levels, n = 0, sup.agg(F.max("part")).first()[0] + 1
    while FAN**levels < n:
        levels += 1
    inner = [f(F.col(c)[i]).alias(f"{c}{i}") for c, f in (("low", F.min), ("high", F.max)) for i in range(size)]
    near = f"{box_gap('low_a', 'high_a', 'low_b', 'high_b')} <= {reach!r}D"
    side = lambda df, s: df.select(*[F.col(c).alias(f"{c}_{s}") for c in df.columns])
    pairs = sup.limit(1).select(F.lit(0).alias("up_a"), F.lit(0).alias("up_b"))
    for level in range(levels - 1, -1, -1):
        node = F.floor(F.col("part") / FAN**level).cast("int")
        nodes = sup.groupBy(node.alias("node")).agg(*inner).select("node", F.floor(F.col("node") / FAN).cast("int").alias("up"), *box)
        pairs = pairs.join(side(nodes, "a"), "up_a").join(side(nodes, "b"), "up_b").filter("node_a <= node_b").filter(near)
        pairs = pairs.select(F.col("node_a").alias("up_a"), F.col("node_b").alias("up_b"))
    leaves = sup.withColumn("up", F.col("part") if levels else F.lit(0))
    pairs = pairs.join(side(leaves, "a"), "up_a").join(side(leaves, "b"), "up_b")
    pairs = pairs.filter("part_a < part_b or part_a = part_b and sup_a <= sup_b").filter(near)
    return pairs.select("part_a", "sup_a", "part_b", "sup_b")


def tile_links(left: list, right: list | None, cosine: float, reach: float):
    """Links inside a tile, as (reps, number of linked vectors) and forest edges (id, id).

    left, right: blocks (low, high, reps, ids, mults, unit vectors); right is None for a tile with itself.
    """
    blocks = left + (right or [])
    at = np.cumsum([0] + [len(b[2]) for b in blocks])
    reps, ids, mults = (np.concatenate([b[k] for b in blocks]) for k in (2, 3, 4))
    links, parent = np.zeros(len(reps), dtype=np.int64), np.arange(len(reps))
    small = [b[5].astype(np.float32) for b in blocks]
    for i in range(len(left)):
        others = range(i, len(left)) if right is None else range(len(left), len(blocks))
        for j in others:
            gap = np.maximum(0, np.maximum(blocks[i][0] - blocks[j][1], blocks[j][0] - blocks[i][1]))
            if gap @ gap > reach:
                continue
            p, q = np.nonzero(small[i] @ small[j].T >= cosine - 1e-4)
            if i == j:
                p, q = p[p < q], q[p < q]
            for s in range(0, len(p), 65536):
                a, b = p[s : s + 65536], q[s : s + 65536]
                sure = np.einsum("ij,ij->i", blocks[i][5][a], blocks[j][5][b]) >= cosine
                a, b = a[sure] + at[i], b[sure] + at[j]
                np.add.at(links, a, mults[b])
                np.add.at(links, b, mults[a])
                parent = merge(parent, a, b)
    # a root that isn't the smallest id of its component is fine: edges only have to connect
    child = np.flatnonzero(parent != np.arange(len(parent)))
    linked = np.flatnonzero(links)
    return reps[linked], links[linked], ids[child], ids[parent[child]]


def near_vectors(embeddings: DataFrame, cosine: float = 0.95, leading: int = 16, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Links of vectors with cosine >= ``cosine``, in double precision: vec_id, n_links, component_id, kept.

    Equal vectors are one class before the join (grouped with partial sums), so a vector that a
    third of the rows share is compared once; other vectors are sorted by grid cells of side
    epsilon (the distance of unit vectors at that cosine) on the leading principal dimensions,
    intervals of the sequence are joined recursively by their boxes, and the surviving pairs of
    blocks are multiplied. A tile of two intervals returns a count per vector and a forest of
    links, not the pairs.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing;
    vectors of different lengths don't link. Rows that repeat an id are one vertex of the
    components, and vectors of their own in the counts. A row
    with a null id links with nothing, has no component and isn't kept. An empty table gives an
    empty result; other columns are not read.
    """
    if not 0 < cosine < 1:
        raise ValueError("cosine must lie between 0 and 1")
    eps = math.sqrt(2 - 2 * cosine)
    reach = eps * eps * (1 + 1e-9) + 1e-12
    numeric = "array<float>" if dict(embeddings.dtypes)[column] == "array<float>" else "array<double>"
    rows = embeddings.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast(numeric).alias("embedding"))
    sound = F.expr("coalesce(exists(embedding, x -> x <> 0) and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')), false)")
    rows = rows.withColumn("embedding", F.when(sound, F.col("embedding")))
    classes = rows.filter("embedding is not null and vec_id is not null").groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("mult"))
    classes = classes.withColumn("rep", F.monotonically_increasing_id())  # a number of the class's own, as ids may repeat
    spark = embeddings.sparkSession
    with scratch(spark):
        classes = stored(classes, "vector-classes")
        found = []
        for (dim,) in classes.select(F.size("embedding")).distinct().collect():
            vectors = classes.filter(F.size("embedding") == dim)
            blocks = ego_blocks(vectors, eps, min(leading, dim))
            pairs = interval_pairs(blocks, eps)
            tiles = pairs.withColumn("tile", F.struct("part_a", "sup_a", "part_b", "sup_b"))
            sides = F.array(F.struct(F.col("part_a").alias("p"), F.col("sup_a").alias("s"), F.lit(0).alias("side")), F.struct(F.col("part_b").alias("p"), F.col("sup_b").alias("s"), F.lit(1).alias("side")))
            needs = tiles.select("tile", F.explode(sides).alias("x")).select("tile", F.col("x.p").alias("part"), F.col("x.s").alias("sup"), F.col("x.side").alias("side"))
            needs = needs.filter("side = 0 or not (tile.part_a = tile.part_b and tile.sup_a = tile.sup_b)")
            placed = needs.join(blocks.withColumn("sup", F.floor(F.col("seq") / SUPER).cast("int")), ["part", "sup"])
            placed = placed.select(F.to_json("tile").alias("tile"), "side", "low", "high", "reps", "ids", "mults", "data")
            placed = placed.repartition("tile").sortWithinPartitions("tile", "side")

            def join(batches, dim=dim):
                import pyarrow as pa

                def solve(left, right):
                    reps, links, a, b = tile_links(left, right, cosine, reach)
                    n, k = len(reps), len(a)
                    nulls = lambda x, front, back: pa.array(np.concatenate([np.zeros(front, dtype=np.int64), x, np.zeros(back, dtype=np.int64)]), mask=np.concatenate([np.ones(front, bool), np.zeros(len(x), bool), np.ones(back, bool)]))
                    return pa.RecordBatch.from_arrays([nulls(reps, 0, k), nulls(links, 0, k), nulls(a, n, 0), nulls(b, n, 0)], ["rep", "links", "a", "b"])

                now, left, right = None, [], []
                for batch in batches:
                    for row in zip(*(batch.column(i).to_pylist() for i in range(8))):
                        if row[0] != now:
                            if now is not None:
                                yield solve(left, right or None)
                            now, left, right = row[0], [], []
                        block = (*(np.array(x) for x in row[2:7]), np.frombuffer(row[7]).reshape(-1, dim))
                        (right if row[1] else left).append(block)
                if now is not None:
                    yield solve(left, right or None)

            found.append(stored(placed.mapInArrow(join, "rep long, links long, a long, b long"), "vector-links"))
        links = spark.createDataFrame([], "rep long, links long, a long, b long")
        for f in found:
            links = links.union(f)
        named = classes.select(F.col("embedding").alias("same"), F.col("rep").alias("class"), "id")
        members = stored(rows.join(named, rows["embedding"] == named["same"], "left").select("vec_id", "class", F.coalesce("id", "vec_id").alias("vertex")), "vector-members", kept=True)
        # vectors that share an id make one vertex
        unlike = members.groupBy(F.col("vec_id").alias("again")).agg(F.min(F.coalesce("class", F.lit(-1))).alias("lo"), F.max(F.coalesce("class", F.lit(-1))).alias("hi")).filter("lo <> hi")
        joint = members.join(unlike, members["vec_id"] == unlike["again"]).select(F.col("vec_id").alias("a"), F.col("vertex").alias("b"))
        whole = stored(components(links.filter("a is not null").select("a", "b").union(joint)), "vector-components", kept=True)
        counts = links.filter("rep is not null").groupBy(F.col("rep").alias("of")).agg(F.sum("links").alias("links"))
        facts = classes.join(counts, F.col("rep") == F.col("of"), "left").select("rep", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
        facts = stored(facts, "vector-facts", kept=True)
    joined = members.join(facts, members["class"] == facts["rep"], "left").join(whole, members["vertex"] == whole["id"], "left")
    component = F.when(F.col("vec_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component", "vertex"))
    return joined.select(
        "vec_id",
        F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def op1_ego_join(spark, sf_dir: str) -> DataFrame:
    """Per vector: how many others have a cosine of 0.95 or more with it, and its component."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.95)


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e,
    coalesce(embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0, false) AS ok
  FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.ok AND b.ok AND list_cosine_similarity(a.e, b.e) >= 0.95),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
r(id, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.id = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
