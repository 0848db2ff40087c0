"""Near-duplicate documents by a multi-index Hamming join of MinHash signatures."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from eventloom.llm.common import fmix, id_filter, may_hold, ranges, scratch, span_hashes, stored, text_batches, unused
from eventloom.llm.components import components

#: Components of a signature, chunks they are split into, wrong components allowed in a chunk, bits kept of each.
COMPONENTS, CHUNKS, ERRORS, BITS = 25, 5, 2, 32
#: Signatures up to this distance meet in a chunk with at most ERRORS errors (pigeonhole).
DISTANCE = CHUNKS * (ERRORS + 1) - 1
_rng = np.random.Generator(np.random.PCG64(20240613))
_MUL = (_rng.integers(0, 1 << 63, COMPONENTS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, COMPONENTS, dtype=np.uint64)
#: What is left of each chunk when the allowed errors are struck out: every choice of components.
KEPT = [tuple(c * (COMPONENTS // CHUNKS) + k for k in keep) for c in range(CHUNKS) for keep in combinations(range(COMPONENTS // CHUNKS), COMPONENTS // CHUNKS - ERRORS)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def shingle_hashes(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct 64-bit shingle hashes of each text one after another, number of each).

    Words are runs of other than space and the controls 9 to 13, A-Z lowered. A text with fewer
    words than ``words`` has its whole sequence as the only shingle, one without words has none.
    """
    blobs = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = _LOWER[np.frombuffer(b"\n".join(blobs) + b"\n", dtype=np.uint8)]
    edge = np.concatenate([[0], np.cumsum([len(b) + 1 for b in blobs])])
    inside = ~_WHITE[raw]
    change = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, ends = change[::2], change[1::2]
    word = span_hashes(raw, starts, ends)
    at = np.searchsorted(starts, edge)
    n = np.diff(at)
    mul = [np.uint64((2 * k + 1) * 0x9FB21C651E98DF25 & (1 << 64) - 1) for k in range(words)]
    usable = max(0, len(word) - words + 1)
    mixed = np.zeros(usable, dtype=np.uint64)
    for k in range(words):
        mixed = fmix(mixed * np.uint64(31) + word[k : k + usable] * mul[k]) if usable else mixed
    out, count = [], np.zeros(len(texts), dtype=np.int64)
    for i, (a, k) in enumerate(zip(at[:-1].tolist(), n.tolist())):
        if k >= words:
            found = np.unique(mixed[a : a + k - words + 1])
        elif k:
            h = np.full(1, k, dtype=np.uint64)
            for w in word[a : a + k]:
                h = fmix(h * np.uint64(0x100000001B3) + w)
            found = h
        else:
            continue
        out.append(found)
        count[i] = len(found)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64), count


def signatures(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """MinHash signatures (rows of COMPONENTS values of BITS bits) of non-empty sets."""
    starts = np.cumsum(count) - count
    out = np.empty((len(count), COMPONENTS), dtype=np.uint64)
    for k in range(COMPONENTS):
        v = hashes * _MUL[k] + _ADD[k]
        v ^= v >> np.uint64(29)
        v *= np.uint64(0xBF58476D1CE4E5B9)
        out[:, k] = np.minimum.reduceat(v >> np.uint64(64 - BITS), starts)
    return out.astype(np.uint32)


def fingerprints(hashes: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that equal sets share."""
    starts = np.cumsum(count) - count
    return np.add.reduceat(fmix(hashes), starts), np.add.reduceat(fmix(hashes ^ np.uint64(0x5851F42D4C957F2D)), starts)


def keys_of(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per kept choice of components: documents share a key where all of these agree."""
    out = np.empty((len(signature), len(KEPT)), dtype=np.uint64)
    wide = signature.astype(np.uint64)
    for j, kept in enumerate(KEPT):
        h = np.full(len(signature), j + 1, dtype=np.uint64)
        for c in kept:
            h = fmix(h * np.uint64(0x9E3779B97F4A7C15) + wide[:, c])
        out[:, j] = h
    return out


def profile(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (fingerprint), signature (binary; null for an empty set) of every whole text."""

    def run(batches):
        import pyarrow as pa

        for keys, texts in text_batches(batches):
            hashes, count = shingle_hashes(texts, words)
            full = count > 0
            f1, f2 = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
            blobs = np.full(len(texts), None, dtype=object)
            if full.any():
                a, b = fingerprints(hashes, count[full])
                f1[full], f2[full] = a.view(np.int64), b.view(np.int64)
                blobs[full] = [s.tobytes() for s in signatures(hashes, count[full])]
            yield pa.RecordBatch.from_arrays([keys, pa.array(count), pa.array(f1), pa.array(f2), pa.array(blobs, pa.binary())], ["doc_id", "n_shingles", "f1", "f2", "signature"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, signature binary")


def with_keys(classes: DataFrame) -> DataFrame:
    """(key, c, doc) for each class and kept choice of components."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for s in range(0, batch.num_rows, 5000):
                part = batch.slice(s, 5000)
                sig = np.frombuffer(b"".join(part.column(2).to_pylist()), dtype=np.uint32).reshape(-1, COMPONENTS)
                keys = keys_of(sig)
                columns = [pa.array(keys.ravel().view(np.int64)), *[pa.array(np.repeat(part.column(k).to_numpy(), keys.shape[1])) for k in (0, 1)]]
                yield pa.RecordBatch.from_arrays(columns, ["key", "c", "doc"])

    return classes.select("c", "doc", "signature").mapInArrow(run, "key long, c long, doc long")


def sets_of(docs: DataFrame, classes: DataFrame, used: DataFrame, words: int) -> DataFrame:
    """(id, of, n, signature, shingles): class, smallest doc_id, size, signature and whole set of the classes whose doc_id is in ``used`` ("doc").

    The texts are read again, and only those that ``used`` may hold are cut into shingles again,
    since sets of all documents would take more room than the documents.
    """
    given = docs.sparkSession.sparkContext.broadcast(id_filter(used, "doc"))  # 8 MB

    def run(batches):
        import pyarrow as pa

        sought = given.value
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(sought, batch.column(0).to_numpy(zero_copy_only=False))))
            for keys, texts in text_batches([batch]):
                hashes, count = shingle_hashes(texts, words)
                full = count > 0
                if not full.any():
                    continue
                f1, f2 = fingerprints(hashes, count[full])
                offsets = pa.array(np.concatenate([[0], np.cumsum(count[full])]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([keys.filter(pa.array(full)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), lists], ["of", "g1", "g2", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    sets = rows.mapInArrow(run, "of long, g1 long, g2 long, shingles array<long>")
    sets = sets.groupBy("of", "g1", "g2").agg(F.first("shingles").alias("shingles"))  # rows that repeat
    sets = classes.join(sets, (F.col("doc") == F.col("of")) & (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")))
    return stored(sets.select(F.col("c").alias("id"), "of", F.col("n_shingles").alias("n"), "signature", "shingles"), "shingle-sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b), as doc_ids, of those pairs (first, c) of classes with 100 * |A & B| >= percent * |A | B| on the full sets."""
    left = sets.select(F.col("id").alias("a_id"), F.col("of").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("id").alias("b_id"), F.col("of").alias("b"), F.col("shingles").alias("right"))
    both = pairs.join(right, F.col("c") == F.col("b_id")).join(left, F.col("first") == F.col("a_id"))
    possible = F.expr(f"100L * least(size(left), size(right)) >= {int(percent)}L * greatest(size(left), size(right))")
    common = F.when(possible, F.size(F.array_intersect("left", "right"))).otherwise(0)
    both = both.withColumn("common", common)
    return both.filter(F.expr(f"100L * common >= {int(percent)}L * (size(left) + size(right) - common)")).select("a", "b")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Groups of near copies: doc_id, n_shingles, component_id, kept (one row per row of ``docs``).

    Documents are linked when the Jaccard similarity of their sets of distinct ``words``-word
    shingles is ``percent`` % or more, confirmed on the full sets; a component is what links reach
    and the smallest doc_id of each is kept. Candidates: a signature of COMPONENTS minimum
    hashes is split into CHUNKS; two signatures that differ in at most DISTANCE components have
    at most ERRORS errors in one chunk, so they share a key once each choice of ERRORS
    components of each chunk is struck out. At a similarity of 0.8, more than DISTANCE errors
    come with probability 1e-5 per pair.

    Equal sets are one class, with a number of its own. First, each class is compared with the
    first class of each of its buckets (found by partial minima, so a bucket of any size is
    split over tasks); then, where the classes that met one first class aren't in one component
    yet, all pairs of them from different components within DISTANCE, in tiles of bounded size
    that return only links that join something. Two classes of one bucket share its first class,
    so no pair is left out, and none is written out that links nothing.

    A null, empty or blank text has no shingles and links with nothing. A row with a null doc_id
    links with nothing and has a null component. Rows that repeat a doc_id are one document,
    linked with all that any of its texts links with. An empty table gives an empty result; other
    columns are not read.
    """
    with scratch(docs.sparkSession):
        facts = stored(profile(docs, words).withColumn("row", F.monotonically_increasing_id()), "profiles")
        labels, _ = grouped(docs, facts, words, percent)
        labels = stored(labels, "near-labels", kept=True)
    return labels.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def grouped(docs: DataFrame, facts: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, component_id) of every row of ``facts``, and the doc_ids that repeat: (again)."""
    full = facts.filter("doc_id is not null and signature is not null")
    classes = full.groupBy("f1", "f2", "n_shingles").agg(F.min("row").alias("c"), F.min("doc_id").alias("doc"), F.min("signature").alias("signature"))
    classes = stored(classes, "shingle-classes")
    keyed = with_keys(classes)
    firsts = keyed.groupBy("key").agg(F.min("c").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("bucket"), "first")
    stars = stored(keyed.join(firsts, keyed["key"] == firsts["bucket"]).select("first", "c", "doc").distinct(), "stars")
    sets = sets_of(docs, classes, stars, words)
    linked = stored(confirmed(stars.filter("first <> c"), sets, percent), "star-links")
    groups = components(linked).withColumnsRenamed({"id": "vertex", "component": "group"})
    held = stars.join(groups, stars["doc"] == groups["vertex"], "left").select("first", "c", F.coalesce("group", "doc").alias("group"))
    links = linked.union(cross_links(stored(held, "star-groups"), sets, percent))
    # texts of one doc_id in several classes, the empty set being one
    repeats = facts.filter("doc_id is not null").groupBy(F.col("doc_id").alias("again")).agg(F.count("*").alias("n"), F.min("f1").alias("lo"), F.max("f1").alias("hi")).filter("n > 1")
    repeats = stored(repeats.select("again", (F.col("lo") != F.col("hi")).alias("unlike")), "repeated-ids")
    named = classes.select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("n_shingles").alias("m"), "doc")
    same = (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n_shingles") == F.col("m"))
    unlike = full.join(repeats.filter("unlike"), full["doc_id"] == repeats["again"], "left_semi")
    joint = unlike.join(named, same).filter("doc_id <> doc").select(F.col("doc_id").alias("a"), F.col("doc").alias("b"))
    found = components(links.union(joint)).withColumnsRenamed({"id": "vertex", "component": "component_id"})
    member = facts.filter("doc_id is not null").join(named, same, "left").select("doc_id", "n_shingles", F.coalesce("doc", "doc_id").alias("doc"))
    member = member.join(found, member["doc"] == found["vertex"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc").alias("component_id"))
    nameless = facts.filter("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return member.union(nameless), repeats.select("again")


def cross_links(members: DataFrame, sets: DataFrame, percent: int, side: int = 256) -> DataFrame:
    """Links (a, b), as doc_ids, that connect what the links between different groups of one star connect.

    members: (first, c, group), a row per first class and class that met it. What the links have
    joined to the first class is the star's main group; it needs no comparison within itself.
    Main and other classes are cut by a hash into parts of about ``side``, and each pair of parts
    that aren't both main is a tile that holds the full sets: a star of n classes of which few
    are apart costs n times these few. A tile compares the classes of different groups whose
    signatures differ in at most DISTANCE components and returns a link only where it joins two
    groups, so it has fewer links than classes.
    """
    cells = members.groupBy("first", "group").agg(F.count("*").alias("n"), F.max(F.col("c") == F.col("first")).alias("is_main"))
    parts = lambda test: F.expr(f"cast(ceil(coalesce(sum(n) filter (where {test}), 0) / {side}) as int)")
    sizes = cells.groupBy(F.col("first").alias("star")).agg(parts("not is_main").alias("n_apart"), parts("is_main").alias("n_main"), F.expr("max(group) filter (where is_main)").alias("main"))
    sizes = stored(sizes.filter("n_apart > 0"), "star-sizes")
    rows = members.join(sizes, members["first"] == sizes["star"]).withColumn("apart", F.col("group") != F.col("main")).join(sets, F.col("c") == sets["id"])
    rows = rows.withColumn("part", F.expr("int(pmod(xxhash64(c, star), if(apart, n_apart, n_main)) + if(apart, 0, n_apart))"))
    tiles = rows.withColumn("other", F.explode(F.expr("sequence(0, n_apart + if(apart, n_main, 0) - 1)")))
    tiles = tiles.select("star", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "of", "group", "signature", "shingles")
    tiles = tiles.repartition("star", "x", "y").sortWithinPartitions("star", "x", "y")

    def run(batches):
        import pyarrow as pa

        def solve(x, y, rows):
            a, b = tile_links(x, y, rows, percent)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        now, held = None, []
        for batch in batches:
            keys = [batch.column(i).to_pylist() for i in range(7)]
            lists = batch.column(7)
            for k, row in enumerate(zip(*keys)):
                if row[:3] != now:
                    if held:
                        yield from solve(now[1], now[2], held)
                    now, held = row[:3], []
                held.append((*row[3:], np.array(lists[k].values.to_numpy(zero_copy_only=False))))
        if held:
            yield from solve(now[1], now[2], held)

    return stored(tiles.mapInArrow(run, "a long, b long"), "cross-links")


def tile_links(x: int, y: int, rows: list[tuple], percent: int) -> tuple[list[int], list[int]]:
    """Links of a tile; rows: (part, doc, group, signature, shingles). Pairs already joined are skipped."""
    part, doc = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    _, group = np.unique([r[2] for r in rows], return_inverse=True)
    sig = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.uint32).reshape(-1, COMPONENTS)
    size = np.array([len(r[4]) for r in rows])
    _, local, times = np.unique(np.concatenate([r[4] for r in rows]), return_inverse=True, return_counts=True)
    shared = times[local] > 1  # what a single set holds is in no intersection
    held = np.add.reduceat(shared, np.cumsum(size) - size, dtype=np.int64)
    local = local[shared]
    start = np.cumsum(held) - held
    mark = np.zeros(len(times), dtype=bool)
    left, right = np.flatnonzero(part == x), np.flatnonzero(part == y)
    a, b = [], []
    for i in left:
        others = right[(group[right] != group[i]) & (right > i if x == y else True)]
        others = others[(100 * np.minimum(held[others], held[i])) >= percent * np.maximum(size[others], size[i])]
        if not len(others):
            continue
        others = others[(sig[others] != sig[i]).sum(axis=1) <= DISTANCE]
        if not len(others):
            continue
        own = local[start[i] : start[i] + held[i]]
        mark[own] = True
        common = np.add.reduceat(mark[local[ranges(start[others], held[others])]], np.cumsum(held[others]) - held[others], dtype=np.int64)
        mark[own] = False
        for j in others[100 * common >= percent * (size[i] + size[others] - common)]:
            if group[j] != group[i]:
                a.append(int(doc[i]))
                b.append(int(doc[j]))
                group[group == group[j]] = group[i]
    return a, b


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document, the one with the smallest id, of each near-duplicate group; rows with null ids stay.

    Rows that repeat a doc_id are one document and stay or go together, but for rows with equal
    id and text, of which one stays.
    """
    spark = docs.sparkSession
    with scratch(spark):
        facts = stored(profile(docs, words).withColumn("row", F.monotonically_increasing_id()), "profiles")
        labels, repeats = grouped(docs, facts, words, percent)
        gone = labels.filter("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
        gone = stored(gone, "near-copies", kept=True)
        repeats = stored(repeats, "repeated-ids", kept=True)
        single = repeats.isEmpty()
    own = docs["doc_id"].cast("long")
    out = docs.join(gone, own == gone["gone"], "left_anti")
    if single:
        return out
    text = unused("text_key", docs)
    twice = docs.join(gone, own == gone["gone"], "left_anti").join(repeats, own == repeats["again"], "left_semi")
    twice = twice.withColumn(text, F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)).dropDuplicates(["doc_id", text]).drop(text)
    return out.join(repeats, own == repeats["again"], "left_anti").unionByName(twice)


def op7_minhash_multi_index(spark, sf_dir: str) -> DataFrame:
    """Per document: number of distinct 4-word shingles, its component of near copies, and whether it is kept."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, percent=80)


OP7_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS ws
  FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [ws] ELSE list_distinct([ws[i:i+3] FOR i IN range(1, len(ws) - 2)]) END) AS g
  FROM w),
h AS (SELECT DISTINCT doc_id, hash(g) AS g FROM s),
n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM h a JOIN h b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
