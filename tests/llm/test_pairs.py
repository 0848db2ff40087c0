"""Joins of vectors and of documents against brute force."""

import math
import random

import duckdb
import numpy as np
import pytest

from eventloom.llm import embed_ego, minhash
from eventloom.llm.components import components


def roots_of(n_or_ids, links):
    parent = {i: i for i in n_or_ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in parent}


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i + 1000, i + 1001) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 50)]
    df = spark.createDataFrame(edges + [(None, 3)], "a long, b long").repartition(7)
    got = dict(map(tuple, components(df).collect()))
    want = roots_of({v for e in edges for v in e}, edges)
    loops = {a for a, b in edges if a == b and sum(a in e for e in edges) == 1}
    assert got == {k: v for k, v in want.items() if k not in loops}


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 12))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i % 20] + rng.normal(scale=0.08, size=12)).tolist()) for i in range(150)]
    rows += [(300 + i, base[7].tolist()) for i in range(30)] + [(400, (base[7] * 3).tolist())]
    rows += [(500, None), (501, [0.0] * 12), (502, [math.nan] + [1.0] * 11), (503, [None] + [1.0] * 11), (504, []), (505, [math.inf] + [0.0] * 11), (506, base[3][:5].tolist()), (None, base[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as rep", "'x' as mult", "0 as label")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_ego.near_vectors(df, 0.95).collect()}
    ok = {i: np.array(v) for i, v in rows if i is not None and v and len(v) == 12 and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in ok.items()}
    links = [(a, b) for a in unit for b in unit if a < b and unit[a] @ unit[b] >= 0.95]
    root = roots_of([i for i, _ in rows if i is not None], links)
    number = {i: 0 for i in root}
    for a, b in links:
        number[a] += 1
        number[b] += 1
    assert got.pop(None) == (0, None, False)
    assert len(links) > 500
    assert got == {i: (number[i], root[i], i == root[i]) for i in root}


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embed_ego.near_vectors(df).collect() == []
    df = spark.createDataFrame([(None, [0.0]), (None, [1.0]), (3, None)], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, embed_ego.near_vectors(df).collect()), key=str) == [(3, 0, 3, True), (None, 0, None, False), (None, 0, None, False)]


def test_vectors_that_share_an_id(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (0, [-1.0, 0.0]), (5, [-1.0, -1.0]), (5, None)], "vec_id long, embedding array<double>").selectExpr("vec_id", "cast(embedding as array<decimal(20,10)>) as embedding")
    got = sorted(map(tuple, embed_ego.near_vectors(df, 0.9).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (0, 0, 0, True), (5, 0, 5, True), (5, 0, 5, True)], key=str)


def test_tree_of_intervals(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 6))
    x = np.concatenate([base, base[rng.integers(0, 40, 260)] + rng.normal(scale=0.1, size=(260, 6))])
    monkeypatch.setattr(embed_ego, "BLOCK", 8)
    monkeypatch.setattr(embed_ego, "SUPER", 2)
    monkeypatch.setattr(embed_ego, "FAN", 2)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_ego.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    root = roots_of(range(300), [(a, b) for a, b in zip(*np.nonzero(near)) if a < b])
    assert got == {i: (int(near[i].sum()) - 1, root[i]) for i in range(300)}


def shingles(text, n):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def near_copies():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 6)))
    text = lambda n: [word() for _ in range(n)]
    rows = [(i, " ".join(text(rng.randint(0, 60)))) for i in range(80)]
    for group, (size, length, edits) in enumerate([(60, 120, 4), (120, 150, 8), (40, 60, 1), (25, 30, 1)]):
        template = text(length)
        for k in range(size):
            copy = list(template)
            for _ in range(rng.randint(0, edits) if group != 1 else edits):
                copy[rng.randrange(length)] = word()
            rows.append((1000 * (group + 1) + k, " ".join(copy)))
    rows += [(9000 + i, "exactly the same words again and again") for i in range(50)] + [(9100, "Exactly THE same\twords again\nand again ")]
    rows += [(9200, None), (9201, ""), (9202, " \n"), (9203, "one two"), (9204, "ONE  two"), (9205, "one two three"), (9206, "É x"), (9207, "é x")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates(spark, n):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' as key", "1 as rep", "2 as first")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, n).collect()}
    sets = {i: shingles(t, n) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = roots_of(sets, links)
    assert len(links) > 1500
    assert got == {i: (len(s), root[i], root[i] == i) for i, s in sets.items()}


def test_near_duplicates_of_nothing_and_null_ids(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(df).collect() == []
    df = spark.createDataFrame([(None, "a b c d e f g"), (None, "a b c d e f g"), (3, "a b c d e f g"), (3, "a b c d e f g"), (5, "a b c d e f g")], "doc_id long, text string")
    got = sorted(map(tuple, minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 3, None, False)] * 2 + [(3, 3, 3, True)] * 2 + [(5, 3, 3, False)], key=str)
    kept = minhash.drop_near_duplicates(df).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["3", "None", "None"]


def test_a_doc_id_that_repeats_loses_no_link(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    a, b = [word() for _ in range(200)], [word() for _ in range(200)]
    changed = lambda t: " ".join([*t[:100], word(), *t[101:]])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, changed(a)), (3, changed(b)), (7, " ".join(word() for _ in range(50))), (7, None), (6, ""), (6, " ".join(a)), (9, "x y"), (9, "u v w"), (8, "X Y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()}
    assert {i: c for (i, _), (c, _) in got.items()} == {1: 1, 2: 1, 3: 1, 6: 1, 7: 7, 8: 8, 9: 8}
    assert got[6, 0] == (1, False) and got[7, 0] == (7, True)
    out = df.selectExpr("*", "1 as gone", "2 as again", "3 as text_key", "4 as component_id", "5 as row")
    kept = minhash.drop_near_duplicates(out)
    assert kept.columns == out.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted((i, t or "") for i, t in rows if i in (1, 7, 8))


def test_tiles_of_a_large_star(spark, monkeypatch):
    rng = random.Random(8)
    template = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(60)]
    rows = []
    for k in range(500):
        copy = list(template)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(60)] = "".join(rng.choices("abcdefgh", k=5))
        rows.append((k * 7 % 501, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = minhash.cross_links
    monkeypatch.setattr(minhash, "cross_links", lambda *a: whole(*a, side=32))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 4).collect()}
    sets = {i: shingles(t, 4) for i, t in rows}
    root = roots_of(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    assert len(set(root.values())) > 10 and got == root


def test_a_stored_table_goes_with_its_scratch(spark):
    from eventloom.llm.common import scratch, stored

    with scratch(spark):
        a, b = stored(spark.range(3)), stored(spark.range(4), kept=True)
        assert a.count() == 3
    assert b.count() == 4
    with pytest.raises(Exception):
        a.union(b).count()


def test_sql_of_the_queries(spark, tmp_path):
    rows = near_copies()
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(30, 8))
    vectors = np.concatenate([vectors, vectors[:20] + rng.normal(scale=0.05, size=(20, 8))]).astype(np.float32)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    for query, sql in ((minhash.op7_minhash_multi_index, minhash.OP7_SQL), (embed_ego.op1_ego_join, embed_ego.OP1_SQL)):
        got = query(spark, str(tmp_path))
        cur = con.execute(f"select {', '.join(got.columns)} from ({sql})")
        assert sorted(map(tuple, got.collect())) == sorted(cur.fetchall())
