"""Every query of the engine against its SQL in DuckDB."""

import decimal
import math
import os

import duckdb
import pytest

from eventloom.operators import analyse
from eventloom.queries import QUERIES, SQL, rounded

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return float(v) if isinstance(v, decimal.Decimal) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events", "orders"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in SQL:
        assert got
        return
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=str)
    assert got == want


def test_deviations_of_many_values_equal_their_sql(spark, tmp_path):
    spark.range(30000).selectExpr(
        "id AS event_id", "timestamp_seconds(1700000000 + id * 60)::timestamp_ntz AS ts", "id % 400 AS user_id", "IF(pmod(hash(id), 3) = 0, 'view', 'click') AS event_type",
        "pmod(hash(id, 5), 1000000) / 100.0D AS value", "concat('{\"k\": ', pmod(hash(id, 6), 9), '}') AS props",
    ).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    df = QUERIES["deviation_both_kinds"](spark, str(tmp_path))
    want = c.execute(f"select {', '.join(df.columns)} from ({SQL['deviation_both_kinds']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


@pytest.mark.parametrize("ends", ["min", "max", "median"])
def test_medians_are_exact_wherever_their_parts_end(spark, monkeypatch, ends):
    df = spark.range(1001).selectExpr("id % 3 AS g", "IF(id % 3 = 2, 7.0D, pmod(hash(id), 500) / 4.0D) AS x")
    values = {}
    for g, x in df.collect():
        values.setdefault(g, []).append(x)
    monkeypatch.setattr(analyse.F, "percentile_approx", lambda c, q: analyse.F.array(*[getattr(analyse.F, ends)(c)] * 2))
    got = {r.g: (r.total, r.median) for r in analyse.medians(df, ["g"], analyse.F.col("x")).collect()}
    assert got == {g: (len(v), sorted(v)[(len(v) - 1) // 2]) for g, v in values.items()}


def test_scores_are_rounded_as_in_sql(spark):
    numbers = [(k + 2 * d + 1) / 2e6 for k in range(0, 9_000_000, 1_000_000) for d in range(60)]
    got = [r.x for r in spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double").coalesce(1).select("i", rounded("x", 6).alias("x")).orderBy("i").collect()]
    assert got == [duckdb.execute("select round(?::double, 6)", [x]).fetchone()[0] for x in numbers]
