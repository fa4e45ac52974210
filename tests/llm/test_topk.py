import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from learnmart.llm import topk as K

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k=10, step=100):
    good = []
    for vec_id, vec in rows:
        if vec is not None and all(x is not None and math.isfinite(x) and math.isfinite(x * 1024) for x in vec):
            good.append((vec_id, [math.floor(1024 * x) for x in vec]))
    out = []
    for i, (q, a) in enumerate(good):
        if q is None or q % step:
            continue
        scored = [(max(-2**63, min(2**63 - 1, sum(x * y for x, y in zip(a, b)))), c) for j, (c, b) in enumerate(good) if j != i and len(b) == len(a)]
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(q, r + 1, c, score) for r, (score, c) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def got(df):
    return sorted([tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()], key=repr)


def asked(step=100):
    return F.col("vec_id") % step == 0


def test_query_equals_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = sorted(con.execute(f"SELECT query_id, rank, vec_id, score FROM ({K.SQL['op12_exact_topk']})").fetchall(), key=repr)
    assert got(K.op12_exact_topk(spark, sf_dir)) == want and want


@pytest.mark.parametrize("settings", [K.Settings(), K.Settings(pivots=8, group_queries=3, chunk_rows=50), K.Settings(pivots=200, group_queries=7, chunk_rows=64, k=3)])
def test_clusters_ties_and_lengths(spark, settings):
    rng = np.random.default_rng(3)
    centers = 4 * rng.normal(size=(12, 6))
    vecs = [(centers[i % 12] + 0.05 * rng.normal(size=6)).round(2 if i % 3 else 0).tolist() for i in range(600)]
    rows = [(i, v if i % 10 else v[:4]) for i, v in enumerate(vecs)] + [(1000 + i, vecs[0]) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(K.top_k(df, asked(20), settings=settings)) == brute(rows, settings.k, 20)


def test_bounds_leave_out_far_cells():
    points = np.array([[1000.0, 0.0], [0.0, 1000.0], [-1000.0, 0.0]])
    radius = np.array([10.0, 10.0, 10.0])
    near = [np.linspace(0, 10, 11)] * 3
    wants = K.needed(points, radius, np.array([5.0, -1.0, 5.0]), near, 10)
    assert wants.tolist() == [[True, False, False], [False] * 3, [False, False, True]]
    few = K.needed(points, radius, np.array([5.0, -1.0, 5.0]), [near[0][:3], near[1], near[2]], 10)
    assert few.tolist() == [[True, True, False], [False] * 3, [False, False, True]]  # too few rows beside the query: the next cell, too


def test_a_hot_query_cell_and_copies(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 400)] + [(1000 + i, [0.5, float(i % 7), -1.0]) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    s = K.Settings(pivots=10, group_queries=4, chunk_rows=64)
    assert got(K.top_k(df, asked(10), settings=s)) == brute(rows, 10, 10)


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(0, v), (100, [0.0, 0.0, 0.0]), (100, v), (100, v), (None, v), (None, [9.0, 9.0, 9.0]), (200, None), (300, []), (400, []), (1, [1.0, None, 2.0]),
            (2, [math.nan, 1.0, 1.0]), (500, [math.inf, 1.0, 1.0]), (600, [1.0]), (7, [-0.0005, -1.0, 0.9999]), (700, [1e17, -3e15, 2.0]), (8, [1e306, 0.0, 1.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("row", "rank", "score", "cell", "group", "query"):
        df = df.withColumn(name, F.lit("mine"))
    assert got(K.top_k(df, asked())) == brute(rows)
    assert K.top_k(df.limit(0), asked()).count() == 0
    assert got(K.top_k(df.filter("vec_id = 600"), asked())) == []  # nothing to compare with
