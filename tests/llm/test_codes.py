import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from learnmart.llm import codes as C

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, s=C.Settings()):
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // s.parts
    part = lambda v, p: v[p * width:(p + 1) * width]
    books = [[part(v, p) for _, v, _ in kept[:s.entries]] for p in range(s.parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(s.rounds):
        for p, book in enumerate(books):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(part(v, p), book)[1], []).append(part(v, p))
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(book)]
    out, sums = [], {}
    for i, v, label in kept:
        found = [near(part(v, p), books[p]) for p in range(s.parts)]
        error = sum(d for d, _ in found)
        sums[label] = sums.get(label, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, label))
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted([(i, code, error, sums[label], digest) for i, code, error, label in out], key=repr)


def got(df):
    return sorted([tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()], key=repr)


def run(spark, tmp_path, df):
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    return C.op13_vector_codes(spark, str(tmp_path))


def test_query_equals_sql_and_brute_force(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    theirs = con.execute(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({C.SQL['op13_vector_codes']})").fetchall()
    mine = got(C.op13_vector_codes(spark, sf_dir))
    assert mine == sorted(theirs, key=repr)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert mine == brute(rows)


def test_ties_copies_and_unused_entries(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-2, 3, 32).astype(float).tolist(), i % 3 or None) for i in range(300)]
    rows += [(i % 5, rows[0][1], 1) for i in range(60)]  # equal ids and vectors, so equal entries
    assert got(run(spark, tmp_path, spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_odd_rows(spark, tmp_path):
    v = [x / 7 for x in range(16)]
    rows = [(3, v, 1), (1, [-x for x in v], 1), (1, [-x for x in v], 1), (None, v, None), (2, None, 1), (4, [], 1), (5, [None] * 16, 2),
            (6, [math.nan] * 16, 1), (7, [math.inf] * 16, 1), (8, [0.001] * 16, 2), (9, [-0.001] * 16, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("code", "entries", "error", "known", "vec", "part"):
        df = df.withColumn(name, F.lit("mine"))
    assert got(run(spark, tmp_path / "a", df)) == brute(rows)
    assert got(run(spark, tmp_path / "b", df.limit(0))) == []
    for bad in ([(1, v, 1), (2, v + v, 1)], [(1, v[:15], 1)], [(1, [1e30] * 16, 1)]):
        with pytest.raises(ValueError):
            C.compress(spark.createDataFrame(bad, SCHEMA))


def test_bounds_prune_and_stay_exact():
    rng = np.random.default_rng(5)
    book, points = rng.integers(-200, 200, (64, 4)), rng.integers(-200, 200, (5000, 4))
    pivots = C.choose_pivots(book[None], 4)[0]
    entry, exact, taken = C.nearest(points, np.sqrt(C.squares(points, pivots)), book, pivots)
    every = C.squares(points, book)
    assert (entry == every.argmin(1)).all() and (exact == every.min(1)).all()
    assert taken < 0.2 * every.size
