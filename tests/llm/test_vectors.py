import math
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from learnmart.llm import vectors as V
from learnmart.llm.common import roots

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.93):
    ids, units, labels = [], [], []
    for vec_id, vec, label in rows:
        v = np.array([np.nan if x is None else x for x in vec] if vec else [np.nan], float)
        ok = label is not None and np.isfinite(v).all() and np.linalg.norm(v) > 0
        ids.append(vec_id)
        units.append(v / np.linalg.norm(v / abs(v).max()) / abs(v).max() if ok else None)
        labels.append((label, len(v)) if ok else None)
    n = len(rows)
    links = [(i, j) for i in range(n) for j in range(n)
             if i != j and labels[i] is not None and labels[i] == labels[j] and units[i] @ units[j] >= threshold]
    root = roots(n, np.array([i for i, _ in links], int), np.array([j for _, j in links], int))
    count = np.bincount(np.array([i for i, _ in links], int), minlength=n)
    least = {}
    for i, r in zip(ids, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [(i, int(c), least.get(r), i == least.get(r)) for i, c, r in zip(ids, count, root)]


def rows_of(df):
    return sorted([tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()], key=repr)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got, want = rows_of(V.op5_vector_dedup(spark, sf_dir)), sorted(brute(rows), key=repr)
    assert got == want


def test_many_cells_and_blocks(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(500, 32))
    near = base[rng.integers(0, 40, 400)] + 0.02 * rng.normal(size=(400, 32))
    rows = [(i, v.astype(np.float32).tolist(), i % 2) for i, v in enumerate(np.concatenate([base, near, base[:30], base[:30]]))]
    df = spark.createDataFrame(rows, SCHEMA)
    s = V.Settings(cell_rows=120, block_rows=100, graph_rows=80, audit_rows=2_000)
    assert rows_of(V.near_duplicates(df, settings=s)) == sorted(brute(rows), key=repr)


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, 1), (2, v, 1), (3, [2.0, 4.0, 6.0], 1), (4, v, 2), (5, v, None), (6, None, 1), (7, [], 1), (8, [0.0, 0.0, 0.0], 1),
            (9, [1.0, None, 3.0], 1), (10, [1.0, math.nan, 3.0], 1), (11, [math.inf, 1.0, 1.0], 1), (12, [1e38, 2e38, 3e38], 1), (13, [1e-38, 2e-38, 3e-38], 1),
            (None, [-1.0, 5.0, 0.0], 1), (14, [3.0, 0.0, -1.0], 1), (15, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("x")).withColumn("rep", F.lit("y"))
    got = rows_of(V.near_duplicates(df))
    want = [(i, c, k, m if i is not None else True) for i, c, k, m in brute(rows)]
    assert got == sorted(want, key=repr)
    assert V.near_duplicates(df.limit(0)).count() == 0


def test_audit_measures_what_is_missing(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "3:1", (b := rng.normal(size=3) * 0.01 + np.array([1.0, 0, 0])) / np.linalg.norm(b), 1) for i in range(20)]
    reps = spark.createDataFrame([(i, 1, label, v.tolist()) for i, label, v, _ in rows], "rep long, n long, label string, vec array<double>")
    full = spark.createDataFrame([(i, 19, 0) for i in range(20)], "rep long, found long, least long")
    half = spark.createDataFrame([(i, 19 * (i % 2), 0) for i in range(20)], "rep long, found long, least long")
    assert V.audit(reps, full, V.Settings()) == 1.0 and 0.3 < V.audit(reps, half, V.Settings()) < 0.7


def near_group(rng, rows, dims=64, spread=0.015):
    """Different vectors that are near copies of one another: every cosine is above the threshold."""
    return rng.normal(size=dims) / np.sqrt(dims) + spread * rng.normal(size=(rows, dims)) / np.sqrt(dims / 64)


def test_a_near_copy_group_larger_than_any_block_keeps_all_links(spark):
    rng = np.random.default_rng(5)
    group, rest = near_group(rng, 5_000), rng.normal(size=(1_000, 64))
    sims = (u := group / np.linalg.norm(group, axis=1, keepdims=True)) @ u[:200].T
    assert sims.min() > 0.935  # clear of the threshold, so every member links with every other
    df = spark.createDataFrame([(i, v.astype(np.float32).tolist(), 1) for i, v in enumerate(np.concatenate([group, rest]))], SCHEMA)
    by_id = {r[0]: r for r in rows_of(V.near_duplicates(df))}
    assert all(by_id[i] == (i, 4_999, 0, i == 0) for i in range(5_000))
    assert all(by_id[i] == (i, 0, i, True) for i in range(5_000, 6_000))


def test_twenty_thousand_near_copies_in_many_blocks(spark):
    rng = np.random.default_rng(8)
    group, rest = near_group(rng, 20_000), rng.normal(size=(500, 64))
    df = spark.createDataFrame([(i, v.astype(np.float32).tolist(), 1) for i, v in enumerate(np.concatenate([group, rest]))], SCHEMA)
    out = V.near_duplicates(df).groupBy("n_links", "component_id", "kept").count().collect()
    assert {tuple(r) for r in out if r.n_links} == {(19_999, 0, True, 1), (19_999, 0, False, 19_999)}
    assert sum(r["count"] for r in out if not r.n_links and r.kept) == 500


def test_a_loose_group_at_the_threshold(spark):
    rng = np.random.default_rng(9)
    group, rest = near_group(rng, 1_500, spread=0.034), rng.normal(size=(500, 64))  # only a part of its pairs link
    rows = [(i, v.astype(np.float32).tolist(), 1) for i, v in enumerate(np.concatenate([group, rest]))]
    s = V.Settings(cell_rows=300, block_rows=200, graph_rows=400, audit_rows=2_000)
    got, want = rows_of(V.near_duplicates(spark.createDataFrame(rows, SCHEMA), settings=s)), sorted(brute(rows), key=repr)
    found, true = sum(r[1] for r in got), sum(r[1] for r in want)
    assert 0.2 * 1_500 ** 2 < true < 0.9 * 1_500 ** 2 and 0.98 * true <= found <= true


def test_leaders_gather_what_links():
    rng = np.random.default_rng(10)
    vecs = np.concatenate([near_group(rng, 50), rng.normal(size=(20, 64))])
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    block = pd.DataFrame({"rep": np.arange(70) * 3, "n": 1, "label": "a", "home": "b", "vec": list(vecs)})
    out = V.lead(block, V.Settings())
    assert out["leader"][:50].nunique() == 1 and (out["leader"][50:] == out["rep"][50:]).all()
    assert (out["found"][:50] == 49).all() and (out["found"][50:] == 0).all() and (out["radius"] > 0).sum() == 1


def test_search_reaches_all_parts_of_a_graph():
    rng = np.random.default_rng(12)
    groups = [near_group(rng, n) for n in (110, 120, 60)]  # no list of a tight group leaves it
    vecs = np.concatenate([*groups, rng.normal(size=(700, 64))])
    vecs = (vecs / np.linalg.norm(vecs, axis=1, keepdims=True)).astype(np.float32)
    block = pd.DataFrame({"rep": np.arange(len(vecs)) + 1000, "vec": list(vecs), "home": [str(i % 2) for i in range(len(vecs))], "radius": 0.0})
    graph = V.build_graph(block, V.Settings())
    assert graph["nbrs"].map(len).min() > 0
    nodes = block.merge(graph, on="rep")
    wanted = np.arccos(0.93)
    lists = [np.array(x) - 1000 for x in graph["nbrs"]]
    nbrs = np.full((len(vecs), max(map(len, lists))), len(vecs))
    for i, x in enumerate(lists):
        nbrs[i, :len(x)] = x
    starts = V.medoids(vecs, nbrs)
    q, x = V.range_search(vecs, np.full(len(vecs), wanted), vecs, np.zeros(len(vecs)), nbrs, starts, np.full(len(vecs), -1), replace(V.Settings(), beam=64, step=8))
    true = np.argwhere(vecs @ vecs.T >= 0.93)
    assert len(set(map(tuple, true)) - set(zip(q, x))) < 0.01 * len(true)  # from medoids alone
    found = V.search(nodes, nodes, replace(V.Settings(), beam=4))
    links = {(a + 1000, str(b % 2)) for a, b in true if a % 2 != b % 2}
    assert set(map(tuple, found[["leader", "other"]].to_numpy())) >= links


def test_tight_groups_beside_a_large_one_are_all_found(spark):
    rng = np.random.default_rng(6)
    labels, groups = (1, 1, 2, 3, 3), [near_group(rng, n) for n in (110, 110, 900, 1_000, 120)]
    rows, want = [], []
    for label, group in zip(labels, groups):
        first = len(rows)
        rows += [(first + k, v.astype(np.float32).tolist(), label) for k, v in enumerate(group)]
        want += [(first + k, len(group) - 1, first, k == 0) for k in range(len(group))]
    got = rows_of(V.near_duplicates(spark.createDataFrame(rows, SCHEMA), settings=V.Settings(cell_rows=1_200)))
    assert got == sorted(want, key=repr)


def test_audit_sees_small_groups_beside_a_large_one(spark):
    rng = np.random.default_rng(7)
    reps, right = [], []
    for g, n in enumerate((300, 20)):
        for v in near_group(rng, n):
            right.append((len(reps), n - 1, 0))
            reps.append((len(reps), 1, "64:1", (v / np.linalg.norm(v)).tolist()))
    reps = spark.createDataFrame(reps, "rep long, n long, label string, vec array<double>")
    counts = lambda rows: spark.createDataFrame(rows, "rep long, found long, least long")
    s = V.Settings(audit_rows=1_000)
    assert V.audit(reps, counts(right), s) == 1.0
    assert V.audit(reps, counts(right[:300]), s) < s.recall  # all links of the small group are missing
    assert V.audit(reps, counts([(r, 2 * n, 0) for r, n, _ in right]), s) < s.recall  # links that are none
