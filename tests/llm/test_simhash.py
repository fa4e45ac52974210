import numpy as np
import xxhash

from learnmart.llm import simhash as S
from learnmart.llm.common import components, roots


def plain_fingerprint(text, words=3):
    parts = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        parts = parts.replace(c, " ")
    parts = [p for p in parts.split(" ") if p]
    grams = [" ".join(parts[i:i + words]) for i in range(len(parts) - words + 1)] or ([" ".join(parts)] if parts else [])
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    left, right = [], []
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                left.append(i)
                right.append(j)
    root = roots(len(rows), np.array(left, int), np.array(right, int))
    least = {}
    for (doc, _), r in zip(rows, root):
        if doc is not None:
            least[r] = min(doc, least.get(r, doc))
    return [(doc, f"{p:016x}", least.get(r)) for (doc, _), p, r in zip(rows, prints, root)]


def key(rows):
    return sorted(map(repr, rows))


def test_query_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in S.op8_simhash(spark, sf_dir).select("doc_id", "fingerprint", "component_id").collect()]
    assert key(got) == key(brute(rows))


def test_odd_rows(odd_docs, odd_rows):
    got = [(r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in S.near_duplicates(odd_docs).collect()]
    assert key(got) == key(brute([r[:2] for r in odd_rows]))
    kept = S.dedup(odd_docs).collect()
    groups = {c for _, _, c in brute([r[:2] for r in odd_rows])}
    assert len(kept) == len(groups) and all(r.fp == "mine" for r in kept)
    assert {r.doc_id for r in kept} == groups


def test_no_rows(no_docs):
    assert S.near_duplicates(no_docs).count() == 0 and S.dedup(no_docs).count() == 0


def test_tiles_lose_no_link(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False)) for b in base for n in (1, 2, 3, 4)]
    prints = sorted({*map(int, base), *near})
    df = spark.createDataFrame([(i, p - 2**64 if p >= 2**63 else p) for i, p in enumerate(prints)], "id long, fp long")
    a = np.array(prints, np.uint64)
    i, j = np.nonzero(np.bitwise_count(a[:, None] ^ a[None, :]) <= 3)
    want = roots(len(a), i, j)
    got = {r.fp & (2**64 - 1): r.component_id for r in S.classes(df).collect()}
    assert [got[p] for p in prints] == want.tolist()


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, k) for k in range(1001, 1200)] + [(5000, 5000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{k: 1000 for k in range(1000, 1200)}}
