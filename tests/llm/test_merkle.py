import hashlib
import zlib
from itertools import groupby

from pyspark.sql import functions as F

from learnmart.llm import merkle as M


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    parts = ["-" if x is None else f"{len(str(x).encode())}:{x}" for x in row]
    return h(*parts)


def lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def root_and_ways(digests):
    """Root of a run of digests and, for each, its siblings and places level by level."""
    ways, level, members = [[] for _ in digests], list(digests), [[i] for i in range(len(digests))]
    while len(level) > 1:
        above, below = [], []
        for at in range(0, len(level), 8):
            run = level[at:at + 8]
            for k in range(len(run)):
                for i in members[at + k]:
                    ways[i].append((run[:k], run[k + 1:]))
            above.append(h(*run))
            below.append([i for m in members[at:at + 8] for i in m])
        level, members = above, below
    return level[0], ways


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    null_first = lambda x: (x is not None, x if x is not None else 0)
    key = lambda r: (r[2] is not None, (r[2] or "").encode())
    rows = sorted(rows, key=lambda r: (key(r), null_first(r[0]), leaf_of(r)))
    trees = [list(g) for _, g in groupby(rows, key)]
    inner = [root_and_ways([leaf_of(r) for r in tree]) for tree in trees]
    root, top_ways = root_and_ways([subroot for subroot, _ in inner])
    out = []
    for tree, (subroot, ways), top in zip(trees, inner, top_ways):
        for row, way in zip(tree, ways):
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            folded, siblings = leaf_of((*row[:4], lower(row[4])) if hit else row), []
            for before, behind in way + top:
                folded = h(*before, folded, *behind)
                siblings += before + behind
            out.append((row[0], leaf_of(row), subroot, root, h(*siblings), folded, folded == root))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def got(df):
    return sorted([tuple(r) for r in df.select(COLUMNS).collect()], key=repr)


def taken(df):
    return [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def test_query_equals_sql(against_sql):
    against_sql("op11_merkle_manifest")


def test_odd_rows(odd_docs, no_docs):
    assert got(M.verify_documents(odd_docs)) == brute(taken(odd_docs))
    clashing = odd_docs.withColumn("at", F.lit(1)).withColumn("leaf", F.lit("x")).withColumn("tree", F.lit("y"))
    assert got(M.verify_documents(clashing)) == brute(taken(odd_docs))
    assert got(M.verify_documents(odd_docs.limit(1))) == brute(taken(odd_docs.limit(1)))  # a lone leaf is the root
    assert M.verify_documents(no_docs).columns == COLUMNS and M.verify_documents(no_docs).count() == 0


def test_many_groups_and_a_hot_one(spark):
    rows = [(i, "s", f"l{i % 75:02d}" if i % 3 else "hot", i, f"Text {i}") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    want = brute(rows)
    assert got(M.verify_documents(df)) == want  # two levels over the roots
    assert 0 < sum(not r[6] for r in want) < 1500


def test_climb_by_exchange_equals_broadcast(spark):
    rows = [(i, "s", "a" if i % 4 else "b", i, f"Text {i}") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    manifest = M.build(df, M.FIELDS, "lang", "doc_id")
    rows_of = lambda bytes_: sorted(map(repr, (tuple(r) for r in M.proofs(manifest, bytes_).collect())))
    some = M.NODE_BYTES * (manifest.sizes[max(manifest.sizes)] + manifest.sizes[max(manifest.sizes) - 1])
    assert rows_of(0) == rows_of(some) == rows_of(M.UPPER_BYTES)
    assert all(r.verified for r in M.proofs(manifest).collect())


def test_session_setting_is_put_back(spark, odd_docs):
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key, None)
    M.verify_documents(odd_docs)
    assert spark.conf.get(key, None) == before
