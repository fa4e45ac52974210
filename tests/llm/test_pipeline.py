import hashlib
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from learnmart.llm import simhash
from test_packing import check
from test_simhash import brute


def rows(df):
    return Counter(map(repr, df.collect()))


def test_stages_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language"](spark, docs, sf_dir)
    assert known.columns == docs.columns
    assert rows(known) == Counter(repr(r) for r in docs.collect() if any(c.isalpha() for c in r.text or ""))
    exact = stages["exact"](spark, known, sf_dir).cache()
    keep = {}
    for r in known.collect():
        k = hashlib.sha256(r.text.encode()).digest()
        keep[k] = max(keep.get(k, r), r, key=lambda x: x.doc_id)
    assert rows(exact) == Counter(map(repr, keep.values()))
    near = stages["simhash"](spark, exact, sf_dir).cache()
    ids = {c for _, _, c in brute([(r.doc_id, r.text) for r in exact.collect()])}
    assert rows(near) == Counter(repr(r) for r in exact.collect() if r.doc_id in ids)
    mixed = stages["mixing"](spark, near, sf_dir).cache()
    copies = Counter(r.doc_id for r in mixed.collect())
    assert set(copies) <= ids and max(copies.values()) <= 2 and mixed.columns == docs.columns
    packed = stages["packing"](spark, mixed, sf_dir)
    assert check(packed.collect(), [(r.doc_id, r.text) for r in mixed.collect()]) < 1.05


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)


def texts(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_odd_and_empty_tables(spark, odd_docs, no_docs, tmp_path):
    """Every stage, on its own, keeps just the rows that its definition keeps."""
    stages, at = dict(corpus_pipeline.STAGES), str(tmp_path)
    docs = odd_docs.collect()
    lettered = [r for r in docs if any(c.isalpha() for c in r.text or "")]
    known = stages["language"](spark, odd_docs, at)
    assert rows(known) == Counter(map(repr, lettered)) and known.columns == odd_docs.columns
    short = odd_docs.limit(1).withColumn("text", F.lit("si")).union(odd_docs)
    assert "si" in {r.text for r in stages["language"](spark, short, at).collect()}
    groups = {}
    for r in docs:
        groups.setdefault(r.text or "", []).append(r)
    exact = stages["exact"](spark, odd_docs, at)
    assert exact.columns == odd_docs.columns
    largest = {text: max((r.doc_id for r in g if r.doc_id is not None), default=None) for text, g in groups.items()}
    assert Counter((r.doc_id, r.text or "") for r in exact.collect()) == Counter((i, text) for text, i in largest.items())
    near = stages["simhash"](spark, odd_docs, at)
    assert near.columns == odd_docs.columns
    component = {(i, fp): c for i, fp, c in brute([(r.doc_id, r.text) for r in docs])}
    kept = near.collect()
    assert Counter(r.doc_id for r in kept if r.doc_id is not None) == Counter({c for c in component.values() if c is not None})
    mixed = stages["mixing"](spark, odd_docs, at)
    assert mixed.columns == odd_docs.columns and set(texts(mixed)) <= set(texts(odd_docs)) and max(texts(mixed).values()) <= 4  # two repeated rows, two copies each
    assert check(stages["packing"](spark, odd_docs, at).collect(), [(r.doc_id, r.text) for r in docs]) >= 1
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, at).count() == 0
        if name != "mixing":
            nothing = stage(spark, odd_docs.filter("text is null"), at).count()
            assert nothing == {"language": 0, "exact": 1, "simhash": 1, "packing": 2}[name]


def test_repeated_rows_leave_one(spark, odd_docs):
    twice = odd_docs.filter("doc_id in (1, 9)").union(odd_docs.filter("doc_id = 9"))
    got = simhash.dedup(twice)
    assert sorted(r.doc_id for r in got.collect()) == [1, 9] and got.columns == odd_docs.columns
