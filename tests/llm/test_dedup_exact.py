import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from learnmart.llm import dedup_exact as D


def test_sql(against_sql):
    against_sql("op9_exact_dedup")


def test_report_of_odd_rows(odd_docs, odd_rows):
    groups = defaultdict(list)
    for r in odd_rows:
        groups[r[1] or ""].append(r[0])
    got = D.report(odd_docs).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        ids = groups[r.text or ""]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.doc_id == keep)
        assert r.text_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        assert r.recipe == "mine" and r["row"] == "mine"


def test_dedup_leaves_one_row_a_text(odd_docs, odd_rows):
    got = D.dedup(odd_docs).collect()
    assert sorted(r.text or "" for r in got) == sorted({r[1] or "" for r in odd_rows})
    assert all(r["size"] == "mine" for r in got)


def test_no_rows(no_docs):
    assert D.report(no_docs).count() == 0 and D.dedup(no_docs).count() == 0


def test_chunks_are_the_text_and_shared(spark, odd_docs):
    words = [w for r in odd_docs.collect() if r.text for w in r.text.split()][:20] + "some more plain tame pieces came down quite near".split()
    pick = random.Random(4)
    body = " ".join(pick.choice(words) for _ in range(6000))
    df = spark.createDataFrame([(body,), ("X. " * 700 + body,), ("",), ("\n\n.",), ("x" * 20000,)], "text string")
    rows = df.select("text", D.chunks(F.col("text")).alias("c")).collect()
    assert all("".join(r.c) == r.text for r in rows)
    assert all(len(c) <= D.MOST_CHARS for r in rows for c in r.c)
    assert set(rows[0].c[5:]) & set(rows[1].c)  # cuts depend on content, so moved passages share chunks


def test_two_contents_of_one_identifier_are_found(spark, monkeypatch):
    monkeypatch.setattr(D, "identifier", lambda c: F.length(c).cast("string").cast("binary"))
    df = spark.createDataFrame([(1, "abc"), (2, "abd")], "doc_id long, text string")
    with pytest.raises(ValueError):
        D.report(df)
