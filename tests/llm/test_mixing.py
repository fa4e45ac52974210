import pytest
from pyspark.sql import functions as F

from learnmart.llm import mixing as M


def test_sql(against_sql):
    against_sql("op6_mixing")


def plain_targets(sizes):
    """Share by weight, cap, share the excess again, until none is above."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + ([None] if None in sizes else [])
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[n] for n in open_)
        over = {n for n in open_ if level * weight[n] > 2 * sizes[n]}
        if not over:
            target |= {n: level * weight[n] for n in open_}
            break
        for n in over:
            target[n] = 2.0 * sizes[n]
            left -= target[n]
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, "c": 3, "d": 40, None: 7}, {"a": 0, "b": 0}, {"b": 0, "a": 5, "é": 5}, {"x": 9},
    {f"s{i}": (i * 37) % 101 for i in range(30)},
])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r for r in M.rates(df).collect()}
    for name, want in plain_targets(sizes).items():
        assert got[name].target == pytest.approx(want)
        assert 0 <= got[name].rate <= 2


def test_odd_rows_and_emission(odd_docs, odd_rows, no_docs):
    planned = M.plan_mix(odd_docs, M.word_count(F.col("text")), M.draw(F.col("doc_id"), F.col("text")), prefix="mix_")
    rows = planned.collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        words = len((r.text or "").encode().split())
        assert r.mix_size == words and r["size"] == "mine" and r.mix_copies <= 2
        assert r.mix_copies in (int(r.mix_rate), int(r.mix_rate) + 1)
    sent = M.emit(planned, odd_docs.columns, "mix_copies")
    assert sent.count() == sum(r.mix_copies for r in rows) and sent.columns == odd_docs.columns
    again = M.emit(planned, odd_docs.columns, "mix_copies").collect()
    assert sorted(map(repr, again)) == sorted(map(repr, sent.collect()))
    assert M.plan_mix(no_docs, M.word_count(F.col("text")), M.draw(F.col("doc_id"), F.col("text"))).count() == 0


def test_taken_words_come_near_the_targets(spark):
    docs = spark.range(60_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("source"),
        F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"))
    planned = M.plan_mix(docs, M.word_count(F.col("text")), M.draw(F.col("doc_id"), F.col("text")))
    for r in planned.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect():
        assert r.taken == pytest.approx(r.target, rel=0.03)
