import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from learnmart.llm import sharding as S


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2), (1, 3)])
def test_the_curve_visits_every_cell_in_unit_steps(spark, dims, bits):
    side = 1 << bits
    cells = [(F.floor(F.col("id") / side**k) % side).cast("int") for k in range(dims)]
    rows = spark.range(side**dims).select(F.array(*cells).alias("c"), S.hilbert_index(cells, bits).alias("h")).collect()
    rows.sort(key=lambda r: r.h)
    assert [r.h for r in rows] == list(range(side**dims))
    assert all(np.abs(np.subtract(a.c, b.c)).sum() == 1 for a, b in zip(rows, rows[1:]))


def test_query(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = S.op2_hilbert_shards(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    slots = defaultdict(list)
    for r in got:
        body = (docs[r.doc_id].text or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(body) + 16, zlib.crc32(body), "rows", None)
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[k]) for k in range(40)]
    assert max(counts) - min(counts) <= 1


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_runs_follow_the_curve(spark, law, odd_docs, odd_rows, no_docs):
    docs = odd_docs.withColumn("weight", F.coalesce(F.length("text"), F.lit(0)) + 16)
    got = S.assign_shards(docs, ["lang", "source", "n_chars"], ["doc_id"], 3, law, "weight").collect()
    assert len(got) == len(odd_rows) and all(r["row"] == "mine" for r in got)
    got.sort(key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in got] == sorted(r.curve for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert all([r.slot for r in rows] == list(range(len(rows))) for rows in by.values()) and set(by) <= {0, 1, 2}
    if law == "bytes":
        total, at = sum(r.weight for r in got), 0
        for r in got:
            assert r.shard == min(2, int((2 * at + r.weight) * 3 // (2 * total)))
            at += r.weight
    assert S.assign_shards(no_docs.withColumn("weight", F.lit(1)), ["lang", "source", "n_chars"], ["doc_id"], 3, law, "weight").count() == 0


def test_bytes_are_near_equal_and_ranges_prune(spark, tmp_path):
    rows = spark.range(20_000).select(
        F.col("id").alias("doc_id"), (F.xxhash64("id") % 1000).alias("x"), (F.xxhash64("id", F.lit(1)) % 1000).alias("y"), (F.col("id") % 50 + 16).alias("weight"))
    got = S.assign_shards(rows, ["x", "y"], ["doc_id"], 64, "bytes", "weight")
    shards = got.groupBy("shard").agg(F.sum("weight").alias("w"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).collect()
    sizes = [r.w for r in shards]
    assert len(sizes) == 64 and max(sizes) - min(sizes) <= 2 * 66
    touched = sum(r.x0 <= 100 and r.x1 >= 0 and r.y0 <= 100 and r.y1 >= 0 for r in shards)
    assert touched <= 16  # a quarter; by hash all 64 shards hold such rows
    S.write_shards(got, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20_000
