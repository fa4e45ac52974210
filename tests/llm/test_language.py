import math
import zlib
from collections import Counter

import numpy as np

from learnmart.llm import language as L


def test_held_out_accuracy(spark, sf_dir):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = L.op10_language_id(spark, sf_dir).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    labelled = [r for r in held if truth[r.doc_id].lang and r.lang_pred != "und"]
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in labelled) >= 0.95 * len(labelled) > 0


def test_batch_scores_equal_plain_sums(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, "the house", "en"), (4, None, "fr"), (5, "der Hund", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    model = L.fit(df, F.col("doc_id").cast("string"), bits=10)
    assert model.languages == ["en", "fr"]
    counts = {k: Counter() for k in model.languages}
    for _, text, lang in rows[:3]:
        counts[lang].update(np.concatenate(list(L.buckets(text, 10))).tolist())
    for text in ("the chien", "é", "x" * 3000, "le dog " * 50):
        grams = np.concatenate(list(L.buckets(text, 10))).tolist()
        sums = [math.log({"en": 2, "fr": 1}[k] / 3) + sum(
            math.log((counts[k][g] + L.SMOOTHING) / (sum(counts[k].values()) + L.SMOOTHING * 1024)) for g in grams) for k in model.languages]
        best, score = L.score_texts([text], model)
        assert best[0] == int(np.argmax(sums))
        assert abs(score[0] - 1 / sum(math.exp(s - max(sums)) for s in sums)) < 1e-3


def test_blocks_do_not_change_the_ngrams():
    text = "Ein Satz über Straßen, 12 Häuser und mehr. " * 40
    whole = np.sort(np.concatenate(list(L.buckets(text))))
    assert np.array_equal(whole, np.sort(np.concatenate(list(L.buckets(text, block=101)))))


def test_odd_rows(odd_docs, odd_rows, no_docs):
    model = L.fit_documents(odd_docs)
    got = L.predict(odd_docs, model).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
        assert r.source is None or r.source in "abc"
    empty = L.fit_documents(no_docs)
    assert empty.languages == [] and L.predict(no_docs, empty).count() == 0
    assert {r.lang_pred for r in L.predict(odd_docs, empty).collect()} == {"und"}
