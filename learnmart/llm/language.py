"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from learnmart.llm.common import col, ship, table, unused

BITS = 15  # 2 ** 15 buckets
ORDERS = 3  # n-grams of 1 to 3 characters
SMOOTHING = 0.5
TRAIN_DOCS = 20_000  # labelled rows per language that a fit reads, in expectation
MOST_LANGUAGES = 512  # bound of the broadcast matrix: 512 * 2 ** 15 * 4 bytes = 64 MB
BLOCK = 1 << 19  # characters scored at a time
UNKNOWN = "und"

_MIX = np.uint32(2654435761)  # Knuth's multiplicative constant


def buckets(text: str, bits: int = BITS, block: int = BLOCK) -> Iterator[np.ndarray]:
    """Bucket numbers of the n-grams of a text, in blocks of bounded size.

    Letters are lower-cased; ASCII characters that are no letters count as one
    blank, so digits, signs and layout say nothing.
    """
    shift = np.uint32(32 - bits)
    for at in range(0, len(text), block):
        part = text[max(0, at - ORDERS + 1):at + block].lower()  # n-grams across the cut are counted with the later block
        c = np.frombuffer(part.encode("utf-32-le"), np.uint32)
        c = np.where((c < 97) | ((c > 122) & (c < 170)), np.uint32(32), c)
        skip = min(at, ORDERS - 1)
        h, out = c * _MIX, [(c[skip:] * _MIX + np.uint32(1)) >> shift]
        for n in range(2, ORDERS + 1):
            h = ((h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(2246822519) + c[n - 1:]) * _MIX
            out.append(h[max(0, skip - n + 1):] >> shift)
        yield np.concatenate(out)


@dataclass(frozen=True)
class Model:
    """Log probabilities by bucket and language, and log priors."""

    languages: list[str]
    log_prob: np.ndarray  # (2 ** bits, languages)
    log_prior: np.ndarray
    bits: int = BITS


def _counts(batches: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    """Bucket counts by language of one task: at most languages * 2 ** bits rows."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            total = held.setdefault(lang, np.zeros(1 << bits, np.int64))
            for b in buckets(text, bits):
                total += np.bincount(b, minlength=1 << bits)
    for lang, total in held.items():
        at = np.nonzero(total)[0]
        yield pd.DataFrame({"lang": lang, "bucket": at, "n": total[at]})


def fit(docs: DataFrame, key: Column, text: str = "text", lang: str = "lang", train_docs: int = TRAIN_DOCS,
        bits: int = BITS, smoothing: float = SMOOTHING) -> Model:
    """Learn from the labelled rows of ``docs`` (text and lang not null).

    Priors count all labelled rows.  n-grams are counted on a sample bounded by
    ``train_docs`` rows per language in expectation, drawn by the hash of
    ``key``; languages with fewer rows are read whole.  What comes to the driver
    is one number per language and bucket.
    """
    ship(docs.sparkSession)
    labelled = docs.select(col(lang).alias("lang"), col(text).alias("text"), key.alias("key")).filter(
        "lang is not null and text is not null")
    totals = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(totals) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not totals:
        return Model([], np.zeros((1 << bits, 0), np.float32), np.zeros(0), bits)
    share = F.create_map(*[x for k, n in totals.items() for x in (F.lit(k), F.lit(min(1.0, train_docs / n)))])
    draw = F.pmod(F.xxhash64("key", F.lit("train")), F.lit(1 << 32)) / float(1 << 32)
    sample = labelled.filter(draw < F.element_at(share, F.col("lang"))).select("lang", "text")
    counted = sample.mapInPandas(lambda it: _counts(it, bits), "lang string, bucket int, n long")
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(totals)
    seen = np.zeros((1 << bits, len(languages)))
    seen[rows["bucket"].to_numpy(int), rows["lang"].map({k: i for i, k in enumerate(languages)}).to_numpy(int)] = rows["n"]
    log_prob = np.log(seen + smoothing) - np.log((seen + smoothing).sum(0))
    prior = np.array([totals[k] for k in languages], float)
    return Model(languages, log_prob.astype(np.float32), np.log(prior / prior.sum()), bits)


def score_texts(texts, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Best language (its number) and posterior of each text.

    A batch is a sparse matrix of n-gram occurrences by row; its product with
    the log probabilities is a gather and a sum by row.
    """
    sums = np.zeros((len(texts), len(model.languages)))
    block = max(4096, 4 * BLOCK // len(model.languages))  # bounds the gathered block whatever the number of languages
    held, starts, rows, size = [], [], [], 0

    def flush() -> None:
        nonlocal held, starts, rows, size
        if held:
            parts = np.add.reduceat(model.log_prob[np.concatenate(held)], starts, axis=0, dtype=np.float64)
            np.add.at(sums, rows, parts)
        held, starts, rows, size = [], [], [], 0

    for i, text in enumerate(texts):
        for b in buckets(text, model.bits, block):
            if len(b):
                held.append(b)
                starts.append(size)
                rows.append(i)
                size += len(b)
            if size >= block:
                flush()
    flush()
    sums += model.log_prior
    best = sums.argmax(1)
    top = sums[np.arange(len(texts)), best][:, None]
    return best, 1.0 / np.exp(sums - top).sum(1)


def predict(docs: DataFrame, model: Model, text: str = "text", lang_name: str = "lang_pred",
            score_name: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its posterior probability.

    A text that is null or has no letter is ``und`` with score 1; so is every
    text if the model has learned no language, with score 0.  Only the text is
    looked at.  Columns named like a result are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    keep = [c for c in docs.columns if c.lower() not in (lang_name.lower(), score_name.lower())]
    sent = spark.sparkContext.broadcast(model)  # bounded: see MOST_LANGUAGES

    @F.pandas_udf("lang string, score double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = sent.value
        names = np.array(known.languages, object)
        for texts in batches:
            best, score = score_texts([t or "" for t in texts], known)
            yield pd.DataFrame({"lang": names[best], "score": score})

    spoken = F.coalesce(col(text).rlike(r"\p{L}"), F.lit(False))
    if not model.languages:
        return docs.select(*map(col, keep), F.lit(UNKNOWN).alias(lang_name),
                           F.when(spoken, 0.0).otherwise(1.0).alias(score_name))
    (guess,) = unused(docs, "guess")
    out = docs.select(*map(col, keep), scored(col(text)).alias(guess))
    return out.select(*map(col, keep),
                      F.when(spoken, F.col(f"`{guess}`.lang")).otherwise(UNKNOWN).alias(lang_name),
                      F.when(spoken, F.col(f"`{guess}`.score")).otherwise(1.0).alias(score_name))


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4 (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4


def fit_documents(docs: DataFrame) -> Model:
    """A model of the documents outside the held-out fold."""
    key = F.concat_ws("|", F.col("doc_id").cast("string"), F.length("text").cast("string"))
    return fit(docs.filter(remainder() != 2), key)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(docs.select("doc_id", "text"), fit_documents(docs))
    return found.select("doc_id", (remainder() == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op10_language_id": op10_language_id}
SQL: dict[str, str] = {}
