"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; ``run``
writes what a stage returns as Parquet in the shared folder and hands the reread
table to the next.  All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learnmart.llm import dedup_exact, language, mixing, packing, simhash
from learnmart.llm.common import col, cut, table, unused


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a text that has a letter; only those have a language.

    The model names a language for each of them, however unsure, so no clean
    text goes for being short.  Null, empty and letterless texts go; repeated
    rows and null ids stay as they are; extra columns are handed on, whatever
    their names.  Without any labelled row nothing is known and the letter alone
    decides.  No rows give none.
    """
    model = language.fit_documents(docs)
    lang, score = unused(docs, "lang_pred", "lang_score")
    judged = language.predict(docs, model, lang_name=lang, score_name=score)
    known = col(lang) != language.UNKNOWN if model.languages else col("text").rlike(r"\p{L}")
    return judged.filter(known).select(*map(col, docs.columns))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the largest id.

    A null text equals an empty one; a null id stays only where all ids of the
    group are null; of repeated rows one stays.  Extra columns are handed on, no
    rows give none.
    """
    return dedup_exact.dedup(docs).select(*map(col, docs.columns))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that with the smallest id.

    Texts without a word (null, empty, blank) have fingerprint zero and link like
    any other; a null id stays only where all ids of the component are null; of
    repeated rows one stays.  Extra columns are handed on, no rows give none.
    """
    return simhash.dedup(docs).select(*map(col, docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the sources come near their targets.

    A null source is a source of its own, the last; texts without a word have no
    size and are repeated or left out at the rate of their source; repeated rows
    draw alike.  Extra columns are handed on, no rows give none.
    """
    planned = mixing.plan_mix(docs, mixing.word_count(F.col("text")), mixing.draw(F.col("doc_id"), F.col("text")),
                              prefix="mix_")
    return mixing.emit(planned, docs.columns, "mix_copies")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences.

    A null or empty text is its end mark alone; repeated rows and null ids are
    documents of their own; extra columns are not looked at; no rows give none.
    """
    return packing.pack(docs)


STAGES = [
    ("language", language_stage),
    ("exact", exact_stage),
    ("simhash", simhash_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The learned model, the hashes and the packing are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
