"""Exact duplicates by content-defined chunk recipes, with built-in functions only.

A text is cut where its own content says so (at blanks between certain letters, between a least and a
largest size), so a passage that occurs in several texts is cut alike after its first cut.  Every chunk becomes an identifier, and texts are compared as ordered identifier lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from learnmart.llm.common import col, table, unused

LEAST_CHARS = 256
MOST_CHARS = 8192
# about one blank in fifty: rarer than LEAST_CHARS, so that cuts meet again soon after a difference
BOUNDARY = r"[lmnrst][aeiouy.!?]\s(?=[bcdpq])"


def chunks(text: Column, least: int = LEAST_CHARS, most: int = MOST_CHARS) -> Column:
    """The chunks of ``text`` in order; together they are the whole text.

    A chunk ends at the first boundary past ``least`` characters, after ``most``
    characters, or with the text.
    """
    pattern = rf"(?s).{{{least},{most - 3}}}?{BOUNDARY}|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def identifier(chunk: Column) -> Column:
    """SHA-256 of a chunk as 32 bytes."""
    return F.unhex(F.sha2(chunk, 256))


def with_recipe(docs: DataFrame, text: str, name: str, least: int, most: int) -> DataFrame:
    parts = chunks(F.coalesce(col(text), F.lit("")), least, most)
    return docs.withColumn(name, F.transform(parts, identifier))


def verify_identifiers(docs: DataFrame, text: str = "text", least: int = LEAST_CHARS, most: int = MOST_CHARS) -> None:
    """Raise if one identifier stands for two different chunks.

    Chunks are deduplicated by identifier (each task sends a chunk once, however
    often it occurs) and the smallest and largest content of each are compared.
    """
    parts = docs.select(F.explode(chunks(col(text), least, most)).alias("chunk"))
    kinds = parts.groupBy(identifier(F.col("chunk")).alias("id")).agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi"))
    if kinds.filter("lo <> hi").limit(1).count():
        raise ValueError("two different chunks have one identifier")


def report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST_CHARS,
           most: int = MOST_CHARS, verify: bool = True) -> DataFrame:
    """Every row of ``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Groups are texts with equal recipes; the largest id of a group stays.  A null
    text counts as empty, and all empty texts are one group (the empty recipe).
    A null id is smaller than any other; a group of null ids keeps null.  Rows
    that repeat id and text are all kept or all dropped here (``dedup`` leaves
    one).  Input columns named like a result are replaced, other columns stay.
    No rows give no rows.
    """
    if verify:
        verify_identifiers(docs, text, least, most)
    results = ("keep_id", "group_size", "kept", "text_sha256")
    extra = [c for c in docs.columns if c.lower() not in results]
    recipe, group, sha = unused(docs, "recipe", "group_recipe", "sha")
    rows = with_recipe(docs.select(*map(col, extra)), text, recipe, least, most)
    rows = rows.withColumn(sha, F.sha2(F.coalesce(col(text), F.lit("")), 256))  # before the join: the text need not move
    groups = rows.groupBy(col(recipe).alias(group)).agg(
        F.max(col(id_col)).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, col(recipe) == col(group)).select(
        *map(col, extra),
        F.col("keep_id"),
        F.col("group_size"),
        col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"),
        col(sha).alias("text_sha256"),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST_CHARS,
          most: int = MOST_CHARS, verify: bool = True) -> DataFrame:
    """The rows of ``docs`` with one of each group of equal texts: that with the largest id.

    Cases are as in ``report``; of rows with the same id and text one stays.
    Long texts move once: tasks hand on one row per recipe.
    """
    if verify:
        verify_identifiers(docs, text, least, most)
    recipe, row = unused(docs, "recipe", "row")
    whole = F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    best = with_recipe(docs, text, recipe, least, most).groupBy(col(recipe)).agg(
        F.max_by(whole, F.struct(col(id_col))).alias(row))
    return best.select(*[F.col(f"`{row}`.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of equal texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return report(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {"op9_exact_dedup": op9_exact_dedup}

SQL = {
    "op9_exact_dedup": """
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(coalesce(d.text, '')) AS text_sha256
        FROM documents d
        JOIN (SELECT coalesce(text, '') AS body, max(doc_id) AS keep_id, count(*) AS group_size
              FROM documents GROUP BY 1) g ON g.body = coalesce(d.text, '')
    """,
}
