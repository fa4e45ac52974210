"""Queries of the operators and the SQL that some are checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from learnmart.llm import chat, codes, dedup_exact, language, merkle, mixing, packing, secrets, sharding, simhash, topk, vectors, warc

MODULES = (chat, sharding, secrets, packing, vectors, mixing, warc, simhash, dedup_exact, language, merkle, topk, codes)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def statements() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
