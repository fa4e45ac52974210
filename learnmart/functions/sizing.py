"""Measured size checks behind every broadcast hint, and the way taken beyond them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

if TYPE_CHECKING:
    from learnmart.model import Tables

BROADCAST_BYTES = 64 * 1024 * 1024
ROW_OVERHEAD = 32
SCORE_ROW_BYTES = 128
SALTS = 64
HEAVY = 256  # a key with more than one in so many rows is joined in salted parts


def row_width(df: DataFrame):
    """Column with a row's approximate size in memory."""
    width = F.lit(ROW_OVERHEAD)
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            width = width + 16 + F.coalesce(F.octet_length(F.col(f.name)), F.lit(0))
        else:
            width = width + 16
    return width.cast("long")


def measured_bytes(df: DataFrame) -> int:
    return df.agg(F.sum(row_width(df)).alias("b")).first()["b"] or 0


@dataclass(frozen=True)
class CatalogueSize:
    outline_bytes: int
    score_bytes: int


def measure_catalogue(t: "Tables") -> CatalogueSize:
    """One small job over the outlines.

    A catalogue dimension is a projection or aggregate of one outline, so the
    largest outline bounds it.  Scores of a course run from 0 to its maximum,
    which bounds the (course, score) pairs.
    """
    frames = (t.lesson_outline, t.homework_outline, t.course_totals)
    sizes = [df.agg(F.sum(row_width(df)).alias("v")) for df in frames]
    scores = t.course_totals.agg((F.sum("max_possible_score") + F.count("*")).alias("v"))
    values = [r["v"] or 0 for r in reduce(DataFrame.unionAll, [*sizes, scores]).collect()]
    return CatalogueSize(
        outline_bytes=max(values[:3]),
        score_bytes=values[3] * SCORE_ROW_BYTES,
    )


def salted_join(big: DataFrame, many: DataFrame, on: str, salts: int = SALTS) -> DataFrame:
    """Inner join on a key that may be hot on both sides.

    The large side spreads each key over ``salts`` values, the other side is
    repeated once per value, so no task sees a whole hot key.
    """
    return _salted(big, many, on, F.lit(True), salts)


def _salted(big: DataFrame, many: DataFrame, on: str, hot: Column, salts: int) -> DataFrame:
    salt = F.when(hot, F.pmod(F.xxhash64(*big.columns), F.lit(salts))).otherwise(0).cast("int")
    copies = F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return big.withColumn("_salt", salt).join(many.withColumn("_salt", F.explode(copies)), [on, "_salt"]).drop("_salt")


def heavy_keys(df: DataFrame, on: str, most: int = HEAVY) -> list:
    """The keys that hold more than one in ``most`` of all rows: fewer than ``most``, from one count per key."""
    counts = df.groupBy(on).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("n")).first()["n"] or 0
    return [r[0] for r in counts.filter(F.col("_n") * most > total).select(on).collect()]


def skewed_join(big: DataFrame, many: DataFrame, on: str, salts: int = SALTS, most: int = HEAVY) -> DataFrame:
    """``salted_join`` of the heavy keys of ``big`` only; rows of all other keys are joined as they are.

    The other side is repeated for heavy keys alone, fewer than ``most`` of them.
    """
    heavy = heavy_keys(big, on, most)
    return _salted(big, many, on, F.col(on).isin(heavy) if heavy else F.lit(False), salts)
