"""The declared table rules applied to rows on their way in.

``quality`` reports what stored rows break; here incoming rows get the first
rule they break as ``reject_reason``.  Values come first (required, enums,
lengths), then the caller's own rules, then row checks, references, and last
the keys, so a row that is refused anyway never takes a key from another.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learnmart.functions import sizing
from learnmart.model import Tables
from learnmart.operators.rules import first_reason
from learnmart.schemas import CATALOGUE, ENUMS, TABLES, Reference


def _row_reasons(name: str, have: set[str]) -> list[Column]:
    """First reasons that a row gives by itself: values, the caller's own rules, row checks."""
    table = TABLES[name]
    values: dict[str, Column] = {}
    for c in (c for c in table.names if c in have):
        if c in table.required:
            values[f"{c}_required"] = F.col(c).isNull()
        if c in table.enums:
            values[f"{c}_not_allowed"] = ~F.coalesce(F.col(c).isin(*ENUMS[table.enums[c]]), F.lit(True))
        if c in table.max_length:
            values[f"{c}_too_long"] = F.coalesce(F.length(c) > table.max_length[c], F.lit(False))
    checks = {}
    for rule, condition in table.checks.items():
        if {c for c in table.names if c in condition.replace("(", " ").split()} <= have:
            checks[rule] = ~F.coalesce(F.expr(condition), F.lit(True))
    earlier = F.col("reject_reason") if "reject_reason" in have else F.lit(None).cast("string")
    return [*([first_reason(**values)] if values else []), earlier, *([first_reason(**checks)] if checks else [])]


def _references(t: Tables, name: str, rows: DataFrame) -> list[Reference]:
    return [r for r in TABLES[name].references if r.column in rows.columns and r.parent in t.frames]


def _parents(t: Tables, ref: Reference, alias: str) -> DataFrame:
    return t.frames[ref.parent].select(F.col("id").alias(alias)).distinct()


def _small(t: Tables, ref: Reference) -> bool:
    ids = _parents(t, ref, "_parent")
    if ref.parent in CATALOGUE:
        return t.outline_small(ids)
    return ref.parent == "users" and t.measured_small("user_ids", ids)


def small_references(t: Tables, name: str, rows: DataFrame) -> int:
    """How many references, from the first on, have parents that are measured small enough to broadcast."""
    refs = _references(t, name, rows)
    return next((i for i, ref in enumerate(refs) if not _small(t, ref)), len(refs))


def judge_values(t: Tables, name: str, rows: DataFrame, references: int | None = None) -> DataFrame:
    """``rows`` (with ``reject_reason`` of earlier rules, if any) judged by everything but keys.

    Rules on columns that ``rows`` do not carry are skipped.  Given ``references``, only so many of them, with small parents, are judged.
    """
    reasons, known = _row_reasons(name, set(rows.columns)), {}
    for i, ref in enumerate(_references(t, name, rows)[:references]):
        parents = _parents(t, ref, f"_parent{i}")
        if references is not None or _small(t, ref):
            parents = F.broadcast(parents)
        rows = rows.join(parents, F.col(ref.column) == F.col(f"_parent{i}"), "left")
        known[f"{ref.column}_unknown"] = F.col(ref.column).isNotNull() & F.col(f"_parent{i}").isNull()
    if known:
        reasons.append(first_reason(**known))
    return rows.withColumn("reject_reason", F.coalesce(*reasons)).drop(*[f"_parent{i}" for i in range(len(known))])


def judge_references(t: Tables, name: str, rows: DataFrame, row: str, done: int) -> tuple[DataFrame, list[DataFrame]]:
    """Written ``rows`` whose references name parents, and frames with the ``reject_reason`` of the others.

    For references after the first ``done``, with parents too large to broadcast.  Parents are joined to the distinct
    ids that rows name.  The rows themselves are held against the unknown or the known ones of these ids, broadcast
    if either is measured small; else only the row numbers (``row``, unique) of refused rows are found by a join.
    """
    refused = []
    for ref in _references(t, name, rows)[done:]:
        value, reason = F.col(ref.column), F.lit(f"{ref.column}_unknown").alias("reject_reason")
        ids = rows.select(ref.column).filter(value.isNotNull()).distinct()
        ids = t.cut("named", ids.join(_parents(t, ref, "_parent"), value == F.col("_parent"), "left").select(
            value.alias("_named"), F.col("_parent").isNotNull().alias("_known")))
        unknown, known = ids.filter("not _known").drop("_known"), ids.filter("_known").drop("_known")
        size = sizing.measured_bytes(unknown)
        if not size:
            continue
        if size <= t.broadcast_bytes:
            marked, bad = rows.join(F.broadcast(unknown), value == F.col("_named"), "left"), F.col("_named").isNotNull()
        elif t.small(known):
            marked, bad = rows.join(F.broadcast(known), value == F.col("_named"), "left"), value.isNotNull() & F.col("_named").isNull()
        else:
            lost = t.cut("refused", rows.join(unknown, value == F.col("_named")).select(row))
            rows = rows.join(t.measured(lost), row, "left_anti")
            refused.append(lost.select(reason))
            continue
        refused.append(marked.filter(bad).select(reason))
        rows = marked.filter(~bad).drop("_named")
    return rows, refused


def judge_keys(t: Tables, name: str, rows: DataFrame, order: list[str], row: str) -> tuple[DataFrame, list[DataFrame]]:
    """Written ``rows`` that get their keys, and frames with the ``reject_reason`` of the others.

    A key is taken by a stored row, or by a row of the load that comes first by ``order``.
    ``row`` is a column unique to each row.  Every key is decided by its smallest
    (order, row), which combines on the map side however often a key repeats.
    Only keys that several rows or a stored row claim can refuse a row, so the
    rows are held against those alone, broadcast if measured small; else only
    the keys and numbers of the rows are joined, to find the numbers of those refused.
    """
    refused = []
    for key in TABLES[name].keys:
        if not set(key) <= set(rows.columns):
            continue
        reason = F.lit(f"{'_'.join(key)}_taken").alias("reject_reason")
        named = [F.col(c).cast("string").alias(f"_k{i}") for i, c in enumerate(key)]
        ks = [f"_k{i}" for i in range(len(key))]
        place = F.struct(*[c for c in order if c not in key], row)  # rows of a key do not differ in its own columns
        claims = rows.select(*named, place.alias("_place")).dropna(subset=ks).groupBy(*ks).agg(
            F.min("_place").alias("_first"), F.count("*").alias("_claims"))
        stored = t.frames[name].select(*named).dropna().distinct().withColumn("_stored", F.lit(True))
        contested = t.cut("contested", claims.join(stored, ks, "left").filter("_claims > 1 or _stored").select(
            *ks, F.col(f"_first.{row}").alias("_winner"), "_stored"))
        on = reduce(Column.__and__, [F.col(c).cast("string") == F.col(k) for c, k in zip(key, ks)])
        taken = F.col("_stored").isNotNull() | (F.col("_winner").isNotNull() & (F.col("_winner") != F.col(row)))
        size = sizing.measured_bytes(contested)
        if not size:
            continue
        if size <= t.broadcast_bytes:
            marked = rows.join(F.broadcast(contested), on, "left")
            refused.append(marked.filter(taken).select(reason))
            rows = marked.filter(~taken).drop(*ks, "_winner", "_stored")
        else:
            lost = t.cut("refused", rows.select(*key, row).join(contested, on).filter(taken).select(row))
            refused.append(lost.select(reason))
            rows = rows.join(t.measured(lost), row, "left_anti")
    return rows, refused
