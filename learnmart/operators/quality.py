"""Violation reports for the declared table rules.

One scan per table for the row rules; keys and references are counted per
value, which combines on the map side however often a value repeats.
Rules on columns a frame does not carry are skipped.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learnmart.functions import sizing
from learnmart.model import Tables
from learnmart.operators.jobs import Change
from learnmart.schemas import CATALOGUE, ENUMS, TABLES, Table

KEY_SEPARATOR = "~"


def _tables(t: Tables, names: list[str] | None) -> list[Table]:
    return [TABLES[n] for n in (names or TABLES) if n in t.frames]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def _text_key(columns) -> Column:
    return F.concat_ws(KEY_SEPARATOR, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def unique_violations(t: Tables, names: list[str] | None = None) -> DataFrame:
    """Keys held by more than one row; keys with a NULL part never collide.

    Two passes.  The first counts 64-bit hashes of all keys of all tables, two
    numbers a row that combine on the map side.  The second writes out only keys
    of rules with a hash that came up twice and counts them exactly; if these
    hashes are measured small, only keys that have one of them.
    """
    rules: list[tuple[str, str]] = []
    scans = []
    for table in _tables(t, names):
        df = t.frames[table.name]
        keys = []
        for key in table.keys:
            if set(key) <= set(df.columns):
                complete = reduce(Column.__and__, [F.col(c).isNotNull() for c in key])
                values = F.array(*[F.col(c).cast("string") for c in key])
                keys.append((len(rules), complete, F.xxhash64(*[F.col(c) for c in key]), values))
                rules.append((table.name, ",".join(key)))
        if keys:
            scans.append((df, keys))

    def rows(texts: bool, wanted: set[int]) -> DataFrame:
        parts = []
        for df, keys in scans:
            fields = [
                F.when(complete, F.struct(F.lit(no).alias("rule"), digest.alias("hash"), *([values.alias("key")] if texts else [])))
                for no, complete, digest, values in keys if no in wanted
            ]
            if fields:
                parts.append(df.select(F.explode(F.array_compact(F.array(*fields))).alias("k")).select("k.*"))
        return _union(parts)

    every = set(range(len(rules)))
    suspects = t.cut("suspects", rows(False, every).groupBy("rule", "hash").agg(F.count("*").alias("n")).filter("n > 1").select("rule", "hash"))
    held = {r["rule"] for r in suspects.select("rule").distinct().collect()}  # at most a row per rule
    texts = rows(True, held or every)
    if sizing.measured_bytes(suspects) <= t.broadcast_bytes:
        texts = texts.join(F.broadcast(suspects), ["rule", "hash"], "left_semi")
    named = F.array(*[F.struct(F.lit(table).alias("table_name"), F.lit(rule).alias("rule")) for table, rule in rules])
    return (
        texts.groupBy("rule", "key")
        .agg(F.count("*").alias("rows_count"))
        .filter("rows_count > 1")
        .select(F.get(named, F.col("rule")).alias("r"), F.array_join("key", KEY_SEPARATOR).alias("key_value"), "rows_count")
        .select("r.table_name", "r.rule", "key_value", "rows_count")
    )


def orphan_rows(t: Tables, names: list[str] | None = None) -> DataFrame:
    """Reference values without a parent row, with the number of rows that hold them; NULL passes."""
    parts = []
    for table in _tables(t, names):
        df = t.frames[table.name]
        for ref in table.references:
            if ref.column in df.columns and ref.parent in t.frames:
                values = (
                    df.filter(F.col(ref.column).isNotNull()).groupBy(ref.column).agg(F.count("*").alias("rows_count"))
                )
                parents = t.frames[ref.parent].select(F.col("id").alias(ref.column))
                if ref.parent in CATALOGUE:
                    parents = t.catalogue_dim(parents)
                parts.append(
                    values.join(parents, ref.column, "left_anti").select(
                        F.lit(table.name).alias("table_name"),
                        F.lit(f"{ref.column}->{ref.parent}").alias("rule"),
                        F.col(ref.column).cast("string").alias("key_value"),
                        "rows_count",
                    )
                )
    return _union(parts)


def _broken_rules(df: DataFrame, table: Table, rules: dict[str, Column]) -> DataFrame:
    """Rows with the names of the rules they break, from a single scan."""
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    return df.select(
        F.lit(table.name).alias("table_name"), _text_key(table.keys[0]).alias("key_value"), F.explode(broken).alias("rule")
    ).select("table_name", "rule", "key_value")


def check_violations(t: Tables, names: list[str] | None = None) -> DataFrame:
    """Rows whose declared condition is false; an unknown (NULL) result passes."""
    parts = []
    for table in _tables(t, names):
        df = t.frames[table.name]
        rules = {}
        for name, condition in table.checks.items():
            needed = {c for c in table.names if c in condition.replace("(", " ").split()}
            if needed <= set(df.columns):
                rules[name] = ~F.coalesce(F.expr(condition), F.lit(True))
        if rules:
            parts.append(_broken_rules(df, table, rules))
    return _union(parts)


def domain_violations(t: Tables, names: list[str] | None = None) -> DataFrame:
    """Values outside their enum, missing required values, texts over their length."""
    parts = []
    for table in _tables(t, names):
        df = t.frames[table.name]
        rules = {}
        for c in df.columns:
            if c in table.required:
                rules[f"{c} required"] = F.col(c).isNull()
            if c in table.enums:
                rules[f"{c} in {table.enums[c]}"] = ~F.coalesce(F.col(c).isin(*ENUMS[table.enums[c]]), F.lit(True))
            if c in table.max_length:
                rules[f"{c} length"] = F.coalesce(F.length(F.col(c)) > table.max_length[c], F.lit(False))
        if rules:
            parts.append(_broken_rules(df, table, rules))
    return _union(parts)


@dataclass(frozen=True)
class Edge:
    """A declared reference: rows of ``child`` whose ``column`` names a row of ``parent``."""

    child: str
    column: str
    parent: str
    on_delete: str

    @property
    def name(self) -> str:
        return f"{self.child}.{self.column}"


def _edges(t: Tables) -> list[Edge]:
    return [
        Edge(table.name, ref.column, ref.parent, ref.on_delete)
        for table in _tables(t, None) for ref in table.references if ref.parent in t.frames
    ]


def _parents_first(edges: list[Edge], tables: list[str]) -> list[str]:
    """Tables ordered so that cascades run forward."""
    order: list[str] = []
    while len(order) < len(tables):
        ready = [n for n in tables if n not in order and all(e.parent in order or e.parent == n for e in edges if e.child == n and e.on_delete == "cascade")]
        if not ready:
            raise ValueError("cascades run in a circle")
        order += ready
    return order


def cascade_purge(t: Tables, wanted: dict[str, DataFrame]) -> tuple[Change, DataFrame]:
    """Delete the ``wanted`` rows (frames with ``id``, by table) and all that the declared references take along.

    One statement: a delete is refused if a row it would take is named by a
    reference that restricts, or by one without action from a row that stays.  A
    refused delete keeps all its rows, which may then hold back others, so this
    is repeated until no delete is refused any more.  Returns the tables after
    the deletes that are not refused, and the refused ones (kind, id, reason).
    """
    edges = _edges(t)
    cascades = [e for e in edges if e.on_delete == "cascade"]
    takes_along = {e.child for e in cascades}
    # reasons in order: what restricts, then rows that no delete takes along, then rows that may go themselves
    blockers = sorted((e for e in edges if e.on_delete != "cascade"), key=lambda e: (e.on_delete != "restrict", e.on_delete != "restrict" and e.child in takes_along))
    named = {e.parent for e in edges}  # only rows of these tables can take others along or be held back
    order = [n for n in _parents_first(edges, [n for n in TABLES if n in t.frames]) if n in named]
    roots = _union([
        df.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("root")).distinct() for kind, df in wanted.items()
    ])
    refused = None

    def reached(open_roots: DataFrame) -> dict[str, DataFrame]:
        """(id, kind, root) for every row that a delete would take, by table."""
        gone: dict[str, DataFrame] = {}
        for name in order:
            rows = t.frames[name]
            parts = []
            if name in wanted:
                own = open_roots.filter(F.col("kind") == name)
                parts.append(wanted[name].select("id").distinct().join(own, F.col("id").cast("string") == F.col("root")).select("id", "kind", "root"))
            for e in cascades:
                if e.child == name and e.parent in gone:
                    above = gone[e.parent].withColumnRenamed("id", "_above")
                    parts.append(rows.join(t.measured(above), F.col(e.column) == F.col("_above")).select("id", "kind", "root"))
            if parts:
                gone[name] = t.cut("purge", _union(parts).distinct())
        return gone

    def staying(e: Edge, gone: dict[str, DataFrame]) -> DataFrame:
        """Values of a reference in rows that no delete takes."""
        rows = t.frames[e.child]
        for c in cascades:
            if c.child == e.child and c.parent in gone:
                rows = rows.join(t.measured(gone[c.parent].select(F.col("id").alias(c.column)).distinct()), c.column, "left_anti")
        if e.child in gone:
            rows = rows.join(t.measured(gone[e.child].select("id").distinct()), "id", "left_anti")
        return rows

    while True:
        open_roots = roots if refused is None else roots.join(refused.select("kind", "root"), ["kind", "root"], "left_anti")
        gone = reached(t.cut("purge", open_roots))
        held = []
        for place, e in enumerate(blockers):
            if e.parent in gone:
                rows = t.frames[e.child] if e.on_delete == "restrict" else staying(e, gone)
                used = rows.filter(F.col(e.column).isNotNull()).select(F.col(e.column).alias("id")).distinct()
                held.append(used.join(gone[e.parent], "id").select("kind", "root", F.lit(place).alias("place")))
        if not held:
            break
        now = t.cut("purge", _union(held).groupBy("kind", "root").agg(F.min("place").alias("place")))
        if now.isEmpty():
            break
        refused = now if refused is None else t.cut("purge", refused.union(now))

    changed = {}
    for name in [n for n in TABLES if n in t.frames]:
        rows = t.frames[name]
        if name in gone:
            rows = rows.join(t.measured(gone[name].select("id").distinct()), "id", "left_anti")
        else:
            for e in cascades:
                if e.child == name and e.parent in gone:
                    rows = rows.join(t.measured(gone[e.parent].select(F.col("id").alias(e.column)).distinct()), e.column, "left_anti")
        if rows is not t.frames[name]:
            changed[name] = rows.select(*t.frames[name].columns)
    reason = F.get(F.array(*[F.lit(e.name) for e in blockers]), F.col("place"))
    none = t.spark.createDataFrame([], "kind string, root string, place int")
    rejects = (none if refused is None else refused).select("kind", F.col("root").alias("id"), reason.alias("reason"))
    return Change(tables=changed), rejects
