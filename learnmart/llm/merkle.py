"""Merkle manifest of a dataset: one tree per group of rows, the trees' roots under one root, a proof for every row.

The tree is built level by level as written tables of nodes that name their parent.  A recursive query then
climbs from every leaf at once: each step looks up the parent, appends the siblings found there and folds the
digest that the leaf has now into the one the parent would have.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from learnmart.llm.common import col, cut, small, table

FANOUT = 8
DIGEST = 32  # bytes of a digest
TOP = -1  # the tree over the roots of all trees
#: Nodes of the upper levels that a step of the climb may broadcast; lower ones are joined by exchange.
UPPER_BYTES = 16 * 1024 * 1024
NODE_BYTES = FANOUT * DIGEST + 96


def field(value: Column) -> Column:
    """A value with its length in bytes, so that no two rows are written alike; a null is ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """SHA-256 over texts, as bytes."""
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def digest_of(parts: Column) -> Column:
    """SHA-256 over digests (bytes one after the other) written as lowercase hex."""
    return F.unhex(F.sha2(F.lower(F.hex(parts)).cast("binary"), 256))


def text_of(parts: Column) -> Column:
    return F.lower(F.hex(parts))


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` (a written table) with ``at``, their place from 0 within ``group`` by ``order``, written.

    Rows are range-partitioned by both, so a group of any size spreads over
    tasks; counts per partition and group, a row each, give the starts.
    """
    keys = [*map(F.col, group), *map(F.col, order)]
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(partitions, *keys).withColumn("part", F.spark_partition_id()), f"{name}_dealt")
    counts = dealt.groupBy("part", *group).agg(F.count("*").alias("held"))
    starts = counts.select("part", *group, (F.sum("held").over(Window.partitionBy(*group).orderBy("part")) - F.col("held")).alias("before"))
    starts = starts.select(F.col("part").alias("of_part"), *[F.col(g).alias(f"of_{g}") for g in group], "before")
    same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"of_{g}")) for g in group], F.col("part") == F.col("of_part"))
    within = F.row_number().over(Window.partitionBy("part", *group).orderBy(*map(F.col, order)))
    placed = dealt.withColumn("within", within).join(small(cut(starts, f"{name}_starts")), same)
    return cut(placed.select(*rows.columns, (F.col("before") + F.col("within") - 1).cast("long").alias("at")), name)


@dataclass(frozen=True)
class Manifest:
    """A built tree of trees.

    ``leaves``: a row per row of the dataset: id, leaf, changed (digests), tree, at and its parent (up_tree, up_storey,
    up_at, place).  ``nodes``: tree, storey, at, children (their digests one after the other), its own digest and parent.
    ``trees``: tree, its group, its rows and root.  A storey is the level in a group's tree; those of the tree over all
    roots follow after ``storeys``.  ``root`` is None without rows.
    """

    leaves: DataFrame
    nodes: DataFrame | None
    trees: DataFrame
    root: str | None
    storeys: int
    sizes: dict[int, int]  # nodes by storey


def _levels(n: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def _up(tree: Column, at: Column, storey: int, last: Column, storeys: int, several: bool) -> list[Column]:
    """The parent of a node: in its own tree, or for a tree's root (``last``) in the tree over all."""
    above = storeys + 1 if several else None

    def either(root: Column | int | None, inner: Column) -> Column:
        root = F.lit(root).cast("long") if not isinstance(root, Column) else root
        return F.when(last, root).otherwise(inner).cast("long")

    by = lambda x: F.floor(x / FANOUT)
    return [
        either(TOP if several else None, tree).alias("up_tree"),
        either(above, F.lit(storey + 1)).alias("up_storey"),
        either(by(tree) if several else None, by(at)).alias("up_at"),
        either(tree % FANOUT if several else None, at % FANOUT).alias("place"),
    ]


def _parents(level: DataFrame) -> DataFrame:
    """(tree, at, n, children, digest) one level above ``level`` (tree, at, n, digest), in trees that have several nodes there."""
    run = level.filter("n > 1").groupBy("tree", F.floor(F.col("at") / FANOUT).alias("at"), F.ceil(F.col("n") / FANOUT).alias("n")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("at").alias("k"), "digest"))).alias("run"))  # at most FANOUT
    children = F.aggregate("run", F.lit("").cast("binary"), lambda a, x: F.concat(a, x.digest))
    return run.select("tree", "at", "n", children.alias("children")).withColumn("digest", digest_of(F.col("children")))


def build(rows: DataFrame, fields: list[str], group: str, order: str, changed: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``rows`` over ``fields``; ``changed`` gives other values of some fields for a second digest.

    Texts are read once: each row becomes two digests with its keys, all later
    steps move those.  Leaves of a group go by ``order`` (null first), then by
    digest, so repeated rows and ids are leaves of their own; a null group is a
    group, the first.  No rows make no trees and no root.
    """
    changed = changed or {}
    leaf = digest(*[field(col(f)) for f in fields])
    other = digest(*[field(changed.get(f, col(f))) for f in fields]) if changed else leaf
    base = cut(rows.select(col(order).alias("id"), col(group).alias("group"), leaf.alias("leaf"), other.alias("changed")), "merkle_leaves")
    groups = cut(base.groupBy("group").agg(F.count("*").alias("n")), "merkle_groups")
    trees = numbered(groups.withColumn("all", F.lit(0)), ["all"], ["group"], "merkle_trees").select(
        F.col("at").alias("tree"), F.col("group").alias("tree_group"), F.col("n").cast("long").alias("n"))
    bounds = trees.agg(F.count("*").alias("trees"), F.max("n").alias("most")).first()
    storeys, several = _levels(bounds.most or 0), bounds.trees > 1
    leaves = base.join(small(trees), F.col("group").eqNullSafe(F.col("tree_group"))).select("id", "leaf", "changed", "tree", "n")
    leaves = numbered(leaves, ["tree"], ["id", "leaf"], "merkle_numbered")

    level = leaves.select("tree", "at", "n", F.col("leaf").alias("digest"))
    parts, roots = [], level.filter("n = 1").select("tree", "digest")
    for storey in range(1, storeys + 1):
        level = cut(_parents(level), "merkle_level")
        up = _up(F.col("tree"), F.col("at"), storey, F.col("n") == 1, storeys, several)
        parts.append(level.select("tree", F.lit(storey).cast("long").alias("storey"), "at", "children", "digest", *up))
        roots = roots.union(level.filter("n = 1").select("tree", "digest"))
    roots = cut(roots, "merkle_roots")  # a row per tree
    level = roots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(bounds.trees).cast("long").alias("n"), "digest")
    for step in range(1, _levels(bounds.trees) + 1):
        storey = storeys + step
        level = cut(_parents(level), "merkle_top")
        up = [F.when(F.col("n") > 1, c).cast("long").alias(name) for name, c in (
            ("up_tree", F.lit(TOP)), ("up_storey", F.lit(storey + 1)), ("up_at", F.floor(F.col("at") / FANOUT)), ("place", F.col("at") % FANOUT))]
        parts.append(level.select("tree", F.lit(storey).cast("long").alias("storey"), "at", "children", "digest", *up))
    root = level.select(text_of(F.col("digest")).alias("root")).first() if bounds.trees else None
    nodes = reduce(DataFrame.union, parts) if parts else None
    sizes = {r.storey: r.n for r in nodes.groupBy("storey").agg(F.count("*").alias("n")).collect()} if nodes else {}  # a row per level
    linked = leaves.select("id", "leaf", "changed", "tree", "at",
                           *_up(F.col("tree"), F.col("at"), 0, F.col("n") == 1, storeys, several))
    named = trees.join(roots, "tree").select("tree", "tree_group", "n", text_of(F.col("digest")).alias("subroot"))
    return Manifest(linked, nodes, named, root.root if root else None, storeys, sizes)


#: One step: from the node that ``place`` and the up-columns of the row below name, to the next.
CLIMB = f"""
    WITH RECURSIVE climb(leaf_tree, leaf_at, step, up_tree, up_storey, up_at, place, siblings, folded) AS (
        SELECT leaf_tree, leaf_at, step, up_tree, up_storey, up_at, place, siblings, folded FROM {{start}}
        UNION ALL
        SELECT {{hint}} c.leaf_tree, c.leaf_at, c.step + 1, n.up_tree, n.up_storey, n.up_at, n.place,
               concat(substring(n.children, 1, cast(c.place * {DIGEST} AS int)), substring(n.children, cast(c.place * {DIGEST} + {DIGEST + 1} AS int))),
               unhex(sha2(cast(lower(hex(concat(
                   substring(n.children, 1, cast(c.place * {DIGEST} AS int)), c.folded,
                   substring(n.children, cast(c.place * {DIGEST} + {DIGEST + 1} AS int))))) AS binary), 256))
        FROM climb c JOIN {{nodes}} n ON n.tree = c.up_tree AND n.storey = c.up_storey AND n.at = c.up_at)
    SELECT * FROM climb
"""


@contextmanager
def unlimited(spark: SparkSession):
    """Recursive queries of any number of rows (levels stay limited by their default of 100)."""
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def climb(manifest: Manifest, upper_bytes: int = UPPER_BYTES) -> DataFrame:
    """A row for every leaf and step of its way to the root: leaf_tree, leaf_at, step, up_storey, siblings, folded.

    Nodes high up have few rows and very many leaves below; those that are
    measured to fit are broadcast in each step.  Further down a node has at most
    as many leaves as make the levels above too large, and steps are joins by
    exchange, written before the climb goes on.  So no task sees all rows of a
    node that a third of the leaves share.  To be run under ``unlimited``.
    """
    spark = manifest.leaves.sparkSession
    at = manifest.leaves.select(
        F.col("tree").alias("leaf_tree"), F.col("at").alias("leaf_at"), F.lit(0).alias("step"), "up_tree", "up_storey", "up_at", "place",
        F.lit("").cast("binary").alias("siblings"), F.col("changed").alias("folded"))
    if manifest.nodes is None:
        return at
    top = max(manifest.sizes) + 1
    first_upper, room = top, upper_bytes
    while first_upper > 1 and (room := room - manifest.sizes[first_upper - 1] * NODE_BYTES) >= 0:
        first_upper -= 1
    done = []
    for low, high, hint in ((1, first_upper, ""), (first_upper, top, "/*+ BROADCAST(n) */")):
        if low < high:
            nodes = manifest.nodes.filter(F.col("storey").between(low, high - 1))
            steps = spark.sql(CLIMB.replace("{hint}", hint), start=at, nodes=nodes)
            if high < top:
                steps = cut(steps, "merkle_climb")
                at = steps.filter(F.col("up_storey") >= high)  # where the next query goes on
                steps = steps.filter(F.isnull("up_storey") | (F.col("up_storey") < high))
            done.append(steps)
    return reduce(DataFrame.union, done)


def proofs(manifest: Manifest, upper_bytes: int = UPPER_BYTES) -> DataFrame:
    """A row per leaf: id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    with unlimited(manifest.leaves.sparkSession):
        steps = climb(manifest, upper_bytes)
        whole = steps.groupBy("leaf_tree", "leaf_at").agg(  # a row per level
            F.sort_array(F.collect_list(F.struct("step", "siblings"))).alias("way"),
            F.max(F.when(F.isnull("up_storey"), F.col("folded"))).alias("folded"))
        proof = F.aggregate("way", F.lit("").cast("binary"), lambda a, x: F.concat(a, x.siblings))
        whole = cut(whole.select("leaf_tree", "leaf_at", F.unhex(F.sha2(text_of(proof).cast("binary"), 256)).alias("proof"), "folded"), "merkle_proofs")
    rows = manifest.leaves.join(whole, (F.col("tree") == F.col("leaf_tree")) & (F.col("at") == F.col("leaf_at"))).drop("leaf_tree", "leaf_at")
    rows = rows.join(small(cut(manifest.trees.select(F.col("tree").alias("of_tree"), "subroot"), "merkle_subroots")), F.col("tree") == F.col("of_tree"))
    return rows.select(
        "id", text_of(F.col("leaf")).alias("leaf"), "subroot", F.lit(manifest.root).cast("string").alias("root"),
        text_of(F.col("proof")).alias("proof_sha256"), text_of(F.col("folded")).alias("folded_root"),
        (text_of(F.col("folded")) == F.lit(manifest.root)).alias("verified"))


# The letters that tampering lower-cases.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def verify_documents(docs: DataFrame) -> DataFrame:
    """Every document's leaf, proof, and the root its possibly tampered row folds to.

    Tampered are rows whose crc32 of the decimal id is divisible by 3: the
    letters A-Z of their text become a-z.  Null ids are not tampered with, come
    first and are leaves like any other; a null text stays null; an empty text
    is not a null one; a null language is the first group; repeated rows are
    leaves of their own; other columns are not looked at; no rows give none.
    """
    hit = F.crc32(col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = F.when(hit, F.translate(col("text"), UPPER, LOWER)).otherwise(col("text"))
    manifest = build(docs.select(*map(col, FIELDS)), FIELDS, "lang", "doc_id", {"text": tampered})
    return proofs(manifest).withColumnRenamed("id", "doc_id")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and verdict of every document."""
    return verify_documents(table(spark, sf_dir, "documents"))


def _sql_field(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen({name}::VARCHAR) || ':' || {name}::VARCHAR END"


_SQL_LEAF = " || ".join(_sql_field(f) for f in FIELDS)
# the checksum bit by bit over the digits of the id
_SQL_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


def _sql_climb(name: str, start: str) -> str:
    """A recursive query that goes up from ``start`` as long as there are siblings."""
    return f"""{name} AS (
        {start}
        UNION ALL
        SELECT c.leaf_tree, c.leaf_at, c.tree, c.storey + 1, c.pos // 8, sha256(s.before || c.folded || s.behind), c.proof || s.before || s.behind
        FROM {name} c JOIN siblings s ON s.tree = c.tree AND s.storey = c.storey AND s.pos = c.pos)"""


QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}

SQL = {
    "op11_merkle_manifest": f"""
        WITH RECURSIVE leaves AS (
            SELECT doc_id, sha256({_SQL_LEAF}) AS leaf,
                   CASE WHEN ({_SQL_CRC}) % 3 = 0 THEN sha256({_SQL_LEAF.replace("text", f"translate(text, '{UPPER}', '{LOWER}')")})
                        ELSE sha256({_SQL_LEAF}) END AS changed,
                   dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
                   row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, sha256({_SQL_LEAF})) - 1 AS pos
            FROM documents),
        inner_nodes AS (
            SELECT tree, 0 AS storey, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM leaves
            UNION ALL
            SELECT tree, storey + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8
            FROM inner_nodes WHERE n > 1 GROUP BY tree, storey, pos // 8, n),
        subroots AS (SELECT tree, h FROM inner_nodes WHERE n = 1),
        top_nodes AS (
            SELECT 0 AS storey, tree AS pos, h, count(*) OVER () AS n FROM subroots
            UNION ALL
            SELECT storey + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM top_nodes WHERE n > 1 GROUP BY storey, pos // 8, n),
        nodes AS (SELECT * FROM inner_nodes WHERE n > 1 UNION ALL SELECT -1, * FROM top_nodes WHERE n > 1),
        siblings AS (
            SELECT a.tree, a.storey, a.pos,
                   coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
                   coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS behind
            FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.storey = b.storey AND a.pos // 8 = b.pos // 8 GROUP BY a.tree, a.storey, a.pos),
        {_sql_climb("way", "SELECT tree AS leaf_tree, pos AS leaf_at, tree, 0 AS storey, pos, changed AS folded, '' AS proof FROM leaves")},
        at_subroot AS (SELECT leaf_tree, leaf_at, arg_max(folded, storey) AS folded, arg_max(proof, storey) AS proof FROM way GROUP BY ALL),
        {_sql_climb("way_up", "SELECT leaf_tree, leaf_at, -1, 0, leaf_tree, folded, proof FROM at_subroot").replace("way_up AS", "way_up(leaf_tree, leaf_at, tree, storey, pos, folded, proof) AS")},
        at_root AS (SELECT leaf_tree, leaf_at, arg_max(folded, storey) AS folded, arg_max(proof, storey) AS proof FROM way_up GROUP BY ALL)
        SELECT l.doc_id, l.leaf, s.h AS subroot, t.h AS root, sha256(r.proof) AS proof_sha256, r.folded AS folded_root, r.folded = t.h AS verified
        FROM leaves l JOIN subroots s USING (tree) JOIN at_root r ON r.leaf_tree = l.tree AND r.leaf_at = l.pos JOIN top_nodes t ON t.n = 1
    """,
}
