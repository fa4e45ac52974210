"""Exact top-k search by inner product as a Voronoi join.

Queries and data fall into cells around pivots.  Summaries of the cells bound the score of every query of a
cell with every row of another from above and below; a group of query cells is sent only the data cells that
could hold one of its k best, in chunks of bounded size, and solved there by integer arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from learnmart.llm.common import col, cut, ship, table

SCALE = 1024
BEST = 10
EXACT = 2.0 ** 53  # sums of whole numbers below this are exact in double precision
LONG = 2 ** 63


@dataclass(frozen=True)
class Settings:
    k: int = BEST
    pivots: int = 128  # drawn from the data, in expectation
    group_queries: int = 4096  # queries solved together; a larger cell is cut into blocks
    chunk_rows: int = 4096  # data rows solved together, in expectation


def usable(vector: Column, scale: int = SCALE) -> Column:
    """No null or non-finite component, before or after scaling."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) == float("inf"))
    return F.coalesce(~F.exists(vector, bad), F.lit(False))


def floored(rows: DataFrame, id_col: str, vector: str, asked: Column) -> DataFrame:
    """(row, vec_id, dims, vec, asked) of the usable rows: components floor(SCALE * x), row a number of their own; written."""
    # components beyond the whole numbers of a long stay as they are: such doubles have no fraction
    whole = F.transform(col(vector), lambda x: F.when(F.abs(x.cast("double") * SCALE) < 2.0 ** 62, F.floor(x.cast("double") * SCALE).cast("double"))
                        .otherwise(x.cast("double") * SCALE))
    good = rows.filter(usable(col(vector))).select(
        F.monotonically_increasing_id().alias("row"), col(id_col).cast("long").alias("vec_id"), F.size(col(vector)).alias("dims"), whole.alias("vec"),
        F.coalesce(asked, F.lit(False)).alias("asked"))
    return cut(good, "topk_rows")


def draw_pivots(rows: DataFrame, s: Settings) -> dict[int, np.ndarray]:
    """Pivots by vector length, a hash-drawn sample of ``pivots`` rows in expectation; a length without one has the zero vector."""
    total = max(1, rows.count())
    drawn = F.pmod(F.xxhash64("row", F.lit("pivot")), F.lit(1 << 32)) < F.lit(int(min(1.0, s.pivots / total) * (1 << 32)))
    sample = rows.filter(drawn).select("dims", "vec").toPandas()
    return {int(d): np.unique(np.stack(g.to_list()), axis=0) for d, g in sample.groupby("dims")["vec"] if d > 0}


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dims)


def _in_cells(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Each row with its cell and its distance from the cell's pivot."""
    for batch in batches:
        lengths = batch.column("dims").to_numpy()
        cell, dist = np.zeros(len(lengths), np.int64), np.zeros(len(lengths))
        for dims in np.unique(lengths):
            at = np.nonzero(lengths == dims)[0]
            vecs = _matrix(batch.column("vec").take(pa.array(at)), dims)
            points = pivots.get(int(dims), np.zeros((1, dims)))
            with np.errstate(over="ignore", invalid="ignore"):
                near = (points ** 2).sum(1) / 2 - vecs @ points.T
                best = np.where(np.isfinite(near), near, np.inf).argmin(1)
                cell[at], dist[at] = best, np.sqrt(((vecs - points[best]) ** 2).sum(1))  # infinite where squares overflow: never left out
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(dist)], [*batch.schema.names, "cell", "dist"])


def needed(pivots: np.ndarray, radius: np.ndarray, asked_radius: np.ndarray, nearest: list[np.ndarray], k: int) -> np.ndarray:
    """Which data cells (columns) a query cell (rows) needs.

    For q within ``asked_radius`` of pivot a and x at distance d of pivot b:
    a.b - |a| d - r |b| - r d  <=  q.x  <=  a.b + |a| d + r |b| + r d.
    The k-th largest lower bound over the ``nearest`` rows of all cells (one
    more than k of each, as a query is no candidate of its own) is reached by k
    rows for every query of the cell, so a data cell whose upper bound is lower
    holds none of its best.  Negative radii mark cells without rows.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        size = np.sqrt((pivots ** 2).sum(1))
        between = pivots @ pivots.T
        out = np.zeros(between.shape, bool)
        for a in np.nonzero(asked_radius >= 0)[0]:
            r = asked_radius[a]
            upper = between[a] + size[a] * radius + r * size + r * radius
            lower = [between[a, b] - size[a] * d - r * size[b] - r * d for b, d in enumerate(nearest) if len(d)]
            lower = np.sort(np.concatenate(lower))[::-1]
            least = lower[k] if len(lower) > k else -np.inf  # the k+1st: one of them may be the query itself
            # room for the rounding of sums of such products
            slack = 1e-9 * (np.abs(between[a]) + (size[a] + r) * (size + np.maximum(radius, 0))) + 1
            out[a] = (radius >= 0) & ~(upper + slack < least - np.nanmax(slack, initial=0))
    return out


@dataclass(frozen=True)
class Plan:
    """Groups of query cells by vector length: the group and blocks of a query cell, the groups that need a data cell."""

    group_of: dict[tuple[int, int], tuple[int, int]]  # (dims, query cell) -> group, blocks
    groups_for: dict[tuple[int, int], list[tuple[int, int]]]  # (dims, data cell) -> (group, blocks)
    chunks: dict[int, int]  # group -> chunks of its data


def plan_join(cells: DataFrame, pivots: dict[int, np.ndarray], s: Settings) -> Plan:
    """Bounds and groups, from summaries of the cells: a row per cell, and the k + 1 distances nearest to its pivot.

    Cells are as many as pivots, and one for each further vector length.
    """
    sums = cells.groupBy("dims", "cell").agg(
        F.count("*").alias("n"), F.max("dist").alias("radius"), F.count_if("asked").alias("asked"),
        F.max(F.when(F.col("asked"), F.col("dist"))).alias("asked_radius")).toPandas()
    order = Window.partitionBy("dims", "cell").orderBy("dist")
    near = cells.select("dims", "cell", "dist", F.row_number().over(order).alias("place")).filter(F.col("place") <= s.k + 1).toPandas()
    group_of, groups_for, chunks = {}, {}, {}
    for dims, own in sums.groupby("dims"):
        points = pivots.get(int(dims), np.zeros((1, int(dims))))
        m = len(points)
        radius, asked_radius, asked, n = np.full(m, -1.0), np.full(m, -1.0), np.zeros(m, np.int64), np.zeros(m, np.int64)
        at = own["cell"].to_numpy()
        radius[at], asked[at], n[at] = own["radius"], own["asked"], own["n"]
        asked_radius[at] = own["asked_radius"].fillna(-1.0)
        close = near[near["dims"] == dims].groupby("cell")["dist"]
        nearest = [close.get_group(c).to_numpy() if c in close.groups else np.empty(0) for c in range(m)]
        wants = needed(points, radius, asked_radius, nearest, s.k)
        # cells of queries one after the other by nearness, bundled up to the size of a group
        left, held, bundle = set(np.nonzero(asked)[0].tolist()), 0, []
        bundles, last = [], None
        while left:
            nxt = min(left) if last is None else min(left, key=lambda c: (float(((points[c] - points[last]) ** 2).sum()), c))
            left.discard(nxt)
            if bundle and held + asked[nxt] > s.group_queries:
                bundles.append(bundle)
                bundle, held = [], 0
            bundle.append(nxt)
            held += int(asked[nxt])
            last = nxt
        for bundle in [*bundles, bundle] if bundle else bundles:
            group, blocks = len(chunks), int(-(-asked[bundle].sum() // s.group_queries))
            sent = wants[bundle].any(0)
            for c in bundle:
                group_of[int(dims), int(c)] = (group, blocks)
            for c in np.nonzero(sent)[0]:
                groups_for.setdefault((int(dims), int(c)), []).append((group, blocks))
            chunks[group] = max(1, int(-(-n[sent].sum() // s.chunk_rows)))
    return Plan(group_of, groups_for, chunks)


def best_of(scores: np.ndarray, k: int, barred: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k highest of every row, ties to the left; ``barred`` entries are none."""
    rows, columns = [], []
    for i, (row, out) in enumerate(zip(scores, barred)):
        free = np.nonzero(~out)[0] if out.any() else None
        line = row if free is None else row[free]
        if len(line) > k:
            least = np.partition(line, len(line) - k)[len(line) - k]
            above = np.nonzero(line > least)[0]
            found = np.concatenate([above, np.nonzero(line == least)[0][:k - len(above)]])
        else:
            found = np.arange(len(line))
        found = found if free is None else free[found]
        rows.append(np.full(len(found), i))
        columns.append(found)
    return np.concatenate(rows), np.concatenate(columns)


def inner_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: in doubles where they hold every sum, else in Python's integers, cut to the range of a long."""
    top = (np.abs(left).max(initial=0) * np.abs(right).max(initial=0)) * max(1, left.shape[1])
    if top < EXACT:
        return left @ right.T
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(left).astype(object) @ whole(right).astype(object).T, -LONG, LONG - 1).astype(np.int64)


def solve(rows: pa.Table, s: Settings) -> pa.Table:
    """(query_row, query_id, row, vec_id, score): the best of one chunk of data for one block of queries."""
    rows = rows.sort_by([("vec_id", "ascending"), ("row", "ascending")])  # null ids last
    query = rows.column("query").to_numpy(zero_copy_only=False).astype(bool)
    asked, data = rows.filter(pa.array(query)), rows.filter(pa.array(~query))
    out = []
    if len(asked) and len(data):
        dims = asked.column("dims")[0].as_py()
        points = _matrix(data.column("vec").combine_chunks(), dims)
        own, theirs = asked.column("row").to_numpy(), data.column("row").to_numpy()
        queries = _matrix(asked.column("vec").combine_chunks(), dims)
        for at in range(0, len(queries), 256):
            scores = inner_products(queries[at:at + 256], points)
            i, j = best_of(scores, s.k, own[at:at + 256, None] == theirs[None, :])
            out.append(pa.table({
                "query_row": own[at + i], "query_id": asked.column("vec_id").take(pa.array(at + i)),
                "row": theirs[j], "vec_id": data.column("vec_id").take(pa.array(j)), "score": scores[i, j].astype(np.int64)}))
    return pa.concat_tables(out).cast(FOUND) if out else FOUND.empty_table()


FOUND = pa.schema([(name, pa.int64()) for name in ("query_row", "query_id", "row", "vec_id", "score")])


def top_k(rows: DataFrame, asked: Column, id_col: str = "vec_id", vector: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of every row that ``asked`` names, against all other rows.

    Scores are inner products of floor(1024 * x) components, ties go to the
    smaller vec_id (null last), then to any order.  Vectors that are null or hold
    a null or non-finite component (also one whose 1024-fold is none) take no
    part, vectors of different length do not meet, empty ones score 0 with each
    other.  Repeated ids are rows of their own, each a candidate of the other,
    and each a query; a null id is a candidate only.  A score beyond a long
    counts as the nearest long.  Other columns are not looked at, no rows give none.

    A data row is sent once to each block of queries that its cell may matter
    to, and nothing is left out otherwise: where bounds do not part the cells, as
    in many dimensions, all blocks see all rows, chunk by chunk.
    """
    ship(rows.sparkSession)
    s = settings
    base = floored(rows, id_col, vector, asked)
    pivots = draw_pivots(base, s)
    schema = "row long, vec_id long, dims int, vec array<double>, asked boolean, cell long, dist double"
    cells = cut(base.mapInArrow(lambda it: _in_cells(it, pivots), schema), "topk_cells")
    plan = plan_join(cells, pivots, s)

    def dealt(batches: Iterator[pa.RecordBatch], query: bool) -> Iterator[pa.RecordBatch]:
        """Rows once for each block (of queries) and chunk (of data) they meet in."""
        for batch in batches:
            names = zip(batch.column("dims").to_pylist(), batch.column("cell").to_pylist(), batch.column("row").to_pylist())
            at, keys = [], []
            for i, (dims, cell, row) in enumerate(names):
                mixed = (row * 0x9E3779B97F4A7C15) >> 16  # rows of a partition are numbered on, so they spread evenly
                if query:
                    group, blocks = plan.group_of[dims, cell]
                    block = mixed % blocks
                    keys += [(group, block, chunk) for chunk in range(plan.chunks[group])]
                    at += [i] * plan.chunks[group]
                else:
                    for group, blocks in plan.groups_for.get((dims, cell), ()):
                        chunk = mixed % plan.chunks[group]
                        keys += [(group, block, chunk) for block in range(blocks)]
                        at += [i] * blocks
            if at:
                take = pa.array(at, pa.int64())
                key = np.array(keys, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(key[:, c]) for c in range(3)], pa.array(np.full(len(at), query)),
                     *[batch.column(name).take(take) for name in ("row", "vec_id", "dims", "vec")]],
                    ["group", "block", "chunk", "query", "row", "vec_id", "dims", "vec"])

    sent = "group long, block long, chunk long, query boolean, row long, vec_id long, dims int, vec array<double>"
    data = cells.mapInArrow(lambda it: dealt(it, False), sent)
    queries = cells.filter("asked").mapInArrow(lambda it: dealt(it, True), sent)
    found = data.union(queries).groupBy("group", "block", "chunk").applyInArrow(
        lambda t: solve(t, s), ", ".join(f"{name} long" for name in FOUND.names))
    # k rows for every query and chunk meet, those of one query in one place
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= s.k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of every hundredth embedding, against all."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows, F.col("vec_id") % 100 == 0)


QUERIES = {"op12_exact_topk": op12_exact_topk}

SQL = {
    "op12_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
}
