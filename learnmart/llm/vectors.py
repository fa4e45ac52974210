"""Near duplicates among embeddings by robust-pruned flat graphs.

Vectors of a label fall into cells around pivots and there into blocks of bounded size.  A block compares its own
vectors and gathers those that link around leaders; so a group of near copies, however large, is a few leaders
with many followers.  Leaders are built into robust-pruned graphs on overlapping shards, their adjacency lists are
united, and every leader searches from the medoids, going on from all that is in reach, for leaders of other
blocks whose followers could link with its own.  What it finds is verified: the followers' cosines decide, in
double precision.  A brute-force audit of a sample measures recall.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learnmart.llm.common import classes, col, components, cut, let, roots, ship, small, table

THRESHOLD = 0.93


@dataclass(frozen=True)
class Settings:
    threshold: float = THRESHOLD
    cell_rows: int = 4000  # vectors per pivot, in expectation
    most_pivots: int = 8192  # bound of the pivots that are broadcast; beyond it cells grow and are cut into more blocks and graphs
    apart: float = 0.8  # of two pivots with a cosine above this one goes, so that a dense group is not parted among many
    block_rows: int = 2000  # vectors of one block, in expectation
    graph_rows: int = 8192  # leaders of one graph, in expectation
    overlap: int = 2  # shards that hold a leader, at least
    slack: float = 0.05  # it is in all shards whose pivot's cosine is this near to the best
    degree: int = 20  # out-neighbours after pruning
    pool: int = 48  # candidates that pruning looks at
    alpha: float = 1.2  # pruning slack (on distances)
    beam: int = 16  # nodes a search keeps
    step: int = 4  # nodes of the beam a search expands at a time
    reach: float = 0.05  # a search also goes on from all nodes whose cosine is at most this much below what it looks for
    audit_rows: int = 256  # vectors held against brute force, in expectation
    recall: float = 0.98  # audited recall in the worst stratum; below it the graphs are built anew with more overlap
    tries: int = 3


def usable(rows: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, vec, usable): unit vectors in double precision; null where a vector links with nothing."""
    v = F.transform(col(vector), lambda x: x.cast("double"))
    # components are scaled by the largest first: their squares neither vanish nor overflow
    peak = F.array_max(F.transform(v, F.abs))
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce((F.size(v) > 0) & finite & (peak > 0), F.lit(False)) & col(label).isNotNull()
    # the largest component and the length are worked out once a vector, not once a component
    scaled = let(peak, lambda p: F.transform(v, lambda x: x / p))
    unit = let(scaled, lambda u: let(F.sqrt(F.aggregate(u, F.lit(0.0), lambda a, x: a + x * x)), lambda norm: F.transform(u, lambda x: x / norm)))
    unit = rows.select(col(id_col).alias("vec_id"), col(label).cast("string").alias("label"), good.alias("usable"), F.when(good, unit).alias("vec"))
    # vectors of different lengths are not compared
    return unit.withColumn("label", F.concat_ws(":", F.size("vec").cast("string"), "label"))


def linked(left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of ``left`` and ``right`` (unit vectors) have a cosine of at least the threshold in double precision."""
    sims = left.astype(np.float32) @ right.astype(np.float32).T
    # rounding of the components and of a sum of so many products, twice over
    margin = np.float32(4 * (left.shape[1] + 4) * 2.0 ** -24)
    near = sims >= threshold + margin
    i, j = np.nonzero((sims >= threshold - margin) & ~near)
    for at in range(0, len(i), 1 << 16):
        part = slice(at, at + (1 << 16))
        near[i[part], j[part]] = np.einsum("ij,ij->i", left[i[part]], right[j[part]]) >= threshold
    return near


def tally(reps: np.ndarray, weight: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links are counted, not listed: for each vector the rows it links to, and the smallest vector the links ``i`` to ``j`` reach."""
    order = np.argsort(reps)
    place = np.empty_like(order)
    place[order] = np.arange(len(reps))
    least = reps[order][roots(len(reps), place[i], place[j])[place]]
    found = np.zeros(len(reps), np.int64)
    np.add.at(found, i, weight[j])
    return found, least


def compare(left: pd.DataFrame, right: pd.DataFrame, s: Settings) -> pd.DataFrame:
    """Rows (rep, found, least) for the vectors of two blocks that link across."""
    near = linked(np.stack(left["vec"].to_list()), np.stack(right["vec"].to_list()), s.threshold)
    i, j = np.nonzero(near)
    i, j = np.concatenate([i, j + len(left)]), np.concatenate([j + len(left), i])
    reps, weight = (np.concatenate([left[c].to_numpy(), right[c].to_numpy()]) for c in ("rep", "n"))
    found, least = tally(reps, weight, i, j)
    some = found > 0
    return pd.DataFrame({"rep": reps[some], "found": found[some], "least": least[some]})


def lead(block: pd.DataFrame, s: Settings) -> pd.DataFrame:
    """The block's rows with the links inside it (found, least), each vector's leader and the leaders' radius.

    The vector with most links leads first; those that link with it follow.
    A follower's cosine with its leader reaches the threshold, and no two
    leaders of a block link.  ``radius`` is the largest angle of a follower.
    """
    vecs, reps = np.stack(block["vec"].to_list()), block["rep"].to_numpy()
    near = linked(vecs, vecs, s.threshold)
    np.fill_diagonal(near, False)  # a vector does not link with itself
    near |= near.T  # whichever way a cosine at the threshold is summed, a link has two ends
    found, least = tally(reps, block["n"].to_numpy(), *np.nonzero(near))
    leader = np.full(len(reps), -1)
    for k in np.argsort(-near.sum(1), kind="stable"):
        if leader[k] < 0:
            leader[near[k] & (leader < 0)] = k
            leader[k] = k
    angle = np.arccos(np.clip(np.einsum("ij,ij->i", vecs, vecs[leader]), -1, 1)) + 1e-6
    radius = np.zeros(len(reps))
    follows = leader != np.arange(len(reps))
    np.maximum.at(radius, leader[follows], angle[follows])
    return pd.DataFrame({"rep": reps, "n": block["n"].to_numpy(), "label": block["label"].to_numpy(), "home": block["home"].to_numpy(), "vec": block["vec"].to_numpy(),
                         "leader": reps[leader], "radius": radius, "found": found, "least": least})


def pivots(reps: DataFrame, s: Settings) -> dict[str, np.ndarray]:
    """Pivots by label, a hash-drawn sample: one in ``cell_rows`` vectors, at most about ``most_pivots`` in all, none near another.

    Labels with fewer vectors than a cell have none and are a cell by themselves.
    """
    counts = reps.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") > s.cell_rows)
    total = counts.agg(F.sum("n")).first()[0] or 0
    rate = min(1.0 / s.cell_rows, s.most_pivots / max(1, total))
    drawn = F.pmod(F.xxhash64("rep", F.lit("pivot")), F.lit(1 << 32)) < F.lit(int(rate * (1 << 32)))
    rows = reps.filter(drawn).join(counts.select("label"), "label", "left_semi").select("label", "vec").toPandas()
    out = {}
    for label, group in rows.groupby("label")["vec"]:
        chosen: list[np.ndarray] = []
        for vec in sorted(group.to_list(), key=tuple):
            if not chosen or (np.stack(chosen) @ vec).max() < s.apart:
                chosen.append(vec)
        out[label] = np.stack(chosen)
    return out


def _cosines(batch: pa.RecordBatch, centers: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a batch and their cosines with the pivots of their label, label by label."""
    labels = np.array(batch.column("label").to_pylist(), object)
    for label in dict.fromkeys(labels):
        at = np.nonzero(labels == label)[0]
        points = centers.get(label)
        if points is None:
            yield at, np.ones((len(at), 1))
        else:
            flat = batch.column("vec").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
            yield at, flat.reshape(len(at), -1) @ points.T


def home_cells(batches: Iterator[pa.RecordBatch], centers: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Each vector with the cell of its nearest pivot."""
    for batch in batches:
        cell = np.zeros(batch.num_rows, np.int64)
        for at, cos in _cosines(batch, centers):
            cell[at] = cos.argmax(1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])


def overlapping_shards(batches: Iterator[pa.RecordBatch], centers: dict[str, np.ndarray], s: Settings) -> Iterator[pa.RecordBatch]:
    """Each leader once for every shard that holds it; ``own`` marks that of its nearest pivot."""
    for batch in batches:
        rows, shards, own = [], [], []
        for at, cos in _cosines(batch, centers):
            best = cos.max(1)
            kth = -np.partition(-cos, min(s.overlap, cos.shape[1]) - 1, axis=1)[:, min(s.overlap, cos.shape[1]) - 1]
            r, c = np.nonzero(cos >= np.minimum(kth, best - s.slack)[:, None])
            rows.append(at[r])
            shards.append(c)
            own.append(c == cos.argmax(1)[r])
        if rows:
            yield pa.RecordBatch.from_arrays(
                [*[column.take(pa.array(np.concatenate(rows))) for column in batch.columns], pa.array(np.concatenate(shards)),
                 pa.array(np.concatenate(own))], [*batch.schema.names, "shard", "own"])


def robust_prune(vecs: np.ndarray, s: Settings, rows: int = 1024) -> np.ndarray:
    """Out-neighbours of every vector, -1 where there are fewer.

    From the ``pool`` nearest candidates the nearest is kept, candidates that
    are ``alpha`` times nearer to it than to the node go, and so on.
    """
    n = len(vecs)
    width = min(s.pool, n - 1)
    out = np.full((n, s.degree), -1, np.int64)
    for first in range(0, n if width > 0 else 0, rows):
        own = np.arange(first, min(n, first + rows))
        sims = vecs[own] @ vecs.T
        sims[np.arange(len(own)), own] = -np.inf
        near = np.argpartition(-sims, width - 1, axis=1)[:, :width]
        cos = np.take_along_axis(sims, near, 1)
        order = np.argsort(-cos, axis=1, kind="stable")
        near, far = np.take_along_axis(near, order, 1), 2 - 2 * np.take_along_axis(cos, order, 1)  # squared distances
        alive, every = np.ones(near.shape, bool), np.arange(len(own))
        candidates = vecs[near]
        for k in range(s.degree):
            pick = alive.argmax(1)
            left = alive[every, pick]
            if not left.any():
                break
            out[own[left], k] = near[every, pick][left]
            between = 2 - 2 * np.einsum("ijk,ik->ij", candidates, candidates[every, pick])
            alive &= s.alpha * s.alpha * between > far
            alive[every, pick] = False
    return out


def build_graph(block: pd.DataFrame, s: Settings) -> pd.DataFrame:
    """(rep, nbrs) of one graph; every node also points back from its neighbours' side."""
    reps = block["rep"].to_numpy()
    out = robust_prune(np.stack(block["vec"].to_list()).astype(np.float32), s)
    source, k = np.nonzero(out >= 0)
    target = out[source, k]
    pairs = np.unique(np.concatenate([source * len(reps) + target, target * len(reps) + source]))
    starts = np.searchsorted(pairs, np.arange(len(reps) + 1) * len(reps))
    return pd.DataFrame({"rep": reps, "nbrs": [reps[pairs[a:b] % len(reps)] for a, b in zip(starts[:-1], starts[1:])]})


def medoids(vecs: np.ndarray, nbrs: np.ndarray) -> np.ndarray:
    """The node nearest to the mean of every component of the graph, so that each part of it is reached."""
    n = len(vecs)
    source, k = np.nonzero(nbrs < n)
    root = roots(n, source, nbrs[source, k])
    parts, part = np.unique(root, return_inverse=True)
    mean = np.zeros((len(parts), vecs.shape[1]))
    np.add.at(mean, part, vecs)
    order = np.lexsort((-np.einsum("ij,ij->i", vecs, mean[part]), part))
    return order[np.searchsorted(part[order], np.arange(len(parts)))]


def range_search(points: np.ndarray, wanted: np.ndarray, vecs: np.ndarray, radius: np.ndarray, nbrs: np.ndarray, starts: np.ndarray,
                 itself: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) within reach of each other: an angle of at most ``wanted`` of the query and ``radius`` of the node.

    Greedy search from the medoids (and from the query's own node, if ``itself``
    is not negative) keeps the ``beam`` best nodes and expands the best of them,
    ``step`` at a time; nodes in reach or nearly so are all expanded, until
    nothing is left to expand.  Each node is looked at once.
    """
    m, n = len(points), len(vecs)
    seen = np.zeros(m * n, bool)
    beam_cos, beam_node = np.full((m, s.beam), -np.inf, np.float32), np.zeros((m, s.beam), np.int64)
    beam_open = np.zeros((m, s.beam), bool)
    has = np.nonzero(itself >= 0)[0]
    fresh = np.unique(np.concatenate([(np.arange(m)[:, None] * n + starts[None, :]).ravel(), has * n + itself[has]]))
    found: list[np.ndarray] = []
    while len(fresh):
        seen[fresh] = True
        q, x = fresh // n, fresh % n
        cos = np.einsum("ij,ij->i", points[q], vecs[x])
        above = cos - np.cos(np.minimum(np.pi, wanted[q] + radius[x])).astype(np.float32)
        found.append(fresh[above >= -1e-5])
        go = above >= -s.reach
        # the best of the fresh ones of each query into its beam
        order = np.lexsort((-cos, q))
        first = np.searchsorted(q[order], np.arange(m))
        rank = np.arange(len(order)) - first[q[order]]
        top = order[rank < s.beam]
        new_cos, new_node, new_open = np.full((m, s.beam), -np.inf, np.float32), np.zeros((m, s.beam), np.int64), np.zeros((m, s.beam), bool)
        at = (q[top], rank[rank < s.beam])
        new_cos[at], new_node[at], new_open[at] = cos[top], x[top], ~go[top]
        both = np.concatenate([beam_cos, new_cos], 1)
        best = np.argsort(-both, axis=1, kind="stable")[:, :s.beam]
        beam_cos = np.take_along_axis(both, best, 1)
        beam_node = np.take_along_axis(np.concatenate([beam_node, new_node], 1), best, 1)
        beam_open = np.take_along_axis(np.concatenate([beam_open, new_open], 1), best, 1)
        turn = beam_open & (np.cumsum(beam_open, axis=1) <= s.step)
        beam_open &= ~turn
        rows, columns = np.nonzero(turn)
        q, x = np.concatenate([q[go], rows]), np.concatenate([x[go], beam_node[rows, columns]])
        reached = nbrs[x]
        fresh = (q[:, None] * n + reached)[reached < n]
        fresh = np.unique(fresh[~seen[fresh]])
    every = np.concatenate(found) if found else np.empty(0, np.int64)
    return every // n, every % n


def search(nodes: pd.DataFrame, queries: pd.DataFrame, s: Settings, at_once: int = 512) -> pd.DataFrame:
    """Rows (leader, other): a leader and a block that holds a leader within its reach, for both ends."""
    reps, vecs = nodes["rep"].to_numpy(), np.stack(nodes["vec"].to_list()).astype(np.float32)
    index = pd.Index(reps)
    lists = [index.get_indexer(x) for x in nodes["nbrs"]]  # united lists also name nodes of other graphs
    lists = [x[x >= 0] for x in lists]
    nbrs = np.full((len(reps), max(1, max(map(len, lists)))), len(reps), np.int64)
    for i, x in enumerate(lists):
        nbrs[i, :len(x)] = x
    starts, radius, homes = medoids(vecs, nbrs), nodes["radius"].to_numpy(), nodes["home"].to_numpy()
    asked, at_home = queries["rep"].to_numpy(), queries["home"].to_numpy()
    points, wanted = np.stack(queries["vec"].to_list()).astype(np.float32), queries["radius"].to_numpy() + np.arccos(s.threshold)
    itself = index.get_indexer(asked)
    out = []
    for at in range(0, len(asked), at_once):
        part = slice(at, at + at_once)
        q, x = range_search(points[part], wanted[part], vecs, radius, nbrs, starts, itself[part], s)
        q = q + at
        across = at_home[q] != homes[x]
        q, x = q[across], x[across]
        out += [pd.DataFrame({"leader": asked[q], "other": homes[x]}), pd.DataFrame({"leader": reps[x], "other": at_home[q]})]
    return pd.concat(out).drop_duplicates().astype({"leader": "int64", "other": "object"})


def in_reach(leaders: DataFrame, centers: dict[str, np.ndarray], s: Settings) -> DataFrame:
    """(leader, other): leaders and the other blocks in which their followers could link, by search of the united graph; written."""
    schema = "rep long, label string, home string, vec array<double>, radius double, shard long, own boolean"
    held = cut(leaders.mapInArrow(lambda it: overlapping_shards(it, centers, s), schema), "leader_shards")
    sizes = cut(held.groupBy("label", "shard").agg(F.ceil(F.count("*") / s.graph_rows).cast("long").alias("graphs")), "shard_sizes")
    dealt = held.join(small(sizes), ["label", "shard"]).withColumn("graph", F.pmod(F.xxhash64("rep", F.lit("graph")), F.col("graphs")))
    graph = dealt.groupBy("label", "shard", "graph").applyInPandas(lambda b: build_graph(b, s), "rep long, nbrs array<long>")
    # the flat graph: a leader's lists of all its shards in one
    lists = cut(graph.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("nbrs"))).alias("nbrs")), "leader_graph")
    nodes = dealt.join(lists, "rep").select("label", "shard", "graph", "rep", "home", "vec", "radius", "nbrs")
    # leaders ask all graphs of their own shard, a batch at a time
    ask = dealt.filter("own").select(
        "label", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("graphs") - 1)).alias("graph"),
        F.col("graph").alias("batch"), F.lit(1).alias("kind"), "rep", "home", "vec", "radius", F.array().cast("array<long>").alias("nbrs"))
    batches = cut(ask.select("label", "shard", "graph", "batch").distinct(), "shard_batches")
    hold = nodes.join(small(batches), ["label", "shard", "graph"]).select(
        "label", "shard", "graph", "batch", F.lit(0).alias("kind"), "rep", "home", "vec", "radius", "nbrs")

    def ask_graph(rows: pd.DataFrame) -> pd.DataFrame:
        nodes, queries = rows[rows["kind"] == 0], rows[rows["kind"] == 1]
        if nodes.empty or queries.empty:
            return pd.DataFrame({"leader": np.empty(0, np.int64), "other": np.empty(0, object)})
        return search(nodes, queries, s)

    found = hold.union(ask).groupBy("label", "shard", "graph", "batch").applyInPandas(ask_graph, "leader long, other string")
    return cut(found.distinct(), "leaders_in_reach")


def blocks_of(reps: DataFrame, s: Settings) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """The vectors in blocks, with their links inside the block and their leaders; written.  And the pivots."""
    centers = pivots(reps, s)
    celled = cut(reps.mapInArrow(lambda it: home_cells(it, centers), "rep long, n long, label string, vec array<double>, cell long"), "vector_cells")
    sizes = cut(celled.groupBy("label", "cell").agg(F.ceil(F.count("*") / s.block_rows).cast("long").alias("blocks")), "cell_sizes")
    block = F.pmod(F.xxhash64("rep", F.lit("block")), F.col("blocks"))
    dealt = celled.join(small(sizes), ["label", "cell"]).select("rep", "n", "label", F.concat_ws("|", block, "cell", "label").alias("home"), "vec")
    schema = "rep long, n long, label string, home string, vec array<double>, leader long, radius double, found long, least long"
    return cut(dealt.groupBy("home").applyInPandas(lambda b: lead(b, s), schema), "vector_blocks"), centers


def link_counts(blocks: DataFrame, centers: dict[str, np.ndarray], s: Settings) -> DataFrame:
    """(rep, found, least): links inside blocks, and across those that the search names; written."""
    leaders = blocks.filter(F.col("rep") == F.col("leader")).select("rep", "label", "home", "vec", "radius")
    across = in_reach(leaders, centers, s)
    followers = blocks.select("leader", "home", "rep", "n", "vec").join(across, "leader")
    pairs = followers.select(F.least("home", "other").alias("low"), F.greatest("home", "other").alias("high"), "home", "rep", "n", "vec")

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows["home"] == rows["low"].iat[0]
        if first.all() or not first.any():
            return pd.DataFrame({"rep": [], "found": [], "least": []}).astype("int64")
        return compare(rows[first], rows[~first], s)

    inside = blocks.filter("found > 0").select("rep", "found", "least")
    return cut(inside.union(pairs.groupBy("low", "high").applyInPandas(meet, "rep long, found long, least long")), "vector_links")


def audit(reps: DataFrame, counts: DataFrame, s: Settings) -> float:
    """How well the links of a hash-drawn sample of vectors agree with brute force against all, in the worst stratum.

    Each vector has its own share (of links found, or of found ones that are
    links), however many links it has; shares are averaged by label and order
    of the true count, so neither a hot group nor a large label hides others.
    """
    total = reps.count()
    drawn = F.pmod(F.xxhash64("rep", F.lit("audit")), F.lit(1 << 32)) < F.lit(int(min(1.0, s.audit_rows / max(1, total)) * (1 << 32)))
    sample = reps.filter(drawn).select("rep", "label", "vec").toPandas()  # audit_rows in expectation
    if sample.empty:
        return 1.0
    sent = reps.sparkSession.sparkContext.broadcast(
        {label: (g["rep"].to_numpy(), np.stack(g["vec"].to_list())) for label, g in sample.groupby("label")})

    def brute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for label, rows in batch.groupby("label"):
                if label in sent.value:
                    asked, points = sent.value[label]
                    sims, n = points @ np.stack(rows["vec"].to_list()).T, rows["n"].to_numpy(np.int64)
                    sims[asked[:, None] == rows["rep"].to_numpy()[None, :]] = -np.inf
                    # sums of another order differ in the last bits, so links at the threshold may count or not
                    yield pd.DataFrame({"rep": asked, "links": (sims >= s.threshold + 1e-12) @ n, "most": (sims >= s.threshold - 1e-12) @ n})

    truth = reps.select("rep", "label", "vec", "n").mapInPandas(brute, "rep long, links long, most long").groupBy("rep").agg(
        F.sum("links").alias("links"), F.sum("most").alias("most"))
    got = counts.groupBy("rep").agg(F.sum("found").alias("found"))
    both = truth.join(got, "rep", "left").join(reps.select("rep", "label"), "rep").withColumn("found", F.coalesce("found", F.lit(0)))
    share = F.when(F.col("found") < F.col("links"), F.col("found") / F.col("links")).when(
        F.col("found") > F.col("most"), F.col("most") / F.col("found")).otherwise(1.0)
    strata = both.groupBy("label", F.floor(F.log2(F.col("links") + 1)).alias("order")).agg(F.avg(share).alias("share"))
    return strata.agg(F.min("share")).first()[0]


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
                    settings: Settings = Settings()) -> DataFrame:
    """One row (vec_id, n_links, component_id, kept) per row of ``rows``.

    Vectors link if their labels are equal and not null and their cosine in
    double precision is at least the threshold.  A vector that is null, empty,
    zero or holds a null or non-finite component links with nothing, as do
    vectors of different length.  Equal vectors of a label are one node that
    counts as often as it occurs, so copies are not compared one by one.
    Repeated ids are rows of their own; ids are whole numbers; a null id names a
    component only if all its ids are null.  Other columns are not looked at, no
    rows give none.  Links are exact (none below the threshold); a link is missed
    only if no search leads from one leader to the other.  The audited recall is
    at least ``recall`` in every stratum, or the graphs are built again with more
    overlap, or the job fails.
    """
    ship(rows.sparkSession)
    s = settings
    vectors = cut(usable(rows, id_col, vector, label), "vectors")
    reps = vectors.filter("usable").groupBy("label", "vec").agg(
        F.count("*").alias("n"), F.min("vec_id").alias("first_id")).withColumn("rep", F.monotonically_increasing_id())
    reps = cut(reps, "vector_reps")
    blocks, centers = blocks_of(reps.select("rep", "n", "label", "vec"), s)
    for _ in range(s.tries):
        counts = link_counts(blocks, centers, s)
        if audit(reps, counts, s) >= s.recall:
            break
        s = replace(s, overlap=2 * s.overlap, slack=2 * s.slack, beam=2 * s.beam, pool=2 * s.pool, reach=2 * s.reach)
    else:
        raise ValueError("the graphs do not reach the asked recall")
    stars = components(counts.select(F.col("rep").alias("a"), F.col("least").alias("b")), "vector_components")
    named = classes(stars, reps.select(F.col("rep").alias("node"), "first_id")).select(F.col("node").alias("rep"), "component_id")
    found = counts.groupBy("rep").agg(F.sum("found").alias("found"))
    nodes = cut(reps.join(found, "rep", "left").join(named, "rep", "left").select(
        F.col("label").alias("node_label"), F.col("vec").alias("node_vec"),
        (F.coalesce("found", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component_id", "first_id").alias("component_id")), "vector_nodes")
    joined = vectors.join(nodes, F.col("usable") & (F.col("label") == F.col("node_label")) & (F.col("vec") == F.col("node_vec")), "left")
    component = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id"))
    return joined.select(
        F.col("vec_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every embedding."""
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


QUERIES = {"op5_vector_dedup": op5_vector_dedup}
SQL: dict[str, str] = {}
