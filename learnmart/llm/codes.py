"""Vector codes: parts of vectors written as the index of the nearest codebook entry, found by pivot distances.

Distances of all parts to a few fixed pivots are worked out once and stored.  In every round the distances of the
codebook's entries to the same pivots bound each distance of a part to an entry from below; entries are looked
at in the order of these bounds and only until none can be nearer, by exact whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from learnmart.llm.common import col, cut, ship, small, table

SCALE = 256
MOST = 2.0 ** 27  # components (whole numbers) beyond this have squares whose sums a long may not hold


@dataclass(frozen=True)
class Settings:
    parts: int = 16
    entries: int = 64
    rounds: int = 2
    pivots: int = 4  # fixed points of each part position


def finite(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return F.coalesce(~F.exists(vector, bad), F.lit(False))


def floored(rows: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, vec) of the kept rows, components floor(SCALE * x); written."""
    good = rows.filter(finite(col(vector)) & (F.size(col(vector)) > 0))
    whole = F.transform(col(vector), lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(2.0 ** 62)), F.lit(-(2.0 ** 62)))))
    kept = good.select(col(id_col).cast("long").alias("vec_id"), col(label).cast("string").alias("label"), whole.alias("vec"))
    return cut(kept, "code_rows")


def common_length(kept: DataFrame, s: Settings) -> int | None:
    """The one length of the kept vectors, a multiple of ``parts``; None without rows."""
    sizes = kept.agg(F.min(F.size("vec")).alias("low"), F.max(F.size("vec")).alias("high"),
                     F.max(F.array_max(F.transform("vec", F.abs))).alias("most")).first()
    if sizes.low is None:
        return None
    if sizes.low != sizes.high or sizes.low % s.parts:
        raise ValueError(f"vectors must have one length that {s.parts} divides, not {sizes.low} to {sizes.high}")
    if sizes.most * (sizes.low // s.parts) ** 0.5 > MOST:
        raise ValueError("components are too large for exact distances")
    return sizes.low


def first_entries(kept: DataFrame, s: Settings) -> np.ndarray:
    """The vectors of the smallest ids, cut into parts: (parts, entries, components)."""
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(s.entries).select("vec").collect()  # ``entries`` rows by definition
    books = np.array([r.vec for r in rows], np.int64)
    return books.reshape(len(books), s.parts, -1).transpose(1, 0, 2).copy()


def choose_pivots(books: np.ndarray, count: int) -> np.ndarray:
    """For each part position, entries far from one another: the first, then again and again the one farthest from those chosen."""
    out = []
    for book in books:
        chosen = [0]
        far = ((book - book[0]) ** 2).sum(1)
        while len(chosen) < min(count, len(book)):
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((book - book[chosen[-1]]) ** 2).sum(1))
        out.append(book[chosen])
    return np.stack(out)


def squares(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact squared distances of every point to every other."""
    out = np.zeros((len(points), len(others)), np.int64)
    for d in range(points.shape[1]):
        out += (points[:, d, None] - others[None, :, d]) ** 2
    return out


def nearest(points: np.ndarray, known: np.ndarray, book: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry (ties to the lower index) and exact squared distance of every point, and how many distances it took.

    ``known`` are the points' distances to the pivots.  No entry can be nearer
    than the largest difference of its distance to a pivot and the point's.
    """
    between = np.sqrt(squares(book, pivots))
    bound = np.abs(known[:, 0, None] - between[None, :, 0])
    for p in range(1, len(pivots)):
        np.maximum(bound, np.abs(known[:, p, None] - between[None, :, p]), out=bound)
    order = np.argsort(bound, axis=1, kind="stable")
    # squared bounds less what rounding may add: whole distances below them are certain
    sure = np.take_along_axis(bound, order, 1) ** 2 * (1 - 1e-9) - 0.25
    active = np.arange(len(points))
    best = np.full(len(points), np.iinfo(np.int64).max)
    entry = np.full(len(points), len(book), np.int64)
    taken = 0
    for k in range(len(book)):
        active = active[sure[active, k] <= best[active]]
        if not len(active):
            break
        e = order[active, k]
        exact = ((points[active] - book[e]) ** 2).sum(1)
        taken += len(active)
        better = (exact < best[active]) | ((exact == best[active]) & (e < entry[active]))
        best[active[better]], entry[active[better]] = exact[better], e[better]
    return entry, best, taken


def _vectors(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def with_pivot_distances(kept: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``kept`` with ``known``: each part's distances to the pivots of its position, worked out once; written."""
    parts, count, width = pivots.shape

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = _vectors(batch, "vec", parts * width).reshape(-1, parts, width)
            known = np.stack([np.sqrt(squares(vecs[:, p], pivots[p])) for p in range(parts)], 1).reshape(len(vecs), -1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(vecs) + 1) * parts * count, pa.int32()), pa.array(known.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "known"])

    return cut(kept.mapInArrow(measure, "vec_id long, label string, vec array<long>, known array<double>"), "code_distances")


def _assigned(batch: pa.RecordBatch, books: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts of a batch's vectors, their entries and squared distances."""
    parts, count, width = pivots.shape
    vecs = _vectors(batch, "vec", parts * width).reshape(-1, parts, width)
    known = _vectors(batch, "known", parts * count).reshape(-1, parts, count)
    found = [nearest(vecs[:, p], known[:, p], books[p], pivots[p])[:2] for p in range(parts)]
    return vecs, np.stack([e for e, _ in found], 1), np.stack([d for _, d in found], 1)


def next_entries(measured: DataFrame, books: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """One round: every entry becomes the floored mean of its parts; one without parts stays.

    Tasks hand on sums and counts, a row per part position and entry at most.
    """
    parts, entries, width = books.shape

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), object), np.zeros((parts, entries), np.int64)
        for batch in batches:
            vecs, entry, _ = _assigned(batch, books, pivots)
            for p in range(parts):
                counts[p] += np.bincount(entry[:, p], minlength=entries)
                own = np.zeros((entries, width), np.int64)
                np.add.at(own, entry[:, p], vecs[:, p])  # a batch's sums fit a long
                sums[p] += own
        p, e = np.nonzero(counts)
        if len(p):
            flat = [Decimal(int(x)) for x in sums[p, e].ravel()]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * width, pa.int32()), pa.array(flat, pa.decimal128(38, 0)))
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(counts[p, e]), lists], ["part", "entry", "n", "sums"])

    rows = measured.select("vec", "known").mapInArrow(total, "part long, entry long, n long, sums array<decimal(38,0)>")
    means = rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(d))) for d in range(width)]).alias("sums"))
    out = books.copy()
    for r in means.collect():  # parts * entries rows
        out[r.part, r.entry] = [int(x) // r.n for x in r.sums]
    return out


def write_codes(measured: DataFrame, books: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """(vec_id, label, entries, error) of every vector; entries by part, errors summed over the parts."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, entry, exact = _assigned(batch, books, pivots)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(entry) + 1) * entry.shape[1], pa.int32()), pa.array(entry.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), lists, pa.array(exact.sum(1))],
                                             ["vec_id", "label", "entries", "error"])

    return cut(measured.mapInArrow(encode, "vec_id long, label string, entries array<long>, error long"), "codes")


def book_text(books: np.ndarray) -> str:
    return ",".join(map(str, books.ravel().tolist()))


def compress(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
             settings: Settings = Settings()) -> tuple[DataFrame, np.ndarray | None]:
    """Codes (vec_id, label, entries, error) of the kept rows, and the codebooks (parts, entries, components).

    Components become floor(256 * x).  Vectors that are null or empty or hold a
    null or non-finite component are dropped; the others must have one length
    that ``parts`` divides, and components whose squares a long can sum, or the
    job fails.  The codebooks start from the smallest ids (null ids last, equal
    ids by vector), fewer rows make shorter ones; equal entries are told apart by
    index only.  Repeated rows count as often as they occur, other columns are
    not looked at, no rows give none and no codebooks.
    """
    ship(rows.sparkSession)
    s = settings
    kept = floored(rows, id_col, vector, label)
    if common_length(kept, s) is None:
        return kept.select("vec_id", "label", F.array().cast("array<long>").alias("entries"), F.lit(0).cast("long").alias("error")), None
    books = first_entries(kept, s)
    pivots = choose_pivots(books, s.pivots)
    measured = with_pivot_distances(kept, pivots)
    for _ in range(s.rounds):
        books = next_entries(measured, books, pivots)
    return write_codes(measured, books, pivots), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code and error of every embedding, with its label's error and the codebooks' digest."""
    coded, books = compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    sums = cut(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label_errors").select(
        F.col("label").alias("of_label"), "label_error")
    digest = hashlib.sha256(book_text(books).encode()).hexdigest() if books is not None else None
    code = F.array_join(F.transform("entries", lambda e: F.lower(F.lpad(F.hex(e), 2, "0"))), "")
    return coded.join(small(sums), F.col("label").eqNullSafe(F.col("of_label"))).select(
        "vec_id", code.alias("code"), "error", "label_error", F.lit(digest).cast("string").alias("codebooks_sha256"))


QUERIES = {"op13_vector_codes": op13_vector_codes}


def _sql_round(number: int) -> str:
    """Assignment to the books of a round and the books that follow."""
    return f"""
        near{number} AS (
            SELECT p.vec_id, p.part, arg_min(b.entry, d * 64 + b.entry) AS entry, min(d) AS d
            FROM parts p JOIN books{number} b USING (part),
                 LATERAL (SELECT list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d)
            GROUP BY p.vec_id, p.part),
        means{number} AS (
            SELECT part, entry, list(m ORDER BY k) AS v
            FROM (SELECT n.part, n.entry, k, floor(sum(p.v[k]) / count(*)::DOUBLE)::BIGINT AS m
                  FROM near{number} n JOIN parts p USING (vec_id, part), range(1, len(p.v) + 1) r(k) GROUP BY n.part, n.entry, k)
            GROUP BY part, entry),
        books{number + 1} AS (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM books{number} b LEFT JOIN means{number} m USING (part, entry))"""


SQL = {
    "op13_vector_codes": f"""
        WITH kept AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS (
            SELECT vec_id, part, v[part * (len(v) // 16) + 1:(part + 1) * (len(v) // 16)] AS v
            FROM kept, range(16) r(part)),
        first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 64),
        books0 AS (SELECT p.part, f.entry, p.v FROM first f JOIN parts p USING (vec_id)),
        {_sql_round(0)}, {_sql_round(1)}, {_sql_round(2)},
        codes AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near2 GROUP BY vec_id),
        text AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS h FROM books2)
        SELECT c.vec_id, c.code, c.error, sum(c.error) OVER (PARTITION BY k.label)::BIGINT AS label_error, t.h AS codebooks_sha256
        FROM codes c JOIN kept k USING (vec_id), text t
    """,
}
