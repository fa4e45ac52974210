"""Near duplicates by SimHash: fingerprints of word shingles and a tiled exact comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from learnmart.llm.common import classes as component_ids
from learnmart.llm.common import col, components, cut, roots, ship, small, table, unused

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
PARTS = 4  # the 64 bits count in four groups of 16
TILE = 2048  # fingerprints of a tile: a comparison holds TILE * TILE words of 8 bytes
BLOCK = 1 << 18  # shingles hashed at a time


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of ``text``: bit i is set if more than half of the shingle hashes have it.

    A-Z are lower-cased, words are split at ASCII white space, shingles are
    counted as often as they occur; fewer words make one shingle, none zero.
    """
    parts = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        end = min(n, at + BLOCK)
        hashes = np.fromiter((digest(b" ".join(parts[i:i + words]), SEED) for i in range(at, end)), "<u8", end - at)
        for start in range(0, end - at, 8192):  # 64 bytes a hash while counting
            bits = np.unpackbits(hashes[start:start + 8192].view(np.uint8), bitorder="little").reshape(-1, 64)
            ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fp", words: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with the fingerprint as a signed long."""
    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x, words) for x in texts], np.uint64).view(np.int64))

    return docs.withColumn(name, of(col(text)))


def counts_key(parts: int = PARTS):
    """Population counts of the bit groups as one number with five binary digits or more for each."""
    width = 64 // parts
    mask = (1 << width) - 1
    key = F.lit(0).cast("long")
    for i in range(parts):
        group = F.shiftrightunsigned(F.col("fp"), i * width).bitwiseAND(F.lit(mask))
        key = key + F.bit_count(group).cast("long") * F.lit(1 << (6 * i))
    return key


def offsets(radius: int, parts: int = PARTS) -> list[int]:
    """Differences of counts within ``radius`` in all, one of each pair of opposite ones, as differences of keys.

    Two fingerprints that differ in r bits differ by at most r in the sum of the
    differences of their groups' population counts.
    """
    steps = [d for d in product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, d)) <= radius]
    return sorted(k for d in steps if (k := sum(x << (6 * i) for i, x in enumerate(d))) >= 0)


def tiles(prints: DataFrame, parts: int = PARTS, tile: int = TILE) -> DataFrame:
    """Distinct fingerprints in rows (key, chunk, fps) of about ``tile``.

    A key is cut into as many chunks as its count needs, so no row grows with
    the data.
    """
    keyed = prints.select("fp", counts_key(parts).alias("key"))
    sizes = keyed.groupBy("key").agg(F.ceil(F.count("*") / tile).cast("long").alias("n_chunks"))
    # at most 17 ** 4 keys (4 groups of 16 bits), 16 bytes each
    rows = keyed.join(F.broadcast(sizes), "key") if parts <= 4 else keyed.join(sizes, "key")
    return rows.groupBy("key", F.pmod(F.xxhash64("fp"), F.col("n_chunks")).alias("chunk")).agg(
        F.collect_list("fp").alias("fps"))


def tile_links(pairs: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Links of tile pairs: not all pairs, but for each linked fingerprint the smallest it reaches in its tile pair."""
    for batch in pairs:
        found: list[np.ndarray] = []
        for left, right in zip(batch["left_fps"], batch["right_fps"]):
            a, b = np.asarray(left, np.int64).view(np.uint64), np.asarray(right, np.int64).view(np.uint64)
            for s in range(0, len(a), TILE):
                for t in range(0, len(b), TILE):
                    x, y = a[s:s + TILE], b[t:t + TILE]
                    i, j = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
                    if len(i):
                        both = np.concatenate([x, y])
                        root = roots(len(both), i, j + len(x))
                        linked = root != np.arange(len(both))
                        found.append(np.stack([both[linked], both[root[linked]]]).view(np.int64))
        if found:
            a, b = np.concatenate(found, axis=1)
            out = pd.DataFrame({"a": a, "b": b})
            yield out[out.a != out.b].drop_duplicates()


def links(tiled: DataFrame, radius: int = MAX_BITS, parts: int = PARTS) -> DataFrame:
    """Links (a, b) that connect all fingerprints within ``radius`` bits, each tile pair reduced to a forest."""
    steps = F.array(*[F.lit(k).cast("long") for k in offsets(radius, parts)])
    left = tiled.select(F.col("key").alias("left_key"), F.col("chunk").alias("left_chunk"), F.col("fps").alias("left_fps"))
    left = left.withColumn("key", F.explode(F.transform(steps, lambda k: k + F.col("left_key"))))
    right = tiled.select("key", F.col("chunk").alias("right_chunk"), F.col("fps").alias("right_fps"))
    pairs = left.join(right, "key").filter("left_key <> key or left_chunk <= right_chunk")
    return pairs.select("left_fps", "right_fps").mapInPandas(lambda it: tile_links(it, radius), "a long, b long")


def classes(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Component of every distinct fingerprint of ``prints`` (id, fp): (fp, component_id), component_id the smallest id."""
    distinct = cut(prints.groupBy("fp").agg(F.min("id").alias("first_id")), "distinct_fingerprints")
    stars = components(links(cut(tiles(distinct), "tiles"), max_bits), "simhash")
    linked = component_ids(stars, distinct.select(F.col("fp").alias("node"), "first_id")).select(F.col("node").alias("fp"), "component_id")
    every = distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return cut(every, "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """One row (id, fp, component_id) per row of ``docs``; component_id is the smallest id reachable by links.

    Fingerprints link at ``max_bits`` or fewer differing bits; equal ones are one
    node.  Texts without a word (null, empty, blank) have fingerprint zero and
    link like any other.  A null id is ignored as a component's name unless all
    its ids are null.  Repeated rows are repeated in the result, no rows give
    none, other columns are not looked at.
    """
    prints = cut(fingerprints(docs.select(col(id_col).alias("id"), col(text).alias("text")), "text", "fp", words)
                 .select("id", "fp"), "fingerprints")
    return prints.join(classes(prints, max_bits), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS,
          max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` with one of each component: that with the smallest id (null ids last).

    Cases are as in ``near_duplicates``.  Of rows with the component's smallest
    id, which only repeated ids can give, the one with the smallest fingerprint
    and then text hash stays; of rows with equal id and text one.  Decisions are
    made on ids, fingerprints and text hashes alone; the rows themselves are then
    read again and stay where they are while those to drop are few enough to be
    broadcast by their measured size.
    """
    digest, gone, same, row = unused(docs, "digest", "gone", "same", "row")
    text_hash = F.xxhash64(F.coalesce(col(text), F.lit("")))
    narrow = docs.select(col(id_col).alias("id"), col(text).alias("text"), text_hash.alias("digest"))
    prints = cut(fingerprints(narrow, "text", "fp", words).select("id", "fp", "digest"), "fingerprints")
    named = prints.join(classes(prints.select("id", "fp"), max_bits), "fp")
    # component_id is null only where all ids are: then the component goes by its own fingerprint
    best = named.groupBy("component_id", F.when(F.isnull("component_id"), F.col("fp")).alias("other")).agg(
        F.min(F.struct(F.isnull("id").alias("missing"), F.col("id"), F.col("fp"), F.col("digest"))).alias("best"))
    stay = best.select(F.col("best.id").alias("best_id"), F.col("best.digest").alias("best_digest"))
    rows = prints.groupBy("id", "digest").agg(F.count("*").alias("n"))
    judged = cut(rows.join(stay, F.col("id").eqNullSafe(F.col("best_id")) & (F.col("digest") == F.col("best_digest")), "left").select(
        "id", "digest", "n", F.col("best_digest").isNotNull().alias("stays")), "judged")

    def pairs(which: str) -> DataFrame:
        return judged.filter(which).select(F.col("id").alias(gone), F.col("digest").alias(same))

    marked = docs.withColumn(digest, text_hash)
    on = col(id_col).eqNullSafe(col(gone)) & (col(digest) == col(same))
    kept = marked.join(small(cut(pairs("not stays"), "dropped")), on, "left_anti")
    repeated = cut(pairs("stays and n > 1"), "repeated")
    if repeated.isEmpty():
        return kept.select(*map(col, docs.columns))
    # equal rows: one stays
    twice = kept.join(small(repeated), on, "left_semi")
    first = twice.withColumn(row, F.row_number().over(Window.partitionBy(col(id_col), col(digest)).orderBy(F.lit(0)))).filter(col(row) == 1)
    return kept.join(small(repeated), on, "left_anti").select(*map(col, docs.columns)).union(first.select(*map(col, docs.columns)))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash": op8_simhash}
SQL: dict[str, str] = {}
