"""Mixing sources to target weights: repetition rates per source, copies per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from learnmart.llm.common import NOT_SPACE, col, cut, small, table, unused

WEIGHTS = (3, 1, 2)
SHARE = 3, 2  # targets share 3/2 of all sizes
MOST = 2  # a target is at most this many times its source
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of words (runs outside ASCII white space); null has none."""
    marks = F.regexp_replace(text, f"{NOT_SPACE}++", "x")
    return F.coalesce(F.length(F.regexp_replace(marks, r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def draw(key: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the hash of a document's id and text, the same in every run."""
    body = F.md5(F.coalesce(text, F.lit("")))
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(key.cast("string"), F.lit("")), body))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def rates(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """Targets of sources: (source, source_size) to (source, source_size, target, rate).

    Sources in code point order, null last, get the weights in turn.  Together
    the targets make ``share`` of all sizes, by weight; a target stops at
    ``most`` times its source and the excess is shared among the others until
    none is above.  That is one level: in the order of cap per weight, the
    sources before it are at their cap.  Sources of size 0 have target and
    rate 0.  The input has one row per source.
    """
    up, down = share
    ranked = sizes.withColumn("n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    pick = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(F.col("n") - 1, len(weights)) + 1).cast("int"))
    ranked = ranked.withColumn("weight", pick)
    # cap / weight ascending; source breaks ties for a fixed order
    order = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("n"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = ranked.select(
        "*",
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("capped"),
        F.sum("weight").over(after).alias("open"),
        F.sum("source_size").over(Window.partitionBy()).alias("total"),
    )
    # with everything before this source at its cap: (up/down * total - most * capped) / open per unit of weight
    room = F.lit(up).cast("long") * F.col("total") - F.lit(down * most).cast("long") * F.col("capped")
    free = F.lit(down * most).cast("long") * F.col("source_size") * F.col("open") > room * F.col("weight")
    first = F.min(F.when(free, F.struct(F.col("source_size") / F.col("weight"), "n", "capped", "open"))).over(Window.partitionBy())
    solved = level.select("source", "source_size", "weight", "total", first.alias("first"))
    room = F.lit(up).cast("long") * F.col("total") - F.lit(down * most).cast("long") * F.col("first.capped")
    level_target = (room * F.col("weight")) / (F.lit(down).cast("long") * F.col("first.open"))
    cap = (F.lit(most).cast("long") * F.col("source_size")).cast("double")
    target = F.coalesce(F.least(cap, level_target), cap)
    return solved.select("source", "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def plan_mix(docs: DataFrame, size: Column, chance: Column, source: str = "source",
             weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST,
             prefix: str = "") -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``rate`` and ``copies``.

    A document gets floor(rate) copies and one more if ``chance`` is below the
    fraction.  Sizes are summed per source in the tasks before they meet; null
    is a source of its own.  Nothing is dropped here (copies may be 0); repeated
    rows draw alike.  The new columns' names begin with ``prefix``; input columns
    of the same name are replaced.  No rows give none.
    """
    results = [prefix + name for name in ("size", "source_size", "target", "rate", "copies")]
    keep = [c for c in docs.columns if c.lower() not in results]
    words, luck, key, missing = unused(docs, "words", "luck", "key", "missing")
    sized = docs.select(*map(col, keep), size.alias(words), chance.alias(luck))
    totals = sized.groupBy(col(source).alias("source")).agg(F.sum(col(words)).alias("source_size"))
    (row,) = unused(docs, "row")
    planned = cut(rates(totals, weights, share, most), "mix_rates").select(
        F.coalesce("source", F.lit("")).alias(key), F.isnull("source").alias(missing),
        F.struct("source_size", "target", "rate").alias(row))
    on = [F.coalesce(col(source), F.lit("")) == col(key), F.isnull(col(source)) == col(missing)]
    joined = sized.join(small(planned), on)
    rate = F.col(f"`{row}`.rate")
    copies = (F.floor(rate) + F.when(col(luck) < rate - F.floor(rate), 1).otherwise(0)).cast("long")
    found = (col(words), F.col(f"`{row}`.source_size"), F.col(f"`{row}`.target"), rate, copies)
    return joined.select(*map(col, keep), *[c.alias(name) for c, name in zip(found, results)])


def emit(planned: DataFrame, columns: list[str], copies: str = "copies") -> DataFrame:
    """Every document as often as planned."""
    (copy,) = unused(planned, "copy")
    many = planned.filter(col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), col(copies))))
    return many.select(*map(col, columns))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    narrow = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("words"),
                             draw(F.col("doc_id"), F.col("text")).alias("chance")), "mix_sizes")
    planned = plan_mix(narrow, F.col("words"), F.col("chance"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


QUERIES = {"op6_mixing": op6_mixing}

SQL = {
    "op6_mixing": f"""
        WITH d AS (
            SELECT doc_id, source,
                   coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
                   ('0x' || substr(md5(concat_ws('|', '{SEED}', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))), 1, 13))::BIGINT
                       / 4503599627370496.0::DOUBLE AS chance
            FROM documents),
        s AS (
            SELECT source, source_size, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::BIGINT AS weight
            FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
        -- the highest level at which the caps and the open sources together make no more than the whole
        c AS (
            SELECT (SELECT sum(source_size) FROM s)::BIGINT AS total, x.source_size * 1.0 / x.weight AS ratio,
                   coalesce((SELECT sum(y.source_size) FROM s y WHERE y.source_size * x.weight < x.source_size * y.weight), 0)::BIGINT AS capped,
                   (SELECT sum(y.weight) FROM s y WHERE y.source_size * x.weight >= x.source_size * y.weight)::BIGINT AS open,
                   x.source_size AS xs, x.weight AS xw
            FROM s x),
        f AS (SELECT total, capped, open FROM c WHERE 4 * xs * open > (3 * total - 4 * capped) * xw ORDER BY ratio LIMIT 1),
        t AS (
            SELECT source, source_size,
                   CASE WHEN f.open IS NULL THEN (2 * source_size)::DOUBLE
                        ELSE least((2 * source_size)::DOUBLE, ((3 * f.total - 4 * f.capped) * weight)::DOUBLE / (2 * f.open)) END AS target
            FROM s LEFT JOIN f ON true),
        r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t)
        SELECT doc_id, size, source_size, target,
               size * (floor(rate) + CASE WHEN chance < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS taken
        FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
    """,
}
