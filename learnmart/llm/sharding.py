"""Shards along a Hilbert curve through several metadata dimensions, in built-in functions only."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from learnmart.llm.common import col, cut, let, small, table, unused

BITS = 5  # cells per dimension: 2 ** BITS
SHARDS = 40
LAWS = ("rows", "bytes")
DIGESTS, STEPS, ACCURACY = 64, 256, 1000  # groups that digests of quantiles meet in, quantiles that each hands on, accuracy of a digest


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """Position on the Hilbert curve of a cell with ``bits`` bits in each dimension.

    The published transpose method (Skilling 2004) as folds over the bits: undo
    the excess work from the highest bit down, Gray-encode, interleave.
    """
    n = len(cells)
    top = 1 << (bits - 1)
    axes = F.array(*[c.cast("int") for c in cells])
    steps = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for q in [1 << b] for i in range(n)])

    def undo(x: Column, step: Column) -> Column:
        p = step["q"] - 1
        at = F.get(x, step["i"])
        swap = F.get(x, F.lit(0)).bitwiseXOR(at).bitwiseAND(p)
        invert = at.bitwiseAND(step["q"]) != 0
        return F.transform(x, lambda v, k: F.when(invert, F.when(k == 0, v.bitwiseXOR(p)).otherwise(v))
                           .otherwise(F.when((k == 0) | (k == step["i"]), F.when(step["i"] == 0, v).otherwise(v.bitwiseXOR(swap))).otherwise(v)))

    def encode(x: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(n - 1)), x,
            lambda x, i: F.transform(x, lambda v, k: F.when(k == i, v.bitwiseXOR(F.get(x, i - 1))).otherwise(v)))

    def flips(gray: Column) -> Column:
        lower = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]).cast("array<int>")
        return F.aggregate(lower, F.lit(0), lambda t, q: F.when(
            F.get(gray, F.lit(n - 1)).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))

    order = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])

    def interleave(gray: Column, flip: Column) -> Column:
        return F.aggregate(order, F.lit(0).cast("long"), lambda h, s: h * 2 + F.when(
            F.get(gray, s["i"]).bitwiseXOR(flip).bitwiseAND(s["q"]) != 0, F.lit(1)).otherwise(F.lit(0)))

    turned = F.aggregate(steps.cast("array<struct<q:int,i:int>>"), axes, undo)
    gray = encode(turned) if n > 1 else turned
    return let(gray, lambda g: let(flips(g), lambda t: interleave(g, t)))


def _number(column: Column, kind: T.DataType, skip: int) -> Column:
    """A value as a double in the same order: a text by seven bytes after ``skip`` common ones."""
    if isinstance(kind, T.StringType):
        head = F.rpad(F.hex(F.substring(column.cast("binary"), skip + 1, 7)), 14, "0")
        return F.conv(head, 16, 10).cast("double")
    if isinstance(kind, (T.DateType, T.TimestampType)):
        return column.cast("timestamp").cast("double")
    return column.cast("double")


def quantiles(rows: DataFrame, values: list[Column], shares: list[float]) -> list[list[float]]:
    """Approximate quantiles of each of ``values`` over all rows, nulls left out; no values, no quantiles.

    Digests of the input tasks meet in ``DIGESTS`` groups, whose evenly spaced
    quantiles, weighted with the groups' counts, meet in the end: a bounded
    number however many tasks there are.
    """
    steps = [(k + 0.5) / STEPS for k in range(STEPS)]
    spread = F.pmod(F.spark_partition_id(), F.lit(DIGESTS))
    groups = rows.select(spread.alias("g"), *[v.alias(f"v{i}") for i, v in enumerate(values)]).groupBy("g").agg(
        *[F.percentile_approx(f"v{i}", steps, ACCURACY).alias(f"q{i}") for i in range(len(values))],
        *[F.count(f"v{i}").alias(f"n{i}") for i in range(len(values))])
    found = cut(groups, "quantiles")  # DIGESTS rows of STEPS numbers for each value
    out = []
    for i in range(len(values)):
        weighted = found.filter(f"n{i} > 0").select(F.explode(f"q{i}").alias("v"), F.col(f"n{i}").alias("n"))
        out.append(weighted.agg(F.percentile("v", shares, F.col("n")).alias("q")).first().q or [])
    return out


def cells(rows: DataFrame, dimensions: list[str], bits: int = BITS) -> list[Column]:
    """The cell of each dimension: how many of the 2 ** bits - 1 quantiles of all rows lie below the value; null is 0.

    Common prefixes are a bounded aggregate over all rows, quantiles one in two levels.
    """
    kinds = {d: rows.schema[d].dataType for d in dimensions}
    texts = [d for d in dimensions if isinstance(kinds[d], T.StringType)]
    ends = rows.agg(F.lit(1), *[f(col(d)).cast("binary").alias(f"{n}{i}") for i, d in enumerate(texts) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    skip = {d: len(os.path.commonprefix([bytes(ends[f"lo{i}"] or b""), bytes(ends[f"hi{i}"] or b"")])) for i, d in enumerate(texts)}
    numbers = {d: _number(col(d), kinds[d], skip.get(d, 0)) for d in dimensions}
    shares = [k / 2**bits for k in range(1, 2**bits)]
    marks = quantiles(rows, [numbers[d] for d in dimensions], shares)
    out = []
    for i, d in enumerate(dimensions):
        bounds = sorted(marks[i])
        marks_of = F.array(*map(F.lit, bounds)).cast("array<double>")
        below = let(numbers[d], lambda v: F.size(F.filter(marks_of, lambda b: b < v)))
        out.append(F.when(numbers[d].isNull(), 0).otherwise(below))
    return out


def assign_shards(rows: DataFrame, dimensions: list[str], tie: list[str], shards: int = SHARDS, law: str = "rows",
                  size: str | None = None, bits: int = BITS) -> DataFrame:
    """``rows`` with ``curve``, ``shard`` and ``slot``: sorted along the curve and cut into runs.

    ``rows`` should be a written table, it is read several times.  Within a cell
    rows go by the columns ``tie``; rows equal in all of them are in any order.
    Under the law ``rows`` shards' counts differ by one at most; under ``bytes``
    a row lies where the middle of its ``size`` lies in the whole, so shards
    differ by about a row's size.  Nulls share the first cell of a dimension.
    Columns named like a result are replaced.  No rows give none; fewer rows
    than shards leave shards empty.

    The rows are range-partitioned by curve and tie columns (a hot cell is split
    by the ties) and written; sums per partition, one row each, give every
    partition its start, so no task sees all rows.
    """
    if law not in LAWS:
        raise ValueError(f"law {law}")
    keep = [c for c in rows.columns if c.lower() not in ("curve", "shard", "slot")]
    part, before, at, total, place, weight, lead, ahead = unused(
        rows, "part", "before", "at", "total", "place", "weight", "lead", "ahead")
    curved = rows.select(*map(col, keep), hilbert_index(cells(rows, dimensions, bits), bits).alias("curve"))
    keys = [col("curve"), *map(col, tie)]
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = curved.repartitionByRange(partitions, *keys).withColumn(part, F.spark_partition_id())
    dealt = cut(dealt.withColumn(weight, col(size).cast("long") if law == "bytes" else F.lit(1).cast("long")), "curve")
    sums = dealt.groupBy(part).agg(F.sum(weight).alias(total))
    starts = sums.select(
        F.col(part).alias(before),
        (F.sum(total).over(Window.orderBy(part)) - F.col(total)).alias(at),  # a row per partition
        F.sum(total).over(Window.partitionBy()).alias(total))
    placed = dealt.join(small(cut(starts, "curve_starts")), F.col(part) == F.col(before))
    running = Window.partitionBy(part).orderBy(*keys)
    # twice the middle of a row under bytes, its rank under rows
    upto = F.sum(weight).over(running.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col(at)
    if law == "rows":
        ranked = placed.withColumn(place, upto - 1)
        shard = F.expr(f"`{place}` * {shards} div `{total}`")
        first = F.expr(f"(shard * `{total}` + {shards - 1}) div {shards}")
        return ranked.withColumn("shard", shard.cast("int")).select(
            *map(col, keep), "curve", "shard", (F.col(place) - first).cast("long").alias("slot"))
    middle = placed.withColumn(place, 2 * upto - F.col(weight))
    cutting = middle.withColumn("shard", F.least(F.expr(f"`{place}` * {shards} div (2 * `{total}`)"), F.lit(shards - 1)).cast("int"))
    held = cut(cutting.withColumn(at, F.row_number().over(running)), "curve_shards")
    counts = cut(held.groupBy("shard", part).agg(F.min(at).alias(total), F.count("*").alias(weight)), "curve_counts")
    earlier = counts.select(
        F.col("shard").alias(place), F.col(part).alias(before), F.col(total).alias(lead),
        (F.sum(weight).over(Window.partitionBy("shard").orderBy(part)) - F.col(weight)).alias(ahead))
    joined = held.select(*map(col, keep), "curve", "shard", part, at).join(
        small(cut(earlier, "curve_ahead")), (F.col("shard") == F.col(place)) & (F.col(part) == F.col(before)))
    return joined.select(*map(col, keep), "curve", "shard", (F.col(at) - F.col(lead) + F.col(ahead)).cast("long").alias("slot"))


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order: files hold a stretch of the curve, so their statistics prune."""
    assigned.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards along the curve through language, source and length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = cut(docs.select("doc_id", "lang", "source", (F.octet_length(body) + 16).cast("long").alias("size"),
                             F.crc32(body).alias("text_crc32")), "shard_rows")
    found = assign_shards(narrow, ["lang", "source", "size"], ["text_crc32", "doc_id"], SHARDS, "rows")
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op2_hilbert_shards": op2_hilbert_shards}
SQL: dict[str, str] = {}
