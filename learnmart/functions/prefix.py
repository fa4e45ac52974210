"""Ranks and running sums over all rows without a task that sees them all."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from learnmart.model import Tables


def ranked_totals(t: Tables, rows: DataFrame, value: str, tie: str) -> DataFrame:
    """``rows`` with ``rank`` by descending ``value``, ``running`` (its sum down to the row, equal values by ``tie``) and ``total``.

    Rows are range-partitioned and numbered inside their partition; a row per
    partition gives every partition what lies before it.  Equal values that go
    on over several partitions have the rank at which the first of them begins.
    """
    at, within = F.col("_part"), Window.partitionBy("_part").orderBy(F.desc(value), tie)
    placed = t.cut("ranges", rows.repartitionByRange(F.desc(value), F.col(tie)).withColumn("_part", F.spark_partition_id()))
    local = t.cut("ranked", placed.withColumn("_rank", F.rank().over(Window.partitionBy("_part").orderBy(F.desc(value)))).withColumn(
        "_running", F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    parts = local.groupBy("_part").agg(
        F.count("*").alias("n"), F.sum(value).alias("held"), F.max(value).alias("first"), F.min(value).alias("last"), F.max("_rank").alias("last_rank"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    parts = t.cut("ranges", parts.select(
        at, "first", "last",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_ahead"),
        F.coalesce(F.sum("held").over(before), F.lit(0)).alias("_sum"),
        F.sum("held").over(Window.partitionBy()).alias("total"),
        (F.coalesce(F.sum("n").over(before), F.lit(0)) + F.col("last_rank")).alias("begins")))
    earlier = parts.select(F.col("_part").alias("_earlier"), F.col("last").alias("_value"), "begins")
    carried = parts.select(at, "first").join(earlier, (F.col("first") == F.col("_value")) & (F.col("_earlier") < at)).groupBy("_part").agg(
        F.min("begins").alias("_begins"))
    known = F.broadcast(parts.join(carried, "_part", "left").select("_part", "first", "_ahead", "_sum", "total", "_begins"))
    joined = local.join(known, "_part")
    rank = F.when((F.col(value) == F.col("first")) & F.col("_begins").isNotNull(), F.col("_begins")).otherwise(F.col("_ahead") + F.col("_rank"))
    return joined.select(*rows.columns, rank.cast("long").alias("rank"), (F.col("_sum") + F.col("_running")).alias("running"), "total")
