"""Helpers shared by the operators: written intermediates, free column names, connected components."""

from __future__ import annotations

import os
import tempfile
import zipfile
from weakref import WeakSet

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from learnmart.functions import sizing
from learnmart.sources.workspace import workspace

#: White space of the word contracts: blank and the ASCII controls from tab to carriage return.
NOT_SPACE = r"[^\x20\x09-\x0D]"


def folder_for(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint folder."""
    folder = workspace(spark, name)
    if folder is None:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return folder


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lost executor costs nothing before this point."""
    spark = df.sparkSession
    folder = folder_for(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


_shipped: WeakSet = WeakSet()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once per Spark context (as ``--py-files`` does)."""
    context = spark.sparkContext
    if context in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "package.zip")  # the driver's file server hands it out
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, files in os.walk(package):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)
    _shipped.add(context)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names near ``names`` that ``df`` does not have, so that extra columns never clash."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` worked out once a row, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def small(df: DataFrame, most: int = sizing.BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` (a written table) if it is measured below ``most`` bytes; leave the join to AQE beyond."""
    return F.broadcast(df) if sizing.measured_bytes(df) <= most else df


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of ``n`` nodes under the links ``left[k]`` - ``right[k]``."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (node, root) for every linked node, root the smallest.

    Alternating star contraction: every round ties neighbours to the smallest
    one, so any graph becomes stars in a number of rounds near the logarithm of
    its diameter.  Every round is written to the shared folder.  Joins put the
    pre-aggregated minimum on one side; AQE splits the rows of a hot node.
    """
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    now, before = cut(ordered, name), None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if before == (mark.n, mark.s):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select(F.col("b"), F.col("b")).distinct())
        before = (mark.n, mark.s)
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large, name)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(star.union(least.select("a", "m")).distinct(), name)


def classes(stars: DataFrame, first_ids: DataFrame, name: str = "component_ids") -> DataFrame:
    """(node, component_id) of all nodes of ``stars`` (node, root): the smallest first_id of ``first_ids`` (node, first_id) in the component.

    A component may hold most nodes, so they are not dealt by their root: the
    minima are broadcast when measured small, and joined on salted roots beyond.
    """
    named = cut(stars.join(first_ids, "node").select("node", "root", "first_id"), f"{name}_named")
    least = cut(named.groupBy("root").agg(F.min("first_id").alias("component_id")), name)
    if sizing.measured_bytes(least) <= sizing.BROADCAST_BYTES:
        joined = named.join(F.broadcast(least), "root")
    else:
        joined = sizing.salted_join(named, least, "root")
    return joined.select("node", "component_id")
