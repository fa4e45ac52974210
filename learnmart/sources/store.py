"""Versioned parquet snapshots.

A commit writes new folders and publishes them by writing one small manifest
last; readers resolve tables through the newest manifest, so they see the old
rows until the new ones are complete, and a lost writer leaves nothing visible.
Folders of older versions are never touched.

A table is either whole (one folder a version, and one for each append) or keyed:
dealt by a hash of some columns into parts, each a folder of its own.  A batch of
changed rows writes new folders for the parts it falls in and no others.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from learnmart.functions import sizing
from learnmart.model import Tables

MANIFEST = ("version long, tables map<string,array<string>>, "
            "keyed map<string,struct<by:array<string>,keys:array<string>,schema:string,folders:array<string>>>, written_at timestamp")
PART_BYTES = 64 * 1024 * 1024  # of a part, in expectation, when a keyed table is written
SCAN_KEYS = 500  # keys that one scan is given as a filter
LOOKUP_KEYS = 8 * SCAN_KEYS  # more are looked up by whole parts
PAGE_ROWS = 1_000  # rows of a parquet page in keyed tables: what a lookup reads for one key


@dataclass(frozen=True)
class Layout:
    """``by``: columns that decide a row's part; ``keys``: columns whose rows a change replaces (``by`` or more)."""

    by: tuple[str, ...]
    keys: tuple[str, ...] = ()
    parts: int | None = None  # from the rows' size if not given

    @property
    def replaced_by(self) -> tuple[str, ...]:
        return self.keys or self.by


@dataclass(frozen=True)
class Replacement:
    """New rows of a keyed table for all of ``keys`` (a frame; by default those of the rows): other rows of these keys go."""

    rows: DataFrame
    keys: DataFrame | None = None


def key_hash(columns: tuple[str, ...] | list[str]) -> Column:
    """The hash a part is chosen by; ids hash alike whether they are numbers or text."""
    return F.xxhash64(*[F.col(c).cast("string") for c in columns])


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # -- what is published ------------------------------------------------------------
    def _newest(self):
        try:
            rows = self.spark.read.schema(MANIFEST).json(f"{self.root}/manifest/*").orderBy(F.desc("version")).limit(1).collect()
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            rows = []
        return (rows[0]["version"], dict(rows[0]["tables"] or {}), dict(rows[0]["keyed"] or {})) if rows else (0, {}, {})

    def manifest(self) -> tuple[int, dict[str, list[str]]]:
        """The version, and the folders of every table."""
        version, tables, keyed = self._newest()
        return version, tables | {name: [f for f in k["folders"] if f] for name, k in keyed.items()}

    def layouts(self) -> dict[str, Layout]:
        """The layout of every keyed table."""
        return {name: Layout(tuple(k["by"]), tuple(k["keys"]), len(k["folders"])) for name, k in self._newest()[2].items()}

    def part_folders(self, name: str) -> list[str | None]:
        return list(self._newest()[2][name]["folders"])

    def read(self, name: str) -> DataFrame:
        _, tables, keyed = self._newest()
        return self._parts(keyed[name], keyed[name]["folders"]) if name in keyed else self.spark.read.parquet(*tables[name])

    def tables(self, as_of: datetime) -> Tables:
        _, tables, keyed = self._newest()
        return Tables(self.spark, {name: self.read(name) for name in [*tables, *keyed]}, as_of)

    # -- commits ---------------------------------------------------------------------
    def commit(self, frames: dict[str, DataFrame] | None = None, at: datetime | None = None, partition_by: dict[str, list[str]] | None = None,
               layouts: dict[str, Layout] | None = None, replace: dict[str, Replacement] | None = None,
               appends: dict[str, DataFrame] | None = None) -> int:
        """One new version of the store.

        ``frames``: whole new versions of tables, keyed if they have one of
        ``layouts``.  ``replace``: changed rows of keyed tables.  ``appends``: more
        rows of whole tables.  All other tables and parts stay as they are.
        """
        version, tables, keyed = self._newest()
        version += 1
        for name, df in (frames or {}).items():
            path = self._folder(name, version)
            tables.pop(name, None), keyed.pop(name, None)
            if layouts and name in layouts:
                keyed[name] = self._write_keyed(df, path, layouts[name])
            else:
                df.write.partitionBy(*(partition_by or {}).get(name, [])).parquet(path)
                tables[name] = [path]
        for name, df in (appends or {}).items():
            path = self._folder(name, version)
            df.write.parquet(path)
            tables[name] = [*tables.get(name, []), path]
        for name, change in (replace or {}).items():
            keyed[name] = self._replace(name, keyed[name], change, version)
        row = [(version, tables, {n: tuple(k[c] for c in ("by", "keys", "schema", "folders")) for n, k in keyed.items()}, at)]
        # A second writer of the same version fails here instead of overwriting.
        self.spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("errorifexists").json(
            f"{self.root}/manifest/v{version:09d}"
        )
        return version

    def _folder(self, name: str, version: int) -> str:
        return f"{self.root}/data/{name}/v{version:09d}-{uuid.uuid4().hex[:8]}"

    # -- keyed tables ---------------------------------------------------------------
    def _write_parts(self, rows: DataFrame, path: str, by: list[str], parts: int) -> None:
        placed = rows.withColumn("_hash", key_hash(by)).withColumn("_part", F.pmod("_hash", F.lit(parts)).cast("int"))
        # rows of a part are sorted by hash in small pages, so that a lookup reads the pages of its keys; tasks go by the
        # rows' size, so that a large part is several files and small parts share a task; with a partition for each part,
        # small parts are not split because they lie beside others
        placed.hint("rebalance", parts, "_part").sortWithinPartitions("_part", "_hash").write.partitionBy("_part").option(
            "parquet.page.row.count.limit", PAGE_ROWS).parquet(path)

    def _write_keyed(self, df: DataFrame, path: str, layout: Layout) -> dict:
        parts = layout.parts or max(1, -(-sizing.measured_bytes(df) // PART_BYTES))
        self._write_parts(df, path, list(layout.by), parts)
        return {"by": list(layout.by), "keys": list(layout.replaced_by), "schema": df.schema.json(), "folders": self._written(path, range(parts), parts)}

    def _written(self, path: str, wanted, parts: int) -> list[str | None]:
        """Folder of each part that has rows."""
        folders: list[str | None] = [None] * parts
        found = self.spark.read.schema("_hash long, _part int").parquet(path).select("_part").distinct().collect()  # at most ``parts``
        for r in found:
            folders[r["_part"]] = f"{path}/_part={r['_part']}"
        return folders

    def _schema(self, keyed) -> T.StructType:
        return T.StructType.fromJson(json.loads(keyed["schema"]))

    def _parts(self, keyed, folders: list[str | None], hashes: list[int] | None = None) -> DataFrame:
        schema = self._schema(keyed)
        folders = [f for f in folders if f]
        if not folders:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(T.StructType([*schema, T.StructField("_hash", T.LongType())])).parquet(*folders)
        if hashes is not None:
            scans = [rows.filter(F.col("_hash").isin(hashes[at:at + SCAN_KEYS])) for at in range(0, len(hashes), SCAN_KEYS)]
            rows = reduce(DataFrame.union, scans)
        return rows.select(*schema.fieldNames())

    def near(self, name: str, rows: DataFrame, names: dict[str, str] | None = None, most: int = LOOKUP_KEYS) -> DataFrame:
        """The stored rows that may have the keys of ``rows``; ``names`` maps the table's columns to theirs.

        Up to ``most`` keys are handed to scans, which read the pages that hold
        them, however large the table; for more, their parts are read whole.
        """
        keyed = self._newest()[2][name]
        n = len(keyed["folders"])
        digest = key_hash([(names or {}).get(c, c) for c in keyed["by"]])
        found = [r[0] for r in rows.select(digest.alias("h")).distinct().limit(most + 1).collect()]
        if len(found) <= most:
            parts = {h % n for h in found}
            return self._parts(keyed, [keyed["folders"][p] for p in sorted(parts)], found)
        parts = [r[0] for r in rows.select(F.pmod(digest, F.lit(n)).alias("p")).distinct().collect()]  # at most the table's parts
        return self._parts(keyed, [keyed["folders"][p] for p in sorted(parts)])

    def _replace(self, name: str, keyed, change: Replacement, version: int) -> dict:
        schema, n, keys = self._schema(keyed), len(keyed["folders"]), list(keyed["keys"])
        typed = change.rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
        new = self._staged(typed, name, version)
        gone = new.select(*keys).distinct() if change.keys is None else self._staged(change.keys.select(*keys).distinct(), f"{name}-keys", version)
        part = F.pmod(key_hash(keyed["by"]), F.lit(n)).cast("int")
        touched = sorted(r[0] for r in gone.select(part.alias("p")).distinct().collect())  # at most the table's parts
        if not touched:
            return keyed
        old = self._parts(keyed, [keyed["folders"][p] for p in touched])
        # null-safe, as a key column may be null
        marks = gone.select(*[F.col(c).cast(schema[c].dataType).alias(f"_{c}") for c in keys])
        same = None
        for c in keys:
            equal = F.col(c).eqNullSafe(F.col(f"_{c}"))
            same = equal if same is None else same & equal
        path = self._folder(name, version)
        self._write_parts(old.join(marks, same, "left_anti").unionByName(new), path, list(keyed["by"]), n)
        written = self._written(path, touched, n)
        folders = list(keyed["folders"])
        for p in touched:
            folders[p] = written[p]
        return {"by": keyed["by"], "keys": keyed["keys"], "schema": keyed["schema"], "folders": folders}

    def _staged(self, rows: DataFrame, name: str, version: int) -> DataFrame:
        path = f"{self.root}/staged/{name}/v{version:09d}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)


class Deltas:
    """Rows by batch.  A batch owns its folder and overwrites it, so a batch that is delivered again leaves the same rows."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path, keys

    def write(self, batch_id: int, rows: DataFrame) -> DataFrame:
        folder = f"{self.path}/batch={batch_id}"
        rows.write.mode("overwrite").parquet(folder)
        return self.spark.read.schema(rows.schema).parquet(folder)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def newest(self) -> DataFrame:
        """The row of the latest batch for each key."""
        rows = self.read()
        rest = [c for c in rows.columns if c not in self.keys and c != "batch"]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
        return newest.select(*self.keys, "_r.*")

    def onto(self, base: DataFrame) -> DataFrame:
        """``base`` with the newest rows in place of those of the same keys."""
        new = self.newest().select(*base.columns)
        return base.join(new.select(*self.keys), self.keys, "left_anti").unionByName(new)
