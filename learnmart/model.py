"""The set of tables a plan reads, with the time it is evaluated at."""

from __future__ import annotations

from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from learnmart import schemas
from learnmart.functions import sizing
from learnmart.operators import facts, outline
from learnmart.sources.workspace import workspace


class Frames(dict):
    """Frames by name; a function in place of a frame is called when the frame is first needed."""

    def __getitem__(self, name: str) -> DataFrame:
        frame = super().__getitem__(name)
        return frame() if callable(frame) and not isinstance(frame, DataFrame) else frame


class Tables:
    """Lazy tables plus ``as_of`` (the stand-in for the current time).

    Frames are plain DataFrames.  What is done ahead of a plan's own action,
    at most once per object: the course catalogue is flattened into three
    written outlines, their size is measured to decide on broadcasts, and the
    per-enrolment facts are written for the marts to share.
    """

    def __init__(self, spark: SparkSession, frames: dict[str, DataFrame], as_of: datetime,
                 broadcast_bytes: int = sizing.BROADCAST_BYTES):
        self.spark = spark
        self.frames = Frames(frames)
        self.as_of = as_of
        self.broadcast_bytes = broadcast_bytes

    def __getattr__(self, name: str) -> DataFrame:
        frames = self.__dict__.get("frames", {})
        if name in frames:
            return frames[name]
        raise AttributeError(name)

    def replace(self, **frames: DataFrame) -> "Tables":
        """A copy with some tables swapped (how change jobs hand on new state)."""
        out = Tables(self.spark, {**dict.copy(self.frames), **frames}, self.as_of, self.broadcast_bytes)
        kept = set(self.frames) - set(frames)
        if kept >= set(schemas.CATALOGUE):
            for name in ("lesson_outline", "homework_outline", "course_totals", "catalogue_size"):
                out.__dict__[name] = getattr(self, name)
            if kept >= {"enrollments", "lesson_progress", "homework_submissions"} and "enrolment_facts" in self.__dict__:
                out.__dict__["enrolment_facts"] = self.enrolment_facts
        if "course_teachers" in kept and "_assignment_bytes" in self.__dict__:
            out.__dict__["_assignment_bytes"] = self._assignment_bytes
        if "users" in kept:
            out.__dict__["_sizes"] = self.__dict__.setdefault("_sizes", {})
        return out

    # -- time ---------------------------------------------------------------
    @property
    def now(self) -> Column:
        return F.lit(self.as_of.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")

    @property
    def today(self) -> Column:
        return F.lit(self.as_of.strftime("%Y-%m-%d")).cast("date")

    # -- written intermediates ------------------------------------------------------
    def cut(self, name: str, df: DataFrame) -> DataFrame:
        """Write ``df`` to the shared folder and read it back: a short plan with exact statistics."""
        folder = workspace(self.spark, name)
        df.write.parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    @cached_property
    def lesson_outline(self) -> DataFrame:
        """Every lesson with its module and course."""
        return self.cut("lesson_outline", outline.lessons(self))

    @cached_property
    def homework_outline(self) -> DataFrame:
        """Every homework with its lesson, module and course."""
        return self.cut("homework_outline", outline.homeworks(self))

    @cached_property
    def course_totals(self) -> DataFrame:
        """Every course with its topic and the totals of its published lessons."""
        return self.cut("course_totals", outline.courses(self))

    @cached_property
    def enrolment_facts(self) -> DataFrame:
        """Every enrolment with its finished lessons, graded homework and score."""
        return self.cut("enrolment_facts", facts.build(self))

    @property
    def active_facts(self) -> DataFrame:
        return self.enrolment_facts.filter("is_active")

    # -- measured sizes -------------------------------------------------------
    @cached_property
    def catalogue_size(self) -> sizing.CatalogueSize:
        return sizing.measure_catalogue(self)

    def catalogue_dim(self, df: DataFrame) -> DataFrame:
        """Broadcast a frame no larger than an outline, if the outlines are measured small."""
        return F.broadcast(df) if self.catalogue_size.outline_bytes <= self.broadcast_bytes else df

    def outline_small(self, df: DataFrame) -> bool:
        """Is a projection of an outline small: measured itself where the whole outlines are too large."""
        return self.catalogue_size.outline_bytes <= self.broadcast_bytes or self.small(df)

    def outline_dim(self, df: DataFrame) -> DataFrame:
        """Broadcast a projection of an outline, if measured small."""
        return F.broadcast(df) if self.outline_small(df) else df

    def score_dim(self, df: DataFrame) -> DataFrame:
        """Broadcast a frame with at most one row per (course, reachable score), if that is known to be small."""
        return F.broadcast(df) if self.catalogue_size.score_bytes <= self.broadcast_bytes else df

    def measured_small(self, name: str, df: DataFrame) -> bool:
        """Does the measured size of ``df`` allow a broadcast; measured once per name."""
        sizes = self.__dict__.setdefault("_sizes", {})
        if name not in sizes:
            sizes[name] = sizing.measured_bytes(df)
        return sizes[name] <= self.broadcast_bytes

    def measured_dim(self, name: str, df: DataFrame) -> DataFrame:
        """Broadcast ``df`` if its measured size allows; measured once per name."""
        return F.broadcast(df) if self.measured_small(name, df) else df

    def small(self, written: DataFrame) -> bool:
        """Is a projection of a written table measured small enough to broadcast."""
        return sizing.measured_bytes(written) <= self.broadcast_bytes

    def measured(self, written: DataFrame) -> DataFrame:
        """Broadcast a projection of a written table if it is measured small; leave the join to AQE beyond."""
        return F.broadcast(written) if self.small(written) else written

    @cached_property
    def _assignment_bytes(self) -> int:
        return sizing.measured_bytes(self.course_teachers.select("course_id", "teacher_id"))

    def assignment_dim(self, df: DataFrame) -> DataFrame:
        """Broadcast a projection of course_teachers keys, if measured small."""
        return F.broadcast(df) if self._assignment_bytes <= self.broadcast_bytes else df

    @property
    def assignments_fit(self) -> bool:
        return self._assignment_bytes <= self.broadcast_bytes


def typed(spark: SparkSession, name: str, rows: list[tuple], columns: list[str] | None = None) -> DataFrame:
    """Small literal rows as a typed table; missing nullable columns become NULL."""
    schema = schemas.TABLES[name].schema
    columns = columns or schema.fieldNames()
    picked = [schema[c] for c in columns]
    from pyspark.sql import types as T

    df = spark.createDataFrame(rows, T.StructType(picked))
    return df.select(*[
        F.col(f.name) if f.name in columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields
    ])
