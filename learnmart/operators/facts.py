"""Per-enrolment facts: the one wide aggregation most marts are built on.

Enrolments, finished lessons and graded homework are stacked and aggregated
once by (student, course).  That costs a single hash exchange of narrow,
partly aggregated rows, where joining three aggregates would cost three
exchanges and three sorts.  The result is written once per set of tables and
read by every mart and report, as their ranks and averages need it twice.
"""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from learnmart.functions.sizing import skewed_join
from learnmart.schemas import GRADED

if TYPE_CHECKING:
    from learnmart.model import Tables


def published_lessons(t: Tables) -> DataFrame:
    return t.lesson_outline.filter("is_published")


def published_homeworks(t: Tables) -> DataFrame:
    return t.homework_outline.filter("is_published")


COUNTS = {"completed_lessons": "done", "graded_homeworks": "graded", "scored_homeworks": "scored", "total_score": "points"}


def _nothing() -> dict[str, Column]:
    """A contribution that adds nothing."""
    no = F.lit(None)
    return {"enrolled_at": no.cast("timestamp"), "is_active": no.cast("boolean"), **{c: F.lit(0) for c in COUNTS.values()}}


def contributions(t: Tables, enrollments: DataFrame | None = None, progress: DataFrame | None = None,
                  submissions: DataFrame | None = None) -> DataFrame:
    """What each given row adds to the facts of its (student, course): narrow rows of one shape."""

    def rows(df: DataFrame, **given) -> DataFrame:
        return df.select("student_id", "course_id", *[given.get(k, v).alias(k) for k, v in _nothing().items()])

    item, stacked = ("course_id", "is_published"), []
    if enrollments is not None:
        stacked.append(rows(enrollments, enrolled_at=F.col("enrolled_at"), is_active=F.col("is_active")))
    if progress is not None:
        lessons = t.outline_dim(t.lesson_outline.select("lesson_id", *item))
        done = progress.filter("is_completed").select("student_id", "lesson_id").join(lessons, "lesson_id")
        stacked.append(rows(done, done=F.col("is_published").cast("int")))
    if submissions is not None:
        homeworks = t.outline_dim(t.homework_outline.select("homework_id", *item))
        sent = submissions.select("student_id", "homework_id", "status", "score").join(homeworks, "homework_id")
        graded = F.col("is_published") & F.col("status").isin(*GRADED)
        stacked.append(rows(
            sent,
            graded=graded.cast("int"),
            scored=(graded & F.col("score").isNotNull()).cast("int"),
            points=F.when(graded, F.coalesce(F.col("score").cast("int"), F.lit(0))).otherwise(F.lit(0)),
        ))
    return reduce(DataFrame.unionByName, stacked)


def fold(rows: DataFrame) -> DataFrame:
    """Contributions added up: one row per (student, course), with or without an enrolment."""
    return rows.groupBy("student_id", "course_id").agg(
        F.max("enrolled_at").alias("enrolled_at"),
        F.max("is_active").alias("is_active"),
        *[F.sum(source).alias(name) for name, source in COUNTS.items()],
    )


def everyone(t: Tables) -> DataFrame:
    """The facts of all pairs that have rows, also of students not enrolled (yet)."""
    return fold(contributions(t, t.enrollments, t.lesson_progress, t.homework_submissions))


def build(t: Tables) -> DataFrame:
    """One row per enrolment.

    (student_id, course_id) -> enrolled_at, is_active, completed_lessons, graded_homeworks, scored_homeworks
    (graded with a score) and total_score, all of published lessons.  A row has the same width whatever the course.
    """
    return everyone(t).filter("enrolled_at is not null")


def moved(facts: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The rows of ``facts`` that contributions touch, as they are after the change.

    ``facts`` need only hold the touched pairs.  Counts are additive; an added
    enrolment row replaces the pair's enrolment.
    """
    turned = removed.select("student_id", "course_id", *[
        (-F.col(c)).alias(c) if c in COUNTS.values() else v.alias(c) for c, v in _nothing().items()
    ])
    change = fold(added.unionByName(turned))
    now = facts.select(
        F.col("student_id").alias("_s"), F.col("course_id").alias("_c"), F.col("enrolled_at").alias("_at"), F.col("is_active").alias("_on"),
        *[F.col(c).alias(f"_{c}") for c in COUNTS])
    both = change.join(now, (F.col("student_id") == F.col("_s")) & (F.col("course_id") == F.col("_c")), "left")
    return both.select(
        "student_id", "course_id",
        F.coalesce("enrolled_at", "_at").alias("enrolled_at"),
        F.when(F.col("enrolled_at").isNotNull(), F.col("is_active")).otherwise(F.col("_on")).alias("is_active"),
        *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in COUNTS],
    )


def people(t: Tables, *columns) -> DataFrame:
    return t.users.select(F.col("id").alias("student_id"), *columns)


def rank_within(
    t: Tables, df: DataFrame, score: str, out: str, group: str = "course_id", size: str | None = None
) -> DataFrame:
    """``rank()`` by descending score inside each group, without a window over the rows.

    A group may hold a third of all rows, so rows are first reduced to a
    histogram of scores; the running count over that histogram gives the rank
    of each score, and is joined back by (group, score).  ``size`` names a
    column for the number of rows in the group.
    """
    whole = Window.partitionBy(group)
    above = whole.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    columns = [group, score, (F.coalesce(F.sum("_n").over(above), F.lit(0)) + 1).alias(out)]
    if size:
        columns.append(F.sum("_n").over(whole).alias(size))
    ranks = df.groupBy(group, score).agg(F.count("*").alias("_n")).select(*columns)
    return df.join(t.score_dim(ranks), [group, score])


def global_rank(df: DataFrame, score: str, out: str) -> DataFrame:
    """``rank()`` by descending score over all rows.

    The unpartitioned window runs over distinct values of an integer count
    only; d distinct counts need at least d(d-1)/2 counted items, so there are
    few even when there are many rows.
    """
    above = Window.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    ranks = (
        df.groupBy(score)
        .agg(F.count("*").alias("_n"))
        .select(score, (F.coalesce(F.sum("_n").over(above), F.lit(0)) + 1).alias(out))
    )
    return df.join(ranks, score)


def per_teacher_rows(t: Tables, rows: DataFrame, many: DataFrame) -> DataFrame:
    """Repeat course rows for every row of ``many``, a frame no larger than course_teachers.

    A course may be hot on both sides: ``many`` is broadcast when measured
    small, otherwise the heavy courses are spread over salted sub-keys.
    """
    if t.assignments_fit:
        return rows.join(F.broadcast(many), "course_id")
    return skewed_join(rows, many, "course_id")
