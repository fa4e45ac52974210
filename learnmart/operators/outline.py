"""The course tree flattened: lessons, homework and courses with everything above them."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from learnmart.model import Tables


def lessons(t: Tables) -> DataFrame:
    optional = [c for c in ("video_url", "webinar_url", "webinar_scheduled_at", "duration_minutes") if c in t.lessons.columns]
    lesson = t.lessons.select(
        F.col("id").alias("lesson_id"),
        F.col("title").alias("lesson_title"),
        "lesson_type",
        F.col("order_index").alias("lesson_order"),
        *optional,
        "is_published",
        "module_id",
    )
    module = t.modules.select(
        F.col("id").alias("module_id"), F.col("title").alias("module_title"), F.col("order_index").alias("module_order"), "course_id"
    )
    course = t.courses.select(F.col("id").alias("course_id"), F.col("title").alias("course_title"))
    return lesson.join(module, "module_id").join(course, "course_id")


def homeworks(t: Tables) -> DataFrame:
    homework = t.homeworks.select(
        F.col("id").alias("homework_id"),
        F.col("title").alias("homework_title"),
        "check_type",
        "max_score",
        "deadline_hours",
        "lesson_id",
    )
    above = ("lesson_id", "lesson_title", "is_published", "module_id", "module_title", "course_id", "course_title")
    return homework.join(t.lesson_outline.select(*above), "lesson_id")


def courses(t: Tables) -> DataFrame:
    published = t.lesson_outline.filter("is_published").groupBy("course_id").agg(F.count("*").alias("total_lessons"))
    owed = (
        t.homework_outline.filter("is_published")
        .groupBy("course_id")
        .agg(F.count("*").alias("total_homeworks"), F.sum("max_score").alias("max_possible_score"))
    )
    course = t.courses.select(
        F.col("id").alias("course_id"),
        F.col("title").alias("course_title"),
        "subject",
        "topic_id",
        F.col("is_active").alias("course_is_active"),
        "price_monthly",
        "price_yearly",
    )
    topic = t.topics.select(F.col("id").alias("topic_id"), F.col("name").alias("topic_name"))
    totals = ("total_lessons", "total_homeworks", "max_possible_score")
    return (
        course.join(topic, "topic_id")
        .join(published, "course_id", "left")
        .join(owed, "course_id", "left")
        .select(
            "course_id", "course_title", "subject", "topic_name", "course_is_active", "price_monthly", "price_yearly",
            *[F.coalesce(c, F.lit(0)).alias(c) for c in totals],
        )
    )
