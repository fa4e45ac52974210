"""Parameterised lookups as set operators: an id becomes an optional filter."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from learnmart.functions.exprs import full_name, pct1, pct1_or_zero, zero
from learnmart.model import Tables
from learnmart.operators import marts
from learnmart.operators.facts import (
    people,
    per_teacher_rows,
    published_homeworks,
    published_lessons,
    rank_within,
)
from learnmart.operators.marts import money_or_zero

# Labels of a student's state in a course, and the idle limit in days.
COURSE_DONE = "Курс завершён"
IDLE = "Неактивен (14+ дней)"
STUDYING = "Активно учится"
JUST_STARTED = "Только начал"
NOT_STARTED = "Не приступал"
IDLE_DAYS = 14


class NotFound(ValueError):
    """An id given as a parameter does not name a suitable row."""


def _require(df: DataFrame, message: str) -> None:
    if df.isEmpty():
        raise NotFound(message)


def user_full_names(t: Tables, user_id=None) -> DataFrame:
    users = t.users.select(F.col("id").alias("user_id"), full_name().alias("full_name"))
    if user_id is None:
        return users
    users = users.filter(F.col("user_id") == user_id)
    _require(users, f"user {user_id} not found")
    return users


def course_stats(t: Tables, course_id=None) -> DataFrame:
    """Structure, students, revenue and mean completion per course.

    ``total_revenue`` counts equal payments of a course once, as the original
    report does; ``total_revenue_actual`` is the plain sum.
    """
    lesson_type = F.col("lesson_type")
    modules = t.modules.groupBy("course_id").agg(F.count("*").alias("modules_count"))
    lessons = published_lessons(t).groupBy("course_id").agg(
        F.count("*").alias("lessons_count"),
        F.count(F.when(lesson_type == "webinar", 1)).alias("webinars_count"),
        F.count(F.when(lesson_type == "video", 1)).alias("videos_count"),
    )
    homeworks = published_homeworks(t).groupBy("course_id").agg(F.count("*").alias("homeworks_count"))
    paid = t.payments.groupBy("course_id").agg(
        F.sum_distinct("amount").alias("distinct_revenue"), F.sum("amount").alias("revenue")
    )
    out = t.course_totals
    if course_id is not None:
        out = out.filter(F.col("course_id") == course_id)
        _require(out, f"course {course_id} not found")
    for part in (modules, lessons, homeworks, marts.active_by_course(t), paid, marts.mean_completion(t)):
        out = out.join(part, "course_id", "left")
    counts = ("modules_count", "lessons_count", "webinars_count", "videos_count", "homeworks_count")
    return out.select(
        "course_id",
        "course_title",
        "topic_name",
        "subject",
        *[zero(c).alias(c) for c in counts],
        zero("enrolled").alias("enrolled_students"),
        money_or_zero("distinct_revenue").alias("total_revenue"),
        money_or_zero("revenue").alias("total_revenue_actual"),
        F.coalesce("avg_completion_pct", F.lit(0).cast("decimal(18,1)")).alias("avg_completion_pct"),
    )


def student_rank(t: Tables, student_id=None, course_id=None) -> DataFrame:
    """Rank of each active student in each course, with the class size.

    For one student only that student's courses are ranked; with
    ``refresh.near_student`` only their facts are read.
    """
    scored = t.active_facts.join(
        t.catalogue_dim(t.course_totals.filter("total_homeworks > 0")), "course_id"
    )
    if student_id is not None:
        own = t.active_facts.filter(F.col("student_id") == student_id).select("course_id").distinct()
        scored = scored.join(t.catalogue_dim(own), "course_id", "left_semi")
    if course_id is not None:
        scored = scored.filter(F.col("course_id") == course_id)
    ranked = rank_within(t, scored, "total_score", "rank_in_course", size="total_students")
    if student_id is not None:
        ranked = ranked.filter(F.col("student_id") == student_id)
        mine = t.enrollments.filter(F.col("is_active") & (F.col("student_id") == student_id))
        if course_id is not None:
            mine = mine.filter(F.col("course_id") == course_id)
        _require(mine, f"student {student_id} is not enrolled")
    graded_score = F.when(F.col("scored_homeworks") > 0, F.col("total_score"))  # no score at all has no share
    return ranked.join(people(t, full_name().alias("full_name")), "student_id").select(
        "student_id",
        "full_name",
        "course_id",
        "total_score",
        F.col("max_possible_score").alias("max_possible"),
        pct1(graded_score, F.col("max_possible_score")).alias("score_pct"),
        "rank_in_course",
        "total_students",
    )


def is_enrolled(t: Tables, pairs: DataFrame) -> DataFrame:
    """``pairs`` with a flag: is the student actively enrolled in the course?"""
    active = t.enrollments.filter("is_active").select("student_id", "course_id", F.lit(True).alias("_on"))
    return pairs.join(active, ["student_id", "course_id"], "left").withColumn(
        "is_enrolled", F.coalesce("_on", F.lit(False))
    ).drop("_on")


def teaching(t: Tables, teacher_id=None, course_id=None) -> DataFrame:
    """(course_id, teacher_id) of real teachers, optionally of one teacher or course."""
    pairs = t.course_teachers.select("course_id", "teacher_id")
    teachers = t.users.filter("role = 'teacher'").select(F.col("id").alias("teacher_id"))
    if teacher_id is not None:
        pairs = pairs.filter(F.col("teacher_id") == teacher_id)
        teachers = teachers.filter(F.col("teacher_id") == teacher_id)
        _require(teachers, f"user {teacher_id} is not a teacher")
    if course_id is not None:
        pairs = pairs.filter(F.col("course_id") == course_id)
    return pairs.join(teachers, "teacher_id", "left_semi").select("course_id", "teacher_id")


def class_rows(t: Tables) -> DataFrame:
    """Active enrolments of active students: score and lesson completion, by the stored marts if there are both."""
    students = t.users.filter("is_active").select(
        F.col("id").alias("student_id"), full_name().alias("full_name"), "email", "last_name", "first_name"
    )
    if {"mv_student_scores", "mv_course_completion"} <= set(t.frames):
        pair = ["student_id", "course_id"]
        places = t.enrollments.filter("is_active").select(*pair, "enrolled_at")
        scores = t.frames["mv_student_scores"].select(*pair, "total_score")
        done = t.frames["mv_course_completion"].select(*pair, "completed_lessons")
        places = places.join(scores, pair, "left").join(done, pair, "left").fillna(0, ["total_score", "completed_lessons"])
    else:
        places = t.active_facts
    return (
        places.join(students, "student_id")
        .join(t.catalogue_dim(t.course_totals), "course_id")
        .select(
            "student_id",
            "full_name",
            "email",
            "course_id",
            "course_title",
            "subject",
            "enrolled_at",
            "total_score",
            pct1_or_zero(F.col("completed_lessons"), F.col("total_lessons")).alias("completed_pct"),
            "last_name",
            "first_name",
        )
    )


def teacher_students(t: Tables, teacher_id=None, course_id=None) -> DataFrame:
    """Students of each teacher's courses with score and completion."""
    rows = class_rows(t)
    if course_id is not None:
        rows = rows.filter(F.col("course_id") == course_id)
    return per_teacher_rows(t, rows, teaching(t, teacher_id, course_id)).select(
        "teacher_id",
        "student_id",
        "full_name",
        "email",
        "course_id",
        "course_title",
        "subject",
        "enrolled_at",
        "total_score",
        "completed_pct",
    )


def monthly_revenue(t: Tables, date_from: date | None = None, date_to: date | None = None) -> DataFrame:
    """Revenue per month with a running total; the default period is the current year so far."""
    date_to = date_to or t.as_of.date()
    date_from = date_from or t.as_of.date().replace(month=1, day=1)
    if date_from > date_to:
        raise ValueError(f"period starts on {date_from}, after its end {date_to}")
    amount, kind = F.col("amount"), F.col("subscription_type")
    monthly = (
        t.payments.filter(F.col("payment_date").between(F.lit(date_from), F.lit(date_to)))
        .groupBy(F.trunc("payment_date", "month").alias("m"))
        .agg(
            money_or_zero(F.sum(amount)).alias("revenue"),
            money_or_zero(F.sum(F.when(kind == "monthly", amount))).alias("revenue_monthly"),
            money_or_zero(F.sum(F.when(kind == "yearly", amount))).alias("revenue_yearly"),
            F.count("*").alias("payments_count"),
        )
    )
    so_far = Window.orderBy("m").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row per month
    return monthly.select(
        F.year("m").alias("year"),
        F.month("m").alias("month"),
        F.date_format("m", "MMMM").alias("month_name"),
        "revenue",
        "revenue_monthly",
        "revenue_yearly",
        "payments_count",
        F.sum("revenue").over(so_far).alias("cumulative_revenue"),
    ).orderBy("year", "month")


def last_activity(t: Tables) -> DataFrame:
    return t.activity_log.groupBy(F.col("user_id").alias("student_id")).agg(
        F.max("created_at").alias("last_activity_at")
    )


def course_progress_report(t: Tables, course_id=None) -> DataFrame:
    """Active students of a course (or of every course) with progress and a status label."""
    facts = t.active_facts
    totals = t.course_totals
    if course_id is not None:
        totals = totals.filter(F.col("course_id") == course_id)
        _require(totals, f"course {course_id} not found")
    students = t.users.filter("is_active").select(
        F.col("id").alias("student_id"), full_name().alias("full_name"), "email"
    )
    pct, last = F.col("lessons_pct"), F.col("last_activity_at")
    label = (
        F.when(pct == 100, COURSE_DONE)
        .when(last.isNull() | (last < t.now - F.make_dt_interval(F.lit(IDLE_DAYS))), IDLE)
        .when(pct >= 50, STUDYING)
        .when(pct > 0, JUST_STARTED)
        .otherwise(NOT_STARTED)
    )
    return (
        facts.join(students, "student_id")
        .join(last_activity(t), "student_id", "left")
        .join(t.catalogue_dim(totals), "course_id")
        .select(
            "course_id",
            "student_id",
            "full_name",
            "email",
            "enrolled_at",
            "completed_lessons",
            "total_lessons",
            pct1_or_zero(F.col("completed_lessons"), F.col("total_lessons")).alias("lessons_pct"),
            F.col("graded_homeworks").alias("submitted_hw"),
            F.col("total_homeworks").alias("total_hw"),
            "total_score",
            F.col("max_possible_score").alias("max_score"),
            pct1_or_zero(F.col("total_score"), F.col("max_possible_score")).alias("score_pct"),
            "last_activity_at",
        )
        .withColumn("status_label", label)
    )
