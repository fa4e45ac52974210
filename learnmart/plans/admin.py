"""Administrator reports: formatted, ordered projections of the marts.

Every order ends in unique keys: results are then deterministic, and equal
leading keys do not pile up in one range partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learnmart.functions.exprs import day, over, stamp, zero
from learnmart.model import Tables
from learnmart.operators import marts
from learnmart.operators.facts import published_lessons
from learnmart.operators.marts import money_or_zero

# Report labels.
NEVER_SEEN = "Не входил"
YES, NO = "Да", "Нет"


def dashboard(t: Tables) -> DataFrame:
    return marts.stored(t, "mv_admin_dashboard", marts.admin_dashboard).select(
        "total_active_students",
        "total_active_teachers",
        "total_active_courses",
        "total_active_enrollments",
        "pending_hw_checks",
        "total_submissions",
        "revenue_current_month",
        "revenue_current_year",
        "revenue_total",
        "active_users_last_7days",
        stamp(F.col("next_webinar_at")).alias("next_webinar"),
        stamp(F.col("refreshed_at")).alias("refreshed"),
    )


def student_activity(t: Tables) -> DataFrame:
    last = F.col("last_activity_at")
    return (
        marts.active_students(t)
        .orderBy(F.desc_nulls_last("last_activity_at"), "student_id")
        .select(
            "student_id",
            "full_name",
            "email",
            "active_courses_count",
            day(F.col("registered_at")).alias("registered"),
            F.coalesce(stamp(last), F.lit(NEVER_SEEN)).alias("last_activity"),
        )
    )


def course_summary(t: Tables) -> DataFrame:
    """Structure, students, revenue and mean progress per course; homework of unpublished lessons counts too."""
    modules = t.modules.groupBy("course_id").agg(F.count("*").alias("modules"))
    lessons = published_lessons(t).groupBy("course_id").agg(
        F.count("*").alias("lessons"), F.count(F.when(F.col("lesson_type") == "webinar", 1)).alias("webinars")
    )
    homeworks = t.homework_outline.groupBy("course_id").agg(F.count("*").alias("homeworks"))
    revenue = t.payments.groupBy("course_id").agg(F.sum("amount").alias("total_revenue"))
    out = t.course_totals
    for part in (modules, lessons, homeworks, marts.active_by_course(t), revenue, marts.mean_completion(t)):
        out = out.join(part, "course_id", "left")
    return out.select(
        F.col("topic_name").alias("topic"),
        "subject",
        "course_id",
        F.col("course_title").alias("title"),
        F.when(F.col("course_is_active"), YES).otherwise(NO).alias("is_active"),
        *[zero(c).alias(c) for c in ("modules", "lessons", "webinars", "homeworks")],
        zero("enrolled").alias("active_students"),
        money_or_zero("total_revenue").alias("total_revenue"),
        F.coalesce("avg_completion_pct", F.lit(0).cast("decimal(18,1)")).alias("avg_completion_pct"),
    ).orderBy(F.desc("total_revenue"), "course_id")


def progress(t: Tables) -> DataFrame:
    return (
        marts.student_progress(t)
        .orderBy("course_title", F.desc("lessons_progress_pct"), "student_id", "course_id")
        .select(
            "student_id",
            "student_name",
            "course_title",
            "topic_name",
            over("completed_lessons", "total_lessons", " / ").alias("lessons_done"),
            "lessons_progress_pct",
            over("submitted_homeworks", "total_homeworks", " / ").alias("homeworks_done"),
            over("total_score", "max_possible_score", " / ").alias("points"),
            "score_pct",
        )
    )


def ranking(t: Tables) -> DataFrame:
    return (
        marts.stored(t, "mv_student_scores", marts.student_scores)
        .orderBy("course_title", "rank_in_course", "student_id", "course_id")
        .select("rank_in_course", "student_id", "full_name", "course_title", "total_score", "max_possible_score", "score_pct")
    )


def finance(t: Tables) -> DataFrame:
    return (
        marts.course_finance(t)
        .orderBy(F.desc("total_revenue"), "course_id")
        .select(
            "course_title",
            "topic_name",
            "total_revenue",
            "revenue_monthly",
            "revenue_yearly",
            "payments_count",
            "paying_students_count",
            day(F.col("first_payment_date")).alias("first_payment"),
            day(F.col("last_payment_date")).alias("last_payment"),
        )
    )


def webinars(t: Tables) -> DataFrame:
    return (
        marts.upcoming_webinars(t)
        .orderBy("webinar_scheduled_at", "lesson_id")
        .select(
            stamp(F.col("webinar_scheduled_at")).alias("scheduled"),
            "lesson_title",
            "course_title",
            "duration_minutes",
            "enrolled_count",
            "teachers",
        )
    )


def pending(t: Tables) -> DataFrame:
    return (
        marts.pending_homeworks(t, with_teachers=False)
        .orderBy("submitted_at", "submission_id")
        .select(
            "submission_id",
            "student_name",
            "course_title",
            "homework_title",
            "max_score",
            stamp(F.col("submitted_at")).alias("submitted"),
        )
    )


def workload(t: Tables) -> DataFrame:
    return (
        marts.stored(t, "mv_teacher_workload", marts.teacher_workload)
        .orderBy(F.desc("total_students"), "teacher_id")
        .select("teacher_id", "full_name", "courses_count", "total_students", "pending_checks", "total_checked")
    )
