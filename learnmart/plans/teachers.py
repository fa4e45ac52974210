"""Teacher reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learnmart.functions.exprs import day, full_name, hours1, stamp
from learnmart.model import Tables
from learnmart.operators import lookups, marts
from learnmart.operators.facts import global_rank, people

# Report labels.
NO_DEADLINE, OVERDUE, URGENT, IN_TIME = "Без дедлайна", "🔴 Просрочено", "🟠 Срочно", "🟢 В срок"
URGENT_HOURS = 2
CHECKED, WAITING, AUTO = "🟢 Проверено", "🟡 Ожидает", "🔵 Авто"
BY_MACHINE = "Автопроверка"


def students(t: Tables, teacher_id=None, course_id=None) -> DataFrame:
    return (
        lookups.teacher_students(t, teacher_id, course_id)
        .orderBy("course_title", F.desc("completed_pct"), "teacher_id", "student_id")
        .select(
            "teacher_id",
            "student_id",
            "full_name",
            "email",
            "course_title",
            day(F.col("enrolled_at")).alias("enrolled"),
            "total_score",
            "completed_pct",
        )
    )


def check_queue(t: Tables) -> DataFrame:
    """Manual work waiting for a grade, with the state of its grading deadline."""
    outline = (
        t.homework_outline
        .filter("check_type = 'manual'")
        .select("homework_id", "homework_title", "max_score", "deadline_hours", "module_title", "course_title")
    )
    due = F.col("submitted_at") + F.make_dt_interval(F.lit(0), F.col("deadline_hours").cast("int"))
    state = (
        F.when(F.col("due").isNull(), NO_DEADLINE)
        .when(t.now > F.col("due"), OVERDUE)
        .when(t.now > F.col("due") - F.make_dt_interval(F.lit(0), F.lit(URGENT_HOURS)), URGENT)
        .otherwise(IN_TIME)
    )
    return (
        t.homework_submissions.filter("status = 'submitted'")
        .select(F.col("id").alias("submission_id"), "homework_id", "student_id", "submitted_at")
        .join(t.catalogue_dim(outline), "homework_id")
        .join(people(t, full_name().alias("full_name")), "student_id")
        .withColumn("due", due)
        .orderBy("submitted_at", "submission_id")
        .select(
            "submission_id",
            "full_name",
            "course_title",
            "module_title",
            "homework_title",
            "max_score",
            stamp(F.col("submitted_at")).alias("submitted"),
            hours1(t.now, F.col("submitted_at")).alias("hours_waiting"),
            state.alias("deadline_state"),
        )
    )


def workload_rank(t: Tables) -> DataFrame:
    return (
        global_rank(marts.stored(t, "mv_teacher_workload", marts.teacher_workload), "total_students", "students_rank")
        .orderBy(F.desc("total_students"), "teacher_id")
        .select(
            "teacher_id",
            "full_name",
            "email",
            "courses_count",
            F.col("courses_count").alias("courses_active"),
            "total_students",
            "pending_checks",
            "total_checked",
            "students_rank",
        )
    )


def webinars(t: Tables, name: str) -> DataFrame:
    """Upcoming webinars of courses with a teacher whose name contains ``name``."""
    return (
        marts.upcoming_webinars(t)
        .filter(F.col("teachers").ilike(f"%{name}%"))
        .orderBy("webinar_scheduled_at", "lesson_id")
        .select(
            stamp(F.col("webinar_scheduled_at")).alias("scheduled"),
            "lesson_title",
            "course_title",
            "duration_minutes",
            "enrolled_count",
        )
    )


def student_grades(t: Tables, student_id=None) -> DataFrame:
    """Hand-ins with the name of whoever graded them."""
    work = t.homework_submissions
    if student_id is not None:
        work = work.filter(F.col("student_id") == student_id)
    status = F.col("status")
    label = F.when(status == "checked", CHECKED).when(status == "submitted", WAITING).when(status == "auto_checked", AUTO)
    homeworks = t.homeworks.select(F.col("id").alias("homework_id"), F.col("title").alias("homework_title"), "max_score")
    graders = t.users.select(F.col("id").alias("grader_id"), full_name().alias("grader"))
    # Ungraded rows get distinct keys that match nobody, so NULLs do not meet in one task.
    grader_id = F.coalesce("checked_by", F.concat(F.lit("~none~"), F.col("submission_id").cast("string")))
    return (
        work.select(
            F.col("id").alias("submission_id"), "student_id", "homework_id", "score", "status", "checked_by", "checked_at",
            "submitted_at",
        )
        .join(t.catalogue_dim(homeworks), "homework_id")
        .join(people(t, full_name().alias("full_name")), "student_id")
        .withColumn("grader_id", grader_id)
        .join(graders, "grader_id", "left")
        .orderBy("student_id", "submitted_at", "submission_id")
        .select(
            "submission_id",
            "student_id",
            "full_name",
            "homework_title",
            "max_score",
            "score",
            label.alias("status_label"),
            F.when(F.col("checked_by").isNull(), BY_MACHINE).otherwise(F.col("grader")).alias("checked_by_name"),
            stamp(F.col("checked_at")).alias("checked"),
        )
    )
