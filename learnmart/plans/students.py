"""Student reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learnmart import schemas
from learnmart.functions.exprs import day, full_name, over, stamp, zero
from learnmart.model import Tables
from learnmart.operators import lookups, marts
from learnmart.operators.facts import people, published_homeworks

# Report labels.
FINISHED, GOING, STARTED, UNTOUCHED = "Завершён", "В процессе", "Начат", "Не начат"
MANUAL, AUTO = "Ручная", "Авто"
NO_SCORE = "—"
WAITING, CHECKED, AUTO_CHECKED = "🟡 Ожидает проверки", "🟢 Проверено", "🔵 Авто-проверено"
NO_DATA = "Нет данных"


def progress_status(t: Tables) -> DataFrame:
    pct = F.col("lessons_progress_pct")
    status = F.when(pct == 100, FINISHED).when(pct >= 50, GOING).when(pct > 0, STARTED).otherwise(UNTOUCHED)
    return (
        marts.student_progress(t)
        .orderBy(F.desc("score_pct"), F.desc("lessons_progress_pct"), "student_id", "course_id")
        .select(
            "student_id",
            "student_name",
            "course_title",
            "lessons_progress_pct",
            over("submitted_homeworks", "total_homeworks").alias("homeworks"),
            over("total_score", "max_possible_score").alias("points"),
            "score_pct",
            status.alias("status"),
        )
    )


def ranking_topic(t: Tables) -> DataFrame:
    return (
        marts.stored(t, "mv_student_scores", marts.student_scores)
        .orderBy("course_title", "rank_in_course", "student_id", "course_id")
        .select(
            "rank_in_course",
            "student_id",
            "full_name",
            "course_title",
            "topic_name",
            "total_score",
            "max_possible_score",
            "score_pct",
        )
    )


def unsubmitted(t: Tables) -> DataFrame:
    """Homework of published lessons an active enrolment owes and has not handed in.

    What the courses ask of their students, without what they have handed in:
    an anti join on (homework, student), over keys alone.  Titles are joined to
    the rows that are left.
    """
    owed = t.outline_dim(published_homeworks(t).select("course_id", "homework_id").distinct())
    titles = t.outline_dim(
        published_homeworks(t).select(
            F.col("course_id").alias("_course"), "course_title", "module_title", "lesson_title",
            F.col("homework_id").alias("_homework"), "homework_title", "check_type"
        )
    )
    kind = F.when(F.col("check_type") == "manual", MANUAL).when(F.col("check_type") == "auto", AUTO)
    return (
        t.enrollments.filter("is_active").select("student_id", "course_id")
        .join(owed, "course_id")
        .join(t.homework_submissions.select("student_id", "homework_id"), ["student_id", "homework_id"], "left_anti")
        .join(titles, (F.col("course_id") == F.col("_course")) & F.col("homework_id").eqNullSafe(F.col("_homework")))
        .join(people(t, full_name().alias("full_name")), "student_id")
        .orderBy("course_title", "student_id", "module_title", "homework_id")
        .select(
            "student_id",
            "full_name",
            "course_title",
            "module_title",
            "lesson_title",
            "homework_title",
            kind.alias("check_kind"),
        )
    )


def submission_status(t: Tables) -> DataFrame:
    outline = t.homework_outline
    status = F.col("status")
    label = F.when(status == "submitted", WAITING).when(status == "checked", CHECKED).when(
        status == "auto_checked", AUTO_CHECKED
    )
    return (
        t.homework_submissions.select(
            F.col("id").alias("submission_id"), "student_id", "homework_id", "score", "status", "submitted_at", "checked_at"
        )
        .join(t.catalogue_dim(outline.select("homework_id", "homework_title", "max_score", "course_title")), "homework_id")
        .join(people(t, full_name().alias("full_name")), "student_id")
        .orderBy("course_title", "full_name", "submitted_at", "submission_id")
        .select(
            "submission_id",
            "full_name",
            "course_title",
            "homework_title",
            "max_score",
            F.coalesce(F.col("score").cast("string"), F.lit(NO_SCORE)).alias("score_text"),
            label.alias("status_label"),
            stamp(F.col("submitted_at")).alias("submitted"),
            stamp(F.col("checked_at")).alias("checked"),
        )
    )


def activity(t: Tables) -> DataFrame:
    """Actions per active student; students without any are kept.

    The log is reduced to (user, day) first, which also gives the distinct days.
    """
    action = F.col("action")
    daily = t.activity_log.groupBy("user_id", F.to_date("created_at").alias("d")).agg(
        F.count("*").alias("n"),
        F.count(F.when(action == schemas.Action.VIEW_LESSON, 1)).alias("v"),
        F.count(F.when(action == schemas.Action.COMPLETE_LESSON, 1)).alias("c"),
        F.count(F.when(action == "submit_hw", 1)).alias("h"),
        F.max("created_at").alias("last"),
    )
    per_user = daily.groupBy(F.col("user_id").alias("student_id")).agg(
        F.sum("n").alias("actions"),
        F.sum("v").alias("lessons_viewed"),
        F.sum("c").alias("lessons_completed"),
        F.sum("h").alias("homeworks_sent"),
        F.count("*").alias("active_days"),
        F.max("last").alias("last"),
    )
    counts = ("actions", "lessons_viewed", "lessons_completed", "homeworks_sent", "active_days")
    return (
        t.users.filter("role = 'student' and is_active")
        .select(F.col("id").alias("student_id"), full_name().alias("full_name"), "email")
        .join(per_user, "student_id", "left")
        .orderBy(F.desc_nulls_last("last"), "student_id")
        .select("student_id", "full_name", "email", *[zero(c).alias(c) for c in counts], stamp(F.col("last")).alias("last_activity"))
    )


def course_detail(t: Tables, course_id=None) -> DataFrame:
    return (
        lookups.course_progress_report(t, course_id)
        .orderBy(F.desc("score_pct"), "course_id", "student_id")
        .select(
            "course_id",
            "student_id",
            "full_name",
            "email",
            over("completed_lessons", "total_lessons").alias("lessons"),
            "lessons_pct",
            over("submitted_hw", "total_hw").alias("homeworks"),
            over("total_score", "max_score").alias("points"),
            "score_pct",
            F.coalesce(day(F.col("last_activity_at")), F.lit(NO_DATA)).alias("last_activity"),
            "status_label",
        )
    )
