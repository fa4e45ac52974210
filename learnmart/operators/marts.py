"""Derived lists and marts.  Results are unordered; reports add the order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learnmart.functions.exprs import full_name, mean1, pct1, pct1_or_zero, short_name, zero
from learnmart.model import Tables
from learnmart.operators.facts import (
    people,
    per_teacher_rows,
    rank_within,
)


def active_by_course(t: Tables) -> DataFrame:
    """course_id -> actively enrolled students ((student, course) is unique)."""
    return t.enrollments.filter("is_active").groupBy("course_id").agg(F.count("*").alias("enrolled"))


def active_students(t: Tables) -> DataFrame:
    """Active students with their active courses and last activity."""
    enrolled = t.enrollments.filter("is_active").select(
        "student_id", F.lit(1).alias("course"), F.lit(None).cast("timestamp").alias("at")
    )
    seen = t.activity_log.select(F.col("user_id").alias("student_id"), F.lit(0).alias("course"), F.col("created_at"))
    per_student = enrolled.union(seen).groupBy("student_id").agg(
        F.sum("course").alias("active_courses_count"), F.max("at").alias("last_activity_at")
    )
    return (
        t.users.filter("role = 'student' and is_active")
        .select(
            F.col("id").alias("student_id"),
            full_name().alias("full_name"),
            "email",
            "phone",
            F.col("created_at").alias("registered_at"),
        )
        .join(per_student, "student_id", "left")
        .withColumn("active_courses_count", zero("active_courses_count"))
    )


def teachers_courses(t: Tables) -> DataFrame:
    """Teacher x course with the number of actively enrolled students."""
    courses = t.course_totals.select("course_id", "course_title", "subject", "topic_name", "course_is_active").join(
        active_by_course(t), "course_id", "left"
    )
    teachers = t.users.filter("role = 'teacher'").select(
        F.col("id").alias("teacher_id"), full_name().alias("full_name"), "email"
    )
    return (
        t.course_teachers.select("course_id", "teacher_id", "assigned_at")
        .join(t.catalogue_dim(courses), "course_id")
        .join(teachers, "teacher_id")
        .select(
            "teacher_id",
            "full_name",
            "email",
            "topic_name",
            "course_id",
            "course_title",
            "subject",
            "course_is_active",
            zero("enrolled").alias("enrolled_students_count"),
            "assigned_at",
        )
    )


def upcoming_webinars(t: Tables, days: int = 30) -> DataFrame:
    """Published webinars from now to ``days`` ahead (both ends included)."""
    webinars = t.lesson_outline.filter(
        (F.col("lesson_type") == "webinar")
        & F.col("is_published")
        & F.col("webinar_scheduled_at").between(t.now, t.now + F.make_dt_interval(F.lit(days)))
    ).join(t.course_totals.select("course_id", "subject", "topic_name"), "course_id")
    names = (
        t.course_teachers.join(
            t.users.select(F.col("id").alias("teacher_id"), short_name().alias("name")), "teacher_id"
        )
        .groupBy("course_id")
        .agg(F.expr("listagg(DISTINCT name, ', ') WITHIN GROUP (ORDER BY name)").alias("teachers"))
    )
    return (
        webinars.join(active_by_course(t), "course_id", "left")
        .join(names, "course_id", "left")
        .select(
            "lesson_id",
            "lesson_title",
            "webinar_scheduled_at",
            "webinar_url",
            "duration_minutes",
            "module_title",
            "course_id",
            "course_title",
            "subject",
            "topic_name",
            zero("enrolled").alias("enrolled_count"),
            "teachers",
        )
    )


def teacher_ids_by_course(t: Tables) -> DataFrame:
    return t.course_teachers.groupBy("course_id").agg(F.sort_array(F.collect_set("teacher_id")).alias("teacher_ids"))


def pending_homeworks(t: Tables, with_teachers: bool = True) -> DataFrame:
    """Hand-ins waiting for manual grading, with the course's teachers ([NULL] when it has none)."""
    outline = t.homework_outline.filter("check_type = 'manual'")
    pending = t.homework_submissions.filter("status = 'submitted'").select(
        F.col("id").alias("submission_id"), "submitted_at", "student_id", "homework_id", "answer_text", "answer_url"
    )
    rows = pending.join(t.catalogue_dim(outline), "homework_id").join(
        people(t, short_name().alias("student_name")), "student_id"
    )
    columns = []
    if with_teachers:
        teachers = teacher_ids_by_course(t)
        rows = rows.join(F.broadcast(teachers) if t.assignments_fit else teachers, "course_id", "left")
        columns = [F.coalesce("teacher_ids", F.array(F.lit(None).cast("string"))).alias("teacher_ids")]
    return rows.select(
        "submission_id",
        "submitted_at",
        "student_id",
        "student_name",
        "homework_id",
        "homework_title",
        "max_score",
        "lesson_id",
        "lesson_title",
        "module_title",
        "course_id",
        "course_title",
        *columns,
        "answer_text",
        "answer_url",
    )


def student_progress(t: Tables) -> DataFrame:
    """Every enrolment with lesson and homework progress."""
    return (
        t.enrolment_facts.join(people(t, short_name().alias("student_name"), "email"), "student_id")
        .join(t.outline_dim(t.course_totals), "course_id")
        .select(
            "student_id",
            "student_name",
            "email",
            "course_id",
            "course_title",
            "subject",
            "topic_name",
            "enrolled_at",
            F.col("is_active").alias("enrollment_active"),
            "total_lessons",
            "completed_lessons",
            pct1_or_zero(F.col("completed_lessons"), F.col("total_lessons")).alias("lessons_progress_pct"),
            "total_homeworks",
            F.col("graded_homeworks").alias("submitted_homeworks"),
            F.when(F.col("total_homeworks") > 0, F.col("total_score")).otherwise(F.lit(0)).alias("total_score"),
            "max_possible_score",
            pct1_or_zero(F.col("total_score"), F.col("max_possible_score")).alias("score_pct"),
        )
    )


def course_finance(t: Tables) -> DataFrame:
    """Revenue per course; courses without payments are kept."""
    amount, kind = F.col("amount"), F.col("subscription_type")
    paid = t.payments.groupBy("course_id").agg(
        F.sum(amount).alias("total_revenue"),
        F.sum(F.when(kind == "monthly", amount)).alias("revenue_monthly"),
        F.sum(F.when(kind == "yearly", amount)).alias("revenue_yearly"),
        F.count("*").alias("payments_count"),
        F.countDistinct("student_id").alias("paying_students_count"),
        F.min("payment_date").alias("first_payment_date"),
        F.max("payment_date").alias("last_payment_date"),
    )
    return t.course_totals.join(paid, "course_id", "left").select(
        "course_id",
        "course_title",
        "subject",
        "topic_name",
        *[money_or_zero(c).alias(c) for c in ("total_revenue", "revenue_monthly", "revenue_yearly")],
        zero("payments_count").alias("payments_count"),
        zero("paying_students_count").alias("paying_students_count"),
        "first_payment_date",
        "last_payment_date",
    )


def money_or_zero(col: str | Column) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col, F.lit(0).cast("decimal(20,2)")).cast("decimal(20,2)")


def side_by_side(*parts: DataFrame) -> DataFrame:
    """One row with the columns of several one-row frames: stacked, then merged by ``max``."""
    columns = [c for part in parts for c in part.columns]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in columns])


def admin_dashboard(t: Tables) -> DataFrame:
    """One row of platform totals: one conditional aggregate per table."""
    active = F.col("is_active")
    users = t.users.agg(
        F.count(F.when((F.col("role") == "student") & active, 1)).alias("total_active_students"),
        F.count(F.when((F.col("role") == "teacher") & active, 1)).alias("total_active_teachers"),
    )
    courses = t.courses.agg(F.count(F.when(active, 1)).alias("total_active_courses"))
    enrolled = t.enrollments.agg(F.count(F.when(active, 1)).alias("total_active_enrollments"))
    work = t.homework_submissions.agg(
        F.count(F.when(F.col("status") == "submitted", 1)).alias("pending_hw_checks"),
        F.count("*").alias("total_submissions"),
    )
    same = {p: F.trunc("payment_date", p) == F.trunc(t.today, p) for p in ("month", "year")}
    money = t.payments.agg(
        money_or_zero(F.sum(F.when(same["month"], F.col("amount")))).alias("revenue_current_month"),
        money_or_zero(F.sum(F.when(same["year"], F.col("amount")))).alias("revenue_current_year"),
        money_or_zero(F.sum("amount")).alias("revenue_total"),
    )
    week_ago = t.now - F.make_dt_interval(F.lit(7))
    seen = t.activity_log.filter(F.col("created_at") >= week_ago).agg(
        F.countDistinct("user_id").alias("active_users_last_7days")
    )
    webinar = t.lessons.filter(
        (F.col("lesson_type") == "webinar") & F.col("is_published") & (F.col("webinar_scheduled_at") > t.now)
    ).agg(F.min("webinar_scheduled_at").alias("next_webinar_at"))
    row = side_by_side(users, courses, enrolled, work, money, seen, webinar)
    return row.select(F.lit(1).alias("id"), "*", t.now.alias("refreshed_at"))


def stored(t: Tables, name: str, build) -> DataFrame:
    """The refreshed snapshot of a mart if the tables carry one (``Store.tables``), else the mart built now."""
    return t.frames[name] if name in t.frames else build(t)


def student_scores(t: Tables) -> DataFrame:
    """Active enrolments of courses with homework: score, share of the maximum, rank in the course."""
    scored = t.active_facts.join(
        t.outline_dim(t.course_totals.filter("total_homeworks > 0")), "course_id"
    )
    graded_score = F.when(F.col("scored_homeworks") > 0, F.col("total_score"))  # no score at all has no share
    return (
        rank_within(t, scored, "total_score", "rank_in_course")
        .join(people(t, full_name().alias("full_name"), "email"), "student_id")
        .select(
            "student_id",
            "full_name",
            "email",
            "course_id",
            "course_title",
            "subject",
            "topic_name",
            "total_score",
            "max_possible_score",
            pct1(graded_score, F.col("max_possible_score")).alias("score_pct"),
            F.col("graded_homeworks").alias("completed_hw_count"),
            F.col("total_homeworks").alias("total_hw_count"),
            "rank_in_course",
            t.now.alias("refreshed_at"),
        )
    )


def completion_facts(t: Tables) -> DataFrame:
    return (
        t.active_facts
        .join(t.outline_dim(t.course_totals), "course_id")
        .withColumn("completion_pct", pct1_or_zero(F.col("completed_lessons"), F.col("total_lessons")))
    )


def course_completion(t: Tables) -> DataFrame:
    """Active enrolments with lesson completion and the course average (of unrounded shares)."""
    rows = completion_facts(t)
    # total_lessons is constant inside a course, so the mean share is sum(done) / (n * total)
    means = rows.groupBy("course_id").agg(
        pct1_or_zero(F.sum("completed_lessons"), F.count("*") * F.max("total_lessons")).alias("avg_completion_pct_in_course")
    )
    return rows.join(t.catalogue_dim(means), "course_id").select(
        "student_id",
        "course_id",
        "course_title",
        "subject",
        "topic_name",
        "total_lessons",
        "completed_lessons",
        "completion_pct",
        "avg_completion_pct_in_course",
        t.now.alias("refreshed_at"),
    )


def mean_completion(t: Tables) -> DataFrame:
    """course_id -> mean of the rounded completion shares of active enrolments, by the stored mart if there is one."""
    return stored(t, "mv_course_completion", completion_facts).groupBy("course_id").agg(
        mean1(F.sum((F.col("completion_pct") * 10).cast("long")), F.count("*")).alias("avg_completion_pct")
    )


def work_counts(t: Tables, submissions: DataFrame) -> DataFrame:
    """(course_id, teacher_id) -> manual hand-ins checked by the teacher, and under no teacher those that wait."""
    manual = t.outline_dim(
        t.homework_outline.filter("check_type = 'manual'").select("homework_id", "course_id")
    )
    work = submissions.select("homework_id", "status", "checked_by").join(manual, "homework_id")
    kinds = F.array(
        F.when(F.col("status") == "submitted", F.struct(F.lit(None).cast("string").alias("teacher_id"), F.lit(1).alias("pending"), F.lit(0).alias("checked"))),
        F.when(F.col("checked_by").isNotNull(), F.struct(F.col("checked_by").alias("teacher_id"), F.lit(0).alias("pending"), F.lit(1).alias("checked"))),
    )
    return (
        work.select("course_id", F.explode(F.array_compact(kinds)).alias("w"))
        .groupBy("course_id", "w.teacher_id")
        .agg(F.sum("w.pending").alias("pending"), F.sum("w.checked").alias("checked"))
    )


def teacher_workload(t: Tables, counts: DataFrame | None = None) -> DataFrame:
    """Active teachers with at least one course: courses, distinct students, work pending and done.

    Distinct students are counted per *set of courses*, not per teacher:
    teachers of the same courses share the count, so enrolments are never
    multiplied by the number of teachers of a course.  ``counts`` are the work
    counts of the courses, if they are known.
    """
    teachers = t.users.filter("role = 'teacher' and is_active").select(
        F.col("id").alias("teacher_id"), full_name().alias("full_name"), "email"
    )
    taught = t.course_teachers.groupBy("teacher_id").agg(F.sort_array(F.collect_set("course_id")).alias("courses"))
    sets = taught.select("courses").distinct()
    members = sets.select("courses", F.explode("courses").alias("course_id"))
    enrolled = t.enrollments.filter("is_active").select("student_id", "course_id")
    students = (
        per_teacher_rows(t, enrolled, members)
        .groupBy("courses")
        .agg(F.countDistinct("student_id").alias("total_students"))
    )
    counts = work_counts(t, t.homework_submissions) if counts is None else counts
    pending = counts.filter("teacher_id is null").select("course_id", "pending")
    checked = counts.filter("teacher_id is not null").select("course_id", "teacher_id", "checked")
    per_teacher = (
        t.course_teachers.select("course_id", "teacher_id")
        .join(t.catalogue_dim(pending), "course_id", "left")
        .join(checked, ["course_id", "teacher_id"], "left")
        .groupBy("teacher_id")
        .agg(
            F.count("*").alias("courses_count"),
            F.sum(zero("pending")).alias("pending_checks"),
            F.sum(zero("checked")).alias("total_checked"),
        )
    )
    return (
        teachers.join(per_teacher, "teacher_id")
        .join(taught, "teacher_id")
        .join(students, "courses", "left")
        .select(
            "teacher_id",
            "full_name",
            "email",
            "courses_count",
            zero("total_students").alias("total_students"),
            "pending_checks",
            "total_checked",
            t.now.alias("refreshed_at"),
        )
    )

