"""Data behind the web pages, for all users at once or one by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learnmart.functions.exprs import day, enum_order, stamp, zero
from learnmart.model import Tables
from learnmart.operators import lookups, marts
from learnmart.operators.facts import people, per_teacher_rows, published_lessons
from learnmart.operators.marts import money_or_zero, side_by_side
from learnmart.plans import finance


def platform_counts(t: Tables) -> DataFrame:
    """Cards of the administrator page; unlike the dashboard, inactive courses count."""
    active = F.col("is_active")
    users = t.users.agg(
        F.count(F.when((F.col("role") == "student") & active, 1)).alias("total_students"),
        F.count(F.when((F.col("role") == "teacher") & active, 1)).alias("total_teachers"),
    )
    courses = t.courses.agg(F.count("*").alias("total_courses"))
    money = t.payments.agg(money_or_zero(F.sum("amount")).alias("total_revenue"))
    return side_by_side(users, courses, money)


def users_by_role(t: Tables) -> DataFrame:
    return t.users.groupBy("role").agg(F.count("*").alias("users_count")).select(
        F.initcap("role").alias("role_label"), "users_count"
    )


def revenue_last_months(t: Tables, months: int = 6) -> DataFrame:
    """The latest months that have payments, oldest first."""
    monthly = t.payments.groupBy(F.date_format(F.trunc("payment_date", "month"), "yyyy-MM").alias("month_label")).agg(
        money_or_zero(F.sum("amount")).alias("revenue")
    )
    return monthly.orderBy(F.desc("month_label")).limit(months).orderBy("month_label")


def monthly_finance(t: Tables) -> DataFrame:
    return (
        finance.by_month(t)
        .select("month_label", "payments_count", "paying_students", "revenue")
        .orderBy(F.desc("month_label"))
    )


def user_directory(t: Tables) -> DataFrame:
    return t.users.orderBy(enum_order(F.col("role"), "user_role"), F.desc("created_at"), "id").select(
        "id", "first_name", "last_name", "email", "role", "is_active", day(F.col("created_at")).alias("created")
    )


def enroll_choices(t: Tables) -> DataFrame:
    """Who and what the enrolment form offers: active students, and every course."""
    students = t.users.filter("role = 'student' and is_active").select(
        F.lit("student").alias("kind"),
        F.col("id").cast("string").alias("id"),
        F.concat("first_name", F.lit(" "), "last_name").alias("label"),
        "email",
    )
    courses = t.courses.select(
        F.lit("course"), F.col("id").cast("string"), F.col("title"), F.lit(None).cast("string")
    )
    return students.union(courses)


def teacher_student_count(t: Tables) -> DataFrame:
    """Students per teacher, once per course: course counts summed, no student rows repeated."""
    students = t.users.filter("is_active").select(F.col("id").alias("student_id"))
    per_course = (
        t.enrollments.filter("is_active")
        .join(students, "student_id", "left_semi")
        .groupBy("course_id")
        .agg(F.count("*").alias("n"))
    )
    teachers = t.users.filter("role = 'teacher'").select(F.col("id").alias("teacher_id"))
    counts = (
        t.course_teachers.select("course_id", "teacher_id")
        .join(t.catalogue_dim(per_course), "course_id")
        .groupBy("teacher_id")
        .agg(F.sum("n").alias("n"))
    )
    return teachers.join(counts, "teacher_id", "left").select("teacher_id", zero("n").alias("students_count"))


def teacher_pending_count(t: Tables) -> DataFrame:
    """Work waiting on each teacher's courses, whatever its check type."""
    homeworks = t.catalogue_dim(t.homework_outline.select("homework_id", "course_id"))
    per_course = (
        t.homework_submissions.filter("status = 'submitted'")
        .select("homework_id")
        .join(homeworks, "homework_id")
        .groupBy("course_id")
        .agg(F.count("*").alias("n"))
    )
    teachers = t.users.filter("role = 'teacher'").select(F.col("id").alias("teacher_id"))
    counts = (
        t.course_teachers.select("course_id", "teacher_id")
        .join(t.catalogue_dim(per_course), "course_id")
        .groupBy("teacher_id")
        .agg(F.sum("n").alias("n"))
    )
    return teachers.join(counts, "teacher_id", "left").select("teacher_id", zero("n").alias("pending_count"))


def teacher_pending_list(t: Tables, teacher_id=None) -> DataFrame:
    """Work waiting on each teacher's courses, with the answers."""
    outline = t.homework_outline
    rows = (
        t.homework_submissions.filter("status = 'submitted'")
        .select(F.col("id").alias("submission_id"), "student_id", "homework_id", "submitted_at", "answer_text", "answer_url")
        .join(
            t.catalogue_dim(outline.select("homework_id", "homework_title", "max_score", "course_id", "course_title")),
            "homework_id",
        )
        .join(people(t, F.concat("first_name", F.lit(" "), "last_name").alias("student_name")), "student_id")
    )
    return (
        per_teacher_rows(t, rows, lookups.teaching(t, teacher_id))
        .orderBy("submitted_at", "submission_id", "teacher_id")
        .select(
            "teacher_id",
            "submission_id",
            stamp(F.col("submitted_at")).alias("submitted_date"),
            "homework_title",
            "max_score",
            "answer_text",
            "answer_url",
            "course_title",
            "student_name",
        )
    )


def student_courses(t: Tables, student_id=None) -> DataFrame:
    rows = marts.student_progress(t).filter("enrollment_active")
    if student_id is not None:
        rows = rows.filter(F.col("student_id") == student_id)
    return rows.orderBy(F.desc("lessons_progress_pct"), "student_id", "course_id").select(
        "student_id",
        "course_id",
        "course_title",
        "subject",
        "topic_name",
        "completed_lessons",
        "total_lessons",
        "lessons_progress_pct",
        "submitted_homeworks",
        "total_homeworks",
        "score_pct",
    )


def _completed(t: Tables) -> DataFrame:
    return t.lesson_progress.filter("is_completed").select("student_id", "lesson_id")


def course_outline(t: Tables, student_id=None, course_id=None) -> DataFrame:
    """Published lessons by module for each active enrolment, as nested arrays.

    The nested outline is built once per course; each enrolment only marks its
    finished lessons (a list no longer than the course) in it, so no lesson rows
    are multiplied by students.
    """
    lesson_fields = F.struct("lesson_order", "lesson_id", "lesson_title", "lesson_type", "duration_minutes")
    module = ("module_order", "module_id", "module_title")
    outline = (
        published_lessons(t)
        .groupBy("course_id", *module)
        .agg(F.sort_array(F.collect_list(lesson_fields)).alias("lessons"))
        .groupBy("course_id")
        .agg(F.sort_array(F.collect_list(F.struct(*module, "lessons"))).alias("outline"))
    )
    titles = t.course_totals.select("course_id", "course_title")
    marked = """
        transform(coalesce(outline, array()), m -> named_struct(
            'module_id', m.module_id, 'module_title', m.module_title,
            'lessons', transform(m.lessons, l -> named_struct(
                'lesson_id', l.lesson_id, 'lesson_title', l.lesson_title, 'lesson_type', l.lesson_type,
                'duration_minutes', l.duration_minutes, 'is_completed', array_contains(coalesce(done, array()), l.lesson_id)))))"""
    enrolled, progress = t.enrollments.filter("is_active"), _completed(t)
    if student_id is not None:
        enrolled, progress = (df.filter(F.col("student_id") == student_id) for df in (enrolled, progress))
    if course_id is not None:
        enrolled = enrolled.filter(F.col("course_id") == course_id)
    done = (
        progress.join(t.catalogue_dim(published_lessons(t).select("lesson_id", "course_id")), "lesson_id")
        .groupBy("student_id", "course_id")
        .agg(F.collect_list("lesson_id").alias("done"))
    )
    return (
        enrolled.select("student_id", "course_id")
        .join(done, ["student_id", "course_id"], "left")
        .join(t.catalogue_dim(titles.join(outline, "course_id", "left")), "course_id")
        .select("student_id", "course_id", "course_title", F.expr(marked).alias("modules"))
    )


def lesson_detail(t: Tables, student_id=None, lesson_id=None) -> DataFrame:
    """Every lesson an actively enrolled student may open, with completion."""
    lessons = t.lesson_outline.select(
        "lesson_id", "lesson_title", "lesson_type", "duration_minutes", "webinar_scheduled_at", "is_published", "course_id",
        "course_title",
    )
    if lesson_id is not None:
        lessons = lessons.filter(F.col("lesson_id") == lesson_id)
    enrolled = t.enrollments.filter("is_active").select("student_id", "course_id")
    done = _completed(t).withColumn("done", F.lit(True))
    if student_id is not None:
        enrolled, done = (df.filter(F.col("student_id") == student_id) for df in (enrolled, done))
    return (
        enrolled.join(t.catalogue_dim(lessons), "course_id")
        .join(done, ["student_id", "lesson_id"], "left")
        .select(
            "student_id",
            "lesson_id",
            "lesson_title",
            "lesson_type",
            "duration_minutes",
            "webinar_scheduled_at",
            "is_published",
            "course_id",
            "course_title",
            F.coalesce("done", F.lit(False)).alias("is_completed"),
        )
    )


def lesson_homeworks(t: Tables, student_id=None, lesson_id=None) -> DataFrame:
    """Homework of the lessons open to each active student, with the student's hand-in if any."""
    homeworks = t.homework_outline
    if lesson_id is not None:
        homeworks = homeworks.filter(F.col("lesson_id") == lesson_id)
    enrolled = t.enrollments.filter("is_active").select("student_id", "course_id")
    work = t.homework_submissions.select(
        "student_id", "homework_id", "status", "score", "answer_text", "answer_url", "checked_at"
    )
    if student_id is not None:
        enrolled, work = (df.filter(F.col("student_id") == student_id) for df in (enrolled, work))
    return (
        enrolled.join(t.catalogue_dim(homeworks), "course_id")
        .join(work, ["student_id", "homework_id"], "left")
        .select(
            "student_id",
            "lesson_id",
            "homework_id",
            "homework_title",
            "check_type",
            "max_score",
            "deadline_hours",
            "status",
            "score",
            "answer_text",
            "answer_url",
            "checked_at",
        )
    )
