"""Row-change rules: what happens to rows when they are written.

Each rule is a function of frames.  The change jobs and the streams apply
them; nothing here keeps state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learnmart import schemas
from learnmart.functions.exprs import hash_id
from learnmart.model import Tables
from learnmart.schemas import MARTS

LOG_COLUMNS = ["id", "user_id", "action", "entity_type", "entity_id", "metadata", "created_at"]


def first_reason(**conditions: Column) -> Column:
    """Name of the first condition that holds, in the given order; NULL when none does."""
    return F.coalesce(*[F.when(cond, F.lit(name)) for name, cond in conditions.items()])


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def log_rows(
    df: DataFrame, at: Column, action: str, entity_type: str, user: str, entity: str, metadata: dict[str, Column], key: list
) -> DataFrame:
    """Activity-log rows; the id is a hash of action and key, so a repeated write makes the same row."""
    body = F.to_json(F.struct(*[v.alias(k) for k, v in metadata.items()]), {"ignoreNullFields": "false"})
    return df.select(
        hash_id(F.lit(action), *key).alias("id"),
        F.col(user).cast("string").alias("user_id"),
        F.lit(action).alias("action"),
        F.lit(entity_type).alias("entity_type"),
        F.col(entity).cast("string").alias("entity_id"),
        body.alias("metadata"),
        at.alias("created_at"),
    )


# -- submissions ------------------------------------------------------------------


def judge_scores(t: Tables, submissions: DataFrame) -> DataFrame:
    """Submissions with a ``reject_reason``: score above the maximum, or given before grading."""
    limits = t.outline_dim(t.homeworks.select(F.col("id").alias("homework_id"), F.col("max_score").alias("_max")))
    return (
        submissions.join(limits, "homework_id", "left")
        .withColumn(
            "reject_reason",
            first_reason(
                score_above_max=F.col("score") > F.col("_max"),
                score_while_submitted=F.col("score").isNotNull() & (F.col("status") == "submitted"),
            ),
        )
        .drop("_max")
    )


def auto_check(t: Tables, submissions: DataFrame) -> DataFrame:
    """New hand-ins of automatic homework get the full score at once."""
    rules = t.outline_dim(
        t.homeworks.select(
            F.col("id").alias("homework_id"), F.col("max_score").alias("_max"), (F.col("check_type") == "auto").alias("_auto")
        )
    )
    auto = F.coalesce("_auto", F.lit(False))
    return (
        submissions.join(rules, "homework_id", "left")
        .withColumn("score", F.when(auto, F.col("_max")).otherwise(F.col("score")).cast("short"))
        .withColumn("status", F.when(auto, "auto_checked").otherwise(F.col("status")))
        .withColumn("checked_at", F.when(auto, t.now).otherwise(F.col("checked_at")))
        .drop("_max", "_auto")
    )


# -- change stamps ------------------------------------------------------------------


def touch_updated_at(table: DataFrame, changed: DataFrame, key: str, at: Column) -> DataFrame:
    """Set ``updated_at`` on rows whose key is in ``changed`` (unique keys)."""
    marks = changed.select(key, F.lit(True).alias("_changed"))
    return (
        table.join(marks, key, "left")
        .withColumn("updated_at", F.when(F.col("_changed"), at).otherwise(F.col("updated_at")))
        .drop("_changed")
        .select(*table.columns)
    )


def set_completed_at(old: DataFrame, new: DataFrame, at: Column) -> DataFrame:
    """New progress rows with completion stamps.

    Only updates are stamped: becoming complete sets both stamps, a roll-back
    clears the completion; a row inserted already complete stays as given.
    """
    before = old.select("id", F.col("is_completed").alias("_was"))
    now_done = F.col("is_completed") & (F.col("_was") == F.lit(False))
    undone = ~F.col("is_completed") & F.col("_was")
    return (
        new.join(before, "id", "left")
        .withColumn("completed_at", F.when(now_done, at).when(undone, F.lit(None)).otherwise(F.col("completed_at")))
        .withColumn("last_viewed_at", F.when(now_done, at).otherwise(F.col("last_viewed_at")))
        .drop("_was")
        .select(*new.columns)
    )


# -- audit log ------------------------------------------------------------------


def log_enrolments(old: DataFrame, new: DataFrame, at: Column) -> DataFrame:
    """Log rows for inserted enrolments and for those that became inactive; reactivation logs nothing."""
    before = old.select("id", F.col("is_active").alias("_was"))
    diff = new.join(before, "id", "left")
    inserted = log_rows(
        diff.filter("_was is null"),
        at,
        schemas.Action.ENROLL,
        "course",
        "student_id",
        "course_id",
        {"enrollment_id": F.col("id").cast("string"), "enrolled_at": iso(F.col("enrolled_at"))},
        [F.col("id"), iso(F.col("enrolled_at"))],
    )
    left = log_rows(
        diff.filter("_was and not is_active"),
        at,
        schemas.Action.UNENROLL,
        "course",
        "student_id",
        "course_id",
        {"enrollment_id": F.col("id").cast("string"), "reason": F.lit("deactivated")},
        [F.col("id"), iso(at)],
    )
    return inserted.union(left)


def log_progress(old: DataFrame, new: DataFrame, at: Column) -> DataFrame:
    """Log rows for first views (inserts) and for lessons that became complete (updates)."""
    before = old.select("id", F.col("is_completed").alias("_was"))
    diff = new.join(before, "id", "left")
    viewed = log_rows(
        diff.filter("_was is null"),
        at,
        schemas.Action.VIEW_LESSON,
        "lesson",
        "student_id",
        "lesson_id",
        {"first_view": F.lit(True)},
        [F.col("student_id"), F.col("lesson_id")],
    )
    done = log_rows(
        diff.filter("not _was and is_completed"),
        at,
        schemas.Action.COMPLETE_LESSON,
        "lesson",
        "student_id",
        "lesson_id",
        {"completed_at": iso(F.col("completed_at"))},
        [F.col("student_id"), F.col("lesson_id"), iso(F.col("completed_at"))],
    )
    return viewed.union(done)


# -- role checks ------------------------------------------------------------------


def judge_role(t: Tables, rows: DataFrame, column: str, role: str) -> DataFrame:
    """Rows with a ``reject_reason`` when ``column`` is not a user of ``role``.

    A user may appear in any share of the rows, so distinct ids are judged
    first (they combine on the map side) and only the bad ones are joined back.
    """
    ids = rows.select(column).distinct()
    known = t.users.select(F.col("id").alias(column), F.col("role").alias("_role"))
    bad = ids.join(known, column, "left").select(
        column,
        first_reason(user_not_found=F.col("_role").isNull(), **{f"not_a_{role}": F.col("_role") != role}).alias(
            "reject_reason"
        ),
    ).filter("reject_reason is not null")
    return rows.join(bad, column, "left").select(*rows.columns, "reject_reason")


def check_teacher_role(t: Tables, assignments: DataFrame) -> DataFrame:
    return judge_role(t, assignments, "teacher_id", "teacher")


def check_student_role(t: Tables, enrolments: DataFrame) -> DataFrame:
    return judge_role(t, enrolments, "student_id", "student")


# -- refresh queue ------------------------------------------------------------------


def queue_refresh(statements: DataFrame, key: list[str], at: Column) -> DataFrame:
    """Four stale-mart rows for every enrolment write in ``statements``."""
    return statements.withColumn("view_name", F.explode(F.array(*[F.lit(m) for m in MARTS]))).select(
        hash_id("view_name", *key).alias("id"),
        "view_name",
        at.alias("triggered_at"),
        F.lit(False).alias("processed"),
    )
