"""Change jobs: batches of commands checked and applied to the tables.

Every job has two steps.  ``decide_*`` gives each command an outcome and, when
rejected, the first reason in the fixed order of checks.  ``apply_*`` turns
decisions into changed tables, log rows and stale-mart rows.  ``run`` writes
the decisions between the two, which cuts lineage and makes the rest of the
batch repeatable.

Judged commands are written once (``Tables.cut``) before winners are chosen,
so the joins behind them run once.  When commands of one batch compete for the same row, the first valid one by
(cmd_ts, cmd_id) wins.  Winners are cut to one row per key and task before the
exchange and marked through the unique command id, so a hot key is never
gathered in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from learnmart import schemas
from learnmart.functions.exprs import full_name, hash_id, period_end, zero
from learnmart.model import Tables
from learnmart.operators import constraints, rules
from learnmart.operators.rules import first_reason
from learnmart.schemas import ENUMS
from learnmart.sources.store import Replacement, Store

REJECTED = "rejected"
AMOUNT = "decimal(10,2)"  # of payments


@dataclass
class Change:
    """What a batch changes: whole new versions of tables, and rows to append.

    ``upserts`` are the rows of the new versions that are new or not as before:
    what a keyed store writes instead of the whole table.
    """

    tables: dict[str, DataFrame] = field(default_factory=dict)
    appends: dict[str, DataFrame] = field(default_factory=dict)
    upserts: dict[str, DataFrame] = field(default_factory=dict)

    def onto(self, t: Tables) -> Tables:
        """The tables after the change."""
        frames = dict(self.tables)
        for name, rows in self.appends.items():
            base = frames[name] if name in frames else t.frames[name] if name in t.frames else None
            frames[name] = rows if base is None else append(base, rows)
        return t.replace(**frames)


def run(t: Tables, commands: DataFrame, decide: Callable, apply: Callable) -> tuple[DataFrame, Change]:
    """Decide a batch, write the decisions, and derive the change from what was written."""
    decisions = t.cut("decisions", decide(t, commands))
    return decisions, apply(t, decisions)


def run_stored(t: Tables, store: Store, commands: DataFrame, decide: Callable, apply: Callable, near: dict[str, dict[str, str]]) -> tuple[DataFrame, Change]:
    """``run`` against a store of keyed tables, and publish the change.

    ``near`` names the keyed tables that the commands touch by key, with the
    command column for each column of their layout: only rows near the commands
    are read, and only the parts that changed rows fall in are written.
    """
    frames = {name: store.near(name, commands, columns) for name, columns in near.items()}
    decisions, change = run(t.replace(**frames), commands, decide, apply)
    keyed = store.layouts()
    replace = {name: Replacement(rows) for name, rows in change.upserts.items()}
    replace |= {name: Replacement(rows) for name, rows in change.appends.items() if name in keyed}
    store.commit(at=t.as_of, replace=replace, appends={name: rows for name, rows in change.appends.items() if name not in keyed})
    return decisions, change


def append(base: DataFrame, rows: DataFrame) -> DataFrame:
    """Union by name with the base's columns and types; ids become text when kinds differ."""
    kinds = dict(rows.dtypes)
    base = base.select(*[
        F.col(c).cast("string").alias(c) if kinds.get(c) == "string" and kind != "string" else F.col(c)
        for c, kind in base.dtypes
    ])
    return base.unionByName(rows.select(*[c for c in base.columns if c in kinds]), allowMissingColumns=True)


def decisions_of(df: DataFrame) -> DataFrame:
    return df.select("cmd_id", "outcome", "reason")


def earliest(commands: DataFrame, keys: list[str]) -> DataFrame:
    """The first command per key; Spark keeps one row per key and task before the exchange."""
    order = Window.partitionBy(*keys).orderBy("cmd_ts", "cmd_id")
    return commands.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def mark_first(judged: DataFrame, candidate: Column, keys: list[str]) -> DataFrame:
    """Add ``is_first``: is this the earliest candidate command for its key?

    Commands with a reason against them are no candidates and are not joined.
    """
    refused, judged = judged.filter("reason is not null"), judged.filter("reason is null")
    winners = earliest(judged.filter(candidate).select(*keys, "cmd_ts", "cmd_id"), keys).select(
        "cmd_id", F.lit(True).alias("is_first")
    )
    marked = judged.join(winners, "cmd_id", "left").withColumn("is_first", F.coalesce("is_first", F.lit(False)))
    return marked.unionByName(refused.withColumn("is_first", F.lit(False)))


def _with_admin(t: Tables, commands: DataFrame) -> DataFrame:
    admins = t.users.filter("role = 'admin' and is_active").select(
        F.col("id").alias("admin_id"), F.lit(True).alias("admin_ok")
    )
    return commands.join(t.measured_dim("active_admins", admins), "admin_id", "left")


def _with_enrolment(t: Tables, commands: DataFrame) -> DataFrame:
    current = t.enrollments.select(
        "student_id", "course_id", F.col("id").cast("string").alias("enrollment_id"), F.col("is_active").alias("was_active")
    )
    return commands.join(current, ["student_id", "course_id"], "left")


def _with_user(t: Tables, commands: DataFrame) -> DataFrame:
    users = t.users.select(
        F.col("id").alias("student_id"),
        F.col("role").alias("user_role"),
        F.col("is_active").alias("user_active"),
        full_name().alias("user_name"),
    )
    return commands.join(users, "student_id", "left")


def _with_course(t: Tables, commands: DataFrame) -> DataFrame:
    courses = t.course_totals.select(
        "course_id", "course_title", F.col("course_is_active").alias("course_active"), "price_monthly", "price_yearly"
    )
    return commands.join(t.outline_dim(courses), "course_id", "left")


# -- enrolment ------------------------------------------------------------------

def _enrolment_reason() -> dict[str, Column]:
    return {
        "admin_not_active": F.col("admin_ok").isNull(),
        "student_not_found_or_inactive": F.col("user_role").isNull() | ~F.col("user_active"),
        "not_a_student": F.col("user_role") != "student",
        "course_not_found": F.col("course_active").isNull(),
        "course_not_active": ~F.col("course_active"),
    }


def _enrolment_outcome() -> Column:
    return (
        F.when(F.col("reason").isNotNull(), REJECTED)
        .when(~F.col("is_first"), "already_enrolled")
        .when(F.col("enrollment_id").isNotNull(), "reactivated")
        .otherwise("enrolled")
    )


def judge_enrolments(t: Tables, commands: DataFrame) -> DataFrame:
    """Commands with the first reason against each that does not depend on places already taken."""
    judged = _with_course(t, _with_user(t, _with_admin(t, commands)))
    return judged.withColumn("reason", first_reason(**_enrolment_reason()))


def settle_enrolments(t: Tables, judged: DataFrame, is_first: Column) -> DataFrame:
    """Outcomes of judged commands, given which of them is the first for its place."""
    placed = _with_enrolment(t, judged)
    open_place = is_first & ~F.coalesce("was_active", F.lit(False))
    return placed.withColumn("is_first", open_place).withColumn("outcome", _enrolment_outcome())


def decide_enrolments(t: Tables, commands: DataFrame) -> DataFrame:
    """Commands: cmd_id, cmd_ts, student_id, course_id, admin_id."""
    judged = t.cut("judged", _with_enrolment(t, judge_enrolments(t, commands)))
    open_place = F.col("reason").isNull() & ~F.coalesce("was_active", F.lit(False))
    return mark_first(judged, open_place, ["student_id", "course_id"]).withColumn("outcome", _enrolment_outcome())


def apply_enrolments(t: Tables, decisions: DataFrame) -> Change:
    done = decisions.filter(F.col("outcome").isin("enrolled", "reactivated"))
    fresh = done.filter("outcome = 'enrolled'").select(
        hash_id("student_id", "course_id").alias("id"),
        "student_id",
        "course_id",
        t.now.alias("enrolled_at"),
        F.lit(True).alias("is_active"),
    )
    again = done.filter("outcome = 'reactivated'").select("student_id", "course_id", F.lit(True).alias("_again"))
    old = t.enrollments
    new = old.join(again, ["student_id", "course_id"], "left").select(
        "id",
        "student_id",
        "course_id",
        F.when(F.col("_again"), t.now).otherwise(F.col("enrolled_at")).alias("enrolled_at"),
        (F.col("is_active") | F.coalesce("_again", F.lit(False))).alias("is_active"),
    )
    inserted = rules.log_rows(
        fresh,
        t.now,
        schemas.Action.ENROLL,
        "course",
        "student_id",
        "course_id",
        {"enrollment_id": F.col("id"), "enrolled_at": rules.iso(F.col("enrolled_at"))},
        [F.col("id"), rules.iso(F.col("enrolled_at"))],
    )
    by_admin = rules.log_rows(
        done,
        t.now,
        schemas.Action.ADMIN_ENROLL,
        "enrollment",
        "admin_id",
        "course_id",
        {"student_id": F.col("student_id"), "course_id": F.col("course_id"), "course_title": F.col("course_title")},
        [F.col("cmd_id")],
    )
    renewed = done.filter("outcome = 'reactivated'").select(
        F.col("enrollment_id").alias("id"), "student_id", "course_id", t.now.alias("enrolled_at"), F.lit(True).alias("is_active")
    )
    return Change(
        tables={"enrollments": append(new, fresh)},
        appends={
            "activity_log": inserted.union(by_admin),
            "mv_refresh_queue": rules.queue_refresh(done, ["cmd_id"], t.now),
        },
        upserts={"enrollments": fresh.union(renewed)},
    )


# -- payment ------------------------------------------------------------------


def _payment_reason(enrolled: Column | None) -> dict[str, Column]:
    kinds = F.col("subscription_type").isin(*ENUMS["subscription_type"])
    return {
        "bad_subscription_type": ~F.coalesce(kinds, F.lit(False)),
        "admin_not_active": F.col("admin_ok").isNull(),
        "not_enrolled": ~enrolled if enrolled is not None else F.lit(False),
        "course_not_found": F.col("course_active").isNull(),
        "missing_period_start": F.col("period_start").isNull(),
        "amount_not_positive": F.col("amount").isNull() | (F.col("amount") <= 0),
        "amount_out_of_range": F.col("amount").try_cast(AMOUNT).isNull(),
    }


def _with_price(df: DataFrame) -> DataFrame:
    kind = F.col("subscription_type")
    expected = F.when(kind == "monthly", F.col("price_monthly")).when(kind == "yearly", F.col("price_yearly"))
    return df.withColumn("expected_price", expected).withColumn(
        "price_differs", F.coalesce(F.col("amount") != expected, F.lit(False))
    )


def decide_payments(t: Tables, commands: DataFrame) -> DataFrame:
    """Commands: cmd_id, cmd_ts, student_id, course_id, admin_id, amount, subscription_type, period_start, notes."""
    judged = _with_price(_with_enrolment(t, _with_course(t, _with_admin(t, commands))))
    enrolled = F.coalesce("was_active", F.lit(False))
    return judged.withColumn("reason", first_reason(**_payment_reason(enrolled))).withColumn(
        "outcome", F.when(F.col("reason").isNotNull(), REJECTED).otherwise("recorded")
    )


def payment_warnings(decisions: DataFrame) -> DataFrame:
    """Accepted payments whose amount is not the list price."""
    return decisions.filter("outcome = 'recorded' and price_differs").select("cmd_id", "amount", "expected_price")


def apply_payments(t: Tables, decisions: DataFrame) -> Change:
    done = decisions.filter("outcome = 'recorded'").withColumn("payment_id", hash_id("cmd_id"))
    done = done.withColumn("period_end", period_end(F.col("period_start"), F.col("subscription_type")))
    rows = done.select(
        F.col("payment_id").alias("id"),
        "student_id",
        "course_id",
        F.col("amount").try_cast(AMOUNT).alias("amount"),
        "subscription_type",
        t.today.alias("payment_date"),
        "period_start",
        "period_end",
        "notes",
        F.col("admin_id").alias("created_by"),
        t.now.alias("created_at"),
    )
    fields = ("student_id", "course_id", "course_title", "amount", "subscription_type", "period_start", "period_end")
    log = rules.log_rows(
        done, t.now, schemas.Action.RECORD_PAYMENT, "payment", "admin_id", "payment_id", {c: F.col(c) for c in fields}, [F.col("cmd_id")]
    )
    return Change(appends={"payments": rows, "activity_log": log})


# -- enrol and pay as one unit ------------------------------------------------------


def decide_enrol_and_pay(t: Tables, commands: DataFrame) -> DataFrame:
    """Both steps or neither.  Commands carry the fields of both."""
    judged = _with_enrolment(t, _with_course(t, _with_user(t, _with_admin(t, commands))))
    judged = _with_price(judged)
    reasons = {**_payment_reason(None), **_enrolment_reason()}
    order = [*_enrolment_reason(), *[k for k in _payment_reason(None) if k not in _enrolment_reason()]]
    judged = t.cut("judged", judged.withColumn("reason", first_reason(**{k: reasons[k] for k in order})))
    open_place = F.col("reason").isNull() & ~F.coalesce("was_active", F.lit(False))
    judged = mark_first(judged, open_place, ["student_id", "course_id"])
    return judged.withColumn("outcome", _enrolment_outcome())


def apply_enrol_and_pay(t: Tables, decisions: DataFrame) -> Change:
    paid = decisions.withColumn(
        "outcome", F.when(F.col("outcome") == REJECTED, REJECTED).otherwise("recorded")
    )
    enrol, pay = apply_enrolments(t, decisions), apply_payments(t, paid)
    return Change(
        tables=enrol.tables,
        appends={
            "payments": pay.appends["payments"],
            "activity_log": enrol.appends["activity_log"].union(pay.appends["activity_log"]),
            "mv_refresh_queue": enrol.appends["mv_refresh_queue"],
        },
        upserts=enrol.upserts,
    )


# -- grading ------------------------------------------------------------------


def decide_grades(t: Tables, commands: DataFrame) -> DataFrame:
    """Commands: cmd_id, cmd_ts, submission_id, teacher_id, score, comment."""
    work = t.homework_submissions.select(
        F.col("id").alias("submission_id"), "homework_id", "student_id", "status"
    )
    outline = t.outline_dim(t.homework_outline.select("homework_id", "check_type", "max_score", "course_id"))
    pairs = t.course_teachers.select("course_id", "teacher_id", F.lit(True).alias("teaches"))
    judged = t.cut(
        "judged",
        commands.join(work, "submission_id", "left")
        .join(outline, "homework_id", "left")
        .join(t.assignment_dim(pairs), ["course_id", "teacher_id"], "left")
        .withColumn(
            "reason",
            first_reason(
                submission_not_found=F.col("status").isNull() | F.col("check_type").isNull(),
                auto_checked_homework=F.col("check_type") == "auto",
                already_checked=F.col("status") != "submitted",
                not_course_teacher=F.col("teaches").isNull(),
                score_out_of_range=(F.col("score") < 0) | (F.col("score") > F.col("max_score")),
            ),
        ),
    )
    first = earliest(judged.filter("reason is null").select("submission_id", "cmd_ts", "cmd_id"), ["submission_id"]).select(
        "submission_id", F.struct("cmd_ts", "cmd_id").alias("first_grade")
    )
    first = t.measured(t.cut("first", first))
    # The status check precedes the later ones: once graded, every later command meets it first.
    after = F.struct("cmd_ts", "cmd_id") > F.col("first_grade")
    return (
        judged.join(first, "submission_id", "left")
        .withColumn("reason", F.when(after, "already_checked").otherwise(F.col("reason")))
        .drop("first_grade")
        .withColumn("outcome", F.when(F.col("reason").isNotNull(), REJECTED).otherwise("graded"))
    )


def apply_grades(t: Tables, decisions: DataFrame) -> Change:
    done = decisions.filter("outcome = 'graded'")
    grades = t.measured(done.select(
        F.col("submission_id").alias("id"), F.col("score").alias("_score"), F.col("teacher_id").alias("_by"),
        F.lit(True).alias("_graded"),
    ))
    old = t.homework_submissions
    changed = {
        "score": F.col("_score").cast("short"),
        "status": F.lit("checked"),
        "checked_by": F.col("_by"),
        "checked_at": t.now,
    }
    new = old.join(grades, "id", "left").select(*[
        F.when(F.col("_graded"), changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in old.columns
    ])
    graded = old.join(grades, "id").select(*[changed[c].alias(c) if c in changed else F.col(c) for c in old.columns])
    fields = ("homework_id", "student_id", "score", "max_score", "comment")
    log = rules.log_rows(
        done,
        t.now,
        schemas.Action.CHECK_HOMEWORK,
        "homework_submission",
        "teacher_id",
        "submission_id",
        {c: F.col(c) for c in fields},
        [F.col("submission_id")],
    )
    return Change(tables={"homework_submissions": new}, appends={"activity_log": log}, upserts={"homework_submissions": graded})


def first_pending_grades(t: Tables, score: int, teacher_id=None, student_id=None, comment: str | None = None) -> DataFrame:
    """Grade commands for the oldest waiting manual work of each student (or of one).

    Without a teacher, the course's first teacher grades.
    """
    manual = t.homework_outline.filter("check_type = 'manual'").select("homework_id", "course_id")
    waiting = t.homework_submissions.filter("status = 'submitted'")
    if student_id is not None:
        waiting = waiting.filter(F.col("student_id") == student_id)
    order = Window.partitionBy("student_id").orderBy("submitted_at", "id")
    oldest = (
        waiting.select("student_id", "homework_id", "submitted_at", "id")
        .join(t.outline_dim(manual), "homework_id")
        .withColumn("_n", F.row_number().over(order))
        .filter("_n = 1")
        .select("submitted_at", "id", "course_id")
    )
    if teacher_id is not None:
        oldest = oldest.withColumn("teacher_id", F.lit(teacher_id))
    else:
        first = t.course_teachers.groupBy("course_id").agg(F.min("teacher_id").alias("teacher_id"))
        oldest = oldest.join(t.catalogue_dim(first), "course_id", "left")
    return oldest.select(
        F.concat(F.lit("first-"), F.col("id").cast("string")).alias("cmd_id"),
        t.now.alias("cmd_ts"),
        F.col("id").alias("submission_id"),
        "teacher_id",
        F.lit(score).cast("short").alias("score"),
        F.lit(comment).cast("string").alias("comment"),
    )


# -- deactivation ------------------------------------------------------------------


def decide_deactivations(t: Tables, commands: DataFrame) -> DataFrame:
    """Commands: cmd_id, cmd_ts, student_id, admin_id, note."""
    reason = first_reason(
        admin_not_active=F.col("admin_ok").isNull(),
        user_not_found=F.col("user_role").isNull(),
        not_a_student=F.col("user_role") != "student",
    )
    judged = t.cut("judged", _with_user(t, _with_admin(t, commands)).withColumn("reason", reason))
    active = t.enrollments.filter("is_active").select("student_id")
    counts = active.groupBy("student_id").agg(F.count("*").alias("_n"))
    return (
        mark_first(judged, F.col("reason").isNull(), ["student_id"])
        .join(counts, "student_id", "left")
        .withColumn("courses_affected", F.when(F.col("is_first"), zero("_n")).otherwise(F.lit(0).cast("long")))
        .drop("_n")
        .withColumn(
            "outcome",
            F.when(F.col("reason").isNotNull(), REJECTED)
            .when(F.col("is_first") & F.col("user_active"), "deactivated")
            .otherwise("already_inactive"),
        )
    )


def apply_deactivations(t: Tables, decisions: DataFrame) -> Change:
    valid = decisions.filter(F.col("outcome") != REJECTED)
    gone = valid.filter("is_first").select("student_id", F.lit(True).alias("_gone"))
    turned = valid.filter("is_first and user_active").select(F.col("student_id").alias("id"))
    users = rules.touch_updated_at(t.users, turned, "id", t.now)
    users = users.join(gone.withColumnRenamed("student_id", "id"), "id", "left").select(*[
        (F.col("is_active") & F.col("_gone").isNull()).alias("is_active") if c == "is_active" else F.col(c)
        for c in t.users.columns
    ])
    marked = t.enrollments.join(gone, "student_id", "left")
    new = marked.select(*[
        (F.col("is_active") & F.col("_gone").isNull()).alias("is_active") if c == "is_active" else F.col(c)
        for c in t.enrollments.columns
    ])
    left = marked.filter("_gone and is_active")
    unenrolled = rules.log_rows(
        left,
        t.now,
        schemas.Action.UNENROLL,
        "course",
        "student_id",
        "course_id",
        {"enrollment_id": F.col("id").cast("string"), "reason": F.lit("deactivated")},
        [F.col("id"), rules.iso(t.now)],
    )
    by_admin = rules.log_rows(
        valid,
        t.now,
        schemas.Action.DEACTIVATE_STUDENT,
        "user",
        "admin_id",
        "student_id",
        {"student_name": F.col("user_name"), "reason": F.col("note"), "courses_affected": F.col("courses_affected")},
        [F.col("cmd_id")],
    )
    return Change(
        tables={"users": users, "enrollments": new},
        appends={
            "activity_log": unenrolled.union(by_admin),
            "mv_refresh_queue": rules.queue_refresh(left, ["id"], t.now),
        },
        upserts={
            "users": users.join(turned, "id", "left_semi"),
            "enrollments": left.select(*[F.lit(False).alias(c) if c == "is_active" else F.col(c) for c in t.enrollments.columns]),
        },
    )


# -- lessons and hand-ins ------------------------------------------------------------


def decide_completions(t: Tables, commands: DataFrame) -> DataFrame:
    """Commands: cmd_id, cmd_ts, student_id, lesson_id."""
    lessons = t.lesson_outline.select("lesson_id", "course_id")
    judged = commands.join(t.outline_dim(lessons), "lesson_id", "left")
    judged = _with_enrolment(t, judged)
    progress = t.lesson_progress.select(
        "student_id", "lesson_id", F.col("id").cast("string").alias("progress_id"), F.col("is_completed").alias("was_completed")
    )
    reason = first_reason(
        lesson_not_found=F.col("course_id").isNull(), not_enrolled=~F.coalesce("was_active", F.lit(False))
    )
    judged = t.cut("judged", judged.join(progress, ["student_id", "lesson_id"], "left").withColumn("reason", reason))
    open_lesson = F.col("reason").isNull() & ~F.coalesce("was_completed", F.lit(False))
    return mark_first(judged, open_lesson, ["student_id", "lesson_id"]).withColumn(
        "outcome",
        F.when(F.col("reason").isNotNull(), REJECTED)
        .when(~F.col("is_first"), "already_complete")
        .when(F.col("was_completed").isNull(), "inserted")
        .otherwise("completed"),
    )


def apply_completions(t: Tables, decisions: DataFrame) -> Change:
    old = t.lesson_progress
    fresh = decisions.filter("outcome = 'inserted'").select(
        hash_id("student_id", "lesson_id").alias("id"),
        "student_id",
        "lesson_id",
        F.lit(True).alias("is_completed"),
        F.lit(None).cast("timestamp").alias("completed_at"),
        t.now.alias("last_viewed_at"),
    )
    done = decisions.filter("outcome = 'completed'").select("student_id", "lesson_id", F.lit(True).alias("_done"))
    updated = old.join(done, ["student_id", "lesson_id"], "left").select(
        "id",
        "student_id",
        "lesson_id",
        (F.col("is_completed") | F.coalesce("_done", F.lit(False))).alias("is_completed"),
        F.when(F.col("_done"), t.now).otherwise(F.col("completed_at")).alias("completed_at"),
        F.when(F.col("_done"), t.now).otherwise(F.col("last_viewed_at")).alias("last_viewed_at"),
    )
    none = decisions.filter("outcome = 'inserted'")
    viewed = rules.log_rows(
        none, t.now, schemas.Action.VIEW_LESSON, "lesson", "student_id", "lesson_id", {"first_view": F.lit(True)},
        [F.col("student_id"), F.col("lesson_id")],
    )
    completed = rules.log_rows(
        done, t.now, schemas.Action.COMPLETE_LESSON, "lesson", "student_id", "lesson_id", {"completed_at": rules.iso(t.now)},
        [F.col("student_id"), F.col("lesson_id"), rules.iso(t.now)],
    )
    finished = decisions.filter("outcome = 'completed'").select(
        F.col("progress_id").alias("id"), "student_id", "lesson_id", F.lit(True).alias("is_completed"),
        t.now.alias("completed_at"), t.now.alias("last_viewed_at"),
    )
    return Change(
        tables={"lesson_progress": append(updated, fresh)},
        appends={"activity_log": viewed.union(completed)},
        upserts={"lesson_progress": fresh.union(finished)},
    )


def decide_submissions(t: Tables, commands: DataFrame) -> DataFrame:
    """Commands: cmd_id, cmd_ts, student_id, homework_id, answer_text, answer_url."""
    outline = t.homework_outline.select("homework_id", "course_id")
    judged = commands.withColumn("answer_text", F.nullif("answer_text", F.lit(""))).withColumn(
        "answer_url", F.nullif("answer_url", F.lit(""))
    )
    judged = _with_enrolment(t, judged.join(t.outline_dim(outline), "homework_id", "left"))
    handed = t.homework_submissions.select("homework_id", "student_id", F.lit(True).alias("handed_in"))
    reason = first_reason(
        homework_not_found=F.col("course_id").isNull(),
        not_enrolled=~F.coalesce("was_active", F.lit(False)),
        no_answer=F.col("answer_text").isNull() & F.col("answer_url").isNull(),
        already_submitted=F.col("handed_in").isNotNull(),
    )
    judged = t.cut("judged", judged.join(handed, ["homework_id", "student_id"], "left").withColumn("reason", reason))
    marked = mark_first(judged, F.col("reason").isNull(), ["homework_id", "student_id"])
    final = F.when(F.col("reason").isNull() & ~F.col("is_first"), "already_submitted").otherwise(F.col("reason"))
    return marked.withColumn("reason", final).withColumn(
        "outcome", F.when(F.col("reason").isNotNull(), REJECTED).otherwise("submitted")
    )


def apply_submissions(t: Tables, decisions: DataFrame) -> Change:
    fresh = decisions.filter("outcome = 'submitted'").select(
        hash_id("homework_id", "student_id").alias("id"),
        "homework_id",
        "student_id",
        "answer_text",
        "answer_url",
        F.lit(None).cast("short").alias("score"),
        F.lit("submitted").alias("status"),
        F.lit(None).cast("string").alias("checked_by"),
        F.lit(None).cast("timestamp").alias("checked_at"),
        t.now.alias("submitted_at"),
    )
    return Change(appends={"homework_submissions": rules.auto_check(t, fresh)})


# -- bulk load ------------------------------------------------------------------


def load_rows(t: Tables, rows: dict[str, DataFrame]) -> tuple[Tables, DataFrame]:
    """Append new rows table by table, each through the rules and constraints of its table.

    ``enrollments`` and ``payments`` rows are commands.  Returns the tables
    after the load, and (table_name, reason, rows) of what was turned away.
    """
    rejects = []

    def turned_away(name: str, judged: DataFrame, reason: str = "reject_reason") -> None:
        rejects.append(
            judged.filter(F.col(reason).isNotNull())
            .groupBy(F.col(reason).alias("reason"))
            .agg(F.count("*").alias("rows"))
            .select(F.lit(name).alias("table_name"), "reason", "rows")
        )

    def admitted(name: str, new: DataFrame, order: list[str], judge=lambda df: df) -> DataFrame:
        """The rows of ``new`` that the table takes.

        Values, the table's own rules and references with small parents are judged once and written with a number per
        row, so that equal rows can be told apart; of a refused row only the reason is written.  Large parents and the
        keys are decided on what was written, which is not written again.
        """
        judged = judge(new)
        refs = constraints.small_references(t, name, new)
        known = constraints.judge_values(t, name, judged, refs).withColumn("_row", F.monotonically_increasing_id())
        kept = [F.when(F.col("reject_reason").isNull(), F.col(c)).alias(c) for c in [*new.columns, "_row"]]
        known = t.cut("incoming", known.select(*kept, "reject_reason"))
        good, unknown = constraints.judge_references(t, name, known.filter("reject_reason is null").drop("reject_reason"), "_row", refs)
        good, taken = constraints.judge_keys(t, name, good, [c for c in order if c in new.columns], "_row")
        refused = known.filter("reject_reason is not null").select("reject_reason")
        turned_away(name, reduce(DataFrame.union, [*unknown, *taken], refused))
        return good.select(*new.columns)

    for name in ("users", "topics", "courses", "modules", "lessons", "homeworks", "activity_log"):
        if name in rows:
            t = Change(appends={name: admitted(name, rows[name], ["created_at", "id"])}).onto(t)
    if "course_teachers" in rows:
        good = admitted("course_teachers", rows["course_teachers"], ["assigned_at"], lambda df: rules.check_teacher_role(t, df))
        t = Change(appends={"course_teachers": good}).onto(t)
    if "enrollments" in rows:
        decided, change = run(t, rows["enrollments"], decide_enrolments, apply_enrolments)
        turned_away("enrollments", decided, "reason")
        t = change.onto(t)
    if "payments" in rows:
        decided, change = run(t, rows["payments"], decide_payments, apply_payments)
        turned_away("payments", decided, "reason")
        t = change.onto(t)
    if "lesson_progress" in rows:
        new = admitted("lesson_progress", rows["lesson_progress"], ["last_viewed_at", "id"])
        log = rules.log_progress(t.lesson_progress, new, t.now)
        t = Change(appends={"lesson_progress": new, "activity_log": log}).onto(t)
    if "homework_submissions" in rows:
        good = admitted("homework_submissions", rows["homework_submissions"], ["submitted_at", "id"], lambda df: rules.judge_scores(t, df))
        t = Change(appends={"homework_submissions": rules.auto_check(t, good)}).onto(t)
    out = rejects[0] if rejects else t.spark.createDataFrame([], "table_name string, reason string, rows bigint")
    for more in rejects[1:]:
        out = out.union(more)
    return t, out
