"""Names of all queries, each a function of the tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from learnmart.functions.exprs import period_end
from learnmart.model import Tables
from learnmart.operators import jobs, lookups, marts, quality, refresh, rules, units
from learnmart.plans import admin, finance, pages, students, teachers
from learnmart.sources import commands, feeds, testdata
from learnmart.sources.store import Layout, Store
from learnmart.sources.workspace import workspace
from learnmart.streaming import jobs as streams

MARTS: dict[str, Callable[[Tables], DataFrame]] = {
    "active_students": marts.active_students,
    "teachers_courses": marts.teachers_courses,
    "upcoming_webinars": marts.upcoming_webinars,
    # the array as text, a NULL element spelled out
    "pending_homeworks": lambda t: marts.pending_homeworks(t).withColumn(
        "teacher_ids", F.array_join("teacher_ids", ",", "NULL")
    ),
    "student_progress": marts.student_progress,
    "course_finance": marts.course_finance,
    "admin_dashboard": marts.admin_dashboard,
    "student_scores": marts.student_scores,
    "course_completion": marts.course_completion,
    "teacher_workload": marts.teacher_workload,
}



def outline_text(t: Tables) -> DataFrame:
    """The nested course outline as text (nested values are not compared directly)."""
    lesson = "concat_ws(':', l.lesson_id, l.lesson_title, l.lesson_type, l.duration_minutes, l.is_completed)"
    text = f"array_join(transform(modules, m -> concat(m.module_title, '[', array_join(transform(m.lessons, l -> {lesson}), ','), ']')), ' ')"
    return pages.course_outline(t).withColumn("modules", F.expr(text))


LOOKUPS = {
    "user_full_names": lookups.user_full_names,
    "course_stats": lookups.course_stats,
    "student_rank": lookups.student_rank,
    "period_end": lambda t: t.payments.select(
        F.col("id").alias("payment_id"),
        "subscription_type",
        "period_start",
        period_end(F.col("period_start"), F.col("subscription_type")).alias("period_end"),
    ),
    "is_enrolled": lambda t: lookups.is_enrolled(
        t, t.payments.select(F.col("id").alias("payment_id"), "student_id", "course_id")
    ),
    "teacher_students": lookups.teacher_students,
    "monthly_revenue": lambda t: lookups.monthly_revenue(t, date(2017, 1, 1), t.as_of.date()),
    "course_progress_report": lookups.course_progress_report,
}

REPORTS = {
    "rpt_dashboard": admin.dashboard,
    "rpt_student_activity": admin.student_activity,
    "rpt_course_summary": admin.course_summary,
    "rpt_progress": admin.progress,
    "rpt_ranking": admin.ranking,
    "rpt_course_finance": admin.finance,
    "rpt_webinars": admin.webinars,
    "rpt_pending": admin.pending,
    "rpt_workload": admin.workload,
    "rpt_monthly_dynamics": finance.monthly_dynamics,
    "rpt_abc": finance.abc,
    "rpt_expiring_subscriptions": finance.expiring_subscriptions,
    "rpt_finance_totals": finance.totals,
    "rpt_progress_status": students.progress_status,
    "rpt_ranking_topic": students.ranking_topic,
    "rpt_unsubmitted": students.unsubmitted,
    "rpt_submission_status": students.submission_status,
    "rpt_activity": students.activity,
    "rpt_course_detail": students.course_detail,
    "rpt_teacher_students": teachers.students,
    "rpt_check_queue": teachers.check_queue,
    "rpt_workload_rank": teachers.workload_rank,
    "rpt_teacher_webinars": lambda t: teachers.webinars(t, "supp3"),
    "rpt_student_grades": teachers.student_grades,
}

PAGES = {
    "platform_counts": pages.platform_counts,
    "users_by_role": pages.users_by_role,
    "revenue_last6": pages.revenue_last_months,
    "monthly_finance": pages.monthly_finance,
    "user_directory": pages.user_directory,
    "enroll_choices": pages.enroll_choices,
    "teacher_student_count": pages.teacher_student_count,
    "teacher_pending_count": pages.teacher_pending_count,
    "teacher_student_list": teachers.students,
    "teacher_pending_list": pages.teacher_pending_list,
    "student_courses": pages.student_courses,
    "course_outline": outline_text,
    "lesson_detail": pages.lesson_detail,
    "lesson_homeworks": pages.lesson_homeworks,
}

RULES = {
    "validate_scores": lambda t: rules.judge_scores(t, commands.raw_submissions(t))
    .filter("reject_reason is not null")
    .select("id", "homework_id", "score", "status", "reject_reason"),
    "auto_check": lambda t: rules.auto_check(t, commands.raw_submissions(t)).select(
        "id", "homework_id", "score", "status", "checked_at"
    ),
    "touch_updated_at": lambda t: rules.touch_updated_at(
        t.users, commands.progress_before(t).select(F.col("student_id").alias("id")).distinct(), "id", t.now
    ).select("id", "updated_at"),
    "log_enrollment": lambda t: rules.log_enrolments(commands.enrolments_before(t), commands.enrolments_after(t), t.now),
    "log_progress": lambda t: rules.log_progress(commands.progress_before(t), t.lesson_progress, t.now),
    "check_teacher_role": lambda t: rules.check_teacher_role(t, commands.raw_assignments(t)).filter(
        "reject_reason is not null"
    ),
    "check_student_role": lambda t: rules.check_student_role(t, commands.raw_enrolments(t))
    .filter("reject_reason is not null")
    .select("id", "student_id", "reject_reason"),
    "set_completed_at": lambda t: rules.set_completed_at(commands.progress_before(t), t.lesson_progress, t.now),
    "queue_refresh": lambda t: _change("enrollments", t).appends["mv_refresh_queue"],
}

# job name -> (starting state, command feed, decide, apply)
JOB_STEPS = {
    "enrollments": (commands.before, commands.enrol_commands, jobs.decide_enrolments, jobs.apply_enrolments),
    "payments": (commands.before, commands.payment_commands, jobs.decide_payments, jobs.apply_payments),
    "units": (commands.before, commands.unit_commands, jobs.decide_enrol_and_pay, jobs.apply_enrol_and_pay),
    "groups": (commands.before, commands.group_commands, units.decide_units, units.apply_units),
    "grades": (lambda t: t, commands.grade_commands, jobs.decide_grades, jobs.apply_grades),
    "deactivations": (lambda t: t, commands.deactivation_commands, jobs.decide_deactivations, jobs.apply_deactivations),
    "completions": (commands.before, commands.completion_commands, jobs.decide_completions, jobs.apply_completions),
    "submissions": (commands.before, commands.submission_commands, jobs.decide_submissions, jobs.apply_submissions),
}


def _ran(job: str, t: Tables) -> tuple[Tables, DataFrame, jobs.Change]:
    """A job's start, written decisions and change; a batch is decided once, however many of its outputs are asked for."""
    done = t.__dict__.setdefault("_ran", {})
    if job not in done:
        state, feed, decide, apply = JOB_STEPS[job]
        start = state(t)
        done[job] = (start, *jobs.run(start, feed(start), decide, apply))
    return done[job]


def _decided(job: str, t: Tables) -> tuple[Tables, DataFrame]:
    return _ran(job, t)[:2]


def _change(job: str, t: Tables) -> jobs.Change:
    return _ran(job, t)[2]


def _outcomes(job: str):
    return lambda t: jobs.decisions_of(_decided(job, t)[1])


def _log(job: str):
    return lambda t: _change(job, t).appends["activity_log"]


def _first_pending(t: Tables) -> DataFrame:
    decided = jobs.decide_grades(t, jobs.first_pending_grades(t, score=17))
    return decided.select("cmd_id", "submission_id", "teacher_id", "score", "outcome", "reason")


JOBS = {
    "apply_enrollments": _outcomes("enrollments"),
    "apply_enrollments_state": lambda t: _change("enrollments", t).tables["enrollments"],
    "apply_enrollments_log": _log("enrollments"),
    "apply_payments": _outcomes("payments"),
    "apply_payments_rows": lambda t: _change("payments", t).appends["payments"],
    "apply_payments_log": _log("payments"),
    "payment_warnings": lambda t: jobs.payment_warnings(_decided("payments", t)[1]),
    "apply_grades": _outcomes("grades"),
    "apply_grades_state": lambda t: _change("grades", t)
    .tables["homework_submissions"]
    .select("id", "homework_id", "student_id", "score", "status", "checked_by", "checked_at"),
    "apply_grades_log": _log("grades"),
    "grade_first_pending": _first_pending,
    "apply_deactivations": lambda t: _decided("deactivations", t)[1].select(
        "cmd_id", "outcome", "reason", "courses_affected"
    ),
    "apply_deactivations_users": lambda t: _change("deactivations", t).tables["users"].select("id", "is_active", "updated_at"),
    "apply_deactivations_enrollments": lambda t: _change("deactivations", t)
    .tables["enrollments"]
    .select("id", "student_id", "course_id", "is_active"),
    "apply_deactivations_log": _log("deactivations"),
    "complete_lessons": _outcomes("completions"),
    "complete_lessons_state": lambda t: _change("completions", t).tables["lesson_progress"],
    "complete_lessons_log": _log("completions"),
    "submit_homeworks": _outcomes("submissions"),
    "submit_homeworks_rows": lambda t: _change("submissions", t).appends["homework_submissions"],
    "enroll_and_pay": _outcomes("units"),
    "enroll_and_pay_log": _log("units"),
    "apply_units": _outcomes("groups"),
    "apply_units_state": lambda t: _change("groups", t).tables["enrollments"],
    "apply_units_payments": lambda t: _change("groups", t).appends["payments"],
    "apply_units_log": _log("groups"),
}


def _purged(t: Tables) -> tuple[jobs.Change, DataFrame]:
    """Deletes of inactive users and courses, and of some topics, lessons and homework; worked out once."""
    done = t.__dict__.setdefault("_purged", [])
    if not done:
        done.append(quality.cascade_purge(t, {
            "users": t.users.filter("not is_active"), "topics": t.topics.filter("id = 1"), "courses": t.courses.filter("not is_active"),
            "modules": t.modules.filter("id % 7 = 0"), "lessons": t.lessons.filter("id % 11 = 0"), "homeworks": t.homeworks.filter("id % 13 = 0")}))
    return done[0]


def purge_counts(t: Tables) -> DataFrame:
    """Rows kept per table after deleting inactive users and courses, and the refused deletes."""
    change, rejects = quality.cascade_purge(t, {"users": t.users.filter("not is_active"), "courses": t.courses.filter("not is_active")})
    out = rejects.groupBy(F.concat(F.lit("rejected "), "kind").alias("kind"), F.col("reason").alias("name")).agg(
        F.count("*").alias("rows")
    )
    for name, df in change.tables.items():
        out = out.union(df.agg(F.count("*").alias("rows")).select(F.lit("kept"), F.lit(name), "rows"))
    return out


def purge_rows(t: Tables) -> DataFrame:
    """The ids that stay in every table that a purge of six tables changes."""
    change = _purged(t)[0]
    parts = [df.select(F.lit(name).alias("table_name"), F.col("id").cast("string").alias("id")) for name, df in change.tables.items() if "id" in df.columns]
    return reduce(DataFrame.union, parts)


QUALITY = {
    "unique_violations": lambda t: quality.unique_violations(commands.arriving(t)),
    "orphan_rows": lambda t: quality.orphan_rows(commands.arriving(t)),
    "check_violations": lambda t: quality.check_violations(commands.arriving(t)),
    "domain_violations": lambda t: quality.domain_violations(commands.arriving(t)),
    "cascade_purge": purge_counts,
    "cascade_purge_refused": lambda t: _purged(t)[1],
    "cascade_purge_rows": purge_rows,
}



def refreshed(t: Tables) -> DataFrame:
    store = Store(t.spark, workspace(t.spark, "marts"))
    refresh.refresh_marts(t, store)
    return refresh.stored_summary(store)


def _on_snapshot(report):
    """A report over marts that were refreshed before the latest changes."""

    def query(t: Tables) -> DataFrame:
        store = Store(t.spark, workspace(t.spark, "marts"))
        refresh.refresh_marts(commands.before(t), store)
        return report(refresh.with_marts(t, store))

    return query


STORED = {
    "rpt_dashboard_stored": _on_snapshot(admin.dashboard),
    "rpt_ranking_stored": _on_snapshot(admin.ranking),
    "rpt_workload_stored": _on_snapshot(admin.workload),
    "rpt_ranking_topic_stored": _on_snapshot(students.ranking_topic),
}


def _loaded(t: Tables) -> tuple[Tables, DataFrame]:
    """A bulk load of unchecked rows into empty course_teachers, homework_submissions and lesson_progress."""
    empty = {name: t.empty(name) for name in ("course_teachers", "homework_submissions", "lesson_progress")}
    queue = rules.queue_refresh(empty["course_teachers"], ["course_id"], t.now)
    start = commands.before(t).replace(**empty, mv_refresh_queue=queue)
    feed = t.replace()
    feed.raw = t.raw
    return jobs.load_rows(
        start,
        {
            "course_teachers": commands.raw_assignments(feed).withColumn("assigned_at", t.now),
            "enrollments": commands.enrol_commands(feed),
            "payments": commands.payment_commands(feed),
            "lesson_progress": t.lesson_progress,
            "homework_submissions": commands.raw_submissions(feed),
        },
    )


def loaded_counts(t: Tables) -> DataFrame:
    """Rows stored and rows turned away, by table and reason."""
    after, out = _loaded(t)
    for name in ("course_teachers", "enrollments", "payments", "lesson_progress", "homework_submissions", "activity_log",
                 "mv_refresh_queue"):
        out = out.union(after.frames[name].agg(F.count("*").alias("rows")).select(F.lit(name), F.lit("stored"), "rows"))
    return out


def loaded_submissions(t: Tables) -> DataFrame:
    return _loaded(t)[0].homework_submissions.select("id", "homework_id", "student_id", "score", "status", "checked_by", "submitted_at")


def followed(t: Tables) -> Store:
    """Marts of the earlier state, brought up to date with three batches of changes."""
    done = t.__dict__.setdefault("_followed", [])
    if not done:
        start, store = commands.before(t), Store(t.spark, workspace(t.spark, "followed"))
        changes = [_change(job, t) for job in ("enrollments", "completions", "submissions")]
        after = reduce(lambda state, change: change.onto(state), changes, start)
        refresh.start_following(start, store, parts=8)
        refresh.follow(start, changes, store, after)
        done.append(store)
    return done[0]


def _stored_job(job: str, table: str, layout: Layout, near: dict[str, str]):
    """A batch of commands against a keyed table, which is then read back."""

    def query(t: Tables) -> DataFrame:
        state, feed, decide, apply = JOB_STEPS[job]
        start, store = state(t), Store(t.spark, workspace(t.spark, "stored"))
        rows = start.frames[table]
        store.commit({table: rows.withColumn("id", F.col("id").cast("string")) if "id" not in layout.by else rows}, t.as_of, layouts={table: layout})
        jobs.run_stored(start, store, feed(start), decide, apply, {table: near})
        return store.read(table)

    return query


FOLLOWED = {
    "follow_student_scores": lambda t: followed(t).read("mv_student_scores"),
    "follow_course_completion": lambda t: followed(t).read("mv_course_completion"),
    "follow_teacher_workload": lambda t: followed(t).read("mv_teacher_workload"),
    "follow_admin_dashboard": lambda t: followed(t).read("mv_admin_dashboard"),
    "apply_enrollments_stored": _stored_job(
        "enrollments", "enrollments", Layout(("student_id",), ("student_id", "course_id"), 8), {"student_id": "student_id"}),
    "complete_lessons_stored": _stored_job(
        "completions", "lesson_progress", Layout(("student_id",), ("student_id", "lesson_id"), 8), {"student_id": "student_id"}),
    "apply_grades_stored": lambda t: _stored_job("grades", "homework_submissions", Layout(("id",), parts=8), {"id": "submission_id"})(t)
    .select("id", "homework_id", "student_id", "score", "status", "checked_by", "checked_at"),
}


def _streamed(name: str, table: str, order: str, feed, run, result, state=commands.before):
    def query(t: Tables) -> DataFrame:
        start = state(t)
        sink = streams.Sink(workspace(t.spark, name))
        raw = feeds.StreamingRaw(t.spark, t.raw.sf_dir, table, order, workspace(t.spark, f"{name}_feed"))
        run(start, feed(start, raw), sink).awaitTermination()
        return result(start, sink)

    return query


STREAMS = {
    "stream_submissions": _streamed(
        "submissions", "lineitem", "l_shipdate", feeds.submissions, streams.stream_submissions,
        lambda t, sink: sink.read(t, "judged").select("id", "homework_id", "student_id", "outcome"),
    ),
    "stream_submissions_accepted": _streamed(
        "submissions", "lineitem", "l_shipdate", feeds.submissions, streams.stream_submissions,
        lambda t, sink: sink.read(t, "accepted").select("id", "homework_id", "student_id", "score", "status", "checked_at"),
    ),
    "stream_progress": _streamed(
        "progress", "events", "ts", feeds.lesson_events, streams.stream_progress,
        lambda t, sink: sink.deltas(t, "progress", ["student_id", "lesson_id"]).newest().select(
            "student_id", "lesson_id", "is_completed", "completed_at", "last_viewed_at"),
    ),
    "stream_progress_log": _streamed(
        "progress", "events", "ts", feeds.lesson_events, streams.stream_progress,
        lambda t, sink: sink.read(t, "log").select("user_id", "action", "entity_id", "metadata"),
    ),
    "stream_enrollments": _streamed(
        "enrollments", "orders", "o_orderdate", feeds.enrol_commands, streams.stream_enrolments,
        lambda t, sink: sink.read(t, "decisions").select("cmd_id", "outcome", "reason"),
    ),
    "stream_last_activity": _streamed(
        "activity", "events", "ts", feeds.activity, streams.stream_last_activity, streams.latest_activity, state=lambda t: t
    ),
    "stream_active_days": _streamed(
        "active_days", "events", "ts", feeds.activity, streams.stream_active_days, streams.active_days, state=lambda t: t
    ),
}

REFRESH = {"refresh_marts": refreshed, "load_seed": loaded_counts, "load_seed_submissions": loaded_submissions}

GROUPS = [MARTS, LOOKUPS, REPORTS, PAGES, RULES, JOBS, QUALITY, REFRESH, STORED, FOLLOWED, STREAMS]


def comparable(df: DataFrame) -> DataFrame:
    """Plain result types: integers as bigint, decimals as double."""
    cols = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            col = col.cast("bigint")
        elif isinstance(f.dataType, T.DecimalType):
            col = col.cast("double")
        cols.append(col.alias(f.name))
    return df.select(*cols)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: comparable(fn(testdata.load(spark, sf_dir)))

    return {name: bind(fn) for group in GROUPS for name, fn in group.items()}


def all_statements() -> dict[str, str]:
    from learnmart.oracle import changes as changes_sql
    from learnmart.oracle import marts as marts_sql
    from learnmart.oracle import reports as reports_sql

    out: dict[str, str] = {}
    for module in (marts_sql, reports_sql, changes_sql):
        out.update(module.STATEMENTS)
    return out
