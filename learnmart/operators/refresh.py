"""Stored marts: recomputed as one published snapshot, or kept up with the changes of batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learnmart.model import Tables
from learnmart.operators import facts, marts
from learnmart.operators.jobs import Change
from learnmart.schemas import MARTS
from learnmart.sources.store import Layout, Replacement, Store

# mart name -> operator
BUILDERS = dict(
    zip(MARTS, (marts.admin_dashboard, marts.student_scores, marts.course_completion, marts.teacher_workload), strict=True)
)

# what a followed store keeps beside the marts, and how tables are dealt: marts are replaced course by course or teacher by teacher
FACTS, WORK, PLACES = "enrolment_facts", "course_work", "student_places"
BY_COURSE = {"mv_student_scores": marts.student_scores, "mv_course_completion": marts.course_completion}
FOLLOWED = ("enrollments", "lesson_progress", "homework_submissions", "users", "activity_log", "mv_refresh_queue", "payments")


def refresh_marts(t: Tables, store: Store) -> int:
    """Write all marts and publish them together; stale-mart requests seen so far become processed."""
    frames = {name: build(t) for name, build in BUILDERS.items()}
    if "mv_refresh_queue" in t.frames:
        frames["mv_refresh_queue"] = t.mv_refresh_queue.withColumn("processed", F.lit(True))
    return store.commit(frames, t.as_of)


def start_following(t: Tables, store: Store, parts: int | None = None) -> int:
    """``refresh_marts`` into keyed tables, with the facts that later changes are added to."""
    course = lambda *keys: Layout(("course_id",), keys or ("course_id",), parts)
    layouts = {name: course() for name in BY_COURSE} | {
        "mv_teacher_workload": Layout(("teacher_id",), parts=parts),
        FACTS: course("course_id", "student_id"),
        WORK: course("course_id", "teacher_id"),
        PLACES: Layout(("student_id",), ("student_id", "course_id"), parts),
    }
    frames = {name: build(t) for name, build in BUILDERS.items()}
    frames[FACTS] = t.cut("facts", facts.everyone(t))
    frames[PLACES] = frames[FACTS].select("student_id", "course_id")
    frames[WORK] = marts.work_counts(t, t.homework_submissions)
    if "mv_refresh_queue" in t.frames:
        frames["mv_refresh_queue"] = t.mv_refresh_queue.withColumn("processed", F.lit(True))
    return store.commit(frames, t.as_of, layouts=layouts)


def _old_rows(t: Tables, name: str, rows: DataFrame) -> DataFrame:
    """The rows of a table that ``rows`` replace, by id; ids may be numbers or text."""
    ids = rows.select(F.col("id").cast("string").alias("_id")).distinct()
    old = t.frames[name]
    return old.join(ids, old["id"].cast("string") == F.col("_id"), "left_semi")


def _changed(t: Tables, changes: list[Change], name: str) -> tuple[DataFrame | None, DataFrame | None]:
    """Rows of a table that are new or newer after ``changes``, and those they replace."""
    upserts = [c.upserts[name] for c in changes if name in c.upserts]
    new = upserts + [c.appends[name] for c in changes if name in c.appends]
    if not new:
        return None, None
    columns = [c for c in t.frames[name].columns if all(c in df.columns for df in new)]
    stack = lambda parts: reduce(DataFrame.union, [df.select(*[F.col(c).cast("string") if c == "id" else F.col(c) for c in columns]) for df in parts])
    return stack(new), _old_rows(t, name, stack(upserts)) if upserts else None


def follow(t: Tables, changes: list[Change], store: Store, after: Tables) -> int:
    """Bring the marts of ``start_following`` up to date with ``changes``.

    ``t`` are the tables before (enrolments, progress, hand-ins: at least the
    rows that change, as ``Store.near`` gives them), ``after`` those after the
    changes.  Each changed row takes its old share from the facts of its
    (student, course) and adds its new one.  Only courses with such rows, and
    teachers of these courses, are computed again, from the facts of their
    parts, and only their parts of the marts are written.  The dashboard, one row
    over all tables and the clock, is computed anew.  Tables that no course
    follows from (the catalogue, assignments) may not be among the changes: they
    take a new start.
    """
    unknown = {name for c in changes for name in [*c.upserts, *c.appends]} - set(FOLLOWED)
    if unknown:
        raise ValueError(f"marts do not follow changes of {sorted(unknown)}")
    moved = {name: _changed(t, changes, name) for name in FOLLOWED[:3]}
    shares = {"enrollments": "enrollments", "lesson_progress": "progress", "homework_submissions": "submissions"}
    added = {shares[name]: new for name, (new, _) in moved.items() if new is not None}
    removed = {shares[name]: old for name, (_, old) in moved.items() if old is not None and name != "enrollments"}
    if not added:
        return store.commit({"mv_admin_dashboard": marts.admin_dashboard(after)}, t.as_of)
    plus = t.cut("shares", facts.contributions(t, **added))
    minus = t.cut("shares", facts.contributions(t, **removed)) if removed else plus.limit(0)
    touched = t.cut("touched", plus.unionByName(minus).select("student_id", "course_id").distinct())
    work = _moved_work(t, moved["homework_submissions"], store)
    courses = touched.select("course_id")
    if work is not None:
        courses = courses.union(work.select("course_id"))
    courses = t.cut("courses", courses.distinct())

    old = store.near(FACTS, courses).join(touched, ["student_id", "course_id"], "left_semi")
    replace = {FACTS: Replacement(facts.moved(old, plus, minus)), PLACES: Replacement(touched)}
    if work is not None:
        replace[WORK] = Replacement(work)
    store.commit(at=t.as_of, replace=replace)

    # the marts of these courses from their facts alone
    own = store.near(FACTS, courses).join(courses, "course_id", "left_semi").filter("enrolled_at is not null")
    near = after.replace()
    near.__dict__["enrolment_facts"] = t.cut("facts", own)
    replace = {name: Replacement(build(near), courses) for name, build in BY_COURSE.items()}
    replace["mv_teacher_workload"] = _workload(after, changes, courses, store)
    queue = [c.appends["mv_refresh_queue"].withColumn("processed", F.lit(True)) for c in changes if "mv_refresh_queue" in c.appends]
    appends = {"mv_refresh_queue": reduce(DataFrame.union, queue)} if queue else {}
    return store.commit({"mv_admin_dashboard": marts.admin_dashboard(after)}, t.as_of, replace=replace, appends=appends)


def _moved_work(t: Tables, changed: tuple[DataFrame | None, DataFrame | None], store: Store) -> DataFrame | None:
    """The work counts of courses with changed hand-ins, after the change; counts that fall to none stay as zero."""
    new, old = changed
    if new is None:
        return None
    rows = marts.work_counts(t, new)
    if old is not None:
        rows = rows.union(marts.work_counts(t, old).select("course_id", "teacher_id", (-F.col("pending")).alias("pending"), (-F.col("checked")).alias("checked")))
    rows = t.cut("work", rows)
    keys = rows.select("course_id", "teacher_id").distinct()
    known = store.near(WORK, rows).alias("k")
    same = (F.col("k.course_id") == F.col("r.course_id")) & F.col("k.teacher_id").eqNullSafe(F.col("r.teacher_id"))
    known = known.join(keys.alias("r"), same, "left_semi")
    sums = known.unionByName(rows).groupBy("course_id", "teacher_id").agg(F.sum("pending").alias("pending"), F.sum("checked").alias("checked"))
    return t.cut("work", sums)


def _workload(after: Tables, changes: list[Change], courses: DataFrame, store: Store) -> Replacement:
    """Workload of the teachers of ``courses`` and of changed users, from the facts and counts of all their courses."""
    assigned = after.course_teachers
    teachers = assigned.join(courses, "course_id", "left_semi").select("teacher_id")
    for change in changes:
        if "users" in change.upserts:
            teachers = teachers.union(change.upserts["users"].select(F.col("id").alias("teacher_id")))
    teachers = after.cut("teachers", teachers.distinct())
    theirs = after.cut("assigned", assigned.join(teachers, "teacher_id", "left_semi"))
    wanted = theirs.select("course_id").distinct()
    enrolled = store.near(FACTS, wanted).join(wanted, "course_id", "left_semi").filter("enrolled_at is not null")
    near = after.replace(course_teachers=theirs, enrollments=enrolled)
    return Replacement(marts.teacher_workload(near, store.near(WORK, wanted)), teachers)


def near_student(t: Tables, store: Store, student_id: str) -> Tables:
    """``t`` with the facts and enrolments of one student's courses only, read from their parts of a followed store."""
    who = t.spark.createDataFrame([(student_id,)], "student_id string")
    places = store.near(PLACES, who).filter(F.col("student_id") == student_id)
    courses = t.cut("courses", places.select("course_id").distinct())
    own = store.near(FACTS, courses).join(t.catalogue_dim(courses), "course_id", "left_semi").filter("enrolled_at is not null")
    out = t.replace(enrollments=own.select("student_id", "course_id", "enrolled_at", "is_active"))
    out.__dict__["enrolment_facts"] = own
    return out


def with_marts(t: Tables, store: Store) -> Tables:
    """``t`` with the stored marts beside it: reports then read the snapshot, as of its last refresh."""
    out = t.replace(**{name: store.read(name) for name in MARTS})
    out.__dict__.update({k: v for k, v in t.__dict__.items() if k == "raw"})
    return out


def refresh_needed(t: Tables) -> bool:
    """Is any stale-mart request waiting?"""
    return not t.mv_refresh_queue.filter("not processed").isEmpty()


def stored_summary(store: Store) -> DataFrame:
    """Rows and a total of each stored mart."""
    totals = {
        "mv_admin_dashboard": F.sum("total_submissions"),
        "mv_student_scores": F.sum("rank_in_course"),
        "mv_course_completion": F.sum("completed_lessons"),
        "mv_teacher_workload": F.sum("total_students"),
    }
    out = None
    for name, total in totals.items():
        row = store.read(name).agg(F.count("*").alias("rows"), total.cast("bigint").alias("total"))
        row = row.select(F.lit(name).alias("mart"), "rows", "total")
        out = row if out is None else out.union(row)
    return out
