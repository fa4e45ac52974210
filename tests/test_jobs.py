"""Change jobs: reasons, order inside a batch, repeatability."""

import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
import seed
from pyspark.sql import functions as F

from learnmart.model import Tables
from learnmart.operators import jobs, lookups, marts, refresh, rules, units
from learnmart.plans import admin, students
from learnmart.session import shuffle_partitions
from learnmart.sources import commands, testdata
from learnmart.sources.store import Deltas, Layout, Replacement, Store, key_hash
from learnmart.sources.tables import read_tables, write_tables
from learnmart.sources.workspace import workspace

AS_OF = seed.AS_OF
LATER = AS_OF + timedelta(days=1)
ENROL = "cmd_id string, cmd_ts timestamp, student_id string, course_id string, admin_id string"
PAY = ENROL + ", amount decimal(10,2), subscription_type string, period_start date, notes string"
GRADE = "cmd_id string, cmd_ts timestamp, submission_id string, teacher_id string, score short, comment string"


def outcomes(decided):
    return {r.cmd_id: r.reason or r.outcome for r in decided.collect()}


@pytest.fixture(scope="module")
def later(school):
    """The school a day later, with an inactive course, student and place."""
    t = Tables(school.spark, dict.copy(school.frames), LATER)
    off = lambda df, key: df.withColumn("is_active", F.col("is_active") & (F.col("id") != key))
    place = school.enrollments.filter("student_id = 'U31'").first().id
    return t.replace(courses=off(t.courses, "C5"), users=off(t.users, "U27"), enrollments=off(t.enrollments, place))


def enrol(spark, *rows):
    return spark.createDataFrame([(c, LATER + timedelta(minutes=m), *r) for c, m, *r in rows], ENROL)


def test_enrolment_reasons_in_order(spark, later):
    feed = enrol(
        spark, ("a", 0, "U20", "C2", "U10"), ("b", 0, "U99", "C2", "U01"), ("c", 0, "U27", "C2", "U01"), ("d", 0, "U10", "C2", "U01"),
        ("e", 0, "U20", "C77", "U01"), ("f", 0, "U20", "C5", "U01"), ("g", 0, "U20", "C1", "U01"), ("h", 0, "U31", "C4", "U01"),
        ("i", 5, "U20", "C2", "U01"), ("j", 3, "U20", "C2", "U02"), ("k", 0, "U99", "C77", "nobody"))
    decided = jobs.decide_enrolments(later, feed)
    assert outcomes(decided) == {
        "a": "admin_not_active", "b": "student_not_found_or_inactive", "c": "student_not_found_or_inactive", "d": "not_a_student",
        "e": "course_not_found", "f": "course_not_active", "g": "already_enrolled", "h": "reactivated", "i": "already_enrolled",
        "j": "enrolled", "k": "admin_not_active"}
    change = jobs.apply_enrolments(later, decided)
    after = change.onto(later)
    assert after.enrollments.count() == 17
    row = after.enrollments.filter("student_id = 'U31' and course_id = 'C4'").first()
    assert row.is_active and row.enrolled_at == LATER
    log = sorted((r.action, r.user_id) for r in change.appends["activity_log"].collect())
    assert log == [("admin_enroll", "U01"), ("admin_enroll", "U02"), ("enroll", "U20")]  # reactivation logs no 'enroll'
    assert change.appends["mv_refresh_queue"].count() == 8
    # the same batch again changes nothing and makes no new rows
    again = jobs.decide_enrolments(after, feed)
    assert set(outcomes(again).values()) & {"enrolled", "reactivated"} == set()
    assert sorted(jobs.apply_enrolments(after, again).onto(after).enrollments.collect()) == sorted(after.enrollments.collect())


def test_payment_reasons_and_warning(spark, later):
    d = date(2024, 1, 31)
    rows = [("a", "U20", "C1", "U01", 2900, "weekly", d), ("b", "U20", "C1", "U10", 2900, "monthly", d), ("c", "U20", "C2", "U01", 2500, "monthly", d),
            ("d", "U31", "C4", "U01", 2800, "monthly", d), ("e", "U20", "C1", "U01", 2900, "monthly", None), ("f", "U20", "C1", "U01", 0, "monthly", d),
            ("g", "U20", "C1", "U01", 2900, "monthly", d), ("h", "U20", "C1", "U01", 20000, "yearly", d)]
    feed = spark.createDataFrame([(c, LATER, u, k, a, Decimal(m), s, p, None) for c, u, k, a, m, s, p in rows], PAY)
    decided = jobs.decide_payments(later, feed)
    assert outcomes(decided) == {"a": "bad_subscription_type", "b": "admin_not_active", "c": "not_enrolled", "d": "not_enrolled",
                                 "e": "missing_period_start", "f": "amount_not_positive", "g": "recorded", "h": "recorded"}
    assert [(r.cmd_id, r.expected_price) for r in jobs.payment_warnings(decided).collect()] == [("h", Decimal(24900))]
    new = jobs.apply_payments(later, decided).appends["payments"].orderBy("period_end").collect()
    assert [(r.payment_date, r.period_end) for r in new] == [(LATER.date(), date(2024, 2, 28)), (LATER.date(), date(2025, 1, 30))]


def test_enrol_and_pay_is_one_unit(spark, later):
    d = date(2024, 5, 1)
    rows = [("a", 0, "U20", "C2", "U01", -5, "monthly"), ("b", 1, "U20", "C2", "U01", 2500, "monthly"), ("c", 2, "U20", "C2", "U01", 2500, "yearly"),
            ("d", 0, "U21", "C5", "U01", 2000, "monthly"), ("e", 0, "U21", "C2", "U01", 2000, "daily"), ("f", 0, "U21", "C1", "U01", 2900, "monthly")]
    feed = spark.createDataFrame([(c, LATER + timedelta(minutes=m), u, k, a, Decimal(x), s, d, None) for c, m, u, k, a, x, s in rows], PAY)
    decided = jobs.decide_enrol_and_pay(later, feed)
    assert outcomes(decided) == {"a": "amount_not_positive", "b": "enrolled", "c": "already_enrolled", "d": "course_not_active",
                                 "e": "bad_subscription_type", "f": "already_enrolled"}
    after = jobs.apply_enrol_and_pay(later, decided).onto(later)
    assert after.payments.count() == 14 + 3 and after.enrollments.count() == 17


GROUP = "cmd_id string, cmd_ts timestamp, unit_id string, kind string, student_id string, course_id string, admin_id string, amount decimal(10,2), subscription_type string, period_start date, notes string"


def unit_feed(spark, rows):
    """Rows (cmd_id, minute, unit_id, kind, student, course[, admin])."""
    d = date(2024, 5, 1)
    return spark.createDataFrame([(c, LATER + timedelta(minutes=m), u, k, s, p, (a or ["U01"])[0], Decimal(2500), "monthly", d, None)
                                  for c, m, u, k, s, p, *a in rows], GROUP)


def test_refused_units_free_their_places(spark, later):
    rows = [
        ("a1", 0, "a", "enroll", "U20", "C2"), ("a2", 1, "a", "pay", "U20", "C2"), ("a3", 2, "a", "pay", "U21", "C4"),  # no place in C4
        ("b1", 3, "b", "enroll", "U20", "C2"), ("b2", 3, "b", "pay", "U20", "C2"),  # takes the place of a
        ("c1", 4, "c", "pay", "U20", "C2"), ("c2", 4, "c", "enroll", "U22", "C3"),  # leans on b
        ("d1", 5, "d", "enroll", "U23", "C4"), ("d2", 5, "d", "enroll", "U23", "C1", "nobody"),
        ("e1", 6, "e", "pay", "U23", "C4"), ("e2", 6, "e", "enroll", "U24", "C4"),  # leaned on d
        ("f1", 7, "f", "pay", "U24", "C4"),  # leaned on e
        ("g1", 8, "g", "pay", "U25", "C4"), ("g2", 9, "g", "enroll", "U25", "C4"),  # pays too early
        ("h1", 10, None, "enroll", "U25", "C4"), ("h2", 11, None, "pay", "U25", "C4"), ("h3", 12, None, "gift", "U25", "C4"),
        ("i1", 13, "i", "enroll", "U25", "C4"), ("i2", 14, "i", "enroll", "U29", "C4"), ("i3", 15, "i", "enroll", "U29", "C4"),
    ]
    decided, change = jobs.run(later, unit_feed(spark, rows), units.decide_units, units.apply_units)
    assert outcomes(decided) == {
        "a1": "unit_refused", "a2": "unit_refused", "a3": "not_enrolled", "b1": "enrolled", "b2": "recorded", "c1": "recorded", "c2": "enrolled",
        "d1": "unit_refused", "d2": "admin_not_active", "e1": "not_enrolled", "e2": "unit_refused", "f1": "not_enrolled",
        "g1": "not_enrolled", "g2": "unit_refused", "h1": "enrolled", "h2": "recorded", "h3": "unknown_kind",
        "i1": "already_enrolled", "i2": "enrolled", "i3": "already_enrolled"}
    after = change.onto(later)
    assert after.enrollments.count() == later.enrollments.count() + 4 and after.payments.count() == later.payments.count() + 3


def test_units_of_an_empty_batch(spark, later):
    decided, change = jobs.run(later, unit_feed(spark, []), units.decide_units, units.apply_units)
    assert decided.isEmpty() and change.appends["payments"].isEmpty()


def test_units_like_one_after_the_other(spark, later):
    """Random units, a long chain of refusals among them, against handling unit after unit."""
    rng = random.Random(5)
    people, courses = [f"U{n}" for n in range(20, 32) if n != 27], ["C1", "C2", "C3", "C4"]
    rows = [(f"r{n:03d}", rng.randrange(400), f"u{rng.randrange(70):02d}", rng.choice(["enroll", "pay"]), rng.choice(people), rng.choice(courses),
             "nobody" if rng.random() < 0.03 else "U01") for n in range(160)]
    held = {(r.student_id, r.course_id) for r in later.enrollments.filter("is_active").collect()}
    stored = {(r.student_id, r.course_id) for r in later.enrollments.collect()}
    free = [(p, c) for p in people for c in courses if (p, c) not in held][:8]
    for n, ((a, b), (c, d)) in enumerate(zip(free, free[1:])):  # each unit pays for the place that the unit before would have opened
        rows += [(f"z{n}p", 900 + n, f"z{n}", "pay", a, b, "nobody" if n == 0 else "U01"), (f"z{n}q", 900 + n, f"z{n}", "enroll", c, d, "U01")]
    want, units_of = {}, {}
    for row in sorted(rows, key=lambda r: (r[1], r[0])):
        units_of.setdefault(row[2], []).append(row)
    for unit, cmds in sorted(units_of.items(), key=lambda u: (u[1][0][1], u[0])):
        mine, stands, said = set(held), True, {}
        for cmd, _, _, kind, who, where, admin in cmds:
            if admin == "nobody":
                said[cmd], stands = "admin_not_active", False
            elif kind == "pay":
                said[cmd] = "recorded" if (who, where) in mine else "not_enrolled"
                stands &= (who, where) in mine
            else:
                said[cmd] = "already_enrolled" if (who, where) in mine else "reactivated" if (who, where) in stored else "enrolled"
                mine.add((who, where))
        done = ("recorded", "enrolled", "reactivated", "already_enrolled")
        want |= said if stands else {c: "unit_refused" if s in done else s for c, s in said.items()}
        held = mine if stands else held
    decided = units.decide_units(later, unit_feed(spark, rows))
    assert outcomes(decided) == want
    assert {"enrolled", "recorded", "unit_refused", "not_enrolled"} <= set(want.values())


def test_grades(spark, later):
    at = lambda m: LATER + timedelta(minutes=m)
    rows = [("a", at(0), "nope", "U10", 5, None), ("b", at(0), "H01-U20", "U10", 5, None), ("c", at(0), "H02-U23", "U10", 5, None),
            ("d", at(0), "H02-U21", "U12", 5, None), ("e", at(1), "H02-U21", "U10", 21, None), ("f", at(2), "H02-U21", "U11", 17, "ok"),
            ("g", at(3), "H02-U21", "U10", 18, None), ("h", at(4), "H02-U21", "U12", 5, None), ("i", at(0), "H05-U24", "U12", None, None),
            ("j", at(0), "H10-U29", "U15", -1, None)]
    decided = jobs.decide_grades(later, spark.createDataFrame(rows, GRADE))
    assert outcomes(decided) == {
        "a": "submission_not_found", "b": "auto_checked_homework", "c": "already_checked", "d": "not_course_teacher", "e": "score_out_of_range",
        "f": "graded", "g": "already_checked", "h": "already_checked", "i": "graded", "j": "score_out_of_range"}
    after = jobs.apply_grades(later, decided).onto(later)
    got = {r.id: (r.status, r.score, r.checked_by) for r in after.homework_submissions.collect()}
    assert got["H02-U21"] == ("checked", 17, "U11") and got["H05-U24"] == ("checked", None, "U12") and got["H10-U29"][0] == "submitted"


def test_deactivation(spark, later):
    rows = [("a", LATER, "U20", "U01", "left"), ("b", LATER + timedelta(1), "U20", "U01", "again"), ("c", LATER, "U10", "U01", "x"),
            ("d", LATER, "U99", "U01", "x"), ("e", LATER, "U21", "U10", "x"), ("f", LATER, "U27", "U02", "late")]
    feed = spark.createDataFrame(rows, "cmd_id string, cmd_ts timestamp, student_id string, admin_id string, note string")
    decided = jobs.decide_deactivations(later, feed)
    assert outcomes(decided) == {"a": "deactivated", "b": "already_inactive", "c": "not_a_student", "d": "user_not_found",
                                 "e": "admin_not_active", "f": "already_inactive"}
    change = jobs.apply_deactivations(later, decided)
    after = change.onto(later)
    assert after.enrollments.filter("student_id in ('U20', 'U27') and is_active").isEmpty()
    user = after.users.filter("id = 'U20'").first()
    assert not user.is_active and user.updated_at == LATER
    counts = {r.metadata for r in change.appends["activity_log"].filter("action = 'deactivate_student'").collect()}
    assert len(counts) == 3 and any('"courses_affected":2' in m for m in counts) and any('"courses_affected":0' in m for m in counts)
    assert change.appends["activity_log"].filter("action = 'unenroll'").count() == 3


def test_lesson_completion(spark, later):
    rows = [("a", 0, "U20", "L02"), ("b", 1, "U20", "L02"), ("c", 0, "U22", "L01"), ("d", 0, "U20", "L01"), ("e", 0, "U20", "L06"), ("f", 0, "U20", "L99")]
    feed = spark.createDataFrame([(c, LATER + timedelta(minutes=m), u, x) for c, m, u, x in rows],
                                     "cmd_id string, cmd_ts timestamp, student_id string, lesson_id string")
    decided = jobs.decide_completions(later, feed)
    assert outcomes(decided) == {"a": "inserted", "b": "already_complete", "c": "completed", "d": "already_complete", "e": "not_enrolled", "f": "lesson_not_found"}
    change = jobs.apply_completions(later, decided)
    rows = {(r.student_id, r.lesson_id): r for r in change.onto(later).lesson_progress.collect()}
    assert len(rows) == 23
    assert rows["U20", "L02"].completed_at is None  # an insert is never stamped
    assert rows["U22", "L01"].completed_at == LATER and rows["U22", "L01"].last_viewed_at == LATER
    assert sorted(r.action for r in change.appends["activity_log"].collect()) == ["complete_lesson", "view_lesson"]


def test_hand_ins(spark, later):
    rows = [("a", 0, "U22", "H01", "x", ""), ("b", 1, "U22", "H01", "y", ""), ("c", 0, "U22", "H02", "", ""), ("d", 0, "U22", "H02", "", "http://z"),
            ("e", 0, "U20", "H01", "x", None), ("f", 0, "U22", "H05", "x", None), ("g", 0, "U22", "H99", "x", None)]
    feed = spark.createDataFrame([(c, LATER + timedelta(minutes=m), u, h, a, b) for c, m, u, h, a, b in rows],
                                     "cmd_id string, cmd_ts timestamp, student_id string, homework_id string, answer_text string, answer_url string")
    decided = jobs.decide_submissions(later, feed)
    assert outcomes(decided) == {"a": "submitted", "b": "already_submitted", "c": "no_answer", "d": "submitted", "e": "already_submitted",
                                 "f": "not_enrolled", "g": "homework_not_found"}
    new = {r.homework_id: r for r in jobs.apply_submissions(later, decided).appends["homework_submissions"].collect()}
    assert (new["H01"].status, new["H01"].score, new["H01"].checked_at) == ("auto_checked", 10, LATER)
    assert (new["H02"].status, new["H02"].score, new["H02"].answer_text, new["H02"].answer_url) == ("submitted", None, None, "http://z")


def test_completion_stamps(school):
    old = school.lesson_progress
    new = old.withColumn("is_completed", ~F.col("is_completed"))
    rows = rules.set_completed_at(old, new, F.lit(str(LATER)).cast("timestamp")).collect()
    assert all((r.completed_at == LATER and r.last_viewed_at == LATER) if r.is_completed else r.completed_at is None for r in rows)


def test_load_rejects_bad_rows(spark):
    rows = seed.rows(spark)
    wrong = rows["homework_submissions"].withColumn("score", F.when(F.col("id") == "H02-U23", 21).otherwise(F.col("score")).cast("short"))
    teachers = rows["course_teachers"].withColumn("teacher_id", F.when(F.col("course_id") == "C6", "U20").otherwise(F.col("teacher_id")))
    _, rejects = jobs.load_rows(seed.empty(spark), {**rows, "homework_submissions": wrong, "course_teachers": teachers})
    assert {tuple(r) for r in rejects.collect()} == {("homework_submissions", "score_above_max", 1), ("course_teachers", "not_a_teacher", 1)}


def test_snapshots(spark, school):
    store = Store(spark, workspace(spark, "store"))
    assert store.manifest() == (0, {})
    assert refresh.refresh_needed(school)
    assert refresh.refresh_marts(school, store) == 1
    before = store.read("mv_student_scores")
    assert before.count() == 16
    assert store.read("mv_refresh_queue").filter("not processed").isEmpty()
    smaller = school.replace(enrollments=school.enrollments.filter("course_id = 'C1'"))
    assert refresh.refresh_marts(smaller, store) == 2
    assert before.count() == 16  # a reader keeps the rows it resolved
    assert store.read("mv_student_scores").count() == 4
    # data without a manifest is not visible
    school.users.write.parquet(f"{store.root}/data/mv_student_scores/v000000003-lost")
    assert store.read("mv_student_scores").count() == 4
    assert set(store.tables(AS_OF).frames) >= {"mv_admin_dashboard", "mv_refresh_queue"}


def test_typed_tables_round_trip(spark, school):
    root = workspace(spark, "tables")
    write_tables(school, root)
    t = read_tables(spark, root, AS_OF)
    assert {n: df.count() for n, df in t.frames.items()} == {n: df.count() for n, df in school.frames.items()}
    assert t.payments.schema["amount"].dataType.simpleString() == "decimal(10,2)"
    assert sorted(map(str, marts.student_scores(t).collect())) == sorted(map(str, marts.student_scores(school).collect()))
    # filters and columns reach the scan
    plan = t.homework_submissions.filter("status = 'submitted'").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(status,submitted)" in plan and "answer_text" not in plan
    lost = workspace(spark, "tables")
    write_tables(school, lost, [n for n in school.frames if n != "mv_refresh_queue"])
    assert read_tables(spark, lost, AS_OF).mv_refresh_queue.isEmpty()


def test_shuffle_partitions():
    assert shuffle_partitions(1) == 200
    assert shuffle_partitions(100 * 1024**3) == 800
    assert shuffle_partitions(10**18) == 100_000


def test_deltas_replace_a_repeated_batch(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    deltas = Deltas(spark, workspace(spark, "deltas"), ["k"])
    for value in ("c", "d"):
        deltas.write(0, spark.createDataFrame([(2, value), (3, value)], "k int, v string"))
    assert sorted(map(tuple, deltas.onto(base).collect())) == [(1, "a"), (2, "d"), (3, "d")]
    deltas.write(1, spark.createDataFrame([(3, "e")], "k int, v string"))
    assert sorted(map(tuple, deltas.onto(base).collect())) == [(1, "a"), (2, "d"), (3, "e")]


def bytes_read(spark):
    return sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())


def test_a_batch_writes_only_the_parts_it_touches(spark):
    store = Store(spark, workspace(spark, "keyed"))
    rows = spark.range(1_000).select(F.concat(F.lit("s"), "id").alias("s"), (F.col("id") % 7).alias("c"), F.lit("old").alias("v"))
    store.commit({"t": rows, "plain": rows.limit(3)}, AS_OF, layouts={"t": Layout(("s",), ("s", "c"), 32)})
    before, reader = store.part_folders("t"), store.read("t")
    change = spark.createDataFrame([("s5", 5, "new"), ("s5", 6, "more"), ("s9999", 1, "new"), (None, 2, "null")], "s string, c long, v string")
    store.commit(at=AS_OF, replace={"t": Replacement(change)}, appends={"plain": rows.limit(2), "fresh": rows.limit(1)})
    after = store.part_folders("t")
    touched = {r[0] for r in change.select(F.pmod(key_hash(["s"]), F.lit(32))).distinct().collect()}
    assert {i for i, (a, b) in enumerate(zip(before, after)) if a != b} == touched and len(touched) <= 3
    got = {(r.s, r.c): r.v for r in store.read("t").collect()}
    assert got["s5", 5] == "new" and got["s5", 6] == "more" and got["s9999", 1] == "new" and got[None, 2] == "null" and len(got) == 1_003
    assert reader.filter("v <> 'old'").isEmpty()  # a reader keeps the rows it resolved
    assert store.read("plain").count() == 5 and store.read("fresh").count() == 1
    # keys without rows are deleted; a change of no rows changes nothing
    store.commit(at=AS_OF, replace={"t": Replacement(change.limit(0), change.select("s", "c").filter("s = 's5'"))})
    assert store.read("t").filter("s = 's5'").isEmpty() and store.read("t").count() == 1_001
    version = store.part_folders("t")
    store.commit(at=AS_OF, replace={"t": Replacement(change.limit(0))})
    assert store.part_folders("t") == version
    assert {r.s for r in store.near("t", change).select("s").collect()} >= {"s9999"}
    assert store.near("t", change, most=0).filter("s = 's9999'").count() == 1  # by whole parts


def test_lookups_read_as_much_from_a_table_ten_times_as_large(spark):
    read, wanted = [], spark.createDataFrame([(f"s{i * 37}",) for i in range(20)], "s string")
    for n in (200_000, 2_000_000):
        store = Store(spark, workspace(spark, "grown"))
        rows = spark.range(n).select(F.concat(F.lit("s"), "id").alias("s"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
        store.commit({"t": rows}, AS_OF, layouts={"t": Layout(("s",), parts=n // 50_000)})
        hits = store.near("t", wanted)
        at = bytes_read(spark)
        assert {r.s for r in hits.collect()} == {r.s for r in wanted.collect()}
        read.append(bytes_read(spark) - at)
    assert read[1] < 4 * read[0] and read[1] < 0.1 * 2_000_000 * 64  # pages of the keys, and the footers of their parts


def test_jobs_against_stored_tables(spark, later):
    """A batch reads and writes the parts of its keys, and the store then holds what the job's new tables hold."""
    rows = [("a", 0, "U20", "C2", "U01"), ("b", 1, "U31", "C4", "U01"), ("c", 2, "U99", "C2", "U01")]
    store = Store(spark, workspace(spark, "stored"))
    store.commit({"enrollments": later.enrollments}, AS_OF, layouts={"enrollments": Layout(("student_id",), ("student_id", "course_id"), 64)})
    before = store.part_folders("enrollments")
    decided, change = jobs.run_stored(later, store, enrol(spark, *rows), jobs.decide_enrolments, jobs.apply_enrolments, {"enrollments": {"student_id": "student_id"}})
    assert outcomes(decided) == {"a": "enrolled", "b": "reactivated", "c": "student_not_found_or_inactive"}
    _, plain = jobs.run(later, enrol(spark, *rows), jobs.decide_enrolments, jobs.apply_enrolments)
    assert sorted(map(str, store.read("enrollments").collect())) == sorted(map(str, plain.tables["enrollments"].collect()))
    assert sum(a != b for a, b in zip(before, store.part_folders("enrollments"))) == 2
    assert store.read("activity_log").count() == plain.appends["activity_log"].count() == 3


@pytest.fixture()
def busy(spark, sf_dir):
    """The earlier state of the test tables, and three batches of changes to a few students of it."""
    from learnmart import catalog

    t = testdata.load(spark, sf_dir)
    start, some = commands.before(t), F.col("student_id").isin("S3", "S11", "S12", "S90", "S104")
    changes = []
    for job in ("enrollments", "completions", "submissions"):
        _, feed, decide, apply = catalog.JOB_STEPS[job]
        changes.append(jobs.run(start, feed(start).filter(some), decide, apply)[1])
    _, _, decide, apply = catalog.JOB_STEPS["grades"]
    changes.append(jobs.run(start, commands.grade_commands(t).limit(300), decide, apply)[1])
    after = start
    for change in changes[:3]:
        after = change.onto(after)
    # hand-ins change twice, by appended rows and by grades
    graded = changes[3].upserts["homework_submissions"].withColumn("id", F.col("id").cast("string"))
    work = after.homework_submissions.withColumn("id", F.col("id").cast("string"))
    return start, changes, after.replace(homework_submissions=work.join(graded.select("id"), "id", "left_anti").unionByName(graded))


def test_followed_marts_equal_a_full_refresh(spark, busy):
    start, changes, after = busy
    store = Store(spark, workspace(spark, "followed"))
    refresh.start_following(start, store, parts=64)
    names = ["mv_student_scores", "mv_course_completion"]
    before = {name: store.part_folders(name) for name in names}
    refresh.follow(start, changes, store, after)
    touched = set()
    for change in changes:
        for name, key, outline in (("enrollments", "course_id", None), ("lesson_progress", "lesson_id", after.lesson_outline), ("homework_submissions", "homework_id", after.homework_outline)):
            for rows in (change.upserts.get(name), change.appends.get(name)):
                if rows is not None:
                    rows = rows.select(key) if outline is None else rows.select(key).join(outline, key)
                    touched |= {r[0] for r in rows.select("course_id").distinct().collect()}
    parts = {r[0] for r in spark.createDataFrame([(c,) for c in touched], "course_id long").select(F.pmod(key_hash(["course_id"]), F.lit(64))).collect()}
    for name in names:
        assert {i for i, (a, b) in enumerate(zip(before[name], store.part_folders(name))) if a != b} <= parts
    whole = Store(spark, workspace(spark, "whole"))
    refresh.refresh_marts(after.replace(mv_refresh_queue=changes[0].appends["mv_refresh_queue"]), whole)
    for name in (*refresh.BUILDERS,):
        assert sorted(map(str, store.read(name).collect())) == sorted(map(str, whole.read(name).collect())), name
    assert store.read("mv_refresh_queue").filter("not processed").isEmpty()
    # nothing changed: nothing but the dashboard is written
    folders = store.manifest()[1]
    refresh.follow(after, [], store, after)
    assert {n for n, f in store.manifest()[1].items() if f != folders[n]} == {"mv_admin_dashboard"}
    with pytest.raises(ValueError):
        refresh.follow(after, [jobs.Change(upserts={"courses": after.courses})], store, after)


def test_one_student_is_ranked_from_the_parts_of_their_courses(spark, sf_dir):
    t = testdata.load(spark, sf_dir)
    store = Store(spark, workspace(spark, "ranked"))
    refresh.start_following(t, store, parts=128)
    student = t.enrollments.filter("is_active").join(t.course_totals.filter("total_homeworks > 0"), "course_id").first().student_id
    near = refresh.near_student(t, store, student)
    courses = t.enrollments.filter(F.col("student_id") == student).select("course_id").distinct()
    seen = t.lesson_progress.filter(F.col("student_id") == student).join(t.lesson_outline, "lesson_id").select("course_id")
    sent = t.homework_submissions.filter(F.col("student_id") == student).join(t.homework_outline, "homework_id").select("course_id")
    parts = {r[0] for r in courses.union(seen).union(sent).select(F.pmod(key_hash(["course_id"]), F.lit(128))).distinct().collect()}
    read = {int(f.split("_part=")[1].split("/")[0]) for f in near.enrolment_facts.inputFiles() if "_part=" in f}
    assert read <= parts and len(read) < 20
    whole = lookups.student_rank(t).filter(F.col("student_id") == student).collect()
    assert whole and sorted(lookups.student_rank(near, student).collect()) == sorted(whole) == sorted(lookups.student_rank(t, student).collect())


def test_a_deactivated_student_leaves_the_followed_marts(spark, school):
    store = Store(spark, workspace(spark, "left"))
    refresh.start_following(school, store, parts=4)
    rows = spark.createDataFrame([("a", LATER, "U20", "U01", "left")], "cmd_id string, cmd_ts timestamp, student_id string, admin_id string, note string")
    _, change = jobs.run(school, rows, jobs.decide_deactivations, jobs.apply_deactivations)
    after = change.onto(school)
    refresh.follow(school, [change], store, after)
    for name, build in refresh.BUILDERS.items():
        assert sorted(map(str, store.read(name).collect())) == sorted(map(str, build(after).collect())), name
    assert store.read("mv_student_scores").filter("student_id = 'U20'").isEmpty()


def test_reports_read_the_stored_marts(spark, school):
    """A report over stored marts shows the last refresh, whatever has changed since."""
    store = Store(spark, workspace(spark, "marts"))
    refresh.refresh_marts(school, store)
    later = school.replace(homework_submissions=school.homework_submissions.limit(0), lesson_progress=school.lesson_progress.limit(0))
    seen = refresh.with_marts(later, store)
    for report in (admin.dashboard, admin.ranking, admin.workload, students.ranking_topic, lookups.course_stats, lookups.teacher_students):
        now, then = (sorted(map(str, report(t).collect())) for t in (seen, school))
        assert now == then
        assert now != sorted(map(str, report(later).collect()))


def test_load_refuses_what_the_tables_forbid(spark, school):
    """First reason of each row; a refused row takes no key from a good one."""
    work = school.homework_submissions.select("homework_id", "student_id").distinct()
    free = school.homeworks.filter("check_type = 'manual'").select(F.col("id").alias("homework_id")).crossJoin(
        school.users.filter("role = 'student'").select(F.col("id").alias("student_id"))).join(work, ["homework_id", "student_id"], "left_anti").first()
    h, s, at = free.homework_id, free.student_id, school.as_of
    taken = work.first()
    rows = [("N1", h, s, None, None, None, "submitted"), ("N2", h, s, "a", None, None, "graded"), ("N3", h, s, "a", None, -1, "checked"),
            ("N4", h, "nobody", "a", None, None, "submitted"), ("N5", h, s, "a", None, None, "submitted"), ("N6", h, s, "a", None, None, "submitted"),
            ("N7", taken.homework_id, taken.student_id, "a", None, None, "submitted"), ("N8", None, s, "a", None, None, "submitted")]
    new = spark.createDataFrame([(*r, None, None, at) for r in rows], ", ".join(
        f"{c} {'short' if c == 'score' else 'timestamp' if c.endswith('_at') else 'string'}" for c in
        ("id", "homework_id", "student_id", "answer_text", "answer_url", "score", "status", "checked_by", "checked_at", "submitted_at")))
    after, rejects = jobs.load_rows(school, {"homework_submissions": new})
    assert {(r.reason, r["rows"]) for r in rejects.collect()} == {
        ("answer_provided", 1), ("status_not_allowed", 1), ("score_not_negative", 1), ("student_id_unknown", 1),
        ("homework_id_student_id_taken", 2), ("homework_id_required", 1)}
    assert {r.id for r in after.homework_submissions.select("id").subtract(school.homework_submissions.select("id")).collect()} == {"N5"}
