"""Edge cases, invariants, and the ways taken beyond the broadcast limit."""

from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
import seed
from pyspark.sql import functions as F

from learnmart.functions import exprs
from learnmart.functions.prefix import ranked_totals
from learnmart.functions.sizing import heavy_keys, salted_join, skewed_join
from learnmart.model import Tables, typed
from learnmart.operators import jobs, lookups, marts, quality, rules
from learnmart.operators.facts import global_rank, per_teacher_rows, rank_within
from learnmart.plans import finance, pages, students, teachers
from learnmart.sources import testdata

AS_OF = seed.AS_OF


def extended(spark, school: Tables) -> Tables:
    """The seed with awkward rows: no lessons, no teachers, no middle name, an idle user."""
    extra = {
        "users": typed(spark, "users", [("U90", "u90@x", "student", "Ян", "Ли", None, None, True, AS_OF, AS_OF)],
                       ["id", "email", "role", "first_name", "last_name", "middle_name", "phone", "is_active", "created_at", "updated_at"]),
        "courses": typed(spark, "courses", [("C9", "P3", "Пустой", "Право", None, None, True, AS_OF, AS_OF)],
                         ["id", "topic_id", "title", "subject", "price_monthly", "price_yearly", "is_active", "created_at", "updated_at"]),
        "enrollments": typed(spark, "enrollments", [("E90", "U90", "C9", AS_OF, True), ("E91", "U90", "C1", AS_OF, False)]),
    }
    return school.replace(**{n: school.frames[n].unionByName(df) for n, df in extra.items()})


def test_course_without_lessons_teachers_or_payments(spark, school):
    t = extended(spark, school)
    row = marts.student_progress(t).filter("course_id = 'C9'").first()
    assert (row.total_lessons, row.lessons_progress_pct, row.max_possible_score, row.score_pct) == (0, 0, 0, 0)
    assert marts.student_scores(t).filter("course_id = 'C9'").isEmpty()
    done = marts.course_completion(t).filter("course_id = 'C9'").first()
    assert (done.completion_pct, done.avg_completion_pct_in_course) == (0, 0)
    money = marts.course_finance(t).filter("course_id = 'C9'").first()
    assert (money.total_revenue, money.payments_count, money.first_payment_date) == (0, 0, None)
    stats = lookups.course_stats(t, "C9").first()
    assert (stats.modules_count, stats.lessons_count, stats.enrolled_students) == (0, 0, 1)
    # an inactive place counts in the progress list but nowhere else
    assert marts.student_progress(t).filter("student_id = 'U90' and course_id = 'C1'").count() == 1
    assert marts.student_scores(t).filter("student_id = 'U90'").isEmpty()


def test_user_without_activity_or_middle_name(spark, school):
    t = extended(spark, school)
    row = students.activity(t).filter("student_id = 'U90'").first()
    assert (row.full_name, row.actions, row.active_days, row.last_activity) == ("Ли Ян", 0, 0, None)
    assert students.activity(t).collect()[-1].student_id == "U90"  # no activity sorts last
    assert lookups.course_progress_report(t, "C9").first().status_label == lookups.IDLE


def test_course_without_teacher_lists_null(spark, school):
    t = school.replace(course_teachers=school.course_teachers.filter("course_id <> 'C2'"))
    got = {r.course_id: r.teacher_ids for r in marts.pending_homeworks(t).collect()}
    assert got["C2"] == [None] and got["C1"] == ["U10", "U11"]
    assert marts.upcoming_webinars(school.replace(course_teachers=school.course_teachers.limit(0))).first().teachers is None


@pytest.mark.parametrize("start,kind,end", [
    (date(2024, 1, 31), "monthly", date(2024, 2, 28)),
    (date(2023, 1, 31), "monthly", date(2023, 2, 27)),
    (date(2024, 2, 29), "yearly", date(2025, 2, 27)),
    (date(2024, 12, 1), "monthly", date(2024, 12, 31)),
    (date(2024, 1, 1), "weekly", None),
])
def test_period_end(spark, start, kind, end):
    df = spark.createDataFrame([(start, kind)], "s date, k string")
    assert df.select(exprs.period_end(F.col("s"), F.col("k"))).first()[0] == end


@pytest.mark.parametrize("num,den,pct", [(1, 8, "12.5"), (1, 2000, "0.1"), (1, 2001, "0.0"), (2, 3, "66.7"), (0, 5, "0.0"), (5, 0, None)])
def test_percentages_round_halves_up(spark, num, den, pct):
    got = spark.range(1).select(exprs.pct1(F.lit(num).cast("long"), F.lit(den).cast("long"))).first()[0]
    assert got == (None if pct is None else Decimal(pct))


def test_growth_may_be_negative(spark):
    df = spark.createDataFrame([(Decimal("-50.00"), Decimal("400.00"))], "a decimal(20,2), b decimal(20,2)")
    assert df.select(exprs.money_pct1(F.col("a"), F.col("b"))).first()[0] == Decimal("-12.5")


def test_expiring_limits(spark, school):
    day = AS_OF.date()
    ends = {"U20": day - timedelta(1), "U21": day, "U22": day + timedelta(6), "U23": day + timedelta(7), "U24": day + timedelta(29), "U25": day + timedelta(30)}
    rows = [(f"p{u}{i}", u, "C1" if u < "U24" else "C2", Decimal(10), "monthly", day, day, end - timedelta(i), "U01", AS_OF)
            for u, end in ends.items() for i in (0, 5)]
    cols = ["id", "student_id", "course_id", "amount", "subscription_type", "payment_date", "period_start", "period_end", "created_by", "created_at"]
    t = school.replace(payments=typed(spark, "payments", rows, cols))
    got = {r.student_id: (r.days_left, r.status) for r in finance.expiring_subscriptions(t).collect()}
    assert got == {"U20": (-1, finance.EXPIRED), "U21": (0, finance.URGENT), "U22": (6, finance.URGENT),
                   "U23": (7, finance.THIS_MONTH), "U24": (29, finance.THIS_MONTH)}


def test_webinar_window_is_closed(spark, school):
    at = {"L02": timedelta(0), "L05": timedelta(days=30), "L11": timedelta(days=30, seconds=1), "L15": timedelta(seconds=-1)}
    times = F.create_map(*[x for k, v in at.items() for x in (F.lit(k), F.lit(str(AS_OF + v)).cast("timestamp"))])
    lessons = school.lessons.withColumn("webinar_scheduled_at", F.coalesce(times[F.col("id")], F.col("webinar_scheduled_at")))
    assert {r.lesson_id for r in marts.upcoming_webinars(school.replace(lessons=lessons)).collect()} == {"L02", "L05", "L17"}


def test_activity_fourteen_days_ago_is_not_idle(spark, school):
    for delta, label in ((timedelta(days=14), lookups.STUDYING), (timedelta(days=14, seconds=1), lookups.IDLE)):
        log = typed(spark, "activity_log", [("x", "U20", "login", AS_OF - delta)], ["id", "user_id", "action", "created_at"])
        report = lookups.course_progress_report(school.replace(activity_log=log), "C1")
        assert report.filter("student_id = 'U20'").first().status_label == label


def test_check_deadlines(spark, school):
    hours = {"U21": 71, "U24": 47, "U29": 100}
    waited = F.create_map(*[x for k, v in hours.items() for x in (F.lit(k), F.lit(str(AS_OF - timedelta(hours=v))).cast("timestamp"))])
    work = school.homework_submissions.withColumn("submitted_at", F.coalesce(waited[F.col("student_id")], F.col("submitted_at")))
    got = {r.homework_title[-3:]: (r.deadline_state, r.hours_waiting) for r in teachers.check_queue(school.replace(homework_submissions=work)).collect()}
    assert got == {"H02": (teachers.URGENT, Decimal(71)), "H05": (teachers.URGENT, Decimal(47)), "H10": (teachers.OVERDUE, Decimal(100))}


def test_equal_revenue_shares_a_rank(spark, school):
    rows = [(f"p{c}", "U20", c, Decimal(100), "monthly", AS_OF.date(), AS_OF.date(), AS_OF.date(), "U01", AS_OF) for c in ("C1", "C2", "C3")]
    cols = ["id", "student_id", "course_id", "amount", "subscription_type", "payment_date", "period_start", "period_end", "created_by", "created_at"]
    got = [(r.revenue_rank, r.course_id, r.abc_class[0]) for r in finance.abc(school.replace(payments=typed(spark, "payments", rows, cols))).collect()]
    assert got == [(1, "C1", "A"), (1, "C2", "A"), (1, "C3", "C")]


def test_revenue_period_is_checked(school):
    with pytest.raises(ValueError):
        lookups.monthly_revenue(school, date(2024, 2, 1), date(2024, 1, 1))
    assert lookups.monthly_revenue(school).first().cumulative_revenue == Decimal(179700)


# -- ranks and joins against brute force, with one hot group -----------------------------


def test_rank_within_equals_a_window(spark, school):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 40).cast("string"))).alias("course_id"),
        (F.xxhash64("id") % 17 + 17).alias("score"), "id")
    got = rank_within(school, rows, "score", "place", size="n")
    from pyspark.sql import Window
    w = Window.partitionBy("course_id")
    want = rows.withColumn("place", F.rank().over(w.orderBy(F.desc("score"))).cast("long")).withColumn("n", F.count("*").over(w))
    cols = ["id", "course_id", "score", "place", "n"]
    assert sorted(got.select(cols).collect()) == sorted(want.select(cols).collect())
    overall = global_rank(rows, "score", "place").select("id", "place")
    want = rows.withColumn("place", F.rank().over(Window.orderBy(F.desc("score"))).cast("long")).select("id", "place")
    assert sorted(overall.collect()) == sorted(want.collect())


def test_salted_join_equals_a_join(spark):
    big = spark.range(2000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("a"))
    many = spark.range(60).select((F.col("id") % 10).alias("k"), F.col("id").alias("b"))
    assert sorted(salted_join(big, many, "k").select("k", "a", "b").collect()) == sorted(big.join(many, "k").select("k", "a", "b").collect())


@pytest.mark.parametrize("query", [
    marts.student_scores, marts.teacher_workload, marts.pending_homeworks, lookups.teacher_students, students.unsubmitted])
def test_results_do_not_depend_on_broadcasts(school, query):
    plain = Tables(school.spark, dict.copy(school.frames), school.as_of, broadcast_bytes=-1)
    assert not plain.assignments_fit
    assert sorted(map(str, query(plain).collect())) == sorted(map(str, query(school).collect()))


def test_long_courses(spark, school):
    """A course with 130 lessons and homework; facts stay as wide as for any other."""
    n = 130
    lessons = typed(spark, "lessons", [(f"X{i:03d}", "M03", f"X{i}", "video", i + 1, "v", 10, i % 5 != 0, AS_OF) for i in range(n)],
                    ["id", "module_id", "title", "lesson_type", "order_index", "video_url", "duration_minutes", "is_published", "created_at"])
    work = typed(spark, "homeworks", [(f"Y{i:03d}", f"X{i:03d}", f"Y{i}", "manual", 10, AS_OF) for i in range(n)],
                 ["id", "lesson_id", "title", "check_type", "max_score", "created_at"])
    done = typed(spark, "lesson_progress", [(f"Q{i}", "U20", f"X{i:03d}", True, AS_OF) for i in range(0, n, 3)],
                 ["id", "student_id", "lesson_id", "is_completed", "last_viewed_at"])
    sent = typed(spark, "homework_submissions", [(f"Z{i}", f"Y{i:03d}", "U20", "a", "submitted", AS_OF) for i in range(0, n, 2)],
                 ["id", "homework_id", "student_id", "answer_text", "status", "submitted_at"])
    extra = {"lessons": lessons, "homeworks": work, "lesson_progress": done, "homework_submissions": sent}
    t = school.replace(**{k: school.frames[k].unionByName(df) for k, df in extra.items()})
    todo = {r.homework_title for r in students.unsubmitted(t).filter("student_id = 'U20' and homework_title like 'Y%'").collect()}
    assert todo == {f"Y{i}" for i in range(n) if i % 2 and i % 5}
    seen = {r.lesson_id: r.is_completed for r in pages.lesson_detail(t, "U20").filter("lesson_id like 'X%'").collect()}
    assert seen == {f"X{i:03d}": i % 3 == 0 for i in range(n)}
    outline = pages.course_outline(t, "U20", "C1").first().modules[-1]
    assert [(x.lesson_id, x.is_completed) for x in outline.lessons] == [(f"X{i:03d}", i % 3 == 0) for i in range(n) if i % 5]
    row = marts.student_progress(t).filter("student_id = 'U20' and course_id = 'C1'").first()
    assert row.completed_lessons == 3 + len([i for i in range(0, n, 3) if i % 5])


# -- invariants on the test tables --------------------------------------------------------


def test_invariants(spark, sf_dir):
    t = testdata.load(spark, sf_dir)
    progress = marts.student_progress(t)
    assert progress.filter("completed_lessons > total_lessons or total_score > max_possible_score").isEmpty()
    assert progress.count() == t.enrollments.count()
    total = finance.totals(t).first().total_revenue
    assert marts.course_finance(t).agg(F.sum("total_revenue")).first()[0] == total
    months = finance.monthly_dynamics(t).collect()
    assert months[-1].running_total == total
    abc = finance.abc(t).collect()
    assert abc[-1].cumulative_pct == 100
    assert abs(sum(r.share_pct for r in abc) - 100) <= Decimal("0.05") * len(abc)


def test_clean_tables_have_no_violations(school):
    assert quality.unique_violations(school).isEmpty()
    assert quality.orphan_rows(school).isEmpty()
    assert quality.check_violations(school).isEmpty()
    assert quality.domain_violations(school).isEmpty()


def test_injected_faults(spark, school):
    users = school.users.unionByName(typed(spark, "users", [
        ("U98", "U20@school.ru", "guest", "A", "B" * 101, AS_OF, AS_OF, True)],
        ["id", "email", "role", "first_name", "last_name", "created_at", "updated_at", "is_active"]))
    lessons = school.lessons.withColumn("webinar_url", F.lit(None).cast("string")).withColumn("duration_minutes", F.lit(None).cast("short"))
    ct = school.course_teachers.unionByName(typed(spark, "course_teachers", [("C8", "U10", AS_OF), ("C1", "U77", AS_OF)]))
    t = school.replace(users=users, lessons=lessons, course_teachers=ct)
    rule = lambda df: {(r.table_name, r.rule, r.key_value) for r in df.collect()}
    assert rule(quality.unique_violations(t)) == {("users", "email", "U20@school.ru")}
    assert rule(quality.orphan_rows(t)) == {("course_teachers", "course_id->courses", "C8"), ("course_teachers", "teacher_id->users", "U77")}
    assert rule(quality.domain_violations(t)) == {("users", "role in user_role", "U98"), ("users", "last_name length", "U98")}
    # a NULL duration passes, a webinar without its address does not
    assert rule(quality.check_violations(t)) == {("lessons", "webinar_fields", i) for i in ("L02", "L05", "L11", "L15", "L17")}


def test_cascade_purge(spark, school):
    ids = spark.createDataFrame([("U20",), ("U10",), ("U01",), ("U02",), ("U15",)], "id string")
    courses = spark.createDataFrame([("C1",), ("C9",)], "id string")
    t = school.replace(payments=school.payments.filter("student_id <> 'U20' and created_by <> 'U02'"),
                       courses=extended(spark, school).courses)
    change, rejects = quality.cascade_purge(t, {"users": ids, "courses": courses})
    assert {(r.kind, r.id, r.reason) for r in rejects.collect()} == {
        ("users", "U10", "homework_submissions.checked_by"), ("users", "U01", "payments.created_by"), ("courses", "C1", "enrollments.course_id")}
    after = change.onto(t)
    assert {r.id for r in t.users.select("id").subtract(after.users.select("id")).collect()} == {"U20", "U02", "U15"}
    for name, column in (("enrollments", "student_id"), ("lesson_progress", "student_id"), ("homework_submissions", "student_id"),
                         ("activity_log", "user_id"), ("course_teachers", "teacher_id")):
        assert after.frames[name].filter(F.col(column).isin("U20", "U02", "U15")).isEmpty()
    assert after.courses.filter("id = 'C9'").isEmpty() and after.modules.count() == 13


def test_purge_of_any_table_walks_the_declared_references(spark, school):
    frame = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    lesson = school.homework_submissions.join(school.homeworks.select(F.col("id").alias("homework_id"), "lesson_id"), "homework_id").first().lesson_id
    module = school.lessons.filter(F.col("id") == lesson).first().module_id
    change, rejects = quality.cascade_purge(school, {"modules": frame(module), "topics": frame(school.courses.first().topic_id)})
    assert {(r.kind, r.reason) for r in rejects.collect()} == {("topics", "courses.topic_id")}
    after = change.onto(school)
    lessons = [r.id for r in school.lessons.filter(F.col("module_id") == module).collect()]
    homeworks = [r.id for r in school.homeworks.filter(F.col("lesson_id").isin(lessons)).collect()]
    assert homeworks and after.topics.count() == school.topics.count()
    for name, column, ids in (("modules", "id", [module]), ("lessons", "id", lessons), ("homeworks", "id", homeworks),
                              ("homework_submissions", "homework_id", homeworks), ("lesson_progress", "lesson_id", lessons)):
        kept = school.frames[name].filter(~F.col(column).isin(ids))
        assert sorted(map(str, after.frames[name].collect())) == sorted(map(str, kept.collect()))
    assert set(change.tables) == {"modules", "lessons", "homeworks", "homework_submissions", "lesson_progress", "topics"}
    # a topic goes with nothing on it, and a refused delete keeps what it would have taken
    empty = school.replace(courses=school.courses.limit(0))
    assert quality.cascade_purge(empty, {"topics": frame(school.courses.first().topic_id)})[1].isEmpty()
    teacher = school.homework_submissions.filter("checked_by is not null").first().checked_by
    unpaid = school.replace(payments=school.payments.limit(0))
    taught = [r.student_id for r in school.homework_submissions.filter(F.col("checked_by") == teacher).select("student_id").distinct().collect()]
    change, rejects = quality.cascade_purge(unpaid.replace(payments=school.payments.filter(F.col("student_id") == taught[0])), {"users": frame(teacher, *taught)})
    assert {(r.id, r.reason) for r in rejects.collect()} >= {(taught[0], "payments.student_id"), (teacher, "homework_submissions.checked_by")}


def test_ranks_and_running_sums_over_partitions_with_ties(spark, school):
    rows = [(i, v) for i, v in enumerate([50] * 40 + [7] * 300 + [9, 8, 8, 3] + [1] * 60)]
    df = spark.createDataFrame(rows, "k int, v long")
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        got = {r.k: (r["rank"], r.running, r.total) for r in ranked_totals(school, df, "v", "k").collect()}
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    ordered, running = sorted(rows, key=lambda r: (-r[1], r[0])), 0
    for k, v in ordered:
        running += v
        assert got[k] == (1 + sum(w > v for _, w in rows), running, sum(w for _, w in rows))
    plan = finance.abc(school)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert ranked_totals(school, df.limit(0), "v", "k").count() == 0


def test_only_heavy_courses_are_salted(spark, school):
    rows = spark.createDataFrame([(1, i) for i in range(900)] + [(2 + i % 300, i) for i in range(600)], "course_id int, student_id int")
    many = spark.createDataFrame([(1 + i % 301, f"T{i}") for i in range(700)], "course_id int, teacher_id string")
    assert heavy_keys(rows, "course_id") == [1]
    want = sorted(rows.join(many, "course_id").collect())
    assert sorted(skewed_join(rows, many, "course_id").select("course_id", "student_id", "teacher_id").collect()) == want
    plain = Tables(spark, dict.copy(school.frames) | {"course_teachers": many}, school.as_of, broadcast_bytes=-1)
    assert sorted(per_teacher_rows(plain, rows, many).select("course_id", "student_id", "teacher_id").collect()) == want
    copies = many.withColumn("hot", F.col("course_id") == 1).groupBy("hot").count().collect()
    assert {r.hot: r["count"] for r in copies} == {True: 3, False: 697}  # three rows are repeated, the others not
    assert skewed_join(rows.limit(0), many, "course_id").count() == 0


def test_a_grader_leaves_with_the_student(spark, school):
    """A grade goes with its student; it blocks the teacher only while somebody it belongs to stays."""
    by = {}
    for r in school.homework_submissions.filter("checked_by is not null").select("checked_by", "student_id").distinct().collect():
        by.setdefault(r.checked_by, set()).add(r.student_id)
    teacher, students = min(by.items(), key=lambda x: len(x[1]))
    t = school.replace(payments=school.payments.limit(0))
    for extra, refused in ((students, set()), (set(list(students)[1:]), {(teacher, "homework_submissions.checked_by")})):
        ids = spark.createDataFrame([(i,) for i in [teacher, *extra]], "id string")
        change, rejects = quality.cascade_purge(t, {"users": ids})
        assert {(r.id, r.reason) for r in rejects.collect()} == refused
        assert change.onto(t).users.filter(F.col("id") == teacher).isEmpty() == (not refused)


def test_a_payment_beyond_the_type_is_refused_alone(spark, school):
    day = school.as_of.date()
    pair = school.enrollments.filter("is_active").join(school.courses.filter("is_active").select(F.col("id").alias("course_id")), "course_id").first()
    rows = [(f"X{i}", school.as_of, pair.student_id, pair.course_id, "U01", amount, "monthly", day, None) for i, amount in enumerate((Decimal("1e9"), Decimal("10")))]
    commands = spark.createDataFrame(rows, "cmd_id string, cmd_ts timestamp, student_id string, course_id string, admin_id string, amount decimal(20,2), subscription_type string, period_start date, notes string")
    decided, change = jobs.run(school, commands, jobs.decide_payments, jobs.apply_payments)
    assert {(r.cmd_id, r.outcome, r.reason) for r in decided.collect()} == {("X0", "rejected", "amount_out_of_range"), ("X1", "recorded", None)}
    assert [r.amount for r in change.appends["payments"].collect()] == [Decimal("10.00")]


def test_work_graded_without_a_score_has_no_share(spark, school):
    graded = school.homework_submissions.filter("status = 'checked'").first()
    work = school.homework_submissions.withColumn("score", F.when(F.col("student_id") == graded.student_id, None).otherwise(F.col("score")))
    t = school.replace(homework_submissions=work)
    rows = marts.student_scores(t).filter(F.col("student_id") == graded.student_id).collect()
    assert rows and all(r.score_pct is None and r.total_score == 0 for r in rows)
    assert any(r.completed_hw_count > 0 for r in rows)
    assert all(r.score_pct is None for r in lookups.student_rank(t, graded.student_id).collect())


def test_log_rows_keep_null_fields(spark):
    df = spark.createDataFrame([("a", None)], "k string, v string")
    row = rules.log_rows(df, F.lit(str(datetime(2024, 1, 1))).cast("timestamp"), "act", "thing", "k", "k", {"v": F.col("v")}, ["k"]).first()
    assert row.metadata == '{"v":null}'
