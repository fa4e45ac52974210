"""What must not grow faster than the input: steps left out, joins over keys alone, small sides broadcast."""

import os

import pytest
from pyspark.sql import functions as F

from learnmart import catalog
from learnmart.functions import sizing
from learnmart.model import Tables
from learnmart.operators import jobs, quality
from learnmart.plans import students
from learnmart.sources import commands, testdata
from learnmart.sources.store import Layout, Store
from learnmart.sources.workspace import workspace


def unread():
    raise AssertionError("hand-ins are not needed here")


@pytest.fixture()
def no_broadcast(spark):
    """Only hints broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def below(text: str, node: str) -> str:
    """The lines of a plan under the first line that names ``node``."""
    lines = text.split("\n")
    at = next(i for i, line in enumerate(lines) if node in line)
    depth = lines[at].index(node)
    rest = []
    for line in lines[at + 1:]:
        if len(line) - len(line.lstrip(" :+-")) <= depth:
            break
        rest.append(line)
    return "\n".join(rest)


def test_the_state_before_works_out_no_hand_ins(spark, sf_dir):
    t = testdata.build(spark, sf_dir)
    dict.__setitem__(t.frames, "homework_submissions", unread)
    start = commands.before(t)
    decided = jobs.decide_enrolments(start, commands.enrol_commands(start))
    assert not jobs.decisions_of(decided).isEmpty()


def test_a_load_into_empty_tables_works_out_no_hand_ins(spark, sf_dir):
    t = testdata.build(spark, sf_dir)
    dict.__setitem__(t.frames, "homework_submissions", unread)
    after, rejects = catalog._loaded(t)
    assert not after.homework_submissions.isEmpty() and not rejects.isEmpty()


def test_first_grades_are_broadcast_if_measured_small(spark, sf_dir, no_broadcast):
    t = testdata.load(spark, sf_dir)
    decisions, change = jobs.run(t, commands.grade_commands(t), jobs.decide_grades, jobs.apply_grades)
    assert "SortMergeJoin" not in plan(jobs.decide_grades(t, commands.grade_commands(t)), "executedPlan")
    assert "SortMergeJoin" not in plan(change.tables["homework_submissions"], "executedPlan")


def test_grades_beyond_the_broadcast_limit_are_the_same(spark, sf_dir):
    t = testdata.load(spark, sf_dir)
    small = Tables(spark, dict.copy(t.frames), t.as_of, broadcast_bytes=0)
    feed = commands.grade_commands(t)
    rows = [sorted(map(str, jobs.decisions_of(jobs.decide_grades(x, feed)).collect())) for x in (t, small)]
    assert rows[0] == rows[1]


def test_owed_homework_is_held_against_hand_ins_without_titles(spark, school):
    report = students.unsubmitted(school)
    kept = [line for line in below(plan(report), "Join LeftAnti").split("\n") if "Project" in line]
    assert kept and not any("title" in line for line in kept[:2])
    twice = school.replace(homework_submissions=school.homework_submissions.union(school.homework_submissions),
                           enrollments=school.enrollments.union(school.enrollments))
    assert students.unsubmitted(twice).count() == 2 * report.count() > 0


def test_many_suspect_keys_are_counted_without_a_join(spark, school):
    t = school.replace(enrollments=school.enrollments.union(school.enrollments))
    beyond = Tables(spark, dict.copy(t.frames), t.as_of, broadcast_bytes=0)
    assert "LeftSemi" not in plan(quality.unique_violations(beyond))
    rows = [sorted(map(str, quality.unique_violations(x).collect())) for x in (t, beyond)]
    assert rows[0] == rows[1] and len(rows[0]) == 2 * school.enrollments.count()


def test_narrow_projections_are_broadcast_where_outlines_are_not(spark, school, no_broadcast):
    keys = school.homework_outline.select("homework_id", "course_id")
    t = Tables(spark, dict.copy(school.frames), school.as_of, broadcast_bytes=sizing.measured_bytes(keys))
    assert t.catalogue_size.outline_bytes > t.broadcast_bytes
    assert "BroadcastHashJoin" in plan(t.homework_submissions.join(t.outline_dim(keys), "homework_id"), "executedPlan")
    assert "BroadcastHashJoin" not in plan(t.homework_submissions.join(t.outline_dim(t.lesson_outline), F.lit(1) == F.col("lesson_id")), "executedPlan")


def test_refused_commands_are_not_joined_to_the_first(spark):
    rows = [("a", 1, "x", None), ("b", 2, "x", None), ("c", 0, "x", "bad")]
    judged = spark.createDataFrame(rows, "cmd_id string, cmd_ts int, k string, reason string")
    marked = jobs.mark_first(judged, F.col("reason").isNull(), ["k"])
    assert plan(marked).count("Union") == 1
    assert {(r.cmd_id, r.is_first) for r in marked.collect()} == {("a", True), ("b", False), ("c", False)}


@pytest.mark.parametrize("limit", [sizing.BROADCAST_BYTES, 300, 0])
def test_a_load_writes_whole_rows_once_and_refused_rows_as_their_reason(spark, school, no_broadcast, monkeypatch, limit):
    """The same outcome whether parents, the ids that are named, or nothing is small enough to broadcast."""
    cuts, real = [], Tables.cut

    def cut(self, name, df):
        cuts.append((name, plan(df), out := real(self, name, df)))
        return out

    work = school.homework_submissions.select("homework_id", "student_id").distinct()
    free = school.homeworks.filter("check_type = 'manual'").select(F.col("id").alias("homework_id")).crossJoin(
        school.users.filter("role = 'student'").select(F.col("id").alias("student_id"))).join(work, ["homework_id", "student_id"], "left_anti")
    a, b, c, d = free.orderBy("homework_id", "student_id").take(4)
    taken, teacher = work.first(), school.users.filter("role = 'teacher'").first().id
    rows = [("N1", *a, None, "submitted", None), ("N2", *a, "x", "graded", None), ("N3", *a, "x", "submitted", None), ("N4", *a, "x", "submitted", teacher),
            ("N5", a.homework_id, "nobody", "x", "submitted", None), ("N6", "H99", "nobody", "x", "submitted", "ghost"),
            ("N7", *taken, "x", "submitted", None), ("N8", *b, "x", "submitted", teacher), ("N8", *c, "x", "submitted", None),
            *[(f"G{i}", *d, "x", "submitted", f"ghost{i}") for i in range(9)], ("Z1", *d, "x", "submitted", None), ("Z2", None, *d[1:], "x", "submitted", None)]
    new = spark.createDataFrame([(*r, None, None, None, school.as_of) for r in rows], ", ".join(
        f"{c} {'short' if c == 'score' else 'timestamp' if c.endswith('_at') else 'string'}" for c in
        ("id", "homework_id", "student_id", "answer_text", "status", "checked_by", "answer_url", "score", "checked_at", "submitted_at")))
    t = Tables(spark, dict.copy(school.frames), school.as_of, broadcast_bytes=limit)
    monkeypatch.setattr(Tables, "cut", cut)
    after, rejects = jobs.load_rows(t, {"homework_submissions": new})
    assert {tuple(r)[1:] for r in rejects.collect()} == {
        ("answer_provided", 1), ("status_not_allowed", 1), ("homework_id_student_id_taken", 2), ("student_id_unknown", 1), ("homework_id_unknown", 1),
        ("id_taken", 1), ("checked_by_unknown", 9), ("homework_id_required", 1)}
    stored = after.homework_submissions.join(school.homework_submissions.select("id"), "id", "left_anti")
    assert sorted(r.id for r in stored.collect()) == ["N3", "N8", "Z1"]
    whole = [(name, text, df) for name, text, df in cuts if "answer_text" in df.columns]
    assert [name for name, _, _ in whole] == ["incoming"]
    _, text, written = whole[0]
    assert limit == sizing.BROADCAST_BYTES or "_parent" not in text
    assert written.filter("reject_reason is not null").dropna(thresh=2).isEmpty()


def test_a_large_part_is_written_by_several_tasks(spark):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "64k")
    try:
        rows = spark.range(0, 100_000, 1, 8).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
        store = Store(spark, workspace(spark, "parts"))
        store.commit({"r": rows}, layouts={"r": Layout(("k",), parts=2)})
    finally:
        spark.conf.set(size, before)
    for folder in store.part_folders("r"):
        assert len([f for f in os.listdir(folder) if f.endswith(".parquet")]) > 1
    assert store.read("r").agg(F.countDistinct("k"), F.count("*")).first() == (100_000, 100_000)
    assert store.near("r", spark.createDataFrame([(77,)], "k bigint")).filter("k = 77").count() == 1
