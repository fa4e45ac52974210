"""Golden results on the seed."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from learnmart.operators import jobs, lookups, marts
from learnmart.plans import admin, finance, pages, students, teachers

D = Decimal

# student, course: lessons done, total, %, score, max, %, mart %, rank, homework not handed in
GOLDEN = {
    ("U20", "C1"): (3, 5, "60.0", 18, 53, "34.0", "34.0", 2, 2),
    ("U21", "C1"): (1, 5, "20.0", 10, 53, "18.9", "18.9", 3, 2),
    ("U22", "C1"): (0, 5, "0.0", 0, 53, "0.0", None, 4, 4),
    ("U23", "C1"): (3, 5, "60.0", 31, 53, "58.5", "58.5", 1, 2),
    ("U24", "C2"): (1, 2, "50.0", 0, 20, "0.0", None, 1, 0),
    ("U25", "C2"): (0, 2, "0.0", 0, 20, "0.0", None, 1, 1),
    ("U30", "C2"): (0, 2, "0.0", 0, 20, "0.0", None, 1, 1),
    ("U20", "C3"): (1, 2, "50.0", 12, 12, "100.0", "100.0", 1, 0),
    ("U21", "C3"): (0, 2, "0.0", 0, 12, "0.0", None, 2, 1),
    ("U26", "C4"): (1, 3, "33.3", 10, 25, "40.0", "40.0", 1, 1),
    ("U27", "C4"): (1, 3, "33.3", 10, 25, "40.0", "40.0", 1, 1),
    ("U31", "C4"): (1, 3, "33.3", 0, 25, "0.0", None, 3, 2),
    ("U26", "C5"): (1, 3, "33.3", 20, 50, "40.0", "40.0", 1, 1),
    ("U29", "C5"): (2, 3, "66.7", 20, 50, "40.0", "40.0", 1, 0),
    ("U28", "C6"): (1, 2, "50.0", 38, 40, "95.0", "95.0", 1, 0),
    ("U30", "C6"): (0, 2, "0.0", 0, 40, "0.0", None, 2, 2),
}


def num(text):
    return None if text is None else D(text)


def test_progress(school):
    got = {
        (r.student_id, r.course_id): (r.completed_lessons, r.total_lessons, r.lessons_progress_pct, r.total_score,
                                      r.max_possible_score, r.score_pct)
        for r in marts.student_progress(school).collect()
    }
    assert got == {k: (v[0], v[1], D(v[2]), v[3], v[4], D(v[5])) for k, v in GOLDEN.items()}


def test_scores_and_ranks(school):
    got = {(r.student_id, r.course_id): (r.total_score, r.score_pct, r.rank_in_course) for r in marts.student_scores(school).collect()}
    assert got == {k: (v[3], num(v[6]), v[7]) for k, v in GOLDEN.items()}
    ranks = {(r.student_id, r.course_id): (r.rank_in_course, r.total_students) for r in lookups.student_rank(school).collect()}
    sizes = {"C1": 4, "C2": 3, "C3": 2, "C4": 3, "C5": 2, "C6": 2}
    assert ranks == {k: (v[7], sizes[k[1]]) for k, v in GOLDEN.items()}


def test_unsubmitted(school):
    got = {(r.student_id, r.course_title): r.n for r in
           students.unsubmitted(school).groupBy("student_id", "course_title").agg(F.count("*").alias("n")).collect()}
    titles = {r.id: r.title for r in school.courses.collect()}
    assert got == {(k[0], titles[k[1]]): v[8] for k, v in GOLDEN.items() if v[8]}
    assert sum(got.values()) == 20


def test_completion(school):
    rows = marts.course_completion(school).collect()
    assert {(r.student_id, r.course_id): r.completion_pct for r in rows} == {k: D(v[2]) for k, v in GOLDEN.items()}
    means = {"C1": "35.0", "C2": "16.7", "C3": "25.0", "C4": "33.3", "C5": "50.0", "C6": "25.0"}
    assert {r.course_id: r.avg_completion_pct_in_course for r in rows} == {k: D(v) for k, v in means.items()}


def test_abc(school):
    rows = [(r.course_id, r.revenue, r.share_pct, r.cumulative_pct, r.abc_class[0]) for r in finance.abc(school).collect()]
    assert rows == [
        ("C1", D(55600), D("30.9"), D("30.9"), "A"), ("C6", D(33400), D("18.6"), D("49.5"), "A"),
        ("C4", D(29500), D("16.4"), D("65.9"), "A"), ("C2", D(24400), D("13.6"), D("79.5"), "A"),
        ("C5", D(19900), D("11.1"), D("90.6"), "B"), ("C3", D(16900), D("9.4"), D("100.0"), "C"),
    ]


def test_course_stats_revenue(school):
    got = {r.course_id: (r.total_revenue, r.total_revenue_actual) for r in lookups.course_stats(school).collect()}
    assert got["C1"] == (D(27800), D(55600))
    assert got["C4"] == (D(26700), D(29500))
    assert all(a == b for k, (a, b) in got.items() if k not in ("C1", "C4"))


def test_finance_totals(school):
    r = finance.totals(school).first()
    assert (r.paying_students, r.paid_courses, r.payments_count, r.mean_payment, r.max_payment, r.min_payment) == (
        12, 6, 14, D("12835.71"), D(29900), D(2000))
    assert (r.yearly_count, r.monthly_count) == (7, 7)


def test_dashboard(school):
    r = marts.admin_dashboard(school).first()
    assert (r.total_active_students, r.total_active_teachers, r.total_active_courses, r.total_active_enrollments) == (12, 6, 6, 16)
    assert (r.pending_hw_checks, r.total_submissions) == (3, 15)
    assert (r.revenue_current_month, r.revenue_current_year, r.revenue_total) == (D(179700),) * 3


def test_workload(school):
    got = {r.teacher_id: (r.courses_count, r.total_students, r.pending_checks, r.total_checked) for r in marts.teacher_workload(school).collect()}
    assert got == {"U10": (1, 4, 1, 2), "U11": (2, 4, 1, 0), "U12": (1, 3, 1, 0), "U13": (1, 3, 0, 0), "U14": (1, 2, 0, 1), "U15": (1, 2, 1, 0)}


def test_webinars(school):
    rows = admin.webinars(school).collect()
    assert [r.lesson_title for r in rows] == [f"Lesson {i}" for i in ("L11", "L02", "L15", "L17", "L05")]
    assert rows[1].teachers == "Иванова Мария, Смирнов Алексей"
    assert [r.lesson_title for r in teachers.webinars(school, "смирнов").collect()] == ["Lesson L02", "Lesson L05"]


def test_load_side_effects(school):
    log = {r.action: r["count"] for r in school.activity_log.groupBy("action").count().collect()}
    assert log == {"enroll": 16, "admin_enroll": 16, "record_payment": 14, "view_lesson": 22, "login": 11}
    assert school.mv_refresh_queue.count() == 64


def test_grading_the_first_pending_work(school):
    commands = jobs.first_pending_grades(school, 17, teacher_id="U11", student_id="U21", comment="Хорошая работа")
    decided = jobs.decide_grades(school, commands)
    assert [(r.outcome, r.reason) for r in decided.collect()] == [("graded", None)]
    after = jobs.apply_grades(school, decided).onto(school)
    r = marts.student_progress(after).filter("student_id = 'U21' and course_id = 'C1'").first()
    assert (r.total_score, r.max_possible_score, r.score_pct) == (27, 53, D("50.9"))
    graded = teachers.student_grades(after, "U21").filter("homework_title = 'Homework H02'").first()
    assert (graded.score, graded.status_label, graded.checked_by_name) == (17, "🟢 Проверено", "Смирнов Алексей Владимирович")
    log = after.activity_log.filter("action = 'check_homework'").first()
    assert log.user_id == "U11" and '"comment":"Хорошая работа"' in log.metadata


def test_parameters(school):
    assert {r.student_id for r in lookups.teacher_students(school, "U11", "C3").collect()} == {"U20", "U21"}
    with pytest.raises(lookups.NotFound):
        lookups.teacher_students(school, "U20")
    with pytest.raises(lookups.NotFound):
        lookups.user_full_names(school, "nobody")
    with pytest.raises(lookups.NotFound):
        lookups.course_progress_report(school, "C9")
    with pytest.raises(lookups.NotFound):
        lookups.student_rank(school, "U20", "C2")
    assert lookups.user_full_names(school, "U25").first().full_name == "Зайцев Артём Денисович"
    outline = pages.course_outline(school, "U20", "C1").first().modules
    assert [(m.module_id, [(x.lesson_id, x.is_completed) for x in m.lessons]) for m in outline] == [
        ("M01", [("L01", True), ("L02", False), ("L03", True)]), ("M02", [("L04", True), ("L05", False)])]
    assert pages.course_outline(school, "U20", "C2").isEmpty()


def test_progress_labels(school):
    labels = {r.student_id: r.status_label for r in lookups.course_progress_report(school, "C1").collect()}
    assert labels == {"U20": "Активно учится", "U21": "Только начал", "U22": "Не приступал", "U23": "Активно учится"}


def test_directory_order(school):
    roles = [r.role for r in pages.user_directory(school).collect()]
    assert roles == ["admin"] * 2 + ["teacher"] * 6 + ["student"] * 12
