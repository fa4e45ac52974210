"""A small deterministic school.  Fixed values: the demo data the golden results are stated for."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from decimal import Decimal

from learnmart.model import Tables, typed
from learnmart.operators import jobs
from learnmart.schemas import TABLES

AS_OF = datetime(2024, 5, 20, 12, 0)
START = datetime(2024, 1, 1)

# id, role, first, last, middle
PEOPLE = [
    ("U01", "admin", "Иван", "Петров", "Сергеевич"), ("U02", "admin", "Петр", "Сидоров", "Алексеевич"),
    ("U10", "teacher", "Мария", "Иванова", "Александровна"), ("U11", "teacher", "Алексей", "Смирнов", "Владимирович"),
    ("U12", "teacher", "Елена", "Козлова", "Николаевна"), ("U13", "teacher", "Игорь", "Кузнецов", "Дмитриевич"),
    ("U14", "teacher", "Светлана", "Попова", "Юрьевна"), ("U15", "teacher", "Николай", "Васильев", "Андреевич"),
    ("U20", "student", "Анна", "Соколова", "Игоревна"), ("U21", "student", "Дмитрий", "Новиков", "Павлович"),
    ("U22", "student", "Ольга", "Морозова", "Сергеевна"), ("U23", "student", "Кирилл", "Волков", "Андреевич"),
    ("U24", "student", "Виктория", "Лебедева", "Михайловна"), ("U25", "student", "Артём", "Зайцев", "Денисович"),
    ("U26", "student", "Екатерина", "Романова", "Олеговна"), ("U27", "student", "Максим", "Макаров", "Ильич"),
    ("U28", "student", "Дарья", "Орлова", "Викторовна"), ("U29", "student", "Иван", "Тихонов", "Степанович"),
    ("U30", "student", "Мария", "Власова", "Борисовна"), ("U31", "student", "Алексей", "Мельников", "Григорьевич"),
]
TOPICS = [("P1", "ЕГЭ"), ("P2", "ОГЭ"), ("P3", "ДВИ"), ("P4", "Олимпиады")]
# id, topic, title, subject, monthly, yearly
COURSES = [
    ("C1", "P1", "ЕГЭ по математике (профиль)", "Математика", 2900, 24900),
    ("C2", "P1", "ЕГЭ по русскому языку", "Русский язык", 2500, 21900),
    ("C3", "P2", "ОГЭ по математике", "Математика", 1900, 16900),
    ("C4", "P1", "ЕГЭ по физике", "Физика", 2800, 23900),
    ("C5", "P2", "ОГЭ по информатике", "Информатика", 2000, 17900),
    ("C6", "P4", "Олимпиадная биология", "Биология", 3500, 29900),
]
TEACHING = [("C1", "U10"), ("C1", "U11"), ("C2", "U12"), ("C3", "U11"), ("C4", "U13"), ("C5", "U15"), ("C6", "U14")]
# id, course, order
MODULES = [
    ("M01", "C1", 1), ("M02", "C1", 2), ("M03", "C1", 3), ("M04", "C2", 1), ("M05", "C2", 2), ("M06", "C3", 1), ("M07", "C3", 2),
    ("M08", "C4", 1), ("M09", "C4", 2), ("M10", "C5", 1), ("M11", "C5", 2), ("M12", "C6", 1), ("M13", "C6", 2),
]
# id, module, order, minutes, webinar in days (None: video)
LESSONS = [
    ("L01", "M01", 1, 25, None), ("L02", "M01", 2, 90, 3), ("L03", "M01", 3, 40, None), ("L04", "M02", 1, 35, None),
    ("L05", "M02", 2, 90, 10), ("L06", "M04", 1, 30, None), ("L07", "M04", 2, 35, None), ("L08", "M06", 1, 28, None),
    ("L09", "M06", 2, 32, None), ("L10", "M08", 1, 30, None), ("L11", "M08", 2, 90, 2), ("L12", "M09", 1, 40, None),
    ("L13", "M10", 1, 45, None), ("L14", "M10", 2, 30, None), ("L15", "M11", 1, 90, 5), ("L16", "M12", 1, 50, None),
    ("L17", "M13", 1, 120, 7),
]
# id, lesson, check type, maximum, deadline hours
HOMEWORKS = [
    ("H01", "L01", "auto", 10, 48), ("H02", "L02", "manual", 20, 72), ("H03", "L03", "manual", 15, 72), ("H04", "L04", "auto", 8, 48),
    ("H05", "L06", "manual", 20, 48), ("H06", "L08", "auto", 12, 48), ("H07", "L10", "auto", 10, 24), ("H08", "L11", "manual", 15, 48),
    ("H09", "L13", "auto", 20, 48), ("H10", "L15", "manual", 30, 72), ("H11", "L16", "auto", 15, 24), ("H12", "L17", "manual", 25, 48),
]
ENROL = [
    ("U20", "C1", "U01"), ("U21", "C1", "U01"), ("U22", "C1", "U01"), ("U23", "C1", "U01"), ("U24", "C2", "U01"), ("U25", "C2", "U01"),
    ("U20", "C3", "U01"), ("U21", "C3", "U01"), ("U26", "C4", "U02"), ("U26", "C5", "U02"), ("U27", "C4", "U02"), ("U28", "C6", "U02"),
    ("U29", "C5", "U02"), ("U30", "C6", "U02"), ("U30", "C2", "U02"), ("U31", "C4", "U02"),
]
TODAY = AS_OF.date()
# student, course, amount, kind, period start, admin
PAY = [
    ("U20", "C1", 24900, "yearly", date(2024, 3, 20), "U01"), ("U21", "C1", 2900, "monthly", date(2024, 4, 20), "U01"),
    ("U22", "C1", 2900, "monthly", TODAY, "U01"), ("U23", "C1", 24900, "yearly", date(2024, 2, 20), "U01"),
    ("U24", "C2", 21900, "yearly", date(2024, 4, 20), "U01"), ("U25", "C2", 2500, "monthly", date(2024, 3, 20), "U01"),
    ("U20", "C3", 16900, "yearly", date(2024, 4, 20), "U01"), ("U26", "C4", 23900, "yearly", date(2024, 1, 20), "U02"),
    ("U26", "C5", 2000, "monthly", date(2024, 5, 10), "U02"), ("U27", "C4", 2800, "monthly", date(2024, 5, 15), "U02"),
    ("U28", "C6", 29900, "yearly", date(2023, 11, 20), "U02"), ("U29", "C5", 17900, "yearly", date(2024, 4, 20), "U02"),
    ("U30", "C6", 3500, "monthly", TODAY, "U02"), ("U31", "C4", 2800, "monthly", date(2024, 5, 5), "U02"),
]
# student, lesson, completed, days ago
PROGRESS = [
    ("U20", "L01", True, 5), ("U20", "L03", True, 3), ("U20", "L04", True, 2), ("U20", "L08", True, 1), ("U21", "L01", True, 10),
    ("U21", "L03", False, 7), ("U22", "L01", False, 1), ("U23", "L01", True, 20), ("U23", "L03", True, 18), ("U23", "L04", True, 15),
    ("U24", "L06", True, 4), ("U24", "L07", False, 1), ("U25", "L06", False, 20), ("U26", "L10", True, 8), ("U26", "L12", False, 2),
    ("U26", "L13", True, 5), ("U27", "L10", True, 1), ("U28", "L16", True, 10), ("U29", "L13", True, 6), ("U29", "L14", True, 3),
    ("U30", "L16", False, 1), ("U31", "L10", True, 4),
]
# homework, student, status, score, checked by, checked days ago
HANDED = [
    ("H01", "U20", "submitted", None, None, None), ("H04", "U20", "submitted", None, None, None),
    ("H06", "U20", "submitted", None, None, None), ("H01", "U21", "submitted", None, None, None),
    ("H02", "U21", "submitted", None, None, None), ("H02", "U23", "checked", 18, "U10", 14), ("H03", "U23", "checked", 13, "U10", 12),
    ("H05", "U24", "submitted", None, None, None), ("H07", "U26", "submitted", None, None, None),
    ("H09", "U26", "submitted", None, None, None), ("H07", "U27", "submitted", None, None, None),
    ("H11", "U28", "submitted", None, None, None), ("H09", "U29", "submitted", None, None, None),
    ("H10", "U29", "submitted", None, None, None), ("H12", "U28", "checked", 23, "U14", 2),
]
LOGINS = ["U20", "U21", "U22", "U23", "U24", "U26", "U27", "U28", "U29", "U30", "U31"]


def rows(spark) -> dict:
    """The seed as rows and commands of each table."""
    ago = lambda days: None if days is None else AS_OF - timedelta(days=days)
    return {
        "users": typed(
            spark, "users",
            [(i, f"{i}@school.ru", role, first, last, middle, f"+7-900-{i}", True, START, START) for i, role, first, last, middle in PEOPLE],
            ["id", "email", "role", "first_name", "last_name", "middle_name", "phone", "is_active", "created_at", "updated_at"],
        ),
        "topics": typed(spark, "topics", [(i, n, START) for i, n in TOPICS], ["id", "name", "created_at"]),
        "courses": typed(
            spark, "courses",
            [(i, p, title, subject, Decimal(m), Decimal(y), True, START, START) for i, p, title, subject, m, y in COURSES],
            ["id", "topic_id", "title", "subject", "price_monthly", "price_yearly", "is_active", "created_at", "updated_at"],
        ),
        "course_teachers": typed(spark, "course_teachers", [(c, u, START) for c, u in TEACHING]),
        "modules": typed(
            spark, "modules", [(i, c, f"Module {i}", n, START) for i, c, n in MODULES], ["id", "course_id", "title", "order_index", "created_at"]
        ),
        "lessons": typed(
            spark, "lessons",
            [
                (i, m, f"Lesson {i}", "video" if d is None else "webinar", n, f"v/{i}" if d is None else None,
                 None if d is None else f"w/{i}", None if d is None else AS_OF + timedelta(days=d), minutes, True, START)
                for i, m, n, minutes, d in LESSONS
            ],
            ["id", "module_id", "title", "lesson_type", "order_index", "video_url", "webinar_url", "webinar_scheduled_at",
             "duration_minutes", "is_published", "created_at"],
        ),
        "homeworks": typed(
            spark, "homeworks", [(i, lesson, f"Homework {i}", kind, top, hours, START) for i, lesson, kind, top, hours in HOMEWORKS],
            ["id", "lesson_id", "title", "check_type", "max_score", "deadline_hours", "created_at"],
        ),
        "activity_log": typed(
            spark, "activity_log", [(f"login-{u}", u, "login", AS_OF) for u in LOGINS], ["id", "user_id", "action", "created_at"]
        ),
        "enrollments": spark.createDataFrame(
            [(f"E{n:02d}", AS_OF, u, c, a) for n, (u, c, a) in enumerate(ENROL)],
            "cmd_id string, cmd_ts timestamp, student_id string, course_id string, admin_id string",
        ),
        "payments": spark.createDataFrame(
            [(f"P{n:02d}", AS_OF, u, c, a, Decimal(amount), kind, start, None) for n, (u, c, amount, kind, start, a) in enumerate(PAY)],
            "cmd_id string, cmd_ts timestamp, student_id string, course_id string, admin_id string, amount decimal(10,2), "
            "subscription_type string, period_start date, notes string",
        ),
        "lesson_progress": typed(
            spark, "lesson_progress", [(f"{u}-{i}", u, i, done, ago(d)) for u, i, done, d in PROGRESS],
            ["id", "student_id", "lesson_id", "is_completed", "last_viewed_at"],
        ),
        "homework_submissions": typed(
            spark, "homework_submissions",
            [(f"{h}-{u}", h, u, "answer", score, status, by, ago(d), AS_OF) for h, u, status, score, by, d in HANDED],
            ["id", "homework_id", "student_id", "answer_text", "score", "status", "checked_by", "checked_at", "submitted_at"],
        ),
    }


def empty(spark) -> Tables:
    return Tables(spark, {name: typed(spark, name, []) for name in TABLES}, AS_OF)


def load(spark) -> Tables:
    tables, rejects = jobs.load_rows(empty(spark), rows(spark))
    assert rejects.isEmpty()
    # One written version: later plans start from plain scans.
    frames = {name: tables.cut(f"seed_{name}", tables.frames[name]) for name in TABLES}
    return Tables(spark, frames, AS_OF)



