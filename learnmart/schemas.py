"""Typed tables and their declared rules.

Everything a table promises (columns, keys, references, row checks, value
domains) is data here; ``operators.quality`` turns it into violation reports
and ``sources.tables`` into read schemas.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Enum members in declaration order (the order is also the sort order).
ENUMS = {
    "user_role": ("admin", "teacher", "student"),
    "lesson_type": ("webinar", "video"),
    "check_type": ("manual", "auto"),
    "submission_status": ("submitted", "checked", "auto_checked"),
    "subscription_type": ("monthly", "yearly"),
}

# Statuses that carry a grade, marts that go stale on enrolment changes.
GRADED = ("checked", "auto_checked")
MARTS = ("mv_admin_dashboard", "mv_student_scores", "mv_course_completion", "mv_teacher_workload")


class Action:
    """Actions of activity-log rows."""

    ENROLL = "enroll"
    UNENROLL = "unenroll"
    ADMIN_ENROLL = "admin_enroll"
    RECORD_PAYMENT = "record_payment"
    CHECK_HOMEWORK = "check_homework"
    DEACTIVATE_STUDENT = "deactivate_student"
    VIEW_LESSON = "view_lesson"
    COMPLETE_LESSON = "complete_lesson"


# Entity types of log rows are course, enrollment, lesson, payment, submission and user; the keys of their
# metadata are the names given where a row is made.
TYPES = {
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "short": T.ShortType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "decimal(10,2)": T.DecimalType(10, 2),
}


@dataclass(frozen=True)
class Reference:
    column: str
    parent: str
    on_delete: str  # cascade | restrict | no_action


@dataclass(frozen=True)
class Table:
    name: str
    columns: str
    keys: tuple[tuple[str, ...], ...]
    references: tuple[Reference, ...] = ()
    checks: dict[str, str] = field(default_factory=dict)
    enums: dict[str, str] = field(default_factory=dict)
    max_length: dict[str, int] = field(default_factory=dict)

    @property
    def schema(self) -> T.StructType:
        fields = []
        for item in self.columns.split(", "):
            name, kind, *rest = item.split()
            fields.append(T.StructField(name, TYPES[kind], nullable=not rest))
        return T.StructType(fields)

    @property
    def required(self) -> tuple[str, ...]:
        return tuple(item.split()[0] for item in self.columns.split(", ") if item.split()[-1] == "required")

    @property
    def names(self) -> list[str]:
        return [item.split()[0] for item in self.columns.split(", ")]


def _refs(*items: tuple[str, str, str]) -> tuple[Reference, ...]:
    return tuple(Reference(*item) for item in items)


_ALL = [
    Table(
        "users",
        "id string required, email string required, role string required, first_name string required, "
        "last_name string required, middle_name string, phone string, avatar_url string, "
        "is_active boolean required, created_at timestamp required, updated_at timestamp required",
        keys=(("id",), ("email",)),
        enums={"role": "user_role"},
        max_length={"email": 255, "first_name": 100, "last_name": 100, "middle_name": 100, "phone": 20},
    ),
    Table(
        "topics",
        "id string required, name string required, description string, created_at timestamp required",
        keys=(("id",), ("name",)),
        max_length={"name": 100},
    ),
    Table(
        "courses",
        "id string required, topic_id string required, title string required, subject string required, "
        "description string, price_monthly decimal(10,2), price_yearly decimal(10,2), "
        "is_active boolean required, created_at timestamp required, updated_at timestamp required",
        keys=(("id",),),
        references=_refs(("topic_id", "topics", "restrict")),
        checks={"price_monthly_not_negative": "price_monthly >= 0", "price_yearly_not_negative": "price_yearly >= 0"},
        max_length={"title": 255, "subject": 100},
    ),
    Table(
        "course_teachers",
        "course_id string required, teacher_id string required, assigned_at timestamp required",
        keys=(("course_id", "teacher_id"),),
        references=_refs(("course_id", "courses", "cascade"), ("teacher_id", "users", "cascade")),
    ),
    Table(
        "modules",
        "id string required, course_id string required, title string required, order_index short required, "
        "description string, created_at timestamp required",
        keys=(("id",), ("course_id", "order_index")),
        references=_refs(("course_id", "courses", "cascade")),
        checks={"order_positive": "order_index > 0"},
        max_length={"title": 255},
    ),
    Table(
        "lessons",
        "id string required, module_id string required, title string required, lesson_type string required, "
        "order_index short required, description string, video_url string, webinar_url string, "
        "webinar_scheduled_at timestamp, duration_minutes short, is_published boolean required, "
        "created_at timestamp required",
        keys=(("id",), ("module_id", "order_index")),
        references=_refs(("module_id", "modules", "cascade")),
        checks={
            "order_positive": "order_index > 0",
            "duration_positive": "duration_minutes > 0",
            "webinar_fields": "lesson_type <> 'webinar' or (webinar_url is not null and webinar_scheduled_at is not null)",
            "video_fields": "lesson_type <> 'video' or video_url is not null",
        },
        enums={"lesson_type": "lesson_type"},
        max_length={"title": 255},
    ),
    Table(
        "homeworks",
        "id string required, lesson_id string required, title string required, description string, "
        "check_type string required, max_score short required, deadline_hours short, created_at timestamp required",
        keys=(("id",),),
        references=_refs(("lesson_id", "lessons", "cascade")),
        checks={"max_score_positive": "max_score > 0", "deadline_positive": "deadline_hours > 0"},
        enums={"check_type": "check_type"},
        max_length={"title": 255},
    ),
    Table(
        "homework_submissions",
        "id string required, homework_id string required, student_id string required, answer_text string, "
        "answer_url string, score short, status string required, checked_by string, checked_at timestamp, "
        "submitted_at timestamp required",
        keys=(("id",), ("homework_id", "student_id")),
        references=_refs(
            ("homework_id", "homeworks", "cascade"),
            ("student_id", "users", "cascade"),
            ("checked_by", "users", "no_action"),
        ),
        checks={
            "score_not_negative": "score >= 0",
            "answer_provided": "answer_text is not null or answer_url is not null",
        },
        enums={"status": "submission_status"},
    ),
    Table(
        "enrollments",
        "id string required, student_id string required, course_id string required, "
        "enrolled_at timestamp required, is_active boolean required",
        keys=(("id",), ("student_id", "course_id")),
        references=_refs(("student_id", "users", "cascade"), ("course_id", "courses", "restrict")),
    ),
    Table(
        "lesson_progress",
        "id string required, student_id string required, lesson_id string required, is_completed boolean required, "
        "completed_at timestamp, last_viewed_at timestamp required",
        keys=(("id",), ("student_id", "lesson_id")),
        references=_refs(("student_id", "users", "cascade"), ("lesson_id", "lessons", "cascade")),
    ),
    Table(
        "activity_log",
        "id string required, user_id string required, action string required, entity_type string, entity_id string, "
        "metadata string, created_at timestamp required",
        keys=(("id",),),
        references=_refs(("user_id", "users", "cascade")),
        max_length={"action": 100, "entity_type": 50},
    ),
    Table(
        "payments",
        "id string required, student_id string required, course_id string required, amount decimal(10,2) required, "
        "subscription_type string required, payment_date date required, period_start date required, "
        "period_end date required, notes string, created_by string required, created_at timestamp required",
        keys=(("id",),),
        references=_refs(
            ("student_id", "users", "restrict"), ("course_id", "courses", "restrict"), ("created_by", "users", "no_action")
        ),
        checks={"amount_positive": "amount > 0", "period_order": "period_end > period_start"},
        enums={"subscription_type": "subscription_type"},
    ),
    Table(
        "mv_refresh_queue",
        "id string required, view_name string required, triggered_at timestamp required, processed boolean required",
        keys=(("id",),),
    ),
]

TABLES: dict[str, Table] = {t.name: t for t in _ALL}

# Tables whose size follows the catalogue, not the number of people or events.
CATALOGUE = ("topics", "courses", "modules", "lessons", "homeworks")
