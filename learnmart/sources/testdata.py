"""The platform tables expressed over the star-schema test tables.

Every relation is a lazy plan on the parquet files, so its size follows the
files: ten parts make a course, and people belong to a few neighbouring courses,
so students and teachers of a course stay few while their number grows.  Only
the announced courses (one per nation, without lessons or teachers) gather ever
more students.  Ids of catalogue items stay integers here.
"""

from __future__ import annotations

from datetime import datetime
from functools import cache, cached_property
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from learnmart.functions.exprs import period_end
from learnmart.model import Tables
from learnmart.session import configure

AS_OF = datetime(2024, 1, 31)
ORDER_SHIFT_DAYS = 8200
SHIP_SHIFT_DAYS = 8100
EPOCH = "2018-01-01 00:00:00"

# Columns read from each file (declared, so that nothing is inferred).
FILES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_size int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_returnflag string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, props string",
}


def _s(prefix: str, col: str):
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


def div(col: str, by: int) -> Column:
    return F.floor(F.col(col) / by).cast("long")


def _since_epoch(key: str):
    return F.lit(EPOCH).cast("timestamp") + F.make_dt_interval((F.col(key) % 2000).cast("int"))


def _shift(col: str, days: int):
    return F.col(col).cast("timestamp") + F.make_dt_interval(F.lit(days))


PARTS = 10  # lessons of a course
BLOCK = 8  # neighbouring customers with the same courses
ANNOUNCED = 25
UNKNOWN = -1  # an id nothing has
ID_BASE = 100_000_000  # keys of customers and catalogue items are smaller


class Raw:
    """The parquet files with declared schemas."""

    @cached_property
    def course_count(self) -> int:
        """Courses made of parts; one small job, the largest key comes from the file's statistics."""
        return (self.part.agg(F.max("p_partkey")).first()[0] or 0) // PARTS + 1

    def course_near(self, key: str, step) -> Column:
        """One of the courses of a customer's block."""
        return (div(key, BLOCK) + step) % self.course_count

    def ordered_course(self) -> Column:
        """The course an order is for: five of the block's courses or an announced one."""
        kind = F.col("o_orderkey") % 6
        announced = self.course_count + div("o_custkey", BLOCK) % ANNOUNCED
        return F.when(kind < 5, self.course_near("o_custkey", kind)).otherwise(announced)

    def line_homework(self) -> Column:
        """The homework a line item is handed in for, in a course of its customer's block."""
        return self.course_near("o_custkey", F.col("l_partkey") % 5) * PARTS + 2 * (div("l_partkey", 5) % 5)

    def event_lesson(self) -> Column:
        """The lesson an event is about."""
        return self.course_near("user_id", F.col("event_id") % 5) * PARTS + div("event_id", 5) % PARTS

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.sf_dir = sf_dir
        self._frames = {
            name: spark.read.schema(ddl).parquet(f"{sf_dir}/{name}.parquet") for name, ddl in FILES.items()
        }

    def __getattr__(self, name: str) -> DataFrame:
        frames = self.__dict__.get("_frames", {})
        if name in frames:
            return frames[name]
        raise AttributeError(name)


def _users(raw: Raw) -> DataFrame:
    students = raw.customer.select(
        _s("S", "c_custkey").alias("id"),
        F.concat(F.lower("c_name"), F.lit("@x")).alias("email"),
        F.lit("student").alias("role"),
        F.col("c_name").alias("first_name"),
        F.col("c_mktsegment").alias("last_name"),
        F.when(F.col("c_nationkey") % 3 == 0, _s("M", "c_nationkey")).alias("middle_name"),
        F.when(F.col("c_custkey") % 4 != 0, _s("P", "c_custkey")).alias("phone"),
        (F.col("c_acctbal") >= 0).alias("is_active"),
        _since_epoch("c_custkey").alias("created_at"),
    )
    teachers = raw.supplier.select(
        _s("T", "s_suppkey"),
        F.concat(F.lower("s_name"), F.lit("@x")),
        F.lit("teacher"),
        F.col("s_name"),
        F.concat(F.lit("SUPP"), (F.col("s_suppkey") % 7).cast("string")),
        F.lit(None).cast("string"),
        _s("P", "s_suppkey"),
        F.col("s_acctbal") >= 0,
        _since_epoch("s_suppkey"),
    )
    admins = raw.region.select(
        _s("A", "r_regionkey"),
        F.concat(F.lower("r_name"), F.lit("@x")),
        F.lit("admin"),
        F.col("r_name"),
        F.lit("ADMIN"),
        F.lit(None).cast("string"),
        _s("P", "r_regionkey"),
        F.col("r_regionkey") != 4,
        _since_epoch("r_regionkey"),
    )
    return students.union(teachers).union(admins).withColumn("updated_at", F.col("created_at"))


def _catalogue(raw: Raw) -> dict[str, DataFrame]:
    start = F.lit(EPOCH).cast("timestamp")
    part, key = F.col("p_partkey"), F.col("id")
    made = raw.part.filter(part % PARTS == 0).select(
        div("p_partkey", PARTS).alias("id"), F.concat(F.lit("C"), div("p_partkey", PARTS).cast("string")).alias("title"))
    announced = raw.nation.select((F.lit(raw.course_count) + F.col("n_nationkey")).cast("long"), F.col("n_name"))
    ids = made.union(announced)
    courses = ids.select(
        "id",
        (key % 5).cast("int").alias("topic_id"),
        "title",
        F.concat(F.lit("SUBJ_"), (key % 6).cast("string")).alias("subject"),
        (1900 + 100 * (key % 25)).cast("decimal(10,2)").alias("price_monthly"),
        (16900 + 1000 * (key % 25)).cast("decimal(10,2)").alias("price_yearly"),
        (key % 6 != 5).alias("is_active"),
        start.alias("created_at"),
        start.alias("updated_at"),
    )
    modules = ids.select("id", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("i")).select(
        (key * 10 + F.col("i")).alias("id"),
        key.alias("course_id"),
        F.concat(F.lit("M"), (key * 10 + F.col("i")).cast("string")).alias("title"),
        F.col("i").cast("short").alias("order_index"),
        start.alias("created_at"),
    )
    place = part % PARTS
    webinar = place % 3 == 1
    lessons = raw.part.select(
        part.alias("id"),
        (div("p_partkey", PARTS) * 10 + 1 + place % 3).alias("module_id"),
        F.col("p_name").alias("title"),
        F.when(webinar, "webinar").otherwise("video").alias("lesson_type"),
        (1 + F.floor(place / 3)).cast("short").alias("order_index"),
        F.when(~webinar, _s("u", "p_partkey")).alias("video_url"),
        F.when(webinar, _s("u", "p_partkey")).alias("webinar_url"),
        F.when(
            webinar,
            F.lit(str(AS_OF)).cast("timestamp") + F.make_dt_interval((part % 60 - 15).cast("int")),
        ).alias("webinar_scheduled_at"),
        F.col("p_size").cast("short").alias("duration_minutes"),
        (F.col("p_size") > 5).alias("is_published"),
        start.alias("created_at"),
    )
    homeworks = raw.part.filter(part % 2 == 0).select(
        part.alias("id"),
        part.alias("lesson_id"),
        _s("HW ", "p_partkey").alias("title"),
        F.when(part % 4 == 0, "auto").otherwise("manual").alias("check_type"),
        (10 + F.col("p_size")).cast("short").alias("max_score"),
        F.when(place < 6, (24 * (1 + place)).cast("short")).alias("deadline_hours"),
        start.alias("created_at"),
    )
    return {
        "topics": raw.region.select(
            F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), start.alias("created_at")
        ),
        "courses": courses,
        "modules": modules,
        "lessons": lessons,
        "homeworks": homeworks,
    }


def _course_teachers(raw: Raw) -> DataFrame:
    """Two neighbouring suppliers share a course, and each has another."""
    first = 4 * div("s_suppkey", 2)
    return raw.supplier.select(
        F.explode(F.array(first % raw.course_count, (first + 1 + F.col("s_suppkey") % 3) % raw.course_count)).alias("course_id"),
        _s("T", "s_suppkey").alias("teacher_id"),
        F.lit(EPOCH).cast("timestamp").alias("assigned_at"),
    )


def enrolment_rows(raw: Raw) -> DataFrame:
    """One row per order, before they are merged into enrolments."""
    return raw.orders.select("o_custkey", raw.ordered_course().alias("course_id"), "o_orderdate", "o_orderstatus")


def merge_enrolments(rows: DataFrame, active) -> DataFrame:
    return (
        rows.groupBy("o_custkey", "course_id")
        .agg(F.min("o_orderdate").alias("first"), F.bool_or(active).alias("is_active"))
        .select(
            (F.col("o_custkey") * ID_BASE + F.col("course_id")).alias("id"),
            _s("S", "o_custkey").alias("student_id"),
            "course_id",
            _shift("first", ORDER_SHIFT_DAYS).alias("enrolled_at"),
            "is_active",
        )
    )


def _payments(raw: Raw) -> DataFrame:
    paid = _shift("o_orderdate", ORDER_SHIFT_DAYS)
    return raw.orders.select(
        F.col("o_orderkey").alias("id"),
        _s("S", "o_custkey").alias("student_id"),
        raw.ordered_course().alias("course_id"),
        F.col("o_totalprice").cast("decimal(10,2)").alias("amount"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "yearly").otherwise("monthly").alias(
            "subscription_type"
        ),
        paid.cast("date").alias("payment_date"),
        paid.cast("date").alias("period_start"),
        paid.alias("created_at"),
        F.lit(None).cast("string").alias("notes"),
        F.lit("A0").alias("created_by"),
    ).withColumn("period_end", period_end(F.col("period_start"), F.col("subscription_type")))


def handed_in(raw: Raw, lines: DataFrame | None = None) -> DataFrame:
    """Line items with their customer and the homework they are handed in for."""
    orders = raw.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    lines = raw.lineitem if lines is None else lines
    return lines.join(orders, "l_orderkey").withColumn("homework_id", raw.line_homework())


def submission_rows(raw: Raw, homeworks: DataFrame) -> DataFrame:
    """One row per line item with its homework: repeated hand-ins included, score not capped."""
    return handed_in(raw).join(homeworks.select(F.col("id").alias("homework_id"), "check_type", "max_score"), "homework_id")


def _rules(homeworks: DataFrame) -> DataFrame:
    """What hand-ins take from their homework, one row each."""
    return homeworks.select(F.col("id").alias("homework_id"), "check_type", "max_score").dropDuplicates(["homework_id"])


def _submissions(raw: Raw, homeworks: DataFrame) -> DataFrame:
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    earliest = Window.partitionBy("homework_id", "o_custkey").orderBy(*order)
    first = handed_in(raw).withColumn("n", F.row_number().over(earliest)).filter("n = 1")
    # a pair is of one homework, so what the homework adds is joined to the rows that are left
    first = first.join(homeworks, "homework_id")
    auto = F.col("check_type") == "auto"
    graded = F.col("l_returnflag") != "N"
    submitted = _shift("l_shipdate", SHIP_SHIFT_DAYS)
    return first.select(
        (F.col("homework_id") * ID_BASE + F.col("o_custkey")).alias("id"),
        "homework_id",
        _s("S", "o_custkey").alias("student_id"),
        _s("a", "l_orderkey").alias("answer_text"),
        F.lit(None).cast("string").alias("answer_url"),
        F.when(auto, F.col("max_score"))
        .when(graded & (F.col("l_linenumber") % 3 != 0), F.least(F.col("l_quantity").cast("int"), F.col("max_score").cast("int")))
        .cast("short")
        .alias("score"),
        F.when(auto, "auto_checked").when(graded, "checked").otherwise("submitted").alias("status"),
        F.when(~auto & graded, _s("T", "l_suppkey")).alias("checked_by"),
        F.when(auto | graded, submitted + F.make_dt_interval(F.lit(1))).alias("checked_at"),
        submitted.alias("submitted_at"),
    )


def progress_rows(raw: Raw) -> DataFrame:
    """One row per event with its lesson, before they are merged into progress."""
    return raw.events.select("user_id", "ts", "event_type", raw.event_lesson().alias("lesson_id"))


def merge_progress(rows: DataFrame) -> DataFrame:
    done = F.col("event_type").isin("purchase", "signup")
    return (
        rows.groupBy("user_id", "lesson_id")
        .agg(
            F.bool_or(done).alias("is_completed"),
            F.max("ts").alias("last"),
            F.min(F.when(done, F.col("ts"))).alias("first_done"),
        )
        .select(
            (F.col("user_id") * ID_BASE + F.col("lesson_id")).alias("id"),
            _s("S", "user_id").alias("student_id"),
            "lesson_id",
            "is_completed",
            F.col("first_done").cast("timestamp").alias("completed_at"),
            F.col("last").cast("timestamp").alias("last_viewed_at"),
        )
    )


def _activity(raw: Raw) -> DataFrame:
    # Event types as platform actions.
    action = (
        F.when(F.col("event_type") == "view", "view_lesson")
        .when(F.col("event_type") == "purchase", "complete_lesson")
        .when(F.col("event_type") == "click", "submit_hw")
        .when(F.col("event_type") == "signup", "login")
        .when(F.col("event_type") == "error", "enroll")
    )
    return raw.events.select(
        F.col("event_id").alias("id"),
        _s("S", "user_id").alias("user_id"),
        action.alias("action"),
        F.lit("lesson").alias("entity_type"),
        raw.event_lesson().cast("string").alias("entity_id"),
        F.col("props").alias("metadata"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def build(spark: SparkSession, sf_dir: str) -> Tables:
    configure(spark)
    raw = Raw(spark, sf_dir)
    frames = _catalogue(raw)
    frames["users"] = _users(raw)
    frames["course_teachers"] = _course_teachers(raw)
    frames["payments"] = _payments(raw)
    frames["activity_log"] = _activity(raw)
    # Relations that take a join or an aggregation are written once, when first used.
    derived = {
        "enrollments": lambda: merge_enrolments(enrolment_rows(raw), F.col("o_orderstatus") != "F"),
        "homework_submissions": lambda: _submissions(raw, tables.measured(_rules(frames["homeworks"]))),
        "lesson_progress": lambda: merge_progress(progress_rows(raw)),
    }
    for name, build_frame in derived.items():
        frames[name] = cache(lambda name=name, build_frame=build_frame: tables.cut(name, build_frame()))
    tables = Tables(spark, frames, AS_OF)
    tables.raw = raw
    tables.empty = lambda name: (derived[name]() if name in derived else frames[name]).limit(0)
    return tables


_cache: WeakKeyDictionary[SparkSession, dict[str, Tables]] = WeakKeyDictionary()


def load(spark: SparkSession, sf_dir: str) -> Tables:
    """Tables over ``sf_dir``; plans and measured sizes are reused within a session."""
    configure(spark)
    per_session = _cache.setdefault(spark, {})
    if sf_dir not in per_session:
        per_session[sf_dir] = build(spark, sf_dir)
    return per_session[sf_dir]
