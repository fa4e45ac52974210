"""Change sets over the test tables: an earlier state, later rows, and command feeds.

The state before is what orders, events and line items up to a cut-off make;
whatever comes after arrives as commands or as new row versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learnmart.model import Tables
from learnmart.sources import testdata
from learnmart.sources.testdata import ID_BASE, ORDER_SHIFT_DAYS, SHIP_SHIFT_DAYS, UNKNOWN, _s, _shift

CUT = "2000-01-01 00:00:00"
EVENT_CUT = "2024-01-16 00:00:00"


def _ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def enrolments_before(t: Tables) -> DataFrame:
    rows = testdata.enrolment_rows(t.raw).filter(F.col("o_orderdate") < _ntz(CUT))
    return testdata.merge_enrolments(rows, F.col("o_orderstatus") != "F")


def enrolments_after(t: Tables) -> DataFrame:
    """A later version of the enrolments: only open orders keep a place active."""
    return testdata.merge_enrolments(testdata.enrolment_rows(t.raw), F.col("o_orderstatus") == "O")


def progress_before(t: Tables) -> DataFrame:
    return testdata.merge_progress(testdata.progress_rows(t.raw).filter(F.col("ts") < _ntz(EVENT_CUT)))


def submissions_before(t: Tables) -> DataFrame:
    return t.homework_submissions.filter(F.col("submitted_at") < _shift_text(CUT, SHIP_SHIFT_DAYS))


def _shift_text(text: str, days: int):
    return F.lit(text).cast("timestamp") + F.make_dt_interval(F.lit(days))


def before(t: Tables) -> Tables:
    """The earlier state; hand-ins are worked out only if something reads them."""
    out = t.replace(
        enrollments=enrolments_before(t), lesson_progress=progress_before(t), homework_submissions=lambda: submissions_before(t)
    )
    out.raw = t.raw
    return out


def _later_orders(t: Tables) -> DataFrame:
    return t.raw.orders.filter(F.col("o_orderdate") >= _ntz(CUT))


def _person():
    """Mostly students, some teachers and some unknown ids."""
    cust = F.col("o_custkey")
    return (
        F.when(cust % 40 == 0, F.concat(F.lit("T"), (cust % 10).cast("string")))
        .when(cust % 41 == 0, _s("X", "o_custkey"))
        .otherwise(_s("S", "o_custkey"))
    )


def _admin_by_priority():
    return F.concat(F.lit("A"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).cast("string"))


def _kind():
    return (
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "yearly")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "weekly")
        .otherwise("monthly")
    )


def _some_course(t: Tables):
    """The course of an order, sometimes an unknown one."""
    return F.when(F.col("o_orderkey") % 27 >= 25, UNKNOWN).otherwise(t.raw.ordered_course())


def _some_lesson(t: Tables):
    return F.when(F.col("event_id") % 21 == 20, UNKNOWN).otherwise(t.raw.event_lesson())


def enrol_commands(t: Tables) -> DataFrame:
    return _later_orders(t).select(
        _s("E", "o_orderkey").alias("cmd_id"),
        _shift("o_orderdate", ORDER_SHIFT_DAYS).alias("cmd_ts"),
        _person().alias("student_id"),
        _some_course(t).alias("course_id"),
        _admin_by_priority().alias("admin_id"),
    )


def payment_commands(t: Tables) -> DataFrame:
    ts = _shift("o_orderdate", ORDER_SHIFT_DAYS)
    return _later_orders(t).select(
        _s("P", "o_orderkey").alias("cmd_id"),
        ts.alias("cmd_ts"),
        _s("S", "o_custkey").alias("student_id"),
        t.raw.ordered_course().alias("course_id"),
        F.concat(F.lit("A"), (F.col("o_custkey") % 6).cast("string")).alias("admin_id"),
        (F.col("o_totalprice").cast("decimal(10,2)") - 20000).cast("decimal(10,2)").alias("amount"),
        _kind().alias("subscription_type"),
        F.when(F.col("o_orderkey") % 31 != 0, ts.cast("date")).alias("period_start"),
        F.col("o_orderstatus").alias("notes"),
    )


def unit_commands(t: Tables) -> DataFrame:
    """Enrol-and-pay commands: the enrolment fields with a payment."""
    ts = _shift("o_orderdate", ORDER_SHIFT_DAYS)
    return _later_orders(t).select(
        _s("U", "o_orderkey").alias("cmd_id"),
        ts.alias("cmd_ts"),
        _person().alias("student_id"),
        _some_course(t).alias("course_id"),
        _admin_by_priority().alias("admin_id"),
        (F.col("o_totalprice").cast("decimal(10,2)") - 20000).cast("decimal(10,2)").alias("amount"),
        _kind().alias("subscription_type"),
        ts.cast("date").alias("period_start"),
        F.col("o_orderstatus").alias("notes"),
    )


def group_commands(t: Tables) -> DataFrame:
    """Units of enrolments and payments: the later orders of two customers in one quarter.

    Every second order enrols, two in three pay, so that some payments lean on an enrolment of another unit.
    """
    ts = _shift("o_orderdate", ORDER_SHIFT_DAYS)
    quarter = F.date_format("o_orderdate", "yyyy-Q")
    order = F.col("o_orderkey")
    kinds = F.array_compact(F.array(F.when(order % 8 < 4, F.lit("enroll")), F.when(order % 3 < 2, F.lit("pay"))))
    return _later_orders(t).select(F.explode(kinds).alias("kind"), "*").select(
        F.concat(F.col("kind"), F.lit("-"), order.cast("string")).alias("cmd_id"),
        ts.alias("cmd_ts"),
        F.concat(testdata.div("o_custkey", 2).cast("string"), F.lit("-"), quarter).alias("unit_id"),
        "kind",
        _person().alias("student_id"),
        t.raw.course_near("o_custkey", order % 3).alias("course_id"),
        F.concat(F.lit("A"), (order % 17 % 5).cast("string")).alias("admin_id"),
        (F.col("o_totalprice").cast("decimal(10,2)") - 5000).cast("decimal(10,2)").alias("amount"),
        F.when(order % 2 == 0, "yearly").otherwise("monthly").alias("subscription_type"),
        ts.cast("date").alias("period_start"),
        F.col("o_orderstatus").alias("notes"),
    )


def _line_id(prefix: str):
    shipped = F.date_format("l_shipdate", "yyyyMMdd")
    return F.concat_ws("-", F.lit(prefix), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", shipped)


def grade_commands(t: Tables) -> DataFrame:
    line = F.col("l_linenumber")
    return (
        testdata.submission_rows(t.raw, t.homeworks)
        .filter("l_returnflag <> 'A'")
        .select(
            _line_id("G").alias("cmd_id"),
            _shift("l_shipdate", SHIP_SHIFT_DAYS).alias("cmd_ts"),
            (F.col("homework_id") * ID_BASE + F.col("o_custkey") + F.when(line == 7, ID_BASE // 2).otherwise(0)).alias(
                "submission_id"
            ),
            _s("T", "l_suppkey").alias("teacher_id"),
            F.when(line != 6, F.col("l_quantity").cast("short")).alias("score"),
            F.col("l_returnflag").alias("comment"),
        )
    )


def deactivation_commands(t: Tables) -> DataFrame:
    return _later_orders(t).filter("o_orderstatus = 'F'").select(
        _s("D", "o_orderkey").alias("cmd_id"),
        _shift("o_orderdate", ORDER_SHIFT_DAYS).alias("cmd_ts"),
        _person().alias("student_id"),
        _admin_by_priority().alias("admin_id"),
        F.col("o_orderpriority").alias("note"),
    )


def completion_commands(t: Tables) -> DataFrame:
    return t.raw.events.filter(
        F.col("event_type").isin("purchase", "signup") & (F.col("ts") >= _ntz(EVENT_CUT))
    ).select(
        _s("C", "event_id").alias("cmd_id"),
        F.col("ts").cast("timestamp").alias("cmd_ts"),
        _s("S", "user_id").alias("student_id"),
        _some_lesson(t).alias("lesson_id"),
    )


def submission_commands(t: Tables) -> DataFrame:
    lines = t.raw.lineitem.filter(F.col("l_shipdate") >= _ntz(CUT))
    return testdata.handed_in(t.raw, lines).select(
        _line_id("H").alias("cmd_id"),
        _shift("l_shipdate", SHIP_SHIFT_DAYS).alias("cmd_ts"),
        _s("S", "o_custkey").alias("student_id"),
        F.when(F.col("l_partkey") % 10 == 9, UNKNOWN).otherwise(F.col("homework_id")).alias("homework_id"),
        F.when(F.col("l_returnflag") == "R", "").otherwise(_s("a", "l_orderkey")).alias("answer_text"),
        F.when(F.col("l_linenumber") > 5, _s("http://x/", "l_orderkey")).otherwise("").alias("answer_url"),
    )


# -- rows as they arrive, before any rule has been applied ------------------------------


def raw_submissions(t: Tables) -> DataFrame:
    """Every hand-in with the score as written: repeated, uncapped, graded too early."""
    return testdata.submission_rows(t.raw, t.homeworks).select(
        _line_id("R").alias("id"),
        "homework_id",
        _s("S", "o_custkey").alias("student_id"),
        F.when(F.col("l_linenumber") != 3, _s("a", "l_orderkey")).alias("answer_text"),
        F.lit(None).cast("string").alias("answer_url"),
        F.when(F.col("l_linenumber") != 5, F.col("l_quantity").cast("short") - F.when(F.col("l_linenumber") == 1, 5).otherwise(0))
        .cast("short")
        .alias("score"),
        F.when(F.col("l_returnflag") == "N", "submitted").when(F.col("l_returnflag") == "R", "checked").otherwise("graded").alias(
            "status"
        ),
        F.when(F.col("l_partkey") % 7 == 0, _s("X", "l_partkey")).otherwise(_s("T", "l_suppkey")).alias("checked_by"),
        F.lit(None).cast("timestamp").alias("checked_at"),
        _shift("l_shipdate", SHIP_SHIFT_DAYS).alias("submitted_at"),
    )


def raw_progress(t: Tables) -> DataFrame:
    return t.raw.events.select(
        F.col("event_id").alias("id"),
        _s("S", "user_id").alias("student_id"),
        _some_lesson(t).alias("lesson_id"),
        F.when(F.col("event_type") != "error", F.col("event_type").isin("purchase", "signup")).alias("is_completed"),
        F.col("ts").cast("timestamp").alias("last_viewed_at"),
    )


def raw_payments(t: Tables) -> DataFrame:
    paid = _shift("o_orderdate", ORDER_SHIFT_DAYS).cast("date")
    return t.raw.orders.select(
        F.col("o_orderkey").alias("id"),
        _s("S", "o_custkey").alias("student_id"),
        _some_course(t).alias("course_id"),
        (F.col("o_totalprice").cast("decimal(10,2)") - 20000).cast("decimal(10,2)").alias("amount"),
        _kind().alias("subscription_type"),
        paid.alias("payment_date"),
        paid.alias("period_start"),
        F.date_add(paid, (F.col("o_orderkey") % 30).cast("int")).alias("period_end"),
        F.concat(F.lit("A"), (F.col("o_custkey") % 6).cast("string")).alias("created_by"),
    )


def raw_enrolments(t: Tables) -> DataFrame:
    return t.raw.orders.select(
        F.col("o_orderkey").alias("id"),
        _person().alias("student_id"),
        _some_course(t).alias("course_id"),
        _shift("o_orderdate", ORDER_SHIFT_DAYS).alias("enrolled_at"),
        (F.col("o_orderstatus") != "F").alias("is_active"),
    )


def raw_assignments(t: Tables) -> DataFrame:
    """Proposed course teachers: suppliers, customers, and suppliers named by parts (many unknown)."""
    first = 4 * testdata.div("s_suppkey", 2) % t.raw.course_count
    suppliers = t.raw.supplier.select(first.alias("course_id"), _s("T", "s_suppkey").alias("teacher_id"))
    customers = t.raw.customer.select(t.raw.course_near("c_custkey", 0), _s("S", "c_custkey"))
    parts = t.raw.part.select(testdata.div("p_partkey", testdata.PARTS), _s("T", "p_partkey"))
    return suppliers.union(customers).union(parts)


def arriving(t: Tables) -> Tables:
    """The tables with unchecked rows in place of the clean ones."""
    out = t.replace(
        homework_submissions=raw_submissions(t),
        lesson_progress=raw_progress(t),
        payments=raw_payments(t),
        enrollments=raw_enrolments(t),
    )
    out.raw = t.raw
    return out
