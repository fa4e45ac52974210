"""Finance reports.  Windows run only after aggregation to months or courses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from learnmart.functions.exprs import day, full_name, money_mean, money_pct1
from learnmart.functions.prefix import ranked_totals
from learnmart.model import Tables
from learnmart.operators.marts import money_or_zero, side_by_side

# Report labels and class limits (percent of revenue).
CLASS_A, CLASS_B, CLASS_C = "A — приоритет", "B — важные", "C — прочие"
LIMIT_A, LIMIT_B = 80, 95
EXPIRED, URGENT, THIS_MONTH = "🔴 Истёк", "🟠 Срочно (< 7 дней)", "🟡 В этом месяце"
URGENT_DAYS, HORIZON_DAYS = 7, 30


def by_month(t: Tables) -> DataFrame:
    """One row per month with payments."""
    amount, kind = F.col("amount"), F.col("subscription_type")
    return (
        t.payments.groupBy(F.trunc("payment_date", "month").alias("month"))
        .agg(
            money_or_zero(F.sum(amount)).alias("revenue"),
            money_or_zero(F.sum(F.when(kind == "monthly", amount))).alias("rev_monthly_sub"),
            money_or_zero(F.sum(F.when(kind == "yearly", amount))).alias("rev_yearly_sub"),
            F.countDistinct("student_id").alias("paying_students"),
            F.count("*").alias("payments_count"),
        )
        .withColumn("month_label", F.date_format("month", "yyyy-MM"))
    )


def monthly_dynamics(t: Tables) -> DataFrame:
    ordered = Window.orderBy("month")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    growth = F.col("revenue") - F.col("previous")
    return (
        by_month(t)
        .withColumn("previous", F.lag("revenue").over(ordered))
        .withColumn("running_total", F.sum("revenue").over(so_far))
        .select(
            "month_label",
            "revenue",
            "rev_monthly_sub",
            "rev_yearly_sub",
            "paying_students",
            "payments_count",
            money_or_zero(growth).alias("growth"),
            F.coalesce(money_pct1(growth, F.col("previous")), F.lit(0).cast("decimal(18,1)")).alias("growth_pct"),
            "running_total",
        )
        .orderBy("month_label")
    )


def abc(t: Tables) -> DataFrame:
    """Paid courses by revenue, with cumulative share and class."""
    per_course = (
        t.payments.groupBy("course_id")
        .agg(
            F.sum("amount").alias("revenue"),
            F.countDistinct("student_id").alias("paying_students"),
            F.count("*").alias("payments_count"),
        )
        .join(t.course_totals, "course_id")
    )
    running, total = F.col("running"), F.col("total")
    return (
        ranked_totals(t, per_course, "revenue", "course_id")
        .withColumnRenamed("rank", "revenue_rank")
        .select(
            "revenue_rank",
            "topic_name",
            "course_id",
            "course_title",
            "revenue",
            "paying_students",
            "payments_count",
            money_pct1(F.col("revenue"), total).alias("share_pct"),
            money_pct1(running, total).alias("cumulative_pct"),
            F.when(running * 100 <= total * LIMIT_A, CLASS_A)
            .when(running * 100 <= total * LIMIT_B, CLASS_B)
            .otherwise(CLASS_C)
            .alias("abc_class"),
        )
        .orderBy("revenue_rank", "course_id")
    )


def latest_payments(t: Tables) -> DataFrame:
    """The payment with the latest period end per (student, course); ties go to the smaller id.

    A first-row filter is also applied before the exchange, per input task, so
    a repeated pair does not travel as a whole.
    """
    newest = Window.partitionBy("student_id", "course_id").orderBy(F.desc("period_end"), "id")
    return (
        t.payments.select("student_id", "course_id", "id", "amount", "subscription_type", "period_end")
        .withColumn("position", F.row_number().over(newest))
        .filter("position = 1")
        .drop("position")
    )


def expiring_subscriptions(t: Tables) -> DataFrame:
    """Latest subscriptions of active enrolments ending within the horizon, expired ones included."""
    end = F.col("period_end")
    enrolled = t.enrollments.filter("is_active").select("student_id", "course_id")
    status = (
        F.when(end < t.today, EXPIRED).when(end < F.date_add(t.today, URGENT_DAYS), URGENT).otherwise(THIS_MONTH)
    )
    return (
        latest_payments(t)
        .filter(end < F.date_add(t.today, HORIZON_DAYS))
        .join(enrolled, ["student_id", "course_id"], "left_semi")
        .join(t.users.select(F.col("id").alias("student_id"), full_name().alias("full_name"), "email", "phone"), "student_id")
        .join(
            t.catalogue_dim(t.course_totals.select("course_id", "course_title")),
            "course_id",
        )
        .orderBy("period_end", "student_id", "course_id")
        .select(
            "student_id",
            "full_name",
            "email",
            "phone",
            "course_title",
            "subscription_type",
            "amount",
            day(end).alias("expires"),
            F.datediff(end, t.today).alias("days_left"),
            status.alias("status"),
        )
    )


def totals(t: Tables) -> DataFrame:
    """One row of payment totals.

    Payments are reduced to one row per student first, so counting students
    needs no second copy of the rows; paid courses come from a one-column scan.
    """
    amount, kind = F.col("amount"), F.col("subscription_type")
    per_student = t.payments.groupBy("student_id").agg(
        F.count("*").alias("n"),
        F.sum(amount).alias("total"),
        F.max(amount).alias("hi"),
        F.min(amount).alias("lo"),
        F.count(F.when(kind == "yearly", 1)).alias("y"),
        F.count(F.when(kind == "monthly", 1)).alias("m"),
    )
    row = per_student.agg(
        F.count("*").alias("paying_students"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("payments_count"),
        F.sum("total").alias("total_revenue"),
        F.max("hi").alias("max_payment"),
        F.min("lo").alias("min_payment"),
        F.coalesce(F.sum("y"), F.lit(0)).alias("yearly_count"),
        F.coalesce(F.sum("m"), F.lit(0)).alias("monthly_count"),
    )
    courses = t.payments.select("course_id").distinct().agg(F.count("*").alias("paid_courses"))
    return side_by_side(row, courses).select(
        "paying_students",
        "paid_courses",
        "payments_count",
        F.col("total_revenue").cast("decimal(28,2)").alias("total_revenue"),
        money_mean(F.col("total_revenue"), F.col("payments_count")).alias("mean_payment"),
        "max_payment",
        "min_payment",
        "yearly_count",
        "monthly_count",
    )
