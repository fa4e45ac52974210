"""Units of several commands: all of a unit's commands take effect, or none.

A unit mixes enrolments and payments of any students and courses.  Units take
their turn by the time of their first command, then by id, and the commands of
a unit by time, then by id.  A payment needs an active place: one that stood
before the batch, one that an earlier unit opened, or one that its own unit
opened before it.  So a refused unit takes back the places it would have
opened: a later unit may open them in its stead, and units that paid for them
are refused in turn.

Refusals are worked out in rounds.  At first every unit whose commands have
nothing against them counts; each round refuses the units with a payment whose
place no earlier counting unit opens.  Payments lean on earlier units only, so
this ends in what handling unit after unit would give, after as many rounds as
the longest chain of refusals.  A round reads narrow written rows, and after
the first only places that the round before took back.

Commands: cmd_id, cmd_ts, unit_id, kind ('enroll' or 'pay'), student_id,
course_id, admin_id, amount, subscription_type, period_start, notes.  A command
without a unit_id is a unit of its own.  Command ids are unique.  An empty
batch gives no decisions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learnmart.model import Tables
from learnmart.operators import jobs
from learnmart.operators.rules import first_reason

PLACE = ["student_id", "course_id"]
TURN = ["unit_ts", "unit", "cmd_ts", "cmd_id"]  # the order in which commands would be handled


def _own_reason() -> Column:
    """The first thing against a command that does not depend on other commands."""
    kind = F.col("kind")
    return F.when(kind == "enroll", first_reason(**jobs._enrolment_reason())).when(
        kind == "pay", first_reason(**jobs._payment_reason(None))
    ).otherwise("unknown_kind")


def judge(t: Tables, commands: DataFrame) -> DataFrame:
    """Commands with their own reason, their unit's turn and whether the unit is refused for a command's own reason."""
    unit = F.when(F.col("unit_id").isNull(), F.concat(F.lit("c~"), "cmd_id")).otherwise(F.concat(F.lit("u~"), "unit_id"))
    judged = jobs._with_enrolment(t, jobs._with_course(t, jobs._with_user(t, jobs._with_admin(t, commands))))
    judged = jobs._with_price(judged).withColumn("unit", unit).withColumn("own_reason", _own_reason())
    judged = t.cut("judged", judged.withColumn("was_active", F.coalesce("was_active", F.lit(False))))
    heads = judged.groupBy("unit").agg(
        F.min("cmd_ts").alias("unit_ts"), F.max(F.col("own_reason").isNotNull()).alias("unit_bad")
    )
    return t.cut("in_turn", judged.join(heads, "unit"))


def first_openings(opened: DataFrame) -> DataFrame:
    """Per place, the first of the commands that open it; partial minima go through the exchange."""
    return opened.groupBy(*PLACE).agg(F.min("turn").alias("first_turn"))


def _uncovered(needs: DataFrame, opened: DataFrame) -> DataFrame:
    """Needs whose place no command opens before them."""
    late = F.col("first_turn").isNull() | (F.col("first_turn") > F.col("turn"))
    return needs.join(first_openings(opened), PLACE, "left").filter(late).drop("first_turn")


def refused_units(t: Tables, judged: DataFrame) -> DataFrame:
    """Units refused because a payment finds no active place, and those refused for a command's own reason."""
    bad = judged.filter("unit_bad").select("unit").distinct()
    fine = judged.filter("not unit_bad and not was_active").select("unit", *PLACE, "kind", F.struct(*TURN).alias("turn"))
    opened = t.cut("opened", fine.filter("kind = 'enroll'").drop("kind"))
    needs = t.cut("needs", fine.filter("kind = 'pay'").drop("kind"))
    found: list[DataFrame] = []
    suspects, standing = needs, opened
    while True:
        lost = t.cut("refused", _uncovered(suspects, standing).select("unit").distinct())
        if lost.isEmpty():
            return reduce(DataFrame.union, [bad, *found])
        found.append(lost)
        gone = reduce(DataFrame.union, found)
        taken_back = opened.join(lost, "unit", "left_semi").select(*PLACE).distinct()
        standing = opened.join(gone, "unit", "left_anti")
        suspects = needs.join(gone, "unit", "left_anti").join(taken_back, PLACE, "left_semi")


def decide_units(t: Tables, commands: DataFrame) -> DataFrame:
    """Every command with its outcome; in a refused unit, commands without a reason of their own say ``unit_refused``.

    A payment says ``not_enrolled`` when neither the units that stand nor the commands before it in its unit open its place.
    """
    judged = judge(t, commands)
    refused = t.cut("refused_units", refused_units(t, judged))
    judged = judged.withColumn("turn", F.struct(*TURN)).join(refused.withColumn("refused", F.lit(True)), "unit", "left")
    judged = t.cut("settled", judged.withColumn("refused", F.coalesce("refused", F.lit(False))))
    opens = judged.filter("kind = 'enroll' and own_reason is null and not was_active")
    standing = first_openings(opens.filter("not refused"))
    own = opens.filter("refused").groupBy("unit", *PLACE).agg(F.min("turn").alias("own_turn"))
    placed = judged.join(standing, PLACE, "left").join(own, ["unit", *PLACE], "left")
    covered = F.col("was_active") | F.coalesce(F.least("first_turn", "own_turn") < F.col("turn"), F.lit(False))
    reason = F.coalesce(
        F.col("own_reason"),
        F.when((F.col("kind") == "pay") & ~covered, "not_enrolled"),
        F.when(F.col("refused"), "unit_refused"),
    )
    outcome = (
        F.when(F.col("reason").isNotNull(), jobs.REJECTED)
        .when(F.col("kind") == "pay", "recorded")
        .when(F.col("was_active") | (F.col("first_turn") < F.col("turn")), "already_enrolled")
        .when(F.col("enrollment_id").isNotNull(), "reactivated")
        .otherwise("enrolled")
    )
    return placed.withColumn("reason", reason).withColumn("outcome", outcome).drop("turn", "first_turn", "own_turn")


def apply_units(t: Tables, decisions: DataFrame) -> jobs.Change:
    enrol, pay = jobs.apply_enrolments(t, decisions), jobs.apply_payments(t, decisions)
    return jobs.Change(
        tables=enrol.tables,
        appends={
            "payments": pay.appends["payments"],
            "activity_log": enrol.appends["activity_log"].union(pay.appends["activity_log"]),
            "mv_refresh_queue": enrol.appends["mv_refresh_queue"],
        },
        upserts=enrol.upserts,
    )
