"""Structured Streaming jobs over file sources.

Uniqueness and old-versus-new checks have no time limit.  What a stream has seen
itself is in Spark's keyed state (RocksDB): the keys claimed so far, or running
aggregates per key.  What was stored before is looked up in a keyed table, which
reads the pages of the micro-batch's own keys however large the table is.

A micro-batch writes its rows first and derives every output from what it wrote;
outputs live in folders named by the batch, so a batch that is delivered again
replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from learnmart import schemas
from learnmart.functions.exprs import hash_id
from learnmart.model import Tables
from learnmart.operators import constraints, jobs, rules
from learnmart.sources.store import Deltas, Layout, Store


@dataclass
class Sink:
    """Where a job keeps its checkpoint, its copy of what was stored before, and its outputs."""

    path: str

    def deltas(self, t: Tables, name: str, keys: list[str]) -> Deltas:
        return Deltas(t.spark, f"{self.path}/{name}", keys)

    def read(self, t: Tables, name: str) -> DataFrame:
        return t.spark.read.parquet(f"{self.path}/{name}")

    def stored(self, t: Tables, name: str, rows: DataFrame, keys: list[str]) -> Store:
        """``rows`` as a keyed table, written when the stream starts for the first time; a restart finds it."""
        store = Store(t.spark, f"{self.path}/_stored")
        if name not in store.layouts():
            store.commit({name: rows}, t.as_of, layouts={name: Layout(tuple(keys))})
        return store


def _start(source: DataFrame, sink: Sink, handle: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    return (
        source.writeStream.foreachBatch(handle)
        .outputMode(mode)
        .option("checkpointLocation", f"{sink.path}/_checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def first_claims(t: Tables, sink: Sink, batch_id: int, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Of ``candidates`` (one row per key), those whose key no earlier micro-batch has claimed.

    A stream of its own, run to its end within the micro-batch, drops candidates
    whose key is in its state: keys alone, in RocksDB, each looked up by itself.
    A micro-batch that is delivered again offers the same candidates; they are
    then known, and what counts is what they got the first time.
    """
    folder, out = f"{sink.path}/_candidates", f"{sink.path}/_claims"
    candidates.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{folder}/{batch_id}")
    schema = T.StructType([*candidates.schema, T.StructField("_batch", T.LongType())])
    offered = t.spark.readStream.schema(schema).option("ignoreMissingFiles", "true").parquet(f"{folder}/*")
    (
        offered.dropDuplicates(keys)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", f"{sink.path}/_claims_checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return t.spark.read.schema(schema).parquet(out).filter(F.col("_batch") == batch_id).drop("_batch")


def stream_submissions(t: Tables, source: DataFrame, sink: Sink) -> StreamingQuery:
    """Hand-ins -> score rules and constraints -> one per (homework, student) -> automatic grading.

    Output ``judged``: every row with an outcome.  Output ``accepted``: rows as stored.
    """
    keys = ["homework_id", "student_id"]
    before = sink.stored(t, "handed_in", t.homework_submissions.select(*keys), keys)
    arrived = sink.deltas(t, "arrived", ["id"])
    judged = sink.deltas(t, "judged", ["id"])
    accepted = sink.deltas(t, "accepted", keys)
    columns = t.homework_submissions.columns

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = constraints.judge_values(t, "homework_submissions", rules.judge_scores(t, batch.select(*columns)))
        rows = arrived.write(batch_id, rows.select(*columns, "reject_reason"))
        order = Window.partitionBy(*keys).orderBy("submitted_at", "id")
        first = rows.filter("reject_reason is null").withColumn("_n", F.row_number().over(order)).filter("_n = 1").select(*keys, "id")
        claimed = first_claims(t, sink, batch_id, first, keys)
        known = before.near("handed_in", claimed).distinct()
        fresh = claimed.join(known, keys, "left_anti").select("id", F.lit(True).alias("is_first"))
        # only rows that no rule refuses are held against the claims
        open_rows = rows.filter("reject_reason is null").join(fresh, "id", "left").select(
            *columns, F.when(F.col("is_first").isNull(), "duplicate").otherwise("accepted").alias("outcome"))
        refused = rows.filter("reject_reason is not null").select(*columns, F.col("reject_reason").alias("outcome"))
        decided = open_rows.unionByName(refused)
        written = judged.write(batch_id, decided)
        accepted.write(batch_id, rules.auto_check(t, written.filter("outcome = 'accepted'").drop("outcome")).select(*columns))

    return _start(source, sink, handle)


def stream_progress(t: Tables, source: DataFrame, sink: Sink) -> StreamingQuery:
    """Lesson events (student_id, lesson_id, event_id, ts, done) -> upserts of progress and log rows.

    Events of one micro-batch act in time order: the first one on a new key
    inserts, a later completing one updates.  State is a running aggregate per
    key that also tells when, by arrival, a key was first seen and first done.
    """
    keys = ["student_id", "lesson_id"]
    base = t.lesson_progress.withColumn("id", F.col("id").cast("string"))
    before = sink.stored(t, "progress", base, keys)
    arrived = sink.deltas(t, "arrived", keys)
    progress = sink.deltas(t, "progress", keys)
    changes = sink.deltas(t, "changes", keys)
    log = sink.deltas(t, "log", ["id"])
    columns = base.columns
    running = source.withColumn("arrived", F.current_timestamp()).groupBy(*keys).agg(
        F.min(F.struct("arrived", "ts", "event_id", "done")).alias("first"),
        F.min(F.when(F.col("done"), F.col("arrived"))).alias("done_in"),
        F.max("ts").alias("last"),
        F.max("arrived").alias("now_in"),
    )

    def handle(batch: DataFrame, batch_id: int) -> None:
        seen = arrived.write(batch_id, batch)
        old = before.near("progress", seen).select(
            *keys,
            F.col("id").alias("old_id"),
            F.col("is_completed").alias("was"),
            F.col("completed_at").alias("old_completed_at"),
            F.col("last_viewed_at").alias("old_viewed_at"),
        )
        new = F.col("first.arrived") == F.col("now_in")  # seen in this stream for the first time
        done_now = F.coalesce(F.col("done_in") == F.col("now_in"), F.lit(False))
        done_before = F.coalesce(F.col("done_in") < F.col("now_in"), F.lit(False))
        # done before this batch: stored so, or by an earlier batch; a key seen for the first time starts as its first event
        was = F.coalesce("was", F.when(new, F.col("first.done")).otherwise(F.lit(False))) | done_before
        # an earlier batch stamped the completion unless the row was inserted as done
        stamped = done_before & ~F.coalesce("was", F.col("first.done"))
        changed = seen.join(old, keys, "left").select(
            *keys,
            F.coalesce("old_id", hash_id(*keys)).alias("id"),
            (F.col("was").isNull() & new).alias("inserted"),
            (was | done_now).alias("is_completed"),
            (~was & (done_now | F.col("first.done") & new)).alias("completed"),
            F.when(stamped, t.now).otherwise(F.col("old_completed_at")).alias("old_completed_at"),
            F.greatest("last", "old_viewed_at", F.when(stamped, t.now)).alias("viewed_at"),
        )
        written = changes.write(batch_id, changed)
        rows = written.select(
            "id",
            *keys,
            "is_completed",
            F.when(F.col("completed"), t.now).otherwise(F.col("old_completed_at")).alias("completed_at"),
            F.when(F.col("completed"), t.now).otherwise(F.col("viewed_at")).alias("last_viewed_at"),
        )
        progress.write(batch_id, rows.select(*columns))
        viewed = rules.log_rows(
            written.filter("inserted"), t.now, schemas.Action.VIEW_LESSON, "lesson", "student_id", "lesson_id",
            {"first_view": F.lit(True)}, [F.col("student_id"), F.col("lesson_id")],
        )
        done = rules.log_rows(
            written.filter("completed"), t.now, schemas.Action.COMPLETE_LESSON, "lesson", "student_id", "lesson_id",
            {"completed_at": rules.iso(t.now)}, [F.col("student_id"), F.col("lesson_id"), rules.iso(t.now)],
        )
        log.write(batch_id, viewed.union(done))

    return _start(running, sink, handle, mode="update")


def stream_enrolments(t: Tables, source: DataFrame, sink: Sink) -> StreamingQuery:
    """Enrolment commands -> decisions, changed enrolments, log rows, stale-mart rows."""
    keys = ["student_id", "course_id"]
    base = t.enrollments.withColumn("id", F.col("id").cast("string"))
    before = sink.stored(t, "enrollments", base, keys)
    arrived = sink.deltas(t, "arrived", ["cmd_id"])
    enrolments = sink.deltas(t, "enrollments", keys)
    decisions = sink.deltas(t, "decisions", ["cmd_id"])
    log = sink.deltas(t, "log", ["id"])
    queue = sink.deltas(t, "queue", ["id"])

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = arrived.write(batch_id, jobs.judge_enrolments(t, batch))
        first = jobs.earliest(rows.filter("reason is null").select(*keys, "cmd_ts", "cmd_id"), keys)
        claimed = first_claims(t, sink, batch_id, first, keys).select("cmd_id", F.lit(True).alias("claimed"))
        now = t.replace(enrollments=before.near("enrollments", rows))
        decided = jobs.settle_enrolments(now, rows.join(claimed, "cmd_id", "left"), F.coalesce("claimed", F.lit(False)))
        written = decisions.write(batch_id, decided.drop("claimed"))
        touched = written.filter(F.col("outcome").isin("enrolled", "reactivated"))
        change = jobs.apply_enrolments(now, touched)
        enrolments.write(batch_id, change.upserts["enrollments"].select(*base.columns))
        log.write(batch_id, change.appends["activity_log"])
        queue.write(batch_id, change.appends["mv_refresh_queue"])

    return _start(source, sink, handle)


def stream_last_activity(t: Tables, source: DataFrame, sink: Sink) -> StreamingQuery:
    """Running last activity and action counts per user, from log rows."""
    action = F.col("action")
    running = source.groupBy("user_id").agg(
        F.count("*").alias("actions"),
        F.count(F.when(action == schemas.Action.VIEW_LESSON, 1)).alias("lessons_viewed"),
        F.count(F.when(action == schemas.Action.COMPLETE_LESSON, 1)).alias("lessons_completed"),
        F.count(F.when(action == "submit_hw", 1)).alias("homeworks_sent"),
        F.max("created_at").alias("last_activity_at"),
    )
    out = sink.deltas(t, "activity", ["user_id"])

    def handle(batch: DataFrame, batch_id: int) -> None:
        out.write(batch_id, batch)

    return _start(running, sink, handle, mode="update")


def latest_activity(t: Tables, sink: Sink) -> DataFrame:
    """The newest running row per user."""
    fields = ["actions", "lessons_viewed", "lessons_completed", "homeworks_sent", "last_activity_at"]
    return sink.deltas(t, "activity", ["user_id"]).newest().select("user_id", *fields)


def stream_active_days(t: Tables, source: DataFrame, sink: Sink, late: str = "2 days") -> StreamingQuery:
    """Running number of distinct active days per user, from log rows.

    Two stateful steps: a user's day passes once, then days are counted.  A day
    is forgotten when the watermark (``late`` behind the latest row) has passed
    its end; rows that come later than that are not counted.
    """
    days = (
        source.select("user_id", "created_at")
        .withWatermark("created_at", late)
        .withColumn("day", F.window("created_at", "1 day"))
        .dropDuplicates(["user_id", "day"])
    )
    running = days.groupBy("user_id").agg(F.count("*").alias("active_days"))
    out = sink.deltas(t, "active_days", ["user_id"])

    def handle(batch: DataFrame, batch_id: int) -> None:
        out.write(batch_id, batch)

    return _start(running, sink, handle, mode="update")


def active_days(t: Tables, sink: Sink) -> DataFrame:
    return sink.deltas(t, "active_days", ["user_id"]).newest()
