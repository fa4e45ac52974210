"""Streams in several micro-batches give what one batch gives."""

from pyspark.sql import functions as F

from learnmart.operators import jobs
from learnmart.plans import students
from learnmart.sources import commands, testdata
from learnmart.sources.workspace import workspace
from learnmart.streaming import jobs as streams


def in_files(spark, df, name, order, files=3):
    """Write ``df`` as time-ordered files and read them as a stream, one file per micro-batch."""
    folder = workspace(spark, name)
    rows = df.withColumn("_part", F.ntile(files).over(__import__("pyspark").sql.Window.orderBy(*order)))
    for part in range(1, files + 1):
        rows.filter(F.col("_part") == part).drop("_part").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def rows_of(df, *cols):
    return sorted(map(str, df.select(*cols).collect()))


def test_submissions(spark, sf_dir):
    t = commands.before(testdata.load(spark, sf_dir))
    feed = commands.raw_submissions(t)
    results = []
    for files in (1, 3):
        sink = streams.Sink(workspace(spark, "s1"))
        streams.stream_submissions(t, in_files(spark, feed, "feed", ["submitted_at", "id"], files), sink).awaitTermination()
        judged = sink.read(t, "judged")
        assert judged.select("batch").distinct().count() == files
        results.append((rows_of(judged, "id", "outcome"), rows_of(sink.read(t, "accepted"), "id", "score", "status")))
    assert results[0] == results[1]


def test_progress(spark, sf_dir):
    t = commands.before(testdata.load(spark, sf_dir))
    feed = t.raw.events.filter("event_type <> 'error'").select(
        F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("student_id"), (F.col("event_id") % 24).alias("lesson_id"), "event_id",
        F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "purchase").alias("done"))
    results = []
    for files in (1, 3):
        sink = streams.Sink(workspace(spark, "s2"))
        streams.stream_progress(t, in_files(spark, feed, "feed", ["ts", "event_id"], files), sink).awaitTermination()
        latest = sink.deltas(t, "progress", ["student_id", "lesson_id"]).onto(t.lesson_progress.withColumn("id", F.col("id").cast("string")))
        results.append((rows_of(latest, "id", "is_completed"), rows_of(sink.read(t, "log").distinct(), "id", "action", "user_id")))
    assert results[0] == results[1]


def test_enrolments(spark, sf_dir):
    t = commands.before(testdata.load(spark, sf_dir))
    feed = commands.enrol_commands(t)
    decided = jobs.decide_enrolments(t, feed)
    sink = streams.Sink(workspace(spark, "s3"))
    streams.stream_enrolments(t, in_files(spark, feed, "feed", ["cmd_ts", "cmd_id"]), sink).awaitTermination()
    assert rows_of(sink.read(t, "decisions"), "cmd_id", "outcome", "reason") == rows_of(decided, "cmd_id", "outcome", "reason")
    change = jobs.apply_enrolments(t, decided)
    assert rows_of(sink.read(t, "log"), "id", "action", "metadata") == rows_of(change.appends["activity_log"], "id", "action", "metadata")
    base = t.enrollments.withColumn("id", F.col("id").cast("string"))
    latest = sink.deltas(t, "enrollments", ["student_id", "course_id"]).onto(base)
    cols = ("id", "student_id", "course_id", "enrolled_at", "is_active")
    assert rows_of(latest, *cols) == rows_of(change.tables["enrollments"], *cols)


def test_last_activity(spark, sf_dir):
    t = testdata.load(spark, sf_dir)
    sink = streams.Sink(workspace(spark, "s4"))
    streams.stream_last_activity(t, in_files(spark, t.activity_log, "feed", ["created_at", "id"]), sink).awaitTermination()
    want = t.activity_log.groupBy("user_id").agg(F.count("*").alias("actions"), F.max("created_at").alias("last_activity_at"))
    cols = ("user_id", "actions", "last_activity_at")
    assert rows_of(streams.latest_activity(t, sink), *cols) == rows_of(want, *cols)


def test_claims_hold_over_batches_and_redelivery(spark, sf_dir):
    t = testdata.load(spark, sf_dir)
    sink = streams.Sink(workspace(spark, "claims"))
    offer = lambda *rows: spark.createDataFrame(list(rows), "k int, j string, id string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(streams.first_claims(t, sink, 0, offer((1, "a", "x"), (2, "a", "y")), ["k", "j"])) == ["x", "y"]
    assert ids(streams.first_claims(t, sink, 1, offer((1, "a", "z"), (1, "b", "w")), ["k", "j"])) == ["w"]
    for _ in range(2):  # delivered again: what it got the first time
        assert ids(streams.first_claims(t, sink, 1, offer((1, "a", "z"), (1, "b", "w")), ["k", "j"])) == ["w"]
    assert ids(streams.first_claims(t, sink, 2, offer((2, "a", "v"), (1, "b", "u")), ["k", "j"])) == []
    assert ids(streams.first_claims(t, sink, 3, offer((3, "a", "t")).limit(0), ["k", "j"])) == []


def test_active_days(spark, sf_dir):
    t = testdata.load(spark, sf_dir)
    sink = streams.Sink(workspace(spark, "s5"))
    streams.stream_active_days(t, in_files(spark, t.activity_log, "feed", ["created_at", "id"], 4), sink).awaitTermination()
    want = t.activity_log.groupBy("user_id").agg(F.countDistinct(F.to_date("created_at")).alias("active_days"))
    assert sink.read(t, "active_days").select("batch").distinct().count() >= 3
    assert rows_of(streams.active_days(t, sink), "user_id", "active_days") == rows_of(want, "user_id", "active_days")
    assert rows_of(streams.active_days(t, sink).select(F.col("user_id").alias("student_id"), "active_days"), "student_id", "active_days") == rows_of(
        students.activity(t.replace(users=t.users.select("id", "email", "role", "first_name", "last_name", "middle_name", F.lit(True).alias("is_active"))))
        .filter("actions > 0").select("student_id", "active_days"), "student_id", "active_days")
