"""The test tables as streams: the same files read with ``readStream``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learnmart.model import Tables
from learnmart.sources import commands, testdata


class StreamingRaw(testdata.Raw):
    """Raw tables with one of them streaming, in time order and several micro-batches."""

    def __init__(self, spark: SparkSession, sf_dir: str, streaming: str, order: str, folder: str, batches: int = 3):
        super().__init__(spark, sf_dir)
        self.course_count = self.course_count  # worked out on the files before any of them streams
        rows = self._frames[streaming]
        marks = rows.agg(F.percentile_approx(F.col(order).cast("timestamp").cast("double"), [k / batches for k in range(1, batches)]).alias("q")).first().q or []
        at = F.col(order).cast("timestamp").cast("double")
        bounds = [None, *marks, None]
        for low, high in zip(bounds, bounds[1:]):  # one folder a batch, oldest first: a file source reads files by their age
            part = rows
            if low is not None:
                part = part.filter(at > low)
            if high is not None:
                part = part.filter(at <= high)
            part.write.mode("append").parquet(folder)
        files = len(spark.read.schema(testdata.FILES[streaming]).parquet(folder).inputFiles())
        reader = spark.readStream.schema(testdata.FILES[streaming]).option("maxFilesPerTrigger", max(1, -(-files // batches)))
        self._frames[streaming] = reader.parquet(folder)


def _with_raw(t: Tables, raw: testdata.Raw) -> Tables:
    out = t.replace()
    out.raw = raw
    return out


def submissions(t: Tables, raw: testdata.Raw) -> DataFrame:
    return commands.raw_submissions(_with_raw(t, raw))


def lesson_events(t: Tables, raw: testdata.Raw) -> DataFrame:
    rows = raw.events.filter(F.col("ts") >= commands._ntz(commands.EVENT_CUT)).select(
        "event_id", "user_id", "ts", "event_type", t.raw.event_lesson().alias("lesson_id")
    )
    return rows.select(
        testdata._s("S", "user_id").alias("student_id"),
        "lesson_id",
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").isin("purchase", "signup").alias("done"),
    )


def enrol_commands(t: Tables, raw: testdata.Raw) -> DataFrame:
    return commands.enrol_commands(_with_raw(t, raw))


def activity(t: Tables, raw: testdata.Raw) -> DataFrame:
    return testdata._activity(raw)
