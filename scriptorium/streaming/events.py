"""The event log: stage timings, heartbeats, gaps in sequences; in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.config import DEFAULT, Thresholds


def stage_timings(events: DataFrame) -> DataFrame:
    """(job, stage, n, first, last, seconds) of events (job, stage, ts)."""
    s = events.groupBy("job", "stage").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return s.withColumn("seconds", (F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp"))) / 1e6)


def heartbeat_gaps(events: DataFrame, seconds: float | None = None, t: Thresholds = DEFAULT) -> DataFrame:
    """(job, beats, gaps, longest): silences longer than the timeout between a job's events."""
    limit = seconds or t.heartbeat_timeout_secs
    rows = events.withColumn("gap", F.expr("(unix_micros(cast(ts as timestamp)) - lag(unix_micros(cast(ts as timestamp))) over (partition by job order by ts, seq)) / 1e6"))
    return rows.groupBy("job").agg(F.count("*").alias("beats"), F.count_if(F.col("gap") > limit).alias("gaps"), F.max("gap").alias("longest"))


def sequence_gaps(events: DataFrame) -> DataFrame:
    """(job, after, missing): where a job's sequence numbers leave some out."""
    rows = events.withColumn("next", F.expr("lead(seq) over (partition by job order by seq)"))
    return rows.where("next > seq + 1").select("job", F.col("seq").alias("after"), (F.col("next") - F.col("seq") - 1).alias("missing"))


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """(job, begin, end, n): runs of events no farther apart than the gap. Works on a stream with a watermark as well."""
    return events.groupBy("job", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("job", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


def windowed_counts(events: DataFrame, width: str, watermark: str | None = None) -> DataFrame:
    """(stage, begin, n, total): events by tumbling window; with a watermark when they are a stream, later ones are dropped by Spark and counted in its metrics."""
    rows = events.withWatermark("ts", watermark) if watermark else events
    return rows.groupBy("stage", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("stage", F.col("w.start").alias("begin"), "n", "total")


def run_windowed(spark, source: str, schema, width: str, sink: str, checkpoint: str, watermark: str = "10 minutes") -> None:
    """Take what a folder of event files holds into a table of window counts, once; state is kept in the checkpoint between calls."""
    stream = spark.readStream.schema(schema).parquet(source)
    rows = stream.select(F.col("ts"), F.col("event_type").alias("stage"), F.col("value"))
    query = windowed_counts(rows, width, watermark).writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
