"""Jobs as events: their states, queue, history, deadlines and reports; in batch and, where state is kept, as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A job's states in their order.
STATES = ["preparing", "running", "cancelling", "done"]


def _in(key: str = "job", *order: str):
    return Window.partitionBy(key).orderBy(*(order or ("seq",)))


def progress(events: DataFrame) -> DataFrame:
    """(job, stage, done, total, share) of progress events (job, seq, stage, done, total): the last said of each stage; a total of 0 is all done."""
    last = events.groupBy("job", "stage").agg(F.max(F.struct("seq", "done", "total")).alias("x")).select("job", "stage", "x.done", "x.total")
    return last.withColumn("share", F.when(F.col("total") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.col("done") / F.col("total"))))


def states(events: DataFrame, kill_after: float = 5.0) -> DataFrame:
    """(job, state, killed) at the end of events (job, seq, ts seconds, t: start, cancel, exit or tick): a job runs once started, cancels when told, is done when it exits; one that goes on cancelling for too long is killed."""
    s = events.groupBy("job").agg(F.some(F.col("t") == "start").alias("started"), F.min(F.when(F.col("t") == "cancel", F.col("ts"))).alias("told"), F.min(F.when(F.col("t") == "exit", F.col("ts"))).alias("left"), F.max("ts").alias("now"))
    until = F.coalesce("left", "now")
    killed = F.coalesce(until - F.col("told") > kill_after, F.lit(False))
    state = F.when(F.col("left").isNotNull() | killed, "done").when(F.col("told").isNotNull(), "cancelling").when(F.col("started"), "running").otherwise("preparing")
    return s.select("job", state.alias("state"), killed.alias("killed"))


def cancelled(events: DataFrame) -> DataFrame:
    """Events without a job's own after it was told to stop; its exit stays."""
    told = F.max((F.col("t") == "cancel").cast("int")).over(_in().rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("told_", F.coalesce(told, F.lit(0))).where("told_ = 0 or t = 'exit'").drop("told_")


def pump(queue: DataFrame, most: int = 1) -> DataFrame:
    """(worker, job, starts): waiting jobs (worker, at, job, running) that a worker may start, in order, beside those that run."""
    busy = F.count_if("running").over(Window.partitionBy("worker"))
    place = F.sum((~F.col("running")).cast("int")).over(Window.partitionBy("worker").orderBy("at"))
    return queue.withColumns({"busy": busy, "place": place}).where("not running").select("worker", "job", (F.col("busy") + F.col("place") <= most).alias("starts"))


def history(jobs: DataFrame, most: int = 500) -> DataFrame:
    """The last so many entries (user, ts, job) of each user."""
    return jobs.withColumn("k_", F.row_number().over(Window.partitionBy("user").orderBy(F.desc("ts"), F.desc("job")))).where(F.col("k_") <= most).drop("k_")


def deadlines(stages: DataFrame, limit: float = 1200.0) -> DataFrame:
    """(job, stage, seconds, late) of stage events (job, stage, begin, end seconds): those that took longer than a stage may."""
    took = F.col("end") - F.col("begin")
    return stages.select("job", "stage", took.alias("seconds"), (took > limit).alias("late"))


def over_limits(jobs: DataFrame, caps: dict[str, float]) -> DataFrame:
    """(job, cap, value, allowed): every cap that a job's declared sizes break, checked before it begins."""
    checks = F.array(*[F.struct(F.lit(c).alias("cap"), F.col(c).cast("double").alias("value"), F.lit(float(v)).alias("allowed")) for c, v in caps.items()])
    return jobs.select("job", F.explode(checks).alias("x")).where("x.value > x.allowed").select("job", "x.*")


def report(stages: DataFrame, warnings: DataFrame, classes: DataFrame) -> DataFrame:
    """(job, status, seconds, stages, warnings map, classes map): one row for a run, of its stages (job, stage, seconds, ok), warnings (job, code) and page classes (job, class, pages)."""
    s = stages.groupBy("job").agg(F.sum("seconds").alias("seconds"), F.count("*").alias("stages"), F.every("ok").alias("ok"))
    counted = lambda df, key, value: df.groupBy("job").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))))
    w = warnings.groupBy("job", "code").agg(F.count("*").alias("n"))
    w = counted(w, "code", "n").toDF("job", "warnings")
    c = counted(classes, "class", "pages").toDF("job", "classes")
    out = s.join(w, "job", "left").join(c, "job", "left")
    return out.select("job", F.when(F.col("ok"), "ok").otherwise("failed").alias("status"), "seconds", "stages", "warnings", "classes")


def structure_digest(content: DataFrame) -> DataFrame:
    """(doc, variants map, headings array) of content (doc, at, kind, level, text): how many of each kind, and the headings in order."""
    kinds = content.groupBy("doc", "kind").agg(F.count("*").alias("n")).groupBy("doc").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("variants"))
    heads = content.where("kind = 'heading'").groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "level", "text"))), lambda x: F.concat_ws(" ", x["level"], x["text"])).alias("headings"))
    return kinds.join(heads, "doc", "left").withColumn("headings", F.coalesce("headings", F.array().cast("array<string>")))


def layout_digest(lines: DataFrame) -> DataFrame:
    """(doc, pages, blocks, lines, columns) of lines (doc, page, block, column)."""
    return lines.groupBy("doc").agg(F.countDistinct("page").alias("pages"), F.countDistinct("block").alias("blocks"), F.count("*").alias("lines"), (F.max("column") + 1).alias("columns"))


def stage_diff(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, was, is, change) of two dumps of a stage: rows that came, went or say something else."""
    a, b = before.select(*keys, F.col(value).cast("string").alias("was"), F.lit(True).alias("a")), after.select(*keys, F.col(value).cast("string").alias("is"), F.lit(True).alias("b"))
    both = a.join(b, keys, "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("is")), "changed")
    return both.select(*keys, "was", "is", change.alias("change")).where("change is not null")


def rotated_log(lines: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(log, at, file): which file of a log each line (log, at, bytes) goes to, a new one when the present one is full. What is before a line decides, so a running sum does it."""
    before = F.coalesce(F.sum("bytes").over(Window.partitionBy("log").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.select("log", "at", F.floor(before / most).alias("file"))


def heartbeat_due(seconds: Column, every: float = 2.0) -> Column:
    """How many beats a job of so many seconds gives."""
    return F.floor(seconds / every).cast("bigint")
