"""Streaming queries over the events table, run until it is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.catalog import ORACLES, query, table
from tessel.plans import relational, sequence
from tessel.shared import new_folder
from tessel.streaming import counters, quiet


@query(ORACLES[relational.counter_final.__name__])
def stream_counters(spark, d):
    like = table(spark, d, "events")
    step = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1)
    events = counters.stream(spark, f"{d}/events.parquet", like).withColumn("step", step).filter("step is not null")
    told = counters.drained(counters.saturating(events, "user_id", "ts", "event_id", "step"), "counters", "update")
    # a key's counter is told by each batch that has rows of it
    return told.groupBy("user_id").agg(F.max_by("counter", "batch").alias("counter"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(spark, d):
    events = counters.stream(spark, f"{d}/events.parquet", table(spark, d, "events"))
    told = counters.drained(counters.windowed(events, "ts", "event_type", "1 day", "1 hour"), "daily", "update")
    # a batch tells the counts that it changed; the watermark frees those of past days
    return told.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))


@query(ORACLES[sequence.last_after_quiet.__name__])
def stream_last_after_quiet(spark, d):
    """The events as a log that comes in over some micro-batches, with a last row that lets the clock run on, so
    that the pause after each user's last burst passes."""
    events = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    folder = new_folder(spark, "log")
    rows, marks = events.agg(F.count("*"), F.percentile_approx("ts", [0.25, 0.5, 0.75])).first()
    # a stretch of time in as many files as a micro-batch takes, so that batches come in order
    files = max(1, rows // 4_000_000)
    stretch = sum((F.coalesce((F.col("ts") > F.lit(m)).cast("int"), F.lit(0)) for m in marks or []), F.lit(0))
    for i in range(4):
        events.filter(stretch == i).repartition(files).write.mode("append").parquet(f"{folder}/rows")
    end = events.agg(F.lit(None).cast("bigint").alias("user_id"), (F.max("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"), F.lit(0).cast("bigint").alias("event_id"))
    end.coalesce(1).write.mode("append").parquet(f"{folder}/rows")
    with quiet.with_timers(spark):
        log = counters.stream(spark, f"{folder}/rows", events, files)
        closing = log.withColumn("user_id", F.coalesce("user_id", F.lit(-1)))
        told = counters.drained(quiet.after_quiet(closing, "user_id", "ts", "event_id", "event_id", "30 minutes", "1 hour"), "bursts", "append")
    return told.select("user_id", F.col("value").alias("event_id"))
