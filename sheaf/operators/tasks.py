"""Asynchronous conversion tasks (T8 batch form, J10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TERMINAL = ("success", "failure")


def latest_status(events: DataFrame) -> DataFrame:
    """A task's status stops changing at its first terminal event; before that
    the latest event (by ``event_ts``, then ``seq``) is its status."""
    pos = F.struct("event_ts", "seq")
    term = F.col("task_status").isin(*TERMINAL)
    return events.groupBy("task_id").agg(
        F.min_by(F.struct("task_status", "progress", "event_ts"), F.when(term, pos)).alias("_t"),
        F.max_by(F.struct("task_status", "progress", "event_ts"), pos).alias("_l"),
        F.count(F.lit(1)).alias("n_events"),
    ).select("task_id", F.coalesce("_t", "_l").alias("s"), "n_events").select(
        "task_id", "s.task_status", "s.progress", F.col("s.event_ts").alias("status_ts"), "n_events")


def task_results(status: DataFrame, results: DataFrame) -> DataFrame:
    """Finished tasks with their result; failed tasks keep a NULL result."""
    done = status.where(F.col("task_status").isin(*TERMINAL))
    return done.join(results, "task_id", "left").withColumn(
        "has_result", (F.col("task_status") == "success") & F.col("result_chars").isNotNull())
