"""Memory samples of tracked runs (C24, C25, W2, W3, T4, T7, F-7, F-10, P9).

Samples: ``run_id, seq, epoch_s, rss_mb, vms_mb, available_mb, percent`` and
optionally ``elapsed_s``; order within a run is ``(epoch_s, seq)``. The first
sample of a run is the "before" snapshot, the last one the "after" snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.operators.carry import running_max

ORDER = ["epoch_s", "seq"]
# Defaults of the converter's monitor (limits) and of the profiler's report.
TIMEOUT_S = 120
MAX_MEMORY_MB = 2048
MIN_AVAILABLE_MB = 500
CULPRIT_DELTA_MB = 50
CULPRIT_PEAK_MB = 500
HIGH_MEMORY_DELTA_MB = 100
MAX_RETRIES = 2


def bytes_to_mb(c: Column) -> Column:
    """Bytes -> MB (1024 * 1024)."""
    return c / 1048576.0


def _pos() -> Column:
    return F.struct(*[F.col(c) for c in ORDER])


def _snap() -> Column:
    return F.struct("epoch_s", "seq", "rss_mb", "vms_mb", "percent", "available_mb")


def run_stats(samples: DataFrame, continuous: bool = True) -> DataFrame:
    """C25 + P9: before/after/peak snapshots, duration and deltas per run.

    With continuous monitoring the peak is the first highest sample from
    ``before`` up to (not including) ``after``; otherwise the peak is ``after``.
    """
    peak_key = F.struct(F.col("rss_mb"), -F.col("epoch_s"), -F.col("seq"))
    if continuous:
        # A light table, a row per run, says which sample is the last; then one aggregation sees every sample once.
        last = samples.groupBy("run_id").agg(F.max(_pos()).alias("_last"))
        agg = samples.join(last, "run_id").groupBy("run_id").agg(
            F.count(F.lit(1)).alias("n_samples"), F.min_by(_snap(), _pos()).alias("before"), F.max_by(_snap(), _pos()).alias("after"),
            F.max_by(_snap(), F.when(_pos() < F.col("_last"), peak_key)).alias("_body"))
        # a one-sample run peaks at "before"
        agg = agg.withColumn("peak", F.coalesce("_body", "before")).drop("_body")
    else:
        agg = samples.groupBy("run_id").agg(
            F.count(F.lit(1)).alias("n_samples"), F.min_by(_snap(), _pos()).alias("before"),
            F.max_by(_snap(), _pos()).alias("after")).withColumn("peak", F.col("after"))
    return agg.select(
        "run_id", "n_samples", "before", "after", "peak",
        (F.col("after.epoch_s") - F.col("before.epoch_s")).cast("double").alias("duration_seconds"),
        (F.col("after.rss_mb") - F.col("before.rss_mb")).alias("rss_delta_mb"),
        (F.col("after.vms_mb") - F.col("before.vms_mb")).alias("vms_delta_mb"))


def with_outcomes(stats: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Run statistics with ``success`` and ``error``; ``outcomes`` (run_id, error) lists the failed runs, one row each."""
    failed = outcomes.where("error is not null").select("run_id", "error")
    return stats.join(failed, "run_id", "left").withColumn("success", F.col("error").isNull())


def with_running_peak(samples: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """W2 + W3: running max of rss (seeded by the first sample) and a strict new-peak flag.

    The first sample of a run is the seed and counts as a new peak.
    """
    s = samples.withColumn("_b", F.floor(F.col("epoch_s") / bucket_seconds).cast("long"))
    s = running_max(s, keys=["run_id"], bucket="_b", order=ORDER, value=F.col("rss_mb"), out="running_peak",
                    out_prev="_prev_peak")
    return (s.withColumn("is_new_peak", F.col("_prev_peak").isNull() | (F.col("rss_mb") > F.col("_prev_peak")))
            .drop("_prev_peak", "_b"))


def limit_verdicts(samples: DataFrame, *, timeout_s: float = TIMEOUT_S, max_memory_mb: float = MAX_MEMORY_MB,
                   min_available_mb: float = MIN_AVAILABLE_MB) -> DataFrame:
    """T4 (batch): the first violating sample of each run and its return code.

    Within one sample: elapsed > timeout -> -1, then rss > max -> -2, then
    available < min -> -3. Runs without a violation get no row.
    """
    code = (F.when(F.col("elapsed_s") > timeout_s, F.lit(-1))
            .when(F.col("rss_mb") > max_memory_mb, F.lit(-2))
            .when(F.col("available_mb") < min_available_mb, F.lit(-3)))
    msg = (F.when(code == -1, F.format_string("Timeout after %ds", F.lit(int(timeout_s))))
           .when(code == -2, F.format_string("Memory limit exceeded: %.1fMB", F.col("rss_mb")))
           .otherwise(F.lit("System low on memory")))
    v = samples.withColumn("returncode", code).where(F.col("returncode").isNotNull()).withColumn("message", msg)
    return v.groupBy("run_id").agg(F.min_by(F.struct("epoch_s", "seq", "returncode", "message", "rss_mb"),
                                            _pos()).alias("v")).select("run_id", "v.*")


def profiler_totals(stats: DataFrame) -> DataFrame:
    """Jobs, total delta, largest delta and highest peak (first run wins ties)."""
    neg_first = F.struct(-F.col("before.epoch_s"), -F.col("before.seq"))
    return stats.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        F.sum("rss_delta_mb").alias("total_rss_delta_mb"),
        F.max_by(F.struct("run_id", "rss_delta_mb"), F.struct(F.col("rss_delta_mb"), neg_first)).alias("max_delta"),
        F.max_by(F.struct("run_id", F.col("peak.rss_mb").alias("peak_rss_mb")),
                 F.struct(F.coalesce(F.col("peak.rss_mb"), F.lit(0.0)), neg_first)).alias("max_peak")).select(
        "total_jobs", "total_rss_delta_mb", F.col("max_delta.run_id").alias("max_delta_run"),
        F.col("max_delta.rss_delta_mb").alias("max_rss_delta_mb"), F.col("max_peak.run_id").alias("max_peak_run"),
        F.col("max_peak.peak_rss_mb").alias("max_peak_rss_mb"))


def oom_culprits(stats: DataFrame, *, delta_mb: float = CULPRIT_DELTA_MB, peak_mb: float = CULPRIT_PEAK_MB) -> DataFrame:
    """F-7 + S3: runs above either threshold, largest delta first."""
    return (stats.where((F.col("rss_delta_mb") > delta_mb) | (F.col("peak.rss_mb") > peak_mb))
            .orderBy(F.col("rss_delta_mb").desc(), F.col("run_id")))


def high_memory_runs(stats: DataFrame, delta_mb: float = HIGH_MEMORY_DELTA_MB) -> DataFrame:
    """F-10: how many runs grew by more than ``delta_mb``."""
    return stats.agg(F.count_if(F.col("rss_delta_mb") > delta_mb).alias("high_memory_runs"),
                     F.count(F.lit(1)).alias("runs"))


def retry_outcome(attempts: DataFrame, max_retries: int = MAX_RETRIES, key: str = "doc_id") -> DataFrame:
    """Attempts past ``max_retries`` never happen; the outcome is the first
    successful attempt, else the last attempt made."""
    a = attempts.where(F.col("attempt") <= max_retries)
    return a.groupBy(key).agg(
        F.count(F.lit(1)).alias("attempts_made"),
        F.min(F.when(F.col("ok"), F.col("attempt"))).alias("first_success"),
        F.max("attempt").alias("last_attempt"),
    ).select(key, "attempts_made", F.col("first_success").isNotNull().alias("succeeded"),
             F.coalesce("first_success", "last_attempt").alias("final_attempt"))
