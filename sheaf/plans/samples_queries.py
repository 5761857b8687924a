"""Registered memory-sample queries over fixture F4 (samples derived from ``events``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions.memlog import job_status_line
from sheaf.operators import samples as sm
from sheaf.operators.timers import memory_spikes_batch, monitor_emissions_batch
from sheaf.plans.common import flat
from sheaf.plans.fixtures import run_outcomes
from sheaf.plans.fixtures import samples as _samples
from sheaf.session import cut_lineage

# Generous limits so that every verdict occurs in the fixture.
VERDICT_LIMITS = dict(timeout_s=259200, max_memory_mb=400, min_available_mb=500)


def samples(s, d):
    # Shared by the branches of a plan (running peak, seeds, chunk passes); one checkpoint per query.
    return cut_lineage(_samples(s, d))


def stats(s, d):
    return sm.run_stats(_samples(s, d))


def _stats_cols(df):
    return flat(df.select(
        "run_id", "n_samples", F.col("before.epoch_s").alias("before_epoch_s"), F.col("before.rss_mb").alias("before_rss_mb"),
        F.col("after.epoch_s").alias("after_epoch_s"), F.col("after.rss_mb").alias("after_rss_mb"),
        F.col("peak.seq").alias("peak_seq"), F.col("peak.rss_mb").alias("peak_rss_mb"),
        "duration_seconds", "rss_delta_mb", "vms_delta_mb"))


# Samples of one run are hours apart in the fixture; a 12 h interval makes the timer matter.
MONITOR_INTERVAL_S, MONITOR_CHUNK_S = 43200, 864000

QUERIES = {
    "memory_spikes": lambda s, d: flat(memory_spikes_batch(samples(s, d), bucket_seconds=MONITOR_CHUNK_S)),
    "monitor_emit": lambda s, d: flat(monitor_emissions_batch(samples(s, d), log_interval_s=MONITOR_INTERVAL_S,
                                                              chunk_seconds=MONITOR_CHUNK_S)),
    "samples_scan": lambda s, d: flat(_samples(s, d).select(
        "run_id", "seq", "epoch_s", sm.bytes_to_mb(F.col("rss_bytes")).alias("rss_mb"), "vms_mb", "available_mb",
        "percent", "elapsed_s")),
    "job_mem_stats": lambda s, d: _stats_cols(stats(s, d)),
    "snapshot_delta": lambda s, d: flat(stats(s, d).select("run_id", "rss_delta_mb", "vms_delta_mb")),
    "job_status_line": lambda s, d: sm.with_outcomes(stats(s, d), run_outcomes(s, d)).select("run_id", job_status_line(
        F.concat(F.lit("run_"), F.col("run_id").cast("string")), F.col("success"), F.col("duration_seconds"),
        F.col("rss_delta_mb"), F.col("vms_delta_mb"), F.col("peak.rss_mb")).alias("line")),
    "running_peak": lambda s, d: flat(sm.with_running_peak(samples(s, d)).select("run_id", "seq", "running_peak")),
    "peak_updates": lambda s, d: sm.with_running_peak(samples(s, d)).select("run_id", "seq", "is_new_peak"),
    "limit_verdict": lambda s, d: flat(sm.limit_verdicts(samples(s, d), **VERDICT_LIMITS).select(
        "run_id", "seq", "returncode", "message")),
    "profiler_totals": lambda s, d: flat(sm.profiler_totals(stats(s, d))),
    "oom_culprits": lambda s, d: flat(sm.oom_culprits(stats(s, d)).select(
        "run_id", "rss_delta_mb", F.col("peak.rss_mb").alias("peak_rss_mb"))),
    "culprits_sorted": lambda s, d: flat(sm.oom_culprits(stats(s, d), delta_mb=100, peak_mb=450).select(
        "run_id", "rss_delta_mb")),
    "high_memory_jobs": lambda s, d: sm.high_memory_runs(stats(s, d)),
}
