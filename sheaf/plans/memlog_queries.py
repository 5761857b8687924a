"""Registered leak-analysis queries over fixture F1 (memory log rendered from ``events``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.memlog import parse_memlog, render_memlog_message
from sheaf.operators import leaks
from sheaf.plans.common import flat, ts_text
from sheaf.plans.fixtures import memlog_lines
from sheaf.session import cut_lineage

CONTAINER_LIMIT_MB = 2048.0


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Parsed once per query into the shared checkpoint folder and read by every branch of its plan (pairing,
    # per-job and global aggregates). The files go when the plan is no longer referenced.
    return cut_lineage(parse_memlog(memlog_lines(spark, sf_dir)))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For plans with one branch: nothing is stored."""
    return parse_memlog(memlog_lines(spark, sf_dir))


def _stats(spark, sf_dir, limit=CONTAINER_LIMIT_MB):
    return leaks.job_stats(entries(spark, sf_dir), container_limit_mb=limit)


def q_memlog_lines(spark, sf_dir):
    return memlog_lines(spark, sf_dir).select("line_no", "line")


def q_memlog_parse(spark, sf_dir):
    return flat(parsed(spark, sf_dir).drop("log_id", "block"))


def q_ts_parse(spark, sf_dir):
    e = parsed(spark, sf_dir)
    return e.select("line_no", ts_text("ts").alias("ts"), F.year("ts").alias("yr"),
                    F.hour("ts").alias("hr"), F.second("ts").alias("sec"))


def q_entries_sorted(spark, sf_dir):
    return flat(leaks.sort_entries(entries(spark, sf_dir)).select("line_no", "ts", "log_type", "job_name"))


def q_start_end_pairs(spark, sf_dir):
    p = leaks.pair_starts_ends(entries(spark, sf_dir))
    return flat(p.select("line_no", "job_name", "end_ts", "start_ts"))


def q_orphaned_jobs(spark, sf_dir):
    return flat(leaks.orphaned_jobs(entries(spark, sf_dir)))


def q_job_run_counts(spark, sf_dir):
    return _stats(spark, sf_dir).select("job_name", "run_count", "orphaned_count")


def q_job_rss_delta(spark, sf_dir):
    return flat(_stats(spark, sf_dir).select("job_name", "avg_rss_delta", "total_rss_delta", "stddev_rss_delta"))


def q_job_vms_delta(spark, sf_dir):
    return flat(_stats(spark, sf_dir).select("job_name", "avg_vms_delta"))


def q_job_peak_rss(spark, sf_dir):
    return flat(_stats(spark, sf_dir).select("job_name", "avg_peak_rss", "max_peak_rss"))


def q_job_growth_rate(spark, sf_dir):
    return flat(_stats(spark, sf_dir).select("job_name", "rss_growth_rate_mb_per_hour"))


def q_job_baseline_shift(spark, sf_dir):
    return flat(_stats(spark, sf_dir).select("job_name", "baseline_shift_mb"))


def q_job_cumulative_impact(spark, sf_dir):
    return flat(_stats(spark, sf_dir).select("job_name", "run_count", "cumulative_impact"))


def q_job_headroom(spark, sf_dir):
    return flat(_stats(spark, sf_dir).select("job_name", "headroom_consumed_percent"))


def q_job_time_to_oom(spark, sf_dir):
    return flat(_stats(spark, sf_dir).select("job_name", "time_to_oom_hours"))


def q_global_delta_stats(spark, sf_dir):
    return flat(leaks.global_delta_stats(entries(spark, sf_dir)))


def q_outlier_threshold_cross(spark, sf_dir):
    e = entries(spark, sf_dir)
    thr = leaks.global_delta_stats(e).select("outlier_threshold").scalar()
    return flat(leaks.job_stats(e).select("job_name", "avg_rss_delta", thr.alias("outlier_threshold")))


def q_job_outliers(spark, sf_dir):
    return _stats(spark, sf_dir).select("job_name", "is_statistical_outlier")


def q_job_stats_full(spark, sf_dir):
    return flat(_stats(spark, sf_dir))


def q_leak_scores(spark, sf_dir):
    return flat(_stats(spark, sf_dir).select("job_name", "leak_score"))


def q_analysis_overview(spark, sf_dir):
    return flat(leaks.analysis_overview(entries(spark, sf_dir), container_limit_mb=CONTAINER_LIMIT_MB))


def q_top_culprits(spark, sf_dir):
    return flat(leaks.top_culprits(_stats(spark, sf_dir), hide_below=None)
                .select("rank", "job_name", "leak_score", "orphaned_count", "run_count"))


def q_leak_rank(spark, sf_dir):
    """W1 + F-8: ranks of the top ten, negligible scores hidden after ranking."""
    return flat(leaks.top_culprits(_stats(spark, sf_dir)).select("rank", "job_name", "leak_score"))


def q_negligible_score(spark, sf_dir):
    """F-8 on every job: which would be hidden from the report."""
    return _stats(spark, sf_dir).select("job_name", (F.col("leak_score") < 1).alias("hidden"))


def q_leak_indicators(spark, sf_dir):
    return _stats(spark, sf_dir).select("job_name", F.array_join(leaks.leak_indicators(), ", ").alias("indicators"))


def q_severity_label(spark, sf_dir):
    return _stats(spark, sf_dir).select("job_name", leaks.severity_label().alias("severity"))


def q_time_to_oom_band(spark, sf_dir):
    return _stats(spark, sf_dir).select("job_name", leaks.time_to_oom_band(F.col("time_to_oom_hours")).alias("band"))


def q_last_monitor_before_crash(spark, sf_dir):
    return flat(leaks.last_monitor_before_crash(entries(spark, sf_dir)))


def q_log_render(spark, sf_dir):
    """The profiler's message text re-rendered from parsed START / END / MONITOR entries."""
    e = entries(spark, sf_dir)
    m = {c: F.col(c) for c in ("rss_mb", "vms_mb", "memory_percent", "system_available_mb", "elapsed", "current_rss_mb",
                               "peak_rss_mb", "duration", "rss_before", "rss_after", "rss_delta", "vms_delta", "peak_rss")}
    m["current_vms_mb"] = F.col("current_rss_mb") + 300  # the analyzer drops it; the fixture's rule restores it
    m["system_available_mb"] = F.coalesce(F.col("system_available_mb"), 8000 - F.col("current_rss_mb"))
    return e.select("line_no", render_memlog_message(F.col("log_type"), F.col("job_name"), m).alias("message"))


QUERIES = {
    "log_render": q_log_render,
    "memlog_lines": q_memlog_lines,
    "memlog_parse": q_memlog_parse,
    "ts_parse": q_ts_parse,
    "entries_sorted": q_entries_sorted,
    "start_end_pairs": q_start_end_pairs,
    "orphaned_jobs": q_orphaned_jobs,
    "job_run_counts": q_job_run_counts,
    "job_rss_delta": q_job_rss_delta,
    "job_vms_delta": q_job_vms_delta,
    "job_peak_rss": q_job_peak_rss,
    "job_growth_rate": q_job_growth_rate,
    "job_baseline_shift": q_job_baseline_shift,
    "job_cumulative_impact": q_job_cumulative_impact,
    "job_headroom": q_job_headroom,
    "job_time_to_oom": q_job_time_to_oom,
    "global_delta_stats": q_global_delta_stats,
    "outlier_threshold_cross": q_outlier_threshold_cross,
    "job_outliers": q_job_outliers,
    "job_stats_full": q_job_stats_full,
    "leak_scores": q_leak_scores,
    "analysis_overview": q_analysis_overview,
    "top_culprits": q_top_culprits,
    "leak_rank": q_leak_rank,
    "negligible_score": q_negligible_score,
    "leak_indicators": q_leak_indicators,
    "severity_label": q_severity_label,
    "time_to_oom_band": q_time_to_oom_band,
    "last_monitor_before_crash": q_last_monitor_before_crash,
}
