"""Leak analysis over parsed memory-log entries (J1, J2, J6, J7, C1-C13, W1, W4, S1, F-8, S4).

Input is the output of ``functions.memlog.parse_memlog``. Ordering rules:

* START/END pairing sorts by ``(ts, file order)``: a stable sort by time.
* Baseline shift, the overview's first/last values and the time range use file
  order ``(log_id, block, line_no)`` only.

Shuffles: the pairing runs per (job, time bucket) with a small per-bucket carry,
so a job that owns most of the log still spreads over many tasks; the per-job
statistics are partial/final aggregates (map-side combine), and global figures
are scalar subqueries (one row, no join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.operators.carry import carry_last

FILE_ORDER = ["log_id", "block", "line_no"]
# Defaults of the analyzer's constructor.
GROWTH_RATE_THRESHOLD = 1.0
BASELINE_SHIFT_THRESHOLD = 10.0
AVG_DELTA_THRESHOLD = 0.5
TOP_N = 10


def file_order() -> Column:
    return F.struct(*[F.col(c) for c in FILE_ORDER])


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 for a timestamp_ntz, independent of the session zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts) / 1e6


def time_bucket(ts: Column, bucket_seconds: int) -> Column:
    return F.floor(epoch_seconds(ts) / F.lit(float(bucket_seconds))).cast("long")


def with_bucket(entries: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """Add the time bucket ``_tb`` unless present (keeps an upstream partitioning usable)."""
    if "_tb" in entries.columns:
        return entries
    return entries.withColumn("_tb", time_bucket(F.col("ts"), bucket_seconds))


def sort_entries(entries: DataFrame, order_by: str = "ts") -> DataFrame:
    """Stable sort by timestamp (file order breaks ties)."""
    keys = ["ts", *FILE_ORDER] if order_by == "ts" else FILE_ORDER
    return entries.orderBy(*keys)


def pair_starts_ends(entries: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """Every END with the latest START of its job at or before it.

    A START is not consumed: several ENDs may take the same START. Returns
    job_name, end_ts, file-order columns and ``start_ts`` (NULL when no START came
    before).
    """
    se = (with_bucket(entries, bucket_seconds).where(F.col("log_type").isin("START", "END"))
          .select("job_name", "ts", "log_type", *FILE_ORDER, "_tb"))
    carried = carry_last(se, keys=["job_name"], bucket="_tb", order=["ts", *FILE_ORDER],
                         value=F.when(F.col("log_type") == "START", F.col("ts")), out="start_ts")
    return (carried.where(F.col("log_type") == "END")
            .select("job_name", F.col("ts").alias("end_ts"), *FILE_ORDER, "start_ts"))


def orphaned_jobs(entries: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """STARTs, keyed by (job, second), that no END took.

    Attributes come from the last START in file order with that key; missing
    values read as 0.0.
    """
    completed = (pair_starts_ends(entries, bucket_seconds)
                 .where(F.col("start_ts").isNotNull())
                 .select("job_name", F.col("start_ts").alias("ts")).distinct())
    starts = (entries.where(F.col("log_type") == "START")
              .groupBy("job_name", "ts")
              .agg(F.max_by(F.struct("rss_mb", "vms_mb", "memory_percent", "system_available_mb"),
                            F.struct(*FILE_ORDER)).alias("a")))
    orphans = starts.join(completed, on=["job_name", "ts"], how="left_anti")
    return orphans.select(
        "job_name", F.col("ts").alias("start_time"),
        F.coalesce(F.col("a.rss_mb"), F.lit(0.0)).alias("rss_at_start"),
        F.coalesce(F.col("a.vms_mb"), F.lit(0.0)).alias("vms_at_start"),
        F.coalesce(F.col("a.memory_percent"), F.lit(0.0)).alias("memory_percent_at_start"),
        F.coalesce(F.col("a.system_available_mb"), F.lit(0.0)).alias("system_available_at_start"))


def end_stats(entries: DataFrame) -> DataFrame:
    """C1-C6 inputs: one row per job with completed runs (END lines only)."""
    ends = entries.where(F.col("log_type") == "END")
    has_after = F.col("rss_after").isNotNull()
    ordered = F.when(has_after, file_order())
    return ends.groupBy("job_name").agg(
        F.count(F.lit(1)).alias("run_count"),
        F.count("rss_delta").alias("n_deltas"),
        F.avg("rss_delta").alias("avg_rss_delta"),
        F.sum("rss_delta").alias("total_rss_delta"),
        F.stddev_samp("rss_delta").alias("stddev_rss_delta"),
        F.avg("vms_delta").alias("avg_vms_delta"),
        F.avg("peak_rss").alias("avg_peak_rss"),
        F.max("peak_rss").alias("max_peak_rss"),
        F.count("rss_after").alias("n_points"),
        # Least squares of rss_after over time; slope is shift invariant.
        F.regr_slope(F.col("rss_after"), F.when(has_after, epoch_seconds(F.col("ts")))).alias("slope_per_s"),
        # File order, not time order.
        F.min_by(F.col("rss_after"), ordered).alias("first_rss_after"),
        F.max_by(F.col("rss_after"), ordered).alias("last_rss_after"),
    )


def global_delta_stats(entries: DataFrame) -> DataFrame:
    """Mean and sample stddev over every END delta, and the outlier threshold."""
    d = entries.where(F.col("log_type") == "END").agg(
        F.count("rss_delta").alias("n"), F.avg("rss_delta").alias("m"), F.stddev_samp("rss_delta").alias("s"))
    mean = F.coalesce(F.col("m"), F.lit(0.0))
    sd = F.when(F.col("n") > 1, F.col("s")).otherwise(F.lit(0.0))
    return d.select(F.col("n").alias("n_deltas"), mean.alias("global_avg_delta"),
                    sd.alias("global_stddev_delta"), (mean + 2 * sd).alias("outlier_threshold"))


def job_stats(entries: DataFrame, *, container_limit_mb: float | None = None,
              growth_rate_threshold: float = GROWTH_RATE_THRESHOLD,
              baseline_shift_threshold: float = BASELINE_SHIFT_THRESHOLD,
              avg_delta_threshold: float = AVG_DELTA_THRESHOLD,
              bucket_seconds: int = 3600) -> DataFrame:
    """J7 + C1-C12: one record per job that has an orphan or a completed run."""
    orphan_counts = (orphaned_jobs(entries, bucket_seconds).groupBy("job_name")
                     .agg(F.count(F.lit(1)).alias("orphaned_count")))
    js = orphan_counts.join(end_stats(entries), on="job_name", how="full")
    zero = F.lit(0.0)
    c = {
        "run_count": F.coalesce(F.col("run_count"), F.lit(0)).cast("long"),
        "orphaned_count": F.coalesce(F.col("orphaned_count"), F.lit(0)).cast("long"),
        "avg_rss_delta": F.coalesce(F.col("avg_rss_delta"), zero),
        "total_rss_delta": F.when(F.col("n_deltas") > 0, F.col("total_rss_delta")).otherwise(zero),
        "stddev_rss_delta": F.when(F.col("n_deltas") > 1, F.col("stddev_rss_delta")).otherwise(zero),
        "avg_vms_delta": F.coalesce(F.col("avg_vms_delta"), zero),
        "avg_peak_rss": F.coalesce(F.col("avg_peak_rss"), zero),
        "max_peak_rss": F.coalesce(F.col("max_peak_rss"), zero),
        "rss_growth_rate_mb_per_hour": F.when(F.col("n_points") >= 2,
                                              F.coalesce(F.col("slope_per_s"), zero) * 3600).otherwise(zero),
        "baseline_shift_mb": F.when(F.col("n_points") >= 2,
                                    F.col("last_rss_after") - F.col("first_rss_after")).otherwise(zero),
    }
    js = js.select("job_name", *[v.alias(k) for k, v in c.items()])
    js = js.withColumn("cumulative_impact", F.col("run_count") * F.col("avg_rss_delta"))

    # Only with a truthy container limit and a positive average peak.
    if container_limit_mb:
        lim = F.lit(float(container_limit_mb))
        ok = F.col("avg_peak_rss") > 0
        headroom = lim - F.col("avg_peak_rss")
        js = js.withColumn("headroom_consumed_percent",
                           F.when(ok, F.col("avg_peak_rss") / lim * 100).otherwise(zero))
        js = js.withColumn("time_to_oom_hours",
                           F.when(ok & (F.col("rss_growth_rate_mb_per_hour") > 0) & (headroom > 0),
                                  headroom / F.col("rss_growth_rate_mb_per_hour")))
    else:
        js = js.withColumn("headroom_consumed_percent", zero) \
            .withColumn("time_to_oom_hours", F.lit(None).cast("double"))

    # The global threshold is a scalar subquery, applied to every job.
    g = global_delta_stats(entries).select(F.struct("n_deltas", "outlier_threshold").alias("g")).scalar()
    js = js.withColumn("is_statistical_outlier",
                       (g.getField("n_deltas") > 0) & (F.col("avg_rss_delta") > g.getField("outlier_threshold")))

    # Weighted score, terms added in a fixed order.
    score = F.col("orphaned_count") * 10000.0
    score = score + F.when(F.col("rss_growth_rate_mb_per_hour") > growth_rate_threshold,
                           F.col("rss_growth_rate_mb_per_hour") * 40).otherwise(zero)
    score = score + F.when(F.col("avg_rss_delta") > avg_delta_threshold,
                           F.col("avg_rss_delta") * 20).otherwise(zero)
    score = score + F.when(F.col("baseline_shift_mb") > baseline_shift_threshold,
                           F.col("baseline_shift_mb") * 15).otherwise(zero)
    score = score + F.abs(F.col("avg_vms_delta")) * 10
    score = score + F.col("cumulative_impact") * 10
    score = score + F.when(F.col("is_statistical_outlier"), F.lit(5.0)).otherwise(zero)
    return js.withColumn("leak_score", score)


def leak_indicators() -> Column:
    """Fixed thresholds, as the report prints them (they ignore configured ones)."""
    return F.array_compact(F.array(
        F.when(F.col("orphaned_count") > 0, F.lit("ORPHANED_JOB")),
        F.when(F.col("rss_growth_rate_mb_per_hour") > 1.0, F.lit("GROWTH_RATE")),
        F.when(F.col("avg_rss_delta") > 0.5, F.lit("AVG_DELTA")),
        F.when(F.col("baseline_shift_mb") > 10, F.lit("BASELINE_SHIFT"))))


def severity_label() -> Column:
    """P14."""
    return (F.when(F.col("orphaned_count") > 0, F.lit("CRITICAL - CAUSED CRASH"))
            .when(F.col("leak_score") > 50, F.lit("HIGH PRIORITY")).otherwise(F.lit("")))


def time_to_oom_band(hours: Column) -> Column:
    """<24 h in hours (critical), <168 h in days (warning), else days."""
    return (F.when(hours.isNull(), F.lit(None))
            .when(hours < 24, F.format_string("%.1f hours [CRITICAL]", hours))
            .when(hours < 168, F.format_string("%.1f days [WARNING]", hours / 24))
            .otherwise(F.format_string("%.1f days", hours / 24)))


def top_culprits(stats: DataFrame, n: int = TOP_N, hide_below: float | None = 1.0) -> DataFrame:
    """S1 + W1 + F-8: top ``n`` by score (ties by job name), numbered 1..n.

    The limit is the feature (a top-k report): Spark plans it as
    TakeOrderedAndProject, so only ``n`` rows per partition travel. The rank is
    numbered on that bounded slice; ``hide_below`` drops negligible scores after
    ranking so the numbers keep their gaps.
    """
    order = [F.col("leak_score").desc(), F.col("job_name")]
    top = stats.orderBy(*order).limit(n)
    # The window sees at most n rows (the limited slice), never the full table.
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    if hide_below is not None:
        ranked = ranked.where(F.col("leak_score") >= hide_below)
    return ranked


def analysis_overview(entries: DataFrame, *, container_limit_mb: float | None = None,
                      bucket_seconds: int = 3600) -> DataFrame:
    """One row. Fails at run time on an empty log, as the analyzer does."""
    end = F.col("log_type") == "END"
    ov = entries.agg(
        F.count(F.lit(1)).alias("total_entries"),
        F.min_by("ts", file_order()).alias("first_ts"),
        F.max_by("ts", file_order()).alias("last_ts"),
        F.count_if(end).alias("n_end"),
        F.min_by("rss_before", F.when(end, file_order())).alias("first_rss"),
        F.max_by("rss_after", F.when(end, file_order())).alias("last_rss"))
    jobs = (orphaned_jobs(entries, bucket_seconds).select("job_name")
            .unionByName(entries.where(end).select("job_name")).distinct())
    gs = global_delta_stats(entries).select(F.struct("global_avg_delta", "global_stddev_delta").alias("g")).scalar()
    zero = F.lit(0.0)
    truthy = lambda c: c.isNotNull() & (c != 0)
    growth = F.when((F.col("n_end") > 0) & truthy(F.col("first_rss")) & truthy(F.col("last_rss")),
                    F.col("last_rss") - F.col("first_rss")).otherwise(zero)
    hours = (epoch_seconds(F.col("last_ts")) - epoch_seconds(F.col("first_ts"))) / 3600
    current = F.when(F.col("n_end") > 0, F.col("last_rss"))
    out = ov.select(
        F.when(F.col("total_entries") == 0, F.raise_error(F.lit("No log entries to analyze")))
        .otherwise(F.col("total_entries")).cast("long").alias("total_entries"),
        jobs.select(F.count(F.lit(1))).scalar().alias("total_jobs_tracked"),
        F.col("first_ts").alias("time_range_start"), F.col("last_ts").alias("time_range_end"),
        growth.alias("overall_rss_growth"),
        F.when(hours > 0, growth / hours).otherwise(zero).alias("overall_growth_rate_mb_per_hour"),
        current.alias("current_rss_mb"),
        gs.getField("global_avg_delta").alias("global_avg_delta"),
        gs.getField("global_stddev_delta").alias("global_stddev_delta"))
    if container_limit_mb:
        lim = F.lit(float(container_limit_mb))
        avail = F.when(truthy(F.col("current_rss_mb")), lim - F.col("current_rss_mb"))
        out = out.withColumn("container_limit_mb", lim).withColumn("available_headroom_mb", avail) \
            .withColumn("headroom_percent", avail / lim * 100)
    else:
        nul = F.lit(None).cast("double")
        out = out.withColumn("container_limit_mb", nul).withColumn("available_headroom_mb", nul) \
            .withColumn("headroom_percent", nul)
    return out


def last_monitor_before_crash(entries: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """For every orphaned run, its last MONITOR sample before the next START."""
    rows = with_bucket(entries, bucket_seconds).where(F.col("log_type").isin("START", "MONITOR"))
    carried = carry_last(rows, keys=["job_name"], bucket="_tb", order=["ts", *FILE_ORDER],
                         value=F.when(F.col("log_type") == "START", F.col("ts")), out="run_start")
    last_mon = (carried.where((F.col("log_type") == "MONITOR") & F.col("run_start").isNotNull())
                .groupBy("job_name", "run_start")
                .agg(F.count(F.lit(1)).alias("monitor_samples"),
                     F.max_by(F.struct(F.col("ts").alias("last_monitor_ts"), "elapsed", "current_rss_mb",
                                       "peak_rss_mb", "memory_percent"),
                              F.struct("ts", *FILE_ORDER)).alias("m")))
    orph = orphaned_jobs(entries, bucket_seconds)
    return (orph.join(last_mon, (orph.job_name == last_mon.job_name) & (orph.start_time == last_mon.run_start),
                      "left")
            .select(orph.job_name, "start_time", F.coalesce("monitor_samples", F.lit(0)).alias("monitor_samples"),
                    "m.last_monitor_ts", "m.elapsed", "m.current_rss_mb", "m.peak_rss_mb", "m.memory_percent"))


def stale_runs(entries: DataFrame, now, max_age_s: float = 300, bucket_seconds: int = 3600) -> DataFrame:
    """T5 (batch): runs still open at ``now`` that started more than ``max_age_s`` earlier.

    ``now`` is a timestamp_ntz literal or column; the streaming form is
    ``streaming.folds.stream_orphans``.
    """
    now_c = F.lit(now).cast("timestamp_ntz") if not isinstance(now, Column) else now
    o = orphaned_jobs(entries, bucket_seconds)
    age = epoch_seconds(now_c) - epoch_seconds(F.col("start_time"))
    return o.withColumn("age_seconds", age).where(F.col("age_seconds") > max_age_s)
