"""Batch forms of the monitor-emission timer (T2) and of the spike ratchet (T3): exact, no run in one task.

T2, per run in order of (epoch_s, seq), the first sample seeding the peak: a monitored sample is logged when
it is a strict new peak or when at least ``interval`` seconds passed since the last logged sample (which starts at 0);
a log resets the timer. That is a chain (``chains``) along time whose sure rows are new peaks and samples after a gap.

T3: a sample is reported when it exceeds the last reported value by more than ``step`` MB (which starts at 0). Only
strict new peaks can be, so it is a chain along the values of the new peaks.

The running peak, the sample before and the number of samples before come from one bucketed pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.operators.carry import carry_in
from sheaf.operators.chains import Chain, chain_marks

LOG_INTERVAL_S = 30.0
SPIKE_STEP_MB = 100.0
ORDER = ["epoch_s", "seq"]


def with_history(samples: DataFrame, key: str, bucket_seconds: float) -> DataFrame:
    """Adds ``_b`` (time bucket), ``_peak`` (highest rss before), ``_at`` (time of the sample before), ``_n`` (samples before)
    and ``_head`` (first of its bucket)."""
    s = samples.withColumn("_b", F.floor(F.col("epoch_s") / F.lit(float(bucket_seconds))).cast("long"))
    w = Window.partitionBy(key, "_b").orderBy(*ORDER)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    tails = s.groupBy(key, "_b").agg(F.struct(F.max("rss_mb").alias("peak"), F.max("epoch_s").cast("double").alias("at"),
                                              F.count(F.lit(1)).alias("n")).alias("_tail"))
    both = lambda f: lambda x, *_: F.struct(f(F.max, x["peak"]).alias("peak"), f(F.max, x["at"]).alias("at"), f(F.sum, x["n"]).alias("n"))
    merge = lambda near, far: F.struct(F.greatest(near["peak"], far["peak"]).alias("peak"), F.greatest(near["at"], far["at"]).alias("at"),
                                       (F.coalesce(near["n"], F.lit(0)) + F.coalesce(far["n"], F.lit(0))).alias("n"))
    carry = carry_in(tails, [key], "_b", both(lambda f, c: f(c)), lambda x, w: both(lambda f, c: f(c).over(w))(x), merge)
    local = s.withColumn("_near", F.struct(F.max("rss_mb").over(before).alias("peak"), F.lag("epoch_s").over(w).cast("double").alias("at"),
                                           (F.row_number().over(w) - 1).alias("n")))
    joined = local.join(carry, [key, "_b"], "left").withColumn("_all", merge(F.col("_near"), F.col("_carry")))
    return joined.select(*samples.columns, "_b", F.col("_all.peak").alias("_peak"), F.col("_all.at").alias("_at"),
                         F.col("_all.n").alias("_n"), (F.col("_near.n") == 0).alias("_head"))


def monitor_emissions_batch(samples: DataFrame, *, log_interval_s: float = LOG_INTERVAL_S, chunk_seconds: float = 3600,
                            key: str = "run_id") -> DataFrame:
    """T2 (batch): the samples the profiler's monitor would log, with the running peak.

    ``key`` may have any type; ``epoch_s`` may have fractions (microseconds are told apart). Times count from 1970, so
    a run's first monitored sample is logged unless it lies within an interval of that.
    """
    chain = Chain(log_interval_s * 1e6, chunk_seconds * 1e6)
    s = with_history(samples.select(key, "seq", "epoch_s", "rss_mb"), key, chunk_seconds).where("_n > 0")
    micros = lambda c: F.round(c * 1e6)  # noqa: E731  whole numbers, so that distances are exact
    x = micros(F.col("epoch_s").cast("double"))
    new_peak = F.coalesce(F.col("rss_mb") > F.col("_peak"), F.lit(False))
    before = F.when(F.col("_n") > 1, micros(F.col("_at"))).otherwise(F.lit(0.0))
    rows = s.select(key, F.col("_b").alias("chunk"), x.alias("x"), (new_peak | chain.beyond(x, before)).alias("sure"),
                    (F.col("_head") | (F.col("_n") == 1)).alias("head"), "seq", "epoch_s", "rss_mb",
                    F.greatest("rss_mb", "_peak").alias("peak_rss_mb"), new_peak.alias("new_peak"))
    # the seed is not monitored: a chunk that it heads begins with the sample after it
    return chain_marks(rows, key, ["x", "seq"], chain).select(key, "seq", "epoch_s", "rss_mb", "peak_rss_mb", "new_peak")


def memory_spikes_batch(samples: DataFrame, *, step_mb: float = SPIKE_STEP_MB, chunk_mb: float = 10_000, bucket_seconds: float = 3600,
                        key: str = "run_id") -> DataFrame:
    """T3 (batch): samples reported by the converter's ratchet (rss above the last reported value + ``step_mb``; the last
    value starts at 0). ``key`` may have any type; samples without rss are never reported."""
    chain = Chain(step_mb, chunk_mb, strict=True)
    s = with_history(samples.select(key, "seq", "epoch_s", "rss_mb"), key, bucket_seconds)
    x, before = F.col("rss_mb"), F.greatest(F.col("_peak"), F.lit(0.0))
    peaks = s.where(x > before).select(
        key, chain.chunk_of(x).alias("chunk"), x.alias("x"), chain.beyond(x, before).alias("sure"), "seq", "epoch_s", "rss_mb")
    first = Window.partitionBy(key, "chunk").orderBy("x")
    rows = peaks.withColumn("head", F.row_number().over(first) == 1)
    return chain_marks(rows, key, ["x"], chain).select(key, "seq", "epoch_s", "rss_mb")
