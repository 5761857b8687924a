"""Stateful stream operators built on :func:`ordered_fold` (T2, T3, T4, T6) and
stateless / aggregate ones (T1, T8)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from sheaf.functions.memlog import parse_memlog
from sheaf.operators.leaks import epoch_seconds
from sheaf.sources.text import stream_log_lines
from sheaf.streaming.ordered import ordered_fold

LOG_INTERVAL_S = 30.0
SPIKE_STEP_MB = 100.0
MAX_AGE_S = 300
IDLE_MS = 86_400_000
TERMINAL = ("success", "failure")


def stream_memlog(spark: SparkSession, path: str, **parse_args) -> DataFrame:
    """Parsed memory-log entries from an arriving directory of log files, read in splits."""
    return parse_memlog(stream_log_lines(spark, path), **parse_args)


def _orphan_step(max_age_s: float):
    limit_ms = int(max_age_s * 1000)

    def step(st, rows: pd.DataFrame, wm, more):
        # st: {"latest": ts_ms of the newest START, "open": {ts_ms: attrs}}. Rows with one
        # timestamp always arrive in the same call, so keys closed here cannot reopen later.
        # Only the newest START can still be closed, so the others leave before more rows come.
        opened = st.setdefault("open", {})
        closed = set()
        for r in rows.itertuples(index=False):
            key = str(r.ts)
            if r.log_type == "START":
                if key not in closed:
                    opened[key] = [r.rss_mb, r.vms_mb, r.memory_percent, r.system_available_mb]
                st["latest"] = key
            elif r.log_type == "END" and st.get("latest") is not None:
                opened.pop(st["latest"], None)
                closed.add(st["latest"])
        out = []
        for key in sorted(list(opened), key=int):
            if int(key) + limit_ms < wm and not (more and key == st["latest"]):
                a = opened.pop(key)
                nz = lambda v: 0.0 if v is None or v != v else float(v)
                out.append({"start_ms": int(key), "rss_at_start": nz(a[0]), "vms_at_start": nz(a[1]),
                            "memory_percent_at_start": nz(a[2]), "system_available_at_start": nz(a[3])})
        return st, out

    return step


def stream_orphans(entries: DataFrame, *, max_age_s: float = MAX_AGE_S, watermark: str = "10 seconds", grace: str | None = None,
                   idle_ms: int | None = None, late_rows: bool = False) -> DataFrame:
    """STARTs still open ``max_age_s`` after they began, once the watermark
    passes that point (append mode; a later END cannot retract the row).

    Pairing follows the batch rule: an END closes the newest START of its job
    seen before it in (ts, file order); the newest START stays in state even
    when closed or reported, until the job has been idle for ``idle_ms`` (``max_age_s`` at least, twice that by default).
    By then every open START has been reported, so an END that comes afterwards finds
    nothing to close, and none that it might close wrongly. MONITOR lines move the watermark too.

    With ``late_rows`` the result also has START and END lines that came behind the watermark, up to ``grace``: late, late_row
    (JSON) and job_name.
    """
    e = entries.select("job_name", "ts", "log_id", "block", "line_no", "log_type", "rss_mb", "vms_mb", "memory_percent",
                       "system_available_mb")
    e = e.withColumn("ts", F.floor(epoch_seconds(F.col("ts")) * 1000).cast("long"))  # epoch ms, zone-free
    limit = int(max_age_s * 1000)
    wake = lambda st: (min(int(k) for k in st.get("open", {})) + limit + 1) if st.get("open") else None
    out = ordered_fold(e, key="job_name", ts_col="ts", order=["log_id", "block", "line_no"],
                       step=_orphan_step(max_age_s), watermark=watermark, grace=grace, wake_after_ms=wake,
                       idle_ms=max(limit, 2 * limit if idle_ms is None else idle_ms), keep=F.col("log_type").isin("START", "END"),
                       out_schema="job_name string, start_ms long, rss_at_start double, vms_at_start double, "
                                  "memory_percent_at_start double, system_available_at_start double")
    epoch0 = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    out = out if late_rows else out.where("not late")
    return out.select("job_name", F.timestamp_add("MILLISECOND", F.col("start_ms"), epoch0).alias("start_time"),
                      "rss_at_start", "vms_at_start", "memory_percent_at_start", "system_available_at_start",
                      *(["late", "late_row"] if late_rows else []))


def _monitor_step(log_interval_s: float):
    def step(st, rows, wm, more):
        out = []
        for r in rows.itertuples(index=False):
            t = r.epoch_s
            if st.get("peak") is None:  # first sample: the "before" snapshot seeds the peak
                st["peak"], st["last"] = r.rss_mb, 0.0
                continue
            new_peak = r.rss_mb > st["peak"]
            if new_peak:
                st["peak"] = r.rss_mb
            if new_peak or (t - st["last"] >= log_interval_s):
                out.append({"run_id": None, "seq": r.seq, "epoch_s": t, "rss_mb": r.rss_mb, "peak_rss_mb": st["peak"],
                            "new_peak": bool(new_peak)})
                st["last"] = t
        return st, out
    return step


def _millis(samples: DataFrame) -> DataFrame:
    return samples.withColumn("ts", F.floor(F.col("epoch_s") * 1000).cast("long"))


def monitor_emissions(samples: DataFrame, *, log_interval_s: float = LOG_INTERVAL_S, watermark: str = "10 seconds",
                      idle_ms: int = IDLE_MS) -> DataFrame:
    """Which samples the profiler logs: a new peak, or ``log_interval_s`` since
    the last logged sample (an emission resets the timer). A run that is idle for ``idle_ms`` ends; samples after
    that are a new run. Samples without rss only move the watermark."""
    schema = f"run_id {samples.schema['run_id'].dataType.simpleString()}, seq long, epoch_s {samples.schema['epoch_s'].dataType.simpleString()}"
    return ordered_fold(_millis(samples), key="run_id", ts_col="ts", order=["seq"], step=_monitor_step(log_interval_s),
                        watermark=watermark, idle_ms=idle_ms, keep=F.col("rss_mb").isNotNull(),
                        out_schema=schema + ", rss_mb double, peak_rss_mb double, new_peak boolean").where("not late").drop("late", "late_row")


def _spike_step(step_mb: float):
    def step(st, rows, wm, more):
        out = []
        last = st.get("last", 0.0)
        for r in rows.itertuples(index=False):
            if r.rss_mb > last + step_mb:
                out.append({"run_id": None, "seq": r.seq, "epoch_s": r.epoch_s, "rss_mb": r.rss_mb})
                last = r.rss_mb
        st["last"] = last
        return st, out
    return step


def memory_spikes(samples: DataFrame, *, step_mb: float = SPIKE_STEP_MB, watermark: str = "10 seconds",
                  idle_ms: int = IDLE_MS) -> DataFrame:
    """Ratchet - report a sample when it exceeds the last reported value by ``step_mb``. State ends as in T2."""
    schema = f"run_id {samples.schema['run_id'].dataType.simpleString()}, seq long, epoch_s {samples.schema['epoch_s'].dataType.simpleString()}"
    return ordered_fold(_millis(samples), key="run_id", ts_col="ts", order=["seq"], step=_spike_step(step_mb), watermark=watermark,
                        idle_ms=idle_ms, keep=F.col("rss_mb").isNotNull(),
                        out_schema=schema + ", rss_mb double").where("not late").drop("late", "late_row")


def task_status_stream(events: DataFrame, *, watermark: str = "10 seconds", keep_ms: int = 3_600_000, idle_ms: int = IDLE_MS) -> DataFrame:
    """Latest status per task, frozen at the first terminal one; a row whenever it changes (update mode).

    A task's state stays for ``keep_ms`` of event time after its terminal status, so that events which come out of order
    meet it, and for ``idle_ms`` after its last event if it never ends; then it is removed. An event with an earlier
    terminal status than the one reported corrects it. Events of a removed task start a new one.
    """
    kind = events.schema["task_id"].dataType.simpleString()
    rows = events.select("task_id", F.floor(epoch_seconds(F.col("event_ts").cast("timestamp_ntz")) * 1e6).cast("long").alias("at"),
                         "seq", "task_status", "progress")
    rows = rows.withColumn("_event_time", F.timestamp_micros("at"))

    def fn(k, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        best = state.get if state.exists else None
        before = best
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                new = (int(r.at), int(r.seq), r.task_status, None if pd.isna(r.progress) else float(r.progress), r.task_status in TERMINAL)
                if best is None or (new[4], *(-x if new[4] else x for x in new[:2])) > (best[4], *(-x if best[4] else x for x in best[:2])):
                    best = new
        if best != before:
            state.update(best)
            yield pd.DataFrame([(k[0], best[2], best[3])], columns=["task_id", "task_status", "progress"])
        state.setTimeoutTimestamp(max(best[0] // 1000 + (keep_ms if best[4] else idle_ms), state.getCurrentWatermarkMs()) + 1)

    return rows.withWatermark("_event_time", watermark).groupBy("task_id").applyInPandasWithState(
        fn, f"task_id {kind}, task_status string, progress double", "at long, seq long, task_status string, progress double, terminal boolean",
        "update", GroupStateTimeout.EventTimeTimeout)
