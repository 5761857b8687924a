"""Memory-profiler log lines: parsing (P1, P2) and rendering.

Parsing is three regular expressions tried in a fixed order; the first that
matches anywhere in the line decides the entry type. Everything stays in JVM
expressions; numbers go through ``try_cast`` so a malformed value becomes NULL
instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# The line formats that must be recognised exactly as written by
# the profiler. Timestamp in brackets, then the tag, then fields in this order.
# ---------------------------------------------------------------------------
TS_STRICT = r"\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\]"
TS_LENIENT = r"\[?(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})(?:,\d{3})?\]?"
END_BODY = (r".*?\[MEMORY_TRACK_END\] job='([^']+)' duration=([\d.]+)s rss_before=([\d.]+)MB "
            r"rss_after=([\d.]+)MB rss_delta=([+-]?[\d.]+)MB vms_delta=([+-]?[\d.]+)MB peak_rss=([\d.]+)MB")
START_BODY = (r".*?\[MEMORY_TRACK_START\] job='([^']+)' rss_mb=([\d.]+) vms_mb=([\d.]+) "
              r"memory_percent=([\d.]+) system_available_mb=([\d.]+)")
MONITOR_BODY = (r".*?\[MEMORY_MONITOR\] job='([^']+)' elapsed=([\d.]+)s current_rss_mb=([\d.]+) "
                r"peak_rss_mb=([\d.]+) current_vms_mb=([\d.]+) system_available_mb=([\d.]+) "
                r"memory_percent=([\d.]+)")
END_FIELDS = ("duration", "rss_before", "rss_after", "rss_delta", "vms_delta", "peak_rss")
START_FIELDS = ("rss_mb", "vms_mb", "memory_percent", "system_available_mb")
# MONITOR lines also carry current_vms_mb and system_available_mb; the analyzer ignores both.
MONITOR_FIELDS = {"elapsed": 2, "current_rss_mb": 3, "peak_rss_mb": 4, "memory_percent": 7}

METRICS = ("rss_mb", "vms_mb", "rss_before", "rss_after", "rss_delta", "vms_delta", "peak_rss",
           "current_rss_mb", "peak_rss_mb", "duration", "memory_percent", "system_available_mb", "elapsed")


SEP = "\u0001"


def capture_groups(text: Column, pattern: str, ngroups: int, marker: str) -> Column:
    """All groups of the leftmost match of ``pattern`` in one regex pass.

    ``^.*?(pattern).*$`` tries start positions left to right exactly like a
    search, so the groups equal those of the first match. The result is
    ``marker SEP g1 SEP g2 ...``, or the text unchanged when nothing matches.
    """
    repl = marker + "".join(f"{SEP}${i}" for i in range(1, ngroups + 1))
    return F.regexp_replace(text, "(?s)^.*?" + pattern + ".*$", repl)


def parse_memlog(lines: DataFrame, lenient: bool = False, keep_rejects: bool = False,
                 failed_as_end: bool = False) -> DataFrame:
    """One row per recognised line.

    Output: log_id, block, line_no, ts (timestamp_ntz), log_type, job_name and the
    13 nullable metric columns. Unrecognised lines are dropped. With
    ``keep_rejects`` lines whose pattern matched but whose timestamp did not
    convert are kept with ``ts`` NULL; a malformed number is always NULL.
    ``failed_as_end`` reads MEMORY_TRACK_FAILED lines as completions (Q3).
    """
    ts = TS_LENIENT if lenient else TS_STRICT
    end_body = END_BODY.replace("MEMORY_TRACK_END", "MEMORY_TRACK_(?:END|FAILED)") if failed_as_end else END_BODY
    me, ms, mm = "\u0002E", "\u0002S", "\u0002M"
    line = F.col("line")
    # Each pattern contains its tag literally: the tag test only skips hopeless regex runs.
    end_tag = line.contains("[MEMORY_TRACK_END]")
    if failed_as_end:
        end_tag = end_tag | line.contains("[MEMORY_TRACK_FAILED]")
    t = lines.withColumn("_e", F.when(end_tag, capture_groups(line, ts + end_body, 8, me)))
    hit_e = F.coalesce(F.col("_e").startswith(me + SEP), F.lit(False))
    t = t.withColumn("_s", F.when(~hit_e & line.contains("[MEMORY_TRACK_START]"),
                                  capture_groups(line, ts + START_BODY, 6, ms)))
    hit_s = F.coalesce(F.col("_s").startswith(ms + SEP), F.lit(False))
    t = t.withColumn("_m", F.when(~hit_e & ~hit_s & line.contains("[MEMORY_MONITOR]"),
                                  capture_groups(line, ts + MONITOR_BODY, 8, mm)))
    hit_m = F.coalesce(F.col("_m").startswith(mm + SEP), F.lit(False))
    t = t.select("log_id", "block", "line_no",
                 F.when(hit_e, F.lit("END")).when(hit_s, F.lit("START")).when(hit_m, F.lit("MONITOR"))
                 .alias("log_type"),
                 F.split(F.coalesce(F.when(hit_e, F.col("_e")), F.when(hit_s, F.col("_s")),
                                    F.when(hit_m, F.col("_m"))), SEP).alias("g"))
    g = lambda i: F.col("g").getItem(i)  # noqa: E731  (0 is the marker, groups start at 1)
    num = lambda i: g(i).try_cast("double")
    typ = F.col("log_type")
    cols = {}
    for name in METRICS:
        cols[name] = F.lit(None).cast("double")
    for i, name in enumerate(END_FIELDS):
        cols[name] = F.when(typ == "END", num(i + 3))
    for i, name in enumerate(START_FIELDS):
        cols[name] = F.when(typ == "START", num(i + 3))
    for name, grp in MONITOR_FIELDS.items():
        mon = F.when(typ == "MONITOR", num(grp + 1))
        cols[name] = mon if name not in START_FIELDS else F.coalesce(cols[name], mon)
    # The regex fixed the shape; a zone-free cast keeps wall-clock times exact (no DST gaps)
    # and turns out-of-range values (month 13, hour 25) into NULL.
    t = t.withColumn("ts", g(1).try_cast("timestamp_ntz"))
    keep = typ.isNotNull() if keep_rejects else (typ.isNotNull() & F.col("ts").isNotNull())
    rec = F.struct(F.col("log_id"), F.col("block"), F.col("line_no"), F.col("ts"), typ.alias("log_type"),
                   g(2).alias("job_name"), *[cols[m].alias(m) for m in METRICS])
    # Zero or one record per line through a generator: no Filter node, so the
    # optimizer cannot push a predicate down by copying the regex captures into it.
    out = t.select(F.explode(F.array_compact(F.array(F.when(keep, rec)))).alias("r"))
    return out.select("r.*")


def render_memlog_message(kind: Column, job: Column, m: dict) -> Column:
    """The profiler's message text for START / MONITOR / END / FAILED.

    ``m`` maps field names to Columns. The END/FAILED message keeps the
    profiler's quirk: with a peak the text stops after ``peak_rss=...MB ``;
    without a peak the whole message is only ``system_available_mb=...``.
    A timestamp prefix is the caller's choice (the analyzer wants ``[ts] ``).
    """
    f2 = lambda c: F.format_string("%.2f", c)
    sgn = lambda c: F.format_string("%+.2f", c)
    start = F.concat(F.lit("[MEMORY_TRACK_START] job='"), job, F.lit("' rss_mb="), f2(m["rss_mb"]),
                     F.lit(" vms_mb="), f2(m["vms_mb"]), F.lit(" memory_percent="), f2(m["memory_percent"]),
                     F.lit(" system_available_mb="), f2(m["system_available_mb"]))
    monitor = F.concat(F.lit("[MEMORY_MONITOR] job='"), job, F.lit("' elapsed="),
                       F.format_string("%.1f", m["elapsed"]), F.lit("s current_rss_mb="), f2(m["current_rss_mb"]),
                       F.lit(" peak_rss_mb="), f2(m["peak_rss_mb"]), F.lit(" current_vms_mb="),
                       f2(m["current_vms_mb"]), F.lit(" system_available_mb="), f2(m["system_available_mb"]),
                       F.lit(" memory_percent="), f2(m["memory_percent"]))
    tag = F.when(kind == "FAILED", F.lit("[MEMORY_TRACK_FAILED]")).otherwise(F.lit("[MEMORY_TRACK_END]"))
    with_peak = F.concat(tag, F.lit(" job='"), job, F.lit("' duration="), f2(m["duration"]),
                         F.lit("s rss_before="), f2(m["rss_before"]), F.lit("MB rss_after="), f2(m["rss_after"]),
                         F.lit("MB rss_delta="), sgn(m["rss_delta"]), F.lit("MB vms_delta="), sgn(m["vms_delta"]),
                         F.lit("MB peak_rss="), f2(m["peak_rss"]), F.lit("MB "))
    no_peak = F.concat(F.lit("system_available_mb="), f2(m["system_available_mb"]))
    end = F.when(m["peak_rss"].isNotNull(), with_peak).otherwise(no_peak)
    body = F.when(kind == "START", start).when(kind == "MONITOR", monitor).otherwise(end)
    err = m.get("error")
    if err is not None:
        body = F.when(kind.isin("END", "FAILED") & err.isNotNull(),
                      F.concat(body, F.lit(" error='"), err, F.lit("'"))).otherwise(body)
    return body


def job_status_line(job: Column, success: Column, duration: Column, rss_delta: Column, vms_delta: Column,
                    peak_rss: Column) -> Column:
    """P10: one-line summary of a tracked run."""
    peak = F.when(peak_rss.isNotNull(), F.format_string(" | Peak RSS: %.2fMB", peak_rss)).otherwise(F.lit(""))
    return F.concat(F.when(success, F.lit("[SUCCESS] ")).otherwise(F.lit("[FAILED] ")), job,
                    F.format_string(" | Duration: %.2fs | RSS Delta: %+.2fMB | VMS Delta: %+.2fMB",
                                    duration, rss_delta, vms_delta), peak)
