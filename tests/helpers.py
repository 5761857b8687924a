from pyspark.sql import functions as F


def lines_df(spark, lines, log_id="log", start=0):
    rows = [(log_id, 0, start + i, line) for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "log_id string, block long, line_no long, line string")


def start(ts, job, rss=100.0, vms=300.0, pct=1.0, avail=8000.0):
    return (f"[{ts}] app [MEMORY_TRACK_START] job='{job}' rss_mb={rss:.2f} vms_mb={vms:.2f} "
            f"memory_percent={pct:.2f} system_available_mb={avail:.2f}")


def end(ts, job, before=100.0, after=110.0, delta=10.0, vdelta=1.0, peak=150.0, dur=5.0):
    return (f"[{ts}] app [MEMORY_TRACK_END] job='{job}' duration={dur:.2f}s rss_before={before:.2f}MB "
            f"rss_after={after:.2f}MB rss_delta={delta:+.2f}MB vms_delta={vdelta:+.2f}MB peak_rss={peak:.2f}MB ")


def monitor(ts, job, rss=120.0, peak=130.0):
    return (f"[{ts}] app [MEMORY_MONITOR] job='{job}' elapsed=1.0s current_rss_mb={rss:.2f} peak_rss_mb={peak:.2f} "
            f"current_vms_mb=400.00 system_available_mb=7000.00 memory_percent=2.00")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())
