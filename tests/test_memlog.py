"""Leak analysis: parser quirks, START/END pairing edge cases, statistics."""

import random

from pyspark.sql import functions as F

from helpers import end, lines_df, monitor, rows, start
from sheaf.functions.memlog import parse_memlog, render_memlog_message
from sheaf.operators import leaks
from sheaf.operators.carry import carry_last


def parse(spark, lines, **kw):
    return parse_memlog(lines_df(spark, lines), **kw)


def test_parse_types_and_priority(spark):
    e = parse(spark, [start("2024-01-01 00:00:00", "a"), end("2024-01-01 00:00:05", "a"),
                      monitor("2024-01-01 00:00:03", "a"), "noise line", "[2024-01-01 00:00:01] [MEMORY_TRACK_FAILED] job='a'"])
    got = rows(e, "line_no", "log_type")
    assert got == [(0, "START"), (1, "END"), (2, "MONITOR")]
    mon = e.where("log_type = 'MONITOR'").first()
    assert mon.current_rss_mb == 120.0 and mon.memory_percent == 2.0 and mon.system_available_mb is None


def test_malformed_number_is_null_not_failure(spark):  # Q14
    bad = start("2024-01-01 00:00:00", "a").replace("rss_mb=100.00", "rss_mb=1.2.3")
    e = parse(spark, [bad])
    r = e.first()
    assert r.log_type == "START" and r.rss_mb is None and r.vms_mb == 300.0


def test_lenient_timestamps(spark):  # Q1
    line = "2024-01-01 00:00:00,123 - memory_profiler - INFO - [MEMORY_TRACK_START] job='a' rss_mb=1.00 vms_mb=2.00 memory_percent=3.00 system_available_mb=4.00"
    assert parse(spark, [line]).count() == 0
    assert parse(spark, [line], lenient=True).count() == 1


def test_failed_as_end(spark):  # Q3
    failed = end("2024-01-01 00:00:05", "a").replace("MEMORY_TRACK_END", "MEMORY_TRACK_FAILED")
    lines = [start("2024-01-01 00:00:00", "a"), failed]
    assert leaks.orphaned_jobs(parse(spark, lines)).count() == 1
    assert leaks.orphaned_jobs(parse(spark, lines, failed_as_end=True)).count() == 0


def test_pairing_edge_cases(spark):
    lines = [
        # two STARTs in one second are one key; last attributes win
        start("2024-01-01 00:00:00", "dup", rss=1.0), start("2024-01-01 00:00:00", "dup", rss=2.0),
        # END before START in the same second (file order): END sees no START
        end("2024-01-01 00:01:00", "same"), start("2024-01-01 00:01:00", "same"),
        # nested STARTs: the END closes only the newer one
        start("2024-01-01 00:02:00", "nest"), start("2024-01-01 00:02:10", "nest"), end("2024-01-01 00:02:20", "nest"),
        # several ENDs for one START: the START is not consumed
        start("2024-01-01 00:03:00", "multi"), end("2024-01-01 00:03:05", "multi"), end("2024-01-01 00:03:06", "multi"),
    ]
    o = leaks.orphaned_jobs(parse(spark, lines))
    got = {(r.job_name, str(r.start_time)[11:19], r.rss_at_start) for r in o.collect()}
    assert got == {("dup", "00:00:00", 2.0), ("same", "00:01:00", 100.0), ("nest", "00:02:00", 100.0)}
    js = {r.job_name: r for r in leaks.job_stats(parse(spark, lines)).collect()}
    assert js["multi"].run_count == 2 and js["multi"].orphaned_count == 0
    assert js["nest"].orphaned_count == 1 and js["dup"].run_count == 0


def brute_orphans(entries):
    """Specification, checked item by item: an END takes the latest START key of its job among
    STARTs that come before it in (time, file position) order; a START key is orphaned when no
    END takes it."""
    starts = [(ts, pos, job) for ts, kind, job, pos in entries if kind == "START"]
    taken = set()
    for ts, kind, job, pos in entries:
        if kind != "END":
            continue
        before = [s_ts for s_ts, s_pos, s_job in starts if s_job == job and (s_ts, s_pos) < (ts, pos)]
        if before:
            taken.add((job, max(before)))
    return {(job, ts) for ts, _, job in starts} - taken


def test_pairing_matches_brute_force(spark):
    rnd = random.Random(7)
    lines, ents = [], []
    for i in range(400):
        job = f"j{rnd.randint(0, 5)}"
        sec = rnd.randint(0, 300)
        ts = f"2024-01-01 00:{sec // 60:02d}:{sec % 60:02d}"
        if rnd.random() < 0.5:
            lines.append(start(ts, job)); ents.append((sec, "START", job, i))
        else:
            lines.append(end(ts, job)); ents.append((sec, "END", job, i))
    e = parse_memlog(lines_df(spark, lines))
    got = {(r.job_name, r.start_time.minute * 60 + r.start_time.second)
           for r in leaks.orphaned_jobs(e, bucket_seconds=45).collect()}
    assert got == brute_orphans(ents)


def test_carry_last_matches_loop(spark):
    rnd = random.Random(3)
    data = [(rnd.randint(0, 3), i, rnd.choice([None, rnd.randint(0, 99)])) for i in range(500)]
    df = spark.createDataFrame(data, "k int, pos long, v int").withColumn("b", F.floor(F.col("pos") / 37))
    out = carry_last(df, keys=["k"], bucket="b", order=["pos"], value=F.col("v"), out="c")
    got = {(r.k, r.pos): r.c for r in out.collect()}
    last = {}
    for k, pos, v in sorted(data, key=lambda x: x[1]):
        if v is not None:
            last[k] = v
        assert got[(k, pos)] == last.get(k)


def test_stats_edge_cases(spark):
    lines = [
        # n = 1 job: stddev 0, no growth
        end("2024-01-01 00:00:00", "one", delta=5.0),
        # identical timestamps: slope undefined -> 0
        end("2024-01-01 00:01:00", "flat", after=100.0), end("2024-01-01 00:01:00", "flat", after=200.0),
        # all deltas negative; orphan-only job has avg 0.0 and is an outlier when mean + 2 sd < 0 (Q5)
        end("2024-01-01 00:02:00", "neg", delta=-50.0), end("2024-01-01 00:03:00", "neg", delta=-60.0),
        start("2024-01-01 00:04:00", "orph"),
    ]
    e = parse(spark, lines)
    js = {r.job_name: r for r in leaks.job_stats(e).collect()}
    assert js["one"].stddev_rss_delta == 0.0 and js["one"].rss_growth_rate_mb_per_hour == 0.0
    assert js["flat"].rss_growth_rate_mb_per_hour == 0.0 and js["flat"].baseline_shift_mb == 100.0
    assert js["orph"].avg_rss_delta == 0.0 and js["orph"].leak_score >= 10000
    g = leaks.global_delta_stats(e).first()
    assert js["orph"].is_statistical_outlier == (0.0 > g.outlier_threshold)
    assert js["one"].time_to_oom_hours is None


def test_container_limit_and_top_k(spark):
    lines = [end(f"2024-01-01 0{h}:00:00", "grow", after=100.0 + 50 * h, peak=500.0) for h in range(4)]
    lines += [end("2024-01-01 00:00:00", "small", delta=0.05, vdelta=0.0)]
    e = parse(spark, lines)
    js = {r.job_name: r for r in leaks.job_stats(e, container_limit_mb=2048).collect()}
    assert abs(js["grow"].rss_growth_rate_mb_per_hour - 50.0) < 1e-9
    assert abs(js["grow"].time_to_oom_hours - (2048 - 500) / 50.0) < 1e-9
    assert abs(js["grow"].headroom_consumed_percent - 500 / 2048 * 100) < 1e-9
    zero = {r.job_name: r for r in leaks.job_stats(e, container_limit_mb=0).collect()}
    assert zero["grow"].time_to_oom_hours is None  # a limit of 0 counts as absent
    top = leaks.top_culprits(leaks.job_stats(e)).collect()
    assert [r.job_name for r in top] == ["grow"] and top[0].rank == 1  # 'small' scores below 1: hidden
    ranked = leaks.top_culprits(leaks.job_stats(e), hide_below=None).orderBy("rank").collect()
    assert [r.rank for r in ranked] == [1, 2]


def test_overview_file_order_and_empty(spark):  # Q4
    lines = [end("2024-01-01 02:00:00", "a", before=300.0, after=310.0), end("2024-01-01 01:00:00", "a", before=100.0, after=120.0)]
    ov = leaks.analysis_overview(parse(spark, lines)).first()
    assert ov.overall_rss_growth == -180.0  # last END rss_after - first END rss_before, file order
    assert ov.overall_growth_rate_mb_per_hour == 0.0  # newest-first: negative duration -> rate 0
    import pytest
    with pytest.raises(Exception):
        leaks.analysis_overview(parse(spark, ["nothing here"])).collect()


def test_render_then_parse_roundtrip(spark):  # P11 is the inverse of P1
    df = spark.createDataFrame([("START", "j", 1.0, 2.0, 3.0, 4.0)], "k string, job string, a double, b double, c double, d double")
    m = {"rss_mb": F.col("a"), "vms_mb": F.col("b"), "memory_percent": F.col("c"), "system_available_mb": F.col("d"),
         "elapsed": F.col("a"), "current_rss_mb": F.col("a"), "peak_rss_mb": F.col("b"), "current_vms_mb": F.col("c"),
         "duration": F.col("a"), "rss_before": F.col("a"), "rss_after": F.col("b"), "rss_delta": F.col("c"),
         "vms_delta": F.col("d"), "peak_rss": F.col("b")}
    msg = df.select(F.concat(F.lit("[2024-01-01 00:00:00] "), render_memlog_message(F.col("k"), F.col("job"), m)).alias("line"))
    ln = msg.select(F.lit("l").alias("log_id"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("line_no"), "line")
    r = parse_memlog(ln).first()
    assert r.log_type == "START" and r.rss_mb == 1.0 and r.system_available_mb == 4.0


def test_end_message_quirk(spark):  # Q2
    df = spark.createDataFrame([("END", None)], "k string, p double")
    m = {k: F.lit(1.0) for k in ("rss_mb", "vms_mb", "memory_percent", "system_available_mb", "elapsed", "current_rss_mb",
                                 "peak_rss_mb", "current_vms_mb", "duration", "rss_before", "rss_after", "rss_delta", "vms_delta")}
    m["peak_rss"] = F.col("p")
    assert df.select(render_memlog_message(F.col("k"), F.lit("j"), m)).first()[0] == "system_available_mb=1.00"


def test_last_monitor_before_crash(spark):
    lines = [start("2024-01-01 00:00:00", "a"), monitor("2024-01-01 00:00:10", "a", rss=10.0),
             monitor("2024-01-01 00:00:20", "a", rss=20.0), start("2024-01-01 00:01:00", "a"), end("2024-01-01 00:01:30", "a")]
    r = leaks.last_monitor_before_crash(parse(spark, lines)).collect()
    assert len(r) == 1 and r[0].current_rss_mb == 20.0 and r[0].monitor_samples == 2


def test_parse_is_zone_independent(spark):
    line = start("2024-03-10 02:30:00", "dst")  # inside the US spring-forward gap
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        r = parse(spark, [line, start("2024-13-01 00:00:00", "bad")]).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert len(r) == 1 and str(r[0].ts) == "2024-03-10 02:30:00"
