"""Memory samples: peak definition, verdict precedence, retries; parse-once analysis."""

from pyspark.sql import functions as F

from helpers import end, lines_df, start
from sheaf.operators import samples as sm
from sheaf.plans.analysis import LeakAnalysis


def df(spark, rows):
    return spark.createDataFrame(rows, "run_id long, seq long, epoch_s long, rss_mb double, vms_mb double, "
                                       "available_mb double, percent double, elapsed_s long")


def test_peak_excludes_after_snapshot(spark):
    rows = [(1, 0, 100, 50.0, 1.0, 900.0, 1.0, 0), (1, 1, 101, 80.0, 1.0, 900.0, 1.0, 1),
            (1, 2, 102, 80.0, 1.0, 900.0, 1.0, 2), (1, 3, 103, 99.0, 1.0, 900.0, 1.0, 3),
            (2, 9, 100, 10.0, 1.0, 900.0, 1.0, 0)]
    st = {r.run_id: r for r in sm.run_stats(df(spark, rows)).collect()}
    assert st[1].peak.seq == 1 and st[1].rss_delta_mb == 49.0  # first of the equal maxima; 'after' not monitored
    assert st[2].peak.seq == 9 and st[2].duration_seconds == 0.0  # one sample: peak = before
    off = {r.run_id: r for r in sm.run_stats(df(spark, rows), continuous=False).collect()}
    assert off[1].peak.seq == 3


def test_verdict_precedence(spark):
    rows = [(1, 0, 0, 3000.0, 1.0, 100.0, 1.0, 200), (2, 0, 0, 3000.0, 1.0, 100.0, 1.0, 10),
            (3, 0, 0, 100.0, 1.0, 100.0, 1.0, 10), (4, 0, 0, 100.0, 1.0, 900.0, 1.0, 10)]
    v = {r.run_id: r.returncode for r in sm.limit_verdicts(df(spark, rows)).collect()}
    assert v == {1: -1, 2: -2, 3: -3}


def test_retry_outcome(spark):
    a = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, False), (2, 2, False), (2, 3, True), (3, 1, True)],
                              "doc_id long, attempt int, ok boolean")
    got = {r.doc_id: (r.succeeded, r.final_attempt) for r in sm.retry_outcome(a).collect()}
    assert got == {1: (True, 2), 2: (False, 2), 3: (True, 1)}  # attempt 3 is past max_retries=2


def test_leak_analysis_parse_once(spark):
    lines = [start("2024-01-01 00:00:00", "a"), end("2024-01-01 00:00:05", "a"), start("2024-01-01 00:01:00", "b")]
    la = LeakAnalysis.from_lines(lines_df(spark, lines), container_limit_mb=2048)
    assert [r.job_name for r in la.orphans().collect()] == ["b"]
    assert la.overview().first().total_jobs_tracked == 2
    assert la.csv_lines().count() == 3
    assert la.report_lines().where(F.col("line").contains("CRITICAL")).count() >= 1
