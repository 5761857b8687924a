
from pyspark.sql import functions as F

from conftest import SF
from helpers import end, lines_df
from sheaf.functions.convlog import parse_convlog, truncate_text
from sheaf.functions.memlog import parse_memlog
from sheaf.operators import conversions as cv
from sheaf.operators import leaks
from sheaf.plans import reports as rp
from sheaf.plans.fixtures import memlog_lines


def test_newest_first_flips_baseline_shift(spark):  # Q4 (fixture variant F1r)
    fwd = {r.job_name: r.baseline_shift_mb for r in leaks.job_stats(parse_memlog(memlog_lines(spark, SF))).collect()}
    rev = {r.job_name: r.baseline_shift_mb for r in
           leaks.job_stats(parse_memlog(memlog_lines(spark, SF, newest_first=True))).collect()}
    moved = [j for j in fwd if fwd[j] != 0]
    assert moved and all(abs(fwd[j] + rev[j]) < 1e-9 for j in moved)


def test_producer_link_scan_wording(spark):  # Q11
    line = "[LINK_SCAN] file='deck.pptx' risk=HIGH links_found=2 types=['ole', 'chart']"
    assert parse_convlog(lines_df(spark, [line])).count() == 0
    r = parse_convlog(lines_df(spark, [line]), lenient=True).first()
    assert r.event_type == "LINK_SCAN" and r.links_found == 2 and r.link_types == ["ole", "chart"]


def test_report_truncation(spark):  # P12: >40 -> 37 + '...'
    df = spark.createDataFrame([("x" * 41,), ("y" * 40,)], "f string")
    got = [r[0] for r in df.select(truncate_text(F.col("f"), 40, 37)).collect()]
    assert got == ["x" * 37 + "...", "y" * 40]


def test_conv_csv_blanks(spark):  # K3: pdf size 0.0 and missing time are blank
    lines = ["[Attempt 1/2] Converting excel_input_a.xlsx (1.50MB)...",
             "Converted excel_input_a.xlsx to PDF (0.0MB) in 0.0s"]
    rec = cv.conversion_records(parse_convlog(lines_df(spark, lines)))
    assert rp.conv_csv_lines(rec).where("ord = 1").first().line == '"excel_input_a.xlsx",excel,False,0,"",True,1.5,,'


def test_score_weights(spark):  # C12 with all thresholds crossed
    lines = [end(f"2024-01-01 0{h}:00:00", "j", after=100.0 + 20 * h, delta=2.0, vdelta=-1.0) for h in range(3)]
    r = leaks.job_stats(parse_memlog(lines_df(spark, lines))).first()
    want = r.rss_growth_rate_mb_per_hour * 40 + 2.0 * 20 + r.baseline_shift_mb * 15 + 1.0 * 10 + 3 * 2.0 * 10
    assert abs(r.leak_score - want) < 1e-6 and r.baseline_shift_mb == 40.0
