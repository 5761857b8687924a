"""Report sinks (K1-K8): CSV lines, text-report lines as ``(section, ord, line)``
rows, JSON and per-document table writers.

Text reports are DataFrames of lines built by unions of small per-section frames
(top-k, one-row overviews, per-orphan blocks numbered with ``dense_index``); a
writer orders them by ``(section, ord)`` within a single output. Only sinks round
numbers for display.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.operators import leaks
from sheaf.operators.indexing import dense_index
from sheaf.session import cut_lineage

# ---------------------------------------------------------------------------
# Report text that must read exactly as the tools' reports do.
# Static lines are gathered here in report order; per-line format templates
# stay next to the columns they format below.
# ---------------------------------------------------------------------------
RULE = "=" * 100
LEAK_CSV_HEADER = ("job_name,orphaned_count,run_count,leak_score,growth_rate_mb_per_hour,avg_rss_delta_mb,"
                   "total_rss_delta_mb,baseline_shift_mb,cumulative_impact_mb,avg_vms_delta_mb,"
                   "avg_peak_rss_mb,max_peak_rss_mb,time_to_oom_hours,headroom_consumed_pct,is_outlier")
CONV_CSV_HEADER = ("filename,file_type,has_links,links_found,link_types,conversion_successful,input_size_mb,"
                   "pdf_size_mb,conversion_time_seconds")
LEAK_TITLE = [RULE, "MEMORY LEAK ANALYSIS REPORT", RULE, "", "OVERVIEW:"]
ORPHANS_FOUND = [RULE, "!!! CRITICAL: JOBS THAT STARTED BUT NEVER COMPLETED !!!", RULE, "",
                 "These jobs are PRIMARY OOM SUSPECTS - they started but have no completion log.",
                 "This typically indicates the container was killed (OOM) during job execution.", ""]
ORPHANS_NONE = [RULE, "ORPHANED JOBS CHECK: PASSED", RULE, "", "All jobs that started also completed successfully.",
                "No evidence of container crash during job execution in this log sample.", ""]
ORPHAN_STATUS = "   [STATUS]: JOB STARTED BUT NEVER FINISHED - LIKELY CAUSED CONTAINER CRASH"
RECOMMENDATION = ["RECOMMENDATION: Investigate the jobs listed above. They are the most likely",
                  "                culprits for OOM issues. Check what these jobs do and why",
                  "                they might consume excessive memory.", ""]
NO_LEAK_CULPRITS = "  No culprits identified."
CULPRITS_TITLE = ["", RULE, "TOP MEMORY LEAK CULPRITS (ranked by leak score)", RULE, ""]
GLOBAL_TITLE = [RULE, "GLOBAL STATISTICS", RULE, ""]
ITEM_RULE = "   " + "─" * 95
CONV_TITLE = [RULE, "DOCUMENT CONVERSION LOG ANALYSIS REPORT", RULE, "", "SUMMARY", "-" * 50]
CONV_BY_TYPE_TITLE = ["", "BY FILE TYPE", "-" * 50]
CONV_DETAIL_TITLE = ["", "DETAILED CONVERSION RESULTS", "-" * 120,
                     f"{'Filename':<40} {'Type':<12} {'Links':<6} {'Link Types':<15} {'Status':<10} "
                     f"{'Input Size':<12} {'PDF Size':<12}", "-" * 120]
CONV_DETAIL_END = ["", RULE]
CONV_LINKS_TITLE = ["", "DOCUMENTS WITH LINKS - DETAILED", "-" * 100]
CONV_DETAIL_ROW = "%-40s %-12s %-6s %-15s %-10s %-12s %-12s"

PROFILER_NONE = "No jobs tracked yet."
PROFILER_TITLE = ["=" * 80, "MEMORY PROFILING REPORT", "=" * 80, "", "Job-by-Job Memory Usage:", "-" * 80]
PROFILER_CULPRITS_TITLE = "POTENTIAL OOM CULPRITS (RSS delta > 50MB or RSS > 500MB):"
PROFILER_NO_CULPRITS = "  No obvious culprits found."
PROFILER_END = ["", "=" * 80]


def _f2(c) -> Column:
    return F.format_string("%.2f", c)


def leak_csv_lines(top: DataFrame, tto_format: str | None = None) -> DataFrame:
    """K1: rank-ordered CSV lines for the top culprits (rank 0 is the header).

    ``time_to_oom_hours`` is written raw (shortest repr), as the original report does;
    ``tto_format`` (e.g. '%.6f') renders it at a fixed precision instead.
    """
    raw = F.col("time_to_oom_hours")
    tto = F.when(F.coalesce(raw, F.lit(0.0)) != 0,
                 raw.cast("string") if tto_format is None else F.format_string(tto_format, raw)).otherwise(F.lit(""))
    head = F.when(F.col("headroom_consumed_percent") > 0, _f2(F.col("headroom_consumed_percent"))).otherwise(F.lit(""))
    line = F.concat_ws(",", F.concat(F.lit('"'), F.col("job_name"), F.lit('"')), F.col("orphaned_count").cast("string"),
                       F.col("run_count").cast("string"), _f2(F.col("leak_score")), _f2(F.col("rss_growth_rate_mb_per_hour")),
                       _f2(F.col("avg_rss_delta")), _f2(F.col("total_rss_delta")), _f2(F.col("baseline_shift_mb")),
                       _f2(F.col("cumulative_impact")), _f2(F.col("avg_vms_delta")), _f2(F.col("avg_peak_rss")),
                       _f2(F.col("max_peak_rss")), tto, head,
                       F.when(F.col("is_statistical_outlier"), F.lit("1")).otherwise(F.lit("0")))
    rows = top.select(F.col("rank").cast("long").alias("rank"), line.alias("line"))
    header = top.sparkSession.range(1).select(F.lit(0).cast("long").alias("rank"), F.lit(LEAK_CSV_HEADER).alias("line"))
    return header.unionByName(rows)


def _py_float(c: Column) -> Column:
    """A double as Python prints it in the common range ('12.0', '1.5')."""
    return c.cast("string")


def conv_csv_lines(records: DataFrame) -> DataFrame:
    """K3: log_id, filename, ord, line: the header of each log's CSV (ord 0, no filename) and a line per document (ord 1).

    Link types are joined by '|', falsy pdf size and time are blank.
    """
    line = F.concat_ws(",", F.concat(F.lit('"'), F.col("filename"), F.lit('"')),
                       F.coalesce(F.col("file_type"), F.lit("None")),
                       F.when(F.col("has_links"), F.lit("True")).otherwise(F.lit("False")),
                       F.col("links_found").cast("string"),
                       F.concat(F.lit('"'), F.array_join("link_types", "|"), F.lit('"')),
                       F.when(F.col("conversion_successful"), F.lit("True")).otherwise(F.lit("False")),
                       F.coalesce(_py_float(F.col("input_size_mb")), F.lit("")),
                       F.when(F.coalesce(F.col("pdf_size_mb"), F.lit(0.0)) != 0, _py_float(F.col("pdf_size_mb"))).otherwise(F.lit("")),
                       F.when(F.coalesce(F.col("conversion_time_seconds"), F.lit(0.0)) != 0,
                              _py_float(F.col("conversion_time_seconds"))).otherwise(F.lit("")))
    rows = cut_lineage(records.select("log_id", "filename", F.lit(1).alias("ord"), line.alias("line")))
    heads = rows.select("log_id").distinct().select("log_id", F.lit("").alias("filename"), F.lit(0).alias("ord"), F.lit(CONV_CSV_HEADER).alias("line"))
    return heads.unionByName(rows)


def _lines(df: DataFrame, section: int, parts: list[Column], ord_base: Column | None = None) -> DataFrame:
    """Explode a list of line expressions into (section, ord, line)."""
    base = ord_base if ord_base is not None else F.lit(0).cast("long")
    return df.select(F.lit(section).alias("section"), F.posexplode(F.array(*parts)).alias("k", "line"),
                     base.alias("_b")).select("section", (F.col("_b") * 100 + F.col("k")).alias("ord"), "line") \
        .where(F.col("line").isNotNull())


def leak_report_lines(entries: DataFrame, *, container_limit_mb: float | None = None) -> DataFrame:
    """K2: the leak report as ordered lines (overview, container, orphans, culprits, global)."""
    ov = leaks.analysis_overview(entries, container_limit_mb=container_limit_mb)
    mins = (leaks.epoch_seconds(F.col("time_range_end")) - leaks.epoch_seconds(F.col("time_range_start"))) / 60
    s0 = _lines(ov, 0, [*[F.lit(x) for x in LEAK_TITLE],
                        F.format_string("  Log entries analyzed: %d", "total_entries"),
                        F.format_string("  Unique jobs tracked: %d", "total_jobs_tracked"),
                        F.format_string("  Time range: %s to %s", F.col("time_range_start").cast("string"),
                                        F.col("time_range_end").cast("string")),
                        F.format_string("  Duration: %.1f minutes", mins), F.lit(""),
                        F.format_string("  Overall RSS growth: %+.2f MB", "overall_rss_growth"),
                        F.format_string("  Overall growth rate: %+.2f MB/hour", "overall_growth_rate_mb_per_hour"),
                        F.lit("")])
    parts = [s0]
    if container_limit_mb:
        cur = F.col("current_rss_mb")
        parts.append(_lines(ov, 1, [
            F.lit("CONTAINER CONTEXT:"),
            F.format_string("  Container memory limit: %.2f MB (%.2f GiB)", F.lit(float(container_limit_mb)),
                            F.lit(container_limit_mb / 1024)),
            F.when(F.coalesce(cur, F.lit(0.0)) != 0, F.format_string("  Current RSS usage: %.2f MB (%.1f%% of limit)", cur,
                                                                      cur / container_limit_mb * 100))
            .otherwise(F.lit("  Current RSS usage: N/A")),
            F.when(F.coalesce(F.col("available_headroom_mb"), F.lit(0.0)) != 0,
                   F.format_string("  Available headroom: %.2f MB (%.1f%%)", "available_headroom_mb", "headroom_percent"))
            .otherwise(F.lit("  Available headroom: N/A")), F.lit("")]))
    orph = leaks.orphaned_jobs(entries)
    n_orph = orph.select(F.count(F.lit(1))).scalar()
    one = entries.sparkSession.range(1)
    parts.append(_lines(one, 2, [F.when(n_orph > 0, F.lit(a)).otherwise(F.lit(b))
                                 for a, b in zip(ORPHANS_FOUND, ORPHANS_NONE)]))
    numbered = dense_index(orph, ["start_time", "job_name"], out="idx")
    parts.append(_lines(numbered, 3, [
        F.format_string("%d. %s", "idx", "job_name"), F.lit(ITEM_RULE), F.lit(ORPHAN_STATUS),
        F.format_string("   Start Time: %s", F.col("start_time").cast("string")),
        F.format_string("   RSS at Start: %.2f MB", "rss_at_start"), F.format_string("   VMS at Start: %.2f MB", "vms_at_start"),
        F.format_string("   Memory %% at Start: %.2f%%", "memory_percent_at_start"),
        F.format_string("   System Available at Start: %.2f MB", "system_available_at_start"), F.lit("")], F.col("idx")))
    ranked = cut_lineage(leaks.top_culprits(leaks.job_stats(entries, container_limit_mb=container_limit_mb), hide_below=None))  # ten rows
    n_top = ranked.select(F.count(F.lit(1))).scalar()
    parts.append(_lines(one, 4, [*[F.when(n_orph > 0, F.lit(x)) for x in RECOMMENDATION], *[F.lit(x) for x in CULPRITS_TITLE],
                                 F.when(n_top == 0, F.lit(NO_LEAK_CULPRITS))]))
    top = ranked.where("leak_score >= 1")
    ind = leaks.leak_indicators()
    flag = lambda cond: F.when(cond, F.lit("[LEAK]")).otherwise(F.lit("[OK]"))
    parts.append(_lines(top, 5, [
        F.format_string("%d. %s", "rank", "job_name"), F.lit(ITEM_RULE),
        F.format_string("   Leak Score: %.2f %s %s", "leak_score", leaks.severity_label(),
                        F.when(F.size(ind) > 0, F.concat(F.lit("["), F.array_join(ind, ", "), F.lit("]"))).otherwise(F.lit(""))),
        F.format_string("   Completed Runs: %d", "run_count"),
        F.when(F.col("orphaned_count") > 0, F.format_string("   Orphaned Runs: %d [CRITICAL - Job did not complete]",
                                                              "orphaned_count")),
        F.lit(""), F.lit("   RSS Metrics:"),
        F.format_string("     • Growth Rate: %+.2f MB/hour %s", "rss_growth_rate_mb_per_hour",
                        flag(F.col("rss_growth_rate_mb_per_hour") > 1.0)),
        F.format_string("     • Avg Delta per Run: %+.2f MB %s", "avg_rss_delta", flag(F.col("avg_rss_delta") > 0.5)),
        F.format_string("     • Total Delta: %+.2f MB", "total_rss_delta"),
        F.format_string("     • Baseline Shift: %+.2f MB %s", "baseline_shift_mb", flag(F.col("baseline_shift_mb") > 10)),
        F.format_string("     • Cumulative Impact: %.2f MB", "cumulative_impact"), F.lit(""), F.lit("   Peak RSS:"),
        F.format_string("     • Average: %.2f MB", "avg_peak_rss"), F.format_string("     • Maximum: %.2f MB", "max_peak_rss"),
        F.when(F.col("headroom_consumed_percent") > 0,
               F.format_string("     • Headroom Consumed: %.1f%% of container limit", "headroom_consumed_percent")),
        F.when(F.col("time_to_oom_hours").isNotNull(), F.concat(F.lit("     • Predicted Time to OOM: "),
                                                                 leaks.time_to_oom_band(F.col("time_to_oom_hours")))),
        F.lit(""), F.lit("   VMS Metrics:"), F.format_string("     • Avg VMS Delta: %+.2f MB", "avg_vms_delta"), F.lit(""),
        F.lit("   Statistical:"),
        F.format_string("     • Outlier: %s", F.when(F.col("is_statistical_outlier"), F.lit("YES [WARNING]")).otherwise(F.lit("No"))),
        F.format_string("     • StdDev: %.2f MB", "stddev_rss_delta"), F.lit("")], F.col("rank").cast("long")))
    g = leaks.global_delta_stats(entries)
    parts.append(_lines(g, 7, [*[F.lit(x) for x in GLOBAL_TITLE],
                               F.format_string("  Global average RSS delta: %.2f MB", "global_avg_delta"),
                               F.format_string("  Global standard deviation: %.2f MB", "global_stddev_delta"),
                               F.format_string("  Outlier threshold (mean + 2*stddev): %.2f MB", "outlier_threshold"), F.lit("")]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def conv_report_lines(records: DataFrame) -> DataFrame:
    """K4: summary, by-type, the detail table and the documents with links in detail (as ordered lines)."""
    from sheaf.functions.convlog import truncate_text
    from sheaf.operators.conversions import conversion_summary, conversions_by_type, docs_with_links
    records = cut_lineage(records)
    s = conversion_summary(records)
    summary = _lines(s, 0, [
        *[F.lit(x) for x in CONV_TITLE],
        F.format_string("Total documents processed: %d", "total"),
        F.when(F.col("total") > 0, F.format_string("Successful conversions: %d (%.1f%%)", "successful", "success_pct"))
        .otherwise(F.lit("No documents")),
        F.format_string("Documents with links: %d", "with_links"),
        F.format_string("Documents with links - successful: %d", "successful_with_links"),
        F.when(F.col("with_links") > 0, F.format_string("Success rate for docs with links: %.1f%%", "links_success_pct")),
        *[F.lit(x) for x in CONV_BY_TYPE_TITLE]])
    bt = conversions_by_type(records)
    by_type = bt.select(F.lit(1).alias("section"), F.when(F.col("file_type") == "excel", F.lit(0)).otherwise(F.lit(1)).cast("long").alias("ord"),
                        F.format_string("%s: %d total, %d successful",
                                        F.when(F.col("file_type") == "excel", F.lit("Excel")).otherwise(F.lit("PowerPoint")),
                                        "total", "successful").alias("line"))
    links = F.when(F.col("has_links"), F.col("links_found").cast("string")).otherwise(F.lit("0"))
    lt = truncate_text(F.when(F.size("link_types") > 0, F.array_join("link_types", ", ")).otherwise(F.lit("-")), 15, 12)
    ins = F.when(F.col("input_size_mb").isNotNull(), F.format_string("%.2fMB", "input_size_mb")).otherwise(F.lit("-"))
    pdf = F.when(F.coalesce(F.col("pdf_size_mb"), F.lit(0.0)) != 0, F.format_string("%.2fMB", "pdf_size_mb")).otherwise(F.lit("-"))
    row = F.format_string(CONV_DETAIL_ROW, truncate_text(F.col("filename"), 40, 37),
                          F.coalesce(F.col("file_type"), F.lit("None")), links, lt,
                          F.when(F.col("conversion_successful"), F.lit("SUCCESS")).otherwise(F.lit("FAILED")), ins, pdf)
    detail = dense_index(records.withColumn("_nl", ~F.col("has_links")), ["_nl", "filename", "log_id"], out="idx") \
        .select(F.lit(3).alias("section"), F.col("idx").alias("ord"), row.alias("line"))
    head = records.sparkSession.range(1).select(F.lit(2).alias("section"), F.lit(0).cast("long").alias("ord"),
                                                F.lit("\n".join(CONV_DETAIL_TITLE)).alias("line"))
    ends = _lines(s, 4, [*[F.lit(x) for x in CONV_DETAIL_END], *[F.when(F.col("with_links") > 0, F.lit(x)) for x in CONV_LINKS_TITLE]])
    linked = dense_index(docs_with_links(records), ["log_id", "created"], out="idx")
    given = lambda c, text: F.when(F.coalesce(F.col(c), F.lit(0.0)) != 0, F.concat(F.lit(text), _py_float(F.col(c))))
    types = F.when(F.size("link_types") > 0, F.concat(F.lit("['"), F.array_join("link_types", "', '"), F.lit("']"))).otherwise(F.lit("[]"))
    links_detail = _lines(linked, 5, [
        F.concat(F.lit("File: "), F.col("filename")), F.concat(F.lit("  Type: "), F.coalesce("file_type", F.lit("None"))),
        F.format_string("  Links found: %d", "links_found"), F.concat(F.lit("  Link types: "), types),
        F.when(F.col("conversion_successful"), F.lit("  Conversion status: SUCCESS")).otherwise(F.lit("  Conversion status: FAILED")),
        F.concat(F.lit("  Input size: "), _py_float(F.col("input_size_mb")), F.lit("MB")),
        F.concat(given("pdf_size_mb", "  PDF size: "), F.lit("MB")),
        F.concat(given("conversion_time_seconds", "  Conversion time: "), F.lit("s")), F.lit("")], F.col("idx"))
    return summary.unionByName(by_type).unionByName(head).unionByName(detail).unionByName(ends).unionByName(links_detail)


def _run_name() -> Column:
    return F.concat(F.lit("run_"), F.col("run_id").cast("string"))


def profiler_report_lines(stats: DataFrame) -> DataFrame:
    """K5: title, numbered job list with errors, summary and OOM culprits of a profiler run.

    ``stats`` may have ``success`` and ``error`` (``samples.with_outcomes``); without them every run is a success.
    """
    from sheaf.functions.memlog import job_status_line
    from sheaf.operators.samples import oom_culprits, profiler_totals
    if "success" not in stats.columns:
        stats = stats.withColumn("success", F.lit(True)).withColumn("error", F.lit(None).cast("string"))
    job = _run_name()
    tot = profiler_totals(stats)
    some = F.col("total_jobs") > 0
    title = _lines(tot, 0, [F.when(some, F.lit(PROFILER_TITLE[0])).otherwise(F.lit(PROFILER_NONE)),
                            *[F.when(some, F.lit(x)) for x in PROFILER_TITLE[1:]]])
    numbered = dense_index(stats.withColumn("_t", F.col("before.epoch_s")).withColumn("_s", F.col("before.seq")),
                           ["_t", "_s"], out="idx")
    jobs = _lines(numbered, 1, [
        F.format_string("%d. %s", "idx", job_status_line(job, F.col("success"), F.col("duration_seconds"), F.col("rss_delta_mb"),
                                                         F.col("vms_delta_mb"), F.col("peak.rss_mb"))),
        F.when(F.coalesce(F.length("error"), F.lit(0)) > 0, F.concat(F.lit("   Error: "), F.col("error")))], F.col("idx"))
    n_culprits = oom_culprits(stats).select(F.count(F.lit(1))).scalar()
    summary = _lines(tot.where(some), 2, [
        F.lit(""), F.lit("-" * 80), F.lit("SUMMARY:"), F.format_string("  Total jobs tracked: %d", "total_jobs"),
        F.format_string("  Total RSS delta: %+.2fMB", "total_rss_delta_mb"),
        F.format_string("  Largest RSS increase: run_%s (%+.2fMB)", F.col("max_delta_run").cast("string"), "max_rss_delta_mb"),
        F.format_string("  Highest peak RSS: run_%s (%.2fMB)", F.col("max_peak_run").cast("string"), "max_peak_rss_mb"), F.lit(""),
        F.lit(PROFILER_CULPRITS_TITLE), F.when(n_culprits == 0, F.lit(PROFILER_NO_CULPRITS))])
    cul = dense_index(oom_culprits(stats).withColumn("_d", -F.col("rss_delta_mb")), ["_d", "run_id"], out="idx")
    culprits = _lines(cul, 3, [F.format_string("  [WARNING] %s:", job), F.format_string("      RSS Delta: %+.2fMB", "rss_delta_mb"),
                               F.format_string("      Peak RSS: %.2fMB", "peak.rss_mb")], F.col("idx"))
    ends = _lines(tot.where(some), 4, [F.lit(x) for x in PROFILER_END])
    return title.unionByName(jobs).unionByName(summary).unionByName(culprits).unionByName(ends)


def profiler_json(stats: DataFrame) -> DataFrame:
    """K5: name, json: the record of each job in the profiler's JSON export (``write_json`` writes a line a job)."""
    success = F.col("success") if "success" in stats.columns else F.lit(True)
    return stats.select(_run_name().alias("name"), F.to_json(F.struct(
        _run_name().alias("name"), F.col("duration_seconds").alias("duration"), "rss_delta_mb",
        F.coalesce(F.col("peak.rss_mb"), F.lit(0.0)).alias("peak_rss_mb"), success.alias("success"))).alias("json"))


STATISTICS = ("filename", "file_path", "file_size_mb", "format", "success", "tables_found", "tables_exported", "images_extracted",
              "page_images_extracted", "processing_time_seconds", "error")


def doc_metadata_json(stats: DataFrame, processing_date: str, out_dir: str) -> DataFrame:
    """K7: file_path, json: the metadata record of each successfully processed document. Output folders are
    told apart by the full path (Q13)."""
    record = F.struct(F.lit(processing_date).alias("processing_date"), F.struct(*STATISTICS).alias("statistics"),
                      F.concat(F.lit(out_dir.rstrip("/") + "/"), F.col("file_path")).alias("output_location"))
    return stats.where("success").select("file_path", F.to_json(record, {"ignoreNullFields": "false"}).alias("json"))


def batch_summary_json(stats: DataFrame, out_dir: str) -> DataFrame:
    """K7: json: the batch record with its breakdown by format, in one row. The results of single documents, which the tool
    nests in it, are the lines of ``doc_metadata_json``: a record of unbounded size is no use."""
    from sheaf.operators.documents import batch_summary, format_breakdown
    each = format_breakdown(stats).select("format", F.struct("count", "success").alias("n"))
    by_format = each.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("format", "n")))).alias("m")).scalar()  # a row per format
    total = batch_summary(stats)
    return total.withColumn("format_breakdown", by_format).select(F.to_json(F.struct(
        "total_files", "successful", "failed", "total_tables_extracted", "total_images_extracted", "total_page_images_extracted",
        F.round("total_processing_time_seconds", 2).alias("total_processing_time_seconds"), F.lit(out_dir).alias("output_directory"),
        "format_breakdown")).alias("json"))


LINES_PER_FILE = 1_000_000
DOCS_PER_BUCKET = 10_000


def write_report(lines: DataFrame, path: str, lines_per_file: int = LINES_PER_FILE) -> DataFrame:
    """Writes ordered report lines as numbered text files, whose concatenation by name is the report; returns the
    manifest: part (from 0), first and last (section, ord), lines. Ranges of lines go to their own tasks; a short report is one file."""
    files = max(1, -(-lines.count() // lines_per_file))
    ranged = lines.repartitionByRange(files, "section", "ord") if files > 1 else lines.coalesce(1)
    stored = cut_lineage(ranged.sortWithinPartitions("section", "ord").withColumn("part", F.spark_partition_id()))
    stored.select("line").write.mode("overwrite").text(path)
    at = F.struct("section", "ord")
    return stored.groupBy("part").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("lines")).orderBy("part")


def write_json(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """K5/K7: JSON lines (one record per row)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)


def write_markdown(docs: DataFrame, path: str, buckets: int | None = None, key: str = "doc_key", per_bucket: int = DOCS_PER_BUCKET) -> None:
    """K6/K8: one Markdown text per document, stored as a table partitioned by a hash
    bucket of the full source path (same stem, other suffix never collide). Buckets follow the number of documents."""
    buckets = buckets or max(1, -(-docs.count() // per_bucket))
    (docs.withColumn("bucket", F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)))
     .repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path))
