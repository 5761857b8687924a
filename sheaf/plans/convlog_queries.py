"""Registered conversion-log queries over fixture F2 (lines rendered from ``documents``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions.convlog import parse_convlog, truncate_text
from sheaf.operators import conversions as cv
from sheaf.plans.common import flat
from sheaf.plans.fixtures import convlog_lines
from sheaf.session import cut_lineage


def events(spark, sf_dir):
    # Shared by the fold's branches (current file, conversions, scans, completions).
    return cut_lineage(parse_convlog(convlog_lines(spark, sf_dir)))


def records(spark, sf_dir):
    return cv.conversion_records(events(spark, sf_dir))


def _rec_cols(df):
    return flat(df.select("log_id", "filename", "file_type", "has_links", "links_found",
                          F.array_join("link_types", "|").alias("link_types"), "conversion_successful",
                          "input_size_mb", "pdf_size_mb", "conversion_time_seconds", "attempt_number",
                          "max_retries", "timestamp"))


QUERIES = {
    "convlog_lines": lambda s, d: convlog_lines(s, d).select("log_id", "line_no", "line"),
    "convlog_parse": lambda s, d: flat(parse_convlog(convlog_lines(s, d)).select(
        "log_id", "line_no", "timestamp", "event_type", "filename", "file_type", "attempt", "input_size",
        "links_found", F.array_join("link_types", "|").alias("link_types"), "pdf_size", "conversion_time")),
    "link_types_split": lambda s, d: parse_convlog(convlog_lines(s, d)).where(F.col("event_type") == "LINK_SCAN").select(
        "log_id", "line_no", F.size("link_types").alias("n_types"),
        F.array_join("link_types", "|").alias("link_types")),
    "conv_current_file": lambda s, d: cv.with_current_file(events(s, d)).select(
        "log_id", "line_no", "event_type", "current_file"),
    "conv_link_match": lambda s, d: cv.scan_targets(events(s, d)).select(
        "log_id", "line_no", "scan_name", "matched", "target"),
    "conv_completed_match": lambda s, d: cv.converted_targets(events(s, d)).select(
        "log_id", "line_no", "filename", "matched"),
    "conv_records": lambda s, d: _rec_cols(records(s, d)),
    "conv_summary": lambda s, d: flat(cv.conversion_summary(records(s, d))),
    "conv_by_type": lambda s, d: cv.conversions_by_type(records(s, d)),
    "conv_detail_sorted": lambda s, d: _rec_cols(cv.detail_sorted(records(s, d))),
    "docs_with_links": lambda s, d: _rec_cols(cv.docs_with_links(records(s, d))),
    "conv_report_truncate": lambda s, d: records(s, d).select(
        "log_id", "filename", truncate_text(F.col("filename"), 40, 37).alias("filename_cell"),
        truncate_text(F.when(F.size("link_types") > 0, F.array_join("link_types", ", ")).otherwise(F.lit("-")),
                      15, 12).alias("link_types_cell")),
}
