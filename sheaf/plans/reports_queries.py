"""Registered report and T5 queries (reuse the F1, F2, F4 fixtures)."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from sheaf.functions.text import html_to_markdown
from sheaf.operators import documents as dm
from sheaf.operators import leaks, office
from sheaf.operators import samples as sm
from sheaf.operators import tables as tb
from sheaf.plans import convlog_queries as cq
from sheaf.plans import memlog_queries as mq
from sheaf.plans import reports as rp
from sheaf.plans.common import flat
from sheaf.plans.fixtures import document_runs, package_members, run_outcomes, samples, table_cells
from sheaf.session import cut_lineage, ensure_checkpoint_dir
from sheaf.sources.tables import load_table

STALE_NOW = dt.datetime(2024, 1, 31, 0, 0, 0)
STALE_MAX_AGE_S = 86400 * 3


def _leak_csv(s, d):
    top = leaks.top_culprits(leaks.job_stats(mq.entries(s, d), container_limit_mb=mq.CONTAINER_LIMIT_MB), hide_below=None)
    # Raw float text differs between engines past ~12 digits; the check view fixes 6 decimals.
    return rp.leak_csv_lines(top, tto_format="%.6f")


def _profiled(s, d):
    return cut_lineage(sm.with_outcomes(sm.run_stats(samples(s, d)), run_outcomes(s, d)))


def _fields(df, key, fields):
    """The fields of a JSON record as columns (dots become underscores), and its top-level keys."""
    at = lambda f: F.get_json_object("json", "$." + f)
    return flat(df.select(key, F.array_join(F.json_object_keys("json"), ",").alias("keys"),
                          *[at(f).cast(t).alias(f.replace(".", "_")) for f, t in fields.items()]))


def _folder(s, name):
    return f"{ensure_checkpoint_dir(s).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _markdown_sink(s, d):
    """Web pages and slide decks as Markdown, written and read again."""
    pages = load_table(s, d, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("doc_key"),
                                             html_to_markdown(F.col("html")).alias("markdown"))
    decks = office.slides_markdown(package_members(s, d)).select(F.col("path").alias("doc_key"), "markdown")
    path = _folder(s, "markdown")
    rp.write_markdown(pages.unionByName(decks), path, per_bucket=500)
    return s.read.parquet(path).select("doc_key", F.md5("markdown").alias("md5"))


def _output_layout(s, d):
    """Table exports in their folders by kind, format and table, read again."""
    path = _folder(s, "layout")
    tb.write_table_exports(tb.to_csv_lines(table_cells(s, d)), path, "csv")
    tb.write_table_exports(tb.to_json_lines(table_cells(s, d, repeated=True)), path, "json")
    return s.read.text(path).select("kind", "fmt", "table_id", F.col("value").alias("line"))


QUERIES = {
    "leak_csv": _leak_csv,
    "conv_csv": lambda s, d: rp.conv_csv_lines(cq.records(s, d)),
    "leak_report_lines": lambda s, d: rp.leak_report_lines(mq.entries(s, d), container_limit_mb=mq.CONTAINER_LIMIT_MB),
    "conv_report_lines": lambda s, d: rp.conv_report_lines(cq.records(s, d)),
    "profiler_report_lines": lambda s, d: rp.profiler_report_lines(_profiled(s, d)),
    "profiler_json": lambda s, d: _fields(rp.profiler_json(_profiled(s, d)), "name", {
        "duration": "double", "rss_delta_mb": "double", "peak_rss_mb": "double", "success": "boolean"}),
    "doc_metadata_json": lambda s, d: _fields(rp.doc_metadata_json(dm.doc_run_stats(document_runs(s, d)), "2026-01-08T10:00:00", "out"), "file_path", {
        "processing_date": "string", "statistics.filename": "string", "statistics.format": "string", "statistics.success": "boolean",
        "statistics.file_size_mb": "double", "statistics.tables_found": "long", "statistics.tables_exported": "long",
        "statistics.images_extracted": "long", "statistics.page_images_extracted": "long",
        "statistics.processing_time_seconds": "double", "statistics.error": "string", "output_location": "string"}),
    "batch_summary_json": lambda s, d: rp.batch_summary_json(dm.doc_run_stats(document_runs(s, d)), "out").select(
        F.regexp_replace("json", r'("total_processing_time_seconds":)[0-9.E]+', "$1T").alias("json")),
    "markdown_sink": _markdown_sink,
    "output_layout": _output_layout,
    "stale_runs": lambda s, d: flat(leaks.stale_runs(mq.entries(s, d), STALE_NOW, STALE_MAX_AGE_S).select(
        "job_name", "start_time", "age_seconds")),
}
