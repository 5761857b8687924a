"""Registered batch-document queries over fixture F5 (``documents`` + ``labels``) and ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions import routing as r
from sheaf.operators import documents as dm
from sheaf.operators import samples as sm
from sheaf.plans.common import flat
from sheaf.plans.fixtures import attempts, document_runs, samples
from sheaf.sources.tables import load_table


def runs(s, d):
    return document_runs(s, d)


def stats(s, d):
    return dm.doc_run_stats(runs(s, d)).withColumn("doc_id", F.col("file_path"))


def _format_join(s, d):
    rr = runs(s, d).withColumn("ext", F.lower(r.suffix(F.col("path"))))
    # The dimension has 15 fixed rows: a proven size bound for the broadcast.
    return rr.join(F.broadcast(r.format_map(s)), "ext", "left").select("doc_id", "ext", "format")


def _url(s, d):
    p = load_table(s, d, "pages").select("page_id", "url")
    return p.select("page_id", r.is_url(F.col("url")).alias("is_url"), r.url_extension(F.col("url")).alias("extension"),
                    r.url_filename(F.col("url")).alias("filename"))


QUERIES = {
    "format_route": lambda s, d: runs(s, d).select("doc_id", "path", r.file_format(F.col("path")).alias("format")),
    "format_dim_join": _format_join,
    "office_type_route": lambda s, d: runs(s, d).select(
        "doc_id", F.regexp_replace(r.suffix(F.col("path")), "^[.]", "").alias("office_type")).select(
        "doc_id", "office_type", r.office_extension(F.col("office_type")).alias("extension"),
        r.office_type_error(F.col("office_type")).alias("error")),
    "url_route": _url,
    "mb_size": lambda s, d: flat(runs(s, d).select("doc_id", r.size_mb(F.col("size_bytes")).alias("size_mb"),
                                                   r.size_kb(F.col("size_bytes")).alias("size_kb"))),
    "output_name": lambda s, d: runs(s, d).select(
        "doc_id", r.output_name(F.col("path"), ".md").alias("md_name"),
        r.output_name(F.col("path"), ".pdf").alias("pdf_name"), r.output_name(F.col("path"), ".json").alias("json_name")),
    "lang_list": lambda s, d: load_table(s, d, "documents").select(
        "doc_id", F.array_join(r.lang_list(F.concat(F.col("lang"), F.lit(" , "), F.col("source"), F.lit(",en "))), "|")
        .alias("langs")),
    "valid_office_ext": lambda s, d: runs(s, d).select("doc_id", r.valid_office_file(F.col("path")).alias("valid")),
    "large_file_flag": lambda s, d: runs(s, d).select("doc_id", r.large_file(F.col("size_bytes")).alias("large")),
    "low_system_memory_flag": lambda s, d: sm.run_stats(samples(s, d)).select(
        "run_id", (F.col("before.available_mb") < r.LOW_MEMORY_MB).alias("low_memory")),
    "doc_limits": lambda s, d: dm.apply_limits(runs(s, d), max_file_size=50_000_000, max_seconds=60.0).select(
        "doc_id", "limit_reason"),
    "doc_run_stats": lambda s, d: flat(dm.doc_run_stats(runs(s, d))),
    "tables_exported": lambda s, d: dm.doc_run_stats(runs(s, d)).select("file_path", "tables_exported"),
    "batch_summary": lambda s, d: flat(dm.batch_summary(dm.doc_run_stats(runs(s, d)))),
    "format_breakdown": lambda s, d: dm.format_breakdown(dm.doc_run_stats(runs(s, d))),
    "conversion_counts": lambda s, d: dm.conversion_counts(dm.doc_run_stats(runs(s, d))),
    "batch_progress": lambda s, d: dm.batch_progress(dm.doc_run_stats(runs(s, d))).select("file_path", "idx", "progress"),
    "files_sorted": lambda s, d: runs(s, d).orderBy("path").select("path"),
    "retry_outcome": lambda s, d: sm.retry_outcome(attempts(s, d)),
    "error_log_classify": lambda s, d: runs(s, d).where(~F.col("ok")).select(
        "doc_id", dm.classify_error_log(F.col("error_msg")).alias("error")),
    "conversion_validate": lambda s, d: dm.validate_for_conversion(runs(s, d)).groupBy(
        F.coalesce(F.regexp_replace("reject_reason", "^Unsupported file type: .*", "unsupported"),
                   F.lit("accepted")).alias("reason"), "large_file").agg(F.count(F.lit(1)).alias("n")),
}
