"""Batch document runs (C18-C20, C26, E5, F-11, G2, P16, W6).

Input: one row per processed document with ``path, size_bytes, ok`` and the
per-document counts. Everything is a projection or a partial/final aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions import routing as r
from sheaf.operators.indexing import dense_index

# The converter's error summary (message text and excerpt length) as it reports them.
ERROR_TEXT_CHARS = 300
OOM_MESSAGE = "OUT OF MEMORY detected in LibreOffice logs"


def classify_error_log(text: Column) -> Column:
    """Memory failures get a fixed message, anything else its first 300 characters."""
    low = F.lower(text)
    return (F.when(text.isNull() | (text == ""), F.lit(""))
            .when(low.contains("out of memory") | low.contains("cannot allocate"), F.lit(OOM_MESSAGE))
            .otherwise(F.substring(text, 1, ERROR_TEXT_CHARS)))


def doc_run_stats(runs: DataFrame) -> DataFrame:
    """E5 + C20: one record per document; a failed document keeps its error and zero counts."""
    exported = F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in
                            ("tables_csv", "tables_md", "tables_json", "tables_html")])
    return runs.select(
        r.base_name(F.col("path")).alias("filename"), F.col("path").alias("file_path"),
        r.size_mb(F.col("size_bytes")).alias("file_size_mb"), r.file_format(F.col("path")).alias("format"),
        F.col("ok").alias("success"),
        F.when(F.col("ok"), F.col("tables_found")).otherwise(F.lit(0)).alias("tables_found"),
        F.when(F.col("ok"), exported).otherwise(F.lit(0)).alias("tables_exported"),
        F.when(F.col("ok"), F.col("images_extracted")).otherwise(F.lit(0)).alias("images_extracted"),
        F.when(F.col("ok"), F.col("page_images_extracted")).otherwise(F.lit(0)).alias("page_images_extracted"),
        F.round(F.col("run_seconds"), 2).alias("processing_time_seconds"),
        F.when(~F.col("ok"), F.col("error_msg")).alias("error"))


def batch_summary(stats: DataFrame) -> DataFrame:
    """One row; failed = total - successful."""
    return stats.agg(
        F.count(F.lit(1)).alias("total_files"), F.count_if("success").alias("successful"),
        F.sum("tables_found").cast("long").alias("total_tables_extracted"),
        F.sum("images_extracted").cast("long").alias("total_images_extracted"),
        F.sum("page_images_extracted").cast("long").alias("total_page_images_extracted"),
        F.sum("processing_time_seconds").alias("total_processing_time_seconds"),
    ).withColumn("failed", F.col("total_files") - F.col("successful"))


def format_breakdown(stats: DataFrame) -> DataFrame:
    """Count and successes per format (NULL format reads 'None')."""
    return (stats.groupBy(F.coalesce(F.col("format"), F.lit("None")).alias("format"))
            .agg(F.count(F.lit(1)).alias("count"), F.count_if("success").alias("success")))


def format_breakdown_map(stats: DataFrame) -> DataFrame:
    """C19 as the batch summary nests it: one row, map format -> {count, success}."""
    fb = format_breakdown(stats)
    return fb.agg(F.map_from_entries(F.collect_list(F.struct(
        "format", F.struct("count", "success")))).alias("format_breakdown"))


def conversion_counts(stats: DataFrame) -> DataFrame:
    """Total / successful / failed for the slide-and-sheet tool (.pptx, .xlsx)."""
    sel = stats.where(F.lower(r.suffix(F.col("file_path"))).isin(*r.MARKDOWN_TOOL_EXTENSIONS))
    return sel.agg(F.count(F.lit(1)).alias("total"), F.count_if("success").alias("successful")) \
        .withColumn("failed", F.col("total") - F.col("successful"))


def batch_progress(stats: DataFrame) -> DataFrame:
    """``[idx/total]`` in path order."""
    total = stats.select(F.count(F.lit(1))).scalar()
    ix = dense_index(stats, ["file_path"], out="idx")
    return ix.withColumn("progress", F.format_string("[%d/%d]", F.col("idx"), total))


def apply_limits(runs: DataFrame, *, max_file_size: int | None = None, max_num_pages: int | None = None,
                 max_seconds: float | None = None) -> DataFrame:
    """F-11: reason a document is over a limit (NULL = within limits). Unset limits are ignored;
    a set one needs its column (``size_bytes``, ``num_pages``, ``run_seconds``)."""
    reasons = []
    if max_file_size is not None:
        reasons.append(F.when(F.col("size_bytes") > max_file_size, F.lit("file too large")))
    if max_num_pages is not None:
        if "num_pages" not in runs.columns:
            raise ValueError("max_num_pages needs a column num_pages")
        reasons.append(F.when(F.col("num_pages") > max_num_pages, F.lit("too many pages")))
    if max_seconds is not None:
        reasons.append(F.when(F.col("run_seconds") > max_seconds, F.lit("timeout")))
    reason = F.coalesce(*reasons) if reasons else F.lit(None).cast("string")
    return runs.withColumn("limit_reason", reason)


def validate_for_conversion(files: DataFrame, path_col: str = "path") -> DataFrame:
    """G2 + F-1 + F-2: why a file cannot go to the office converter (NULL = accepted)."""
    p = F.col(path_col)
    exists = F.col("exists") if "exists" in files.columns else F.lit(True)
    is_file = F.col("is_file") if "is_file" in files.columns else F.lit(True)
    reason = (F.when(~exists, F.concat(F.lit("File not found: "), p))
              .when(~is_file, F.concat(F.lit("Not a file: "), p))
              .when(~r.valid_office_file(p), F.concat(F.lit("Unsupported file type: "), r.suffix(p))))
    return files.withColumn("reject_reason", reason).withColumn("large_file", r.large_file(F.col("size_bytes")))
