"""Registered table-export, text and task queries (F6 from ``part``, ``pages``,
``documents``, F8 from ``events``)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sheaf.functions import responses as rs
from sheaf.functions.text import chunk_starts, html_to_markdown
from sheaf.operators import office
from sheaf.operators import tables as tb
from sheaf.operators import tasks as tk
from sheaf.plans.common import flat
from sheaf.plans.fixtures import (memlog_files, package_members, requests, responses, table_cells, table_places, task_events,
                                  workbook_members)
from sheaf.session import cut_lineage, ensure_checkpoint_dir
from sheaf.sources.tables import load_table
from sheaf.streaming import folds

CHUNK_SIZE, CHUNK_OVERLAP = 1000, 100


def _chunks(s, d):
    # the pieces are exploded, not the text: each row carries its own piece only
    starts = chunk_starts(F.col("text"), CHUNK_SIZE, CHUNK_OVERLAP)
    pieces = F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring(
        F.col("text"), s, F.lit(CHUNK_SIZE)).alias("piece")))
    c = load_table(s, d, "documents").select("doc_id", F.posexplode(pieces).alias("chunk_ix", "c"))
    return c.select("doc_id", "chunk_ix", "c.start", F.length("c.piece").alias("n_chars"), F.md5("c.piece").alias("md5"))


def _results(s, d):
    docs = load_table(s, d, "documents")
    return docs.select(F.col("doc_id").alias("task_id"), F.col("n_chars").alias("result_chars"))


def _sheet_tables(s, d):
    return cut_lineage(office.sheet_tables(office.sheet_cells(workbook_members(s, d))))


def _streamed(s, d, build):
    """The rows that a stream over the memory log's files puts out until it has read them all."""
    folder = f"{ensure_checkpoint_dir(s).rstrip('/')}/stream-{uuid.uuid4().hex}"
    memlog_files(s, d, f"{folder}/in")
    df = build(f"{folder}/in")
    df.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return s.read.schema(df.schema).parquet(f"{folder}/out")


QUERIES = {
    "table_metadata": lambda s, d: tb.table_metadata(table_cells(s, d), table_places(s, d)).select(
        "table_id", "num_rows", "num_columns", F.array_join("headers", "|").alias("headers"), "has_headers",
        "total_cells", "grid_rows", "grid_cols", "page_number", F.array_join(F.col("bbox").cast("array<string>"), "|").alias("bbox")),
    "headers_preview": lambda s, d: tb.table_metadata(table_cells(s, d)).select("table_id", "headers_preview"),
    "table_to_csv": lambda s, d: tb.to_csv_lines(table_cells(s, d)),
    "table_to_markdown": lambda s, d: tb.to_markdown_lines(table_cells(s, d)),
    "table_to_json": lambda s, d: tb.to_json_lines(table_cells(s, d, repeated=True)),
    "table_to_html": lambda s, d: tb.to_html_lines(table_cells(s, d)),
    # The Markdown is computed once (a projection referenced twice is not inlined).
    "html_to_markdown": lambda s, d: load_table(s, d, "pages").select(
        "page_id", html_to_markdown(F.col("html")).alias("md")).select(
        "page_id", F.md5("md").alias("md5"), F.length("md").alias("n_chars")),
    "doc_chunk": _chunks,
    "responses_scan": lambda s, d: flat(rs.scan_responses(responses(s, d))),
    "response_select": lambda s, d: flat(responses(s, d).select("doc_id", rs.select_content(F.col("response"), F.col("output_format")).alias("c")).select(
        "doc_id", "c.content", "c.error", "c.processing_time")),
    "request_v1": lambda s, d: requests(s, d).select("doc_id", rs.request_v1(F.col("request")).alias("request")),
    "pptx_to_markdown": lambda s, d: office.slides_markdown(package_members(s, d)),
    "xlsx_to_cells": lambda s, d: office.sheet_cells(workbook_members(s, d)),
    # spreadsheets end to end: members, cells, tables, exports
    "sheet_to_csv": lambda s, d: tb.to_csv_lines(_sheet_tables(s, d)),
    "sheet_to_markdown": lambda s, d: tb.to_markdown_lines(_sheet_tables(s, d)),
    "stream_memlog": lambda s, d: flat(_streamed(s, d, lambda path: folds.stream_memlog(s, path)).drop("log_id", "block", "line_no")),
    "stream_orphans": lambda s, d: flat(_streamed(s, d, lambda path: folds.stream_orphans(folds.stream_memlog(s, path)))),
    "task_status_latest": lambda s, d: flat(tk.latest_status(task_events(s, d))),
    "task_results": lambda s, d: tk.task_results(tk.latest_status(task_events(s, d)), _results(s, d)).select(
        "task_id", "task_status", "result_chars", "has_result"),
}
