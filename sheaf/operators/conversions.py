"""Conversion-log fold (C14, C15, J3, J4, C16, C17, S2, F-9): one record per document.

Per log (``log_id``) the rule is defined as a walk over lines in order with a map of
conversions keyed by file name and a "current file" cursor. Here:

* C15 current file: bucketed carry-forward of the last ATTEMPT file name.
* Conversions: one row per (log, file name) from its ATTEMPTs (first ATTEMPT
  fixes type and timestamp, the last one attempt and input size).
* J3 scan target: first-created conversion (created before the scan) whose name
  contains the scan name or is contained in it; else the current file. Names meet
  in an index of rare grams (``containment``), once per different scan name of a
  log: its first-created match is the target of every scan after that.
* J4: CONVERTED joins by exact name to a conversion created before it.
* Last writer wins for links (scans) and pdf size (SUCCESS/CONVERTED); success is
  sticky.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions.convlog import MAX_RETRIES
from sheaf.operators.carry import carry_last
from sheaf.operators.containment import contained_names
from sheaf.session import cut_lineage

ORDER = ["block", "line_no"]


def _pos() -> F.Column:
    return F.struct(*[F.col(c) for c in ORDER])


def with_current_file(events: DataFrame) -> DataFrame:
    """File name of the last ATTEMPT at or before each event of the same log."""
    return carry_last(events, keys=["log_id"], bucket="block", order=ORDER,
                      value=F.when(F.col("event_type") == "ATTEMPT", F.col("filename")), out="current_file")


def conversions(events: DataFrame) -> DataFrame:
    """One row per (log, file name) first seen in an ATTEMPT."""
    att = events.where(F.col("event_type") == "ATTEMPT")
    return att.groupBy("log_id", "filename").agg(
        F.min(_pos()).alias("created"),
        F.min_by("file_type", _pos()).alias("file_type"),
        F.min_by("timestamp", _pos()).alias("timestamp"),
        F.max_by("attempt", _pos()).alias("attempt_number"),
        F.max_by("input_size", F.when(F.col("input_size").isNotNull(), _pos())).alias("input_size_mb"))


def scan_targets(events: DataFrame, convs: DataFrame | None = None, with_current: DataFrame | None = None) -> DataFrame:
    """The conversion each LINK_SCAN updates (NULL when none)."""
    ev = with_current_file(events) if with_current is None else with_current
    convs = conversions(events) if convs is None else convs
    scans = (ev.where(F.col("event_type") == "LINK_SCAN")
             .select("log_id", "block", "line_no", F.col("filename").alias("scan_name"), "current_file",
                     "links_found", "link_types", _pos().alias("pos")))
    best = scan_matches(convs, scans.select("log_id", "scan_name").distinct())
    out = scans.join(best, on=["log_id", "scan_name"], how="left").withColumn(
        "matched", F.when(F.col("created") < F.col("pos"), F.col("cand")))
    return out.select("log_id", "block", "line_no", "scan_name", "matched", "current_file",
                      F.coalesce("matched", "current_file").alias("target"), "links_found", "link_types")


def scan_matches(convs: DataFrame, scan_names: DataFrame) -> DataFrame:
    """log_id, scan_name, cand, created: the first-created conversion whose name contains the scan name or is contained in it."""
    names = convs.select("log_id", F.col("filename").alias("name"), F.lit(True).alias("is_conv"), "created").unionByName(
        scan_names.select("log_id", F.col("scan_name").alias("name"), F.lit(False).alias("is_conv")), allowMissingColumns=True)
    pairs = contained_names(cut_lineage(names), ["log_id"], "name", "is_conv", ["created"])
    inner = F.col("inner_side")
    cand = F.when(inner, F.col("inner")).otherwise(F.col("outer"))
    scan = F.when(inner, F.col("outer")).otherwise(F.col("inner"))
    created = F.coalesce("inner_created", "outer_created")
    return pairs.select("log_id", scan.alias("scan_name"), cand.alias("cand"), created.alias("created")).groupBy(
        "log_id", "scan_name").agg(F.min_by("cand", "created").alias("cand"), F.min("created").alias("created"))


def converted_targets(events: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """CONVERTED lines whose exact file name was created by an earlier ATTEMPT."""
    convs = conversions(events) if convs is None else convs
    cv = events.where(F.col("event_type") == "CONVERTED").withColumn("pos", _pos())
    return (cv.join(convs.select("log_id", "filename", "created"), on=["log_id", "filename"], how="left")
            .withColumn("matched", F.when(F.col("created") < F.col("pos"), F.col("filename")))
            .select("log_id", "block", "line_no", "filename", "matched", "pdf_size", "conversion_time"))


def conversion_records(events: DataFrame) -> DataFrame:
    """C14: one row per converted document and log, as the fold leaves it."""
    convs = conversions(events)
    ev = with_current_file(events)
    scans = (scan_targets(events, convs, ev).where(F.col("target").isNotNull())
             .groupBy("log_id", F.col("target").alias("filename"))
             .agg(F.max_by(F.struct("links_found", "link_types"), F.struct(*[F.col(c) for c in ORDER])).alias("s")))
    succ = (ev.where((F.col("event_type") == "SUCCESS") & F.col("current_file").isNotNull())
            .select("log_id", F.col("current_file").alias("filename"), _pos().alias("pos"), "pdf_size",
                    F.lit(None).cast("double").alias("conversion_time"), F.lit(False).alias("is_conv")))
    conv = (converted_targets(events, convs).where(F.col("matched").isNotNull())
            .select("log_id", F.col("matched").alias("filename"), _pos().alias("pos"), "pdf_size",
                    "conversion_time", F.lit(True).alias("is_conv")))
    done = succ.unionByName(conv).groupBy("log_id", "filename").agg(
        F.count(F.lit(1)).alias("n_done"),
        F.max_by("pdf_size", "pos").alias("pdf_size_mb"),
        F.max_by("conversion_time", F.when(F.col("is_conv"), F.col("pos"))).alias("conversion_time_seconds"))
    out = convs.join(scans, on=["log_id", "filename"], how="left").join(done, on=["log_id", "filename"], how="left")
    links = F.coalesce(F.col("s.links_found"), F.lit(0))
    return out.select(
        "log_id", "filename", "file_type",
        F.coalesce(F.col("s.links_found") > 0, F.lit(False)).alias("has_links"),
        links.alias("links_found"),
        F.coalesce(F.col("s.link_types"), F.array().cast("array<string>")).alias("link_types"),
        F.coalesce(F.col("n_done") > 0, F.lit(False)).alias("conversion_successful"),
        "input_size_mb", "pdf_size_mb", "conversion_time_seconds", "attempt_number",
        F.lit(MAX_RETRIES).alias("max_retries"), F.coalesce(F.col("timestamp"), F.lit("")).alias("timestamp"),
        "created")


def conversion_summary(records: DataFrame) -> DataFrame:
    """Totals and rates (percentages NULL when their base is 0)."""
    return records.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("conversion_successful").alias("successful"),
        F.count_if("has_links").alias("with_links"),
        F.count_if(F.col("has_links") & F.col("conversion_successful")).alias("successful_with_links"),
    ).select("*",
             F.when(F.col("total") > 0, 100.0 * F.col("successful") / F.col("total")).alias("success_pct"),
             F.when(F.col("with_links") > 0, 100.0 * F.col("successful_with_links") / F.col("with_links"))
             .alias("links_success_pct"))


def conversions_by_type(records: DataFrame) -> DataFrame:
    """C17: excel and powerpoint only; a type with no documents has no row."""
    return (records.where(F.col("file_type").isin("excel", "powerpoint")).groupBy("file_type")
            .agg(F.count(F.lit(1)).alias("total"), F.count_if("conversion_successful").alias("successful")))


def detail_sorted(records: DataFrame) -> DataFrame:
    """Documents with links first, then by file name."""
    return records.orderBy(F.col("has_links").desc(), F.col("filename"))


def docs_with_links(records: DataFrame) -> DataFrame:
    """F-9."""
    return records.where(F.col("has_links"))
