"""Conversion-log lines (P3, P4): one typed event per line.

Five patterns are tried. When several match one line, the later one in the order
ENTRY < ATTEMPT < LINK_SCAN < SUCCESS < CONVERTED gives the event, and each field comes from the
latest of the matching patterns that has it. Every pattern contains a literal tag, tested first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.memlog import SEP, capture_groups

# ---------------------------------------------------------------------------
# The conversion-log formats to recognise. (?U) gives \w, \s, \d
# their Unicode meaning, as in the producer's language.
# ---------------------------------------------------------------------------
TS_PATTERN = r"(?U)^\[?(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})\]?"
ENTRY_PATTERN = r"(?U)\[ENTRY\]\s+convert_office_to_pdf\s+called:\s+type=(\w+),\s+size=([\d.]+)MB,\s+max_retries=(\d+)"
ATTEMPT_PATTERN = r"(?U)\[Attempt\s+(\d+)/(\d+)\]\s+Converting\s+(\w+)_input_([^\s]+)\s+\(([\d.]+)MB\)"
LINK_SCAN_PATTERN = (r"(?U)\[LINK_SCAN\]\s+file=['\"]?([^'\"]+)['\"]?\s+external_links_found=(\d+)\s+"
                     r"link_types=\[([^\]]*)\]")
# The producer's own wording (risk=, links_found=, types=); read only with lenient=True.
LINK_SCAN_PRODUCER = (r"(?U)\[LINK_SCAN\]\s+file=['\"]?([^'\"]+)['\"]?\s+risk=\w+\s+links_found=(\d+)\s+"
                      r"types=\[([^\]]*)\]")
SUCCESS_PATTERN = r"(?U)\[SUCCESS\]\s+(\w+)\s+conversion\s+completed,\s+PDF\s+size:\s+([\d.]+)MB"
CONVERTED_PATTERN = r"(?U)Converted\s+(\w+_input_[^\s]+)\s+to\s+PDF\s+\(([\d.]+)MB\)\s+in\s+([\d.]+)s"
MAX_RETRIES = 2

EVENT_SCHEMA_COLS = ("log_id", "block", "line_no", "timestamp", "event_type", "filename", "file_type", "attempt",
                     "input_size", "links_found", "link_types", "pdf_size", "conversion_time")


def split_link_types(text: Column) -> Column:
    """``'a', 'b'`` -> [a, b]. Items blank after trimming whitespace are dropped;
    quotes are stripped afterwards, so ``''`` stays as an empty string."""
    ws = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    parts = F.split(text, ",")
    kept = F.filter(parts, lambda x: ws(x) != "")
    return F.transform(kept, lambda x: F.regexp_replace(ws(x), "^['\"]+|['\"]+$", ""))


def parse_convlog(lines: DataFrame, lenient: bool = False) -> DataFrame:
    """One row per line that carries an event, with typed nullable fields."""
    line = F.col("line")
    scan = capture_groups(line, LINK_SCAN_PATTERN, 3, "\u0002L")
    if lenient:
        scan = F.when(scan.startswith("\u0002L" + SEP), scan).otherwise(capture_groups(line, LINK_SCAN_PRODUCER, 3, "\u0002L"))
    captured = {"C": ("Converted", capture_groups(line, CONVERTED_PATTERN, 3, "\u0002C")),
                "U": ("[SUCCESS]", capture_groups(line, SUCCESS_PATTERN, 2, "\u0002U")), "L": ("[LINK_SCAN]", scan),
                "A": ("[Attempt", capture_groups(line, ATTEMPT_PATTERN, 5, "\u0002A")),
                "N": ("[ENTRY]", capture_groups(line, ENTRY_PATTERN, 3, "\u0002N"))}
    t = lines.select("log_id", "block", "line_no", F.regexp_extract(line, TS_PATTERN, 1).alias("_ts"),
                     *[F.when(line.contains(tag), groups).alias(k) for k, (tag, groups) in captured.items()])
    # groups of each pattern, NULL where it did not match; the marker is item 0
    t = t.select("log_id", "block", "line_no", "_ts", *[
        F.when(F.col(k).startswith(f"\u0002{k}{SEP}"), F.split(k, SEP)).alias(k) for k in captured])
    hit = lambda k: F.col(k).isNotNull()
    g = lambda k, i: F.col(k).getItem(i)
    ev = (F.when(hit("C"), "CONVERTED").when(hit("U"), "SUCCESS").when(hit("L"), "LINK_SCAN").when(hit("A"), "ATTEMPT")
          .when(hit("N"), "ENTRY"))
    rec = F.struct(
        F.col("log_id"), F.col("block"), F.col("line_no"),
        F.when(F.col("_ts") != "", F.col("_ts")).alias("timestamp"), ev.alias("event_type"),
        F.coalesce(g("C", 1), g("L", 1), F.concat(g("A", 3), F.lit("_input_"), g("A", 4))).alias("filename"),
        F.coalesce(g("U", 1), g("A", 3), g("N", 1)).alias("file_type"),
        g("A", 1).try_cast("int").alias("attempt"), g("A", 5).try_cast("double").alias("input_size"),
        g("L", 2).try_cast("int").alias("links_found"), F.when(hit("L"), split_link_types(g("L", 3))).alias("link_types"),
        F.when(hit("C"), g("C", 2)).otherwise(g("U", 2)).try_cast("double").alias("pdf_size"),
        g("C", 3).try_cast("double").alias("conversion_time"))
    # Generator instead of a filter: see parse_memlog.
    return t.select(F.explode(F.array_compact(F.array(F.when(ev.isNotNull(), rec)))).alias("r")).select("r.*")


def truncate_text(c: Column, width: int, keep: int) -> Column:
    """Longer than ``width`` -> first ``keep`` characters + '...'."""
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, keep), F.lit("..."))).otherwise(c)
