"""Office packages as member tables (F-4..F-6, F-12, J8, J9, C22, C23, C27, G1, G3-G6).

A package is a zip of named members. ``sources.packages.read_members`` turns
files into ``(path, member_ix, member, content, readable)`` rows; from then on
everything here is native column logic: findings per member, one conditional
aggregation per package, and rewriting members with ``regexp_replace``.

Findings keep zip order (``member_ix``); a package's lists are the feature the
scan reports, so they are collected per package (bounded by its member count).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Risk levels (ordered) and the markers the scan looks for.
# ---------------------------------------------------------------------------
RISK_LEVELS = {0: "SAFE", 1: "LOW", 2: "MEDIUM", 3: "HIGH", 4: "CRITICAL"}
SAFE, LOW, MEDIUM, HIGH, CRITICAL = 0, 1, 2, 3, 4
OLE_MARKERS = ("<p:oleObj", "oleObject")
CHART_MARKER = "<c:externalData"
EXTERNAL_MODE = 'TargetMode="External"'
NETWORK_TARGETS = ('Target="http://', 'Target="https://')
FILE_TARGET = 'Target="file://'
OLE_ELEMENT = r"(?s)<p:oleObj\b[^>]*/>|<p:oleObj\b.*?</p:oleObj>"
CHART_ELEMENT = r"(?s)<c:externalData.*?</c:externalData>"
AUTO_UPDATE_ELEMENT = r"(?s)<c:autoUpdate.*?/>"
EXTERNAL_REL_ELEMENT = r'<Relationship\b[^>]*TargetMode="External"[^>]*/>'
SCANNED_EXTENSIONS = (".pptx", ".ppt")


def risk_name(level: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in RISK_LEVELS.items() for x in kv])
    return m[level]


def member_findings(members: DataFrame) -> DataFrame:
    """F-4, F-5, F-6 (+ F-12): one row per member that is a finding, in zip order.

    ``kind``: 1 ole, 2 chart, 3 external_rel (the scan's list order). Members
    whose bytes are not UTF-8 are skipped (``readable`` false).
    """
    m, c = F.col("member"), F.col("content")
    ok = F.coalesce(F.col("readable"), F.lit(True)) if "readable" in members.columns else F.lit(True)
    ole = m.startswith("ppt/slides/slide") & m.endswith(".xml") & (c.contains(OLE_MARKERS[0]) | c.contains(OLE_MARKERS[1]))
    chart = m.startswith("ppt/charts/") & m.endswith(".xml") & c.contains(CHART_MARKER)
    ext = m.endswith(".rels") & c.contains(EXTERNAL_MODE)
    network = c.contains(NETWORK_TARGETS[0]) | c.contains(NETWORK_TARGETS[1])
    rel_text = (F.when(network, F.concat(F.lit("Network link in "), m))
                .when(c.contains(FILE_TARGET), F.concat(F.lit("File link in "), m)))
    # A member can be both a slide with OLE and (by name) nothing else; one finding per list.
    rows = F.array_compact(F.array(
        F.when(ole, F.struct(F.lit(1).alias("kind"), F.concat(F.lit("OLE in "), m).alias("finding"),
                             F.lit(False).alias("network"))),
        F.when(chart, F.struct(F.lit(2).alias("kind"), F.concat(F.lit("External data in "), m).alias("finding"),
                               F.lit(False).alias("network"))),
        F.when(ext & rel_text.isNotNull(), F.struct(F.lit(3).alias("kind"), rel_text.alias("finding"),
                                                     network.alias("network")))))
    return (members.select("path", "member_ix", "member", F.explode(F.when(ok, rows)).alias("f"))
            .select("path", "member_ix", "member", "f.*"))


def link_scan(members: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """C22 + C23 (J8 as one conditional aggregation): one row per package.

    ``packages`` (optional) lists every package with ``path, size_bytes, is_zip,
    readable``; without it the packages are those with members and the size is
    the sum of member sizes. Not-a-zip -> SAFE with its size; unreadable -> SAFE
    with size 0.
    """
    f = member_findings(members)
    per = f.groupBy("path").agg(
        F.sort_array(F.collect_list(F.struct("kind", "member_ix", "finding"))).alias("_l"),
        F.count_if(F.col("kind") == 1).alias("n_ole"), F.count_if(F.col("kind") == 2).alias("n_chart"),
        F.count_if(F.col("kind") == 3).alias("n_rel"), F.count_if(F.col("network")).alias("n_network"))
    if packages is None:
        packages = members.groupBy("path").agg(
            F.sum(F.octet_length("content")).cast("long").alias("size_bytes")).select(
            "path", "size_bytes", F.lit(True).alias("is_zip"), F.lit(True).alias("readable"))
    p = packages.join(per, "path", "left")
    n_links = F.coalesce(F.col("n_ole") + F.col("n_chart") + F.col("n_rel"), F.lit(0))
    types = F.array_compact(F.array(F.when(F.col("n_ole") > 0, F.lit("ole")),
                                    F.when(F.col("n_chart") > 0, F.lit("chart")),
                                    F.when(F.col("n_rel") > 0, F.lit("external_rel"))))
    risk = (F.when(n_links == 0, F.lit(SAFE)).when(F.col("n_ole") > 0, F.lit(HIGH))
            .when((F.col("n_chart") > 0) & (n_links > 3), F.lit(HIGH)).when(F.col("n_chart") > 0, F.lit(MEDIUM))
            .when(F.col("n_network") > 0, F.lit(MEDIUM)).otherwise(F.lit(LOW)))
    readable = F.col("is_zip") & F.col("readable")
    out = p.select(
        "path",
        F.when(readable, risk).otherwise(F.lit(SAFE)).alias("risk_level"),
        F.when(readable, F.coalesce(F.transform("_l", lambda x: x["finding"]), F.array().cast("array<string>")))
        .otherwise(F.array().cast("array<string>")).alias("external_links"),
        F.when(readable, types).otherwise(F.array().cast("array<string>")).alias("link_types"),
        F.when(F.col("readable"), F.col("size_bytes") / 1048576.0).otherwise(F.lit(0.0)).alias("file_size_mb"))
    return (out.withColumn("links_found", F.size("external_links"))
            .withColumn("is_sanitizable", F.col("risk_level") != CRITICAL)
            .withColumn("risk_name", risk_name(F.col("risk_level"))))


def gate_decision(scans: DataFrame, *, link_detection: bool = True, auto_sanitize: bool = True) -> DataFrame:
    """G1: what the converter does with each file before converting it.

    Adds ``action`` (proceed / sanitize / reject) and ``message``. Only .ppt/.pptx
    files are scanned. ``sanitize_ok`` (optional column) is the outcome of a
    sanitisation; a failed one falls back to the original file, except for
    CRITICAL risk, which is rejected.
    """
    ext = F.lower(F.regexp_extract(F.col("path"), r"(\.[^./\\]+)$", 1))
    scanned = F.lit(link_detection) & ext.isin(*SCANNED_EXTENSIONS)
    risky = scanned & (F.col("risk_level") >= MEDIUM)
    crit = F.col("risk_level") == CRITICAL
    san_ok = F.coalesce(F.col("sanitize_ok"), F.lit(True)) if "sanitize_ok" in scans.columns else F.lit(True)
    can_sanitize = F.lit(auto_sanitize) & F.col("is_sanitizable")
    action = (F.when(~risky, F.lit("proceed"))
              .when(can_sanitize & san_ok, F.lit("sanitize"))
              .when(can_sanitize & crit, F.lit("reject"))
              .when(can_sanitize, F.lit("proceed"))
              .when(crit, F.lit("reject"))
              .otherwise(F.lit("proceed")))
    message = (F.when(~risky, F.lit(""))
               .when(can_sanitize & san_ok, F.concat(F.lit("sanitize "), F.col("risk_name"), F.lit(" risk file")))
               .when(can_sanitize & crit, F.lit("Critical risk file - sanitization failed"))
               .when(can_sanitize, F.lit("sanitization failed, converting original"))
               .when(crit, F.lit("Critical risk file with external links - skipping to prevent OOM"))
               .otherwise(F.concat(F.lit("File has "), F.col("risk_name"),
                                   F.lit(" risk but proceeding without sanitization"))))
    return scans.withColumn("action", action).withColumn("message", message)


def strip_ole(c: Column) -> Column:
    """Drop complete ``<p:oleObj .../>`` and ``<p:oleObj ...>...</p:oleObj>`` elements (text removal)."""
    return F.regexp_replace(c, OLE_ELEMENT, "")


def strip_chart_links(c: Column) -> Column:
    """Drop externalData elements, then ``<c:autoUpdate .../>``; an unclosed start stays."""
    return F.regexp_replace(F.regexp_replace(c, CHART_ELEMENT, ""), AUTO_UPDATE_ELEMENT, "")


def strip_external_rels(c: Column) -> Column:
    """Drop Relationship elements whose TargetMode is External."""
    return F.regexp_replace(c, EXTERNAL_REL_ELEMENT, "")


def sanitize_members(members: DataFrame, parity: bool = True) -> DataFrame:
    """G6 + J9: rewritten content per member and the operation it caused.

    Only members whose name ends with ``.xml`` are visited (so with ``parity``
    the ``.rels`` rule never fires, as in the original sanitiser); members that
    are not UTF-8 are left as they are.
    """
    m, c = F.col("member"), F.col("content")
    ok = F.coalesce(F.col("readable"), F.lit(True)) if "readable" in members.columns else F.lit(True)
    visit = ok & (m.endswith(".xml") | F.lit(not parity) & m.endswith(".rels"))
    ole = visit & m.startswith("ppt/slides/") & c.contains("<p:oleObj")
    chart = visit & m.startswith("ppt/charts/") & c.contains(CHART_MARKER)
    rels = visit & m.endswith(".rels") & c.contains(EXTERNAL_MODE)
    s1 = F.when(ole, strip_ole(c)).otherwise(c)
    s2 = F.when(chart, strip_chart_links(s1)).otherwise(s1)
    s3 = F.when(rels, strip_external_rels(s2)).otherwise(s2)
    ops = F.array_compact(F.array(F.when(ole, F.concat(F.lit("Removed OLE from "), m)),
                                  F.when(chart, F.concat(F.lit("Broke chart links in "), m)),
                                  F.when(rels, F.concat(F.lit("Removed external rels in "), m))))
    return members.withColumn("sanitized", s3).withColumn("operations", ops) \
        .withColumn("changed", F.col("sanitized") != c)


def rewrite_members(members: DataFrame, parity: bool = True) -> DataFrame:
    """Every member's bytes after sanitising; a member that is not text keeps its ``raw`` bytes."""
    out = sanitize_members(members, parity)
    text = F.encode("sanitized", "UTF-8")
    whole = F.coalesce(text, F.col("raw")) if "raw" in members.columns else text
    return out.select("path", "member_ix", "member", whole.alias("content_out"), *(["part"] if "part" in members.columns else []))


def sanitize_ops(sanitized: DataFrame) -> DataFrame:
    """Operations per package in zip order, content size before and after (bytes of
    uncompressed member content)."""
    return sanitized.groupBy("path").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("member_ix", "operations"))),
                              lambda x: x["operations"])).alias("operations"),
        F.sum(F.octet_length("content")).cast("long").alias("bytes_before"),
        F.sum(F.octet_length("sanitized")).cast("long").alias("bytes_after"))
