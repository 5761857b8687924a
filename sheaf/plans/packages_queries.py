"""Registered office-package queries over fixture F3 (members built from ``pages``)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sheaf.operators import packages as pk
from sheaf.plans.common import flat
from sheaf.plans.fixtures import package_members
from sheaf.session import ensure_checkpoint_dir
from sheaf.sources import packages as src


def members(s, d):
    return package_members(s, d)


def _as_read(s, d):
    """The members with the bytes and the text that reading them from a package would give; a third is not UTF-8."""
    return members(s, d).select(
        "path", "member_ix", "member", "content", F.concat(F.encode(F.col("content"), "UTF-8"), F.when(
            F.length("content") % 3 == 0, F.unhex(F.lit("C3"))).otherwise(F.unhex(F.lit("")))).alias("raw")).withColumn(
        "readable", F.is_valid_utf8(F.col("raw").cast("string"))).withColumn("content", F.when(F.col("readable"), F.col("content")))


def _written(s, d):
    """Real packages in the shared folder, written from the members (numbered from 0 in each)."""
    folder = f"{ensure_checkpoint_dir(s).rstrip('/')}/packages-{uuid.uuid4().hex}"
    rows = _as_read(s, d).select("path", (F.col("member_ix") % 8).alias("member_ix"), "member", F.col("raw").alias("content_out"))
    src.write_packages(rows, folder).write.format("noop").mode("overwrite").save()
    return src.package_files(s, folder, "*.pptx")


def _discovered(s, d, suffixes):
    found = src.discover(s, _written(s, d).select("path").first()[0].rsplit("/", 1)[0], suffixes, recursive=False)
    return found.select(F.substring_index("path", "/", -1).alias("path"), (F.col("length") > 0).alias("has_bytes"))


def scans(s, d):
    return pk.link_scan(members(s, d))


def _findings(kind):
    return lambda s, d: pk.member_findings(members(s, d)).where(F.col("kind") == kind).select(
        "path", "member", "finding")


def _strip(fn, prefix, marker):
    def q(s, d):
        m = members(s, d)
        sel = m.where(F.col("member").startswith(prefix) & F.col("content").contains(marker))
        return sel.select("path", "member", fn(F.col("content")).alias("content_after"))
    return q


QUERIES = {
    "ole_slides": _findings(1),
    "chart_links": _findings(2),
    "external_rels": _findings(3),
    # real bytes: a third of the members end in a cut-off two-byte sequence
    "utf8_decodable": lambda s, d: members(s, d).select("path", "member", F.concat(
        F.encode(F.col("content"), "UTF-8"),
        F.when(F.length("content") % 3 == 0, F.unhex(F.lit("C3"))).otherwise(F.unhex(F.lit("")))).alias("raw")).select(
        "path", "member", F.is_valid_utf8(F.col("raw").cast("string")).alias("decodable")),
    "link_sources_union": lambda s, d: pk.member_findings(members(s, d)).select("path", "kind", "member", "finding"),
    "pkg_link_scan": lambda s, d: flat(scans(s, d).select(
        "path", "links_found", F.array_join("external_links", "|").alias("external_links"),
        F.array_join("link_types", "|").alias("link_types"), "is_sanitizable", "file_size_mb")),
    "pkg_risk": lambda s, d: scans(s, d).select("path", "risk_level", "risk_name"),
    "gate_decision": lambda s, d: pk.gate_decision(scans(s, d)).select("path", "action", "message"),
    "strip_ole": _strip(pk.strip_ole, "ppt/slides/", "<p:oleObj"),
    "strip_chart_links": _strip(pk.strip_chart_links, "ppt/charts/", "<c:externalData"),
    "strip_external_rels": lambda s, d: members(s, d).where(
        F.col("member").endswith(".rels") & F.col("content").contains('TargetMode="External"')).select(
        "path", "member", pk.strip_external_rels(F.col("content")).alias("content_after")),
    "sanitize_members": lambda s, d: pk.sanitize_members(members(s, d)).select(
        "path", "member", "changed", F.array_join("operations", "|").alias("operations"),
        F.octet_length("sanitized").alias("bytes_after")),
    "sanitize_ops": lambda s, d: pk.sanitize_ops(pk.sanitize_members(members(s, d))).select(
        "path", F.array_join("operations", "|").alias("operations"), "bytes_before", "bytes_after"),
    "pkg_rewrite_join": lambda s, d: pk.rewrite_members(_as_read(s, d)).select(
        "path", "member", F.hex("content_out").alias("content_out")),
    "pkg_members": lambda s, d: src.stream_members(src.member_directory(_written(s, d))).select(
        F.substring_index("path", "/", -1).alias("path"), "member_ix", "member", "part", "content", F.hex("raw").alias("raw"), "readable"),
    "office_discover": lambda s, d: _discovered(s, d, (".pptx", ".xlsx")),
    "doc_discover": lambda s, d: _discovered(s, d, (".pdf", ".pptx")),
}
