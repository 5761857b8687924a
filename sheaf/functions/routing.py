"""File, URL and type routing (P5-P8, P18, P19, F-1, F-2) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Supported input extensions and their formats (15 -> 7).
# ---------------------------------------------------------------------------
FILE_FORMATS = {
    ".pdf": "pdf",
    ".docx": "docx", ".pptx": "pptx", ".xlsx": "xlsx",
    ".png": "image", ".jpg": "image", ".jpeg": "image", ".tiff": "image", ".tif": "image", ".bmp": "image",
    ".webp": "image",
    ".html": "html", ".htm": "html", ".md": "md", ".markdown": "md",
}
# Office type aliases accepted by the bytes converter (case-insensitive).
OFFICE_TYPE_EXTENSIONS = {
    "powerpoint": ".pptx", "ppt": ".pptx", "pptx": ".pptx",
    "excel": ".xlsx", "xls": ".xlsx", "xlsx": ".xlsx",
    "word": ".docx", "doc": ".docx", "docx": ".docx",
}
# Extensions the office converter accepts.
VALID_OFFICE_EXTENSIONS = (".pptx", ".ppt", ".odp", ".xlsx", ".xls", ".ods", ".docx", ".doc", ".odt")
# Extensions handled by the slide/sheet to Markdown tool.
MARKDOWN_TOOL_EXTENSIONS = (".pptx", ".xlsx")
LARGE_FILE_MB = 100
LOW_MEMORY_MB = 1000


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def suffix(path: Column) -> Column:
    """Suffix of the last path component: from its last dot, if that dot is neither
    the first nor the last character; '' otherwise."""
    return F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    name = base_name(path)
    sfx = suffix(path)
    return F.when(sfx == "", name).otherwise(F.left(name, F.length(name) - F.length(sfx)))


def splitext_ext(name: Column) -> Column:
    """Extension as a path split sees it: leading dots ignored, a trailing dot counts."""
    return F.regexp_extract(name, r"^\.*[^.].*(\.[^.]*)$", 1)


def format_map(spark: SparkSession):
    """M13 dimension (15 rows, fixed): broadcast-safe by construction."""
    return spark.createDataFrame(sorted(FILE_FORMATS.items()), "ext string, format string")


def office_type_map(spark: SparkSession):
    return spark.createDataFrame(sorted(OFFICE_TYPE_EXTENSIONS.items()), "office_type string, extension string")


def file_format(path: Column) -> Column:
    """P5 without a join: the same fixed mapping as a map literal."""
    m = F.create_map(*[F.lit(x) for kv in sorted(FILE_FORMATS.items()) for x in kv])
    return m[F.lower(suffix(path))]


def office_extension(office_type: Column) -> Column:
    """Alias -> extension; NULL for an unknown type (see office_type_error)."""
    m = F.create_map(*[F.lit(x) for kv in sorted(OFFICE_TYPE_EXTENSIONS.items()) for x in kv])
    return m[F.lower(office_type)]


def office_type_error(office_type: Column) -> Column:
    keys = ", ".join(f"'{k}'" for k in OFFICE_TYPE_EXTENSIONS)
    return F.when(office_extension(office_type).isNull(),
                  F.concat(F.lit("Unsupported office type: "), office_type,
                           F.lit(f". Supported types: [{keys}]")))


def is_url(path: Column) -> Column:
    return path.startswith("http://") | path.startswith("https://")


def url_path(url: Column) -> Column:
    """Path part of a URL: after scheme://host, before ? or #."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def url_extension(url: Column) -> Column:
    """Lower-cased extension of the URL path, '.html' when there is none."""
    ext = F.lower(splitext_ext(base_name(url_path(url))))
    return F.when(ext == "", F.lit(".html")).otherwise(ext)


def url_filename(url: Column) -> Column:
    """Base name (or 'downloaded_content'), extension appended when the name does
    not already end with the lower-cased extension."""
    name = base_name(url_path(url))
    name = F.when(name == "", F.lit("downloaded_content")).otherwise(name)
    ext = url_extension(url)
    return F.when(name.endswith(ext), name).otherwise(F.concat(name, ext))


def size_mb(size_bytes: Column) -> Column:
    """P8."""
    return size_bytes / (1024.0 * 1024.0)


def size_kb(size_bytes: Column) -> Column:
    return size_bytes / 1024.0


def output_name(path: Column, ext: str) -> Column:
    """Stem + new extension."""
    return F.concat(stem(path), F.lit(ext))


def lang_list(text: Column) -> Column:
    """Comma-separated list -> trimmed items."""
    return F.transform(F.split(text, ","), lambda x: F.trim(x))


def valid_office_file(path: Column) -> Column:
    """F-1."""
    return F.lower(suffix(path)).isin(*VALID_OFFICE_EXTENSIONS)


def large_file(size_bytes: Column, limit_mb: float = LARGE_FILE_MB) -> Column:
    """F-2: warning flag only."""
    return size_mb(size_bytes) > limit_mb
