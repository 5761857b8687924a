"""Office content from package members (P22 slides, P23 sheets)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions.text import slide_text, xml_unescape

SHARED_ITEM = r"(?s)<si\s*/>|<si\b[^>]*>.*?</si>"
PHONETIC = r"(?s)<rPh\b.*?</rPh>"
RUN = r"(?s)<t(?:\s[^>]*)?(?<!/)>(.*?)</t>"


def _runs(xml):
    """Text of the ``<t>`` runs of an element, without phonetic guides; empty where there are none."""
    return xml_unescape(F.array_join(F.regexp_extract_all(F.regexp_replace(xml, PHONETIC, ""), F.lit(RUN), 1), ""))


def slides_markdown(members: DataFrame) -> DataFrame:
    """One Markdown text per deck: a heading per slide (slide number from the
    member name) followed by its text runs, slides in number order."""
    s = members.where(F.col("member").rlike(r"^ppt/slides/slide\d+\.xml$")).select(
        "path", F.regexp_extract("member", r"slide(\d+)\.xml$", 1).cast("int").alias("slide"),
        slide_text(F.col("content")).alias("text"))
    return s.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("slide", "text"))),
                                                          lambda x: F.format_string("## Slide %d\n\n%s", x["slide"], x["text"])),
                                              "\n\n").alias("markdown"))


def sheet_cells(members: DataFrame) -> DataFrame:
    """Cells of every worksheet as ``(path, sheet, cell_ref, row_ix, col_ix, value)``.

    Shared strings (``t="s"``) are resolved by an equi-join with the package's
    string table on (path, index); other cells keep their literal value.
    """
    ss = members.where(F.col("member") == "xl/sharedStrings.xml").select(
        "path", F.posexplode(F.regexp_extract_all("content", F.lit(SHARED_ITEM), 0)).alias("ix", "si"))
    ss = ss.select("path", "ix", _runs(F.col("si")).alias("shared"))
    sheets = members.where(F.col("member").rlike(r"^xl/worksheets/sheet\d+\.xml$")).select(
        "path", F.regexp_extract("member", r"sheet(\d+)\.xml$", 1).cast("int").alias("sheet"),
        F.explode(F.regexp_extract_all("content", F.lit(r"(?s)(<c\b[^>]*?(?:/>|>.*?</c>))"), 1)).alias("c"))
    cells = sheets.select(
        "path", "sheet", F.regexp_extract("c", r'\br="([A-Z]+\d+)"', 1).alias("cell_ref"),
        F.regexp_extract("c", r'\bt="([^"]*)"', 1).alias("t"),
        xml_unescape(F.regexp_extract("c", r"(?s)<v>(.*?)</v>", 1)).alias("v"),
        _runs(F.regexp_extract("c", r"(?s)<is>(.*?)</is>", 1)).alias("inline"))
    letters = F.regexp_extract("cell_ref", r"^([A-Z]+)", 1)
    col_ix = F.aggregate(F.split(letters, ""), F.lit(0), lambda acc, ch: acc * 26 + (F.ascii(ch) - 64)) - 1
    cells = cells.withColumn("row_ix", F.regexp_extract("cell_ref", r"(\d+)$", 1).cast("int") - 1) \
        .withColumn("col_ix", col_ix.cast("int")).withColumn("ix", F.when(F.col("t") == "s", F.col("v").try_cast("int")))
    joined = cells.join(ss, ["path", "ix"], "left")
    value = F.when(F.col("t") == "s", F.col("shared")).when(F.col("t") == "inlineStr", F.col("inline")).otherwise(F.col("v"))
    return joined.select("path", "sheet", "cell_ref", "row_ix", "col_ix", value.alias("value"))


def sheet_tables(cells: DataFrame) -> DataFrame:
    """Cells of ``sheet_cells`` in the long form of the table exports: a table per sheet.

    The first row that has cells is the header; the other rows are numbered from 0. A column without a header cell
    has an empty header; a sheet with a header only has no rows.
    """
    keyed = cells.withColumn("table_id", F.concat("path", F.lit("#"), F.col("sheet").cast("string")))
    top = keyed.groupBy("table_id").agg(F.min("row_ix").alias("_top"))
    keyed = keyed.join(top, "table_id")
    head = keyed.where("row_ix = _top").select("table_id", "col_ix", F.col("value").alias("header"))
    body = keyed.where("row_ix > _top").select("table_id", (F.col("row_ix") - F.col("_top") - 1).cast("long").alias("row_ix"),
                                               "col_ix", F.col("value").alias("cell"))
    return body.join(head, ["table_id", "col_ix"], "left").select("table_id", "row_ix", "col_ix", "header", "cell")
