"""Extracted tables (C21, E1-E4, S6) from long-form cells.

Cells: ``table_id, row_ix, col_ix, header, cell``. Exports are produced as
ordered lines (``line_ix`` 0 is the header part), one row per table row, so a
table is never gathered into one value; the sinks write the lines per table in
order. Row assembly groups by (table, row), bounded by the column count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER_PREVIEW = 5


def csv_field(c: Column) -> Column:
    """Quote a CSV field only when it holds a comma, quote or line break."""
    needs = c.rlike('[,"\\r\\n]')
    return F.when(needs, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def md_cell(c: Column) -> Column:
    return F.replace(c, F.lit("|"), F.lit("\\|"))


def headers(cells: DataFrame) -> DataFrame:
    """Column numbers and header list per table in column order (distinct columns first, then ordered collect).

    A column without a header has an empty one.
    """
    cols = cells.groupBy("table_id", "col_ix").agg(F.coalesce(F.min("header"), F.lit("")).alias("header"))
    both = F.sort_array(F.collect_list(F.struct("col_ix", "header")))
    return cols.groupBy("table_id").agg(F.transform(both, lambda x: x["col_ix"]).alias("cols"),
                                        F.transform(both, lambda x: x["header"]).alias("headers"))


def table_rows(cells: DataFrame) -> DataFrame:
    """One row per (table, row) with a cell for every column of the table, in column order.

    NULL and absent cells are empty strings; of several cells in one place the smallest counts.
    """
    rows = cells.groupBy("table_id", "row_ix").agg(
        F.sort_array(F.collect_list(F.struct("col_ix", F.coalesce("cell", F.lit("")).alias("cell")))).alias("_given"))
    own = F.transform("_given", lambda x: x["col_ix"])
    gaps = F.transform("cols", lambda c: F.coalesce(
        F.get(F.filter("_given", lambda x: x["col_ix"] == c), F.lit(0))["cell"], F.lit("")))
    # only a row with gaps or repeats looks its columns up
    grid = F.when(own == F.col("cols"), F.transform("_given", lambda x: x["cell"])).otherwise(gaps)
    return rows.join(headers(cells), "table_id").select("table_id", "row_ix", "headers", grid.alias("cells"))


def json_keys(h: Column) -> Column:
    """Headers as JSON keys: a repeated header gets its number among its equals, from the second on."""
    earlier = lambda x, i: F.size(F.filter(F.slice(h, F.lit(1), i + 1), lambda y: y == x))
    return F.transform(h, lambda x, i: F.when(earlier(x, i) > 1, F.concat(x, F.lit("_"), earlier(x, i).cast("string")))
                       .otherwise(x))


def json_string(c: Column) -> Column:
    """A string as a JSON string literal."""
    quoted = F.to_json(F.array(c))
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def table_metadata(cells: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """C21 (+ S6): rows, columns, headers, cells; a header row always exists.

    ``places`` (table_id, place_ix, page_number, bbox) says where tables were found: the first place counts. Without one, page and
    box are NULL.
    """
    rows = cells.groupBy("table_id", "row_ix").agg(F.lit(1).alias("_")).groupBy("table_id").agg(
        F.count(F.lit(1)).alias("num_rows"))
    h = headers(cells).withColumn("num_columns", F.size("cols").cast("long"))
    m = rows.join(h, "table_id")
    if places is None:
        m = m.withColumn("bbox", F.lit(None).cast("array<double>")).withColumn("page_number", F.lit(None).cast("int"))
    else:
        first = places.groupBy("table_id").agg(F.min_by(F.struct("bbox", "page_number"), "place_ix").alias("p"))
        m = m.join(first.select("table_id", "p.bbox", "p.page_number"), "table_id", "left")
    return m.select(
        "table_id", "num_rows", "num_columns", "headers", F.lit(True).alias("has_headers"),
        (F.col("num_rows") * F.col("num_columns")).alias("total_cells"),
        F.col("num_rows").alias("grid_rows"), F.col("num_columns").alias("grid_cols"), "bbox", "page_number",
        headers_preview(F.col("headers")).alias("headers_preview"))


def headers_preview(h: Column, n: int = HEADER_PREVIEW) -> Column:
    """First five headers, '...' when there are more."""
    return F.concat(F.array_join(F.slice(h, 1, n), ", "), F.when(F.size(h) > n, F.lit("...")).otherwise(F.lit("")))


def _lines(cells: DataFrame, head: Column, row: Column, tail: Column | None = None) -> DataFrame:
    h = headers(cells).select("table_id", F.lit(0).cast("long").alias("line_ix"), head.alias("line"))
    r = table_rows(cells).select("table_id", (F.col("row_ix") + 1).cast("long").alias("line_ix"), row.alias("line"))
    out = h.unionByName(r)
    if tail is not None:
        big = F.lit(2**62).cast("long")
        out = out.unionByName(headers(cells).select("table_id", big.alias("line_ix"), tail.alias("line")))
    return out


def to_csv_lines(cells: DataFrame) -> DataFrame:
    """Header line then one CSV line per row, no index column."""
    return _lines(cells, F.array_join(F.transform("headers", csv_field), ","),
                  F.array_join(F.transform("cells", csv_field), ","))


def to_markdown_lines(cells: DataFrame) -> DataFrame:
    """Pipe table; line 0 holds the header and the separator row."""
    head = F.concat(F.lit("| "), F.array_join(F.transform("headers", md_cell), " | "), F.lit(" |\n|"),
                    F.array_join(F.transform("headers", lambda _: F.lit(" --- ")), "|"), F.lit("|"))
    row = F.concat(F.lit("| "), F.array_join(F.transform("cells", md_cell), " | "), F.lit(" |"))
    return _lines(cells, head, row)


def to_json_lines(cells: DataFrame) -> DataFrame:
    """Records orientation, one JSON object per row (header -> cell); repeated headers are numbered."""
    pairs = F.zip_with(json_keys(F.col("headers")), F.col("cells"),
                       lambda k, v: F.concat(json_string(k), F.lit(":"), json_string(v)))
    return table_rows(cells).select("table_id", (F.col("row_ix") + 1).cast("long").alias("line_ix"),
                                    F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")).alias("line"))


def to_html_lines(cells: DataFrame) -> DataFrame:
    """<table> with a header row, one <tr> per row, closing tag last."""
    th = F.concat(F.lit("<table>\n<tr>"), F.array_join(
        F.transform("headers", lambda x: F.concat(F.lit("<th>"), html_escape(x), F.lit("</th>"))), ""), F.lit("</tr>"))
    td = F.concat(F.lit("<tr>"), F.array_join(
        F.transform("cells", lambda x: F.concat(F.lit("<td>"), html_escape(x), F.lit("</td>"))), ""), F.lit("</tr>"))
    return _lines(cells, th, td, F.lit("</table>"))


def write_table_exports(lines: DataFrame, out_dir: str, fmt: str) -> None:
    """K8-style sink: one text file set per table under ``out_dir/kind=tables/fmt=../table_id=..``."""
    # ranges of lines: a large table is written by several tasks, its part files in line order
    (lines.repartitionByRange("table_id", "line_ix").sortWithinPartitions("table_id", "line_ix")
     .select("table_id", "line").write.mode("overwrite").partitionBy("table_id").text(f"{out_dir}/kind=tables/fmt={fmt}"))
