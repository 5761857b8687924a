"""Inputs derived from the driver tables by plain projections (see FIXTURES.md).

Fixtures *render text* where an operator parses text, so the registered queries
exercise the parsers; the DuckDB oracle reads the typed source columns instead.
Every fixture grows with its source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.sources.tables import load_table
from sheaf.sources.text import lines_from_column


def r2(c):
    return F.round(c, 2)


def memlog_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one memory-log line per event; 20 jobs.

    view -> START, purchase -> END, click -> MONITOR, error -> FAILED, other ->
    noise. Numbers are rounded to two decimals before formatting, so the text
    equals a decimal(14,2) rendering.
    """
    ev = load_table(spark, sf_dir, "events")
    uid, eid = F.col("user_id") % 20, F.col("event_id")
    t = ev.select(
        eid.alias("line_no"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts_s"),
        F.concat(F.lit("job_"), uid.cast("string")).alias("job"), "event_type",
        r2(F.col("value")).alias("v"),
        ((eid % 7) - 2 + F.when(uid == 7, 25).otherwise(0)).cast("double").alias("d"),
        ((eid % 11) - 4).cast("double").alias("vd"),
        r2(uid * (eid - eid % 100) * 0.01).alias("g"),
        (eid % 90).cast("double").alias("dur"), (eid % 100).cast("double").alias("pct"))
    v, d, vd, g, dur, pct = (F.col(c) for c in ("v", "d", "vd", "g", "dur", "pct"))
    head = "[%s] app "
    et = F.col("event_type")
    start = F.format_string(
        head + "[MEMORY_TRACK_START] job='%s' rss_mb=%.2f vms_mb=%.2f memory_percent=%.2f system_available_mb=%.2f",
        "ts_s", "job", v, r2(v + 300), pct, r2(8000 - v))
    end = F.format_string(
        head + "[MEMORY_TRACK_END] job='%s' duration=%.2fs rss_before=%.2fMB rss_after=%.2fMB "
        "rss_delta=%+.2fMB vms_delta=%+.2fMB peak_rss=%.2fMB ",
        "ts_s", "job", dur, r2(v + g), r2(v + g + d), d, vd, r2(v + g + 50))
    monitor = F.format_string(
        head + "[MEMORY_MONITOR] job='%s' elapsed=%.2fs current_rss_mb=%.2f peak_rss_mb=%.2f "
        "current_vms_mb=%.2f system_available_mb=%.2f memory_percent=%.2f",
        "ts_s", "job", dur, v, r2(v + g + 50), r2(v + 300), r2(8000 - v), pct)
    failed = F.format_string(head + "[MEMORY_TRACK_FAILED] job='%s' error='x'", "ts_s", "job")
    noise = F.format_string(head + "heartbeat %d", "ts_s", "line_no")
    line = (F.when(et == "view", start).when(et == "purchase", end).when(et == "click", monitor)
            .when(et == "error", failed).otherwise(noise))
    return t.select("line_no", line.alias("line"))


def memlog_lines(spark: SparkSession, sf_dir: str, newest_first: bool = False) -> DataFrame:
    """F1 in the line schema; ``newest_first`` negates line_no (variant F1r)."""
    df = memlog_text(spark, sf_dir)
    if newest_first:
        df = df.withColumn("line_no", -F.col("line_no"))
    return lines_from_column(df, "line", "line_no", log_id=F.lit("memlog"))


def money(cents):
    """Non-negative cents as 'd.dd' text, exact in every engine."""
    return F.format_string("%d.%02d", F.floor(cents / 100).cast("long"), (cents % 100).cast("long"))


def convlog_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversion log lines; 50 logs (doc_id % 50), up to six lines per document.

    Covers retries, exact / partial / ambiguous / unmatched scan names, failures
    without SUCCESS and SUCCESS without CONVERTED. Sizes are whole cents.
    """
    docs = load_table(spark, sf_dir, "documents")
    did = F.col("doc_id")
    ty = F.when(did % 3 == 0, "excel").when(did % 3 == 1, "powerpoint").otherwise("word")
    ext = F.when(did % 3 == 0, ".xlsx").when(did % 3 == 1, ".pptx").otherwise(".docx")
    n = docs.select(did, (did % 50).alias("log_id"), ty.alias("ty"), F.col("n_chars").alias("sz_c"),
                    ((F.col("n_chars") + 1) / 2).cast("long").alias("pdf_c"),
                    F.concat(ty, F.lit("_input_"), did.cast("string"), ext).alias("fn"))
    k = F.col("k")
    n = n.select("*", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    n = n.where(~((k == 3) & (did % 4 != 0)) & ~((k == 4) & (did % 5 == 0))
                & ~((k == 5) & ((did % 5 == 0) | (did % 7 == 0))))
    fn, sz, pdf = F.col("fn"), money(F.col("sz_c")), money(F.col("pdf_c"))
    scan_name = (F.when(did % 9 == 0, F.lit("other"))
                 .when(did % 9 == 1, F.replace(fn, F.concat(F.col("ty"), F.lit("_")), F.lit("")))
                 .when(did % 9 == 2, F.concat((did % 10).cast("string"), F.lit("."),
                                              F.split_part(fn, F.lit("."), F.lit(2))))
                 .otherwise(fn))
    types = F.when(did % 4 == 0, F.lit("")).when(did % 4 == 1, F.lit("'ole'")).otherwise(F.lit("'ole', 'chart'"))
    ts = F.concat(F.lit("[2026-01-08 10:00:0"), k.cast("string"), F.lit("] "))
    body = (F.when(k == 0, F.concat(F.lit("[ENTRY] convert_office_to_pdf called: type="), F.col("ty"),
                                    F.lit(", size="), sz, F.lit("MB, max_retries=2")))
            .when(k == 1, F.concat(F.lit("[Attempt 1/2] Converting "), fn, F.lit(" ("), sz, F.lit("MB)...")))
            .when(k == 2, F.concat(F.lit("[LINK_SCAN] file='"), scan_name, F.lit("' external_links_found="),
                                   (did % 4).cast("string"), F.lit(" link_types=["), types, F.lit("]")))
            .when(k == 3, F.concat(F.lit("[Attempt 2/2] Converting "), fn, F.lit(" ("), sz, F.lit("MB)...")))
            .when(k == 4, F.concat(F.lit("[SUCCESS] "), F.col("ty"), F.lit(" conversion completed, PDF size: "),
                                   pdf, F.lit("MB")))
            .otherwise(F.concat(F.lit("Converted "), fn, F.lit(" to PDF ("), pdf, F.lit("MB) in "),
                                (did % 60).cast("string"), F.lit(".00s"))))
    return n.select(F.col("log_id").cast("string").alias("log_id"), (did * 10 + k).alias("line_no"),
                    F.concat(ts, body).alias("line"))


def convlog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = convlog_text(spark, sf_dir)
    return lines_from_column(df, "line", "line_no", log_id="log_id", block_size=64)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one memory sample per event, one run per user; ``elapsed_s`` from the run's first sample."""
    from sheaf.operators.leaks import epoch_seconds
    ev = load_table(spark, sf_dir, "events")
    t = ev.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"),
                  F.floor(epoch_seconds(F.col("ts"))).cast("long").alias("epoch_s"),
                  (F.col("value") * 1048576.0).alias("rss_bytes"), F.col("value").alias("rss_mb"),
                  (F.col("value") + 300).alias("vms_mb"), (2000 - 4 * F.col("value")).alias("available_mb"),
                  (F.col("event_id") % 100).cast("double").alias("percent"))
    first = t.groupBy("run_id").agg(F.min("epoch_s").alias("_t0"))
    return t.join(first, "run_id").withColumn("elapsed_s", F.col("epoch_s") - F.col("_t0")).drop("_t0")


def run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the runs whose last event is an error, with its text."""
    from sheaf.operators.leaks import epoch_seconds
    ev = load_table(spark, sf_dir, "events")
    at = F.struct(F.floor(epoch_seconds(F.col("ts"))), F.col("event_id"))
    last = ev.groupBy(F.col("user_id").alias("run_id")).agg(F.max_by(F.struct("event_type", "event_id"), at).alias("e"))
    return last.where("e.event_type = 'error'").select("run_id", F.concat(F.lit("failed at event "), F.col("e.event_id").cast("string")).alias("error"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one to four attempts a document; each succeeds or fails by its own rule."""
    did = F.col("doc_id")
    docs = load_table(spark, sf_dir, "documents").select(did, F.explode(F.sequence(F.lit(1), (did % 4 + 1).cast("int"))).alias("attempt"))
    return docs.select(did, "attempt", ((did + F.col("attempt")) % 3 == 0).alias("ok"))


def table_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """where a table was found, in order: every part of a brand is a place, on the page of its size."""
    part, size = load_table(spark, sf_dir, "part"), F.col("p_size").cast("double")
    return part.select(F.col("p_brand").alias("table_id"), F.col("p_partkey").alias("place_ix"), F.col("p_size").cast("int").alias("page_number"),
                       F.array(size, F.lit(0.5), size + 10, F.lit(20.25)).alias("bbox"))


def document_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one processing record per document; mixed-case and unsupported suffixes.

    Export counts per format equal ``tables_found`` except JSON, which loses one
    table on every seventh document (so C20's maximum matters).
    """
    docs = load_table(spark, sf_dir, "documents")
    labels = load_table(spark, sf_dir, "labels").select("doc_id", "quality")
    did = F.col("doc_id")
    ext = F.element_at(F.array(*[F.lit(e) for e in
                                 (".pdf", ".DOCX", ".pptx", ".xlsx", ".png", ".html", ".md", ".zip")]),
                       (did % 8 + 1).cast("int"))
    ok = F.coalesce(F.col("quality"), F.lit(1)) == 1
    d = docs.join(labels, "doc_id", "left")
    tables = F.when(ok, F.col("n_chars") % 4).otherwise(0)
    return d.select(
        did, F.concat(F.lit("in/"), F.col("source"), F.lit("/"), did.cast("string"), ext).alias("path"),
        (F.col("n_chars") * 1000).alias("size_bytes"), ok.alias("ok"), tables.alias("tables_found"),
        tables.alias("tables_csv"), tables.alias("tables_md"),
        F.greatest(tables - F.when(did % 7 == 0, 1).otherwise(0), F.lit(0)).alias("tables_json"),
        tables.alias("tables_html"),
        F.when(ok, did % 3).otherwise(0).alias("images_extracted"),
        F.when(ok, did % 5).otherwise(0).alias("page_images_extracted"),
        (F.col("n_chars") / 100.0).alias("run_seconds"), (did % 3 + 1).cast("int").alias("attempt"),
        F.when(ok, F.lit(None)).when(did % 2 == 0, F.lit("terminate: Out of Memory"))
        .otherwise(F.lit("parse error")).alias("error_msg"))


def package_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """office-package members built from ``pages``; eight consecutive pages per package."""
    pages = load_table(spark, sf_dir, "pages")
    pid, url = F.col("page_id"), F.col("url")
    ps = pid.cast("string")
    member = (F.when(pid % 5 == 0, F.concat(F.lit("ppt/slides/slide"), ps, F.lit(".xml")))
              .when(pid % 5 == 1, F.concat(F.lit("ppt/charts/chart"), ps, F.lit(".xml")))
              .when(pid % 5 == 2, F.concat(F.lit("ppt/slides/_rels/slide"), ps, F.lit(".xml.rels")))
              .when(pid % 5 == 3, F.concat(F.lit("ppt/media/m"), ps, F.lit(".bin")))
              .otherwise(F.lit("docProps/app.xml")))
    content = (F.when((pid % 5 == 0) & (pid % 3 == 0),
                      F.concat(F.lit('<p:sld><p:oleObj id="'), ps, F.lit('">x</p:oleObj><a:t>'), url,
                               F.lit("</a:t></p:sld>")))
               .when(pid % 5 == 0, F.concat(F.lit("<p:sld><a:t>"), url, F.lit("</a:t></p:sld>")))
               .when((pid % 5 == 1) & (pid % 2 == 0),
                     F.lit('<c:chart><c:externalData r:id="r1"><c:autoUpdate val="0"/></c:externalData></c:chart>'))
               .when(pid % 5 == 1, F.lit("<c:chart/>"))
               .when((pid % 5 == 2) & (pid % 4 != 3),
                     F.concat(F.lit('<Relationships><Relationship Id="r1" Target="'),
                              F.when(pid % 4 == 0, F.lit("file:///x")).otherwise(url),
                              F.lit('" TargetMode="External"/></Relationships>')))
               .when(pid % 5 == 2, F.lit("<Relationships/>"))
               .otherwise(url))
    return pages.select(F.concat(F.lit("pkg_"), F.floor(pid / 8).cast("long").cast("string"), F.lit(".pptx")).alias("path"),
                        pid.cast("int").alias("member_ix"), member.alias("member"), content.alias("content"),
                        F.lit(True).alias("readable"), pid.alias("page_id"))


def table_cells(spark: SparkSession, sf_dir: str, repeated: bool = False) -> DataFrame:
    """one table per brand in long form (key, name, price columns); some names are NULL or empty, some prices absent.
    ``repeated`` heads the price column ``name`` as well.

    The part key is the row key: unique and ordered, so no per-brand window (one
    task per brand) is needed to number rows.
    """
    part = load_table(spark, sf_dir, "part")
    c = part.select("p_brand", "p_partkey", "p_name", "p_retailprice",
                    F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("col_ix"))
    cell = (F.when(F.col("col_ix") == 0, F.col("p_partkey").cast("string"))
            .when((F.col("col_ix") == 1) & (F.col("p_partkey") % 7 == 0), F.lit(None).cast("string"))
            .when((F.col("col_ix") == 1) & (F.col("p_partkey") % 7 == 1), F.lit(""))
            .when(F.col("col_ix") == 1, F.col("p_name"))
            .otherwise(F.col("p_retailprice").cast("decimal(14,2)").cast("string")))
    header = F.when(F.col("col_ix") == 0, "key").when(F.col("col_ix") == 1, "name").otherwise("name" if repeated else "price")
    c = c.where("not (col_ix = 2 and p_partkey % 7 = 2)")
    return c.select(F.col("p_brand").alias("table_id"), F.col("p_partkey").cast("long").alias("row_ix"),
                    F.col("col_ix").cast("int").alias("col_ix"), header.alias("header"), cell.alias("cell"))


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: task status events from ``events`` (ties on ts broken by seq)."""
    ev = load_table(spark, sf_dir, "events")
    st = (F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "failure")
          .when(F.col("event_type") == "signup", "pending").otherwise("started"))
    return ev.select(F.col("user_id").alias("task_id"), F.col("ts").alias("event_ts"), F.col("event_id").alias("seq"),
                     st.alias("task_status"), (F.col("value") * 0.002).alias("progress"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a conversion response per document: JSON content as an object, as a string or absent; failures; one in eleven is cut off.
    ``output_format`` is what the client asked for."""
    docs = load_table(spark, sf_dir, "documents")
    did, ds = F.col("doc_id"), F.col("doc_id").cast("string")
    content = (F.when(did % 3 == 0, F.concat(F.lit('{"id":'), ds, F.lit(',"tags":["a","\u00e9"]}')))
               .when(did % 3 == 1, F.concat(F.lit('"id '), ds, F.lit('"'))).otherwise(F.lit("null")))
    body = F.concat(F.lit('{"document":{"md_content":"# '), ds, F.lit('","json_content":'), content, F.lit(',"html_content":"<p>'), ds,
                    F.lit('</p>"},"status":"'), F.when(did % 7 == 0, "failure").otherwise("success"), F.lit('","processing_time":'),
                    money(F.col("n_chars")), F.lit(',"errors":['), F.when(did % 7 == 0, F.lit('"parse error"')).otherwise(F.lit("")), F.lit("]}"))
    formats = F.array(*[F.lit(x) for x in ("json", "markdown", "html", "text", "JSON")])
    return docs.select(did, F.concat(F.lit("responses/"), ds, F.lit(".json")).alias("source"),
                       F.when(did % 11 == 5, F.left(body, F.lit(30))).otherwise(body).alias("response"),
                       F.element_at(formats, (did % 5 + 1).cast("int")).alias("output_format"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a conversion request per document in the old, the new or a mixed shape."""
    did, ds = F.col("doc_id"), F.col("doc_id").cast("string")
    http = F.concat(F.lit('"http_sources":[{"url":"http://h/'), ds, F.lit('"}]'))
    files = F.concat(F.lit('"file_sources":[{"base64_string":"QQ==","filename":"'), ds, F.lit('.pdf"}]'))
    new = F.concat(F.lit('"sources":[{"kind":"http","url":"https://n/'), ds, F.lit('"}]'))
    body = F.when(did % 3 == 0, http).when(did % 3 == 1, F.concat(files, F.lit(","), http)).otherwise(F.concat(new, F.lit(","), files))
    return load_table(spark, sf_dir, "documents").select(did, F.concat(F.lit("{"), body, F.lit(',"options":{"to":"md"}}')).alias("request"))


def workbook_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a workbook per fifty parts: shared strings (a name with a character reference), a number and an inline string a row."""
    part = load_table(spark, sf_dir, "part")
    k, ks = F.col("p_partkey"), F.col("p_partkey").cast("string")
    book = F.concat(F.lit("book_"), F.floor(k / 50).cast("long").cast("string"), F.lit(".xlsx"))
    row = (k % 50 + 1).cast("int").cast("string")
    rows = part.select(book.alias("path"), k.alias("k"), F.concat(F.lit("<si><t>&#x41;&amp;&#233; "), F.col("p_name"), F.lit("</t></si>")).alias("si"), F.concat(
        F.lit('<row><c r="A'), row, F.lit('" t="s"><v>@</v></c><c r="B'), row, F.lit('"><v>'), F.col("p_size").cast("string"),
        F.lit('</v></c><c r="AA'), row, F.lit('" t="inlineStr"><is><t>i'), ks, F.lit("</t></is></c></row>")).alias("row"))
    books = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("k", "si", "row"))).alias("r"))  # fifty rows
    strings = F.concat(F.lit("<sst>"), F.array_join(F.transform("r", lambda x: x["si"]), ""), F.lit("</sst>"))
    sheet = F.concat(F.lit("<sheetData>"), F.array_join(F.transform("r", lambda x, i: F.replace(x["row"], F.lit("@"), i.cast("string"))), ""), F.lit("</sheetData>"))
    member = lambda name, content: F.struct(F.lit(name).alias("member"), content.alias("content"))
    return books.select("path", F.inline(F.array(member("xl/sharedStrings.xml", strings), member("xl/worksheets/sheet1.xml", sheet))))


def memlog_files(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """F1 as text files in ``folder``, lines in order within each."""
    memlog_text(spark, sf_dir).repartitionByRange(4, "line_no").sortWithinPartitions("line_no").select("line").write.text(folder)
