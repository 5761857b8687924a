"""Small checks for A6, T4 on a stream, K7, K8 and the map-shaped breakdown."""

import glob
import json
import os

from pyspark.sql import functions as F

from sheaf.functions import responses as rs
from sheaf.operators import documents as dm
from sheaf.operators import samples as sm
from sheaf.operators import tables as tb
from sheaf.plans import reports as rp


def test_read_responses(spark, tmpdir_path):  # A6 + P17 on files
    for i, body in enumerate([{"document": {"md_content": "# A"}, "status": "success"},
                              {"status": "failure", "errors": ["x"]}]):
        with open(f"{tmpdir_path}/r{i}.json", "w") as f:
            json.dump(body, f, indent=2)
    df = rs.read_responses(spark, tmpdir_path).select(
        F.regexp_extract("source", r"(r\d)\.json$", 1).alias("name"), rs.select_content(F.col("response"), F.lit("md")).alias("c"))
    got = {r.name: (r.c.content, r.c.error is not None) for r in df.collect()}
    assert got == {"r0": ("# A", False), "r1": (None, True)}


def test_limit_verdict_on_stream(spark, tmpdir_path):  # T4 stream (update mode aggregate)
    rows = [(1, 0, 0, 100.0, 1.0, 900.0, 1.0, 0), (1, 1, 5, 3000.0, 1.0, 900.0, 1.0, 5), (1, 2, 9, 100.0, 1.0, 10.0, 1.0, 9)]
    schema = "run_id long, seq long, epoch_s long, rss_mb double, vms_mb double, available_mb double, percent double, elapsed_s long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmpdir_path}/s")
    src = spark.readStream.schema(schema).parquet(f"{tmpdir_path}/s")
    q = (sm.limit_verdicts(src).writeStream.format("memory").queryName("t4").outputMode("complete")
         .option("checkpointLocation", f"{tmpdir_path}/ck").trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.sql("select run_id, seq, returncode from t4").collect()] == [(1, 1, -2)]


def test_json_and_table_writers(spark, tmpdir_path):  # K7, K8
    stats = spark.createDataFrame([("a.pdf", "pdf", True), ("b.md", "md", False), ("c.pdf", "pdf", False)],
                                  "file_path string, format string, success boolean")
    fb = dm.format_breakdown_map(stats).first().format_breakdown
    assert fb["pdf"]["count"] == 2 and fb["pdf"]["success"] == 1 and fb["md"]["success"] == 0  # M15
    rp.write_json(stats, f"{tmpdir_path}/meta", partition_by=["format"])
    assert sorted(os.path.basename(p) for p in glob.glob(f"{tmpdir_path}/meta/format=*")) == ["format=md", "format=pdf"]
    cells = spark.createDataFrame([("t1", 0, 0, "k", "1"), ("t1", 0, 1, "v", "a,b"), ("t1", 1, 0, "k", "2"), ("t1", 1, 1, "v", "c")],
                                  "table_id string, row_ix long, col_ix int, header string, cell string")
    tb.write_table_exports(tb.to_csv_lines(cells), tmpdir_path, "csv")
    text = "".join(open(p).read() for p in sorted(glob.glob(f"{tmpdir_path}/kind=tables/fmt=csv/table_id=t1/part-*")))
    assert text == 'k,v\n1,"a,b"\n2,c\n'


def test_character_references(spark):
    from sheaf.functions.text import xml_unescape
    texts = ["&#65;&#x42;", "&amp;#65;", "a &#233;&lt; &#x1F600; z", "&#0;&#xD800;&#x110000;&#99999999;", "&#x;&#;&", "plain & simple", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.u for r in df.select("i", xml_unescape(F.col("t")).alias("u")).orderBy("i").collect()]
    assert got == ["AB", "&#65;", "a é< 😀 z", "&#0;&#xD800;&#x110000;&#99999999;", "&#x;&#;&", "plain & simple", "", None]


def test_sorted_results_keep_their_order(spark):
    """What a sort promises is the order of the rows, not only the rows."""
    import __spark_entry__ as entry
    queries, sf = entry.queries(), "/root/testdata/sf0.01"
    rows = {k: queries[k](spark, sf).collect() for k in ("conv_detail_sorted", "culprits_sorted", "entries_sorted", "files_sorted", "top_culprits")}
    assert [(not r.has_links, r.filename) for r in rows["conv_detail_sorted"]] == sorted((not r.has_links, r.filename) for r in rows["conv_detail_sorted"])
    assert [-r.rss_delta_mb for r in rows["culprits_sorted"]] == sorted(-r.rss_delta_mb for r in rows["culprits_sorted"])
    assert [(r.ts, r.line_no) for r in rows["entries_sorted"]] == sorted((r.ts, r.line_no) for r in rows["entries_sorted"])
    assert [r.path for r in rows["files_sorted"]] == sorted(r.path for r in rows["files_sorted"])
    assert [r["rank"] for r in rows["top_culprits"]] == sorted(r["rank"] for r in rows["top_culprits"])
    assert all(len(r) for r in rows.values())
