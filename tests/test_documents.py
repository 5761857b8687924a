"""Routing quirks, discovery on real folders, dense numbering, responses, requests."""

import json
import os

from pyspark.sql import functions as F

from sheaf.functions import responses as rs
from sheaf.functions import routing as r
from sheaf.operators import documents as dm
from sheaf.operators.indexing import dense_index
from sheaf.sources.packages import discover


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x"))).first()[0]


def test_suffix_and_format(spark):
    assert one(spark, r.suffix, "a/b/File.DOCX") == ".DOCX"
    assert one(spark, r.file_format, "a/b/File.DOCX") == "docx"
    assert one(spark, r.suffix, "a/.bashrc") == ""
    assert one(spark, r.file_format, "x.zip") is None
    assert one(spark, r.stem, "dir/report.final.pdf") == "report.final"


def test_url_route(spark):  # P7 quirks
    assert one(spark, r.url_filename, "https://h/x/A.PDF?q=1") == "A.PDF.pdf"
    assert one(spark, r.url_filename, "https://h/") == "downloaded_content.html"
    assert one(spark, r.url_extension, "http://h/a/b.tar.gz#frag") == ".gz"
    assert one(spark, r.url_filename, "http://h/dir/page") == "page.html"
    assert one(spark, r.is_url, "ftp://h/x") is False


def test_office_alias(spark):  # P6
    assert one(spark, r.office_extension, "PowerPoint") == ".pptx"
    assert one(spark, r.office_type_error, "pdf").startswith("Unsupported office type: pdf")


def test_error_classification(spark):  # P16
    assert one(spark, dm.classify_error_log, "Fatal: Cannot Allocate memory") == dm.OOM_MESSAGE
    assert len(one(spark, dm.classify_error_log, "x" * 500)) == 300


def test_discover_case_insensitive(spark, tmpdir_path):  # A3 / Q12
    os.makedirs(f"{tmpdir_path}/sub")
    for name in ("a.PDF", "sub/b.docx", "c.txt", "sub/d.Md"):
        with open(f"{tmpdir_path}/{name}", "w") as f:
            f.write("x")
    got = [os.path.basename(x.path) for x in discover(spark, tmpdir_path, list(r.FILE_FORMATS)).collect()]
    assert got == ["a.PDF", "b.docx", "d.Md"]


def test_dense_index(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000).alias("k"))
    got = {x.k: x.idx for x in dense_index(df, ["k"]).collect()}
    assert got == {k: k + 1 for k in range(1000)}


def test_response_select(spark):  # P17
    rows = [
        (json.dumps({"document": {"md_content": "# T", "json_content": {"a": [1, "é"]}}, "status": "success"}), "json"),
        (json.dumps({"document": {"md_content": "# T", "json_content": "{\"raw\": 1}"}, "status": "success"}), "json"),
        (json.dumps({"document": {"md_content": "# T"}, "status": "success"}), "json"),
        (json.dumps({"document": {"html_content": "<p>"}, "status": "success"}), "html"),
        (json.dumps({"document": {"md_content": "# T"}, "status": "success"}), "Markdown"),
        (json.dumps({"status": "failure", "errors": ["bad"]}), "md"),
    ]
    df = spark.createDataFrame(rows, "response string, fmt string")
    out = [x.c for x in df.select(rs.select_content(F.col("response"), F.col("fmt")).alias("c")).collect()]
    assert out[0].content == json.dumps({"a": [1, "é"]}, indent=2, ensure_ascii=False)
    assert out[1].content == "{\"raw\": 1}"
    assert out[2].content == "# T"  # empty json falls back to markdown
    assert out[3].content == "<p>" and out[4].content == "# T"
    assert out[5].content is None and out[5].error.startswith("Conversion failed")


def test_request_v1(spark):  # P20
    req = json.dumps({"http_sources": [{"url": "u1"}], "file_sources": [{"base64_string": "QQ==", "filename": "f.pdf"}],
                      "options": {"to_formats": "md"}})
    v1 = json.loads(spark.createDataFrame([(req,)], "r string").select(rs.request_v1(F.col("r"))).first()[0])
    assert [s["kind"] for s in v1["sources"]] == ["http", "base64"]
    assert v1["sources"][0]["url"] == "u1" and v1["sources"][1]["filename"] == "f.pdf"
