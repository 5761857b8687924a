"""Sinks write what the operators produce; the driver entry runs on sf0.001."""

import glob

from pyspark.sql import functions as F

from sheaf.plans import reports as rp


def test_entry_smoke(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns[:2] == ["rank", "job_name"] and 0 < len(rows) <= 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_report_and_markdown_writers(spark, tmpdir_path):
    lines = spark.createDataFrame([(1, 2, "b"), (0, 1, "a"), (1, 1, "c")], "section int, ord long, line string")
    rp.write_report(lines, f"{tmpdir_path}/rep")
    text = "".join(open(p).read() for p in sorted(glob.glob(f"{tmpdir_path}/rep/part-*")))
    assert text == "a\nc\nb\n"
    # a long report is many files, one after the other; the manifest says what each holds
    big = spark.range(100_000).select((F.col("id") % 3).cast("int").alias("section"), F.col("id").alias("ord"), F.col("id").cast("string").alias("line"))
    manifest = rp.write_report(big, f"{tmpdir_path}/big", lines_per_file=9_000).collect()
    files = sorted(glob.glob(f"{tmpdir_path}/big/part-*"))
    assert len(files) == len(manifest) > 8 and sum(m.lines for m in manifest) == 100_000
    got = [int(x) for p in files for x in open(p).read().split()]
    assert got == sorted(range(100_000), key=lambda i: (i % 3, i))
    assert all(a.last < b.first for a, b in zip(manifest, manifest[1:]))
    docs = spark.createDataFrame([("in/a.pdf", "# A"), ("in/a.docx", "# B")], "doc_key string, markdown string")
    rp.write_markdown(docs, f"{tmpdir_path}/md", buckets=4)
    back = spark.read.parquet(f"{tmpdir_path}/md")
    assert sorted(r.doc_key for r in back.collect()) == ["in/a.docx", "in/a.pdf"]  # same stem, both kept (Q13)
