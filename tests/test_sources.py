"""Line order survives file splitting; bytes -> MB."""

from pyspark.sql import functions as F

from sheaf.sources.text import read_log_lines


def test_line_order_across_splits(spark, tmpdir_path):
    for f in range(3):
        with open(f"{tmpdir_path}/log{f}.txt", "w") as fh:
            fh.write("".join(f"file{f} line {i:05d} {'x' * (i % 37)}\n" for i in range(4000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        df = read_log_lines(spark, tmpdir_path)
        assert df.rdd.getNumPartitions() > 10
        got = [r.line for r in df.orderBy("log_id", "block", "line_no").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = [f"file{f} line {i:05d} {'x' * (i % 37)}" for f in range(3) for i in range(4000)]
    assert got == want


def test_compressed_log_is_many_blocks(spark, tmpdir_path):
    """A gzip log is one split and one task's read; order-dependent work still spreads over its blocks."""
    import gzip
    with gzip.open(f"{tmpdir_path}/a.log.gz", "wt") as fh:
        fh.write("".join(f"line {i:05d}\n" for i in range(5000)))
    with open(f"{tmpdir_path}/b.log", "w") as fh:
        fh.write("".join(f"plain {i:05d}\n" for i in range(700)))
    df = read_log_lines(spark, tmpdir_path, block_lines=100)
    sizes = df.groupBy("log_id", "block").count()
    assert sizes.agg(F.max("count")).first()[0] <= 100 and sizes.count() >= 57
    got = [r.line for r in df.orderBy("log_id", "block", "line_no").collect()]
    assert got == [f"line {i:05d}" for i in range(5000)] + [f"plain {i:05d}" for i in range(700)]
    assert read_log_lines(spark, f"{tmpdir_path}/a.log.gz").select("block").distinct().count() == 1


def test_map_sorted_groups_across_batches(spark):
    import pandas as pd
    from sheaf.operators.carry import map_sorted_groups
    df = spark.range(0, 5000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))

    def fn(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [int(g["k"].iloc[0])], "n": [len(g)], "first": [int(g["v"].iloc[0])]})

    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = sorted(tuple(r) for r in map_sorted_groups(df, ["k"], ["v"], fn, "k long, n long, first long").collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == [(k, len(range(k, 5000, 7)), k) for k in range(7)]
