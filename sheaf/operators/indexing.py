"""Dense 1..n numbering in a global order without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.session import cut_lineage


def dense_index(df: DataFrame, order_cols: list[str], out: str = "idx") -> DataFrame:
    """Number rows 1..n in ``order_cols`` order (keys should be unique).

    Range-partition and sort, then number rows inside each partition and add
    the row counts of all earlier partitions. The offsets table has one row per
    partition, so broadcasting it is bounded by the partition count. The sorted
    data is checkpointed (reliably) so that partition ids stay fixed between
    counting and numbering.
    """
    s = df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
    s = s.withColumn("_pid", F.spark_partition_id()).withColumn("_rid", F.monotonically_increasing_id())
    s = cut_lineage(s)
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offs = counts.select("_pid", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    local = F.col("_rid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (s.join(F.broadcast(offs), "_pid").withColumn(out, F.col("_off") + local + 1)
            .drop("_pid", "_rid", "_off"))
