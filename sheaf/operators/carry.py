"""Carry the latest non-null value forward along an order, split into buckets.

A plain ``last(x, ignorenulls) over (partition by key order by ...)`` puts every
row of a key into one task; a key holding a third of the data would then be one
giant task. Here the window runs per ``(key, bucket)`` and each bucket takes a
*carry-in* from the buckets before it.

The carry-ins come from a prefix scan in two levels over a table of one row per key and
bucket: the buckets of a key are dealt into groups of consecutive ones, as many
groups as buckets in a group; groups are combined, scanned per key, and what enters a
group is handed down to its buckets. A sparse run with a million buckets is thus a
thousand windows of a thousand rows, and one more.

Requirement: ``bucket`` must not decrease along ``order`` within a key
(a time bucket when ordering by time, the split offset when ordering by file
position).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from sheaf.session import cut_lineage


def _cols(names):
    return [F.col(n) if isinstance(n, str) else n for n in names]


def bucket_groups(tails: DataFrame, bucket: str) -> DataFrame:
    """``tails`` with ``_g``: number of the group of consecutive buckets; groups and buckets a group are about as many.

    Widths go by the values of the buckets over the whole table, so a group never has more rows of a key than
    the square root of their range.
    """
    b = F.col(bucket)
    span = tails.agg(F.min(b).alias("low"), F.max(b).alias("high")).select(
        F.struct("low", F.ceil(F.sqrt(F.col("high") - F.col("low") + 1)).alias("width")).alias("s")).scalar()
    return tails.withColumn("_span", span).withColumn(
        "_g", F.floor((b - F.col("_span.low")) / F.col("_span.width")).cast("long")).drop("_span")


def carry_in(tails: DataFrame, keys: list[str], bucket: str, combine: Callable[[Column, Column], Column],
             scan: Callable[[Column, WindowSpec], Column], merge: Callable[[Column, Column], Column]) -> DataFrame:
    """keys, bucket, ``_carry``: what the buckets before each one (column ``_tail``) amount to; stored.

    ``combine(tail, bucket)`` aggregates a group, ``scan(x, window)`` aggregates over a window in order, ``merge(near, far)`` joins the
    carry within a group to the group's own.
    """
    dealt = bucket_groups(tails, bucket)
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    groups = dealt.groupBy(*keys, "_g").agg(combine(F.col("_tail"), F.col(bucket)).alias("_all"))
    entering = groups.select(*keys, "_g", scan(F.col("_all"), before(*keys).orderBy("_g")).alias("_far"))
    near = dealt.withColumn("_near", scan(F.col("_tail"), before(*keys, "_g").orderBy(bucket)))
    return cut_lineage(near.join(entering, [*keys, "_g"], "left").select(
        *keys, bucket, merge(F.col("_near"), F.col("_far")).alias("_carry")))


def carry_last(df: DataFrame, *, keys: list[str], bucket: str, order: list[str], value: Column,
               out: str) -> DataFrame:
    """Add ``out``: ``value`` of the latest row at or before this one (by ``order``)
    within ``keys`` whose ``value`` is not null."""
    order_cols = _cols(order)
    ord_struct = F.struct(*order_cols)
    w = Window.partitionBy(*keys, bucket).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    valued = df.withColumn("_v", value)
    with_local = valued.withColumn("_local", F.last("_v", ignorenulls=True).over(w))

    # One row per (key, bucket): the last non-null value inside the bucket, combined before any shuffle.
    tails = valued.groupBy(*keys, bucket).agg(
        F.max_by(F.col("_v"), F.when(F.col("_v").isNotNull(), ord_struct)).alias("_tail"))
    carry = carry_in(tails, keys, bucket, lambda x, b: F.max_by(x, F.when(x.isNotNull(), F.struct(b))),
                     lambda x, w: F.last(x, ignorenulls=True).over(w), F.coalesce)
    return (with_local.join(carry, on=[*keys, bucket], how="left")
            .withColumn(out, F.coalesce(F.col("_local"), F.col("_carry")))
            .drop("_v", "_local", "_carry"))


def running_max(df: DataFrame, *, keys: list[str], bucket: str, order: list[str], value: Column, out: str,
                include_current: bool = True, out_prev: str | None = None) -> DataFrame:
    """Add ``out``: max of ``value`` over rows before (and, by default, at) this one
    within ``keys``; bucketed like :func:`carry_last`. ``out_prev`` additionally
    gives the max over the rows strictly before, from the same pass."""
    order_cols = _cols(order)
    w = Window.partitionBy(*keys, bucket).orderBy(*order_cols)
    run = F.max("_v").over(w.rowsBetween(Window.unboundedPreceding, 0))
    valued = df.withColumn("_v", value)
    with_local = valued.withColumn("_local", run)
    with_local = with_local.withColumn("_local_prev", F.lag("_local", 1).over(w))
    tails = valued.groupBy(*keys, bucket).agg(F.max("_v").alias("_tail"))
    carry = carry_in(tails, keys, bucket, lambda x, b: F.max(x), lambda x, w: F.max(x).over(w), F.greatest)
    joined = with_local.join(carry, on=[*keys, bucket], how="left")
    prev = F.greatest(F.col("_local_prev"), F.col("_carry"))
    cur = F.greatest(F.col("_local"), F.col("_carry"))
    joined = joined.withColumn(out, cur if include_current else prev)
    if out_prev:
        joined = joined.withColumn(out_prev, prev)
    return joined.drop("_v", "_local", "_local_prev", "_carry")


def map_sorted_groups(df: DataFrame, keys: list[str], order: list[str], fn, schema: str,
                      prepartitioned: bool = False) -> DataFrame:
    """Like ``groupBy(keys).applyInPandas(fn)`` but one Python call per partition.

    Rows are hash-partitioned on ``keys`` and sorted within partitions, so each
    group is a contiguous run of rows; Arrow batches are cut at group ends (a group
    that spans batches is carried into the next one). Memory per task: one group,
    as with applyInPandas; overhead: per partition instead of per group.
    """
    import numpy as np
    import pandas as pd

    def run(batches):
        carry = None
        for pdf in batches:
            if carry is not None and len(carry):
                pdf = pd.concat([carry, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = pdf.iloc[-1]
            tail = np.logical_and.reduce([pdf[k].to_numpy() == last[k] for k in keys])
            done, carry = pdf[~tail], pdf[tail]
            if len(done):
                yield pd.concat([fn(g) for _, g in done.groupby(keys, sort=False)], ignore_index=True)
        if carry is not None and len(carry):
            yield fn(carry)

    if not prepartitioned:
        df = df.repartition(*keys)
    # With ``prepartitioned`` the caller guarantees hash partitioning on ``keys``;
    # a sort the child already satisfies is removed by the planner.
    return df.sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
