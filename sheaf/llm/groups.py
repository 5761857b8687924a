"""Whole groups out of sorted Arrow batches, and connected sets inside a group.

A partition that is sorted by its group columns arrives in batches that cut groups
anywhere. ``whole_groups`` hands on tables that hold only complete groups, carrying an
unfinished last group over to the next batch. Callers bound the size of a group before
the shuffle (see ``block_pairs``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(table, group offsets) with complete groups only; integer key columns, input sorted by them."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cut = np.flatnonzero(change)
        first, last = tuple(c[0] for c in cols), tuple(c[-1] for c in cols)
        if held and first != held_key:
            t = pa.Table.from_batches(held)
            yield t, _offsets(t, keys)
            held = []
        if len(cut):
            held.append(b.slice(0, int(cut[-1])))
            t = pa.Table.from_batches(held)
            yield t, _offsets(t, keys)
            held = [b.slice(int(cut[-1]))]
        else:
            held.append(b)
        held_key = last
    if held:
        t = pa.Table.from_batches(held)
        yield t, _offsets(t, keys)


def _offsets(t: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(t.num_rows, bool)
    for k in keys:
        c = t.column(k).to_numpy()
        change[1:] |= c[1:] != c[:-1]
    return np.concatenate([[0], np.flatnonzero(change), [t.num_rows]])


def block_pairs(df: DataFrame, key: Column, blocks: Column, main: Column | None = None,
                main_blocks: Column | None = None) -> DataFrame:
    """Deal a group's rows into ``blocks`` blocks and give each row to every pair of blocks that holds its own.

    Adds ``_i <= _j`` (the block pair) and ``_side`` (0: the row is of block ``_i``, 1: of ``_j``).
    Any two rows of a group meet in exactly one pair; a group of one block stays one group. Rows
    for which ``main`` holds need not meet each other: they are dealt into ``main_blocks`` blocks of their own, which meet
    the other blocks only.
    """
    hashed = F.xxhash64(key)
    own, others = F.pmod(hashed, blocks), blocks
    if main is not None:
        own = F.when(main, blocks + F.pmod(hashed, F.greatest(main_blocks, F.lit(1)))).otherwise(own)
        others = F.when(main, blocks).otherwise(blocks + main_blocks)
    columns = df.columns
    df = df.withColumn("_own", own.cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), (others - 1).cast("int"))))
    return df.select(*columns, F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"),
                     (F.col("_own") > F.col("_other")).cast("int").alias("_side"))


def unsettled(rows: DataFrame, group: str, part: str) -> DataFrame:
    """``group``, main, n_main, n_rest of the groups whose rows lie in two or more parts; main is the largest part.

    Rows of one part need no further comparison, so a group is compared as its rest against all of it.
    """
    sizes = rows.groupBy(group, part).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.groupBy(group).agg(F.max_by(part, F.struct("_n", part)).alias("main"), F.max("_n").alias("n_main"),
                                    (F.sum("_n") - F.max("_n")).alias("n_rest")).where("n_rest > 0")


def labels_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over undirected edges ``a``-``b``."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        if np.array_equal(before, label):
            break
        live = label[a] != label[b]
        a, b = a[live], b[live]
    return label


def shared_counts(values: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Pairwise intersection sizes of value arrays that are each free of repeats.

    Values that only one array has are dropped, the others become 0/1 columns that are
    multiplied in strips, so memory is ``n * columns`` whatever the arrays hold.
    """
    n = len(values)
    sizes = np.array([len(v) for v in values])
    flat = np.concatenate(values) if n else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    common = count[inverse] > 1
    column = np.cumsum(count > 1) - 1
    c, o = column[inverse[common]], owner[common]
    order = np.argsort(c, kind="stable")
    c, o = c[order], o[order]
    out = np.zeros((n, n), np.float32)
    top = int(c[-1]) + 1 if len(c) else 0
    for k in range(0, top, columns):
        i, j = np.searchsorted(c, [k, k + columns])
        m = np.zeros((n, min(columns, top - k)), np.float32)
        m[o[i:j], c[i:j] - k] = 1
        out += m @ m.T
    out[np.arange(n), np.arange(n)] = sizes
    return out.astype(np.int64)
