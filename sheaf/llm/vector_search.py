"""Exact top-k search by inner product over a vector-approximation file.

Components are scaled integers, ``floor(scale * x)``. Equal vectors form a class that keeps its smallest ids,
so that a vector which a third of all rows share is one candidate. The approximation of a class has one cell
number a component. A scan of the cells gives each query bounds of every score; a class whose upper bound is
below the (k+1)th best lower bound can't be a result. Exact vectors are then read in the order of their upper
bounds, in rounds, until no unread bound reaches the kth exact score.

Queries and cells meet in (query block, stripe) pairs. A task holds one block of queries and streams the
stripe's cells past it, so its memory does not depend on the table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from sheaf.session import cut_lineage

LONG = 2**63


@dataclass(frozen=True)
class VaFile:
    """``k``: results a query; ``scale``: of the components; ``bits``: of a cell number, at most 8; ``tail``: share of a
    component's values beyond its evenly spaced cells at either end (two open cells take them); ``query_rows``: queries
    of a block, about; ``stripe_rows``: least and most classes of a stripe, about; ``scores``: bounds held at once;
    ``first``: exact vectors that the first round reads for a query, each further round reads four times as many."""
    k: int = 5
    scale: int = 256
    bits: int = 6
    tail: float = 0.001
    query_rows: int = 16_384
    stripe_rows: tuple[int, int] = (1_024, 1_000_000)
    scores: int = 4_000_000
    first: int = 16


def scaled_vectors(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """vec_id, vec: different (id, scaled vector) rows; ``vec`` has the components as little-endian floats.

    Single precision holds ``floor(256 * x)`` of a single-precision x exactly; other element types take double. Rows
    with a null id, a null vector, or a null or non-finite component (scaled) are left out.
    """
    single = isinstance(df.schema[vector].dataType.elementType, FloatType)
    width = "<f4" if single and scale & (scale - 1) == 0 else "<f8"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            length = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            value = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                value = (np.floor(value * scale) + 0.0).astype(width)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(value))])
            ends = np.cumsum(length)
            good = bad[ends] == bad[ends - length]
            raw = value[np.repeat(good, length)].tobytes()
            at = np.concatenate([[0], np.cumsum(length[good])]) * value.itemsize
            vec = pa.Array.from_buffers(pa.binary(), int(good.sum()), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good)), vec], ["vec_id", "vec"])

    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast(
        "array<float>" if single else "array<double>").alias("v")).where("vec_id is not null and v is not null")
    return rows.mapInArrow(run, "vec_id long, vec binary").dropDuplicates()


def numbers(vec: pa.Array, dim: int, width: str) -> np.ndarray:
    """Rows of components out of a binary column whose values have ``dim`` components each."""
    return np.frombuffer(b"".join(vec.to_pylist()), width).reshape(len(vec), dim).astype(np.float64)


class Cells:
    """Evenly spaced cells of whole numbers for every component, with an open cell at either end."""

    def __init__(self, rows: list, bits: int):
        inner = 2**bits - 2
        low, high, least, most = (np.floor([float(r[c]) for r in rows]) for c in ("low", "high", "least", "most"))
        self.low, self.step, self.inner = low, np.maximum(1, np.ceil((high - low + 1) / inner)), inner
        edge = low[:, None] + self.step[:, None] * np.arange(inner + 1)
        self.floor = np.concatenate([least[:, None], edge], 1)
        self.ceil = np.concatenate([edge - 1, most[:, None]], 1)
        # beyond 2**53 the edges are rounded: the whole range bounds every cell there
        wide = np.maximum(abs(least), abs(most)) >= 2**53
        self.floor[wide], self.ceil[wide] = least[wide, None], most[wide, None]
        self.reach = np.maximum(abs(least), abs(most))

    def number(self, x: np.ndarray) -> np.ndarray:
        """Cell of each component."""
        inside = np.clip(np.floor((x - self.low) / self.step), -1, self.inner) + 1
        return inside.astype(np.uint8)

    def bounds(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest component of the cells."""
        at = np.arange(cells.shape[1])
        return self.floor[at, cells], self.ceil[at, cells]


def cell_ranges(df: DataFrame, vector: str, params: VaFile) -> DataFrame:
    """dim, pos, low, high, least, most: ranges of every scaled component of the vectors of each length."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.transform(F.col(vector).cast("array<double>"), lambda x: x * params.scale).alias("v")).where(
        v.isNotNull() & ~bad)
    parts = rows.select(F.size(v).alias("dim"), F.posexplode(v).alias("pos", "x")).groupBy("dim", "pos").agg(
        F.percentile_approx("x", F.array(F.lit(params.tail), F.lit(1 - params.tail)), F.lit(1000)).alias("q"),
        F.min("x").alias("least"), F.max("x").alias("most"))
    return parts.select("dim", "pos", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "least", "most")


class Scan:
    """Bounds of one block of queries against the cells that pass by."""

    def __init__(self, queries: np.ndarray, cells: Cells, k: int):
        most = float((abs(queries) @ cells.reach).max(initial=0.0))
        kind = np.float32 if most < 2**24 else np.float64
        self.slack = 0.0 if most < 2**53 else most * 1e-15 * (queries.shape[1] + 1)
        self.sides = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], 1).astype(kind)
        self.cells, self.kind = cells, kind
        self.best = np.full((len(queries), k + 1), -np.inf)  # largest lower bounds
        self.need = np.full(len(queries), -np.inf)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.n_held = 0

    def add(self, ids: np.ndarray, numbers_: np.ndarray) -> None:
        low, high = self.cells.bounds(numbers_)
        up = np.concatenate([high, low], 1).astype(self.kind)
        down = np.concatenate([low, high], 1).astype(self.kind)
        upper = self.sides @ up.T + self.kind(self.slack)
        if np.isneginf(self.need).any():
            lower = self.sides @ down.T - self.kind(self.slack)
            both = np.concatenate([self.best, lower], 1)
            k = self.best.shape[1]
            self.best = np.partition(both, both.shape[1] - k, axis=1)[:, -k:].astype(np.float64)
            self.need = self.best.min(1)
            q, c = np.nonzero(upper >= self.need[:, None])
        else:
            q, c = np.nonzero(upper >= self.need[:, None])
            lower = np.empty(len(q))
            for k in range(0, len(q), 65_536):
                part = slice(k, k + 65_536)
                lower[part] = np.einsum("ij,ij->i", self.sides[q[part]], down[c[part]]) - self.slack
            self._raise(q, lower)
        keep = upper[q, c] >= self.need[q]
        self.held.append((q[keep], ids[c[keep]], upper[q[keep], c[keep]].astype(np.float64)))
        self.n_held += int(keep.sum())

    def _raise(self, q: np.ndarray, lower: np.ndarray) -> None:
        """Enters lower bounds of the (query, class) pairs; ``q`` ascends."""
        more = lower > self.need[q]
        q, lower = q[more], lower[more]
        while len(q):
            first = np.concatenate([[True], q[1:] != q[:-1]])
            one, value = q[first], lower[first]
            at = self.best[one].argmin(1)
            self.best[one, at] = np.maximum(self.best[one, at], value)
            self.need[one] = self.best[one].min(1)
            q, lower = q[~first], lower[~first]
            more = lower > self.need[q]
            q, lower = q[more], lower[more]

    def taken(self) -> tuple[np.ndarray, ...]:
        """(query, class, upper bound) of what may still be a result; forgets them."""
        if not self.held:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        q, c, upper = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.n_held = [], 0
        keep = upper >= self.need[q]
        return q[keep], c[keep], upper[keep]


def _scanned(pairs: DataFrame, ranges: dict[int, Cells], params: VaFile, width: str) -> DataFrame:
    """qid, cid, upper: what the scan of the approximations leaves. Sorted by pair, queries before cells."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, scan, queries, qids = None, None, [], []

        def out():
            q, c, upper = scan.taken()
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(qids)[q]), pa.array(c), pa.array(upper)], ["qid", "cid", "upper"])

        for b in batches:
            column = lambda name: b.column(b.schema.get_field_index(name)).to_numpy()  # noqa: E731, B023
            key = np.stack([column(c).astype(np.int64) for c in ("dim", "block", "stripe", "side")], 1)
            body = b.column(b.schema.get_field_index("body"))
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            for i, j in zip([0, *cuts], [*cuts, b.num_rows]):
                if i == j:
                    continue
                pair, side, dim = tuple(key[i, :3]), key[i, 3], int(key[i, 0])
                if pair != at:
                    if scan is not None:
                        yield out()
                    at, scan, queries, qids = pair, None, [], []
                ids = column("id")[i:j]
                if side == 0:
                    queries.append(numbers(body.slice(i, j - i), dim, width))
                    qids.append(ids)
                elif queries:
                    scan = scan or Scan(np.concatenate(queries), ranges[dim], params.k)
                    cells = np.frombuffer(b"".join(body.slice(i, j - i).to_pylist()), np.uint8).reshape(j - i, dim)
                    tile = max(params.k + 1, params.scores // len(scan.need))
                    for t in range(0, j - i, tile):
                        scan.add(ids[t: t + tile], cells[t: t + tile])
                        if scan.n_held > params.scores:
                            yield out()
        if scan is not None:
            yield out()

    return pairs.mapInArrow(run, "qid long, cid long, upper double")


def _scored(pairs: DataFrame, width: str) -> DataFrame:
    """Exact scores: qid, query_id, score, ids of rows that also have qvec, vec. Whole numbers beyond a long end at its limits."""
    size = np.dtype(width).itemsize

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            dims = pc.binary_length(column["vec"]).to_numpy() // size
            score = np.zeros(b.num_rows, np.int64)
            for dim in np.unique(dims[dims > 0]):
                at = np.flatnonzero(dims == dim)
                x, y = (numbers(column[c].take(pa.array(at)), int(dim), width) for c in ("qvec", "vec"))
                exact = np.einsum("ij,ij->i", abs(x), abs(y)) < 2**53
                score[at[exact]] = np.einsum("ij,ij->i", x[exact], y[exact]).astype(np.int64)
                for i in np.flatnonzero(~exact):
                    total = sum(int(u) * int(v) for u, v in zip(x[i], y[i]))
                    score[at[i]] = min(max(total, -LONG), LONG - 1)
            yield pa.RecordBatch.from_arrays([column["qid"], column["query_id"], pa.array(score), column["ids"]],
                                             ["qid", "query_id", "score", "ids"])

    return pairs.select("qid", "query_id", "qvec", "vec", "ids").mapInArrow(
        run, "qid long, query_id long, score long, ids array<long>")


def top_k(df: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", params: VaFile = VaFile()) -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score: the k rows of ``df`` with the largest inner product with each query.

    ``queries`` has the columns ``key`` and ``vector`` too. Rows whose id is the query's own are no candidates; ties go
    to the smaller id; a query with fewer candidates has them all. Vectors that are null or hold null or non-finite
    components take no part, nor do rows without an id. Vectors meet those of their own length (empty ones score 0).
    Rows that agree in id and scaled vector count once; rows that share an id only are rows (or queries) of their own.
    Other columns are ignored. An empty table, or no query, gives no rows. The driver holds a row per component of each vector length.
    """
    spark, k = df.sparkSession, params.k
    single = isinstance(df.schema[vector].dataType.elementType, FloatType) and isinstance(
        queries.schema[vector].dataType.elementType, FloatType)
    if not single:
        df = df.withColumn(vector, F.col(vector).cast("array<double>"))
        queries = queries.withColumn(vector, F.col(vector).cast("array<double>"))
    width = "<f4" if single and params.scale & (params.scale - 1) == 0 else "<f8"
    size = np.dtype(width).itemsize
    dim = (F.length("vec") / size).cast("int")

    smallest = Window.partitionBy("vec").orderBy("vec_id")
    classes = scaled_vectors(df, key, vector, params.scale).withColumn("_n", F.row_number().over(smallest)).where(
        F.col("_n") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = cut_lineage(classes.select(F.monotonically_increasing_id().alias("cid"), dim.alias("dim"), "vec", "ids"))
    asked = cut_lineage(scaled_vectors(queries, key, vector, params.scale).select(
        F.monotonically_increasing_id().alias("qid"), F.col("vec_id").alias("query_id"), dim.alias("dim"), F.col("vec").alias("qvec")))
    n_classes, n_asked = classes.count(), asked.count()
    schema = "query_id long, rank int, vec_id long, score long"
    if not n_classes or not n_asked:
        return spark.createDataFrame([], schema)

    rows: dict[int, list] = {}
    for r in cell_ranges(df, vector, params).orderBy("dim", "pos").collect():
        rows.setdefault(r["dim"], []).append(r)
    ranges = {d: Cells(r, params.bits) for d, r in rows.items()}
    ranges[0] = Cells([], params.bits)

    def approximate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, vec = b.column(1).to_numpy(), b.column(2)
            for d in np.unique(dims):
                at = pa.array(np.flatnonzero(dims == d))
                cells = ranges[int(d)].number(numbers(vec.take(at), int(d), width))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(
                    [c.tobytes() for c in cells], pa.binary())], ["cid", "dim", "cells"])

    blocks = -(-n_asked // params.query_rows)
    least, most = params.stripe_rows
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    stripes = max(-(-n_classes // most), min(-(-n_classes // least), -(-tasks // blocks)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    approximations = classes.select("cid", "dim", "vec").mapInArrow(approximate, "cid long, dim int, cells binary")
    pairs = asked.select("dim", of("qid", blocks).alias("block"), every(stripes).alias("stripe"), F.lit(0).alias("side"),
                         F.col("qid").alias("id"), F.col("qvec").alias("body")).unionByName(
        approximations.select("dim", every(blocks).alias("block"), of("cid", stripes).alias("stripe"), F.lit(1).alias("side"),
                              F.col("cid").alias("id"), F.col("cells").alias("body")))
    key_ = ("dim", "block", "stripe")
    pairs = pairs.repartitionById(blocks * stripes, F.col("block") * stripes + F.col("stripe")).sortWithinPartitions(*key_, "side")
    order = Window.partitionBy("qid").orderBy(F.col("upper").desc(), "cid")
    left = cut_lineage(_scanned(pairs, ranges, params, width).withColumn("place", F.row_number().over(order)))

    best = spark.createDataFrame([], "qid long, query_id long, score long, vec_id long")
    begin, end = 0, params.first
    while True:
        kth = best.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
        open_ = left.where(F.col("place") > begin).join(kth.select("qid", "kth"), "qid", "left").where(
            "kth is null or upper >= kth")
        if begin and open_.isEmpty():
            break
        now = open_.where(F.col("place") <= end).join(asked.drop("dim"), "qid").join(classes.select("cid", "vec", "ids"), "cid")
        found = _scored(now, width).select("qid", "query_id", "score", F.explode("ids").alias("vec_id")).where(
            "vec_id <> query_id").unionByName(best)
        order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "vec_id")
        best = cut_lineage(found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n"))
        begin, end = end, 4 * end
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "vec_id")
    return best.select("query_id", F.row_number().over(order).cast("int").alias("rank"), "vec_id", "score")
