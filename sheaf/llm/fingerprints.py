"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes cuts a text wherever it hits a residue modulo the block
size; every chunk between cuts gives one signature character. A fingerprint has the block
size and the signatures for it and for its double: ``block:signature:signature``. Two
fingerprints are compared where their block sizes agree, by edit distance (insertions and
deletions) over the signatures, after a common run of characters has been found. Texts are
taken whole and signatures are as long as the text makes them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.textbytes import mix, powers

WINDOW, LEAST_BLOCK, CHUNKS = 7, 3, 64
"""Bytes that the rolling hash sees, smallest block size, chunks that a text is expected to fall into at most."""

RUN = 5
"""Characters in a row that two signatures must share, or half of a shorter one."""

BUCKET_ROWS, MOST_BUCKETS = 2000, 100_000
"""Documents of one bucket of neighbouring ids, about, and buckets at most."""

_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_ROLL = [np.uint32(pow(0x01000193, k, 1 << 32)) for k in range(WINDOW)]


def _rolling(b: np.ndarray) -> np.ndarray:
    wide = b.astype(np.uint32) + np.uint32(1)
    out = wide.copy()
    for k in range(1, WINDOW):
        out[k:] += wide[:-k] * _ROLL[k]
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    return out ^ (out >> np.uint32(13))


def fingerprint(data: bytes) -> str:
    """Fingerprint of UTF-8 bytes; equal bytes give equal fingerprints, no bytes give ``3::``."""
    n = len(data)
    if not n:
        return f"{LEAST_BLOCK}::"
    b = np.frombuffer(data, np.uint8)
    rolled = _rolling(b)
    block = LEAST_BLOCK
    while block * CHUNKS < n:  # by length alone: texts of like length stay comparable, repetitive ones too
        block *= 2
    cuts = np.flatnonzero(rolled % np.uint32(block) == block - 1)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])

    def signature(at: np.ndarray) -> str:
        edges = np.concatenate([[0], at + 1] if len(at) and at[-1] == n - 1 else [[0], at + 1, [n]])
        s, e = edges[:-1], edges[1:]
        return _ALPHABET[mix((total[e] - total[s]) * down[s]) >> np.uint64(58)].tobytes().decode()

    double = cuts[rolled[cuts] % np.uint32(2 * block) == 2 * block - 1]
    return f"{block}:{signature(cuts)}:{signature(double)}"


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word of positions at a time."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & every
    return len(a) - row.bit_count()


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    run = max(1, min(RUN, min(len(a), len(b)) // 2))
    if {a[i: i + run] for i in range(len(a) - run + 1)}.isdisjoint(b[i: i + run] for i in range(len(b) - run + 1)):
        return 0.0
    return 2 * common_length(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1: one less the edit distance over the signatures' length, at the best compatible block size."""
    if a == b:
        return 1.0
    (x, a1, a2), (y, b1, b2) = a.split(":"), b.split(":")
    x, y = int(x), int(y)
    if x == y:
        return max(_alike(a1, b1), _alike(a2, b2) if a2 and len(a2) > 1 else 0.0)
    return _alike(a1, b2) if x == 2 * y else _alike(a2, b1) if y == 2 * x else 0.0


def _bounds(docs: DataFrame) -> np.ndarray:
    """Ascending doc_ids that end the buckets, the largest one last; at most MOST_BUCKETS."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top")).first()
    if not row["n"]:
        return np.empty(0, np.int64)
    n = min(MOST_BUCKETS, -(-row["n"] // BUCKET_ROWS))
    at = [k / n for k in range(1, n)]
    inner = docs.approxQuantile("doc_id", at, 0.2 / n) if at else []
    return np.unique(np.array([int(x) for x in inner if x < row["top"]] + [row["top"]], np.int64))


def with_next(docs: DataFrame) -> DataFrame:
    """Documents in buckets of neighbouring ids, each bucket followed by the document after its last.

    Columns _bucket, _after (1: the document after), doc_id, text, sorted within partitions so that every
    document of a bucket is followed by the next one in descending doc_id (after the smallest: the largest).
    """
    bounds = _bounds(docs)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            bucket = np.searchsorted(bounds, ids)
            head = np.flatnonzero(bounds[bucket] == ids)  # first of its bucket: it follows the last of the one above
            row = np.concatenate([np.arange(len(ids)), head])
            to = np.concatenate([bucket, (bucket[head] + 1) % len(bounds)])
            after = np.concatenate([np.zeros(len(ids), np.int32), np.ones(len(head), np.int32)])
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(after), pa.array(ids[row]),
                                              b.column(1).take(pa.array(row))], ["_bucket", "_after", "doc_id", "text"])

    dealt = docs.mapInArrow(deal, "_bucket long, _after int, doc_id long, text string").repartition("_bucket")
    return dealt.sortWithinPartitions("_bucket", "_after", F.col("doc_id").desc(), "text")


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last third (rounded down, in code points) replaced by the first as many of the next
    document in descending doc_id; after the last comes the first. A null text counts as empty; two
    empty texts are alike (1.0), an empty and another one are not (0.0). Rows of equal doc_id stand in
    the order of their texts, rows without a doc_id are left out, an empty table gives no rows.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            rows = []
            for bucket, after, doc, text in zip(*(b.column(k).to_pylist() for k in range(4))):
                text = text or ""
                mark = fingerprint(text.encode())
                if held is not None and held[0] == bucket:
                    _, doc0, text0, mark0 = held
                    n = len(text0)
                    edited = (text0[: n - n // 3] + text[: n // 3]).encode()
                    edited_mark = fingerprint(edited)
                    rows.append((doc0, n, hashlib.sha256(edited).hexdigest(), mark0, edited_mark,
                                 likeness(mark0, edited_mark), likeness(mark0, mark)))
                held = None if after else (bucket, doc, text, mark)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_next(docs).mapInArrow(run, schema)
