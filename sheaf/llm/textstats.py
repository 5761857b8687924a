"""Exact counts over whole texts that the quality operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.textbytes import WHITESPACE, Chunk, lut, repeats, text_chunks, windows

SYMBOLS = lut("#*$%&|<>")
_CONTINUATION = (np.arange(256) & 0xC0) == 0x80
_UPPER = lut("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = lut("0123456789")
_STOP = lut(".!?")
_MARK = lut("!\"'()+,-./:;=?@[\\]^_`{}~")

STATS = ("n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
         "n_adjacent", "n_distinct", "n_upper", "n_digits", "n_stops", "n_marks", "n_long_words")
"""n_lines: lines with a word; n_dup_lines: those equal to an earlier line; n_repeat_words: words inside a 3-word window
that the text holds twice or more; n_adjacent: words equal to the word before; n_distinct: different words;
n_stops: full stops, question and exclamation marks; n_marks: other ASCII punctuation too; n_long_words: over 20 bytes."""


def chunk_stats(c: Chunk) -> dict[str, np.ndarray]:
    """One int64 array per statistic, a value per document."""
    data = c.data
    whole = ~_CONTINUATION[data]
    s, e, n_words = c.words()
    h = c.hashes(s, e)
    word_doc = np.repeat(np.arange(len(c)), n_words)

    def per_doc(flag, doc):
        return np.bincount(doc[flag], minlength=len(c)).astype(np.int64)

    first, hashes = windows(h, n_words, 3)
    _, shared = repeats(hashes, np.maximum(n_words - 2, 0))
    covered = np.zeros(len(h) + 3, bool)
    for k in range(3):
        covered[first[shared] + k] = True
    again, _ = repeats(h, n_words)
    beside = np.zeros(len(h), bool)
    beside[1:] = (h[1:] == h[:-1]) & (word_doc[1:] == word_doc[:-1])
    ls, le, n_lines = c.lines()
    ink = np.concatenate([[0], np.cumsum(~WHITESPACE[data])])
    wordy = ink[le] > ink[ls]
    line_doc = np.repeat(np.arange(len(c)), n_lines)[wordy]
    with_word = np.bincount(line_doc, minlength=len(c)).astype(np.int64)
    dup, _ = repeats(c.hashes(ls[wordy], le[wordy]), with_word)
    return {
        "n_chars": c.sums(whole), "n_words": n_words.astype(np.int64),
        "word_chars": c.sums(whole & ~WHITESPACE[data]), "n_symbols": c.sums(SYMBOLS[data]), "n_lines": with_word,
        "n_dup_lines": per_doc(dup, line_doc), "n_repeat_words": per_doc(covered[: len(h)], word_doc),
        "n_adjacent": per_doc(beside, word_doc), "n_distinct": n_words - per_doc(again, word_doc),
        "n_upper": c.sums(_UPPER[data]), "n_digits": c.sums(_DIGIT[data]), "n_stops": c.sums(_STOP[data]),
        "n_marks": c.sums(_MARK[data]), "n_long_words": per_doc(e - s > 20, word_doc),
    }


def text_stats(docs: DataFrame) -> DataFrame:
    """doc_id and ``STATS`` (long) of each row's whole text; a null text counts as empty."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [chunk_stats(c) for _, c in text_chunks(b.column(1))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(np.concatenate([p[k] for p in parts]) if parts else [], pa.int64())
                                for k in STATS)], ["doc_id", *STATS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, " + ", ".join(f"{k} long" for k in STATS))


def labelled_rows(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and label (0 or 1) of all rows outside the held-out fifth.

    Rows without a doc_id or with another label are left out; of repeated doc_ids one row stays.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
    return rows.groupBy("doc_id").agg(F.min("label").alias("label"))


def labelled_sample(labels: DataFrame, label: str, bound: int) -> DataFrame:
    """At most ``bound`` of ``labelled_rows``, by a hash of doc_id."""
    return labelled_rows(labels, label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def held_out():
    """crc32(doc_id as text) mod 5 is 0; a null doc_id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
