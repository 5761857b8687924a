"""Packing tokenised documents into sequences of a fixed length by bin completion.

Tokenising gives pieces of at most ``capacity`` ids. The plan needs only the histogram of piece
lengths, one row per length and so at most ``capacity`` rows whatever the corpus holds; it is
the one thing that reaches the driver. Pieces of one length are interchangeable, so a piece's
rank within its length says in which bin of which pattern it lies: ranks come from windows
over (length, hash bucket), with the buckets' counts added up beforehand, so that a length
that a third of all pieces share is ranked by many tasks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.bin_completion import Limits, Pattern, complete
from sheaf.session import cut_lineage

LONG = 400
"""Characters of a word, or of surplus space, from which a text is left to the file's own library."""
CALL_CHARS = 2_000_000
"""Characters of the texts that are tokenised together, about."""
RANK_ROWS = 4_000
"""Pieces that one ranking window holds, about, should all have one length."""

# Punctuation, currency, arrows and box drawing beyond U+024F hold no letters, numbers or spaces.
UNKNOWN = re.compile("[^\x00-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u2190-\u21ff\u2500-\u25ff]")


SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
"""Fixed value: the splitting pattern that the byte-level files of this kind use."""


class ByteBpe:
    """Ids of texts under a byte-level BPE file of the ``tokenizers`` library.

    The file's merges are also its ranks, so ``tiktoken`` gives the same ids in less time. Texts with special tokens, with
    characters whose class the two libraries might see differently, or with very long words or spaces (which
    take it time in their square) are given to the file's own library, and so is every text if ids do not rise with the merges.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.quick = _ranked(path)

    def _plain(self, text: str) -> bool:
        if UNKNOWN.search(text) or any(s in text for s in self.special):
            return False
        if len(text) < LONG:
            return True
        sizes = list(map(len, text.split()))
        return max(sizes, default=0) < LONG and len(text) - sum(sizes) - len(sizes) < LONG

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text, without added special tokens."""
        if self.quick is not None and self._plain(text):
            return self.quick.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _ranked(path: str):
    """The file as a ``tiktoken`` encoding, or None if it is not a plain byte-level file with ids in the order of its merges."""
    import json

    import tiktoken
    from tokenizers.pre_tokenizers import ByteLevel

    spec = json.load(open(path, encoding="utf-8"))
    model, vocab = spec["model"], spec["model"]["vocab"]
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    plain = (spec.get("normalizer") is None and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel"
             and not spec["pre_tokenizer"].get("add_prefix_space") and spec["pre_tokenizer"].get("use_regex", True)
             and merged == sorted(merged) and not model.get("ignore_merges") and not model.get("byte_fallback"))
    if not plain:
        return None
    level = ByteLevel(add_prefix_space=False, use_regex=False)
    byte_of = {}
    for c in map(chr, range(0x800)):  # every byte of UTF-8 but those that no text has occurs here or below
        for shown, raw in zip(level.pre_tokenize_str(c)[0][0], c.encode()):
            byte_of[shown] = raw
    for c in ("\u0800", "\uffff", *map(chr, range(0x1000, 0x10000, 0x1000)), *map(chr, range(0x10000, 0x110000, 0x10000))):
        if not 0xD800 <= ord(c) < 0xE000:
            for shown, raw in zip(level.pre_tokenize_str(c)[0][0], c.encode()):
                byte_of[shown] = raw
    special = {t["content"] for t in spec["added_tokens"]}
    unused = iter(sorted(set(range(256)) - set(byte_of.values())))
    for shown in sorted({c for w in vocab if w not in special and len(w) == 1 for c in w} - byte_of.keys()):
        byte_of[shown] = next(unused)  # bytes that no UTF-8 text holds
    ranks = {bytes(map(byte_of.__getitem__, w)): i for w, i in vocab.items() if w not in special}
    return tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def _calls(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about CALL_CHARS characters, or one text."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= CALL_CHARS:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for every core
    return ByteBpe(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Token pieces of each text: doc_id, piece, start, length, ids_crc32, and ``ids`` (binary) if asked for.

    A document's ids are its text's and then ``end_id``, so even a null or empty text has one
    piece. One of more than ``capacity`` ids is cut into pieces of ``capacity``, its first piece
    taking what is over.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = byte_bpe(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            docs_, texts = batch.column(0).to_pylist(), pc.fill_null(batch.column(1), "").to_pylist()
            for i, j in _calls(texts):
                rows = []
                for doc, ids in zip(docs_[i:j], map(bpe.encode, texts[i:j])):
                    ids += end
                    total = len(ids) // 4
                    first = (total - 1) % capacity + 1
                    for p, start in enumerate([0, *range(first, total, capacity)]):
                        length = capacity if p else first
                        part = ids[4 * start: 4 * (start + length)]
                        rows.append((doc, p, start, length, zlib.crc32(part)) + ((part,) if with_ids else ()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, PIECES + ", ids binary" * with_ids)


def _layout(plan: list[Pattern]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, first bin, pieces a bin, offset of the first) in order of rank."""
    rank: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    base = 0
    for filling, times in plan:
        offset = 0
        for size in sorted(set(filling), reverse=True):
            n = filling.count(size)
            rows.setdefault(size, []).append((rank.get(size, 0), base, n, offset))
            rank[size] = rank.get(size, 0) + n * times
            offset += n * size
        base += times
    return {size: np.array(r, np.int64) for size, r in rows.items()}


def place(made: DataFrame, capacity: int = 1024, limits: Limits = Limits()) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns of ``pieces``; a stored table, as it is read three times)."""
    total = made.count()
    buckets = max(1, total // RANK_ROWS)
    keys = ("doc_id", "piece", "start", "ids_crc32")
    dealt = made.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    count = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = count.withColumn("_before", F.coalesce(F.sum("_n").over(
        Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    layout = _layout(complete(histogram, capacity, limits))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*keys)))
    ranked = ranked.join(before.drop("_n"), ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before") - 1)
    names = made.columns

    def locate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy()
            rank = b.column(b.schema.get_field_index("_rank")).to_numpy()
            seq, at = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for size in np.unique(length):
                mine = np.flatnonzero(length == size)
                rows = layout[int(size)]
                row = rows[np.searchsorted(rows[:, 0], rank[mine], "right") - 1]
                within = rank[mine] - row[:, 0]
                seq[mine] = row[:, 1] + within // row[:, 2]
                at[mine] = row[:, 3] + within % row[:, 2] * size
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index(c)) for c in names] + [pa.array(seq), pa.array(at)],
                [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"{c} {t}" for c, t in made.dtypes)
    return ranked.select(*names, "_rank").mapInArrow(locate, f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, limits: Limits = Limits(),
         with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece; before sequence_id the column ``ids``
    (little-endian unsigned 32-bit) if asked for.

    Sequences are gapless from offset 0 and as few as the search finds. Other columns of
    ``docs`` are ignored; repeated rows are packed again, each with its ids; an empty table gives no rows.
    """
    return place(cut_lineage(pieces(docs, path, capacity, end_id, with_ids)), capacity, limits)
