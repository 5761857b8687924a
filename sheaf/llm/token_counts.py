"""Token counts by byte-pair merging, without emitting identifiers.

A word's symbols form a linked list; a heap holds the rank of each adjacent pair. The pair of
lowest rank (the leftmost among equals) is popped and merged until no pair has a rank. The
count is the number of first symbols less the number of merges. Words recur, so a worker
keeps the counts of the words that it has met, up to a bound.

The vocabulary file (JSON of the ``tokenizers`` library) is a parameter; its merges and byte
symbols are read from it. Texts whose characters are all below U+0250 are cut into words
here; any other text goes through the file's own normaliser and word splitter.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_WORDS = 600_000
"""Words whose counts a worker keeps; beyond it the cache starts anew."""

# The classes of characters below U+0250 that the splitting patterns of the vocabularies name.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACES = "\t-\r \x85\xa0"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"

BEYOND_LATIN = re.compile("[^\x00-ɏ]")
WORD = re.compile(f"{CONTRACTIONS}|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")


def merged_length(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> int:
    """Symbols left when every pair that has a rank is merged, lowest rank first.

    ``pairs`` maps two symbols to (rank, merged symbol). No symbols leave none.
    """
    n = len(symbols)
    symbols = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(found[0], i, symbols[i], symbols[i + 1], found[1])
            for i in range(n - 1) if (found := pairs.get((symbols[i], symbols[i + 1])))]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, left, right, merged = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != left or j >= n or symbols[j] != right:
            continue  # one of the two has been merged meanwhile
        symbols[i], symbols[j] = merged, -1
        after[i] = k = after[j]
        merges += 1
        if k < n:
            before[k] = i
            if found := pairs.get((merged, symbols[k])):
                heapq.heappush(heap, (found[0], i, merged, symbols[k], found[1]))
        if (h := before[i]) >= 0 and (found := pairs.get((symbols[h], merged))):
            heapq.heappush(heap, (found[0], h, symbols[h], merged, found[1]))
    return n - merges


class _Counts(dict):
    """Word -> tokens; a missing word is merged and kept."""

    def __init__(self, count: Callable[[str], int]):
        super().__init__()
        self.count = count

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = n = self.count(word)
        return n


class WordBpe:
    """Token counts of texts under a word-level BPE file: words end in a marked last symbol."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        spec = json.load(open(path, encoding="utf-8"))
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab = vocab
        self.pairs = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        special = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = re.compile("|".join(sorted(special, key=len, reverse=True))) if special else None
        library = Tokenizer.from_file(path)
        self.normalise, self.split = library.normalizer, library.pre_tokenizer
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.byte_chars = {c: level.pre_tokenize_str(c)[0][0] for c in map(chr, range(0x250)) if c}
        self.plain = _Counts(lambda w: self._count("".join(map(self.byte_chars.__getitem__, w))))
        self.mapped = _Counts(self._count)

    def _count(self, byte_chars: str) -> int:
        """Tokens of a word that is written in the vocabulary's byte characters; unknown symbols give none."""
        symbols = [*byte_chars[:-1], byte_chars[-1] + self.end]
        return merged_length([self.vocab[s] for s in symbols if s in self.vocab], self.pairs)

    def _part(self, text: str) -> int:
        low = text.lower()
        if BEYOND_LATIN.search(text) or BEYOND_LATIN.search(low):
            words = self.split.pre_tokenize_str(self.normalise.normalize_str(text))
            return sum(self.mapped[w] for w, _ in words)
        return sum(map(self.plain.__getitem__, WORD.findall(low)))

    def count(self, text: str) -> int:
        """Tokens of a whole text; a special token's string counts as that one token."""
        if self.special is None or not self.special.search(text):
            return self._part(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._part, parts))


@lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit): one row per input row.

    ``path`` is a vocabulary file that every worker can read. A null text counts as empty: no
    bytes, no tokens. Other columns are ignored, repeated rows give repeated rows, an empty
    table gives none. No begin, end or padding tokens are counted and nothing is cut off.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for b in batches:
            text = pc.fill_null(b.column(1), "")
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pc.binary_length(text).cast(pa.int64()),
                 pa.array([bpe.count(t.as_py()) for t in text], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
