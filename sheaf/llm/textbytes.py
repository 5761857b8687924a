"""Words, lines, hashes and shingles straight from the UTF-8 buffers of Arrow string columns.

Every helper works on a *chunk*: some documents' bytes in one ``uint8`` array plus the
offsets between them. Word and line separators are ASCII bytes, which never occur inside a
multi-byte UTF-8 sequence, so byte positions give exact word boundaries. Hashes are 64-bit
polynomials over the bytes (odd multiplier modulo 2**64), finished with an avalanche step;
they are equal on every machine and Python version. Equal hashes are taken as equal words
only within one document or one pair of documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
"""Documents are handled in chunks of about this many bytes; one longer text is a chunk by itself."""

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SHINGLE = np.uint64(0xD6E8FEB86659FD93)

WHITESPACE = np.zeros(256, bool)
WHITESPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"): ord("Z") + 1] += 32


def lut(characters: str) -> np.ndarray:
    """Boolean table over byte values for a set of ASCII characters."""
    out = np.zeros(256, bool)
    out[[ord(c) for c in characters]] = True
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche step: spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse; the table of a normal chunk is kept."""
    size = CHUNK_BYTES + 1
    if n > size:
        return _powers.__wrapped__(n)
    up, down = _powers(size)
    return up[:n], down[:n]


class Chunk:
    """Some documents' bytes: ``data`` and ``offsets`` (one more than documents)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.starts, self.ends = offsets[:-1], offsets[1:]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i]: self.ends[i]].tobytes()

    def lowered(self) -> "Chunk":
        """A-Z in lower case, all other characters as they are."""
        return Chunk(LOWER[self.data], self.offsets)

    def folded(self) -> "Chunk":
        """A-Z and the capitals from U+00C0 to U+00DE in lower case."""
        data = LOWER[self.data]
        second = np.flatnonzero(data[:-1] == 0xC3) + 1
        second = second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]
        data[second] += 0x20
        return Chunk(data, self.offsets)

    def sums(self, per_byte: np.ndarray) -> np.ndarray:
        """Per document, the sum of a per-byte count or flag."""
        total = np.concatenate([[0], np.cumsum(per_byte, dtype=np.int64)])
        return total[self.ends] - total[self.starts]

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of flagged bytes within each document: starts, ends, and runs per document."""
        n = len(self.data)
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1] | edge[1:n]
            last[:-1] &= ~inside[1:] | edge[1:n]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        return s, e, np.searchsorted(s, self.ends) - np.searchsorted(s, self.starts)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words ``[^\\x20\\x09-\\x0D]+``: starts, ends, words per document."""
        return self.spans(~WHITESPACE[self.data])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lines split at \\n (empty ones included, at least one per document): starts, ends, lines per document."""
        cut = np.flatnonzero(self.data == 10)
        cuts = np.searchsorted(cut, self.ends) - np.searchsorted(cut, self.starts)
        first = np.searchsorted(cut, self.starts)
        count = cuts + 1
        at = np.concatenate([[0], np.cumsum(count)])
        s, e = np.empty(at[-1], np.int64), np.empty(at[-1], np.int64)
        head, tail = np.zeros(at[-1], bool), np.zeros(at[-1], bool)
        head[at[:-1]], tail[at[1:] - 1] = True, True
        inner = cut[first[0] if len(self) else 0: (first[-1] + cuts[-1]) if len(self) else 0]
        s[head], e[tail] = self.starts, self.ends
        s[~head], e[~tail] = inner + 1, inner
        return s, e, count

    def hasher(self) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """Gives 64-bit hashes of byte spans (starts, ends); equal bytes give equal hashes wherever they stand."""
        up, down = powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        return lambda s, e: mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))

    def hashes(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return self.hasher()(s, e)


def windows(word_hash: np.ndarray, per_doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every window of ``width`` words that lies within one document."""
    size = max(len(word_hash) - width + 1, 0)
    full = np.zeros(size, np.uint64)
    if not size:
        return np.empty(0, np.int64), full
    for k in range(width):
        full = full * _SHINGLE + word_hash[k: k + size]
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    first = np.flatnonzero(doc[:size] == doc[width - 1:])
    return first, mix(full[first] + np.uint64(width))


def shingles(word_hash: np.ndarray, per_doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` words, document after document, and windows per document.

    A document with fewer words gives one window of all its words; without words it gives none.
    """
    first, full = windows(word_hash, per_doc, width)
    count = np.where(per_doc >= width, per_doc - width + 1, np.minimum(per_doc, 1))
    short = np.flatnonzero((per_doc > 0) & (per_doc < width))
    if not len(short):
        return full, count
    at = np.concatenate([[0], np.cumsum(per_doc)])
    pos, val = [first], [full]
    for d in short:
        h = np.zeros(1, np.uint64)
        for w in word_hash[at[d]: at[d + 1]]:
            h = h * _SHINGLE + w
        pos.append(np.array([at[d]]))
        val.append(mix(h + np.uint64(per_doc[d])))
    order = np.argsort(np.concatenate(pos), kind="stable")
    return np.concatenate(val)[order], count


def repeats(hashes: np.ndarray, per_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of items that an earlier item of their document equals, and of items that any other one equals."""
    doc = np.repeat(np.arange(len(per_doc), dtype=np.uint64), per_doc)
    key = mix(hashes + doc * _SHINGLE)  # equal only for equal hashes of one document
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = key[1:] == key[:-1]
    later, shared = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    later[order[1:]] = same
    shared[order[1:]] |= same
    shared[order[:-1]] |= same
    return later, shared


def text_chunks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, Chunk]]:
    """(first row, chunk) pieces of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, "right")) - 1)
        yield i, Chunk(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i])
        i = j
