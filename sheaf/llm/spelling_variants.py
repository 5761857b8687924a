"""Spelling variants: words one edit apart, found by partition-and-enumerate signatures of their letter multisets.

A word's letters are a multiset, that is a binary vector with a bit for the k-th occurrence of each letter. One inserted or
deleted letter flips one bit, a replaced one two. The bits are dealt into ``parts`` parts; two vectors at
distance two or less differ in two parts at most, so they agree on all but some two parts. A signature is the multiset
without two parts, one for every choice of the two, and equal signatures are equi-joined. The join's condition holds
the pair to one signature (the one that leaves out just the parts that differ) and to a
distance of two over hashed bits. Words of the matched multisets are then compared letter by letter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.session import cut_lineage

SLICE = 1 << 20
"""Bytes of a text that are split at a time."""
HELD = 200_000
"""Different words that a task counts before it passes them on."""


@dataclass(frozen=True)
class Variants:
    """``least_chars``, ``least_count``: of a word; ``typo``: a run with a checksum that this divides loses a letter (0:
    none does); ``parts``: of the bits of a multiset; ``ratio``: least count of a word's form, in counts of the word;
    ``list_words``: words of one multiset that a row holds, about."""
    least_chars: int = 5
    least_count: int = 3
    typo: int = 97
    parts: int = 6
    ratio: int = 2
    list_words: int = 256


LETTERS = bytes([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256)])
"""Latin-1: A-Z in lower case, a-z and from U+00C0 as they are, all else a blank."""


def letter_runs(text: str) -> Iterator[list[bytes]]:
    """Maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased, in Latin-1, a slice of the text at a time."""
    rest = text.encode("latin-1", "replace").translate(LETTERS)
    at = 0
    while at < len(rest):
        end = rest.find(b" ", at + SLICE)
        end = len(rest) if end < 0 else end
        yield rest[at:end].split()
        at = end


def word_counts(docs: DataFrame, params: Variants = Variants()) -> DataFrame:
    """word, n, letters: the words of all texts after damage, their counts, and their letters in code point order."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def batch():
            words = [w.decode("latin-1") for w in held]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own: Counter[bytes] = Counter()
                for words in letter_runs(text):
                    own.update(words)
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for w, n in own.items():
                    if params.typo:
                        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                        if h % params.typo == 0:
                            k = h % len(w)
                            w = w[:k] + w[k + 1:]
                    if len(w) >= params.least_chars:
                        held[w] += n
                if len(held) > HELD:
                    yield batch()
                    held.clear()
        if held:
            yield batch()

    counts = docs.select("doc_id", "text").where("text is not null").mapInArrow(run, "word string, n long")
    words = counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= params.least_count)
    return words.withColumn("letters", F.array_join(F.array_sort(F.split("word", "")), ""))


def signatures(multisets: DataFrame, rank: dict[str, int], parts: int) -> DataFrame:
    """signature, letters, size, first, second, lone_first, lone_second, bits: a row for each two parts left out.

    ``first`` and ``second`` are the letters of the parts left out. ``lone_first`` (``lone_second``) says that the
    signature counts for pairs that differ in the first (second) of them only; those differ in one
    part, which ``parts - 1`` signatures leave out. ``bits``: the left-out bits hashed into a long.
    """
    names = ["signature", "letters", "size", "first", "second", "lone_first", "lone_second", "bits"]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int64()]
    out_of = list(combinations(range(parts), 2))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 2_000):
                rows = []
                for letters in b.column(0).slice(k, 2_000).to_pylist():
                    lists, bits, seen, last = [[] for _ in range(parts)], [0] * parts, 0, ""
                    for c in letters:
                        seen = seen + 1 if c == last else 0
                        last, r = c, rank[c]
                        p = (r + 3 * seen) % parts
                        # a letter's occurrences in a part differ by their number only, so it is repeated in the text
                        lists[p].append(c)
                        bits[p] ^= 1 << (r * 7 + seen * 29) % 63
                    dealt = ["".join(x) for x in lists]
                    for i, j in out_of:
                        kept = "/".join([dealt[p] for p in range(parts) if p != i and p != j])
                        rows.append((f"{i}.{j}/{kept}", letters, len(letters), dealt[i], dealt[j], (i, j) == (0, 1), i == 0,
                                     bits[i] ^ bits[j]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return multisets.select("letters").mapInArrow(
        run, "signature string, letters string, size int, first string, second string, lone_first boolean, lone_second boolean, bits long")


def near_multisets(words: DataFrame, parts: int) -> DataFrame:
    """more, less: pairs of multisets that one inserted or replaced letter may turn into each other; ``more`` has the
    inserted letter, or the larger letters of two of one size. May hold a few pairs that are further apart."""
    multisets = words.select("letters").distinct()
    found = multisets.select(F.explode(F.split("letters", "")).alias("c")).groupBy("c").count().orderBy(F.desc("count"), "c")
    rank = {r["c"]: i for i, r in enumerate(found.collect())}  # a row per letter that occurs: at most 90
    entries = signatures(multisets, rank, parts)
    x, y = entries.alias("x"), entries.alias("y")
    col = F.col
    first, second = col("x.first") != col("y.first"), col("x.second") != col("y.second")
    longer = (col("x.size") == col("y.size") + 1) | ((col("x.size") == col("y.size")) & (col("x.letters") > col("y.letters")))
    same = (col("x.signature") == col("y.signature")) & longer & (
        F.bit_count(col("x.bits").bitwiseXOR(col("y.bits"))) <= 2) & (
        (first & second) | (first & ~second & col("x.lone_first")) | (second & ~first & col("x.lone_second")))
    return x.join(y, same).select(col("x.letters").alias("more"), col("y.letters").alias("less"))


def word_lists(words: DataFrame, list_words: int) -> DataFrame:
    """letters, words, counts: the words of a multiset and their counts, joined by blanks, in lists of about ``list_words``."""
    size = words.groupBy("letters").agg(F.ceil(F.count(F.lit(1)) / list_words).alias("_lists"))
    dealt = words.join(size, "letters").withColumn("_list", F.pmod(F.xxhash64("word"), F.col("_lists")))
    lists = dealt.groupBy("letters", "_list").agg(F.collect_list(F.struct("word", "n")).alias("l"))
    return lists.select("letters", F.array_join("l.word", " ").alias("words"),
                        F.array_join(F.col("l.n").cast("array<string>"), " ").alias("counts"))


def one_edit(more: list[str], less: list[str]) -> list[tuple[int, int]]:
    """(i, j) of words ``more[i]``, ``less[j]`` that one deleted or replaced letter turns into each other.

    All words of a list have the same letters, so the edited letter is known.
    """
    left, extra = more[0], ""
    for c in less[0]:  # short words: a replacement a letter is quicker than counting letters
        rest = left.replace(c, "", 1)
        if len(rest) == len(left):
            extra += c
            if len(extra) > 1:
                return []
        left = rest
    if len(left) != 1:
        return []
    old, new = left, extra
    place = {w: j for j, w in enumerate(less)}
    out = []
    for i, w in enumerate(more):
        at, hits = w.find(old), set()
        while at >= 0:
            j = place.get(w[:at] + new + w[at + 1:])
            if j is not None and j not in hits:
                hits.add(j)
                out.append((i, j))
            at = w.find(old, at + 1)
    return out


def near_words(words: DataFrame, params: Variants = Variants()) -> DataFrame:
    """word, n, near, near_n: both directions of all pairs of words one edit apart (``words``: as ``word_counts``, stored)."""
    lists = cut_lineage(word_lists(words, params.list_words))
    pairs = near_multisets(words, params.parts)
    both = pairs.join(lists.select(F.col("letters").alias("more"), F.col("words").alias("x"), F.col("counts").alias("x_n")), "more").join(
        lists.select(F.col("letters").alias("less"), F.col("words").alias("y"), F.col("counts").alias("y_n")), "less").select(
        "x", "x_n", "y", "y_n")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, x_n, y, y_n in zip(*(c.to_pylist() for c in b.columns)):
                x, y = x.split(" "), y.split(" ")
                found = one_edit(x, y)
                if found:
                    x_n, y_n = x_n.split(" "), y_n.split(" ")
                for i, j in found:
                    n, m = int(x_n[i]), int(y_n[j])
                    out.append((x[i], n, y[j], m))
                    out.append((y[j], m, x[i], n))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["word", "n", "near", "near_n"])

    return both.mapInArrow(run, "word string, n long, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of each word's chain of forms, by pointer doubling (chains have no loops, as counts rise)."""
    at = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("_on"), F.col("root").alias("_to"))
        step = cut_lineage(at.join(on, at["root"] == on["_on"], "left").select(
            "word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("_moved")))
        at = step.select("word", "root")
        if step.where("_moved").isEmpty():
            return at


def spelling_variants(docs: DataFrame, params: Variants = Variants()) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of all texts.

    ``form`` is the near word (one edit apart) of largest count, ties the smallest in code point order, if it counts
    ``ratio`` times the word's or more; ``root`` follows forms to the last. ``docs`` has doc_id and text;
    other columns are ignored. Null and empty texts have no words; a null doc_id is written as nothing in the checksum's
    text; repeated rows count again. An empty table gives no rows.
    """
    words = cut_lineage(word_counts(docs, params))
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near")))
    near = near_words(words, params).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("_b"))
    joined = words.select("word", "n").join(near, "word", "left")
    good = -F.col("_b.m") >= params.ratio * F.col("n")
    found = cut_lineage(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                      F.when(good, F.col("_b.near")).alias("form"), F.when(good, -F.col("_b.m")).alias("form_n")))
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
