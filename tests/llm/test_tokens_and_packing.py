import collections
import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from sheaf.llm import bin_completion as bc  # noqa: E402
from sheaf.llm import packing, token_counts  # noqa: E402

WORDS, BYTES = str(P.path("word_bpe_49k.json")), str(P.path("byte_bpe_50k.json"))


def texts(n):
    rng = random.Random(3)
    parts = [*"abcXYZ '’stTdD  \t\n\r\x0b\x1c\x85\xa0 éÉßİΣσς中文é٣²½Ⅷ_-!😀\x00\xad", "'s", "'ll", "<|endoftext|>", "<|startoftext|>",
             "don't", "ΟΔΟΣ", "hello", " world", "12", "ŉ", "’s", "–", " — ", "“", "”", "…", "€", "→", "•", "\u2028", "\u2009", "\u202f", "\u205f"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    plain = [p for p in parts if not any(c in "İΣσς中文é٣ⅧΟΔΟΣ😀" for c in p)]
    made += ["".join(rng.choice(plain) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return [*made, *map(chr, range(0x2000, 0x2070)), *map(chr, range(0x20A0, 0x20C0)), *map(chr, range(0x2190, 0x2200)), "", "a" * 3000, " " * 500, "ab" * 1500, *map(chr, range(0x250))]


def test_merging_equals_the_library():
    library, own = Tokenizer.from_file(WORDS), token_counts.WordBpe(WORDS)
    for t in texts(600):
        assert own.count(t) == len(library.encode(t, add_special_tokens=False).ids), repr(t)


def test_ids_equal_the_library():
    library, own = Tokenizer.from_file(BYTES), packing.ByteBpe(BYTES)
    assert own.quick is not None
    for t in texts(600):
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
    assert not own._plain("a" * 400) and not own._plain("a " + "\n " * 300) and not own._plain("ａ") and own._plain("a – b" * 200)


def test_other_files_are_left_to_the_library():
    assert packing._ranked(WORDS) is None


def test_merges_leftmost_lowest_rank_first():
    pairs = {(1, 1): (1, 2), (2, 1): (0, 3)}
    assert token_counts.merged_length([1, 1, 1], pairs) == 1
    assert token_counts.merged_length([1, 1, 1, 1], pairs) == 2
    assert token_counts.merged_length([], pairs) == 0


def test_counts_query_edges(spark):
    rows = [(1, None, 9), (2, "", 9), (3, "Hello  world", 9), (3, "Hello  world", 9), (None, "x", 9), (4, "a " * 3000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = [tuple(r) for r in token_counts.token_counts(df, WORDS).collect()]
    assert collections.Counter(got) == collections.Counter(
        [(1, 0, 0, False), (2, 0, 0, False), (3, 12, 2, False), (3, 12, 2, False), (None, 1, 1, False), (4, 6000, 3000, True)])
    assert token_counts.token_counts(df.limit(0), WORDS).count() == 0


def optimum(items, capacity):
    best = [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k in {r: j for j, r in enumerate(rooms) if r >= items[i]}.values():
            go(i + 1, [*rooms[:k], rooms[k] - items[i], *rooms[k + 1:]])
        go(i + 1, [*rooms, capacity - items[i]])
    go(0, [])
    return best[0]


def test_bin_completion_is_optimal_on_small_instances_and_complete_on_all():
    rng = random.Random(0)
    for _ in range(150):
        capacity = rng.choice([10, 20, 50])
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(0, 10))), reverse=True)
        counts = collections.Counter(items)
        plan, used = bc.complete(counts, capacity), collections.Counter()
        for filling, n in plan:
            assert sum(filling) <= capacity
            used.update({s: n * k for s, k in collections.Counter(filling).items()})
        assert used == counts
        assert bc.lower_bound(counts, capacity) <= bc.bins(plan) == (optimum(items, capacity) if items else 0)
    with pytest.raises(ValueError):
        bc.complete({11: 1}, 10)
    assert bc.dominates((5, 3), (4, 1, 3)) and not bc.dominates((4, 4), (5, 3))


def test_bins_of_many_short_pieces():
    """Fillings hold as many pieces as fit, not a fixed number of them."""
    rng = random.Random(1)
    for low, high, n, gap in ((100, 146, 3000, 1.015), (60, 140, 3000, 1.005), (3, 9, 20_000, 1.0)):
        counts = collections.Counter(rng.randint(low, high) for _ in range(n))
        plan, used = bc.complete(counts, 1024), collections.Counter()
        for filling, times in plan:
            assert sum(filling) <= 1024
            used.update({s: times * k for s, k in collections.Counter(filling).items()})
        assert used == counts
        assert bc.bins(plan) <= gap * bc.lower_bound(counts, 1024)


def test_packing_is_gapless_and_whole(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 50)
    rng = random.Random(5)
    rows = [(d, " ".join(rng.choice(["alpha", "beta", "gamma delta"]) for _ in range(rng.randint(0, 60)))) for d in range(300)]
    rows += [(1000 + d, "same text") for d in range(150)] + [(2000, None), (2001, ""), (2002, "word " * 900), (7, rows[7][1])]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, _rank string")
    out = packing.pack(df, BYTES, capacity=64).collect()
    library = Tokenizer.from_file(BYTES)
    want = collections.Counter()
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range((len(ids) - 1) % 64 + 1, len(ids), 64), len(ids)]
        for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            want[(d, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert collections.Counter(tuple(r)[:5] for r in out) == want
    sequences = collections.defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in out)
    assert len(sequences) <= 1.02 * total / 64 + 1
    assert packing.pack(df.limit(0), BYTES).count() == 0
    ids = packing.pack(df, BYTES, 64, with_ids=True).collect()
    assert collections.Counter(tuple(r)[:5] for r in ids) == want
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in ids)
