import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sheaf.llm import textbytes as tb
from sheaf.llm.textstats import chunk_stats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(n=400):
    rng = random.Random(1)
    odd = [None, "", "a", "  a b\nc ", "x y z", "é ü\n\nfoo\n", "aa", "aa bb cc dd aa bb cc", "a b " * 300, "z z z\nz z z\n\n"]
    return odd + ["".join(rng.choice("aab \n\tcé#|1A.") for _ in range(rng.randint(0, 90))) for _ in range(n)]


@pytest.mark.parametrize("size", [50, 1 << 20])
def test_words_lines_and_shingles(monkeypatch, size):
    monkeypatch.setattr(tb, "CHUNK_BYTES", size)
    docs, seen = texts(), {}
    for i, c in tb.text_chunks(pa.array(docs).slice(2)):
        s, e, n = c.words()
        h = c.hashes(s, e)
        ls, le, ln = c.lines()
        g, gn = tb.shingles(h, n, 3)
        at, la, ga = (np.concatenate([[0], np.cumsum(x)]) for x in (n, ln, gn))
        for k in range(len(c)):
            t = docs[2 + i + k] or ""
            w = WORD.findall(t)
            assert [c.data[a:b].tobytes().decode() for a, b in zip(s[at[k]:at[k + 1]], e[at[k]:at[k + 1]])] == w
            assert [c.data[a:b].tobytes().decode() for a, b in zip(ls[la[k]:la[k + 1]], le[la[k]:la[k + 1]])] == t.split("\n")
            own = [" ".join(w[j:j + 3]) for j in range(len(w) - 2)] or ([" ".join(w)] if w else [])
            assert gn[k] == len(own)
            for kind, key, value in [("w", x, y) for x, y in zip(w, h[at[k]:at[k + 1]])] + \
                    [("g", x, y) for x, y in zip(own, g[ga[k]:ga[k + 1]])]:
                assert seen.setdefault((kind, key), value) == value
    assert len({(k[0], v) for k, v in seen.items()}) == len(seen)


def test_stats_equal_plain_counts():
    docs = texts()
    got = {}
    for i, c in tb.text_chunks(pa.array(docs)):
        for k, v in chunk_stats(c).items():
            got.setdefault(k, []).extend(v.tolist())
    for i, t in enumerate(docs):
        t = t or ""
        w = WORD.findall(t)
        windows = collections.Counter(tuple(w[j:j + 3]) for j in range(len(w) - 2))
        covered = {j + k for j in range(len(w) - 2) if windows[tuple(w[j:j + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert got["n_words"][i] == len(w) and got["word_chars"][i] == sum(map(len, w))
        assert got["n_symbols"][i] == len(re.findall(r"[#*$%&|<>]", t)) and got["n_repeat_words"][i] == len(covered)
        assert got["n_lines"][i] == len(lines) and got["n_dup_lines"][i] == len(lines) - len(set(lines))
        assert got["n_distinct"][i] == len(set(w)) and got["n_chars"][i] == len(t)
        assert got["n_adjacent"][i] == sum(a == b for a, b in zip(w, w[1:]))
