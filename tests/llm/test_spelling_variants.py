import collections
import random
import re
import zlib

import pytest

from sheaf.llm import spelling_variants as sv
from sheaf.llm.queries import op13_spelling_variants

SCHEMA = "doc_id long, text string"
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counted(rows, params=sv.Variants()):
    out = collections.Counter()
    for doc, text in rows:
        for w in RUN.findall(text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % params.typo == 0:
                w = "".join(c for i, c in enumerate(w) if i != h % len(w))
            out[w] += 1
    return {w: n for w, n in out.items() if n >= params.least_count and len(w) >= params.least_chars}


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def brute(rows, params=sv.Variants()):
    n = counted(rows, params)
    form, found = {}, {}
    for w in n:
        others = [x for x in n if x != w and abs(len(x) - len(w)) < 2 and near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= params.ratio * n[w] else None
        found[w] = len(others)

    def root(w):
        return w if form[w] is None else root(form[w])
    return sorted((w, form[w] or "", root(w), n[w], found[w], n.get(form[w], 0)) for w in n)


def got(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def texts(seed, docs=12):
    rng = random.Random(seed)
    base = ["".join(rng.choice("aabécÿd") for _ in range(rng.randint(4, 8))) for _ in range(60)]
    base += ["repeat", "repeats", "repeatss", "aaaaa", "aaaaaa", "aaaaab", "abcde", "bacde", "Straße", "ÀÉ×xyz"]

    def word():
        w = rng.choice(base[:max(1, int(len(base) * rng.random() ** 2))])
        if rng.random() < 0.3:
            k, c = rng.randrange(len(w)), rng.choice("abzé")
            w = rng.choice([w[:k] + w[k + 1:], w[:k] + c + w[k:], w[:k] + c + w[k + 1:]])
        return w.upper() if rng.random() < 0.1 and w.isascii() else w
    return [(d, "".join(word() + rng.choice([" ", ", ", "’", "1", "\n", "ā"]) for _ in range(120))) for d in range(docs)]


@pytest.mark.parametrize("params", [sv.Variants(), sv.Variants(parts=4, list_words=1, typo=5), sv.Variants(least_count=1, least_chars=2, ratio=1 + 1, typo=3)])
def test_equals_brute_force(spark, params):
    rows = texts(1) + [(100, None), (101, ""), (102, " — "), (None, "repeat Repeat reXpeat"), (0, "abcde " * 3)]
    rows += [(200 + i, "lanterns " * 16 + "lanternz " * 6 + "lentarnz lanternzz lantqrnz") for i in range(12)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA + ", word string, n int").repartition(4)
    out = got(sv.spelling_variants(df, params))
    assert out == brute(rows, params)
    assert any(r[1] and r[2] != r[1] for r in out)


def test_long_text_slices_and_empty(spark, monkeypatch):
    rows = [(7, " ".join(f"word{'abc'[i % 3]}x" + "y" * (i % 11) for i in range(20_000)) + "." + "z" * 3_000_000)] * 3
    assert got(sv.spelling_variants(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    monkeypatch.setattr(sv, "SLICE", 3)
    text = "ab cde’fgh IJ éÉ x" * 5
    assert [w.decode("latin-1") for part in sv.letter_runs(text) for w in part] == [
        "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in RUN.findall(text)]
    assert sv.spelling_variants(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_edit_of_lists():
    assert sorted(sv.one_edit(["abba", "aabb"], ["abb", "bab", "bba"])) == [(0, 0), (0, 2), (1, 0)]
    assert sv.one_edit(["abca"], ["abda", "adba"]) == [(0, 0)]
    assert sv.one_edit(["abcd"], ["ab"]) == [] and sv.one_edit(["abcd"], ["abxy"]) == []


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    n = counted(rows)
    out = op13_spelling_variants(spark, sf).collect()
    assert {r.word: r.n for r in out} == n
    bucket = collections.defaultdict(set)  # words that agree without one place
    for w in n:
        for i in range(len(w)):
            bucket[w[:i] + "*" + w[i + 1:]].add(w)
            bucket[w[:i] + w[i + 1:]].add(w)
        bucket[w].add(w)
    close = collections.defaultdict(set)
    for b in bucket.values():
        for x in b:
            close[x] |= {y for y in b if near(x, y)}
    for r in out:
        best = min(close[r.word], key=lambda x: (-n[x], x), default=None)
        want = best if best is not None and n[best] >= 2 * r.n else None
        assert (r.n_near, r.form, r.form_n) == (len(close[r.word]), want, n.get(want))
    forms = {r.word: r.form for r in out}
    for r in out:
        w = r.word
        while forms[w]:
            w = forms[w]
        assert w == r.root
