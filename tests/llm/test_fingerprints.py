import numpy as np
import hashlib
import random

from sheaf.llm import fingerprints as fp


def slow_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_edit_distance_and_likeness():
    rng = random.Random(0)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 80))) for _ in range(2))
        assert fp.common_length(a, b) == slow_common(a, b)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(2000)).encode()
    other = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(2000)).encode()
    a, b = fp.fingerprint(text), fp.fingerprint(text[:4000] + b"an insertion " + text[4000:])
    assert fp.likeness(a, a) == 1 and 0.9 < fp.likeness(a, b) < 1 and fp.likeness(a, fp.fingerprint(other)) == 0
    assert fp.likeness(a, b) == fp.likeness(b, a)
    assert fp.likeness(a, fp.fingerprint(text[: len(text) * 2 // 3])) > 0.5
    assert fp.fingerprint(b"") == "3::" and fp.likeness("3::", "3::") == 1 and fp.likeness("3::", a) == 0


def test_next_document_and_edges(spark, monkeypatch):
    monkeypatch.setattr(fp, "BUCKET_ROWS", 7)
    rng = random.Random(2)
    texts = {d * 3 - 50: "".join(rng.choice("abc é\n中") for _ in range(rng.randint(0, 90))) for d in range(100)}
    texts |= {5: None, 8: "", 10: "x" * 200_000}
    df = spark.createDataFrame([(d, t, 1) for d, t in texts.items()] + [(None, "z", 1)], "doc_id long, text string, bucket int")
    got = {r.doc_id: r for r in fp.document_fingerprints(df.repartition(5)).collect()}
    order = sorted(texts, reverse=True)
    assert sorted(got) == sorted(texts)
    for d, after in zip(order, order[1:] + order[:1]):
        t, n = texts[d] or "", texts[after] or ""
        edited = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == fp.fingerprint(t.encode()) and r.edited_fingerprint == fp.fingerprint(edited.encode())
        assert r.near_next == fp.likeness(r.fingerprint, got[after].fingerprint)
        assert r.near_edited == fp.likeness(r.fingerprint, r.edited_fingerprint)
    one = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert fp.document_fingerprints(one).first().near_next == 1.0
    assert fp.document_fingerprints(one.union(one)).count() == 2 and fp.document_fingerprints(one.limit(0)).count() == 0


def plain_fingerprint(data):
    """The fingerprint byte by byte: every window's hash, every chunk's hash."""
    from sheaf.llm import fingerprints as fp
    from sheaf.llm.textbytes import mix, powers
    if not data:
        return "3::"
    block = 3
    while block * 64 < len(data):
        block *= 2
    m32, m64 = (1 << 32) - 1, (1 << 64) - 1

    def rolled(i):
        h = 0
        for k in range(min(7, i + 1)):
            h = (h + (data[i - k] + 1) * pow(0x01000193, k, 1 << 32)) & m32
        h ^= h >> 15
        h = h * 0x2C1B3C6D & m32
        return h ^ h >> 13
    base = int(powers(2)[0][1])
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

    def signature(size):
        out, chunk = "", []
        for i, c in enumerate(data):
            chunk.append(c)
            if rolled(i) % size == size - 1 or i == len(data) - 1:
                total = sum((x + 1) * pow(base, k, 1 << 64) for k, x in enumerate(chunk)) & m64
                out += alphabet[int(mix(np.array([total], np.uint64))[0]) >> 58]
                chunk = []
        return out
    return f"{block}:{signature(block)}:{signature(2 * block)}"


def test_fingerprint_byte_by_byte():
    from sheaf.llm.fingerprints import fingerprint
    rng = random.Random(12)
    samples = [b"", b"a", b"ab" * 40, bytes(range(256)), "é😀".encode() * 30] + [rng.randbytes(rng.randrange(1, 700)) for _ in range(40)]
    samples += [b"the quick brown fox " * k for k in (1, 7, 40)]
    for data in samples:
        assert fingerprint(data) == plain_fingerprint(data)
