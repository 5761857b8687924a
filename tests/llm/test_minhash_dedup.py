import random
import re

from sheaf.llm.components import connected_components
from sheaf.llm.minhash_dedup import NearDup, drop_near_duplicates, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, percent, width):
    """doc_id -> (set size, smallest reachable doc_id) by comparing all pairs."""
    sets = {}
    for d, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {" ".join(w[i:i + width]) for i in range(len(w) - width + 1)} or ({" ".join(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed, families=25, size=12):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows = []
    for f in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 8, 60, 150, 400]))]
        for _ in range(rng.randint(1, size if f else 90)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append(" ".join(w + (passage if rng.random() < 0.3 else [])))
    rng.shuffle(rows)
    return list(enumerate(rows))


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_matches_all_pairs(spark, monkeypatch):
    rows = corpus(1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent, width in ((85, 3), (80, 5)):
        assert found(near_duplicates(df, NearDup(percent, width))) == brute(rows, percent, width)


def test_blocks_of_long_lists_and_sets(spark, monkeypatch):
    from sheaf.llm import minhash_dedup
    monkeypatch.setattr(minhash_dedup, "BLOCK_ROWS", 30)
    rows = corpus(2, families=6, size=20)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(near_duplicates(df, NearDup(85, 3))) == brute(rows, 85, 3)


def test_chains_in_a_long_list(spark, monkeypatch):
    """A large group whose ends are not like its smallest document, hung together by what lies between."""
    from sheaf.llm import minhash_dedup
    monkeypatch.setattr(minhash_dedup, "BLOCK_ROWS", 20)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for i in [*range(40), *range(48, 90)]:
        w = list(base)
        w[: i * 2] = [f"c{j}" for j in range(i * 2)]
        rows.append(" ".join(w))
    for i in range(60):
        w = list(base)
        w[rng.randrange(300)] = f"d{i}"
        rows.append(" ".join(w))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows, 95, 3)
    assert 1 < len({c for _, c in want.values()}) < len(rows) and found(near_duplicates(df, NearDup(95, 3))) == want


def test_short_documents_in_lists_of_any_length(spark, monkeypatch):
    """Sets of few shingles are linked by what they share, however many documents share it."""
    from sheaf.llm import minhash_dedup
    same = [f"w{i}" for i in range(16)]
    other = [f"v{i}" for i in range(9)]
    rows = [" ".join([*same, f"own{i}"]) for i in range(200)] + [" ".join([f"own{i}", *other]) for i in range(40)]
    random.Random(3).shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for block in (minhash_dedup.BLOCK_ROWS, 30):
        monkeypatch.setattr(minhash_dedup, "BLOCK_ROWS", block)
        for percent, width in ((85, 3), (80, 5)):
            want = brute(rows, percent, width)
            assert len({c for _, c in want.values()}) < 60
            assert found(near_duplicates(df, NearDup(percent, width))) == want


def test_edge_cases(spark):
    long = "lorem ipsum dolor sit amet " * 20_000
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (6, "one two"), (7, long), (8, long + "x"),
            (9, "Été été été"), (10, "été été été"), (2 ** 40, "a b c d e f g"), (11, "a b c d e f g")]
    df = spark.createDataFrame([(d, t, d, "x") for d, t in rows],
                               "doc_id long, text string, component long, rep string")
    got = found(near_duplicates(df, NearDup(85, 3)))
    assert got == brute(rows, 85, 3)
    assert got[1] == (0, 1) and got[5] == (1, 4) and got[10][1] == 10 and got[2 ** 40][1] == 11
    again = near_duplicates(df.union(df), NearDup(85, 3))
    assert again.count() == 2 * len(rows) and found(again) == got
    kept = drop_near_duplicates(df, NearDup(85, 3))
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, (_, c) in got.items() if c == d)


def test_empty_table_and_null_ids(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).count() == 0 and drop_near_duplicates(df).count() == 0
    one = spark.createDataFrame([(None, "a b"), (1, "a b")], "doc_id long, text string")
    assert found(near_duplicates(one)) == {1: (1, 1)}
    assert drop_near_duplicates(one).count() == 2


def test_components_of_a_chain_a_star_and_loops(spark):
    chain = [(i, i + 1) for i in range(1000, 1040)]
    star = [(7, i) for i in range(2000, 2300)]
    edges = spark.createDataFrame(chain + star + [(5, 5), (9, 3), (3, 9), (9, 4)], "u long, v long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 1000 for i in range(1000, 1041)}, 7: 7, **{i: 7 for i in range(2000, 2300)}, 3: 3, 9: 3, 4: 3}
