import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sheaf.llm.oracles import ORACLES
from sheaf.llm.queries import op11_exact_top_k
from sheaf.llm.vector_search import VaFile, top_k

SCHEMA = "vec_id long, embedding array<float>, label int, qid long, vec string"


def brute(rows, k, every=50):
    """(query_id, rank, vec_id, score) over different (id, scaled vector) rows."""
    kept = set()
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.add((i, tuple(math.floor(256 * x) for x in v)))
    out = []
    for q, x in kept:
        if q % every == 0:
            near = sorted((-sum(a * b for a, b in zip(x, y)), c) for c, y in kept if c != q and len(y) == len(x))
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(near[:k])]
    return sorted(out)


def single(x):
    import struct
    return struct.unpack("f", struct.pack("f", x))[0]


def vectors(seed, n=400, dim=6, step=None):
    rng = random.Random(seed)
    one = lambda: [single(round(rng.gauss(0, 0.3) * step) / step if step else rng.gauss(0, 0.3)) for _ in range(dim)]
    common, rows = one(), []
    for i in range(n):
        rows.append((i, list(common) if i % 3 == 1 else one()))
    return rows


def run(spark, rows, params=VaFile(), parts=5):
    df = spark.createDataFrame([(i, v, 1, 7, "x") for i, v in rows], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in top_k(df, df.where(F.col("vec_id") % 50 == 0), params=params).collect())


@pytest.mark.parametrize("params", [VaFile(), VaFile(k=3, bits=2, query_rows=3, stripe_rows=(40, 90), scores=50, first=1),
                                    VaFile(k=7, bits=4, tail=0.1, scores=1)])
def test_equals_all_pairs(spark, params):
    rows = vectors(1) + vectors(2, 60, 6, step=4) + [(i, v) for i, v in vectors(3, 120, 3)]
    assert run(spark, rows, params) == brute(rows, params.k)


def test_nulls_copies_ties_and_outliers(spark):
    rows = vectors(5, 150, 4, step=2)
    rows += [(200, None), (250, [None, 1.0, 1.0, 1.0]), (300, [float("nan")] * 4), (350, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4)]
    rows += [(400, []), (401, []), (450, [single(1e30), 0.0, single(-1e30), 0.5]), (451, [1e6, -1e6, 3e5, 0.25])]
    rows += [(0, rows[0][1]), (0, [9.0, 9.0, 9.0, 9.0]), (3, rows[0][1]), (500, [-0.0, 0.0, 0.0, 0.0])]
    got = run(spark, rows)
    want = [(q, r, c, min(max(s, -2**63), 2**63 - 1)) for q, r, c, s in brute(rows, 5)]
    assert [g for g in got if g[0] != 450] == [w for w in want if w[0] != 450]
    assert [g[3] for g in got if g[0] == 450] == [w[3] for w in want if w[0] == 450]
    assert {g[0] for g in got if g[0] == 400} == {400} and len([g for g in got if g[0] == 400]) == 1


def test_fewer_candidates_and_empty(spark):
    assert run(spark, [(50, [1.0, 2.0]), (51, [0.5, 0.5])]) == [(50, 1, 51, 128 * 256 + 128 * 512)]
    assert run(spark, [(50, [1.0, 2.0])]) == [] and run(spark, [(51, [1.0, 2.0])]) == []
    df = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert top_k(df, df).collect() == []
    wide = spark.createDataFrame([(0, [0.1, 1e-9]), (1, [0.3, -0.1])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in top_k(wide, wide).collect()] == [(0, 1, 1, 25 * 76), (1, 1, 0, 25 * 76)]


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{sf}/embeddings.parquet')")
    want = sorted(con.execute(ORACLES["op11_exact_top_k"]).fetchall())
    assert sorted(tuple(r) for r in op11_exact_top_k(spark, sf).select("query_id", "rank", "vec_id", "score").collect()) == want
