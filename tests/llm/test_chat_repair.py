import collections
import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from sheaf.llm import chat_repair as cr
from sheaf.llm.queries import op12_chat_repair
from sheaf.llm.role_paths import MUST_GO, Paths, Prices, symbol

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
LEGAL = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit, roles and texts) over every edit; rows of (role, text, must go, truncated)."""
    @lru_cache(None)
    def best(i, made):  # made: what the pattern has so far, "" or s or u or a
        options = [(0, "", ())] if i == len(rows) and made in ("", "a") else []
        for to in "ua":
            if (to == "u") == (made != "u"):
                if len(options) < 9 and inserted[0] < 3:
                    inserted[0] += 1
                    cost, audit, out = best(i, to)
                    inserted[0] -= 1
                    options.append((cost + 5, "I" + audit, ((("user" if to == "u" else "assistant"), ""),) + out))
        if i < len(rows):
            role, text, must, truncated = rows[i]
            cost, audit, out = best(i + 1, made)
            options.append((cost + 2, "D" + audit, out))
            if not must:
                for to, edit, price, name in ((role[:1], "K", 0, role), ("u", "R", 1, "user"), ("a", "R", 1, "assistant")):
                    if to and ((to == "s" and made == "") or (to == "u" and made != "u") or (to == "a" and made == "u")):
                        cost, audit, out = best(i + 1, to)
                        options.append((cost + price + 5 * truncated, edit + audit, ((name, text),) + out))
        return min(options) if options else (10**9, "", ())

    inserted = [0]
    # at most three insertions at a place; more never pay
    for i in range(len(rows), -1, -1):
        for made in ("a", "u", "s", ""):
            best(i, made)
    return best(0, "")


def exhaustive(rows):
    """As ``cheapest``, by listing every edit sequence with at most two insertions at a place."""
    places = [()] + [p for n in (1, 2) for p in itertools.product("ua", repeat=n)]
    found = []
    for ins in itertools.product(places, repeat=len(rows) + 1):
        for edits in itertools.product("DKua", repeat=len(rows)):
            cost, audit, made = 0, "", ""
            for i, extra in enumerate(ins):
                cost, audit, made = cost + 5 * len(extra), audit + "I" * len(extra), made + "".join(extra)
                if i < len(rows):
                    role, _, must, truncated = rows[i]
                    e = edits[i]
                    if must and e != "D":
                        break
                    cost += {"D": 2, "K": 0}.get(e, 1) + (5 if truncated and e != "D" else 0)
                    audit += e if e in "DK" else "R"
                    made += "" if e == "D" else role[:1] if e == "K" else e
            else:
                if LEGAL.fullmatch(made):
                    found.append((cost, audit))
    return min(found)


def faults(rows):
    """Rows (turn, role, text) -> fault of each."""
    seen, out = set(), []
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows):
    """Expected result of conversations given as (conv_id, turn, role, text)."""
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        by[c].append((t, r, x))
    out = []
    for c, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        fault = faults(own)
        cost, audit, made = cheapest(tuple((r, x, f in ("blank", "duplicate"), f == "truncated") for (_, r, x), f in zip(own, fault)))
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        text = "\n".join(f"{r}:{x}" for r, x in made)
        out.append((c, gaps, *(fault.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                    hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def random_rows(seed, convs=60, longest=9):
    rng = random.Random(seed)
    text = lambda: rng.choice(["a.", "b", "c!", "", " \t\n", "d?  ", "e.\x0b", "é", None, rng.choice("xyz") * 3 + "."])
    return [(c, rng.choice([None, t, t, t, t, t + 1]), rng.choice(["user", "user", "assistant", "assistant", "system", "tool", None, "us"]), text())
            for c in range(convs) for t in range(rng.randint(1, longest))]


def test_solver_against_every_edit():
    rng, solver = random.Random(3), Paths()
    for _ in range(60):
        rows = [(rng.choice(["s", "u", "a", "o"]), "", rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 3))]
        symbols = [MUST_GO if m else symbol("suao".index(r), t) for r, _, m, t in rows]
        want = exhaustive(rows)
        assert solver.solve(symbols, [1] * len(symbols)) == want
        assert cheapest(tuple((r, x, m, t and not m) for r, x, m, t in rows))[:2] == want


def test_long_runs_equal_rows_one_by_one():
    rng, solver, plain = random.Random(4), Paths(), Paths(Prices(), cached=0)
    for _ in range(60):
        runs = [(rng.randrange(9), rng.choice([1, 2, 3, 7, 64, 65, 1000])) for _ in range(rng.randint(1, 6))]
        symbols, counts = zip(*runs)
        one = [c for c, n in runs for _ in range(n)]
        cost, audit = solver.solve(symbols, counts)
        assert (cost, audit) == plain.solve(one, [1] * len(one))
        assert len(audit.replace("I", "")) == len(one)
    assert solver.solve([symbol(1, False)], [10**6]) == (500_000, "KR" * 500_000)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = random_rows(seed) + [(None, 1, "user", "q."), (None, 2, "assistant", "a."), (None, None, "user", "q.")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", audit string, side int").repartition(5)
    assert got(cr.repair_conversations(df)) == brute(rows)


def test_chunks_and_parts_join_up(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(1, t // 2, rng.choice(["user", "assistant"]), f"{rng.randrange(25)}.") for t in range(60)] + \
        [(1, None, rng.choice(["user", "assistant"]), f"n{rng.randrange(5)}") for _ in range(20)] + random_rows(5, 20)
    monkeypatch.setattr(cr, "CHUNK_TURNS", 4)
    monkeypatch.setattr(cr, "PIECE_RUNS", 2)
    assert got(cr.repair_conversations(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_long_conversation_and_empty(spark):
    n = 30_000
    df = spark.range(n).select(F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"),
                               F.concat(F.col("id").cast("string"), F.lit(".")).alias("text"))
    row = cr.repair_conversations(df, spark.createDataFrame([(7,), (8,), (None,)], "conv_id long")).collect()
    seven = next(r for r in row if r.conv_id == 7)
    assert seven.cost == n // 2 and seven.audit == "KR" * (n // 2) and seven.illegal == n - 1 and seven.gaps == 0
    text = "\n".join(f"{'assistant' if i % 2 else 'user'}:{i}." for i in range(n))
    assert seven.repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()
    none = hashlib.sha256(b"").hexdigest()
    assert sorted((tuple(r) for r in row if r.conv_id != 7), key=str) == sorted(
        [(c, 0, 0, 0, 0, 0, 0, "", none) for c in (8, None)], key=str)
    empty = spark.createDataFrame([], SCHEMA)
    assert cr.repair_conversations(empty).collect() == []


def test_damage(spark):
    rows = [(c, t, r, x) for c in (None, 1, 2, 3) for t in (*range(30), None) for r, x in (("assistant", "a.b!c?d"), (None, None))]
    want = []
    for c, t, r, x in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if h:
            x = "" if h == 1 else "".join(a for a in x if a not in ".!?") if h == 2 else x
            want += [(c, t, "user" if h == 4 else r, x)] * (2 if h == 3 else 1)
    assert sorted((tuple(r) for r in cr.damaged(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == sorted(want, key=str)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in cr.damaged(spark.read.parquet(f"{sf}/conversations.parquet")).collect()]
    ids = {r[0] for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").collect()}
    out = got(op12_chat_repair(spark, sf))
    want = brute(rows)
    assert [r for r in out if r[0] in {w[0] for w in want}] == want and {r[0] for r in out} == ids
