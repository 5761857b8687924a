"""Names inside names by the index of rare grams, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from sheaf.operators import containment as ct
from sheaf.operators import conversions as cv

SCHEMA = "log_id string, name string, is_conv boolean, created long"


def brute(rows):
    return sorted((g, a, b, sa, ca, cb) for g, a, sa, ca in rows for h, b, sb, cb in rows
                  if g is not None and g == h and sa != sb and a and b and a in b)


def got(spark, rows, gram):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = ct.contained_names(df, ["log_id"], "name", "is_conv", ["created"], gram)
    return sorted(tuple(r) for r in out.select("log_id", "inner", "outer", "inner_side", "inner_created", "outer_created").collect())


@pytest.mark.parametrize("gram", [2, 4, 6])
def test_equals_all_pairs(spark, gram):
    rng = random.Random(gram)
    name = lambda: "".join(rng.choice("ab_é") for _ in range(rng.choice([1, 2, 3, 5, 6, 9, 14])))
    rows = {(f"log{rng.randrange(3)}", name(), rng.random() < 0.5): rng.randrange(99) for _ in range(160)}
    rows = [(g, n, s, c) for (g, n, s), c in rows.items()] + [("log0", None, True, 1), ("log0", "", False, 2), (None, "ab", True, 3)]
    assert got(spark, rows, gram) == brute(rows)


def test_long_names(spark):
    """Names of 400 characters that differ in a few places, and pieces of them."""
    rng = random.Random(2)
    base = "".join(rng.choice("abcdefghij") for _ in range(400))
    rows = []
    for i in range(40):
        k = rng.randrange(380)
        whole = base[:k] + f"{i:04d}" + base[k + 4:]
        rows.append(("log", whole, True, i))
        j = rng.randrange(300)
        rows.append(("log", whole[j:j + rng.choice([3, 8, 60, 100])], False, None))
    rows.append(("log", base + rows[0][1] + base, False, None))
    rows = list({r[:3]: r for r in rows}.values())
    assert sorted(x[:4] for x in got(spark, rows, 6)) == sorted(x[:4] for x in brute(rows))
    # a name probes with a row per character, not per pair of character and length
    df = spark.createDataFrame(rows, SCHEMA)
    probes = df.select(F.explode(ct.substrings(F.col("name"), F.lit(6)))).count()
    assert probes <= sum(len(r[1]) for r in rows)


def test_first_created_match_of_a_scan_name(spark):
    convs = spark.createDataFrame([("a", "excel_input_x.xlsx", (0, 5)), ("a", "x.xlsx", (0, 3)), ("b", "x.xlsx", (0, 1))],
                                  "log_id string, filename string, created struct<block:long,line_no:long>")
    scans = spark.createDataFrame([("a", "x.xlsx"), ("a", "t_x"), ("a", "zz x.xlsx zz"), ("a", "none"), ("b", "x")], "log_id string, scan_name string")
    assert sorted((r.log_id, r.scan_name, r.cand) for r in cv.scan_matches(convs, scans).collect()) == [
        ("a", "t_x", "excel_input_x.xlsx"), ("a", "x.xlsx", "x.xlsx"), ("a", "zz x.xlsx zz", "x.xlsx"), ("b", "x", "x.xlsx")]
