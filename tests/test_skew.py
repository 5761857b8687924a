"""A job that owns a third of the log: results stay exact and no window task gets the hot job whole."""

import random

from pyspark.sql import functions as F

from helpers import end, lines_df, start
from sheaf.functions.memlog import parse_memlog
from sheaf.operators import leaks
from test_memlog import brute_orphans

PARTITIONS = 64


def _max_share(df, keys):
    """Largest share of rows one hash partition receives when ``df`` is shuffled on ``keys``."""
    loads = (df.groupBy(F.pmod(F.hash(*[F.col(k) for k in keys]), F.lit(PARTITIONS)).alias("p")).count()
             .agg(F.max("count").alias("m"), F.sum("count").alias("n")).first())
    return loads.m / loads.n


def test_hot_job_spreads_and_stays_exact(spark):
    rnd = random.Random(17)
    lines, ents = [], []
    for i in range(6000):
        job = "hot" if i % 3 == 0 else f"j{rnd.randint(0, 200)}"
        sec = rnd.randint(0, 30 * 86400 - 1)
        ts = f"2024-01-{1 + sec // 86400:02d} {sec % 86400 // 3600:02d}:{sec % 3600 // 60:02d}:{sec % 60:02d}"
        kind = "START" if rnd.random() < 0.5 else "END"
        lines.append(start(ts, job) if kind == "START" else end(ts, job))
        ents.append((sec, kind, job, i))
    e = parse_memlog(lines_df(spark, lines))
    se = leaks.with_bucket(e.where(F.col("log_type").isin("START", "END")), 3600)
    # A plain per-job window puts the hot third into one task; the bucketed carry does not.
    assert _max_share(se, ["job_name"]) >= 0.33
    assert _max_share(se, ["job_name", "_tb"]) < 0.05
    got = {(r.job_name, (r.start_time.day - 1) * 86400 + r.start_time.hour * 3600 + r.start_time.minute * 60
            + r.start_time.second) for r in leaks.orphaned_jobs(e).collect()}
    assert got == brute_orphans(ents)


def test_one_huge_conversion_log(spark):
    from sheaf.functions.convlog import parse_convlog
    from sheaf.operators import conversions as cv
    from sheaf.sources.text import lines_from_column
    from test_convlog import fold_loop
    rnd = random.Random(4)
    names = [f"excel_input_{i}.xlsx" for i in range(60)]
    text = []
    for _ in range(3000):
        n = rnd.choice(names)
        k = rnd.random()
        if k < 0.4:
            text.append(f"[Attempt {rnd.randint(1, 2)}/2] Converting {n} ({rnd.randint(1, 9)}.00MB)...")
        elif k < 0.6:
            text.append(f"[LINK_SCAN] file='{rnd.choice([n, n[6:], 'zz'])}' external_links_found=1 link_types=['ole']")
        elif k < 0.8:
            text.append(f"[SUCCESS] excel conversion completed, PDF size: {rnd.randint(1, 9)}.00MB")
        else:
            text.append(f"Converted {n} to PDF ({rnd.randint(1, 9)}.00MB) in 2.0s")
    raw = spark.createDataFrame(list(enumerate(text)), "pos long, line string")
    ev = parse_convlog(lines_from_column(raw, "line", "pos", log_id=F.lit("one-log"), block_size=32))
    # One log: a per-log window is one task (100%). About 94 blocks of 32 lines hash into 64 partitions, so the
    # busiest partition holds a few blocks (a few percent) rather than the log.
    assert _max_share(ev, ["log_id"]) == 1.0 and _max_share(ev, ["log_id", "block"]) < 0.1
    want = fold_loop([r.asDict() for r in ev.orderBy("line_no").collect()])
    got = {r.filename: (r.conversion_successful, r.links_found, r.pdf_size_mb) for r in cv.conversion_records(ev).collect()}
    assert got == {f: (w["ok"], w["links"], w["pdf"]) for f, w in want.items()}


def test_sparse_key_with_a_million_buckets(spark):
    """One key has 10**6 buckets: no window holds 1 % of its rows, and what is carried is right."""
    from sheaf.operators import carry
    n = 10 ** 6
    df = spark.range(n).select(F.lit("hot").alias("k"), (F.col("id") * 3).alias("b"), F.col("id").alias("at"),
                               F.when(F.col("id") % 7 == 0, F.col("id")).alias("v")).unionByName(
        spark.range(50).select(F.lit("cold").alias("k"), (F.col("id") * 60_000).alias("b"), F.col("id").alias("at"), F.col("id").alias("v")))
    sizes = carry.bucket_groups(df.select("k", "b"), "b").groupBy("k", "_g").count()
    assert sizes.agg(F.max("count")).first()[0] <= 0.01 * n and sizes.where("k = 'hot'").count() <= 0.01 * n
    out = carry.carry_last(df, keys=["k"], bucket="b", order=["at"], value=F.col("v"), out="c")
    assert out.where("k = 'hot' and c <> at - at % 7 or k = 'cold' and c <> at or c is null").isEmpty() and out.count() == n + 50
    top = carry.running_max(df, keys=["k"], bucket="b", order=["at"], value=-F.col("v"), out="m", out_prev="p")
    assert top.where("m <> 0 or (at > 0 and p <> 0) or (at = 0 and p is not null) or m is null").isEmpty()


def test_carry_over_null_and_negative_buckets(spark):
    from sheaf.operators import carry
    rnd = random.Random(8)
    rows = [(rnd.choice("ab"), rnd.randrange(-50, 50), i, rnd.choice([None, None, i])) for i in range(400)]
    rows += [("a", None, -1, 77), ("c", None, -1, None), ("c", 5, 0, None)]
    df = spark.createDataFrame([(k, b, i, v) for k, b, i, v in rows], "k string, b long, at long, v long").withColumn(
        "at", F.struct(F.coalesce("b", F.lit(-99)).alias("b"), "at"))
    got = {(r.k, r.b, r["at"]["at"]): r.c for r in carry.carry_last(df, keys=["k"], bucket="b", order=["at"], value=F.col("v"), out="c").collect()}
    last = {}
    for k, b, i, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        last[k] = v if v is not None else last.get(k)
        assert got[k, b, i] == last[k]
