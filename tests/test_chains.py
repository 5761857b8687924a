"""Chains of marks: batch T2 and T3 against plain loops, on dense and sparse runs with any key."""

import random

import pytest
from pyspark.sql import functions as F

from sheaf.operators import chains
from sheaf.operators.timers import memory_spikes_batch, monitor_emissions_batch
from test_streaming import loop_spikes


def loop_monitor(rows, interval):
    out, peak, last = [], None, 0
    for _, seq, t, rss in rows:
        t = round(t * 10 ** 6)
        if peak is None:
            peak = rss
            continue
        new = rss > peak
        peak = max(peak, rss)
        if new or t - last >= interval * 10 ** 6:
            out.append(seq)
            last = t
    return out


def runs(seed, n=700):
    rng = random.Random(seed)
    rows = []
    for run, gaps in enumerate(([1], [0, 0.25, 0.5], [1, 2, 5, 13, 40], [30, 29.75, 30.25], [500, 3000], [1, 1, 1, 1, 9000])):
        t = rng.choice([0.0, 3.5, 1_700_000_000.0])
        for i in range(n):
            t += rng.choice(gaps)
            rows.append((f"job {run}", run * 10_000 + i, t, float(rng.randint(100, 400) + (i * rng.choice([0, 3]) if run % 2 else 0))))
    return rows


@pytest.mark.parametrize("seed, chunk", [(1, 60), (2, 97), (3, 3600)])
def test_monitor_equals_loop(spark, seed, chunk):
    rows = runs(seed)
    df = spark.createDataFrame(rows, "job string, seq long, epoch_s double, rss_mb double").repartition(5)
    got = {}
    for r in monitor_emissions_batch(df, log_interval_s=30, chunk_seconds=chunk, key="job").collect():
        got.setdefault(r.job, []).append((r.seq, r.epoch_s, r.rss_mb, r.peak_rss_mb, r.new_peak))
    for job in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == job), key=lambda r: (r[2], r[1]))
        found = sorted(got.get(job, []), key=lambda r: (r[1], r[0]))
        assert [f[0] for f in found] == loop_monitor(mine, 30), job
        for seq, t, rss, peak, new in found:
            earlier = [r[3] for r in mine if (r[2], r[1]) < (t, seq)]
            assert peak == max([*earlier, rss]) and new == (rss > max(earlier))


@pytest.mark.parametrize("seed, chunk", [(4, 200), (5, 350), (6, 10_000)])
def test_spikes_equal_loop(spark, seed, chunk):
    rng = random.Random(seed)
    rows = []
    for run, (low, high) in enumerate(((0, 300), (0, 5), (40, 60), (95, 130), (-20, 20))):
        level = 0.0
        for i in range(500):
            level += rng.uniform(low, high)
            rows.append((run, i, float(i), level if rng.random() < 0.9 else rng.uniform(0, level or 1)))
    df = spark.createDataFrame([*rows, (7, 1, 1.0, None), (7, 2, 2.0, 150.0)], "run_id long, seq long, epoch_s double, rss_mb double").repartition(5)
    got = {}
    for r in memory_spikes_batch(df, chunk_mb=chunk, bucket_seconds=40).collect():
        got.setdefault(r.run_id, []).append(r.seq)
    for run in range(5):
        assert sorted(got.get(run, [])) == loop_spikes([r for r in rows if r[0] == run], 100.0), run
    assert got[7] == [2]


def test_dense_run_composes_over_groups(spark):
    """A sample a second, no new peak, no gap: every chunk depends on the one before, through groups of chunks."""
    n = 40_000
    df = spark.range(n).select(F.lit("hot").alias("run_id"), F.col("id").alias("seq"), (F.col("id") + 1_000_000).alias("epoch_s"),
                               F.when(F.col("id") == 0, 900.0).otherwise(100.0).alias("rss_mb"))
    got = sorted(r.seq for r in monitor_emissions_batch(df, log_interval_s=7, chunk_seconds=20).collect())
    assert got == list(range(1, n, 7))


def test_summaries_compose(spark):
    rng = random.Random(3)
    chain = chains.Chain(10, 25)
    for _ in range(200):
        xs, x = [], rng.uniform(0, 9)
        while x < 400:
            xs.append(x)
            x += rng.uniform(0.1, 9.9)
        parts = [chains.summarised([x for x in xs if x // 25 == c], [False] * sum(x // 25 == c for x in xs), chain) for c in range(16)]
        last = want = rng.uniform(-9, 0)
        for x in xs:
            if chain.beyond(x, want):
                want = x
        cut = rng.randrange(1, 16)
        for part in (chains.composed(parts[:cut], chain), chains.composed(parts[cut:], chain)):
            last = chains.passed(part, chain, last)
        assert last == want
    with pytest.raises(ValueError):
        chains.Chain(10, 19)
