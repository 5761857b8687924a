import math
import random
import zlib

import numpy as np
import pytest

from sheaf.llm import quality_classifier as qc
from sheaf.llm import quality_rules as qr


def corpus(n, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for d in range(n):
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(60, 150))]
        kind = rng.random()
        if kind < 0.15:
            w = [x + rng.choice(["###", "&&&"]) for x in w]
        elif kind < 0.3:
            w = [x.upper() + "!!" for x in w]
        rows.append((d, ". ".join(" ".join(w[i:i + 12]) for i in range(0, len(w), 12))))
        labels.append((d, int((kind >= 0.3) != (rng.random() < 0.02))))
    return rows, labels


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(d, t, "x", 0.5) for d, t in rows], "doc_id long, text string, n_words string, score double")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int")


def test_rules_and_scores_on_held_out_rows(spark):
    rows, labels = corpus(800)
    docs, lab = frames(spark, rows, labels)
    truth = {d: int("#" not in t and "&" not in t and t.upper() != t) for d, t in rows}
    out, rules = qr.quality_rules(docs, lab)
    got = {r.doc_id: r for r in out.collect()}
    assert rules and np.mean([r.kept == bool(truth[d]) for d, r in got.items()]) > 0.97
    scored = {r.doc_id: r for r in qc.quality_scores(docs, lab)[0].collect()}
    held = [d for d, r in scored.items() if r.held_out]
    assert sorted(held) == [d for d, _ in rows if zlib.crc32(str(d).encode()) % 5 == 0]
    assert np.mean([scored[d].predicted == truth[d] for d in held]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored.values())
    turned = spark.createDataFrame([(d, 1 - q if d in set(held) else q) for d, q in labels], "doc_id long, quality int")
    assert {r.doc_id: r.score for r in qc.quality_scores(docs, turned)[0].collect()} == {d: r.score for d, r in scored.items()}


@pytest.mark.parametrize("labelled", [0, 1])
def test_edge_cases(spark, labelled):
    rows, labels = corpus(60)
    odd = [(100, None), (101, ""), (102, " \n"), (103, "x " * 100_000), (104, "x"), (104, "x"), (None, "a b")]
    docs, lab = frames(spark, rows + odd, labels * labelled + [(None, 1), (3, None)])
    out = [r for r in qr.quality_rules(docs, lab)[0].collect()]
    assert len(out) == 67
    got = {r.doc_id: r for r in out}
    assert all(got[d].base_failed and not got[d].kept for d in (100, 101, 102, 103, 104, None))
    assert got[100].n_words == 0 and got[103].n_repeat_words == 100_000
    scored = qc.quality_scores(docs, lab)[0].collect()
    assert len(scored) == 67 and all(0 <= r.score <= 1 for r in scored)
    assert qr.quality_rules(docs.limit(0), lab)[0].count() == 0 and qc.quality_scores(docs.limit(0), lab)[0].count() == 0


def test_one_label_only():
    rows = {"symbols_per_word": np.arange(5.0)}
    good = qc.fit(rows, np.ones(5, bool))
    assert good.terms == () and good.threshold < 0
    assert qc.fit(rows, np.zeros(5, bool)).threshold > 0
    assert qr.learn(rows, np.zeros(5, bool)) == []


def test_ranking_gradient_and_threshold_by_plain_loops():
    """The fitted weights are a minimum of the pair loss over the same pairs, and no cut of the scores makes fewer errors."""
    from sheaf.llm.quality_classifier import Ranking, fit
    rng = np.random.default_rng(5)
    n = 400
    good = rng.random(n) < 0.6
    rows = {"a": rng.gamma(2, 3, n) + 4 * good, "b": rng.gamma(2, 2, n)}
    params = Ranking(pairs=3000, knots=2)
    model = fit(rows, good, params)
    value = lambda w, i: sum(x * max(0.0, math.log1p(rows[name][i]) - knot) for (name, knot, _), x in zip(model.terms, w))
    pick = np.random.default_rng(0)
    plus, minus = pick.choice(np.flatnonzero(good), params.pairs), pick.choice(np.flatnonzero(~good), params.pairs)
    spread = [np.maximum(np.log1p(rows[name]) - knot, 0).std() for name, knot, _ in model.terms]
    weights = [w for _, _, w in model.terms]

    def loss(w):
        scores = [value(w, i) for i in range(n)]
        pairs = sum(math.log1p(math.exp(-(scores[i] - scores[j]))) for i, j in zip(plus, minus)) / params.pairs
        return pairs + params.ridge * sum((x * s) ** 2 for x, s in zip(w, spread)) / 2
    least = loss(weights)
    for k in range(len(weights)):
        for step in (-0.02, 0.02):
            moved = list(weights)
            moved[k] += step
            assert loss(moved) > least
    scores = [value(weights, i) for i in range(n)]
    wrong = lambda cut: sum((s >= cut) != g for s, g in zip(scores, good))
    assert wrong(model.threshold) == min(wrong(c) for c in [*scores, max(scores) + 1])


def test_first_condition_by_trying_all():
    """With few values every cut is tried: the grown condition gains as much as the best of all."""
    from sheaf.llm import quality_rules as qr
    rng = np.random.default_rng(8)
    for _ in range(20):
        n = 120
        rows = {k: rng.integers(0, 9, n).astype(float) for k in "xyz"}
        bad = (rows["x"] > 5) & (rng.random(n) < 0.8) | (rng.random(n) < 0.1)
        params = qr.Learning(conditions=1, support=4)
        p, total = int(bad.sum()), n

        def gain(name, above, cut, rows=rows, bad=bad, p=p, total=total):
            inside = rows[name] > cut if above else rows[name] <= cut
            p1, t1 = int((inside & bad).sum()), int(inside.sum())
            return p1 * (math.log2(p1 / t1) - math.log2(p / total)) if p1 >= 4 else 0.0
        best = max(gain(k, above, c + 0.5) for k in rows for above in (False, True) for c in range(8))
        rule = qr._grow(rows, bad, params)
        assert len(rule) == (best > 1e-9)
        if rule:
            inside = rule[0].holds(rows)
            p1, t1 = int((inside & bad).sum()), int(inside.sum())
            assert abs(p1 * (math.log2(p1 / t1) - math.log2(p / total)) - best) < 1e-9


def test_all_labelled_rows_are_learned_from(spark):
    """More rows than any sample once held: those with the other label come last by the hash that used to pick it."""
    from pyspark.sql import functions as F

    from sheaf.llm.textstats import held_out
    ids = spark.range(26_500).select(F.col("id").alias("doc_id"), held_out().alias("held"), F.xxhash64("id").alias("h")).collect()
    learned = sorted((r.h, r.doc_id) for r in ids if not r.held)
    last = {d for _, d in learned[20_000:]}
    assert len(last) > 500
    docs = spark.createDataFrame([(r.doc_id, "## $$ ##" if r.doc_id in last else "some plain words") for r in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(r.doc_id, int(r.doc_id not in last)) for r in ids], "doc_id long, quality int")
    out, model = qc.quality_scores(docs, labels)
    assert model.terms
    assert {(r.doc_id in last, r.predicted) for r in out.where("not held_out").collect()} == {(True, 0), (False, 1)}


def test_learned_weights_and_threshold_by_plain_loops(spark):
    """With blocks of few rows and a rare label: each row has its pairs, the weights are a minimum, no cut makes fewer errors."""
    rng = np.random.default_rng(6)
    n, names = 300, sorted(qc.columns())
    good = rng.random(n) < 0.9
    x = rng.gamma(2, 0.5, (n, len(names))) + good[:, None] * rng.random(len(names))
    x[:, 3] = 0.5
    rows = spark.createDataFrame([(i, int(g), r) for i, (g, r) in enumerate(zip(good, x.tolist()))], "doc_id long, label int, x array<double>")
    params = qc.Ranking(knots=2, block=40, panel=6)
    model = qc.learn(rows, params)
    assert model.terms and not any(name == names[3] for name, _, _ in model.terms)
    blocks = {}
    for r in qc._blocks(rows, int(good.sum()), int((~good).sum()), params).collect():
        blocks.setdefault(r.block, []).append(r)
    assert len(blocks) == 8 and sum(r.first for b in blocks.values() for r in b) == n
    hinges = lambda v: np.stack([np.maximum(np.asarray(v)[:, names.index(name)] - knot, 0) for name, knot, _ in model.terms], 1)
    spread, diffs = hinges(x).std(0), []
    for b in blocks.values():
        label = np.array([r.label == 1 for r in b])
        assert 0 < label.sum() < len(label)
        diffs += list(qc.block_pairs_of(hinges([r.x for r in b]), label, params.rounds))
    diffs = np.concatenate(diffs)
    loss = lambda w: np.logaddexp(0, -diffs @ w).mean() + params.ridge * ((w * spread) ** 2).sum() / 2
    weights = np.array([w for _, _, w in model.terms])
    for k in range(len(weights)):
        for step in (-0.02, 0.02):
            assert loss(weights + step * (np.arange(len(weights)) == k)) > loss(weights)
    scores = hinges(x) @ weights
    wrong = lambda cut: sum((s >= cut) != g for s, g in zip(scores, good))
    assert wrong(model.threshold) == min(wrong(c) for c in [*scores, max(scores) + 1])


def test_pairs_leave_no_row_out():
    for g, p in ((1, 1), (1, 7), (5, 3), (8, 8)):
        x = np.eye(g + p)
        for a in qc.block_pairs_of(x, np.arange(g + p) < g, 4):
            assert (a != 0).any(0).all() and len(a) == max(g, p)


@pytest.mark.parametrize("rows, want", [
    ([(1.0, 0), (2.0, 1)], 1.5), ([(1.0, 1), (2.0, 0)], 0.0), ([(1.0, 0), (2.0, 0), (3.0, 1), (4.0, 0)], 2.5),
    ([(1.0, 0)] * 3 + [(1.0, 1)], 2.0), ([(float(i), int(i > 40)) for i in range(90)], 40.5)])
def test_best_threshold(spark, rows, want):
    good = sum(y for _, y in rows)
    assert qc.best_threshold(spark.createDataFrame(rows, "s double, label int").repartition(7), good, len(rows) - good) == want
