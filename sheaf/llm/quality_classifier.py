"""Quality scores by Bradley-Terry pairwise ranking.

A good and a poor labelled document make a preference pair; the score is linear in the
documents' features, and logistic loss on the feature differences of the pairs is minimised
by Newton steps. The decision threshold is a quantile of the scores of the labelled rows: the one
that errs least on them. Reported scores are the logistic of the distance to the threshold, placed so that the
threshold itself is reported as ``cut``.

All labelled rows take part in each step (``learn``). Knots are quantiles of counts on a fine grid. Rows are dealt into
blocks by a hash, a block's good and poor rows are paired in ``rounds`` shifts so that each row has a pair in each, and a
Newton step sums the blocks' losses, gradients and Hessians. The threshold comes from running counts over range partitions of
the scores. The driver gets counts and these sums only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.groups import whole_groups
from sheaf.llm.quality_rules import features
from sheaf.llm.textstats import held_out, labelled_rows, text_stats
from sheaf.session import cut_lineage


@dataclass(frozen=True)
class Ranking:
    """``pairs``: preference pairs that ``fit`` draws; ``knots``: hinges a feature; ``ridge``: penalty on the weights;
    ``cut``: reported score at the threshold; ``rounds``: pairs of each row at least; ``block``: rows of a block, about;
    ``panel``: rows of the rarer label that a block has, about, which for that go to several blocks if they are few;
    ``grid``: cells of a unit of log1p(feature) that knots are counted in."""
    pairs: int = 100_000
    knots: int = 4
    ridge: float = 1e-3
    steps: int = 25
    cut: float = 0.3
    rounds: int = 4
    block: int = 16_384
    panel: int = 64
    grid: int = 4096


@dataclass(frozen=True)
class Model:
    """Score = sum of weight * max(0, log1p(feature) - knot); ``threshold`` and ``scale`` place the logistic."""
    terms: tuple[tuple[str, float, float], ...] = ()
    threshold: float = 0.0
    scale: float = 1.0
    cut: float = 0.3

    def raw(self, logs: dict[str, Column] | None = None) -> Column:
        """``logs``: log1p of the features, by default of those of the row's statistics."""
        logs, out = logs or {k: F.log1p(c) for k, c in columns().items()}, F.lit(0.0)
        for name, knot, weight in self.terms:
            out = out + F.greatest(logs[name] - knot, F.lit(0.0)) * weight
        return out

    def score(self) -> Column:
        shift = float(np.log(self.cut / (1 - self.cut)))
        return 1 / (1 + F.exp(-((self.raw() - self.threshold) * self.scale + shift)))


def columns() -> dict[str, Column]:
    return features() | {"words": F.col("n_words").cast("double"), "lines": F.col("n_lines").cast("double")}


def _one_label(good: int, n: int, params: Ranking) -> Model:
    """Every document scores alike, above the cut if all are good."""
    return Model(threshold=-1.0 if good == n else 1.0, cut=params.cut)


def pair_sums(a: np.ndarray, w: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Number of pairs, and their loss, gradient and Hessian at ``w``; ``a``: feature differences, good minus poor."""
    p = 1 / (1 + np.exp(np.clip(a @ w, -500, 500)))
    return len(a), np.logaddexp(0, -(a @ w)).sum(), -(a * p[:, None]).sum(0), (a * (p * (1 - p))[:, None]).T @ a


def newton(sums: Callable[[np.ndarray], tuple], size: int, params: Ranking) -> np.ndarray:
    """The weights of least mean loss and penalty; ``sums`` as ``pair_sums`` gives them for some weights."""
    def at(w):
        n, loss, gradient, hessian = sums(w)
        return (loss / n + params.ridge * (w @ w) / 2, gradient / n + params.ridge * w,
                hessian / n + params.ridge * np.eye(size))

    w = np.zeros(size)
    now = at(w)
    for _ in range(params.steps):
        step, scale = np.linalg.solve(now[2], now[1]), 1.0
        new = at(w - step)
        while scale > 1e-4 and new[0] > now[0]:
            scale /= 2
            new = at(w - scale * step)
        w, now = w - scale * step, new
        if np.abs(scale * step).max() < 1e-6:
            break
    return w


def fit(rows: dict[str, np.ndarray], good: np.ndarray, params: Ranking = Ranking()) -> Model:
    """``learn`` for few rows in memory, on ``params.pairs`` drawn pairs; the same model with one label only."""
    if not good.any() or good.all():
        return _one_label(int(good.sum()), len(good), params)
    names, columns_, knots = sorted(rows), [], []
    for name in names:
        x = np.log1p(rows[name])
        among = np.concatenate([x[good], np.repeat(x[~good], max(1, int(good.sum() / (~good).sum())))])
        for knot in np.unique(np.quantile(among, np.linspace(0, 1, params.knots + 1)[:-1])):
            column = np.maximum(x - knot, 0)
            if column.std() > 1e-9:
                knots.append((name, float(knot), column.std()))
                columns_.append(column / column.std())
    if not columns_:
        return Model(threshold=-1.0, cut=params.cut)
    m = np.stack(columns_, 1)
    rng = np.random.default_rng(0)
    a = m[rng.choice(np.flatnonzero(good), params.pairs)] - m[rng.choice(np.flatnonzero(~good), params.pairs)]
    w = newton(lambda w: pair_sums(a, w), m.shape[1], params)
    score = m @ w
    order = np.argsort(score, kind="stable")
    ranked = score[order]
    wrong = np.concatenate([[0], np.cumsum(good[order])]) + np.concatenate([np.cumsum((~good[order])[::-1])[::-1], [0]])
    at = np.flatnonzero(np.concatenate([[True], ranked[1:] > ranked[:-1], [True]]))
    k = int(at[np.argmin(wrong[at])])
    threshold = ranked[0] - 1 if k == 0 else ranked[-1] + 1 if k == len(ranked) else (ranked[k - 1] + ranked[k]) / 2
    terms = tuple((n, t, float(x / s)) for (n, t, s), x in zip(knots, w))
    return Model(terms, float(threshold), 1.0, params.cut)


def _knots(rows: DataFrame, names: list[str], good: int, poor: int, params: Ranking) -> list[tuple[str, float]]:
    """Quantiles of each feature, good and poor rows weighing alike, from counts of all rows on the grid."""
    cells = rows.select("label", F.posexplode("x").alias("k", "v")).groupBy(
        "k", F.floor(F.col("v") * params.grid).cast("long").alias("cell")).agg(
        F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("poor")).toArrow()
    k, cell, g, p = (cells.column(c).to_numpy() for c in ("k", "cell", "good", "poor"))
    weight, out = g + p * max(1, good // poor), []
    for i, name in enumerate(names):
        own = np.flatnonzero(k == i)
        own = own[np.argsort(cell[own])]
        upto = np.cumsum(weight[own])
        at = np.searchsorted(upto, np.linspace(0, 1, params.knots + 1)[:-1] * upto[-1], "right")
        out += [(name, float(c) / params.grid) for c in np.unique(cell[own][np.minimum(at, len(own) - 1)])]
    return out


def _blocks(rows: DataFrame, good: int, poor: int, params: Ranking) -> DataFrame:
    """block, first (false for further copies of a row), label, x: sorted by block in their partitions."""
    n, few = good + poor, min(good, poor)
    blocks = -(-n // params.block)
    copies = min(blocks, max(1, -(-params.panel * blocks // few)))
    copy = F.explode(F.when(F.col("label") == int(good <= poor), F.sequence(F.lit(0), F.lit(copies - 1))).otherwise(F.array(F.lit(0))))
    dealt = rows.withColumn("copy", copy).withColumn("block", (F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) + F.col("copy")) % blocks)
    return cut_lineage(dealt.repartition(blocks, "block").sortWithinPartitions("block", F.xxhash64("doc_id", F.lit(1)), "doc_id").select(
        "block", (F.col("copy") == 0).alias("first"), "label", "x"))


def block_pairs_of(x: np.ndarray, good: np.ndarray, rounds: int) -> Iterator[np.ndarray]:
    """Feature differences of the pairs of each round; every row has a pair in each, if there are rows of both labels."""
    plus, minus = x[good], x[~good]
    if len(plus) and len(minus):
        i = np.arange(len(plus) if len(plus) > len(minus) else len(minus))
        for k in range(rounds):
            yield plus[i % len(plus)] - minus[(i + k * max(1, len(minus) // rounds)) % len(minus)]


def learn(rows: DataFrame, params: Ranking = Ranking()) -> Model:
    """A model from all of ``rows``: doc_id, label (0 or 1) and x, log1p of the features in the order of their names.

    With one label only, every document scores alike, above the cut if all are good.
    """
    names = sorted(columns())
    n, good = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    poor = n - good
    if not good or not poor:
        return _one_label(good, n, params)
    found = _knots(rows, names, good, poor, params)
    of, knot = np.array([names.index(name) for name, _ in found]), np.array([t for _, t in found])
    blocks = _blocks(rows, good, poor, params)

    def summed(fn: Callable, sizes: list[int]) -> list[np.ndarray]:
        """Sums over blocks, in their order, of the arrays that ``fn`` makes of a block's hinges, labels and first marks."""
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t, at in whole_groups(batches, ["block"]):
                x = t.column("x").combine_chunks()
                x = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x).flatten().to_numpy().reshape(t.num_rows, len(names))
                label, first = t.column("label").to_numpy() == 1, t.column("first").to_numpy()
                for lo, hi in zip(at[:-1], at[1:]):
                    made = fn(np.maximum(x[lo:hi][:, of] - knot, 0), label[lo:hi], first[lo:hi])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([t.column("block")[int(lo)].as_py()], pa.int64()),
                         pa.array([np.concatenate([np.ravel(m) for m in made])], pa.list_(pa.float64()))], ["block", "sums"])
        parts = sorted(blocks.mapInArrow(run, "block long, sums array<double>").collect())
        total = np.sum([np.array(r["sums"]) for r in parts], 0)
        return np.split(total, np.cumsum(sizes)[:-1])

    m = len(found)
    total, squares = summed(lambda x, label, first: (x[first].sum(0), (x[first] ** 2).sum(0)), [m, m])
    spread = np.sqrt(np.maximum(squares / n - (total / n) ** 2, 0))
    use = np.flatnonzero(spread > 1e-6)
    if not len(use):
        return Model(threshold=-1.0, cut=params.cut)

    def sums(w: np.ndarray) -> tuple:
        def of_block(x, label, first):
            out = [0, 0.0, np.zeros(len(use)), np.zeros((len(use), len(use)))]
            for a in block_pairs_of(x[:, use] / spread[use], label, params.rounds):
                out = [s + t for s, t in zip(out, pair_sums(a, w))]
            return out
        pairs, loss, gradient, hessian = summed(of_block, [1, 1, len(use), len(use) ** 2])
        return float(pairs[0]), float(loss[0]), gradient, hessian.reshape(len(use), -1)

    w = newton(sums, len(use), params)
    model = Model(tuple((*found[i], float(x / spread[i])) for i, x in zip(use, w)), 0.0, 1.0, params.cut)
    scored = rows.select(model.raw({name: F.col("x")[i] for i, name in enumerate(names)}).alias("s"), "label")
    return replace(model, threshold=best_threshold(scored, good, poor))


def best_threshold(scored: DataFrame, good: int, poor: int) -> float:
    """The least cut that errs on fewest of the rows (s, label): halfway between two scores, or 1 beyond the ends.

    Scores are dealt into ranges; each counts from what the ranges before it hold.
    """
    counts = scored.groupBy("s").agg(F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("poor"))
    counts = cut_lineage(counts.repartitionByRange("s").withColumn("part", F.spark_partition_id()))
    parts = counts.groupBy("part").agg(F.max("s").alias("top"), F.sum("good").alias("good"), F.sum("poor").alias("poor")).collect()
    before, carry = [0, 0, None], []
    for r in sorted(parts, key=lambda r: r["top"]):
        carry.append((r["part"], *before))
        before = [before[0] + r["good"], before[1] + r["poor"], r["top"]]
    carried = F.broadcast(scored.sparkSession.createDataFrame(carry, "part int, good0 long, poor0 long, top0 double"))
    order = Window.partitionBy("part").orderBy("s")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = counts.join(carried, "part").select(
        "s", F.coalesce(F.lag("s").over(order), "top0").alias("below"),
        (F.col("good0") + F.sum("good").over(upto) - F.col("good") + poor
         - F.col("poor0") - F.sum("poor").over(upto) + F.col("poor")).alias("wrong"))
    best = cuts.orderBy("wrong", "s").first()
    if good < best["wrong"]:  # all below the cut
        return before[2] + 1
    return best["s"] - 1 if best["below"] is None else (best["below"] + best["s"]) / 2


def quality_scores(docs: DataFrame, labels: DataFrame, params: Ranking = Ranking()) -> tuple[DataFrame, Model]:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= params.cut), and the model.

    Only the text is scored. ``labels`` has doc_id and quality (1: good); all rows
    outside the held-out fifth are learned from. A null or empty text has a score like any
    other (all its features are 0), repeated rows give repeated rows, ties in the scores fall on the
    same side, an empty table gives no rows.
    """
    stats = cut_lineage(text_stats(docs))
    logs = F.array(*[F.log1p(c) for _, c in sorted(columns().items())])
    # of rows that repeat a doc_id one counts
    rows = stats.select("doc_id", logs.alias("x")).groupBy("doc_id").agg(F.min("x").alias("x"))
    model = learn(cut_lineage(rows.join(labelled_rows(labels, "quality"), "doc_id")), params)
    out = stats.select("doc_id", held_out().alias("held_out"), model.score().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= params.cut).cast("int")), model
