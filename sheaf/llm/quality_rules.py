"""Quality rules as a learned decision list.

Sequential covering: each round grows one conjunction of thresholds on text statistics that
separates rejected (label 0) from good rows, by information gain on two thirds of the labelled
rows, and prunes its last conditions on the other third. A rule that holds up there joins the
list, the rows that it covers go, and the next round starts. The list becomes one ordered
Spark conditional expression over the statistics' columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.textstats import labelled_sample, text_stats
from sheaf.session import cut_lineage


def _rate(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))




def features() -> dict[str, Column]:
    """What conditions may test: rates over the columns of ``text_stats``."""
    return {
        "symbols_per_word": _rate("n_symbols", "n_words"), "repeated_share": _rate("n_repeat_words", "n_words"),
        "duplicate_line_share": _rate("n_dup_lines", "n_lines"), "chars_per_word": _rate("word_chars", "n_words"),
        "adjacent_share": _rate("n_adjacent", "n_words"), "distinct_share": _rate("n_distinct", "n_words"),
        "upper_per_char": _rate("n_upper", "word_chars"), "stops_per_word": _rate("n_stops", "n_words"),
        "marks_per_word": _rate("n_marks", "n_words"), "digits_per_char": _rate("n_digits", "word_chars"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        x = rows[self.feature]
        return x > self.threshold if self.above else x <= self.threshold

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.feature] > self.threshold if self.above else of[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


@dataclass(frozen=True)
class Learning:
    """``sample``: labelled rows at most; ``cuts``: thresholds tried a feature; ``precision``: share of rejected
    rows that a rule needs among the pruning rows it covers; ``support``: rejected rows that it covers at least."""
    sample: int = 20_000
    cuts: int = 64
    conditions: int = 4
    rules: int = 16
    precision: float = 0.8
    support: int = 8


def _covers(rule: Rule, rows: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(rows)
    return out


def _grow(rows: dict[str, np.ndarray], bad: np.ndarray, params: Learning) -> Rule:
    """Adds the condition of highest gain until only rejected rows are covered or no condition gains."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < params.conditions:
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not p or not n:
            break
        best = (1e-9, None, None)
        for name in sorted(rows):
            x = rows[name][inside]
            y = bad[inside]
            order = np.argsort(x, kind="stable")
            x, hits = x[order], np.concatenate([[0], np.cumsum(y[order])])
            at = np.flatnonzero(x[1:] > x[:-1]) + 1
            if len(at) > params.cuts:  # cuts at even steps among all rows and among the rejected ones
                among = at[np.linspace(0, len(at) - 1, params.cuts // 2).astype(int)]
                of_bad = at[np.searchsorted(hits[at], np.linspace(0, p, params.cuts // 2 + 2)[1:-1]).clip(0, len(at) - 1)]
                at = np.unique(np.concatenate([among, of_bad]))
            if not len(at):
                continue
            for above, p1, total in ((False, hits[at], at), (True, p - hits[at], len(x) - at)):
                gain = np.where(p1 >= params.support, p1 * (np.log2(np.maximum(p1, 1) / total) - np.log2(p / (p + n))), 0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], Condition(name, above, float((x[at[k] - 1] + x[at[k]]) / 2)), None)
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(rows)
    return tuple(rule)


def _prune(rule: Rule, rows: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The shortest beginning of the rule that is worth most on rows it was not grown on."""
    def worth(r: Rule) -> float:
        inside = _covers(r, rows, len(bad))
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0
    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (round(worth(r), 9), -len(r)), default=())


def learn(rows: dict[str, np.ndarray], bad: np.ndarray, params: Learning = Learning()) -> list[Rule]:
    """Ordered rules that reject; no rows, or no rejected ones, give no rules. Reruns agree."""
    rules: list[Rule] = []
    part = np.arange(len(bad)) % 3 == 2
    live = np.ones(len(bad), bool)
    while len(rules) < params.rules:
        grow, prune = live & ~part, live & part
        rule = _grow({k: x[grow] for k, x in rows.items()}, bad[grow], params)
        rule = _prune(rule, {k: x[prune] for k, x in rows.items()}, bad[prune])
        inside = _covers(rule, rows, len(bad)) & live if rule else np.zeros(len(bad), bool)
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        checked = int((inside & part).sum())
        if p < params.support or p < params.precision * (p + n) or \
                (inside & part & bad).sum() < params.precision * checked:
            break
        rules.append(rule)
        live &= ~inside
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Ordered conditional: false where a rule of the list holds, else true."""
    of, out = features(), None
    for rule in rules:
        test = rule[0].column(of)
        for c in rule[1:]:
            test = test & c.column(of)
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def quality_rules(docs: DataFrame, labels: DataFrame, params: Learning = Learning()) -> tuple[DataFrame, list[Rule]]:
    """``text_stats`` of every document with ``base_failed`` and ``kept``, and the learned rules.

    base_failed: under 50 words, or more than half of the words in repeated 3-word windows.
    kept: false if base_failed, else the list's verdict. ``labels`` has doc_id and quality (0: reject); the
    list is learned from at most ``params.sample`` labelled rows that do not fail the base, none
    of them of the held-out fifth. A null or empty text has no words and fails the base; repeated
    rows give repeated rows (one counts for learning); an empty table gives no rows and no rules.
    """
    stats = cut_lineage(text_stats(docs))
    stats = stats.withColumn("base_failed", (F.col("n_words") < 50) |
                             (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    sample = labelled_sample(labels, "quality", params.sample)
    picked = stats.where("not base_failed").join(F.broadcast(sample), "doc_id").select(
        "doc_id", "label", *[c.alias(k) for k, c in features().items()]).dropDuplicates(["doc_id"]).toPandas()
    picked = picked.sort_values("doc_id")
    rows = {k: picked[k].to_numpy(float) for k in features()}
    rules = learn(rows, picked["label"].to_numpy() == 0, params)
    return stats.withColumn("kept", ~F.col("base_failed") & verdict(rules)), rules
