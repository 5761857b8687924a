"""A two-state linear-chain conditional random field over word chains, in arrays.

With two states the forward and backward vectors reduce to odds, so a step of all chains at
once is one fraction. Chains are ordered by length, and each step touches only those that
are still running.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Chains:
    """Consecutive chains of a token array: ``start`` and ``length`` of each (no empty ones).

    ``order`` lists the tokens step by step, longest chains first; step ``t`` has the entries
    ``step[t]`` to ``step[t + 1]``.
    """
    start: np.ndarray
    length: np.ndarray

    def __post_init__(self):
        by_length = np.argsort(-self.length, kind="stable")
        longest = int(self.length[by_length[0]]) if len(by_length) else 0
        running = np.searchsorted(-self.length[by_length], -np.arange(longest), "left")
        self.step = np.concatenate([[0], np.cumsum(running)]).astype(np.int64)
        rank = np.empty(len(by_length), np.int64)
        rank[by_length] = np.arange(len(by_length))
        within = np.arange(int(self.length.sum())) - np.repeat(self.start - (self.start[0] if len(self.start) else 0),
                                                               self.length)
        self.order = np.empty(len(within), np.int64)
        self.order[self.step[within] + np.repeat(rank, self.length)] = np.arange(len(within))


def odds(emission: np.ndarray, transition: np.ndarray, chains: Chains) -> tuple[np.ndarray, np.ndarray]:
    """Forward odds (with the token's own emission) and backward odds of state 1 for every token.

    ``emission``: factor of state 1 over state 0; ``transition[i, j]``: factor of i followed by j.
    """
    t00, t01, t10, t11 = transition.ravel()
    x, step = emission[chains.order], chains.step
    f, b = np.empty(len(x)), np.ones(len(x))
    for t in range(len(step) - 1):
        lo, hi = step[t], step[t + 1]
        if t:
            r = f[step[t - 1]: step[t - 1] + hi - lo]
            f[lo:hi] = x[lo:hi] * (t01 + r * t11) / (t00 + r * t10)
        else:
            f[lo:hi] = x[lo:hi]
    for t in range(len(step) - 3, -1, -1):
        lo, hi = step[t + 1], step[t + 2]
        y = x[lo:hi] * b[lo:hi]
        b[step[t]: step[t] + hi - lo] = (t10 + y * t11) / (t00 + y * t01)
    forward, backward = np.empty(len(x)), np.empty(len(x))
    forward[chains.order], backward[chains.order] = f, b
    return forward, backward


def marginals(emission: np.ndarray, transition: np.ndarray, chains: Chains) -> np.ndarray:
    """Probability of state 1 for every token."""
    forward, backward = odds(emission, transition, chains)
    x = forward * backward
    return x / (1 + x)


def train(word: np.ndarray, label: np.ndarray, chains: Chains, words: int, ridge: float = 0.05,
          steps: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Weights per word and a 2x2 log-transition table from labelled tokens.

    A token's score is a bias that all share plus its word's own weight; the returned weights have the
    bias added. Minimises the negative conditional log-likelihood plus ``ridge/2`` times the squared own weights by
    sign-adaptive full-batch steps; the gradient is expected less observed counts from
    forward-backward. Reruns agree.
    """
    theta = np.zeros(words + 5)
    step, before = np.full(len(theta), 0.5), np.zeros(len(theta))
    inner = np.ones(len(word), bool)
    inner[chains.start] = False
    nxt = np.flatnonzero(inner)
    seen = np.bincount(word, label, words)
    pairs = np.bincount(label[nxt - 1].astype(np.int64) * 2 + label[nxt], minlength=4).astype(float)
    for _ in range(steps):
        transition = np.exp(theta[words + 1:]).reshape(2, 2)
        emission = np.exp(theta[:words] + theta[words])[word]
        forward, backward = odds(emission, transition, chains)
        p = forward * backward
        p /= 1 + p
        a, b = forward[nxt - 1], emission[nxt] * backward[nxt]
        whole = transition[0, 0] + transition[0, 1] * b + a * (transition[1, 0] + transition[1, 1] * b)
        from_one = a / whole
        both = np.array([(1 / whole).sum(), (b / whole).sum(), from_one.sum(), (from_one * b).sum()])
        joint = transition.ravel() * both
        own = np.bincount(word, p, words) - seen
        gradient = np.concatenate([own + ridge * theta[:words], [own.sum()], joint - pairs])
        turn = np.sign(gradient) * np.sign(before)
        step = np.clip(np.where(turn > 0, step * 1.2, np.where(turn < 0, step * 0.5, step)), 1e-4, 2.0)
        before = np.where(turn < 0, 0, gradient)
        theta -= np.sign(before) * step
        theta = np.clip(theta, -20, 20)
    return theta[:words] + theta[words], theta[words + 1:].reshape(2, 2)
