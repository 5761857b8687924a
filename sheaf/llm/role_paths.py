"""Cheapest edits that bring a sequence of rows to the roles ``(s?(ua)+)?``, by run-length dynamic programming.

A row is a symbol: its role's initial and its fault. The pattern's automaton has four states, and a symbol is a 4 x 4
min-plus transition: rows are kept (0), given the next role (1) or deleted (2), turns without text are inserted (5). A run of
one symbol is one step: its costs come from cached binary powers of the transition. Costs to the end, reckoned backwards
over the runs, then let the choices be unrolled forwards, the ASCII-least first. Inside a run the unrolled
choices of a power are joined from those of its halves and cached too, as costs up to a constant recur.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

START, SYSTEM, USER, ASSISTANT = range(4)
"""States: nothing yet; after the system turn; after a user turn; after an assistant turn."""
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant", SYSTEM: "system"}
INITIALS = {"s": 0, "u": 1, "a": 2}
ENTERS = (SYSTEM, USER, ASSISTANT)
MUST_GO = 8
"""Symbol of blank and repeated rows; others are 2 * (initial: s, u, a or 3) + truncated."""
FAR = 1 << 40

Costs = tuple[int, int, int, int]


def symbol(initial: int, truncated: bool) -> int:
    return 2 * initial + truncated


@dataclass(frozen=True)
class Prices:
    """Costs of the edits; ``truncated``: of leaving a truncated row in."""
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def kept(state: int, symbol_: int) -> int | None:
    """The state after keeping a row as it is."""
    initial = symbol_ // 2
    if symbol_ == MUST_GO or initial == 3:
        return None
    to = ENTERS[initial]
    return to if (state == START and to == SYSTEM) or NEXT[state] == to else None


class Paths:
    def __init__(self, prices: Prices = Prices(), cached: int = 200_000):
        self.prices = prices
        self.ends = tuple(self._to_end(s) for s in range(4))
        self.power = lru_cache(maxsize=None)(self._power)
        self.back = lru_cache(cached)(self._back)
        self.advance = lru_cache(cached)(self._advance)
        self.spell_cached = lru_cache(cached)(self._spell)
        self.step = lru_cache(cached)(self._step)

    def _to_end(self, state: int) -> int:
        cost = 0
        while state not in (START, ASSISTANT):
            state, cost = NEXT[state], cost + self.prices.insert
        return cost

    def _row(self, state: int, c: int) -> list[tuple[str, int, int]]:
        """(edit, cost, state after) of one row, without insertions; ASCII order."""
        p = self.prices
        stays = 0 if c == MUST_GO else (c & 1) * p.truncated
        out = [("D", p.delete, state)]
        if (to := kept(state, c)) is not None:
            out.append(("K", stays, to))
        if c != MUST_GO:
            out.append(("R", p.rerole + stays, NEXT[state]))
        return out

    def _power(self, c: int, i: int) -> tuple[tuple[int, ...], ...]:
        """Min-plus transition of 2**i rows of a symbol, insertions before each row included."""
        if i:
            m = self.power(c, i - 1)
            return tuple(tuple(min(FAR, min(m[x][k] + m[k][y] for k in range(4))) for y in range(4)) for x in range(4))
        out = [[FAR] * 4 for _ in range(4)]
        for x in range(4):
            at, paid = x, 0
            for _ in range(4):  # more insertions than states never help
                for _, cost, to in self._row(at, c):
                    out[x][to] = min(out[x][to], paid + cost)
                at, paid = NEXT[at], paid + self.prices.insert
        return tuple(map(tuple, out))

    def _back(self, c: int, i: int, after: Costs) -> tuple[Costs, int]:
        """Costs to the end before 2**i rows, less their minimum, and that minimum."""
        m = self.power(c, i)
        v = [min(m[x][y] + after[y] for y in range(4)) for x in range(4)]
        low = min(v)
        return (v[0] - low, v[1] - low, v[2] - low, v[3] - low), low

    def _advance(self, c: int, n: int, after: Costs) -> tuple[Costs, int]:
        """As ``_back`` for a run of n rows: one cached power a binary digit."""
        total, i = 0, 0
        while n:
            if n & 1:
                after, low = self.back(c, i, after)
                total += low
            n, i = n >> 1, i + 1
        return after, total

    def _step(self, c: int, state: int, after: Costs) -> tuple[str, int]:
        """Edits of one row (insertions before it included) and the state after."""
        before, low = self.back(c, 0, after)
        out = ""
        while True:
            left = before[state] + low
            rows = {e: to for e, cost, to in self._row(state, c) if cost + after[to] == left}
            if "D" in rows:
                return out + "D", rows["D"]
            if self.prices.insert + before[NEXT[state]] + low == left:
                out, state = out + "I", NEXT[state]
                continue
            edit = min(rows)
            return out + edit, rows[edit]

    def _spell(self, c: int, i: int, state: int, after: Costs) -> tuple[str, int]:
        """Edits of 2**i rows of a symbol and the state after."""
        if i == 0:
            return self.step(c, state, after)
        spell = self.spell_cached if i <= 11 else self._spell
        first, state = spell(c, i - 1, state, self.back(c, i - 1, after)[0])
        second, state = spell(c, i - 1, state, after)
        return first + second, state

    def solve(self, symbols, counts) -> tuple[int, str]:
        """(least cost, ASCII-least audit) of the runs (equal neighbours are allowed)."""
        after, total, ahead = self.ends, 0, []
        for c, n in zip(reversed(symbols), reversed(counts)):
            ahead.append(after)
            after, low = self.advance(c, n, after)
            total += low
        total += after[START]
        state, out = START, []
        for c, n in zip(symbols, counts):
            after = ahead.pop()
            while n:
                i = n.bit_length() - 1
                n -= 1 << i
                text, state = self._spell(c, i, state, self.advance(c, n, after)[0]) if i > 11 else \
                    self.spell_cached(c, i, state, self.advance(c, n, after)[0])
                out.append(text)
        while state not in (START, ASSISTANT):
            out.append("I")
            state = NEXT[state]
        return total, "".join(out)
