"""Bin completion over a histogram of lengths.

Only how often each length occurs matters, so an instance has at most ``capacity`` rows
whatever the number of documents. A *pattern* (one filling) is applied to as many bins as the
counts allow at once.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

Pattern = tuple[tuple[int, ...], int]
"""Lengths in a bin, largest first, and the number of such bins."""


@dataclass(frozen=True)
class Limits:
    """``width``: fillings tried at a node; ``nodes``: nodes that the search opens at most; ``steps``: extensions of
    a filling that a node tries; ``items``: pieces that are added one by one; where more fit, the filling is a subset sum
    of least waste, of any number of pieces."""
    width: int = 6
    nodes: int = 4_000
    steps: int = 300
    items: int = 5


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing: each bin is opened by the largest length and takes the largest that still fits."""
    left = {k: n for k, n in counts.items() if n > 0}
    order = sorted(left)
    out: list[Pattern] = []
    while order:
        filling, room, used = [], capacity, {}
        k = len(order)
        while k:
            size = order[k - 1]
            if size <= room and used.get(size, 0) < left[size]:
                used[size] = used.get(size, 0) + 1
                filling.append(size)
                room -= size
            if size > room or used.get(size, 0) >= left[size]:
                k = min(k - 1, bisect_right(order, room)) if room else 0
        times = min(left[s] // n for s, n in used.items())
        out.append((tuple(filling), times))
        _take(left, order, used, times)
    return out


def _take(left: dict[int, int], order: list[int], used: dict[int, int], times: int) -> None:
    for s, n in used.items():
        left[s] -= n * times
        if not left[s]:
            del left[s]
            del order[bisect_right(order, s) - 1]


def bins(patterns: list[Pattern]) -> int:
    return sum(n for _, n in patterns)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: the total volume, and for each length ``a`` the large pieces that
    cannot meet one of at least ``a``, plus what the medium ones leave no room for."""
    number, volume = [0] * (capacity + 2), [0] * (capacity + 2)
    for k in range(capacity, -1, -1):
        n = counts.get(k, 0)
        number[k], volume[k] = number[k + 1] + n, volume[k + 1] + k * n
    half = capacity // 2 + 1
    best = -(-volume[0] // capacity)
    for a in range(capacity - half + 2):
        big = capacity - a + 1
        medium = number[half] - number[big]
        spare = medium * capacity - (volume[half] - volume[big])
        best = max(best, number[half] + max(0, -(-(volume[a] - volume[half] - spare) // capacity)))
    return best


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the pieces of filling ``b`` fit, in groups, into the pieces of ``a`` (largest first)."""
    def fits(rest: tuple[int, ...], rooms: tuple[int, ...]) -> bool:
        if not rest:
            return True
        tried = set()
        for i, room in enumerate(rooms):
            if room >= rest[0] and room not in tried:
                tried.add(room)
                if fits(rest[1:], (*rooms[:i], room - rest[0], *rooms[i + 1:])):
                    return True
        return False
    return sum(a) >= sum(b) and fits(b, a)


def _sums(order: list[int], left: dict[int, int], room: int) -> list[int]:
    """Bit sets of the sums up to ``room`` that the first 0, 1, 2, ... lengths of ``order`` reach with the pieces at hand."""
    out, mask = [1], (1 << (room + 1)) - 1
    for size in order[:bisect_right(order, room)]:
        reach, open_, step = out[-1], min(left[size], room // size), 1
        while open_:
            n = min(step, open_)
            reach |= (reach << (size * n)) & mask
            open_, step = open_ - n, 2 * step
        out.append(reach)
    return out


def _filling_of(target: int, order: list[int], left: dict[int, int], reach: list[int]) -> tuple[int, ...]:
    """The filling of sum ``target`` that takes as many of the largest pieces as it can, then of the next ones."""
    out: list[int] = []
    for i in range(len(reach) - 1, 0, -1):
        size = order[i - 1]
        n = min(left[size], target // size)
        while not reach[i - 1] >> (target - n * size) & 1:
            n -= 1
        out += [size] * n
        target -= n * size
    return tuple(out)


def least_waste(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Each bin is opened by the largest length and filled by a subset sum of least waste."""
    left = {k: n for k, n in counts.items() if n > 0}
    order = sorted(left)
    out: list[Pattern] = []
    while order:
        top = order[-1]
        left[top] -= 1
        reach = _sums(order, left, capacity - top)
        filling = (top, *_filling_of(reach[-1].bit_length() - 1, order, left, reach))
        left[top] += 1
        used = {s: filling.count(s) for s in set(filling)}
        times = min(left[s] // n for s, n in used.items())
        out.append((filling, times))
        _take(left, order, used, times)
    return out


def fillings(order: list[int], left: dict[int, int], room: int, waste: int, limits: Limits) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room`` by the lengths at hand that waste at most ``waste``, least waste first.

    Where the smallest length does not fit, the empty filling is the only one. A single piece
    that fills the room dominates every other filling. Where the steps or ``limits.items`` end a filling that
    could still grow, fillings of the largest reachable sums stand for it.
    """
    if room in left:
        return [(room,)]
    if not order or order[0] > room:
        return [()] if room <= waste else []
    found: list[tuple[int, tuple[int, ...]]] = []
    budget = [limits.steps]
    least = [room]
    cut = [False]

    def grow(filling: tuple[int, ...], space: int, top: int) -> None:
        budget[0] -= 1
        k = min(bisect_right(order, space), top)
        if len(filling) == limits.items and any(filling.count(s) < left[s] for s in order[:k]):
            cut[0] = True
            return
        if not k or len(filling) == limits.items:
            if space <= waste:
                found.append((space, filling))
                least[0] = min(least[0], space)
            return
        tried = 0
        for i in range(k - 1, -1, -1):
            size = order[i]
            if filling.count(size) >= left[size]:
                continue
            if budget[0] <= 0:
                cut[0] = True
                return
            if tried >= limits.width and least[0] == 0:
                break
            tried += 1
            rest = space - size
            if rest and rest in left and rest <= size and (*filling, size).count(rest) < left[rest]:
                found.append((0, (*filling, size, rest)))
                least[0] = 0
            else:
                grow((*filling, size), rest, i + 1)
        if not tried and space <= waste:
            found.append((space, filling))
            least[0] = min(least[0], space)

    grow((), room, len(order))
    if cut[0]:
        reach = _sums(order, left, room)
        target = reach[-1].bit_length() - 1
        for _ in range(limits.width):
            if target < 0 or room - target > waste:
                break
            found.append((room - target, _filling_of(target, order, left, reach)))
            target = (reach[-1] & ((1 << target) - 1)).bit_length() - 1
    out: list[tuple[int, ...]] = []
    for _, f in sorted(set(found), key=lambda x: (x[0], len(x[1]), [-s for s in x[1]])):
        # long fillings are not compared: the test takes time that is exponential in their pieces
        if len(out) < limits.width and not any(max(len(o), len(f)) <= limits.items + 1 and dominates(o, f) for o in out):
            out.append(f)
    return out


def complete(counts: dict[int, int], capacity: int, limits: Limits = Limits()) -> list[Pattern]:
    """A packing of ``counts[length]`` pieces of each length into as few bins as the search finds.

    Branch and bound: every node fills bins around the largest remaining piece with one of the
    undominated fillings, as many bins as the counts allow or one; a branch ends when its waste would need as many bins as
    the best packing known. The first incumbent is the better of best-fit decreasing and ``least_waste``; the search ends early when ``lower_bound``
    is met, or after ``limits.nodes`` nodes. Lengths must lie in
    1..capacity; without pieces there are no bins.
    """
    counts = {k: n for k, n in counts.items() if n > 0}
    if any(not 0 < k <= capacity for k in counts):
        raise ValueError("a length lies outside 1..capacity")
    total = sum(k * n for k, n in counts.items())
    bound = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    if not counts or bins(best) == bound:
        return best
    best = min(best, least_waste(counts, capacity), key=bins)
    nodes = 0
    start = (dict(counts), sorted(counts), 0, [])
    stack = [iter([start])]
    while stack and nodes < limits.nodes and bins(best) > bound:
        state = next(stack[-1], None)
        if state is None:
            stack.pop()
            continue
        nodes += 1
        left, order, wasted, made = state
        if not order:
            if bins(made) < bins(best):
                best = made
            continue
        stack.append(_children(left, order, wasted, made, capacity, (bins(best) - 1) * capacity - total, limits))
    return best


def _children(left, order, wasted, made, capacity, allowed, limits):
    top = order[-1]
    rest = dict(left)
    rest[top] -= 1
    open_ = order if rest[top] else order[:-1]
    if not rest[top]:
        del rest[top]
    once = []
    for filling in fillings(open_, rest, capacity - top, allowed - wasted, limits):
        pattern = (top, *filling)
        used = {s: pattern.count(s) for s in set(pattern)}
        spare = capacity - sum(pattern)
        times = min(left[s] // n for s, n in used.items())
        if spare:
            times = min(times, max(1, (allowed - wasted) // spare))
        if wasted + spare * times <= allowed:
            yield _applied(left, order, wasted, made, pattern, used, spare, times)
        if times > 1:
            once.append((pattern, used, spare))
    for pattern, used, spare in once:
        yield _applied(left, order, wasted, made, pattern, used, spare, 1)


def _applied(left, order, wasted, made, pattern, used, spare, times):
    now_left, now_order = dict(left), list(order)
    _take(now_left, now_order, used, times)
    return now_left, now_order, wasted + spare * times, [*made, (pattern, times)]
