"""Bin completion on a histogram of sizes: branch and bound over fillings around the largest item.

Items of one size are alike, so a bin's filling is applied as often as the counts allow, and a
solution is a list of (filling, times).  Its length follows from the number of sizes, not of items.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

Filling = tuple[tuple[int, int], ...]
Solution = list[tuple[Filling, int]]


def bins_of(solution: Solution) -> int:
    return sum(times for _, times in solution)


def lower_bound(counts: dict[int, int], size: int) -> int:
    total = sum(s * n for s, n in counts.items())
    return max(-(-total // size), sum(n for s, n in counts.items() if 2 * s > size))


def _largest_fitting(sizes: list[int], room: int) -> list[int]:
    """For each free space up to ``room`` the largest of the ascending ``sizes`` that fits, or 0."""
    out, at, fits = [0] * (room + 1), 0, 0
    for space in range(room + 1):
        while at < len(sizes) and sizes[at] <= space:
            fits = sizes[at]
            at += 1
        out[space] = fits
    return out


def best_fit(counts: dict[int, int], size: int) -> Solution:
    """Around each largest item the largest that fits, again and again: the first incumbent."""
    left, out = {s: n for s, n in counts.items() if n}, []
    while left:
        filling = [max(left)]
        room = size - filling[0]
        fits = _largest_fitting(sorted(s for s in left if s <= room), room)
        used = {filling[0]: 1}
        s = fits[room]
        while s:
            if used.get(s, 0) < left[s]:
                used[s] = used.get(s, 0) + 1
                filling.append(s)
                room -= s
                s = fits[min(room, s)]
            else:
                s = fits[s - 1]
        out.append(_apply(left, tuple((s, used[s]) for s in sorted(used, reverse=True))))
    return out


def _sums(sizes: list[int], counts: dict[int, int], room: int) -> list[int]:
    """For each k the sums up to ``room`` that the first k sizes can make, as bits."""
    mask, out = (1 << (room + 1)) - 1, [1]
    for s in sizes:
        bits, n, step = out[-1], min(counts[s], room // s), 1
        while n:
            step = min(step, n)
            bits |= bits << (s * step)
            n, step = n - step, 2 * step
        out.append(bits & mask)
    return out


def dominated(items: list[tuple[int, int]], free: int, waste: int) -> bool:
    """Whether an item outside could take the place of some inside.

    ``free`` has a bit for each size of which an item is left outside.  One that takes the place of
    smaller ones, with what they leave, or of several that add up to it, makes a filling at least as good.
    """
    none, some, several = 1, 1, 0  # sums of no item, of any items, of at least two
    one = 0
    for s, n in items:
        for _ in range(n):
            several |= (several | one) << s
            one |= none << s
            some |= some << s
    if several & free:
        return True
    reached, width = some << 1, 1
    if waste:
        while width < waste:
            step = min(width, waste - width)
            reached |= reached << step
            width += step
        return bool(reached & free)
    return False


def _fillings(
    left: dict[int, int], largest: int, size: int, width: float, nodes: float, limit: int, stats: Counter
) -> list[tuple[Filling, int]]:
    """Up to ``width`` undominated fillings of a bin that holds ``largest``, least waste first.

    A choice is given up where the sums that the remaining sizes can make leave more waste than
    ``limit``, the most that a better solution may have, or no less than ``width`` fillings already have.
    ``nodes`` bounds the choices looked at.
    """
    room = size - largest
    own = dict(left)
    own[largest] -= 1
    sizes = sorted(s for s, n in own.items() if n and s <= room)
    sums = _sums(sizes, own, room)
    outside = sum(1 << s for s in sizes)
    found: list[tuple[int, int, tuple[tuple[int, int], ...]]] = []
    budget = nodes

    def hopeless(space: int, k: int) -> bool:
        waste = space - (sums[k] & ((1 << (space + 1)) - 1)).bit_length() + 1
        cut = waste > limit or (len(found) >= width and waste >= -found[0][0])
        stats["cut"] += cut
        return cut

    def search(space: int, k: int, items: tuple[tuple[int, int], ...]) -> None:
        """Fill ``space`` with the first ``k`` sizes."""
        nonlocal budget
        k = bisect_right(sizes, space, 0, k)
        if not k or not sums[k] & ((1 << (space + 1)) - 2):
            used = sum(1 << s for s, n in items if n == own[s])
            if dominated(list(items), outside & ~used, space):
                stats["dominated"] += 1
                return
            # Few items first at equal waste: small ones fill gaps better later.
            entry = (-space, -sum(n for _, n in items), items)
            if space <= limit:
                (heapq.heappush if len(found) < width else heapq.heappushpop)(found, entry)
            return
        for j in range(k, 0, -1):
            if hopeless(space, j):
                return
            s = sizes[j - 1]
            for n in range(min(own[s], space // s), 0, -1):
                if budget <= 0:
                    return
                budget -= 1
                if not hopeless(space - n * s, j - 1):
                    search(space - n * s, j - 1, (*items, (s, n)))

    if not hopeless(room, len(sizes)):
        search(room, len(sizes), ())
    out = []
    for negative, _, items in sorted(found, reverse=True):
        used = dict(items)
        used[largest] = used.get(largest, 0) + 1
        out.append((tuple((s, used[s]) for s in sorted(used, reverse=True)), -negative))
    return out


def _times(left: dict[int, int], filling: Filling) -> int:
    return min(left[s] // k for s, k in filling)


def _apply(left: dict[int, int], filling: Filling) -> tuple[Filling, int]:
    times = _times(left, filling)
    for s, k in filling:
        left[s] -= k * times
        if not left[s]:
            del left[s]
    return filling, times


def _undo(left: dict[int, int], filling: Filling, times: int) -> None:
    for s, k in filling:
        left[s] = left.get(s, 0) + k * times


def complete(
    counts: dict[int, int], size: int, width: int | None = 3, nodes: int | None = 200, steps: int | None = 4_000,
    stats: Counter | None = None,
) -> Solution:
    """A solution with as few bins as ``steps`` steps of branch and bound find.

    The incumbent is best fit, then the best solution met.  A branch ends where its waste leaves no room for
    a solution with fewer bins than the incumbent, or where the same items were left before at no more waste.
    The search ends at the lower bound or after ``steps`` steps.  With all three caps None it is exact: every
    undominated filling is tried, one bin at a time, however long that takes.  Items larger than a bin are
    refused.  ``stats`` counts steps, cut choices and dominated fillings.
    """
    if any(s > size or s <= 0 for s, n in counts.items() if n):
        raise ValueError("every size must be between 1 and the bin's")
    stats = Counter() if stats is None else stats
    left = {s: n for s, n in counts.items() if n}
    total = sum(s * n for s, n in left.items())
    best, least = best_fit(left, size), lower_bound(left, size)
    if not left or bins_of(best) == least:
        return best
    exact = width is None and nodes is None and steps is None
    width, nodes, steps = (float("inf") if cap is None else cap for cap in (width, nodes, steps))
    path: list[tuple[Filling, int, int]] = []
    waste = 0
    seen: dict[Filling, int] = {}

    def slack() -> int:
        """The waste that a solution with fewer bins may still have."""
        return (bins_of(best) - 1) * size - total - waste

    def choices() -> Iterator[tuple[Filling, int]]:
        return iter(_fillings(left, max(left), size, width, nodes, slack(), stats))

    stack = [choices()]
    while stack and stats["steps"] < steps and bins_of(best) > least:
        choice = next(stack[-1], None)
        if choice is None:
            stack.pop()
            if path:
                filling, times, lost = path.pop()
                _undo(left, filling, times)
                waste -= lost
            continue
        stats["steps"] += 1
        filling, lost = choice
        times = 1 if exact else _times(left, filling)
        if lost * times > slack():
            stats["cut"] += 1
            continue
        for s, k in filling:
            left[s] -= k * times
            if not left[s]:
                del left[s]
        path.append((filling, times, lost * times))
        waste += lost * times
        state = tuple(sorted(left.items()))
        if not left:
            best = [(f, t) for f, t, _ in path]
            stack.append(iter(()))
        elif seen.get(state, waste + 1) <= waste:
            stats["met"] += 1
            stack.append(iter(()))
        else:
            seen[state] = waste
            stack.append(choices())
    return best
