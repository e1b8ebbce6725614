"""Bins of a fixed capacity filled by bin completion, on counts per item size.

The input is a histogram (size -> number of items), so its length is bounded by
the capacity however many items there are; a step fills as many equal bins as
the counts allow.

Around the largest size that is left, the undominated fillings of the rest of
its bin are enumerated, least waste first, and tried in depth-first order. A
branch ends where its waste leaves no room for a better solution than the best
one known. Best fit decreasing, run on what is left at the root and along the
branches, gives that first best solution and improves it. The search ends when
a lower bound is met, or after ``nodes`` fillings; it then returns the best
solution known, which holds all items in any case.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

#: (((size, how many in a bin), ...), number of such bins)
Run = tuple[tuple[tuple[int, int], ...], int]

#: Undominated fillings tried around one item, fillings looked at for that.
WIDTH, LOOKED_AT = 6, 60
#: Steps along a branch between two runs of best fit.
REFIT = 32


def best_fit(counts: dict[int, int], capacity: int) -> list[Run]:
    """Best fit decreasing: each item, largest first, into the fullest bin that has room."""
    groups: dict[int, list[Run]] = {}
    rooms: list[int] = []

    def add(room: int, pattern: tuple, times: int) -> None:
        if room not in groups:
            insort(rooms, room)
        groups.setdefault(room, []).append((pattern, times))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            i = bisect_left(rooms, size)
            if i == len(rooms):
                fit = capacity // size
                bins, rest = divmod(left, fit)
                if bins:
                    add(capacity - fit * size, ((size, fit),), bins)
                if rest:
                    add(capacity - rest * size, ((size, rest),), 1)
                break
            room = rooms[i]
            pattern, times = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[i]
            fit = room // size
            full = min(times, left // fit)
            if full:
                add(room - fit * size, (*pattern, (size, fit)), full)
            left -= full * fit
            times -= full
            if times and left:
                add(room - left * size, (*pattern, (size, left)), 1)
                left, times = 0, times - 1
            if times:
                add(room, pattern, times)
    return [run for runs in groups.values() for run in runs]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any solution needs: the volume, and for each size ``a`` the bins
    of the items larger than ``capacity - a``, which take no item of ``a`` or more."""
    most = -(-sum(s * n for s, n in counts.items()) // capacity)
    volume, number = [0] * (capacity + 2), [0] * (capacity + 2)
    for s in range(1, capacity + 1):
        volume[s + 1] = volume[s] + s * counts.get(s, 0)
        number[s + 1] = number[s] + counts.get(s, 0)
    half = capacity // 2
    for a in {0, *(s for s in counts if s <= half)}:
        alone = number[capacity + 1] - number[capacity - a + 1]
        large = number[capacity - a + 1] - number[half + 1]
        room = large * capacity - (volume[capacity - a + 1] - volume[half + 1])
        small = volume[half + 1] - volume[a]
        most = max(most, alone + large + max(0, -(-(small - room) // capacity)))
    return most


def sums_of(filling: list[tuple[int, int]]) -> int:
    """Bit ``s`` is set if some of the items add up to ``s``."""
    bits = 1
    for size, n in filling:
        for _ in range(n):
            bits |= bits << size
    return bits


def dominated(filling: list[tuple[int, int]], waste: int, counts: dict[int, int]) -> bool:
    """Whether an item outside could take the place of items inside (or of the
    waste) that all fit into its own place: then the filling with it is as good."""
    bits, inside = sums_of(filling), dict(filling)
    for x, n in counts.items():
        if n <= inside.get(x, 0):
            continue
        near = (bits >> max(0, x - waste)) & ((1 << (min(x, waste) + 1)) - 1)
        if near & ~(1 << min(x, waste)):
            return True  # less than x, or nothing, makes way for x
        if near and not inside.get(x) and bits >> x & 1:
            return True  # several items that add up to x
    return False


def fillings(counts: dict[int, int], room: int, most_waste: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(waste, filling) of undominated fillings of ``room``, least waste first."""
    if counts.get(room):
        yield 0, [(room, 1)]  # one item that fits exactly dominates all others
        return
    sizes = sorted(s for s in counts if s <= room)
    reach, mask = [1], (1 << (room + 1)) - 1
    for s in sizes:  # reach[i]: the sums that the i smallest sizes can make
        bits, n, step = reach[-1], min(counts[s], room // s), 1
        while n:
            step = min(step, n)
            bits |= bits << (s * step)
            n -= step
            step *= 2
        reach.append(bits & mask)
    given = seen = 0
    for waste in range(min(most_waste, room) + 1):
        if not reach[-1] >> (room - waste) & 1:
            continue
        stack = [(len(sizes), room - waste, [])]
        while stack:
            i, rest, chosen = stack.pop()
            if not rest:
                seen += 1
                if not dominated(chosen, waste, counts):
                    given += 1
                    yield waste, chosen
                if given >= WIDTH or seen >= LOOKED_AT:
                    return
                continue
            while not reach[i - 1] >> rest & 1 and sizes[i - 1] > rest:
                i -= 1
            size = sizes[i - 1]
            for k in range(min(counts[size], rest // size) + 1):  # the last pushed, the most of the largest, comes first
                if reach[i - 1] >> (rest - k * size) & 1:
                    stack.append((i - 1, rest - k * size, [*chosen, (size, k)] if k else chosen))


def complete(counts: dict[int, int], capacity: int, nodes: int = 6000) -> list[Run]:
    """Bins for all items, as few as the search finds."""
    counts = {s: n for s, n in counts.items() if n}
    if not counts:
        return []
    if min(counts) < 1 or max(counts) > capacity:
        raise ValueError("sizes must lie between 1 and the capacity")
    total, least = sum(s * n for s, n in counts.items()), lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    bins = sum(times for _, times in best)

    path: list[Run] = []
    used = spent = 0
    # one frame per step: counts before it, its fillings, used bins and waste before it
    frames = [(counts, _around(counts, capacity, (bins - 1) * capacity - total), 0, 0)]
    while frames and bins > least and nodes:
        before, options, used, spent = frames[-1]
        del path[len(frames) - 1:]
        option = next(options, None)
        if option is None:
            frames.pop()
            continue
        nodes -= 1
        waste, filling = option
        allowed = (bins - 1) * capacity - total - spent
        times = min(before[s] // k for s, k in filling)
        if waste:
            times = min(times, allowed // waste)
        if times < 1:
            frames.pop()  # fillings come least waste first
            continue
        after = dict(before)
        for s, k in filling:
            after[s] -= k * times
            if not after[s]:
                del after[s]
        path.append((tuple(filling), times))
        used, spent = used + times, spent + waste * times
        if not after:
            if used < bins:
                best, bins = list(path), used
            continue
        if len(path) % REFIT == 0:
            rest = best_fit(after, capacity)
            if used + (n := sum(t for _, t in rest)) < bins:
                best, bins = [*path, *rest], used + n
        frames.append((after, _around(after, capacity, (bins - 1) * capacity - total - spent), used, spent))
    return best


def _around(counts: dict[int, int], capacity: int, most_waste: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Fillings of whole bins that hold the largest item."""
    if most_waste < 0:
        return
    largest = max(counts)
    rest = dict(counts)
    rest[largest] -= 1
    if not rest[largest]:
        del rest[largest]
    for waste, filling in fillings(rest, capacity - largest, most_waste):
        whole = dict(filling)
        whole[largest] = whole.get(largest, 0) + 1
        yield waste, sorted(whole.items(), reverse=True)
