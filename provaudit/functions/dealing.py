"""Dealing groups into folds with the least largest fold, exactly.

Only sizes matter, so groups of one size are interchangeable. A bound on the largest fold is tried by filling one fold after
another: a fold takes the largest group left and any others that bring it between what the other folds cannot hold and the
bound. Which sums the groups left can still reach is a bitset (a big integer), so no branch is entered that
cannot end in range, and the last two folds need no search at all. Bounds are bisected between the trivial one and that of a greedy deal.
"""

from __future__ import annotations

from bisect import bisect_left

#: Folds tried before a bound is given up as undecided.
TRIES = 200_000
#: Bits of a sum's bitset times groups, above which only the greedy deal is tried.
LARGEST = 4_000_000_000


class Undecided(Exception):
    """More folds were tried than TRIES."""


def greedy(sizes: list[int], k: int) -> list[list[int]]:
    """Each group, the largest first, to the lightest fold."""
    folds: list[list[int]] = [[] for _ in range(k)]
    loads = [0] * k
    for n in sorted(sizes, reverse=True):
        f = loads.index(min(loads))
        folds[f].append(n)
        loads[f] += n
    return folds


def reachable(sizes: list[int]) -> list[int]:
    """Bitsets of the sums that the groups from the i-th on can reach."""
    out = [1]
    for n in reversed(sizes):
        out.append(out[-1] | out[-1] << n)
    return out[::-1]


def dealt(sizes: list[int], k: int, low: int, bound: int) -> list[list[int]] | None:
    """Folds of low to bound rows each, or None. sizes fall."""
    tries = 0

    def folds_of(left: list[int], k: int) -> list[list[int]] | None:
        nonlocal tries
        total = sum(left)
        if not k * low <= total <= k * bound or len(left) < k:
            return None
        if k == 1:
            return [left]
        reach = reachable(left)
        least, most = max(low, total - (k - 1) * bound), min(bound, total - (k - 1) * low)
        failed = set()

        def in_range(i: int, load: int) -> bool:
            """Can the groups from the i-th on bring this load into range?"""
            a, b = max(0, least - load), most - load
            return b >= 0 and bool(reach[i] >> a & ((1 << (b - a + 1)) - 1))

        def fill(i: int, load: int, rest: list[int], own: list[int]) -> list[list[int]] | None:
            """Decide on the i-th group: the fold's or not."""
            nonlocal tries
            if load > most or not in_range(i, load):
                return None
            if i == len(left):
                key = tuple(rest)
                if key in failed or len(rest) < k - 1:
                    return None
                tries += 1
                if tries > TRIES:
                    raise Undecided
                if k == 2:
                    return [own, rest]  # what is left lies in range by the choice of least and most
                if found := folds_of(rest, k - 1):
                    return [own, *found]
                failed.add(key)
                return None
            # Of equal groups the first are taken.
            same = i
            while same < len(left) and left[same] == left[i]:
                same += 1
            for take in range(same - i, -1, -1):
                if found := fill(same, load + take * left[i], rest + left[i + take : same], own + left[i : i + take]):
                    return found
            return None

        first = 1
        while first < len(left) and left[first] == left[0]:
            first += 1
        for take in range(first, 0, -1):  # the largest group is in this fold
            if found := fill(first, take * left[0], left[take:first], left[:take]):
                return found
        return None

    return folds_of(sizes, k)


def least_largest(sizes: list[int], k: int, low: int) -> tuple[list[list[int]] | None, bool]:
    """(folds of `low` rows at least whose largest is least, whether that is proven); None if there are no such folds."""
    sizes = sorted(sizes, reverse=True)
    total = sum(sizes)
    if len(sizes) < k or k * low > total:
        return None, True
    best = greedy(sizes, k)
    loads = [sum(f) for f in best]
    floor = max(sizes[0], -(-total // k))
    if min(loads) >= low and max(loads) == floor:
        return best, True
    if min(loads) < low:
        best, loads = None, [total + 1]
    if total * len(sizes) > LARGEST:
        return best, False
    proven, bounds = True, range(floor, max(loads))

    def at_most(bound: int) -> bool:
        nonlocal best, proven
        try:
            found = dealt(sizes, k, low, bound)
        except (Undecided, RecursionError):
            proven, found = False, None
        if found and (best is None or max(map(sum, found)) < max(map(sum, best))):
            best = found
        return found is not None

    bisect_left(bounds, True, key=at_most)
    return best, proven
