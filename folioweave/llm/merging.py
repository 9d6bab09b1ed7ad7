"""Joining neighbouring symbols by rank, in time that hardly exceeds the number of symbols."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Hashable


def joined(symbols: list, rule: Callable[[Hashable, Hashable], tuple | None]) -> list:
    """``symbols`` after joining the pair of least rank, leftmost first, until no pair has a rule.

    ``rule(a, b)`` is (rank, whole) or None. Symbols are a linked list, open pairs a heap by (rank, place); a pair whose
    symbols have changed since is passed over, so n symbols take n log n steps.
    """
    n = len(symbols)
    value: list = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple] = []

    def opened(i: int, j: int) -> list[tuple]:
        found = rule(value[i], value[j])
        return [] if found is None else [(found[0], i, value[i], value[j], found[1])]

    for i in range(n - 1):
        heap += opened(i, i + 1)
    heapq.heapify(heap)
    while heap:
        _, i, a, b, whole = heapq.heappop(heap)
        j = after[i]
        if j >= n or value[i] != a or value[j] != b:
            continue
        value[i], value[j] = whole, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            for pair in opened(i, after[i]):
                heapq.heappush(heap, pair)
        if before[i] >= 0:
            for pair in opened(before[i], i):
                heapq.heappush(heap, pair)
    return [v for v in value if v is not None]
