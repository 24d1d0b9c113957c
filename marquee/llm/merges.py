"""Applying byte-pair merges to one short piece: the base case of the tokenizer operators."""

from __future__ import annotations

import heapq

#: From so many symbols on a heap finds the next merge; below, a list of all pairs is faster.
HEAP_FROM = 64
_NONE = 1 << 62
_ID = (1 << 32) - 1


def rule(rank: int, merged: int) -> int:
    """Rank and merged id in one number, which sorts by rank."""
    return rank << 32 | merged


def merge(symbols: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """Merge neighbours, lowest rank first and leftmost on a tie, until no pair has a rule.

    ``pairs`` maps two neighbouring ids to their ``rule``.
    """
    if len(symbols) >= HEAP_FROM:
        return _merge_long(symbols, pairs)
    parts, of = list(symbols), pairs.get
    rules = [of(pair, _NONE) for pair in zip(parts, parts[1:])]
    while rules:
        best = min(rules)
        if best == _NONE:
            break
        i = rules.index(best)
        parts[i] = best & _ID
        del parts[i + 1], rules[i]
        if i < len(rules):
            rules[i] = of((parts[i], parts[i + 1]), _NONE)
        if i:
            rules[i - 1] = of((parts[i - 1], parts[i]), _NONE)
    return parts


def _merge_long(symbols: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """The same with a heap of (rule, place) over a linked list: n log n for n symbols."""
    n = len(symbols)
    ids, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def look(i: int, j: int) -> None:
        if i >= 0 and j < n and (found := pairs.get((ids[i], ids[j]))) is not None:
            heapq.heappush(heap, (found, i, ids[i], ids[j]))

    for i in range(n - 1):
        look(i, i + 1)
    while heap:
        found, i, a, b = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j >= n or ids[j] != b:
            continue  # one of the two has been merged with another neighbour
        ids[i], ids[j] = found & _ID, -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        look(i, after[i])
        look(before[i], i)
    return [x for x in ids if x >= 0]
