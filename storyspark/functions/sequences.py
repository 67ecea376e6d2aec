"""How much of one text another holds in order: matching blocks by recursive longest common runs, found with a suffix automaton."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

#: A text shorter than this has no ratio.
LEAST = 200


class Automaton:
    """Suffix automaton of a text: every run of it is a path; a state knows where its runs first end."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.end = [-1], [0], [-1]
        last = 0
        for i, c in enumerate(text):
            new = self._state({}, self.length[last] + 1, i)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p < 0:
                self.link[new] = 0
            else:
                q = self.next[p][c]
                if self.length[q] == self.length[p] + 1:
                    self.link[new] = q
                else:
                    copy = self._state(dict(self.next[q]), self.length[p] + 1, self.end[q])
                    self.link[copy] = self.link[q]
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = self.link[p]
                    self.link[q] = self.link[new] = copy
            last = new

    def _state(self, arcs: dict[str, int], length: int, end: int) -> int:
        self.next.append(arcs)
        self.link.append(-1)
        self.length.append(length)
        self.end.append(end)
        return len(self.next) - 1

    def longest(self, text: str) -> tuple[int, int, int]:
        """(size, start in ``text``, start in the automaton's text) of the longest common run: of equals the first in ``text``, there the first in the other."""
        best, state, size = (0, 0, 0), 0, 0
        for i, c in enumerate(text):
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if c in self.next[state]:
                state, size = self.next[state][c], size + 1
                if size > best[0]:
                    best = (size, i - size + 1, self.end[state] - size + 1)
        return best


def matching(a: str, b: str) -> int:
    """Characters in matching blocks: the longest common run, then the same left and right of it."""
    total, waiting = 0, [(0, len(a), 0, len(b))]
    while waiting:
        a0, a1, b0, b1 = waiting.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        # equal heads and tails of a part are no shortcut here: the longest run may lie elsewhere
        size, x, y = Automaton(b[b0:b1]).longest(a[a0:a1])
        if size:
            total += size
            waiting += [(a0, a0 + x, b0, b0 + y), (a0 + x + size, a1, b0 + y + size, b1)]
    return total


def ratio(member: str | None, anchor: str | None) -> float | None:
    """Share of ``member`` in matching blocks with ``anchor``; null for a member of under ``LEAST`` characters or where one is null."""
    if member is None or anchor is None or len(member) < LEAST:
        return None
    return matching(member, anchor) / len(member)


def contained(member, anchor):
    """Column of ``ratio`` of two text columns."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")

    return run(member, anchor)
