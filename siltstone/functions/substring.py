"""Longest common substrings in linear time: a suffix automaton of one text, streamed by the other."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Automata of repeated texts that a task remembers, and the characters of the longest of them.
REMEMBERED, SHORT = 64, 20_000


class Substrings:
    """The automaton of all substrings of a text: moves, suffix links and lengths of its states."""

    def __init__(self, text: str):
        self.moves, self.links, self.lengths = [{}], [-1], [0]
        end = 0
        for c in text:
            new = self._state(self.lengths[end] + 1, {})
            at, end = end, new
            while at >= 0 and c not in self.moves[at]:
                self.moves[at][c] = new
                at = self.links[at]
            self.links[new] = self._shared(at, c) if at >= 0 else 0

    def _state(self, length: int, moves: dict) -> int:
        self.moves.append(moves)
        self.links.append(0)
        self.lengths.append(length)
        return len(self.moves) - 1

    def _shared(self, at: int, c: str) -> int:
        """The state of the longest string at ``at`` followed by c, split off where the one it leads to is longer."""
        old = self.moves[at][c]
        if self.lengths[old] == self.lengths[at] + 1:
            return old
        part = self._state(self.lengths[at] + 1, dict(self.moves[old]))
        self.links[part], self.links[old] = self.links[old], part
        while at >= 0 and self.moves[at].get(c) == old:
            self.moves[at][c] = part
            at = self.links[at]
        return part

    def longest_in(self, text: str) -> int:
        """The length of the longest substring that the two texts share."""
        best = at = n = 0
        for c in text:
            while at and c not in self.moves[at]:
                at = self.links[at]
                n = self.lengths[at]
            if c in self.moves[at]:
                at, n = self.moves[at][c], n + 1
                best = max(best, n)
            else:
                n = 0
        return best


def longest_common(df: DataFrame, key: str, a: str, b: str, most: int | None = 4000) -> DataFrame:
    """key, longest: the length of the longest common substring of two columns, each cut to its first ``most`` characters (None: whole). Null counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        remembered = functools.lru_cache(maxsize=REMEMBERED)(Substrings)
        for batch in batches:
            out = []
            for x, y in zip(batch[a], batch[b], strict=True):
                x, y = (x or "")[:most], (y or "")[:most]
                if len(y) < len(x):
                    x, y = y, x
                out.append((remembered if len(x) <= SHORT else Substrings)(x).longest_in(y))
            yield pd.DataFrame({key: batch[key], "longest": out})

    return df.select(key, a, b).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, longest long")
