"""Automata over strings: suffix automata and minimal acyclic word automata."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


class SuffixAutomaton:
    """All substrings of a sequence, built online in linear time.

    ``next[s]`` maps a symbol to a state, ``link[s]`` is the suffix link, ``length[s]`` the longest string of s.
    """

    def __init__(self, symbols: Iterable = ()):
        self.next: list[dict] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        self.last = 0
        for x in symbols:
            self.add(x)

    def add(self, x) -> None:
        nxt, link, length = self.next, self.link, self.length
        p, cur = self.last, len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[p] + 1)
        while p >= 0 and x not in nxt[p]:
            nxt[p][x] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][x]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(x) == q:
                    nxt[p][x] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        self.last = cur

    def extend(self, symbols: Iterable) -> None:
        """One more string beside those held: it starts from the root, so no substring spans two strings."""
        self.last = 0
        for x in symbols:
            self._append(x)

    def _append(self, x) -> None:
        """``add`` where the last state may already lead on by x, as it may within a string that is held."""
        s = self.last
        t = self.next[s].get(x)
        if t is None:
            self.add(x)
        elif self.length[t] == self.length[s] + 1:
            self.last = t
        else:
            copy = len(self.next)
            self.next.append(dict(self.next[t]))
            self.link.append(self.link[t])
            self.length.append(self.length[s] + 1)
            while s >= 0 and self.next[s].get(x) == t:
                self.next[s][x] = copy
                s = self.link[s]
            self.link[t] = copy
            self.last = copy

    def reached(self, symbols: Iterable, least: int) -> list[int]:
        """The places where a match of at least so many symbols ends: matching statistics, cut at ``least``."""
        nxt, link, length = self.next, self.link, self.length
        root = nxt[0]
        if not root:
            return []
        out, s, n = [], 0, 0
        for i, x in enumerate(symbols):
            t = nxt[s].get(x)
            if t is None:
                if not s:
                    continue
                while True:
                    s = link[s]
                    t = nxt[s].get(x)
                    if t is not None:
                        n = length[s] + 1
                        s = t
                        break
                    if not s:
                        n = 0
                        break
            else:
                s = t
                n += 1
            if n >= least:
                out.append(i)
        return out

    def statistics(self, symbols: Iterable) -> list[int]:
        """At each position, the length of the longest match that ends there."""
        out, s, n = [], 0, 0
        for x in symbols:
            while s and x not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            if x in self.next[s]:
                s = self.next[s][x]
                n += 1
            else:
                n = 0
            out.append(n)
        return out

    def phrases(self, symbols: Sequence) -> int:
        """Greedy cross-parse: how many longest matches spell the sequence (an unknown symbol is one phrase)."""
        nxt = self.next
        found, s = 0, nxt[0]
        started = False
        for x in symbols:
            t = s.get(x)
            if t is None:
                if started:
                    found += 1
                t = nxt[0].get(x)
                if t is None:
                    found += 1
                    s, started = nxt[0], False
                    continue
            s, started = nxt[t], True
        return found + started


class WordAutomaton:
    """A minimal acyclic automaton of sorted byte strings, each with its rank (so outputs sit in one array by rank).

    Built by incremental minimisation: the states of the last word's tail are replaced by equal registered ones.
    """

    def __init__(self, words: list[bytes]):
        arcs: list[dict[int, int]] = [{}]
        final = [False]
        register: dict[tuple, int] = {}
        path = [0]
        last = b""
        for word in words:
            if word <= last and last:
                raise ValueError("words must be sorted and distinct")
            same = next((i for i, (a, b) in enumerate(zip(word, last, strict=False)) if a != b), min(len(word), len(last)))
            self._settle(arcs, final, register, path, last, same)
            for x in word[same:]:
                arcs.append({})
                final.append(False)
                arcs[path[-1]][x] = len(arcs) - 1
                path.append(len(arcs) - 1)
            final[path[-1]] = True
            last = word
        self._settle(arcs, final, register, path, last, 0)
        self.arcs, self.final = arcs, final

    @staticmethod
    def _settle(arcs, final, register, path, last, depth) -> None:
        while len(path) - 1 > depth:
            state = path.pop()
            key = (final[state], tuple(arcs[state].items()))
            kept = register.setdefault(key, state)
            if kept != state:
                arcs[path[-1]][last[len(path) - 1]] = kept

    def flat(self) -> dict[str, list[int]]:
        """Arrays for a memory map: first arc of each state (and an end), labels, targets, words skipped by an arc, finals."""
        order, number = [0], {0: 0}
        for s in order:
            for t in self.arcs[s].values():
                if t not in number:
                    number[t] = len(order)
                    order.append(t)
        below: dict[int, int] = {}

        def count(s: int) -> int:
            if s not in below:
                below[s] = self.final[s] + sum(count(t) for t in self.arcs[s].values())
            return below[s]

        first, label, target, skip = [], [], [], []
        for s in order:
            first.append(len(label))
            seen = int(self.final[s])
            for x, t in sorted(self.arcs[s].items()):
                label.append(x)
                target.append(number[t])
                skip.append(seen)
                seen += count(t)
        return {"first": [*first, len(label)], "label": label, "target": target, "skip": skip, "final": [int(self.final[s]) for s in order]}
