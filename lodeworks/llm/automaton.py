"""Generalised suffix automaton over word sequences, with occurrence counts."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Sequence


class SuffixAutomaton:
    """All substrings of the sequences added; ``finish`` counts the places where each one ends."""

    def __init__(self) -> None:
        self.next: list[dict[Hashable, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, of: int | None = None) -> int:
        self.next.append({} if of is None else self.next[of].copy())
        self.link.append(-1 if of is None else self.link[of])
        self.length.append(length)
        self.count.append(0)
        return len(self.length) - 1

    def _split(self, p: int, word: Hashable, q: int) -> int:
        """The state of the longest common part when p's transition by ``word`` leads too far, to q."""
        clone = self._state(self.length[p] + 1, q)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: Hashable) -> int:
        q = self.next[last].get(word)
        if q is not None:  # another sequence led here already
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new, p = self._state(self.length[last] + 1), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def add(self, words: Iterable[Hashable], times: int = 1) -> None:
        """One more reference sequence, which occurs ``times`` times."""
        last = 0
        for word in words:
            last = self._extend(last, word)
            self.count[last] += times

    def finish(self) -> None:
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[v]] += self.count[v]

    def matching(self, words: Sequence[Hashable], most: int):
        """For each word: (length, count) of the longest match that ends there, ``most`` words at
        the longest, and the number of places where that match ends in the references."""
        v, n = 0, 0
        for word in words:
            while v and word not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            if word in self.next[v]:
                v, n = self.next[v][word], n + 1
            n = min(n, most)
            while self.link[v] >= 0 and self.length[self.link[v]] >= n:
                v = self.link[v]
            yield n, self.count[v] if v else 0
