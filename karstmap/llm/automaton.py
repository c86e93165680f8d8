"""A suffix automaton over sequences of hashable symbols, several sequences in one."""

from __future__ import annotations

from collections.abc import Hashable, Iterable


class SuffixAutomaton:
    """Every factor of the added sequences leads from state 0 to a state; link drops to the longest shorter factor of another state."""

    def __init__(self) -> None:
        self.next: list[dict[Hashable, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, sequence: Iterable[Hashable]) -> None:
        last = 0
        for symbol in sequence:
            last = self._extend(last, symbol)

    def _state(self, length: int, moves: dict[Hashable, int], link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, symbol: Hashable) -> int:
        """A state for p's longest factor followed by symbol, apart from q's longer ones."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, symbol: Hashable) -> int:
        if (q := self.next[last].get(symbol)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, symbol)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][symbol]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, symbol)
        return new
