"""Suffix automata of word sequences, for matching statistics."""

from __future__ import annotations

from collections.abc import Sequence


class SuffixAutomaton:
    """All factors of the sequences added, with how often each occurs (counted by the sequences' weights)."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]
        self.closed = False

    def _state(self, following: dict, link: int, length: int, count: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.count.append(count)
        return len(self.link) - 1

    def _clone(self, state: int, symbol, onto: int) -> int:
        """Split off the factors of `onto` that are no longer than `state` and the symbol."""
        copy = self._state(dict(self.next[onto]), self.link[onto], self.length[state] + 1, 0)
        self.link[onto] = copy
        while state >= 0 and self.next[state].get(symbol) == onto:
            self.next[state][symbol] = copy
            state = self.link[state]
        return copy

    def add(self, sequence: Sequence, weight: int = 1) -> None:
        last = 0
        for symbol in sequence:
            onto = self.next[last].get(symbol)
            if onto is not None:  # known from another sequence
                last = onto if self.length[onto] == self.length[last] + 1 else self._clone(last, symbol, onto)
            else:
                new, state = self._state({}, 0, self.length[last] + 1, 0), last
                while state >= 0 and symbol not in self.next[state]:
                    self.next[state][symbol] = new
                    state = self.link[state]
                if state >= 0:
                    onto = self.next[state][symbol]
                    self.link[new] = onto if self.length[onto] == self.length[state] + 1 else self._clone(state, symbol, onto)
                last = new
            self.count[last] += weight

    def close(self) -> None:
        """Carry counts from longer factors to their suffixes; no sequence may follow."""
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[state]] += self.count[state]
        self.closed = True

    def spans(self, sequence: Sequence, least: int, times: int) -> list[int]:
        """Maximal places of factors of at least `least` symbols that occur `times` times: start, stop, start, stop, ...

        The matching statistic at a place is the length of the longest factor that
        ends there and occurs often enough; such factors' own factors do too, so it
        is followed by steps and suffix links.
        """
        found: list[int] = []
        state, size = 0, 0
        for at, symbol in enumerate(sequence):
            while True:
                onto = self.next[state].get(symbol)
                if onto is not None and self.count[onto] >= times:
                    state, size = onto, size + 1
                    break
                if not state:
                    size = 0
                    break
                state = self.link[state]
                size = self.length[state]
            if size >= least:
                if found and found[-1] >= at + 1 - size:
                    found[-1] = at + 1
                else:
                    found += [at + 1 - size, at + 1]
        return found
