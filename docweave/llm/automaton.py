"""A generalised suffix automaton over sequences of word numbers."""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Sequence


class SuffixAutomaton:
    """Recognises every factor of the items added. State 0 is the empty factor.

    Transitions of all states lie in one dictionary, keyed by state * n_words + word.
    """

    def __init__(self, n_words: int) -> None:
        self.n_words = max(1, n_words)
        self.length = array("l", [0])
        self.link = array("l", [-1])
        self.next: dict[int, int] = {}
        self._out: list[list[int]] = [[]]

    def _state(self, length: int, link: int, like: int | None = None) -> int:
        at = len(self.length)
        self.length.append(length)
        self.link.append(link)
        self._out.append([])
        if like is not None:
            for word in self._out[like]:
                self._set(at, word, self.next[like * self.n_words + word])
        return at

    def _set(self, state: int, word: int, to: int) -> None:
        key = state * self.n_words + word
        if key not in self.next:
            self._out[state].append(word)
        self.next[key] = to

    def add(self, item: Iterable[int]) -> None:
        """Add all factors of one more item; it begins at the empty factor again."""
        last = 0
        for word in item:
            last = self._extend(last, word)

    def _extend(self, last: int, word: int) -> int:
        have = self.next.get(last * self.n_words + word)
        if have is not None:
            if self.length[have] == self.length[last] + 1:
                return have
            return self._split(last, have, word)
        new = self._state(self.length[last] + 1, 0)
        at = last
        while at != -1 and at * self.n_words + word not in self.next:
            self._set(at, word, new)
            at = self.link[at]
        if at == -1:
            self.link[new] = 0
            return new
        to = self.next[at * self.n_words + word]
        self.link[new] = to if self.length[to] == self.length[at] + 1 else self._split(at, to, word)
        return new

    def _split(self, at: int, to: int, word: int) -> int:
        copy = self._state(self.length[at] + 1, self.link[to], like=to)
        self.link[to] = copy
        while at != -1 and self.next.get(at * self.n_words + word) == to:
            self._set(at, word, copy)
            at = self.link[at]
        return copy

    def state_of(self, factor: Sequence[int]) -> int:
        """The state of a factor, which must be one."""
        at = 0
        for word in factor:
            at = self.next[at * self.n_words + word]
        return at

    def seal(self) -> None:
        """No more items: forget what only building needs."""
        self._out = []
