"""Suffix automaton of word sequences with owners."""

from __future__ import annotations

from collections.abc import Iterable


class Automaton:
    """All runs of symbols of the sequences added, each with its smallest owner."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.len = [0]
        self.owner: list[int] = [0]

    def add(self, symbols: Iterable[int], owner: int) -> None:
        next_, link, length, owners = self.next, self.link, self.len, self.owner
        last = 0
        for c in symbols:
            p = last
            q = next_[p].get(c)
            if q is not None and length[q] == length[p] + 1:  # known from an earlier sequence
                owners[q] = min(owners[q], owner)
                last = q
                continue
            if q is None:
                new = len(link)
                next_.append({})
                length.append(length[p] + 1)
                link.append(0)
                owners.append(owner)
                while p >= 0 and c not in next_[p]:
                    next_[p][c] = new
                    p = link[p]
                if p < 0:
                    last = new
                    continue
                q = next_[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                    last = new
                    continue
            else:
                new = -1
            clone = len(link)
            next_.append(dict(next_[q]))
            length.append(length[p] + 1)
            link.append(link[q])
            owners.append(owners[q])
            while p >= 0 and next_[p].get(c) == q:
                next_[p][c] = clone
                p = link[p]
            link[q] = clone
            if new >= 0:
                link[new] = clone
                last = new
            else:
                owners[clone] = min(owners[clone], owner)
                last = clone

    def close(self) -> None:
        """Give every state the smallest owner among all places it stands for."""
        for state in sorted(range(1, len(self.link)), key=self.len.__getitem__, reverse=True):
            up = self.link[state]
            if up > 0 and self.owner[state] < self.owner[up]:
                self.owner[up] = self.owner[state]

    def matches(self, symbols: Iterable[int], size: int, below: int) -> list[bool]:
        """For each symbol: do the ``size`` symbols that end there occur with an owner
        less than ``below``? Matching statistics are followed up to ``size``."""
        next_, link, length, owners = self.next, self.link, self.len, self.owner
        state = matched = 0
        out = []
        for c in symbols:
            while state and c not in next_[state]:
                state = link[state]
                matched = length[state]
            to = next_[state].get(c)
            if to is not None:
                state, matched = to, matched + 1
                while length[link[state]] >= size:
                    state = link[state]
                matched = min(matched, size)
            out.append(matched == size and owners[state] < below)
        return out
