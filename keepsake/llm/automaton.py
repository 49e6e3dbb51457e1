"""Suffix automaton over words."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


class SuffixAutomaton:
    """All runs of words in some passages, each with the owner of the first passage that holds it.

    Passages come by ascending owner, so that is the smallest owner. Each passage starts at the root, so no
    run crosses two of them.
    """

    def __init__(self, passages: Iterable[tuple[int, list[bytes]]]):
        self.next: list[dict] = [{}]
        self.link, self.length, self.owner = [-1], [0], [None]
        nxt, link, length, owners = self.next, self.link, self.length, self.owner
        for owner, words in passages:
            last = 0
            for word in words:
                to = nxt[last].get(word)
                if to is not None:  # the run is known from a passage before
                    last = to if length[to] == length[last] + 1 else self._split(last, word, to)
                    continue
                new = len(link)
                nxt.append({})
                length.append(length[last] + 1)
                owners.append(owner)
                link.append(0)
                at = last
                while at >= 0 and word not in nxt[at]:
                    nxt[at][word] = new
                    at = link[at]
                if at >= 0:
                    to = nxt[at][word]
                    link[new] = to if length[to] == length[at] + 1 else self._split(at, word, to)
                last = new

    def _split(self, at: int, word: bytes, to: int) -> int:
        """A state for the shorter runs of state `to`, up to those that end in state `at` and the word."""
        nxt, link, length = self.next, self.link, self.length
        twin = len(link)
        nxt.append(nxt[to].copy())
        length.append(length[at] + 1)
        self.owner.append(self.owner[to])  # they were first met where `to` was
        link.append(link[to])
        link[to] = twin
        while at >= 0 and nxt[at].get(word) == to:
            nxt[at][word] = twin
            at = link[at]
        return twin

    def matched(self, words: list[bytes], width: int, below: int | None = None) -> np.ndarray:
        """For each window of `width` words: is it a run of some passage (of an owner below `below`)?

        The matching statistic (longest suffix read so far that is a run) is followed from word to word.
        Capped at `width`, it stays in the state of the last `width` words, whose owner is then at hand.
        """
        nxt, link, length, owners = self.next, self.link, self.length, self.owner
        out = np.zeros(max(0, len(words) - width + 1), bool)
        state = run = 0
        for i, word in enumerate(words):
            while state and word not in nxt[state]:
                state = link[state]
                run = length[state]
            to = nxt[state].get(word)
            if to is not None:
                state, run = to, run + 1
                while length[link[state]] >= width:
                    state = link[state]
                if run >= width:
                    run = width
                    if below is None or owners[state] < below:
                        out[i - width + 1] = True
        return out
