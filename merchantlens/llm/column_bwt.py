"""Burrows-Wheeler transform and common prefixes of a collection, built column by column.

The texts are read from their ends. Round j puts the suffix of length j of every text into the sorted
order of all shorter ones: the text's next symbol c goes where the stable order of the symbols seen so far
sends it, and the new suffix stands after as many suffixes as there are c's before its predecessor. Common
prefixes follow from those of the round before: one more than the least of them back to the previous c, and
ahead to the next one. Both arrays are read once and written once per round, from front to back.

Symbols are numbers below 65,535, so a text may hold bytes and beside them names for longer strings.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

# Stands before a text in the transform; no symbol has this number.
END = 0xFFFF


class Collection:
    """The transform ``bwt`` and the common prefixes ``lcp`` of ``texts`` after ``rounds`` columns.

    Suffix k of the sorted order is preceded by symbol ``bwt[k]`` and shares its first ``lcp[k]`` symbols
    with suffix k - 1. The first len(texts) suffixes are the empty ones, in the order of the texts; ends
    of different texts never count as equal. Texts are shorter than 65,536 symbols.
    """

    def __init__(self, texts: Sequence[bytes] | Sequence[np.ndarray]):
        self.n_texts = len(texts)
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        arrays = [np.frombuffer(t, np.uint8) if isinstance(t, bytes) else t for t in texts]
        self.symbols = np.concatenate([np.empty(0, np.uint16), *arrays]).astype(np.uint16)
        self.alphabet = int(self.symbols.max(initial=0)) + 1
        self.ends = np.cumsum(self.lengths)
        self.bwt = np.full(self.n_texts, END, np.uint16)
        filled = self.lengths > 0
        self.bwt[filled] = self.symbols[self.ends[filled] - 1]
        self.lcp = np.zeros(self.n_texts, np.uint16)
        self.rounds = 0
        # Texts with symbols left, in the sorted order of their current suffixes, and those places.
        self.texts = np.flatnonzero(filled)
        self.places = self.texts.copy()

    def insert_column(self) -> None:
        """Put one more symbol of every text that has one into the order."""
        old, n = self.bwt, len(self.bwt)
        order = np.argsort(old, kind="stable")
        placed = np.empty(n, np.int64)
        placed[order] = np.arange(n)
        # END stands behind every symbol and is never chosen.
        starts = np.append(0, np.cumsum(np.bincount(old, minlength=self.alphabet)[: self.alphabet]))
        chosen = old[self.places].astype(np.int64)
        rank = placed[self.places]
        # Minima between neighbouring occurrences of a symbol; an outer one at the ends of its block.
        lcp = np.append(self.lcp, np.uint16(0))
        has_before, has_after = rank > starts[chosen], rank + 1 < starts[chosen + 1]
        before = np.zeros(len(rank), np.uint16)
        before[has_before] = 1 + _least(lcp, order[rank[has_before] - 1] + 1, self.places[has_before] + 1)
        after = np.zeros(len(rank), np.uint16)
        after[has_after] = 1 + _least(lcp, self.places[has_after] + 1, order[rank[has_after] + 1] + 1)

        self.rounds += 1
        target = self.n_texts + rank
        left = self.lengths[self.texts] > self.rounds
        preceding = np.full(len(rank), END, np.uint16)
        preceding[left] = self.symbols[self.ends[self.texts[left]] - self.rounds - 1]
        stays = np.ones(n + len(rank), bool)
        stays[target] = False
        bwt, common = np.empty(len(stays), np.uint16), np.empty(len(stays) + 1, np.uint16)
        bwt[stays], bwt[target] = old, preceding
        common[:-1][stays] = self.lcp
        common[target + 1] = np.where(has_after, after, common[target + 1])
        common[target] = before
        # Where two new suffixes stand side by side, the second one's own value holds; both agree.
        self.bwt, self.lcp = bwt, common[:-1]
        sorted_ = np.argsort(target[left])
        self.texts, self.places = self.texts[left][sorted_], target[left][sorted_]

    def build(self) -> Collection:
        while len(self.texts):
            self.insert_column()
        return self

    def repeated(self, length: int) -> list[np.ndarray]:
        """For each text the starts of its substrings of ``length`` that occur twice in the collection."""
        common = np.append(self.lcp, np.uint16(0))
        twice = (common[:-1] >= length) | (common[1:] >= length)
        order = np.argsort(self.bwt, kind="stable")
        follow = np.empty(len(order), np.int64)
        follow[order] = np.arange(len(order)) + self.n_texts
        found: list[list[int]] = [[] for _ in range(self.n_texts)]
        texts, places = np.arange(self.n_texts), np.arange(self.n_texts)
        for taken in range(1, int(self.lengths.max(initial=0)) + 1):
            going = self.lengths[texts] >= taken
            texts, places = texts[going], follow[places[going]]
            if taken >= length:
                for text in texts[twice[places]]:
                    found[text].append(int(self.lengths[text]) - taken)
        return [np.array(starts[::-1], np.int64) for starts in found]


def _least(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Minimum of each non-empty range [start, end)."""
    if not len(starts):
        return np.empty(0, values.dtype)
    by_start = np.argsort(starts, kind="stable")
    pairs = np.column_stack([starts[by_start], ends[by_start]]).ravel()
    out = np.empty(len(starts), values.dtype)
    out[by_start] = np.minimum.reduceat(values, pairs)[::2]
    return out
