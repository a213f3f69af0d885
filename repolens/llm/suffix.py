"""Enhanced suffix arrays over byte strings, and their interval tree of common prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes that one number holds: the first level of ranks.
WORD = 8


def _ranks(key: np.ndarray) -> np.ndarray:
    """Dense ranks from 1."""
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.ones(len(order), np.int64)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


class SuffixArray:
    """Suffixes of several strings in order, those that share ``least`` bytes with another only. No common
    prefix runs beyond a string's end. Ranks of 8, 16, 32, ... bytes are kept: they give common prefixes
    without a scan."""

    def __init__(self, strings: list[bytes], least: int = 1) -> None:
        size = np.array([len(s) for s in strings], np.int64)
        self.begin = np.cumsum(size + 1) - size - 1
        n = int((size + 1).sum())
        text = np.frombuffer(b"\0".join(strings) + b"\0" * (WORD + 1), np.uint8)[: n + WORD]
        self.text = text[:n]
        self.owner = np.repeat(np.arange(len(strings)), size + 1)
        left = np.repeat(self.begin + size, size + 1) - np.arange(n)
        words = np.ndarray((n,), ">u8", np.ascontiguousarray(text).tobytes(), strides=(1,)).astype(np.uint64)
        short = left < WORD
        keep = np.where(short, left, WORD).astype(np.uint64) * np.uint64(8)
        mask = np.where(keep == 0, np.uint64(0), ~np.uint64(0) << (np.uint64(64) - np.maximum(keep, np.uint64(1))))
        self.words, self.left = words & mask, left
        # what runs into its string's end equals nothing but itself, and comes before what goes on
        tie = np.where(short, left * len(strings) + self.owner, WORD * len(strings))
        self.levels = [_ranks(_ranks(self.words) * (WORD * len(strings) + 1) + tie)]
        width, longest = WORD, int(size.max(initial=0))
        while width < longest and 2 * width <= max(least, WORD):
            self.levels.append(_ranks(self.levels[-1] * (n + 1) + self._after(self.levels[-1], width)))
            width *= 2
        # ranks of exactly `least` bytes tell which suffixes matter
        rank = self.levels[-1]
        if least > width:
            rank = _ranks(rank * (n + 1) + self._after(rank, least - width))
        if least >= WORD:
            count = np.bincount(rank)
            at = np.flatnonzero((count[rank] > 1) & (left >= least))
        else:
            at = np.flatnonzero(left > 0)
        keys = [self._rank_at(at + k * width) for k in range(longest // width + 1)]
        self.width = width
        self.order = at[np.lexsort(keys[::-1])] if len(at) else at

    def _after(self, rank: np.ndarray, step: int) -> np.ndarray:
        out = np.zeros(len(rank), np.int64)
        out[: max(0, len(rank) - step)] = rank[step:]
        return out

    def _rank_at(self, at: np.ndarray) -> np.ndarray:
        """Ranks of the widest level; 0 beyond the end."""
        out = np.zeros(len(at), np.int64)
        inside = at < len(self.text)
        out[inside] = self.levels[-1][at[inside]]
        return out

    def common(self) -> np.ndarray:
        """Length of the common prefix of each suffix in order with the one before; the first has 0."""
        n = len(self.order)
        length = np.zeros(n, np.int64)
        if n < 2:
            return length
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        most = np.minimum(self.left[a], self.left[b])
        for k in range(len(self.levels) - 1, -1, -1):
            rank, width = self.levels[k], WORD << k
            going = np.arange(n - 1)
            # the widest level may fit several times, each other one once
            while len(going):
                going = going[(length[1:][going] + width <= most[going])]
                same = rank[a[going]] == rank[b[going]]
                going = going[same]
                length[1:][going] += width
                a[going] += width
                b[going] += width
                if k < len(self.levels) - 1:
                    break
        inside = length[1:] < most
        differ = self.words[a[inside]] ^ self.words[b[inside]]
        lead = np.zeros(len(differ), np.int64)
        for k in range(1, WORD):
            lead += (differ >> np.uint64(64 - 8 * k)) == 0
        rest = np.minimum(lead, most[inside] - length[1:][inside])
        length[1:][inside] += rest
        return length

    def maximal_repeats(self, least: int) -> Iterator[tuple[int, np.ndarray]]:
        """(length, start positions) of every maximal repeat of at least ``least`` bytes (no fewer than the array
        was made for) with all its
        occurrences: the nodes of the interval tree, found with a stack over the common prefixes, whose
        suffixes have more than one byte before them (a string's start counts as a byte of its own)."""
        common = self.common()
        first_byte = np.zeros(len(self.text), bool)
        first_byte[self.begin] = True
        before = np.where(first_byte[self.order], -1 - self.owner[self.order], self.text[self.order - 1].astype(np.int64))
        turns = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])]) if len(before) else before
        high = np.flatnonzero(common >= least)
        if not len(high):
            return
        cut = np.flatnonzero(np.diff(high) > 1)
        firsts, lasts = high[np.concatenate([[0], cut + 1])], high[np.concatenate([cut, [len(high) - 1]])]
        for first, last in zip(firsts.tolist(), lasts.tolist(), strict=True):
            values = common[first : last + 1].tolist()
            stack: list[tuple[int, int]] = []
            for k, value in enumerate([*values, 0], first):
                left = k - 1
                while stack and stack[-1][0] > value:
                    length, left = stack.pop()
                    if turns[k - 1] > turns[left]:
                        yield length, self.order[left:k]
                if value and (not stack or stack[-1][0] < value):
                    stack.append((value, left))
