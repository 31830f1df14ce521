"""An FM-index over sequences of words, searched by many queries in lockstep."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; ``text`` ends with a symbol smaller than all others."""
    n = len(text)
    rank, k = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + nxt
        sa = np.argsort(key, kind="stable")
        s = key[sa]
        new = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        rank = np.empty(n, np.int64)
        rank[sa] = new
        if new[-1] == n - 1 or k >= n:
            return sa
        k *= 2


class FMIndex:
    """``sequences``: arrays of word numbers from 0. Rows of the index know the sequence they start in."""

    def __init__(self, sequences: list[np.ndarray], n_words: int):
        parts, owner = [], []
        for i, s in enumerate(sequences):
            parts += [s + 2, [1]]  # 1: end of a sequence, 0: end of the text
            owner.append(np.full(len(s) + 1, i))
        text = np.concatenate([*parts, [0]]).astype(np.int64)
        owner = np.concatenate([*owner, [0]]).astype(np.int64)
        sa = suffix_array(text)
        self.n, self.text, self.owner, self.sa = len(text), text, owner, sa
        if (n_words + 2) * (self.n + 1) >= 1 << 63:
            raise ValueError("too many words for one index")
        self.rows = np.sort(text[sa - 1] * (self.n + 1) + np.arange(self.n))  # the BWT's rows by their word

    def step(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Backward search: rows before ``i`` that ``c`` precedes, as positions in the first column. Words that are less come before
        them in both, so the place among the sorted rows is that position."""
        return np.searchsorted(self.rows, (c + 2) * (self.n + 1) + i)

    def matches(self, words: np.ndarray, start: np.ndarray, length: np.ndarray, least: int):
        """(query, position, sequence) for every run of ``least`` words of a query that the index holds.

        A query is ``words[start : start + length]``; words not in the index are -1. Each is read from the
        right: the match ending at ``e`` grows to the left as far as it goes, which gives the matching
        statistics of the runs it covers. Then the search starts again at the last end that could still
        hold an unread position: runs with the position that failed and the old end are all out.
        A match at one place only is located there and grows by comparing words, which is what backward search would find.
        """
        lane = np.flatnonzero(length >= least)
        e = length[lane] - 1
        p, sp, ep = e.copy(), np.zeros(len(lane), np.int64), np.full(len(lane), self.n)  # ep: -1 where the match is at place sp
        out = []
        while len(lane):
            c = words[start[lane] + p]
            found = c >= 0
            placed = ep < 0
            at = np.flatnonzero(placed)
            before = sp[at] - 1
            found[at] &= self.text[before] == c[at] + 2  # a sequence's first word has an end before it, which is no word
            sp[at] = before
            wide = np.flatnonzero(~placed & found)
            if wide.size:
                both = self.step(np.tile(c[wide], 2), np.concatenate([sp[wide], ep[wide]]))
                lo, hi = both[: len(wide)], both[len(wide) :]
                one = hi - lo == 1
                sp[wide], ep[wide] = np.where(one, self.sa[np.minimum(lo, self.n - 1)], lo), np.where(one, -1, hi)
                found[wide] = lo < hi
            size = e - p + 1
            hit = np.flatnonzero(found & (size >= least))
            if hit.size:
                out.append((lane[hit], p[hit], self.owner[np.where(ep[hit] < 0, sp[hit], self.sa[np.minimum(sp[hit], self.n - 1)])]))
            lost = np.flatnonzero(~found)
            if lost.size:
                p_, e_ = p[lost], e[lost]
                e[lost] = p[lost] = np.where(c[lost] < 0, p_ - 1, np.where(size[lost] - 1 >= least, p_ + least - 1, e_ - 1))
                sp[lost], ep[lost] = 0, self.n
                p[lost] += 1
            p -= 1
            live = (p >= 0) & (e >= least - 1)
            if not live.all():
                lane, e, p, sp, ep = lane[live], e[live], p[live], sp[live], ep[live]
        if not out:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        return tuple(np.concatenate(x) for x in zip(*out))
