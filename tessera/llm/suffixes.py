"""Suffix order of many strings by two-stage sorting, and which neighbours in it share a long prefix.

A suffix that is smaller than its successor (the suffix one byte on) is sorted directly. All others follow by scans of
the buckets of first bytes, from the smallest up: when a suffix is met whose predecessor is larger than it, the predecessor's place
is the next one among the larger ones of its own bucket. Suffixes are ordered by their first ``depth`` bytes at least, and the end
of a string is smaller than any byte.
"""

from __future__ import annotations

import numpy as np

BLOCK = 8  # bytes that two suffixes are compared by at a time


class Suffixes:
    """The suffixes of ``strings`` that have ``depth`` bytes or more: ``order`` holds where they begin in ``data``."""

    def __init__(self, strings: list[bytes], depth: int):
        self.depth = depth
        self.data = b"\0" + b"\0".join(strings) + b"\0"
        size = np.array([len(s) for s in strings], np.int64)
        self.begin = np.cumsum(size + 1) - size  # of each string; the byte before it and the one behind it divide strings
        self.end = self.begin + size
        self.text = np.frombuffer(self.data, np.uint8).astype(np.int16)
        self.text[self.end] = self.text[0] = -1
        self.order = self._order()

    def _order(self) -> np.ndarray:
        t, n = self.text, len(self.text)
        # smaller than its successor: the next byte that differs is larger; dividers count as such, they are the smallest
        change = np.append(t[:-1] != t[1:], True)
        last = np.minimum.accumulate(np.where(change, np.arange(n), n - 1)[::-1])[::-1]
        rises = np.append(t[:-1] < t[1:], True)[last]
        rises[self.end] = True
        # only suffixes with ``depth`` bytes are wanted, and those that their places follow from: up to the next one that is sorted directly
        stop = np.flatnonzero(rises)
        full = self.end - self.begin >= self.depth
        until = stop[np.searchsorted(stop, self.end[full] - self.depth)] + 1
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, self.begin[full], 1)
        np.add.at(step, until, -1)
        needed = np.cumsum(step[:-1]) > 0
        direct = np.flatnonzero(needed & rises)
        ends = self.end[np.searchsorted(self.end, direct)]
        stops = np.minimum(direct + self.depth, ends)
        data = self.data
        keys = [data[a:b] for a, b in zip(direct.tolist(), stops.tolist())]
        direct = direct[np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)]
        del keys
        first = np.searchsorted(t[direct], np.arange(-1, 257)) if len(direct) else np.zeros(258, np.int64)
        waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
        out = []
        for c in range(-1, 256):
            bucket = waiting[c] if c >= 0 else []
            run = np.concatenate(bucket) if bucket else direct[:0]
            while len(run):  # one more of the same byte in front: larger than all with fewer
                run = run[needed[run - 1] & (t[run - 1] == c)] - 1
                if len(run):
                    bucket.append(run)
            bucket.append(direct[first[c + 1]: first[c + 2]])
            found = np.concatenate(bucket)
            out.append(found)
            before = found - 1
            before = before[needed[before] & (t[before] > c) & ~rises[before]]
            before = before[np.argsort(t[before], kind="stable")]
            cuts = np.flatnonzero(np.diff(t[before])) + 1
            for part in np.split(before, cuts) if len(before) else ():
                waiting[t[part[0]]].append(part)
        order = np.concatenate(out)
        owner = np.minimum(np.searchsorted(self.end, order), len(self.end) - 1)
        return order[self.end[owner] - order >= self.depth]

    def common(self) -> np.ndarray:
        """For each two neighbours in the order, the length of their common prefix, at most ``depth``."""
        a, b = self.order[:-1], self.order[1:]
        out = np.zeros(len(a), np.int64)
        raw = np.frombuffer(self.data + b"\0" * BLOCK, np.uint8)
        words = np.lib.stride_tricks.sliding_window_view(raw, BLOCK)
        words = np.ascontiguousarray(words).view("<u8").ravel()
        live = np.arange(len(a))
        for at in range(0, self.depth, BLOCK):
            odd = words[a[live] + at] ^ words[b[live] + at]
            low = odd & (~odd + np.uint64(1))  # the lowest bit set lies in the first byte that differs
            bits = np.zeros(len(live), np.int64)
            np.log2(low.astype(np.float64), out=(scale := np.zeros(len(live))), where=low > 0)
            bits[:] = scale
            out[live] = at + np.where(odd == 0, BLOCK, bits // 8)
            live = live[odd == 0]
        return np.minimum(out, self.depth)

    def repeated(self) -> np.ndarray:
        """Where suffixes begin (in ``data``, rising) whose first ``depth`` bytes begin another one, too."""
        same = self.common() >= self.depth
        hit = np.zeros(len(self.order), bool)
        hit[:-1] |= same
        hit[1:] |= same
        return np.sort(self.order[hit])
