"""Hashed word shingles of many texts at once, in numpy.

Words are the runs of bytes other than blank and the control characters 9 to 13, with A-Z lower-cased. A word's hash comes from
a running polynomial over all bytes of a batch, a shingle's from its words' hashes; both are finished by a
mixing step. A text with fewer words than a shingle has one shingle of them all, one without words none.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WORD = np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


def word_hashes(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts joined in ``data``, and how many each text has; ``first``: the texts' offsets and the end."""
    low = _LOWER[data]
    inside = ~_SPACE[low]
    edge = np.zeros(len(data) + 1, bool)
    edge[first] = True  # a word ends with its text
    before = np.concatenate([[False], inside])
    here = np.concatenate([inside, [False]])
    start = np.flatnonzero(here & (~before | edge))
    end = np.flatnonzero(before & (~here | edge))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=total[1:])
    back = _powers(_INVERSE, len(data) + 1)
    words = mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64) * _WORD)
    return words, np.diff(np.searchsorted(start, first))


def shingle_sets(texts, size: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text (bytes; None and empty texts have none)."""
    joined = [t or b"" for t in texts]
    first = np.concatenate([[0], np.cumsum([len(t) for t in joined])]).astype(np.int64)
    data = np.frombuffer(b"".join(joined), np.uint8)
    if not len(data):
        return [np.zeros(0, np.uint64) for _ in joined]
    words, counts = word_hashes(data, first)
    run = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        run = run * _WORD + words[k: len(words) - size + 1 + k] if len(run) else run
    run = mix(run)
    out, at = [], 0
    for n in counts.tolist():
        if n >= size:
            out.append(np.unique(run[at: at + n - size + 1]))
        elif n:
            h = np.uint64(n)
            for w in words[at: at + n]:
                h = np.uint64((int(h) * int(_WORD) + int(w)) & 0xFFFFFFFFFFFFFFFF)
            out.append(mix(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out
