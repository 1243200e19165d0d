"""Words and word shingles of many texts at once, as 64-bit hashes in numpy arrays.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed
and carriage return.
"""

from __future__ import annotations

import numpy as np

from volscribe.llm.common import mixed

SHINGLE_WORDS = 5

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def raised(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and their inverses, kept for the next call."""
    global _powers, _inverses
    if n > len(_powers):
        size = max(n, 1 << 20)
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.r_[np.uint64(1), np.full(size, _BASE, np.uint64)])
            _inverses = np.cumprod(np.r_[np.uint64(1), np.full(size, inverse, np.uint64)])
    return _powers, _inverses


def random_bytes(data: np.ndarray) -> np.ndarray:
    """A random 64-bit number for each byte."""
    return _BYTE[data]


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word starts and ends, and which word is the first of each text, with their number last.

    ``at`` holds where each text starts in ``data``, with the end last. Words never
    reach across texts.
    """
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.r_[False, inside[:-1]]
    after = np.r_[inside[1:], False]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, at)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span."""
    powers, inverses = raised(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.r_[np.uint64(0), np.cumsum(_BYTE[data] * powers[: len(data)])]
        return mixed((total[end] - total[start]) * inverses[start])


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and which word is the first of each text, with their number last."""
    start, end, first = word_spans(data, at)
    return span_hashes(data, start, end), first


def shingles(words: np.ndarray, first: np.ndarray, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each run of ``size`` words, and where each text's shingles start, with the end last.

    A text of fewer words, but one at least, has one shingle of all its words.
    """
    counts = np.diff(first)
    number = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_at = np.r_[0, np.cumsum(number)]
    out = np.empty(out_at[-1], np.uint64)
    if not len(out):
        return out, out_at
    factor = np.uint64(_BASE)
    with np.errstate(over="ignore"):
        if len(words) >= size:
            rolling = words[: len(words) - size + 1].copy()
            for k in range(1, size):
                rolling = rolling * factor + words[k : len(words) - size + 1 + k]
            long = np.repeat(counts >= size, number)
            source = np.arange(len(out)) - np.repeat(out_at[:-1] - first[:-1], number)
            out[long] = rolling[source[long]]
        for k in np.flatnonzero((counts > 0) & (counts < size)):
            value = words[first[k]]
            for word in words[first[k] + 1 : first[k + 1]]:
                value = value * factor + word
            out[out_at[k]] = value * factor + np.uint64(counts[k])
    return mixed(out), out_at
