"""Suffix arrays by two-stage sorting, in numpy, of the segments that one task gets.

Only suffixes smaller than their successors are sorted directly. The others follow by
scans of the buckets, smallest symbol first: what precedes the suffixes of a finished
bucket is already in order.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

# Symbols of 9 bits in one key: a byte plus one, or 0 for the end of a segment.
_IN_KEY, _BITS = 7, 9


class Segments:
    """Segments laid end to end, each followed by an end mark that no suffix reads beyond."""

    def __init__(self, segments: Sequence[bytes]):
        lengths = np.array([len(s) for s in segments], np.int64)
        self.first = np.cumsum(lengths + 1) - lengths - 1
        self.symbols = np.zeros(int((lengths + 1).sum()), np.int64)
        body = np.ones(len(self.symbols), bool)
        body[self.first + lengths] = False
        self.symbols[body] = np.frombuffer(b"".join(segments), np.uint8).astype(np.int64) + 1
        self.segment = np.repeat(np.arange(len(segments)), lengths + 1)
        # Symbols left up to the end mark.
        self.left = np.repeat(self.first + lengths, lengths + 1) - np.arange(len(self.symbols))
        self.keys = np.zeros(len(self.symbols), np.int64)
        padded = np.r_[self.symbols, np.zeros(_IN_KEY, np.int64)]
        for k in range(_IN_KEY):
            ahead = padded[k : k + len(self.symbols)]
            self.keys |= np.where(self.left > k, ahead, 0) << (_BITS * (_IN_KEY - 1 - k))

    def key(self, at: np.ndarray, offset: int) -> np.ndarray:
        """The symbols from ``offset`` on of the suffixes ``at``."""
        inside = self.left[at] > offset
        return np.where(inside, self.keys[np.minimum(at + offset, len(self.keys) - 1)], 0)


def _larger(symbols: np.ndarray) -> np.ndarray:
    """Which suffixes are larger than their successors; end marks are not."""
    change = np.flatnonzero(symbols[1:] != symbols[:-1])
    out = np.zeros(len(symbols), bool)
    if len(change):
        down = symbols[change] > symbols[change + 1]
        upto = np.searchsorted(change, np.arange(change[-1] + 1))
        out[: change[-1] + 1] = down[upto]
    return out & (symbols > 0)


def _sorted_directly(text: Segments, at: np.ndarray, depth: int) -> np.ndarray:
    """``at`` in the order of the suffixes' first ``depth`` symbols."""
    key = text.key(at, 0)
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    group = np.cumsum(np.r_[0, key[1:] != key[:-1]]) if len(at) else np.empty(0, np.int64)
    for offset in range(_IN_KEY, depth, _IN_KEY):
        same = np.r_[False, group[1:] == group[:-1]]
        tied = np.flatnonzero(same | np.r_[same[1:], False])
        tied = tied[np.isin(group[tied], group[tied[text.left[at[tied]] >= offset]])] if len(tied) else tied
        if not len(tied):
            break
        key = text.key(at[tied], offset)
        order = np.lexsort((key, group[tied]))
        at[tied], key = at[tied][order], key[order]
        split = np.zeros(len(at), np.int64)
        split[tied[1:]] = (group[tied][1:] == group[tied][:-1]) & (key[1:] != key[:-1])
        group = group + np.cumsum(split)
    return at


def suffix_array(text: Segments, depth: int) -> np.ndarray:
    """All suffixes in the order of their first ``depth`` symbols, end marks first."""
    symbols = text.symbols
    larger = _larger(symbols)
    ends = np.flatnonzero(symbols == 0)
    smaller = _sorted_directly(text, np.flatnonzero(~larger & (symbols > 0)), depth)
    by_symbol = np.searchsorted(symbols[smaller], np.arange(258))
    waiting: list[list[np.ndarray]] = [[] for _ in range(258)]
    out = []

    def scan(bucket: np.ndarray, symbol: int) -> None:
        before = bucket[bucket > 0] - 1
        before = before[larger[before] & (symbols[before] > symbol)]
        kinds = symbols[before]
        order = np.argsort(kinds, kind="stable")
        before, kinds = before[order], kinds[order]
        cuts = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]]) if len(kinds) else np.empty(0, np.int64)
        for part in np.split(before, cuts[1:]) if len(cuts) else ():
            waiting[symbols[part[0]]].append(part)

    scan(ends, 0)
    out.append(ends)
    for symbol in range(1, 257):
        induced = waiting[symbol]
        last = np.concatenate(induced) if induced else np.empty(0, np.int64)
        parts = [last]
        while len(last):
            # Longer runs of the same symbol follow the shorter ones.
            last = last[last > 0] - 1
            last = last[larger[last] & (symbols[last] == symbol)]
            parts.append(last)
        bucket = np.concatenate([*parts, smaller[by_symbol[symbol] : by_symbol[symbol + 1]]])
        if len(bucket):
            scan(bucket, symbol)
            out.append(bucket)
    return np.concatenate(out)


def common_prefixes(text: Segments, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each suffix in ``order`` with the one before it, up to ``depth``; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    going = np.arange(1, len(order))
    for offset in range(0, depth, _IN_KEY):
        differ = text.key(order[going], offset) ^ text.key(order[going - 1], offset)
        # The place of the highest bit; without the bit below it, no rounding moves it up.
        equal = (_IN_KEY * _BITS - np.frexp((differ & ~(differ >> 1)).astype(np.float64))[1]) // _BITS
        out[going] += equal
        going = going[equal == _IN_KEY]
    out[1:] = np.minimum(out[1:], np.minimum(text.left[order[1:]], text.left[order[:-1]]))
    return np.minimum(out, depth)
