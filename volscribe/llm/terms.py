"""Terms of texts: runs of digits, ASCII letters and all characters beyond ASCII, in lower case for A-Z only.

The operators for ranked search and for benchmark passages share this splitting.
"""

from __future__ import annotations

import numpy as np

from volscribe.llm.common import SLICE_BYTES
from volscribe.llm.words import span_hashes

_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def term_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes, where each term starts and ends, and which is the first of each text, with their number last.

    ``at`` holds where each text starts in ``data``, with the end last.
    """
    inside = _TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    start = np.flatnonzero(inside & (~np.r_[False, inside[:-1]] | edge[:-1]))
    end = np.flatnonzero(inside & (~np.r_[inside[1:], False] | edge[1:])) + 1
    return _LOWER[data], start, end, np.searchsorted(start, at)


def term_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, limit: int = SLICE_BYTES) -> np.ndarray:
    """A hash of each span's bytes, about ``limit`` bytes at a time, so that a very long text needs no more memory."""
    out, low = np.empty(len(start), np.uint64), 0
    while low < len(start):
        base = start[low]
        high = max(low + 1, int(np.searchsorted(end, base + limit, side="right")))
        out[low:high] = span_hashes(data[base : end[high - 1]], start[low:high] - base, end[low:high] - base)
        low = high
    return out


def terms_of(text: str | None) -> list[bytes]:
    """The terms of one text."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    data, start, end, _ = term_spans(data, np.array([0, len(data)]))
    stored = data.tobytes()
    return [stored[i:j] for i, j in zip(start.tolist(), end.tolist(), strict=True)]
