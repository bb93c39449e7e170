"""Lower case and runs of letters over UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def folded(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of U+00C0 to U+00DE in lower case."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        out[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)] += 32
    return out


def letter_runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of runs of ASCII letters and bytes of wider characters, within texts."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = _LETTER[data]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:n]
    end[:-1] &= ~inside[1:] | cut[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offs, s, "right") - 1


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)
