"""Word shingles of whole texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np

from .batches import Rolling, U, lowered, mix, words

_NEXT = U(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): of each row its distinct shingles of size words, sorted. A row with fewer words has
    one shingle, its whole sequence; a row without words has none."""
    rows = len(offs) - 1
    low = lowered(data)
    s, e, row = words(low, offs)
    if not len(s):
        return np.zeros(0, U), np.zeros(rows + 1, np.int64)
    h = Rolling(low).of(s, e)
    n = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    rank = np.arange(len(s)) - first[row]
    full = rank <= n[row] - size
    at = np.flatnonzero(full)
    key = np.full(len(at), U(size))
    for k in range(size):
        key = mix(key * _NEXT + h[at + k])
    owner = row[at]
    if (n < size).any():  # one shingle from all the words of a short row
        few = np.flatnonzero((n > 0) & (n < size))
        short = n[few].astype(U)
        for k in range(size - 1):
            has = n[few] > k
            short[has] = mix(short[has] * _NEXT + h[first[few[has]] + k])
        key, owner = np.concatenate([key, short]), np.concatenate([owner, few])
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    key, owner = key[new], owner[new]
    return key, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))])
