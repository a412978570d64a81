"""Hashes of all words of many texts at once.

A word's hash is the sum of its bytes times powers of an odd constant, modulo
2**64, mixed.  Sums over a running total give all words in a few array
operations; multiplying by the inverse power makes a hash independent of the
word's place.
"""

from __future__ import annotations

import numpy as np

M = 0x9E3779B97F4A7C15
_MIX, _FINAL = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD)
#: Bytes looked at together; a task holds some 100 bytes for each.
CHUNK = 1 << 20
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of M and of its inverse; one table serves all chunks."""
    size = max(CHUNK, 1 << (n - 1).bit_length() if n > 1 else 1)
    if size not in _tables:
        _tables.clear()
        out = []
        for base in (M, pow(M, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p))
        _tables[size] = tuple(out)
    return _tables[size]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _FINAL
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray, inside: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last byte, part and hash of each word in ``data``.

    ``inside`` tells the bytes of words; ``edge`` has the parts' ends after a 0,
    no part is empty, and no word crosses an edge.
    """
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[edge[:-1]] = inside[edge[:-1]]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edge[1:] - 1] = inside[edge[1:] - 1]
    a, z = np.flatnonzero(first), np.flatnonzero(last)
    own = np.searchsorted(edge, a, side="right") - 1
    up, down = _powers(len(data))
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
    return a, z, own, mix((run[z + 1] - run[a]) * down[a] + (z - a).astype(np.uint64))
