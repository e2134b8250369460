"""A minimal perfect hash (hash and displace) over 64-bit keys, built and read with numpy."""

from __future__ import annotations

import numpy as np

from ._text import mix

_PER_CELL = 4


def _cells(n: int) -> int:
    return max(1, n // _PER_CELL)


def _place(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    return (mix(keys ^ (seeds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(n)).astype(np.int64)


def build(keys: np.ndarray) -> np.ndarray:
    """The displacements of distinct keys: slot() then maps the n keys one to one onto 0 to n - 1.

    Cells are placed from the fullest down, trying displacements; cells of one
    key take what is left and store their slot itself, as a negative number.
    """
    n = len(keys)
    cells = (mix(keys) % np.uint64(_cells(n))).astype(np.int64)
    order = np.argsort(cells, kind="stable")
    start = np.searchsorted(cells[order], np.arange(_cells(n) + 1))
    sizes = np.diff(start)
    seeds = np.zeros(_cells(n), np.int64)
    taken = np.zeros(n, bool)
    for cell in np.argsort(-sizes, kind="stable"):
        if sizes[cell] < 2:
            break
        own = keys[order[start[cell] : start[cell + 1]]]
        first = 1
        while True:
            tried = np.arange(first, first + 64)
            at = _place(own[None, :], tried[:, None], n)
            sort = np.sort(at, axis=1)
            good = ~taken[at].any(axis=1) & (sort[:, 1:] != sort[:, :-1]).all(axis=1)
            if good.any():
                best = int(np.argmax(good))
                seeds[cell] = tried[best]
                taken[at[best]] = True
                break
            first += 64
            if first > 1 << 24:
                raise ValueError("keys are not distinct")
    single = np.flatnonzero(sizes == 1)
    seeds[single] = -1 - np.flatnonzero(~taken)[: len(single)]
    return seeds


def slot(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    """The slot of each key; any slot for keys that are not among those of build()."""
    if not n:
        return np.zeros(len(keys), np.int64)
    seed = seeds[(mix(keys) % np.uint64(_cells(n))).astype(np.int64)]
    return np.where(seed < 0, -1 - seed, _place(keys, np.abs(seed), n))
