"""Grids of pixels as arrays, many images at once; used within Arrow steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def listed(column: pa.ListArray, *fields: str) -> tuple[np.ndarray, ...]:
    """Of a column of lists of structs the row that each element is from, and the fields, as flat arrays."""
    flat = column.flatten()
    row = np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return (row, *(flat.field(f).to_numpy(zero_copy_only=False) for f in fields))


def places(image: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers of pixels that rise with image, y and x, and what a step of y adds; a step of x adds one. Gaps between the values in use count as two, so numbers stay small."""

    def close(v):
        own, at = np.unique(v, return_inverse=True)
        to = np.cumsum(np.concatenate([[1], np.minimum(np.diff(own), 2)]))
        return to[at], int(to[-1]) + 2

    if not len(x):
        return np.zeros(0, dtype=np.int64), 1
    (rows, height), (columns, width) = close(y.astype(np.int64)), close(x.astype(np.int64))
    return (image.astype(np.int64) * height + rows) * width + columns, width


def neighbours(place: np.ndarray, width: int, steps: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of neighbouring pixels of sorted places, a pair for each step (dx, dy) that leads to one; of equal places the last counts."""
    first, second = [], []
    last = np.flatnonzero(np.append(place[1:] != place[:-1], True)) if len(place) else np.zeros(0, dtype=int)
    for dx, dy in steps:
        to = place[last] + dy * width + dx
        at = np.searchsorted(place, to, side="right") - 1
        hit = (at >= 0) & (place[at] == to)
        first.append(last[hit])
        second.append(at[hit])
    return np.concatenate(first), np.concatenate(second)


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n is linked with by the edges (a, b)."""
    up = np.arange(n)
    while True:
        p, q = up[a], up[b]
        open_ = p != q
        if not open_.any():
            return up
        np.minimum.at(up, np.maximum(p, q)[open_], np.minimum(p, q)[open_])
        while True:
            far = up[up]
            if (far == up).all():
                break
            up = far
