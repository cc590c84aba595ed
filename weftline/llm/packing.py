"""Numbers in as many bytes of seven bits as each needs."""

from __future__ import annotations

import numpy as np

LIMITS = [1 << 7 * k for k in range(1, 9)]


def packed_numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends): numbers below 2^56 one after another, and where each ends; all bytes of a number but its last have the upper bit."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for limit in LIMITS[:7]:
        more = values >= limit
        if not more.any():
            break
        sizes += more
    ends = np.cumsum(sizes)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    begins = ends - sizes
    for k in range(int(sizes.max(initial=0))):
        some = np.flatnonzero(sizes > k)
        part = (values[some] >> np.uint64(7 * k)) & np.uint64(127)
        out[begins[some] + k] = part | (sizes[some] > k + 1).astype(np.uint64) << np.uint64(7)
    return out, ends


def unpacked_numbers(data: np.ndarray) -> np.ndarray:
    """The numbers that packed_numbers() wrote."""
    last = data < 128
    ends = np.flatnonzero(last) + 1
    if len(ends) == len(data):
        return data.astype(np.int64)
    begins = np.concatenate(([0], ends[:-1]))
    place = np.arange(len(data)) - np.repeat(begins, ends - begins)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), begins)
