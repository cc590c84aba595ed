"""Words of whole texts as hashes, scanned with numpy over the bytes of Arrow columns."""

from __future__ import annotations

from functools import cache

import numpy as np
import xxhash

#: Bytes of a word that are hashed side by side, eight at a time; longer words are hashed one by one.
SHORT = 64
#: What is kept of eight bytes of which so many belong to a word.
KEEP = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


@cache
def classes(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(is word byte, value of byte) with A-Z lower-cased.

    "letters": digits, letters and bytes of characters beyond ASCII; "spaced": all but ASCII white space.
    """
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    word = np.ones(256, bool)
    if kind == "letters":
        word[:128] = False
        word[48:58] = word[97:123] = word[65:91] = True
    else:
        word[[32, *range(9, 14)]] = False
    return word, low


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased, and eight zeros after them."""
    out = np.zeros(len(data) + 8, np.uint8)
    np.take(classes("letters")[1], data, out=out[:-8])
    return out


def eight(low: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    windows = np.lib.stride_tricks.as_strided(low, (max(len(low) - 7, 0), 8), (1, 1))
    return windows[at].view("<u8").ravel()


def hashes(low: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of pieces of lower-cased bytes.

    Each eight bytes go through a bijection of the hash so far, so words of up to eight bytes and the
    same length never share a hash, and longer ones do so as if by chance, whatever pattern they follow.
    """
    h = mix(lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x1B873593 + seed))
    if not len(starts):
        return h
    h = mix(h ^ (eight(low, starts) & KEEP[np.minimum(lengths, 8)]))
    rest = np.flatnonzero((lengths > 8) & (lengths <= SHORT))
    at = 8
    while len(rest):
        h[rest] = mix(h[rest] * np.uint64(0xD6E8FEB86659FD93) ^ (eight(low, starts[rest] + at) & KEEP[np.minimum(lengths[rest] - at, 8)]))
        at += 8
        rest = rest[lengths[rest] > at]
    for i in np.flatnonzero(lengths > SHORT).tolist():
        h[i] = xxhash.xxh3_64_intdigest(low[starts[i] : starts[i] + lengths[i]].data, 42 + seed)
    return h


def equal(low: np.ndarray, starts: np.ndarray, other: np.ndarray, at_other: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether pieces of two buffers, of the same lengths, hold the same bytes."""
    same = np.ones(len(starts), bool)
    rest, at = np.flatnonzero((lengths > 0) & (lengths <= SHORT)), 0
    while len(rest):
        same[rest] &= (eight(low, starts[rest] + at) ^ eight(other, at_other[rest] + at)) & KEEP[np.minimum(lengths[rest] - at, 8)] == 0
        at += 8
        rest = rest[lengths[rest] > at]
    for i in np.flatnonzero(lengths > SHORT).tolist():
        n = lengths[i]
        same[i] = np.array_equal(low[starts[i] : starts[i] + n], other[at_other[i] : at_other[i] + n])
    return same


def spans(data: np.ndarray, offsets: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, starts, ends) of the words of texts that lie one after another in data; text i has words first[i] to first[i + 1]."""
    inside = classes(kind)[0][data]
    size = len(data)
    before, after = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
    before[1:size] = inside[: size - 1] if size else False
    after[: max(size - 1, 0)] = inside[1:]
    before[offsets] = False
    after[offsets[offsets > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before[:size])
    ends = np.flatnonzero(inside & ~after[:size]) + 1
    return np.searchsorted(starts, offsets), starts, ends


def scan(data: np.ndarray, offsets: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, hashes, starts, ends) of the words of texts, as in spans(); equal after lower-casing A-Z gives equal hashes."""
    first, starts, ends = spans(data, offsets, kind)
    return first, hashes(lowered(data), starts, ends - starts), starts, ends
