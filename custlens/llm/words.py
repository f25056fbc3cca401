"""Hashes of words, and of runs of words, of whole batches of texts at once."""

from __future__ import annotations

import numpy as np

M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
#: Bytes that part words: the six ASCII blanks; all ASCII but letters and digits.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, 9, 10, 11, 12, 13]] = True
MARKS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * M[0]
    h ^= h >> np.uint64(29)
    h *= M[1]
    return h ^ (h >> np.uint64(32))


def word_hashes(raw: np.ndarray, ends: np.ndarray, parting: np.ndarray = BLANKS):
    """Of each word of concatenated texts: hash, number of its text, start and end in ``raw``. ``ends``: ends of texts."""
    solid = ~parting[raw]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = ends[(ends > 0) & (ends < len(raw))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    length = stops - starts
    h = length.astype(np.uint64) * M[2]
    # eight bytes at a time; words longer than that go on in ever smaller sets
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    todo = np.arange(len(starts))
    at = starts
    while len(todo):
        left = stops[todo] - at
        part = np.ascontiguousarray(eight[at]).view("<u8")[:, 0].astype(np.uint64)
        short = np.minimum(left, 8).astype(np.uint64) * np.uint64(8)
        part = np.where(left >= 8, part, part & ((np.uint64(1) << (short & np.uint64(63))) - np.uint64(1)))
        h[todo] = mix(h[todo] + part * M[3])
        more = left > 8
        todo, at = todo[more], at[more] + 8
    return h, np.searchsorted(ends, starts, "right"), starts, stops


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words, by doubling."""
    of, size = {1: h}, 1
    while 2 * size <= n:
        of[2 * size] = joined(of[size], size, of[size])
        size *= 2
    out, done = of[size], size
    while done < n:
        while size > n - done:
            size //= 2
        out = joined(out, done, of[size])
        done += size
    return out


def joined(a: np.ndarray, words: int, b: np.ndarray) -> np.ndarray:
    """Hash of runs from those of their first ``words`` words and of the rest."""
    b = b[words:]
    return mix(a[:len(b)] * M[2] + b)


