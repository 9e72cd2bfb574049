"""Words and word shingles of whole texts as 64-bit hashes, computed for a slice of documents at once in numpy.

A word's hash is a polynomial over random values of its bytes, followed by a mixer; a shingle's is a polynomial over
its words. Two different words or shingles share a hash with a chance near 2**-64.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.RandomState(20240229)
_BYTE = _rng.randint(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33, _S29 = np.uint64(33), np.uint64(29)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words by white space: everything but 09-0D and 20.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Words of ASCII letters (lower-cased before), ASCII digits and all that isn't ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_powers = np.ones(1, np.uint64)


def _pow(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        steps = np.full(max(n, 4096), _BASE, np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            _powers = np.multiply.accumulate(steps)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _S33)) * _M1
        x = (x ^ (x >> _S29)) * _M2
        return x ^ (x >> _S33)


def word_hashes(data: np.ndarray, at: np.ndarray, word: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words in order, where each document's words begin (one entry more than documents), and the words' first bytes."""
    low = LOWER[data]
    inside = word[low]
    before = np.empty(len(inside), bool)
    if len(before):
        before[0] = False
        before[1:] = inside[:-1]
        before[at[:-1][at[:-1] < len(inside)]] = False
    first = np.flatnonzero(inside & ~before)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64), first
    length = np.diff(np.append(np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])[first], np.count_nonzero(inside)))
    rank = np.cumsum(length) - length
    place = np.arange(rank[-1] + length[-1], dtype=np.int32) - np.repeat(rank.astype(np.int32), length)
    with np.errstate(over="ignore"):
        total = np.add.reduceat(_BYTE[low[inside]] * _pow(int(length.max()))[place], rank)
        return mix(total + length.astype(np.uint64) * _STEP), np.searchsorted(first, at), first


def shingle_hashes(words: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles, in order, with where each document's begin; a document of fewer words, if any, has the whole of them as one."""
    count = np.diff(of)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(len(of), np.int64)
    own = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(own)])
    with np.errstate(over="ignore"):
        start = np.repeat(of[:-1] - at[:-1], own) + np.arange(at[-1])
        short = np.repeat(np.where(count < n, count, n), own)
        total = words[start].copy()
        for k in range(1, n):
            more = short > k
            follow = words[np.minimum(start + k, len(words) - 1)]
            total = np.where(more, total * _STEP + follow, total)
        return mix(total + short.astype(np.uint64) * _BASE), at
