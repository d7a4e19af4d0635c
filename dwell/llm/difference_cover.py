"""Suffix order of a text by the difference cover modulo 3 (numpy, used inside tasks)."""

from __future__ import annotations

import numpy as np

BITS = 21                      # symbols and ranks are packed three to a 64-bit key
MOST = (1 << BITS) - 4         # longest text for that; beyond, pairs of symbols are named first


def _names(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Rank of each key among the distinct keys, from 1."""
    order = np.argsort(keys)
    new = np.empty(len(keys), dtype=np.int64)
    ranked = keys[order]
    new[order] = np.cumsum(np.concatenate(([1], ranked[1:] != ranked[:-1])))
    return new, int(new[order[-1]])


def suffix_order(text: np.ndarray, depth: int, covers: int = 1) -> np.ndarray:
    """Starts of all suffixes of ``text`` (symbols from 1), in an order that agrees with their first
    ``depth`` characters; a symbol stands for ``covers`` characters.

    The suffixes that start at 1 or 2 modulo 3 are sampled; their triples are sorted and named. While
    names repeat and are shorter than ``depth``, the string of names is ordered recursively. The
    suffixes at 0 modulo 3 then follow from their first symbol and the sampled rank behind it, and
    both orders are merged by ranking each sampled suffix among the others."""
    n = len(text)
    s = np.concatenate((text, np.zeros(4, dtype=np.int64)))
    if n <= MOST:
        bits, pair = BITS, s[:-1] << BITS | s[1:]
    else:
        bits, pair = 31, _names(s[:-1] << 31 | s[1:])[0]
    ones, twos = np.arange(1, n + 1, 3), np.arange(2, n, 3)  # up to n: a sampled position behind every 0 modulo 3
    sampled = np.concatenate((ones, twos))
    names, most = _names(pair[sampled] << bits | s[sampled + 2])
    if most < len(sampled) and 3 * covers < depth:
        order = suffix_order(names, depth, 3 * covers)
        names[order] = np.arange(1, len(order) + 1)
    else:
        order = np.argsort(names, kind="stable")
    rank = np.zeros(n + 4, dtype=np.int64)
    rank[sampled] = names
    sampled = sampled[order]
    sampled = sampled[sampled < n]

    def by_one(i: np.ndarray) -> np.ndarray:
        return s[i] << bits | rank[i + 1]

    def by_two(i: np.ndarray) -> np.ndarray:
        return pair[i] << bits | rank[i + 2]

    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(by_one(rest))]
    one = sampled % 3 == 1
    below = np.empty(len(sampled), dtype=np.int64)
    below[one] = np.searchsorted(by_one(rest), by_one(sampled[one]))
    below[~one] = np.searchsorted(by_two(rest), by_two(sampled[~one]))
    out = np.empty(n, dtype=np.int64)
    place = np.arange(len(sampled)) + np.maximum.accumulate(below) if len(sampled) else below
    out[place] = sampled
    left = np.ones(n, dtype=bool)
    left[place] = False
    out[left] = rest
    return out
