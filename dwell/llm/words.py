"""Vectorised word splitting and hashing of one text (numpy, used inside tasks).

A text is its UTF-8 bytes. Words are maximal runs of bytes of a class given by a 256-entry table.
Every character class used here holds all bytes above 0x7F or none, so byte runs equal the
character runs of the corresponding regular expression.

Hashes are 64-bit and depend on a word's bytes alone: equal words have equal hashes everywhere;
different words collide with probability 2^-64 a pair.
"""

from __future__ import annotations

import numpy as np
import xxhash

LONG_WORD = 1024  # longer words are hashed by xxhash
PIECE = 1 << 14   # bytes hashed at a time


def _table(members: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


#: [^\x20\x09-\x0D]+
NOT_SPACE = ~_table(b" \t\n\x0b\x0c\r")
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = _table(bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)))
#: A-Z to a-z, every other byte as it is
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(seed: int, n: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    return mix(steps) | np.uint64(1)


BYTE_CODE = constants(11, 256)
STEP_CODE = constants(13, 64)
_STEP = 0xD6E8FEB86659FD93
POWER = np.multiply.accumulate(np.append(np.uint64(1), np.full(PIECE, _STEP, dtype=np.uint64)))
INVERSE = np.multiply.accumulate(np.append(np.uint64(1), np.full(PIECE, pow(_STEP, -1, 1 << 64), dtype=np.uint64)))


def as_bytes(raw: bytes | None, lower: bool = False) -> np.ndarray:
    """Null is the empty text."""
    b = np.frombuffer(raw or b"", dtype=np.uint8)
    return LOWER[b] if lower else b


def bounds(b: np.ndarray, word_byte: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of each word."""
    edge = np.flatnonzero(np.diff(word_byte[b], prepend=False, append=False))
    return edge[::2], edge[1::2]


def word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial over a word's bytes, from running sums over pieces of the text."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + PIECE, side="right")))
        piece = b[base:min(ends[j - 1], base + PIECE)]
        run = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(BYTE_CODE[piece] * POWER[:len(piece)], out=run[1:])
        first = starts[i:j] - base
        out[i:j] = (run[np.minimum(ends[i:j] - base, len(piece))] - run[first]) * INVERSE[first]
        i = j
    lens = ends - starts
    out = mix(out + lens.astype(np.uint64))
    for i in np.flatnonzero(lens > LONG_WORD):
        out[i] = xxhash.xxh64_intdigest(b[starts[i]:ends[i]].tobytes())
    return out


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` words; fewer words: the whole sequence as one; none: none."""
    n = len(h)
    if n == 0:
        return h
    width = min(n, size)
    total = np.zeros(n - width + 1, dtype=np.uint64)
    for j in range(width):
        total = total + h[j:n - width + 1 + j] * STEP_CODE[j]
    return mix(total + np.uint64(width))
