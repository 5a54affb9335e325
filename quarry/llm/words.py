"""Hashes of the words of texts, for a batch of texts at a time, without a Python object for each word.

A word is a run of bytes other than white space, A-Z in lower case. Its hash is a polynomial over random 64-bit numbers
for its bytes, read off running sums over the whole batch, and mixed with its length. Words longer than LONG bytes are
hashed one by one, so that a text without white space needs no powers beyond a piece.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

from .common import SPACE_BYTES

#: Bytes of the longest word that is hashed by its polynomial, and about so many that are worked on at a time.
LONG = 4096
PIECE = 1 << 20

_rng = np.random.default_rng(20_240_229)
_BYTES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = int(_rng.integers(1 << 40, 1 << 62)) * 2 + 1
_M1, _M2, _LENGTH = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of P and of its inverse, modulo 2^64."""
    inverse = pow(_P, -1, 1 << 64)
    up, down = np.full(n, _P, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _pieces(data: bytes) -> list[bytes]:
    """``data`` cut after white space into pieces of about PIECE bytes; a longer word is in one piece."""
    out, at = [], 0
    while len(data) - at > PIECE:
        before = max(data.rfind(bytes([c]), at, at + PIECE) for c in SPACE_BYTES)
        if before < 0:
            before = min((x for c in SPACE_BYTES if (x := data.find(bytes([c]), at + PIECE)) >= 0), default=len(data) - 1)
        out.append(data[at : before + 1])
        at = before + 1
    return [*out, data[at:]] if at < len(data) else out


def _of_piece(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places where the words of a piece start, and their hashes."""
    raw = np.frombuffer(data, np.uint8)
    blank = np.ones(len(raw) + 2, bool)
    blank[1:-1] = _SPACE[raw]
    start, stop = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
    sizes = stop - start
    long = np.flatnonzero(sizes > LONG)
    if len(raw) <= 2 * PIECE:
        up, down = _powers(2 * PIECE)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[raw] * up[: len(raw)], out=sums[1:])
        found = mix((sums[stop] - sums[start]) * down[start] + sizes.astype(np.uint64) * _LENGTH)
    else:  # one long word, and what is left of a piece beside it
        found = np.zeros(len(start), np.uint64)
        for i in np.flatnonzero(sizes <= LONG).tolist():
            found[i] = _of_piece(data[start[i] : stop[i]])[1][0]
    for i in long.tolist():
        found[i] = xxhash.xxh3_64_intdigest(data[start[i] : stop[i]])
    return start, found


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (64 bits, unsigned) of all words of the texts in order, and offsets: text i has words offsets[i]:offsets[i + 1]."""
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    starts, found, at = [], [], 0
    for piece in _pieces(b"\n".join([*texts, b""]).lower()):
        s, h = _of_piece(piece)
        starts.append(s + at)
        found.append(h)
        at += len(piece)
    where = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.searchsorted(where, ends)])
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), offsets
