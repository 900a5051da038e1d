"""Word-shingle sets and their minwise sketches, per text."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import xxhash

#: Minwise values in a sketch, which trees branch by, and those of them whose low bits are compared.
COORDINATES, COMPARED = 128, 64

_TILE = 4096


@functools.cache
def _constants() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20_240_229))
    multiply = rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    scale = (rng.integers(0, 1 << 31, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)
    shift = rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint64).astype(np.uint32)
    return multiply, scale, shift


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of `width` words.

    A-Z are lower-cased; ASCII white space separates words. With fewer words
    the whole sequence is one shingle; without words the set is empty.
    """
    words = text.encode().lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if not len(h):
        return h
    width = min(width, len(h))
    n = len(h) - width + 1
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total += h[k : k + n] * _constants()[0][k]
    return np.unique(mix(total))


def set_key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def sketch(hashes: np.ndarray) -> np.ndarray:
    """One minimum per coordinate over the set (of at least one element)."""
    _, scale, shift = _constants()
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(high), _TILE):
        values = scale[:, None] * high[None, at : at + _TILE] + shift[:, None]
        np.minimum(least, values.min(1), out=least)
    return least


def nibbles(sketches: np.ndarray) -> np.ndarray:
    """Four bits of each compared coordinate, two coordinates to a byte: (n, COMPARED / 2)."""
    low = (sketches[:, :COMPARED] & np.uint32(15)).astype(np.uint8)
    return low[:, ::2] << 4 | low[:, 1::2]


#: Equal nibbles of two bytes, by their XOR.
_EQUAL = ((np.arange(256) >> 4 == 0).astype(np.uint8) + (np.arange(256) % 16 == 0)).astype(np.uint8)


def similarity(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity from nibbles; chance agreement of four bits is taken off."""
    agree = _EQUAL[one ^ others].sum(-1, dtype=np.int32) / COMPARED
    return (agree - 1 / 16) / (1 - 1 / 16)
