"""Words of many texts at once, as 64-bit hashes, without a Python step per word."""

from typing import NamedTuple

import numpy as np

STEP = 1 << 16
NEAR = 64
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32


class Words(NamedTuple):
    """buf: the lower-cased bytes of all texts; each word's start, end and hash; bounds[i]:bounds[i + 1] are text i's words."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random number for each byte at each of a word's first NEAR places; 0 for white space.
NUMBERS = mix(np.arange(1, NEAR * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
NUMBERS[np.tile(IS_SPACE, NEAR)] = 0


def _numbers(place: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """A random number for each byte at its place in its word."""
    cell = (place << 8) | byte
    out = NUMBERS.take(cell, mode="clip")
    far = np.flatnonzero(place >= NEAR)
    if len(far):
        out[far] = mix((cell[far].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) * ~IS_SPACE[byte[far]]
    return out


def words(texts: list[bytes]) -> Words:
    """Words of `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased.

    A word's hash is the sum of random numbers, one for each of its bytes at its place. Equal words have equal hashes; others
    differ but for chance (2^-64), as no algebra ties the numbers together. The numbers are added up STEP bytes at a time, so
    that what is held besides the words is little, however long a text or a word is.
    """
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    starts, ends, before = [], [], True
    low = np.empty(len(buf), np.uint8)
    for a in range(0, len(buf), STEP):
        np.take(TO_LOWER, buf[a : a + STEP], out=low[a : a + STEP])
        space = IS_SPACE[low[a : a + STEP]]
        changes = np.flatnonzero(space != np.concatenate([[before], space[:-1]]))
        opens = ~space[changes]
        starts.append(changes[opens] + a)
        ends.append(changes[~opens] + a)
        before = space[-1]
    start, end = np.concatenate([np.zeros(0, np.int64), *starts]), np.concatenate([np.zeros(0, np.int64), *ends])
    h = np.zeros(len(start), np.uint64)
    for a in range(0, len(low), STEP):
        b = min(len(low), a + STEP)
        first, last = np.searchsorted(end, a, side="right"), np.searchsorted(start, b)  # words with bytes in a:b
        if first == last:
            continue
        begins, past = np.maximum(start[first:last], a), min(end[last - 1], b)
        place = np.arange(begins[0], past) - np.repeat(start[first:last], np.diff(begins, append=past))  # of the space after a word too
        h[first:last] += np.add.reduceat(_numbers(place, low[begins[0] : past]), begins - begins[0])
    h = mix(h + (end - start).astype(np.uint64))
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    return Words(low, start, end, h, np.searchsorted(start, offsets))
