"""Hashes of words and of runs of words, a whole group of texts at a time in numpy.

A word's hash takes its bytes eight at a time, each step mixing what came
before, so that no pattern of bytes cancels out; very long words go to BLAKE2b.
:func:`chained` hashes short windows of words in the same way. ``Runs`` hashes
runs of any length as polynomials in their items' hashes modulo 2^64: prefix
sums give any run's value by one subtraction and a multiplication by the inverse
power of its start, so every window costs the same however long it is. Patterns
of two words can lower the strength of such a value; what stands on it is
compared by the very words afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

#: Bytes of texts that are hashed at a time; longer texts go in pieces that end at white space.
GROUP = 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """The finishing steps of splitmix64."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Bytes of a word from which on BLAKE2b hashes it; masks of the first n of eight bytes.
LONG = 256
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, GROUP + 4096)
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


class Runs:
    """Hashes of runs of ``items`` (uint64)."""

    def __init__(self, items: np.ndarray, salt: int = 0):
        self.salt = salt
        self.up, self.down = powers(len(items) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(items) + 1, np.uint64)
            np.cumsum((mixed(items, salt) if salt else items) * self.up[: len(items)], dtype=np.uint64, out=self.sums[1:])

    def of(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[stops] - self.sums[starts]) * self.down[starts] + (stops - starts).astype(np.uint64), self.salt)


def chained(items: np.ndarray, starts: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hashes of the ``k`` items from each start on, mixed one by one."""
    with np.errstate(over="ignore"):
        h = np.full(len(starts), k, np.uint64)
        for j in range(k):
            h = mixed(h * _BASE + items[starts + j], salt)
        return h


def _span_hashes(buffer: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hashes of spans of bytes."""
    padded = np.zeros(len(buffer) + 8, np.uint8)
    padded[: len(buffer)] = buffer
    eight = np.ndarray(len(buffer) + 1, "<u8", padded, 0, (1,))  # the eight bytes from each place on
    left = stops - starts
    h = mixed(left.astype(np.uint64), 7)
    live = np.flatnonzero(left < LONG) if len(left) and left.max() >= LONG else np.arange(len(left))
    for i in np.flatnonzero(left >= LONG):
        h[i] = int.from_bytes(hashlib.blake2b(padded[starts[i] : stops[i]].tobytes(), digest_size=8).digest(), "little")
    at, left = starts[live], left[live]
    while len(live):
        with np.errstate(over="ignore"):
            h[live] = mixed(h[live] * _BASE + (eight[at] & _FIRST[np.minimum(left, 8)]), 7)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return h


def _words(data: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of ``data``."""
    buffer = np.frombuffer(data, np.uint8)
    if lower:
        buffer = _LOWER[buffer]
    space = np.empty(len(buffer) + 2, bool)
    space[0] = space[-1] = True
    space[1:-1] = _SPACE[buffer]
    edges = np.flatnonzero(space[1:] != space[:-1])
    return _span_hashes(buffer, edges[::2], edges[1::2]), edges[::2]


def _pieces(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > GROUP:
        end = at + GROUP
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def word_hashes(texts: list[bytes], lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Groups of texts: index of the first and past the last, hashes of all their words, and each text's first word (one more at the end)."""
    first = 0
    while first < len(texts):
        last, size = first + 1, len(texts[first])
        while last < len(texts) and size + len(texts[last]) < GROUP:
            size += len(texts[last]) + 1
            last += 1
        if size > GROUP:
            hashes = np.concatenate([_words(p, lower)[0] for p in _pieces(texts[first])])
            yield first, last, hashes, np.array([0, len(hashes)])
        else:
            hashes, at = _words(b"\n".join(texts[first:last]), lower)
            begins = np.cumsum([0, *(len(t) + 1 for t in texts[first:last])])
            yield first, last, hashes, np.searchsorted(at, begins)
        first = last
