"""Minimal perfect hashes over pairs of 64-bit hashes, and the second hash that makes a span's identity 128 bits.

Levels of bits: on each level every key left over hashes to a place of a table twice their number; the keys alone on
their place set its bit, the others go on to the next level. A key's slot is the number of bits set before its own.
Building and probing work on whole arrays. A key outside the set may land on any slot, so callers keep a fingerprint
or the key itself at the slot and compare.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from orfloom.llm.words import SLICE_BYTES, mix

_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_LETTERS = mix(np.arange(256, dtype=np.uint64), 77)
_powers: list[np.ndarray] = []


def second_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes that shares neither base nor letters with ``words.span_hashes``."""
    n = len(data) + 1
    if not _powers or len(_powers[0]) < n:
        grown = max(n, SLICE_BYTES + (1 << 16))
        ones, back = np.full(grown, _BASE), np.full(grown, _INVERSE)
        ones[0] = back[0] = 1
        _powers[:] = [np.multiply.accumulate(ones), np.multiply.accumulate(back)]
    up, down = _powers
    total = np.zeros(n, np.uint64)
    np.cumsum(_LETTERS[data] * up[: n - 1], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] ^ (ends - starts).astype(np.uint64), 9)
    if len(up) > 8 * SLICE_BYTES:  # tables grown for one very long text are not kept
        _powers.clear()
    return hashes


@dataclass
class PerfectHash:
    """``sizes``: bits of each level; ``bits``: all levels as 64-bit words; ``before``: bits set ahead of each word."""

    sizes: np.ndarray
    bits: np.ndarray
    before: np.ndarray

    def to_bytes(self) -> bytes:
        head = np.r_[len(self.sizes), self.sizes].astype(np.int64)
        return head.tobytes() + self.bits.tobytes()

    @staticmethod
    def from_bytes(blob: bytes) -> PerfectHash:
        words = np.frombuffer(blob, np.int64)
        levels = int(words[0])
        return _ranked(words[1 : 1 + levels], words[1 + levels :].view(np.uint64))

    def slots(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Slot of every key of the set; -1 or any slot for other keys."""
        found = np.full(len(first), -1, np.int64)
        left, base = np.arange(len(first)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            place = base + _places(first[left], second[left], level, int(size))
            word, bit = place >> 6, (place & 63).astype(np.uint64)
            block = self.bits[word]
            hit = (block >> bit) & np.uint64(1) == 1
            below = block & ((np.uint64(1) << bit) - np.uint64(1))
            found[left[hit]] = (self.before[word] + np.bitwise_count(below))[hit]
            left, base = left[~hit], base + int(size)
        return found


def _places(first: np.ndarray, second: np.ndarray, level: int, size: int) -> np.ndarray:
    spread = mix(first ^ mix(second, 2 * level + 1), 2 * level)
    return (((spread >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)


def _ranked(sizes: np.ndarray, bits: np.ndarray) -> PerfectHash:
    ones = np.bitwise_count(bits).astype(np.int64)
    return PerfectHash(np.asarray(sizes, np.int64), bits, np.r_[0, np.cumsum(ones)[:-1]] if len(bits) else ones)


def build(first: np.ndarray, second: np.ndarray) -> PerfectHash:
    """Perfect hash of distinct (first, second) pairs; fewer than 2^31 of them (a shard is far smaller)."""
    sizes, words = [], []
    while len(first):
        size = -(-2 * len(first) // 64) * 64
        place = _places(first, second, len(sizes), size)
        alone = np.bincount(place, minlength=size) == 1
        words.append(np.packbits(alone, bitorder="little").view(np.uint64))
        sizes.append(size)
        again = ~alone[place]
        first, second = first[again], second[again]
    return _ranked(np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, np.uint64))


def pair_order(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stable order, start of each run) that bring equal pairs together, sorted by ``first``."""
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(first, kind="stable")
    a, b = first[order], second[order]
    new = a[1:] != a[:-1]
    if np.any(~new & (b[1:] != b[:-1])):  # two keys share their first hash
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
        new = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.flatnonzero(np.r_[True, new])
