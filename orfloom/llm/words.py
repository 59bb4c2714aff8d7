"""Words of a whole Arrow column at once: spans, 64-bit hashes and shingles, without a Python object per word.

Words are runs of characters other than space and U+0009-U+000D. All work is on the UTF-8 bytes of a slice
of at most ``SLICE_BYTES`` (one longer text is a slice of its own), so memory does not follow the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64-bit result (wrapping arithmetic)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive slices; a null text is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        end = min(end, len(texts))
        own = offsets[start : end + 1]
        yield start, end, data[own[0] : own[-1]], own - own[0]
        start = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word, in order; words never cross a text boundary."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    solid = np.zeros(len(data) + 2, bool)
    np.logical_not(_SPACE[data], out=solid[1:-1])
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span, from one running polynomial sum over all bytes."""
    n = len(data) + 1
    if not _powers or len(_powers[0]) < n:
        grown = max(n, SLICE_BYTES + (1 << 16))
        ones = np.full(grown, _BASE)
        ones[0] = 1
        back = np.full(grown, _INVERSE)
        back[0] = 1
        _powers[:] = [np.multiply.accumulate(ones), np.multiply.accumulate(back)]
    up, down = _powers
    total = np.zeros(n, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: n - 1], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    if len(up) > 8 * SLICE_BYTES:  # tables grown for one very long text are not kept
        _powers.clear()
    return hashes


def shingle_sets(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of ``size``-word shingles; fewer words are one shingle; no word, no shingle."""
    if len(words) == 0:
        return words
    n = max(1, len(words) - size + 1)
    out = np.full(n, np.uint64(min(len(words), size)))
    for k in range(min(size, len(words))):
        out = mix(out ^ words[k : k + n], k)
    return np.unique(out)
