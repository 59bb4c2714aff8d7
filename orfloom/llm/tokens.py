"""Token ids of whole text columns for the byte-level BPE vocabulary, each distinct piece encoded once.

The vocabulary's split pattern is applied to all bytes of a slice with array operations; pieces are hashed, and
only pieces that the task has not met are given to the encoder. Texts with characters outside ASCII and the
letters U+00C0-U+00FF (where character classes are not plain from the bytes) are encoded whole by the encoder, and
texts with an added token of the vocabulary (``<|endoftext|>``) by the tokenizer file itself, which gives it its own id.
"""

from __future__ import annotations

import base64
import json
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa

from orfloom.llm.words import slices, span_hashes

CACHE_PIECES = 1_500_000

_LETTER, _DIGIT, _SPACE, _OTHER = 0, 1, 2, 3
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[np.r_[65:91, 97:123, 128:256]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_ODD = np.zeros(256, bool)
_ODD[np.r_[28:32, 0xC0:0xC3, 0xC4:0x100]] = True
APOSTROPHE = 39


@lru_cache(maxsize=2)
def encoder(path: str):
    """Encoder over the rank file at ``path``: the same ids as the tokenizer file of the same vocabulary."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """(tokenizer, its added tokens as bytes) of the tokenizer file beside the rank file at ``path``."""
    from tokenizers import Tokenizer

    beside = path.removesuffix(".tiktoken") + ".json"
    with open(beside, encoding="utf-8") as file:
        added = [token["content"].encode() for token in json.load(file)["added_tokens"]]
    return Tokenizer.from_file(beside), added


def rows_with(data: np.ndarray, offsets: np.ndarray, needles: list[bytes]) -> set[int]:
    """Rows in whose text one of the byte strings stands."""
    raw, found = data.tobytes(), set()
    for needle in needles:
        at = raw.find(needle)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, "right")) - 1
            if at + len(needle) <= offsets[row + 1]:
                found.add(row)
                at = raw.find(needle, int(offsets[row + 1]))
            else:  # from the end of one text into the next
                at = raw.find(needle, at + 1)
    return found


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Start of every piece of the split pattern, for texts of plain characters."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = _CLASS[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    first = first[:n]
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change |= first
    start = change.copy()
    # the last character of white space before something else is a piece of its own, or leads it if it is a blank
    following = np.zeros(n, bool)
    following[:-1] = (kind[1:] != _SPACE) & ~first[1:]
    space = kind == _SPACE
    last = space & following
    start |= last
    lead = last & (data == 32)
    start[1:] &= ~lead[:-1]
    # contractions: an apostrophe that starts a piece takes one of the fixed endings with it
    marks = np.flatnonzero((data == APOSTROPHE) & start)
    if len(marks):
        text_end = offsets[np.searchsorted(offsets, marks, "right")]
        padded = np.r_[data, np.zeros(2, np.uint8)]
        one, two = padded[marks + 1], padded[marks + 2]
        single = np.isin(one, np.frombuffer(b"stmd", np.uint8)) & (marks + 1 < text_end)
        pair = one.astype(np.int64) * 256 + two
        double = np.isin(pair, [a * 256 + b for a, b in (b"re", b"ve", b"ll")]) & (marks + 2 < text_end)
        width = np.where(single, 2, np.where(double, 3, 0))
        hit = width > 0
        start[marks[hit] + 1] = False
        after = (marks + width)[hit]
        inside = after < text_end[hit]
        start[after[inside]] = True
        three = marks[hit & (width == 3)]
        start[three + 2] = False
    return np.flatnonzero(start)


class Pieces:
    """Ids of pieces met so far by a worker; emptied when it holds more than ``CACHE_PIECES``."""

    def __init__(self, path: str):
        self.path = path
        self.clear()

    def clear(self) -> None:
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        encode = encoder(self.path).encode_ordinary
        ids = [encode(p) for p in pieces]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        slots = len(self.sizes) + np.arange(len(ids))
        starts = len(self.flat) + np.cumsum(sizes) - sizes
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))])
        self.starts, self.sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes])
        order = np.argsort(hashes)
        places = np.searchsorted(self.hashes, hashes[order])
        self.hashes = np.insert(self.hashes, places, hashes[order])
        self.slots = np.insert(self.slots, places, slots[order])

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids in order, number of ids per span, hash per span)."""
        hashes = span_hashes(data, starts, ends)
        back, distinct = pd.factorize(hashes)
        if len(self.hashes) > CACHE_PIECES:
            self.clear()
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == distinct[inside]
        if not known.all():
            where = np.empty(len(distinct), np.int64)
            where[back[::-1]] = np.arange(len(back) - 1, -1, -1)
            raw, new = data.tobytes(), where[~known]
            self._learn(distinct[~known], [raw[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            at = np.searchsorted(self.hashes, distinct)
        slot = self.slots[at][back]
        sizes = self.sizes[slot]
        begin = np.repeat(self.starts[slot] - (np.cumsum(sizes) - sizes), sizes)
        return self.flat[begin + np.arange(len(begin))], sizes, hashes


@lru_cache(maxsize=2)
def worker_pieces(path: str) -> Pieces:
    """The cache of this worker process, which runs one task at a time."""
    return Pieces(path)


def encode_column(texts: pa.Array, pieces: Pieces):
    """(row, ids, hashes of its pieces) for every row; a null text is empty."""
    for first, end, data, offsets in slices(texts):
        n = end - first
        odd = _ODD[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        odd[lead] |= np.isin(data[lead + 1], (0x97, 0xB7))
        odd_rows = np.unique(np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1)
        starts = piece_starts(data, offsets)
        ends = np.r_[starts[1:], len(data)][: len(starts)]
        ids, sizes, hashes = pieces.ids(data, starts, ends) if len(starts) else (np.zeros(0, np.uint32), starts, starts.astype(np.uint64))
        piece_cuts = np.searchsorted(starts, offsets)
        id_cuts = np.r_[0, np.cumsum(sizes)][piece_cuts]
        by_hand = set(odd_rows.tolist())
        whole, added = tokenizer(pieces.path)
        with_added = rows_with(data, offsets, added)
        for r in range(n):
            if r in with_added:
                text = data[offsets[r] : offsets[r + 1]].tobytes().decode()
                own = np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)
            elif r in by_hand:
                own = np.array(
                    encoder(pieces.path).encode_ordinary(data[offsets[r] : offsets[r + 1]].tobytes().decode()), np.uint32
                )
            else:
                own = ids[id_cuts[r] : id_cuts[r + 1]]
            yield first + r, own, hashes[piece_cuts[r] : piece_cuts[r + 1]]
