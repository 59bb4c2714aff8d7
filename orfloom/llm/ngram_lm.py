"""Language-model scoring with an n-gram trie of Elias-Fano levels in memory-mapped files.

Level 1 holds the distinct words (as 64-bit hashes) in shards by hash, with their exact counts. Level 2 holds the
successors of every context word: a successor is stored relative to its context, as ``context id * 2^b + word id``,
so the level is one monotone sequence, and its entries carry interpolated absolute-discount probabilities
quantised to 8 bits. Pointers into level 2 are a monotone sequence per context as well. Counting and building run in
Spark tasks; every shard of a level is one file in the shared folder, bounded by its share of the input, which
readers map into memory and never load. Successors are found by Elias-Fano search on the context-relative key.

p(w | c) = max(n(c w) - D, 0) / n(c) + D * types(c) / n(c) * p(w), with p(w) = (n(w) + 1) / (N + V + 1).
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orfloom.llm.packed import PACKED, packed_rows, shard_count, unpack_bytes, unpack_sorted
from orfloom.llm.words import lower_ascii, mix, slices, span_hashes, word_spans
from orfloom.session import cut_lineage, scratch_dir

END = np.uint64(0x5EED0FE7D)  # hash of the end token, which also stands before the first word
DISCOUNT = 0.75
LOWEST = -12.0  # log10 probabilities are quantised to 256 steps between this and 0
FLUSH = 4_000_000


# ---- Elias-Fano ---------------------------------------------------------------------------------------------

def ef_arrays(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Elias-Fano form of a sorted uint64 sequence: low bits in the narrowest type, high bits in unary, a directory."""
    n = len(values)
    low_bits = max(0, int(universe // max(1, n)).bit_length() - 1)
    kind = next(t for t, w in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if low_bits <= w)
    high = (values >> np.uint64(low_bits)).astype(np.int64)
    size = n + (universe >> low_bits) + 2
    bits = np.zeros(-(-size // 64) * 64, np.uint8)
    bits[high + np.arange(n)] = 1
    words = np.packbits(bits, bitorder="little").view(np.uint64)
    zeros = np.r_[0, np.cumsum(64 - np.bitwise_count(words).astype(np.int64))].astype(np.uint64)
    mask = np.uint64((1 << low_bits) - 1)
    return {
        "meta": np.array([n, low_bits], np.int64), "low": (values & mask).astype(kind), "high": words, "zeros": zeros,
    }


def _select_in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the ``rank``-th set bit (from 0) of every word."""
    place, rank = np.zeros(len(words), np.uint64), rank.astype(np.int64).copy()
    for width in (32, 16, 8, 4, 2, 1):
        low = words & np.uint64((1 << width) - 1)
        ones = np.bitwise_count(low).astype(np.int64)
        up = rank >= ones
        rank -= np.where(up, ones, 0)
        words = np.where(up, words >> np.uint64(width), low)
        place += np.where(up, np.uint64(width), np.uint64(0))
    return place.astype(np.int64)


def ef_bucket_start(ef: dict[str, np.ndarray], bucket: np.ndarray) -> np.ndarray:
    """Number of entries whose high part is below ``bucket``: position of its preceding zero, less the zeros."""
    zero = np.maximum(bucket - 1, 0)
    word = np.searchsorted(ef["zeros"], zero.astype(np.uint64), "right") - 1
    place = word * 64 + _select_in_word(~ef["high"][word], zero - ef["zeros"][word].astype(np.int64))
    return np.where(bucket > 0, place - zero, 0)


def ef_find(ef: dict[str, np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """Position of every wanted value, -1 where absent: successor search among the low bits of its bucket."""
    n, low_bits = int(ef["meta"][0]), int(ef["meta"][1])
    if not n or not len(wanted):
        return np.full(len(wanted), -1, np.int64)
    bucket = (wanted >> np.uint64(low_bits)).astype(np.int64)
    low = (wanted & np.uint64((1 << low_bits) - 1)).astype(ef["low"].dtype)
    known = bucket < int(ef["zeros"][-1]) - 1
    bucket = np.where(known, bucket, 0)
    a, end = ef_bucket_start(ef, bucket), ef_bucket_start(ef, bucket + 1)
    b = end.copy()
    while True:
        open_ = np.flatnonzero(a < b)
        if not len(open_):
            break
        middle = (a[open_] + b[open_]) >> 1
        less = ef["low"][middle] < low[open_]
        a[open_] = np.where(less, middle + 1, a[open_])
        b[open_] = np.where(less, b[open_], middle)
    hit = known & (a < end)
    hit[hit] = ef["low"][a[hit]] == low[hit]
    return np.where(hit, a, -1)


# ---- files --------------------------------------------------------------------------------------------------

def write_level(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file with all arrays; written under a name of its own first, so that a repeated task does no harm."""
    head, at = [], 0
    for key, a in arrays.items():
        head.append((key, a.dtype.str, len(a), at))
        at += -(-a.nbytes // 64) * 64
    header = repr(head).encode().ljust(4096)
    fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
    fs.create_dir(root, recursive=True)
    own = f"{root}/.{name}.{os.urandom(6).hex()}"
    with fs.open_output_stream(own) as out:
        out.write(header)
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).tobytes())
            out.write(b"\0" * (-a.nbytes % 64))
    fs.move(own, f"{root}/{name}")


@lru_cache(maxsize=4096)
def mapped_level(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory: in place where the shared folder is mounted, else from a copy
    that has no name any more once it is open, so nothing is left behind."""
    import ast

    fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
    if isinstance(fs, pafs.LocalFileSystem):
        raw = np.memmap(f"{root}/{name}", np.uint8, "r")
    else:
        with tempfile.TemporaryFile() as copy, fs.open_input_stream(f"{root}/{name}") as source:
            while block := source.read(1 << 22):
                copy.write(block)
            copy.flush()
            raw = np.memmap(copy, np.uint8, "r")
    head = ast.literal_eval(raw[:4096].tobytes().decode().strip())
    return {
        key: raw[4096 + at : 4096 + at + count * np.dtype(kind).itemsize].view(kind) for key, kind, count, at in head
    }


# ---- tokens -------------------------------------------------------------------------------------------------

def token_stream(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, token hash, context hash, row) of slices: words, then one end for every text."""
    for first, end, data, offsets in slices(texts):
        n = end - first
        data = lower_ascii(data)
        starts, ends, rows = word_spans(data, offsets)
        places = np.arange(len(starts)) + rows  # every earlier text has one end
        tokens = np.full(len(starts) + n, END)
        tokens[places] = span_hashes(data, starts, ends)
        owner = np.empty(len(tokens), np.int64)
        owner[places] = rows
        is_end = np.ones(len(tokens), bool)
        is_end[places] = False
        owner[is_end] = np.arange(n)
        yield first, end, tokens, np.r_[END, tokens[:-1]], owner


def _shards_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(40)).astype(np.int64) * shards) >> 24


def _add_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[cuts], np.add.reduceat(counts, cuts) if len(cuts) else counts


def _counted(stream, flush: int = FLUSH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sorted keys, counts): combined over a task, or over ``flush`` distinct keys of it."""
    parts, held = [], 0
    for keys in stream:
        parts.append(tuple(np.unique(keys, return_counts=True)))
        held += len(parts[-1][0])
        if held >= flush:
            parts = [_add_up(parts)]
            held = len(parts[0][0])
            if held >= flush // 2:
                yield parts[0]
                parts, held = [], 0
    if parts:
        yield _add_up(parts)


_PACKED_ARROW = pa.schema(
    [("shard", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("vals", pa.binary()), ("tag", pa.int64())]
)


def _word_rows(shards: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (tokens for batch in batches for _, _, tokens, _, _ in token_stream(batch.column(0)))
        for keys, counts in _counted(stream):
            yield pa.RecordBatch.from_pydict(
                packed_rows(_shards_of(keys, shards), keys, counts.astype(np.uint64), 0), _PACKED_ARROW
            )

    return rows


def _word_level(folder: str):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _add_up([(unpack_sorted(k), unpack_bytes(v)) for k, v in zip(pdf["keys"], pdf["vals"], strict=True)])
        shard = int(pdf["shard"].iloc[0])
        write_level(folder, f"words-{shard}", ef_arrays(keys, (1 << 64) - 1) | {"count": counts.astype(np.uint64)})
        return pd.DataFrame({"shard": [shard], "types": [len(keys)], "tokens": [int(counts.sum())]})

    return build


class Words:
    """Level 1: shards of words by hash. The id of a word is its place in its shard after all earlier shards."""

    def __init__(self, folder: str, sizes: tuple[tuple[int, int], ...], shards: int):
        self.folder, self.shards = folder, shards
        self.first = np.zeros(shards + 1, np.int64)
        for shard, types in sizes:
            self.first[shard + 1] = types
        self.present = {s for s, _ in sizes}
        self.first = np.cumsum(self.first)
        self.types = int(self.first[-1])
        self.bits = max(1, self.types.bit_length())

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, count), -1 and 0 for words that were never seen; ``hashes`` must be sorted."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        cuts = np.searchsorted(_shards_of(hashes, self.shards), np.arange(self.shards + 1))
        for s in self.present:
            a, b = cuts[s], cuts[s + 1]
            if a < b:
                level = mapped_level(self.folder, f"words-{s}")
                at = ef_find(level, hashes[a:b])
                hit = at >= 0
                ids[a:b][hit] = self.first[s] + at[hit]
                counts[a:b][hit] = level["count"][at[hit]].astype(np.int64)
        return ids, counts

    def shard_of(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, ids, "right") - 1


@lru_cache(maxsize=2)
def words_of(folder: str, sizes: tuple[tuple[int, int], ...], shards: int) -> Words:
    return Words(folder, sizes, shards)


def _pair_rows(model: tuple):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(*model)

        def stream():
            for batch in batches:
                for _, _, tokens, _, _ in token_stream(batch.column(0)):
                    codes, distinct = pd.factorize(tokens)
                    order = np.argsort(distinct)
                    ids = np.empty(len(distinct), np.int64)
                    ids[order] = words.find(distinct[order])[0]
                    end = ids[codes[-1]]  # every slice closes with an end
                    own = ids[codes].astype(np.uint64)
                    yield (np.r_[np.uint64(end), own[:-1]] << np.uint64(words.bits)) | own

        for keys, counts in _counted(stream()):
            shard = words.shard_of((keys >> np.uint64(words.bits)).astype(np.int64))
            yield pa.RecordBatch.from_pydict(packed_rows(shard, keys, counts.astype(np.uint64), 0), _PACKED_ARROW)

    return rows


def _quantised(log10p: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(log10p / LOWEST, 0, 1) * 255).astype(np.uint8)


def _pair_level(folder: str, model: tuple, tokens: int):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        words = words_of(*model)
        keys, counts = _add_up([(unpack_sorted(k), unpack_bytes(v)) for k, v in zip(pdf["keys"], pdf["vals"], strict=True)])
        shard = int(pdf["shard"].iloc[0])
        base, own = int(words.first[shard]), int(words.first[shard + 1] - words.first[shard])
        context = (keys >> np.uint64(words.bits)).astype(np.int64) - base
        word = (keys & np.uint64((1 << words.bits) - 1)).astype(np.int64)
        total, types = np.bincount(context, counts.astype(float), own), np.bincount(context, minlength=own)
        back_off = DISCOUNT * types / np.maximum(total, 1)
        unigram = np.empty(len(word))
        for s in words.present:  # counts of successors, shard by shard
            inside = (word >= words.first[s]) & (word < words.first[s + 1])
            level = mapped_level(words.folder, f"words-{s}")
            unigram[inside] = (level["count"][word[inside] - words.first[s]] + 1.0) / (tokens + words.types + 1.0)
        p = (counts.astype(float) - DISCOUNT) / total[context] + back_off[context] * unigram
        relative = keys - (np.uint64(base) << np.uint64(words.bits))
        arrays = {f"next_{k}": v for k, v in ef_arrays(relative, max(1, own) << words.bits).items()}
        pointers = np.r_[0, np.cumsum(types)].astype(np.uint64)
        arrays |= {f"pointer_{k}": v for k, v in ef_arrays(pointers, len(keys) + 1).items()}
        arrays |= {"p": _quantised(np.log10(p)), "back_off": _quantised(np.log10(np.maximum(back_off, 1e-12)))}
        write_level(folder, f"pairs-{shard}", arrays)
        return pd.DataFrame({"shard": [shard], "pairs": [len(keys)]})

    return build


@lru_cache(maxsize=4096)
def pair_level(folder: str, shard: int):
    raw = mapped_level(folder, f"pairs-{shard}")
    return {k.removeprefix("next_"): v for k, v in raw.items() if k.startswith("next_")}, raw["p"], raw["back_off"]


def _scores(model: tuple, tokens: int, pair_shards: frozenset[int]):
    folder = model[0]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(*model)
        step = LOWEST / 255.0
        for batch in batches:
            for first, end, token, _, owner in token_stream(batch.column(1)):
                n = end - first
                codes, distinct = pd.factorize(token)
                order = np.argsort(distinct)
                ids, counts = np.empty(len(distinct), np.int64), np.empty(len(distinct), np.int64)
                ids[order], counts[order] = words.find(distinct[order])
                base = np.log10((counts + 1.0) / (tokens + words.types + 1.0))
                own, known = ids[codes], counts[codes] > 0
                before = np.r_[own[-1], own[:-1]]  # an end stands before the first word of every text
                key = np.where((own >= 0) & (before >= 0), (before << words.bits) | own, -1)
                pair_codes, pairs = pd.factorize(key)
                order = np.argsort(pairs)
                pairs = pairs[order]
                found = np.full(len(pairs), np.nan)
                context = np.where(pairs >= 0, pairs >> words.bits, -1)
                cuts = np.searchsorted(context, words.first)
                for s in pair_shards:
                    a, b = cuts[s], cuts[s + 1]
                    if a < b:
                        following, p, _ = pair_level(folder, s)
                        at = ef_find(following, (pairs[a:b] - (int(words.first[s]) << words.bits)).astype(np.uint64))
                        found[a:b] = np.where(at >= 0, p[np.maximum(at, 0)] * step, np.nan)
                by_code = np.empty(len(pairs))
                by_code[order] = found
                score = by_code[pair_codes]
                back = np.zeros(len(distinct))
                shard = words.shard_of(np.maximum(ids, 0))
                for s in pair_shards:
                    inside = np.flatnonzero((ids >= 0) & (shard == s))
                    if len(inside):
                        back[inside] = pair_level(folder, s)[2][ids[inside] - words.first[s]] * step
                back_of_context = np.r_[back[codes[-1]], back[codes[:-1]]]
                score = np.where(np.isnan(score), back_of_context + base[codes], score)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n), batch.column(2).slice(first, n),
                        pa.array(np.bincount(owner, minlength=n).astype(np.int64)),
                        pa.array(np.bincount(owner, known, n).astype(np.int64)),
                        pa.array(np.full(n, tokens, np.int64)),
                        pa.array(np.bincount(owner, base[codes], n)), pa.array(np.bincount(owner, score, n)),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return rows


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """A row per input row: ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Learns from rows whose crc32(key as text) mod ``folds`` is not ``held``; a null key counts as empty text. A null or
    empty text is its end token alone. Without training rows every token has probability 1. Repeated rows count
    as often as they occur and are scored alike; other columns are ignored.
    """
    spark = docs.sparkSession
    fold = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % folds
    body = F.col(text).cast("string")
    train = docs.where(fold != held).select(body.alias("text"))
    shards, folder = shard_count(docs), scratch_dir(spark, "lm")
    levels = cut_lineage(
        train.mapInArrow(_word_rows(shards), PACKED).groupBy("shard").applyInPandas(
            _word_level(folder), "shard int, types long, tokens long"
        )
    )
    sizes = sorted((r["shard"], r["types"], r["tokens"]) for r in levels.collect())  # a few numbers per shard
    model = (folder, tuple((s, n) for s, n, _ in sizes), shards)
    tokens = sum(t for _, _, t in sizes)
    pairs = cut_lineage(
        train.mapInArrow(_pair_rows(model), PACKED).groupBy("shard").applyInPandas(
            _pair_level(folder, model, tokens), "shard int, pairs long"
        )
    )
    pair_shards = frozenset(r["shard"] for r in pairs.select("shard").collect())
    named = docs.select(F.col(key).cast("long").alias("doc_id"), body.alias("text"), (fold == held).alias("held_out"))
    schema = (
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return named.mapInArrow(_scores(model, tokens, pair_shards), schema).withColumnRenamed("doc_id", key)
