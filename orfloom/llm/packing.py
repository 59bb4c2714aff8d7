"""Lexical retrieval packing: each window is filled with unused neighbours of its seed document.

A task reads its documents in shards of at most ``SHARD_TOKENS`` tokens and builds a BM25 inverted index over
each shard. Whole windows of a document come first; what is left of it waits. The seed of a window is the
oldest waiting piece; its BM25 neighbours follow in falling order, and a piece that does not fit is cut, its rest
waiting on. A shard's last pieces wait for the next shard, so a task ends with less than one window, which is
written as sequences whose lengths are powers of two and need no padding. No shuffle; each shard is bounded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orfloom.llm.tokens import encode_column, worker_pieces

WINDOW = 2048
END_ID = 1
SHARD_TOKENS = 1 << 20
K1, B = 1.2, 0.75
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Shard:
    """BM25 inverted index over the distinct pieces of each waiting document."""

    def __init__(self, terms: list[np.ndarray]):
        n = len(terms)
        lengths = np.array([len(t) for t in terms], float)
        docs = np.repeat(np.arange(n), [len(t) for t in terms])
        codes, _ = pd.factorize(np.concatenate(terms)) if n else (docs, None)
        width = max(1, int(codes.max()) + 1 if len(codes) else 1)
        cell, tf = np.unique(docs * width + codes, return_counts=True)
        doc, term = cell // width, cell % width
        df = np.bincount(term, minlength=width)
        shared = df[term] > 1  # a term of one document finds no neighbour
        doc, term, tf = doc[shared], term[shared], tf[shared]
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / max(1.0, lengths.mean() if n else 1.0))
        score = idf[term] * tf * (K1 + 1) / (tf + norm[doc])
        cuts = np.searchsorted(doc, np.arange(n + 1))
        # a query is all terms that the document shares with another
        self.query = [term[cuts[d] : cuts[d + 1]] for d in range(n)]
        by_term = np.argsort(term, kind="stable")
        self.doc, self.score = doc[by_term], score[by_term]
        self.cuts = np.searchsorted(term[by_term], np.arange(width + 1))

    def neighbours(self, seed: int) -> np.ndarray:
        """Documents that share a term with the seed, best first, ties by position."""
        terms = self.query[seed]
        if not len(terms):
            return np.zeros(0, np.int64)
        runs = [slice(a, b) for a, b in zip(self.cuts[terms].tolist(), self.cuts[terms + 1].tolist(), strict=True)]
        total = np.bincount(np.concatenate([self.doc[r] for r in runs]), np.concatenate([self.score[r] for r in runs]))
        found = np.flatnonzero(total)
        return found[np.argsort(-total[found], kind="stable")]


class Waiting:
    """What is left of a document: its ids from ``start`` on."""

    __slots__ = ("doc_id", "ids", "start", "total", "terms")

    def __init__(self, doc_id, ids, start, total, terms):
        self.doc_id, self.ids, self.start, self.total, self.terms = doc_id, ids, start, total, terms


def _pack(batches: Iterator[pa.RecordBatch], path: str, window: int) -> Iterator[pa.RecordBatch]:
    pieces = worker_pieces(path)
    first_id = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
    sequences = 0
    rows: list[tuple] = []

    def put(piece: Waiting, length: int, offset: int) -> None:
        own = piece.ids[:length]
        rows.append((
            piece.doc_id, piece.start, length, zlib.crc32(own.astype("<u4").tobytes()), piece.total,
            first_id + sequences, offset,
        ))
        piece.ids, piece.start = piece.ids[length:], piece.start + length

    def emit() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        rows.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns],
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )

    def fill(waiting: list[Waiting]) -> list[Waiting]:
        """Full windows as far as the waiting ids reach; returns the pieces of the unfilled rest."""
        nonlocal sequences
        index = Shard([w.terms for w in waiting])
        unused = np.ones(len(waiting), bool)
        left, oldest = sum(len(w.ids) for w in waiting), 0
        while left >= window:
            while not unused[oldest]:
                oldest += 1
            offset = 0
            order = index.neighbours(oldest)
            plan = [oldest, *order[unused[order]].tolist()]
            step = oldest
            while offset < window:
                if not plan:  # no neighbour is left: go on with the next oldest
                    while not unused[step]:
                        step += 1
                    plan.append(step)
                at = plan.pop(0)
                if not unused[at]:
                    continue
                take = min(window - offset, len(waiting[at].ids))
                put(waiting[at], take, offset)
                offset += take
                unused[at] = len(waiting[at].ids) > 0
            left -= window
            sequences += 1
        return [waiting[i] for i in np.flatnonzero(unused)]

    waiting: list[Waiting] = []
    held = 0
    for batch in batches:
        doc_ids = batch.column(0).to_pylist()
        for row, ids, terms in encode_column(batch.column(1), pieces):
            whole = Waiting(doc_ids[row], np.r_[ids, np.uint32(END_ID)].astype(np.uint32), 0, len(ids) + 1, terms)
            while len(whole.ids) >= window:
                put(whole, window, 0)
                sequences += 1
            if len(whole.ids):
                waiting.append(whole)
                held += len(whole.ids)
            if held >= SHARD_TOKENS:
                waiting = fill(waiting)
                held = sum(len(w.ids) for w in waiting)
        if rows:
            yield emit()
    if waiting:
        waiting = fill(waiting)
        left = sum(len(w.ids) for w in waiting)
        at = 0
        while left:
            room, offset = 1 << (left.bit_length() - 1), 0
            left -= room
            while offset < room:
                take = min(room - offset, len(waiting[at].ids))
                put(waiting[at], take, offset)
                offset += take
                at += not len(waiting[at].ids)
            sequences += 1
    if rows:
        yield emit()


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, path: str | None = None
) -> DataFrame:
    """A row per piece: where it starts in its document, its length and digest, its sequence and place there.

    A document is its ids and a final id 1; a null or empty text is that id alone. Every id lies in exactly one
    piece. Rows are packed as they come, so repeated rows and null keys are documents of their own; an empty
    table gives no pieces; other columns are ignored.
    """
    path = path or tokenizer_path()
    named = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return named.mapInArrow(lambda batches: _pack(batches, path, window), SCHEMA).withColumnRenamed("doc_id", key)
