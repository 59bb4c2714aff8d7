"""Line de-duplication over sharded minimal perfect hashes.

A line's identity is a 128-bit hash of its key. Every task combines its own lines first, so a line that a third of all
documents hold costs one entry for each task. A shard (a range of the first hash) drops the lines of one document only and
keeps the others in a minimal perfect hash with three arrays: a 64-bit fingerprint, the number of rows and the
smallest document. Documents then send their line hashes to the shards and get back the places of the lines to drop; the texts
meet these in one join by row. A shard's most frequent lines, at most ``HOT_LINES``, are taken out of it and known to all
tasks, so no shard receives a probe for every document. Shards follow the input, so arrays and probes of one task stay bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orfloom.llm.packed import pack_bytes, pack_sorted, shard_count, unpack_bytes, unpack_sorted
from orfloom.llm.perfect import PerfectHash, build, pair_order, second_hashes
from orfloom.llm.words import lower_ascii, slices, span_hashes, word_spans
from orfloom.session import cut_lineage

MIN_CHARS = 10
HOT_LINES = 16  # of a shard
FLUSH = 500_000
LAST = np.int64((1 << 63) - 1)  # stands for a null document id
_SIGN = np.uint64(1 << 63)

COUNTED = "shard int, n long, h1 binary, h2 binary, low binary, high binary, rows binary"
ARRAYS = "shard int, hot boolean, n long, perfect binary, h1 binary, fingerprints binary, counts binary, firsts binary"
PROBES = "shard int, n long, h1 binary, h2 binary, doc binary, ref binary, line binary"
DROPS = "doc long, ref long, lines array<int>"


def line_keys(texts: pa.Array, min_chars: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, row, place in its text, two hashes) of all lines whose key is long enough, by slices.

    The key is the line between its first and last word, so its white space is stripped; lengths count code points.
    """
    for first, end, data, offsets in slices(texts):
        data = lower_ascii(data)
        starts, ends, rows = word_spans(data, offsets)
        breaks = np.flatnonzero(data == 10)
        line = np.searchsorted(breaks, starts) + rows  # different lines of different texts never share a number
        if len(line):
            new = np.r_[True, line[1:] != line[:-1]]
            old = np.r_[new[1:], True]
            starts, ends, rows = starts[new], ends[old], rows[new]
        points = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=points[1:])
        long = points[ends] - points[starts] >= min_chars
        starts, ends, rows = starts[long], ends[long], rows[long]
        place = np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets[rows])
        yield first, end, rows, place, span_hashes(data, starts, ends), second_hashes(data, starts, ends)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)).astype(np.int64) * shards) >> 24


def _combined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(h1, h2, smallest document, largest document, rows) of distinct lines, sorted by h1."""
    h1, h2, low, high, rows = (np.concatenate(p) for p in zip(*parts, strict=True))
    order, cuts = pair_order(h1, h2)
    if not len(cuts):
        return h1, h2, low, high, rows
    return (
        h1[order][cuts], h2[order][cuts], np.minimum.reduceat(low[order], cuts), np.maximum.reduceat(high[order], cuts),
        np.add.reduceat(rows[order], cuts),
    )


def _by_shard(shards: int, h1: np.ndarray, columns: dict[str, np.ndarray]) -> dict[str, list]:
    """Packed columns, a row for each shard that has entries; ``h1`` must be sorted."""
    shard = shard_of(h1, shards)
    cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.zeros(0, int)
    spans = list(zip(cuts, np.r_[cuts[1:], len(shard)], strict=True))
    out = {"shard": [int(shard[a]) for a, _ in spans], "n": [int(b - a) for a, b in spans]}
    out["h1"] = [pack_sorted(h1[a:b]) for a, b in spans]
    return out | {name: [pack_bytes(values[a:b]) for a, b in spans] for name, values in columns.items()}


def _documents(column: pa.Array) -> np.ndarray:
    """Document ids as unsigned numbers of the same order; null is the largest."""
    return pc.fill_null(column, pa.scalar(int(LAST))).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ _SIGN


_COUNTED = pa.schema([("shard", pa.int32()), ("n", pa.int64()), *[(c, pa.binary()) for c in ("h1", "h2", "low", "high", "rows")]])
_PROBES = pa.schema([("shard", pa.int32()), ("n", pa.int64()), *[(c, pa.binary()) for c in ("h1", "h2", "doc", "ref", "line")]])


def _count_lines(shards: int, min_chars: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed():
            h1, h2, low, high, n = parts[0]
            columns = {"h2": h2, "low": low, "high": high, "rows": n.astype(np.uint64)}
            return pa.RecordBatch.from_pydict(_by_shard(shards, h1, columns), _COUNTED)

        parts: list[tuple[np.ndarray, ...]] = []
        held = 0
        for batch in batches:
            ids = _documents(batch.column(0))
            for first, _, row, _, h1, h2 in line_keys(batch.column(1), min_chars):
                order, cuts = pair_order(h1, h2)
                if not len(cuts):
                    continue
                doc = ids[first + row[order]]  # a stable order: the rows of one line ascend
                again = np.r_[True, (row[order][1:] != row[order][:-1])]
                again[cuts] = True
                parts.append((
                    h1[order][cuts], h2[order][cuts], np.minimum.reduceat(doc, cuts), np.maximum.reduceat(doc, cuts),
                    np.add.reduceat(again.astype(np.int64), cuts),
                ))
                held += len(cuts)
                if held >= FLUSH:
                    parts = [_combined(parts)]
                    held = len(parts[0][0])
                    if held >= FLUSH // 2:
                        yield packed()
                        parts, held = [], 0
        if parts:
            parts = [_combined(parts)]
            yield packed()

    return rows


def _shard_arrays(pdf: pd.DataFrame) -> pd.DataFrame:
    """The shard's perfect hash and arrays, and a second row for its few very frequent lines."""
    parts = [
        (unpack_sorted(a), unpack_bytes(b), unpack_bytes(c), unpack_bytes(d), unpack_bytes(e).astype(np.int64))
        for a, b, c, d, e in zip(pdf["h1"], pdf["h2"], pdf["low"], pdf["high"], pdf["rows"], strict=True)
    ]
    h1, h2, low, high, rows = _combined(parts)
    many = low < high
    total = int(rows.sum())
    h1, h2, low, rows = h1[many], h2[many], low[many], rows[many]
    top = np.argsort(-rows, kind="stable")[:HOT_LINES]
    hot = np.zeros(len(h1), bool)
    hot[top[rows[top] > np.maximum(64, (total - np.cumsum(rows[top])) // 64)]] = True
    out = []
    for is_hot, take in ((False, ~hot), (True, hot)):
        if not take.any() and is_hot:
            continue
        mph = build(h1[take], h2[take])
        slot = mph.slots(h1[take], h2[take])
        back = np.empty(len(slot), np.int64)
        back[slot] = np.arange(len(slot))
        keys = [pack_bytes(values[take][back]) for values in (h2, rows.astype(np.uint64), low)]
        first_hash = pack_bytes(h1[take][back]) if is_hot else b""
        out.append((int(pdf["shard"].iloc[0]), is_hot, len(slot), mph.to_bytes(), first_hash, *keys))
    return pd.DataFrame(out, columns=["shard", "hot", "n", "perfect", "h1", "fingerprints", "counts", "firsts"])


class LineArrays:
    """Perfect hash with fingerprints and smallest documents."""

    def __init__(self, perfect: PerfectHash, fingerprints: np.ndarray, firsts: np.ndarray):
        self.perfect, self.fingerprints, self.firsts = perfect, fingerprints, firsts

    def first(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known, smallest document) of each line."""
        slot = self.perfect.slots(h1, h2)
        known = slot >= 0
        known[known] = self.fingerprints[slot[known]] == h2[known]
        return known, self.firsts[np.where(known, slot, 0)] if len(self.firsts) else np.zeros(len(h1), np.uint64)


def hot_lines(arrays: DataFrame) -> LineArrays:
    """The frequent lines of all shards, at most ``HOT_LINES`` a shard, as one table for every task."""
    rows = arrays.where("hot").select("h1", "fingerprints", "firsts").collect()
    none = np.zeros(0, np.uint64)
    h1, h2, first = (
        np.concatenate([none, *[unpack_bytes(bytes(r[k])) for r in rows]]) for k in range(3)
    )
    mph = build(h1, h2)
    slot = mph.slots(h1, h2)
    back = np.empty(len(slot), np.int64)
    back[slot] = np.arange(len(slot))
    return LineArrays(mph, h2[back], first[back])


def _probe_rows(shards: int, min_chars: int, hot: LineArrays):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed():
            h1, h2, doc, ref, line = (np.concatenate(p) for p in zip(*parts, strict=True))
            order = np.argsort(h1, kind="stable")
            columns = {"h2": h2, "doc": doc, "ref": ref, "line": line.astype(np.uint64)}
            return pa.RecordBatch.from_pydict(
                _by_shard(shards, h1[order], {k: v[order] for k, v in columns.items()}), _PROBES
            )

        parts, held = [], 0
        for batch in batches:
            ids = _documents(batch.column(0))
            refs = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for first, _, row, place, h1, h2 in line_keys(batch.column(1), min_chars):
                ask = np.flatnonzero(~hot.first(h1, h2)[0])
                if len(ask):
                    at = first + row[ask]
                    parts.append((h1[ask], h2[ask], ids[at], refs[at], place[ask]))
                    held += len(ask)
                if held >= FLUSH:
                    yield packed()
                    parts, held = [], 0
        if parts:
            yield packed()

    return rows


def _answers(probes: pd.DataFrame, arrays: pd.DataFrame) -> pd.DataFrame:
    """Places of the lines to drop: a row for each document of the shard that loses any."""
    nothing = pd.DataFrame({"doc": [], "ref": [], "lines": []})
    if not len(probes) or not len(arrays):
        return nothing
    held = arrays.iloc[0]
    table = LineArrays(
        PerfectHash.from_bytes(held["perfect"]), unpack_bytes(held["fingerprints"]), unpack_bytes(held["firsts"])
    )
    out = []
    for h1, h2, doc, ref, line in zip(*[probes[c] for c in ("h1", "h2", "doc", "ref", "line")], strict=True):
        doc = unpack_bytes(doc)
        known, first = table.first(unpack_sorted(h1), unpack_bytes(h2))
        lose = np.flatnonzero(known & (first < doc))
        if len(lose):
            out.append((doc[lose], unpack_bytes(ref)[lose], unpack_bytes(line)[lose].astype(np.int64)))
    if not out:
        return nothing
    doc, ref, line = (np.concatenate(p) for p in zip(*out, strict=True))
    order, cuts = pair_order(doc, ref)
    ends = np.r_[cuts[1:], len(order)]
    doc, ref, line = doc[order], ref[order], line[order].astype(np.int32)
    return pd.DataFrame({
        "doc": (doc[cuts] ^ _SIGN).view(np.int64), "ref": ref[cuts].view(np.int64),
        "lines": [np.unique(line[a:b]) for a, b in zip(cuts, ends, strict=True)],
    })


def _kept_texts(min_chars: int, hot: LineArrays):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _documents(batch.column(0))
            drops: list[list[int]] = [d or [] for d in batch.column(2).to_pylist()]
            if len(hot.firsts):
                for first, _, row, place, h1, h2 in line_keys(batch.column(1), min_chars):
                    known, smallest = hot.first(h1, h2)
                    for at in np.flatnonzero(known & (smallest < ids[first + row])):
                        drops[first + int(row[at])].append(int(place[at]))
            n_lines, n_dropped, kept = [], [], []
            for text, gone in zip(batch.column(1).to_pylist(), drops, strict=True):
                lines = (text or "").split("\n")
                n_lines.append(len(lines))
                if gone:
                    skip = set(gone)
                    lines = [line for k, line in enumerate(lines) if k not in skip]
                n_dropped.append(n_lines[-1] - len(lines))
                kept.append("\n".join(lines))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_lines", "n_dropped", "text"],
            )

    return rows


def line_arrays(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, shards: int | None = None) -> DataFrame:
    """The sharded perfect hashes with fingerprints, row counts and smallest documents, as a written table (ARRAYS)."""
    own = docs.select(F.col(key).cast("long"), F.col(text).cast("string"))
    counted = own.mapInArrow(_count_lines(shards or shard_count(docs), min_chars), COUNTED)
    return cut_lineage(counted.groupBy("shard").applyInPandas(_shard_arrays, ARRAYS))


def dedup_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, shards: int | None = None
) -> DataFrame:
    """A row per input row: ``key``, ``n_lines``, ``n_dropped`` and the ``text`` without repeated lines.

    Lines whose key (white space stripped, A-Z lower-cased) has ``min_chars`` code points and is found under two ids or
    more stay in the smallest id only, there as often as they occur. Null or empty text is one empty line. Rows with one id are one
    document: they keep each other's lines. A null id comes after all others. Without rows there are none; other columns are
    ignored whatever their names.
    """
    shards = shards or shard_count(docs)
    arrays = line_arrays(docs, key, text, min_chars, shards)
    hot = hot_lines(arrays)
    body: Column = F.col(text).cast("string")
    own = docs.select(F.col(key).cast("long").alias("doc_id"), body.alias("text"))
    with_ref = own.withColumn("ref", F.xxhash64("text"))
    probes = with_ref.select("doc_id", "text", "ref").mapInArrow(_probe_rows(shards, min_chars, hot), PROBES)
    answers = probes.groupBy("shard").cogroup(arrays.where("not hot").groupBy("shard")).applyInPandas(_answers, DROPS)
    # repeated rows have equal answers: a set of places each
    drops = answers.groupBy("doc", "ref").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lines"))
    ident = F.coalesce(F.col("doc_id"), F.lit(int(LAST)))
    texts = with_ref.withColumn("doc", ident).join(drops, ["doc", "ref"], "left").select("doc_id", "text", "lines")
    kept = texts.mapInArrow(_kept_texts(min_chars, hot), "doc_id long, n_lines long, n_dropped long, text string")
    return kept.select(F.col("doc_id").alias(key), "n_lines", "n_dropped", F.col("text").alias(text))


SQL = """
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS place, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (
  SELECT doc_id, place, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (
  SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT doc_id, place, line, first IS NOT NULL AND first < doc_id AS gone FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
