"""Shuffle of many small integers as few packed rows.

A task sorts its (key, value) pairs by shard and key and writes one row per shard: differences of the sorted
keys in as many bytes as they need, values in the narrowest type, compressed. A pair costs a few bytes and no
JVM row, and what reaches one task is bounded by the number of shards, which follows the input.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession

PACKED = "shard int, n long, keys binary, vals binary, tag long"


def shard_count(df: DataFrame) -> int:
    """Shards that grow with the input: its number of read tasks, or the session's shuffle width if larger."""
    spark: SparkSession = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def pack_bytes(values: np.ndarray) -> bytes:
    """An unsigned array in the narrowest type, bytes of equal weight together, compressed."""
    top = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
    planes = np.ascontiguousarray(values.astype(f"<u{width}")).view(np.uint8).reshape(-1, width)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes.T).tobytes())


def unpack_bytes(blob: bytes) -> np.ndarray:
    width = blob[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{width}").astype(np.uint64)


def pack_sorted(keys: np.ndarray) -> bytes:
    steps = keys.copy()
    steps[1:] -= keys[:-1]
    return pack_bytes(steps)


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack_bytes(blob), dtype=np.uint64)


def packed_rows(shard: np.ndarray, keys: np.ndarray, vals: np.ndarray, tag: int) -> dict[str, list]:
    """Columns of PACKED, a row for each shard that has pairs; keys must be sorted within a shard."""
    order = np.argsort(shard, kind="stable")
    shard, keys, vals = shard[order], keys[order], vals[order]
    cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.zeros(0, int)
    ends = np.r_[cuts[1:], len(shard)]
    return {
        "shard": [int(shard[a]) for a in cuts],
        "n": [int(b - a) for a, b in zip(cuts, ends, strict=True)],
        "keys": [pack_sorted(keys[a:b]) for a, b in zip(cuts, ends, strict=True)],
        "vals": [pack_bytes(vals[a:b]) for a, b in zip(cuts, ends, strict=True)],
        "tag": [tag] * len(cuts),
    }
