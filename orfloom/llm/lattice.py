"""Near-duplicate vectors by lattice hashing: random projections decoded to E8 lattice points.

Each of ``TABLES`` tables projects a unit vector to 16 dimensions, two blocks of eight, scales them, and decodes
each block to the nearest point of the E8 lattice; the two points are the vector's cell. The nearest ``PROBES``
neighbouring cells (by minimal lattice vectors) are probed as well. Vectors of one label that meet in a cell
are compared by cosine in double precision. A pair that meets in several tables is counted in the first one only.

Cells are joined by key first; only cells with two vectors or more receive vectors. A large cell is cut into
blocks, and pairs of blocks are compared apart. A block gives link counts per vector and a spanning forest, never
its pairs. Identical vectors are one class with a multiplicity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orfloom.llm.links import components
from orfloom.llm.words import mix
from orfloom.session import cut_lineage

TABLES = 10
BLOCKS = 2
SCALE = 2.6
PROBES = 4
LIMIT = 0.98
BLOCK_ROWS = 512


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row of eight numbers, doubled so that it is integral."""

    def d8(y: np.ndarray) -> np.ndarray:
        near = np.rint(y)
        odd = np.flatnonzero(near.sum(1).astype(np.int64) & 1)
        gap = y[odd] - near[odd]
        worst = np.abs(gap).argmax(1)
        near[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
        return near

    whole, half = d8(x), d8(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1)
    return np.rint(2 * np.where(nearer[:, None], whole, half)).astype(np.int64)


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled."""
    rows = []
    for i in range(8):
        for j in range(i):
            for a in (2, -2):
                for b in (2, -2):
                    v = np.zeros(8, np.int64)
                    v[i], v[j] = a, b
                    rows.append(v)
    for bits in range(256):
        v = np.array([1 if bits >> k & 1 else -1 for k in range(8)])
        if (v < 0).sum() % 2 == 0:
            rows.append(v)
    return np.array(rows)


def cell_codes(unit: np.ndarray, seed: int = 0) -> np.ndarray:
    """(vector, table, home cell first, then probed cells): 64-bit cell keys."""
    n, dims = unit.shape
    codes = np.zeros((n, TABLES, 1 + PROBES), np.uint64)
    shortest = minimal_vectors()
    for t in range(TABLES):
        g = np.random.default_rng((seed, t)).standard_normal((dims, 8 * BLOCKS)) * SCALE / np.sqrt(8.0)
        x = unit @ g
        keys, others, gains = [], [], []
        for b in range(BLOCKS):
            block = x[:, 8 * b : 8 * b + 8]
            point = decode_e8(block)
            rest = block - point / 2
            # squared distance to a neighbour less that to the home point: 2 - 2 * rest . v
            gain = 2 - rest @ shortest.T
            best = np.argpartition(gain, PROBES, axis=1)[:, :PROBES]
            weights = mix(np.arange(8, dtype=np.uint64), 100 * t + b + 1)

            def key(p: np.ndarray, weights=weights) -> np.ndarray:
                return mix((p.view(np.uint64) * weights).sum(-1, dtype=np.uint64))

            keys.append(key(point))
            others.append(key(point[:, None, :] + shortest[best]))
            gains.append(np.take_along_axis(gain, best, 1))
        home = mix(keys[0] + mix(keys[1], 5), t)
        probes = np.concatenate(
            [mix(others[0] + mix(keys[1], 5)[:, None], t), mix(keys[0][:, None] + mix(others[1], 5), t)], 1
        )
        nearest = np.argsort(np.concatenate(gains, 1), 1, kind="stable")[:, :PROBES]
        codes[:, t, 0], codes[:, t, 1:] = home, np.take_along_axis(probes, nearest, 1)
    return codes


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims = np.array([len(v) for v in batch.column(2).to_pylist()])
        for d in np.unique(dims):  # vectors of another length never meet
            part = batch.filter(pa.array(dims == d))
            for a in range(0, len(part), 2048):
                rows = part.slice(a, 2048)
                codes = cell_codes(_unit(_matrix(rows.column(2))))
                label = mix(np.array(rows.column(1).to_pylist(), np.int64).view(np.uint64), int(d))
                cells = mix(codes + label[:, None, None])
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        pa.FixedSizeListArray.from_arrays(pa.array(cells.reshape(-1).view(np.int64)), TABLES * (1 + PROBES)).cast(pa.list_(pa.int64())),
                    ],
                    ["id", "cells"],
                )


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Link counts and spanning links of every (cell, block pair); input sorted by them."""
    names = ["bucket", "pair", "part", "slot", "id", "copies", "embedding", "cells"]

    def one(t: pa.Table):
        ids, part, slot, copies = [t.column(c).to_numpy() for c in ("id", "part", "slot", "copies")]
        low, high = divmod(t.column("pair")[0].as_py(), 1 << 20)
        left, right = np.flatnonzero(part == low), np.flatnonzero(part == high)
        home = slot % (1 + PROBES) == 0
        unit = _unit(_matrix(t.column("embedding").combine_chunks()))
        cells = _matrix_int(t.column("cells").combine_chunks())
        links = unit[left] @ unit[right].T >= LIMIT
        links &= home[left][:, None] | home[right][None, :]
        links &= ids[left][:, None] < ids[right][None, :] if low == high else ids[left][:, None] != ids[right][None, :]
        a, b = np.nonzero(links)
        i, j = left[a], right[b]
        # the smaller id first, whichever block it stands in, so that every cell judges a pair alike
        i, j = np.where(ids[i] < ids[j], i, j), np.where(ids[i] < ids[j], j, i)
        if len(i):  # keep a pair in the first table where the two meet, and there in the first way
            keep = np.zeros(len(i), bool)
            for s in range(0, len(i), 1 << 16):
                ci, cj = cells[i[s : s + (1 << 16)]].reshape(-1, TABLES, 1 + PROBES), cells[j[s : s + (1 << 16)]].reshape(-1, TABLES, 1 + PROBES)
                at_home = ci[:, :, 0] == cj[:, :, 0]
                left_probes = (ci[:, :, 1:] == cj[:, :, :1]).any(2)
                right_probes = (cj[:, :, 1:] == ci[:, :, :1]).any(2)
                way = np.where(at_home, 0, np.where(left_probes, 1, np.where(right_probes, 2, 3)))
                table = (way < 3).argmax(1)
                first = way[np.arange(len(way)), table]
                cell = np.where(first == 1, cj[np.arange(len(way)), table, 0], ci[np.arange(len(way)), table, 0])
                keep[s : s + (1 << 16)] = (cell == t.column("bucket")[0].as_py()) & (slot[i[s : s + (1 << 16)]] // (1 + PROBES) == table)
                # either side must stand in its own right here: home, or probing the other's home
                hi, hj = home[i[s : s + (1 << 16)]], home[j[s : s + (1 << 16)]]
                keep[s : s + (1 << 16)] &= np.where(first == 0, hi & hj, np.where(first == 1, hj & ~hi, hi & ~hj))
            i, j = i[keep], j[keep]
        count = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        parent = np.arange(len(ids))
        forest = []
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            while parent[y] != y:
                parent[y] = parent[parent[y]]
                y = parent[y]
            if x != y:
                parent[max(x, y)] = min(x, y)
                forest.append((ids[x], ids[y]))
        some = np.flatnonzero(count)
        return [*zip(ids[some].tolist(), count[some].astype(int).tolist(), [None] * len(some), strict=True),
                *((int(x), 0, int(y)) for x, y in forest)]

    def out(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "n", "other"])

    held, rows = None, []
    for batch in batches:
        t = pa.Table.from_batches([batch]).rename_columns(names)
        t = (t if held is None else pa.concat_tables([held, t])).combine_chunks()
        key = np.stack([t.column("bucket").to_numpy(), t.column("pair").to_numpy()], 1)
        cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)]) if len(t) else np.zeros(0, int)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            rows += one(t.slice(a, b - a))
        held = t.slice(cuts[-1]) if len(cuts) else None
        yield out(rows)
        rows = []
    if held is not None and len(held):
        yield out(one(held))


def _matrix_int(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.int64).reshape(len(column), -1)


def vector_links(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """A row per input row: ``key``, ``n_links``, ``component_id``, ``kept``.

    Vectors that are null, zero, or hold null or non-finite components, and rows with a null label, link with
    nothing and are kept. Identical vectors of a label link with each other. A row with a null key is returned
    with no links and a null component. Rows that repeat a key count as rows. Other columns are ignored.
    """
    named = rows.select(
        F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
        F.col(vector).cast("array<double>").alias("embedding"),
    )
    sound = F.col("label").isNotNull() & F.col("id").isNotNull() & F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    ) & F.exists("embedding", lambda x: x != 0)
    # a component of -0.0 is the same number as 0.0
    usable = named.where(sound).withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))
    classes = cut_lineage(
        usable.groupBy("label", "embedding").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    )
    members = cut_lineage(
        usable.join(classes.withColumnsRenamed({"id": "rep"}), ["label", "embedding"]).select("id", "rep", "copies").distinct()
    )
    cells = cut_lineage(classes.select("id", "label", "embedding").mapInArrow(_keys, "id long, cells array<long>"))
    flat = cells.select("id", F.posexplode("cells").alias("slot", "bucket"))
    is_home = (F.col("slot") % (1 + PROBES) == 0).cast("int")
    crowded = (
        flat.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(is_home).alias("homes")).where("n > 1 and homes > 0")
        .select("bucket", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"))
    )
    dealt = (
        flat.join(crowded, "bucket")
        .withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("long"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
        .withColumn("pair", F.least("part", "other") * (1 << 20) + F.greatest("part", "other"))
        .join(classes.select("id", "copies", "embedding"), "id").join(cells, "id")
        .select("bucket", "pair", "part", "slot", "id", "copies", "embedding", "cells")
    )
    compared = cut_lineage(
        dealt.repartition("bucket", "pair").sortWithinPartitions("bucket", "pair").mapInArrow(
            _compare, "id long, n long, other long"
        )
    )
    counts = compared.where("other is null").groupBy(F.col("id").alias("rep")).agg(F.sum("n").alias("n"))
    edges = compared.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))
    copies = members.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    comps = components(edges.unionByName(copies))
    linked = members.join(counts, "rep", "left").select(
        "id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n")
    ).groupBy("id").agg(F.max("n").alias("n"))
    out = named.select("id", sound.alias("ok")).join(linked, "id", "left").join(comps, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(key), F.when(F.col("ok"), F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
