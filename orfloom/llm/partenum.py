"""Jaccard self-join of word-shingle sets by PartEnum signatures (Arasu, Ganti and Kaushik, 2006).

Sizes fall into overlapping windows such that any two sets of similarity 0.8 share a window. In a window of
sets up to ``hi`` shingles such a pair differs in at most ``k = 2 * hi // 9`` shingles. The shingle domain is
partitioned into groups of parts, so that some group holds at most ``k2`` differences and, among its
``n2`` parts, some subset of ``n2 - k2`` parts holds none: every such subset gives one signature.

Nothing is capped. Empty subsets would be equal for unrelated sets, so ``m`` groups more than needed are made:
more than ``m`` groups must then agree, and a set with at most ``m`` groups that have an empty subset needs no
empty signature. Sets with more emit them as well, so no pair is lost.

Candidates of a signature are first compared with one member each (three rounds, each with another member);
then every pair that is not known to be connected is compared, after two exact bounds (sizes, and the parities of
shingle counts in about two bins per shingle: sets differ in at least as many shingles as parities). Copies inside one task are represented by the first of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orfloom.llm.links import components
from orfloom.llm.packed import PACKED, pack_bytes, packed_rows, shard_count, unpack_bytes, unpack_sorted
from orfloom.llm.words import lower_ascii, mix, shingle_sets, slices, span_hashes, word_spans
from orfloom.session import cut_lineage

KEY_BITS = 48
FLUSH = 1_000_000
STAR_ROUNDS = 3
BLOCK = 1_024
LEAST_BITS = 1_024
BROADCAST_IDS = 1_000_000

_windows: list[tuple[int, int]] = [(1, 4)]


def size_windows(largest: int) -> list[tuple[int, int]]:
    """(lo, hi) windows up to ``largest``: a set of size s and any similar larger one share a window."""
    while _windows[-1][0] <= largest:
        lo = -(-4 * (_windows[-1][1] + 1) // 5)
        _windows.append((lo, max(_windows[-1][1] + 1, lo * 25 // 16)))
    return _windows


def text_sets(texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, shingle set per row) for slices of a text column."""
    for first, end, data, offsets in slices(texts):
        data = lower_ascii(data)
        starts, ends, rows = word_spans(data, offsets)
        words = span_hashes(data, starts, ends)
        cuts = np.searchsorted(rows, np.arange(end - first + 1))
        yield first, [shingle_sets(words[cuts[i] : cuts[i + 1]]) for i in range(end - first)]


def set_hash(s: np.ndarray) -> int:
    return int(mix(s, 7).sum(dtype=np.uint64) + np.uint64(len(s)))


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(key, position in ``sets``) of all signatures of the non-empty sets."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    elements, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    keys, owners = [], []
    for w, (lo, hi) in enumerate(size_windows(int(sizes.max()))):
        inside = (sizes >= lo) & (sizes <= hi)
        if not inside.any():
            continue
        seed, k = mix(np.array([w], np.uint64), 99)[0], 2 * hi // 9
        if k == 0:
            groups, n2, take, spare = 1, 1, 1, 0
        elif k <= 4:
            groups, n2, take, spare = 1, k + 3, 3, -1
        else:
            least = k // 2 + 1
            spare = 2 + int(0.3 * least)
            groups, n2, take = least + spare, 3, 2
        chosen = inside[owner]
        x = mix(elements[chosen] + seed)
        renumber = np.cumsum(inside) - 1
        cell = renumber[owner[chosen]] * (groups * n2) + (x % np.uint64(groups * n2)).astype(np.int64)
        n_cells, value = int(inside.sum()) * groups * n2, mix(x, 1)
        low = np.bincount(cell, (value & np.uint64(0xFFFFFFFF)).astype(float), n_cells).astype(np.uint64)
        high = np.bincount(cell, (value >> np.uint64(32)).astype(float), n_cells).astype(np.uint64)
        sums = (low + (high << np.uint64(32))).reshape(-1, n2)
        counts = np.bincount(cell, minlength=n_cells).reshape(-1, n2)
        subsets = np.array(list(combinations(range(n2), take)))
        sums, counts = sums[:, subsets].sum(2, dtype=np.uint64), counts[:, subsets].sum(2)
        place = np.arange(groups * len(subsets), dtype=np.uint64).reshape(groups, -1)
        label = mix(place + seed, 2)
        key = mix(sums.reshape(-1, groups, len(subsets)) + label, 3)
        counts = counts.reshape(key.shape)
        needs_empty = (counts == 0).any(2).sum(1) > spare
        keep = (counts > 0) | needs_empty[:, None, None]
        keys.append(key[keep])
        owners.append(np.flatnonzero(inside)[np.nonzero(keep)[0]])
    return np.concatenate(keys) >> np.uint64(64 - KEY_BITS), np.concatenate(owners)


def parities(s: np.ndarray) -> bytes:
    """A bit per bin: whether the bin's number of shingles is odd. The bins of half the width fold by exclusive or."""
    bits = max(LEAST_BITS, 1 << (2 * len(s) - 1).bit_length()) if len(s) else LEAST_BITS
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: list[bytes], width: int) -> np.ndarray:
    """The sketches as rows of ``width`` 64-bit words."""
    out = np.empty((len(sketches), width), np.uint64)
    for r, sketch in enumerate(sketches):
        words = np.frombuffer(sketch, np.uint64)
        while len(words) > width:
            words = words[: len(words) // 2] ^ words[len(words) // 2 :]
        out[r] = words
    return out


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, sets in text_sets(batch.column(1)):
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, len(sets)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array([set_hash(s) for s in sets], np.uint64).view(np.int64)),
                    pa.array([parities(s) for s in sets], pa.binary()),
                ],
                ["doc_id", "n_shingles", "set_hash", "sketch"],
            )


def _signature_rows(shards: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            key, val = np.concatenate(keys), np.concatenate(ids)
            keys.clear()
            ids.clear()
            order = np.argsort(key)
            key, val = key[order], val[order]
            shard = (key * np.uint64(shards)) >> np.uint64(KEY_BITS) if shards < 1 << 16 else key % np.uint64(shards)
            pa.default_memory_pool().release_unused()
            return pa.RecordBatch.from_pydict(
                packed_rows(shard.astype(np.int64), key, val, 0),
                pa.schema([("shard", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("vals", pa.binary()),
                           ("tag", pa.int64())]),
            )

        for batch in batches:
            doc_ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, sets in text_sets(batch.column(1)):
                own = []
                for i, s in enumerate(sets):
                    h = set_hash(s) if len(s) else 0
                    own.append(s if len(s) and h not in seen else s[:0])
                    seen.add(h)
                key, at = signatures(own)
                if len(key):
                    keys.append(key)
                    ids.append(doc_ids[first + at].view(np.uint64))
                if sum(map(len, keys)) >= FLUSH:
                    yield flush()
        if keys:
            yield flush()

    return rows


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """The distinct member lists (two members or more) of a shard's signatures, packed into one row."""
    key = np.concatenate([unpack_sorted(b) for b in pdf["keys"]])
    val = np.concatenate([unpack_bytes(b) for b in pdf["vals"]])
    order = np.lexsort((val, key))
    key, val = key[order], val[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (val[1:] != val[:-1])]
    key, val = key[new], val[new]
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    lengths = np.diff(np.r_[cuts, len(key)])
    many = np.repeat(lengths > 1, lengths)
    val, lengths = val[many], lengths[lengths > 1]
    if not len(lengths):
        return pd.DataFrame({"shard": [], "lengths": [], "members": []})
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    digest = mix(np.add.reduceat(mix(val, 11), starts) + lengths.astype(np.uint64))
    first = np.sort(np.unique(digest, return_index=True)[1])
    keep = np.zeros(len(lengths), bool)
    keep[first] = True
    return pd.DataFrame({
        "shard": [int(pdf["shard"].iloc[0])],
        "lengths": [pack_bytes(lengths[keep].astype(np.uint64))],
        "members": [pack_bytes(val[np.repeat(keep, lengths)])],
    })


def _run_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lengths, members in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            lengths, members = unpack_bytes(lengths).astype(np.int64), unpack_bytes(members).view(np.int64)
            # a list is named by its members, so that the same list of several signatures and shards is one
            starts = np.r_[0, np.cumsum(lengths)[:-1]]
            digest = mix(np.add.reduceat(mix(members.view(np.uint64), 11), starts) + lengths.astype(np.uint64))
            run = np.repeat(digest.view(np.int64), lengths)
            for a in range(0, len(run), 1 << 18):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(run[a : a + (1 << 18)]), pa.array(members[a : a + (1 << 18)])], ["run", "id"]
                )


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose parities differ in no more bins than a pair of similarity 0.8 can."""
    for batch in batches:
        n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
        left, right = batch.column(4).to_pylist(), batch.column(5).to_pylist()
        width = np.array([min(len(x), len(y)) // 8 for x, y in zip(left, right, strict=True)], np.int64)
        keep = np.zeros(len(batch), bool)
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            for a in range(0, len(rows), 4096):
                part = rows[a : a + 4096]
                apart = folded([left[r] for r in part], w) ^ folded([right[r] for r in part], w)
                keep[part] = 9 * np.bitwise_count(apart).sum(1, dtype=np.int64) <= n[part]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = []
        for i in (2, 3):
            col = batch.column(i)
            sides.append((col.offsets.to_numpy(), col.values.to_numpy()))
        keep = np.zeros(len(batch), bool)
        for r in range(len(batch)):
            x, y = [v[o[r] : o[r + 1]] for o, v in sides]
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep[r] = 100 * both >= 80 * (len(x) + len(y) - both)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, sets in text_sets(batch.column(1)):
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, len(sets)),
                    pa.ListArray.from_arrays(
                        np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32),
                        np.concatenate(sets).view(np.int64),
                    ),
                ],
                ["id", "shingles"],
            )


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of a block pair that are not connected yet and pass both bounds; input sorted by (run, cell)."""
    names = ["run", "cell", "part", "id", "comp", "n", "sketch"]

    def one(cell: int, part, ids, comp, n, raw) -> tuple[np.ndarray, np.ndarray]:
        sketch = folded(raw, min(map(len, raw)) // 8)
        low, high = divmod(cell, 1 << 20)
        left, right = np.flatnonzero(part == low), np.flatnonzero(part == high)
        out = []
        for k in range(0, len(left), max(1, (1 << 15) // max(1, len(right)))):
            own = left[k : k + max(1, (1 << 15) // max(1, len(right)))]
            apart = comp[own][:, None] != comp[right][None, :]
            if low == high:
                apart &= ids[own][:, None] < ids[right][None, :]
            i, j = np.nonzero(apart)
            i, j = own[i], right[j]
            close = 5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j])
            i, j = i[close], j[close]
            close = 9 * np.bitwise_count(sketch[i] ^ sketch[j]).sum(1, dtype=np.int64) <= n[i] + n[j]
            out.append((i[close], j[close]))
        i, j = np.concatenate([x for x, _ in out] or [left[:0]]), np.concatenate([y for _, y in out] or [left[:0]])
        return np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])

    def several(t: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        cell, part, ids, comp, n = [t.column(c).to_numpy() for c in names[1:6]]
        raw, found = t.column("sketch").to_pylist(), []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            found.append(one(int(cell[a]), part[a:b], ids[a:b], comp[a:b], n[a:b], raw[a:b]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["a", "b"])

    held: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch]).rename_columns(names)
        t = t if held is None else pa.concat_tables([held, t])
        key = np.stack([t.column("run").to_numpy(), t.column("cell").to_numpy()], 1)
        cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)]) if len(t) else np.zeros(0, int)
        if len(cuts) > 1:
            yield several(t.slice(0, cuts[-1]), cuts)
        held = t.slice(cuts[-1]) if len(cuts) else None
    if held is not None and len(held):
        yield several(held, np.array([0, len(held)]))


def _near(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """The pairs (a, b) within both bounds."""
    fa = facts.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ka"))
    fb = facts.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("kb"))
    near = (
        pairs.join(fa, "a").join(fb, "b").where("5 * least(na, nb) >= 4 * greatest(na, nb)")
        .select("a", "b", "na", "nb", "ka", "kb").mapInArrow(_bounded, "a long, b long")
    )
    return cut_lineage(near)


def _check(near: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs that link. Each text is read once more, and only texts of pairs within the bounds."""
    ids = cut_lineage(near.select(F.col("a").alias("id")).union(near.select("b")).distinct())
    n_ids = ids.count()
    texts = docs.join(F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids, "id", "left_semi")
    sets = cut_lineage(texts.mapInArrow(_set_rows, "id long, shingles array<long>").dropDuplicates(["id"]))
    sa = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    sb = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    found = near.join(sa, "a").join(sb, "b").select("a", "b", "sa", "sb").mapInArrow(_verified, "a long, b long")
    return cut_lineage(found)


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per input row: ``key``, ``n_shingles``, ``component_id`` (smallest key reachable by links).

    Two texts link when their sets of five-word shingles (A-Z lower-cased) have a Jaccard similarity of 0.8 or
    more; a text with fewer words is one shingle; one without words, or null, has none and links with nothing.
    Rows that repeat a key with other text are one node with the links of all its texts. A row with a null key
    keeps its count and has a null component. Other columns are ignored, whatever their names.
    """
    named = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    facts = cut_lineage(
        named.mapInArrow(_facts, "doc_id long, n_shingles long, set_hash long, sketch binary")
    )
    real = facts.where("doc_id is not null and n_shingles > 0")
    classes = real.groupBy("n_shingles", "set_hash").agg(F.min("doc_id").alias("rep"))
    members = cut_lineage(
        real.join(classes, ["n_shingles", "set_hash"]).select("doc_id", "rep").distinct()
    )
    reps = cut_lineage(
        real.groupBy("n_shingles", "set_hash").agg(F.min("doc_id").alias("id"), F.min("sketch").alias("sketch"))
        .select("id", F.col("n_shingles").alias("n"), "sketch")
    )
    # a key that several texts share is verified with each of them: one row per (key, text) from here on
    repeated = reps.groupBy("id").count().where("count > 1").select("id")
    if not repeated.isEmpty():
        return _with_repeated_keys(docs, key, text)
    return facts.select("doc_id", "n_shingles").join(
        _components(named, members, reps), "doc_id", "left"
    ).select(
        F.col("doc_id").alias(key), "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )


def _components(named: DataFrame, members: DataFrame, reps: DataFrame) -> DataFrame:
    shards = shard_count(named)
    usable = named.where("id is not null and text is not null")
    packed = usable.mapInArrow(_signature_rows(shards), PACKED)
    lists = cut_lineage(
        packed.groupBy("shard").applyInPandas(_shared, "shard int, lengths binary, members binary")
    )
    runs = lists.repartition(shards, "shard").mapInArrow(_run_members, "run long, id long")
    runs = cut_lineage(
        runs.join(members.select(F.col("doc_id").alias("id"), "rep"), "id").select("run", F.col("rep").alias("id")).distinct()
    )
    copies = members.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    edges, centres = None, []
    state = runs.withColumn("comp", F.col("id"))
    for _ in range(STAR_ROUNDS):
        centre = state.groupBy("run").agg(F.min(F.struct("id", "comp")).alias("c"), F.max("comp").alias("top"), F.min("comp").alias("low"))
        centre = centre.where("low < top").select("run", F.col("c.id").alias("a"), F.col("c.comp").alias("ca"))
        pairs = cut_lineage(
            state.join(centre, "run").where("id <> a and comp <> ca")
            .select(F.least("id", "a").alias("a"), F.greatest("id", "a").alias("b")).distinct()
        )
        if pairs.isEmpty():
            state = None
            break
        found = _check(_near(pairs, reps), named)
        edges = found if edges is None else edges.unionByName(found)
        comps = cut_lineage(components(edges))
        # the next round starts from a member outside the first one's component; members of it stay to be compared
        merged = runs.join(comps.select("id", F.col("component").alias("c")), "id", "left").select(
            "run", "id", F.coalesce("c", "id").alias("comp")
        )
        centres.append(centre.select("run", F.col("a").alias("id")))
        used = centres[0]
        for c in centres[1:]:
            used = used.unionByName(c)
        split = merged.groupBy("run").agg(F.min("comp").alias("low"), F.max("comp").alias("top")).where("low < top")
        merged = cut_lineage(merged.join(split.select("run"), "run", "left_semi"))
        state = merged.join(used, ["run", "id"], "left_anti")
    if state is not None:
        rest = _rest_pairs(merged, reps)
        found = _check(rest, named)
        edges = edges.unionByName(found)
    links = copies if edges is None else copies.unionByName(edges)
    return components(links).withColumnRenamed("id", "doc_id")


def _rest_pairs(merged: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs of a member list that no round has compared or connected, found block by block."""
    blocks = merged.groupBy("run").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = (
        merged.join(blocks, "run").join(reps, "id")
        .withColumn("part", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("long"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("cell", F.least("part", F.col("other").cast("long")) * (1 << 20) + F.greatest("part", F.col("other").cast("long")))
        .select("run", "cell", "part", "id", "comp", "n", "sketch")
    )
    sorted_cells = dealt.repartition("run", "cell").sortWithinPartitions("run", "cell")
    return cut_lineage(sorted_cells.mapInArrow(_block_pairs, "a long, b long").distinct())


def _with_repeated_keys(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Keys that repeat with other texts: join on stand-in keys, then connect the texts of a key."""
    rows = docs.select(F.col(key).cast("long").alias("own"), F.col(text).cast("string").alias("text"))
    rows = cut_lineage(rows.withColumn("stand", F.monotonically_increasing_id()))
    found = cut_lineage(jaccard_components(rows, "stand", "text"))
    both = cut_lineage(rows.select("own", "stand").join(found, "stand"))
    keyed = both.where("own is not null")
    least = keyed.groupBy("component_id").agg(F.min("own").alias("low"))
    comps = components(keyed.join(least, "component_id").select(F.col("own").alias("a"), F.col("low").alias("b")))
    return both.join(comps.withColumnRenamed("id", "own"), "own", "left").select(
        F.col("own").alias(key), "n_shingles", F.coalesce("component", "own").alias("component_id")
    )
