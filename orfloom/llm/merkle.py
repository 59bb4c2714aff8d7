"""Merkle manifest of a dataset by time-forward processing.

Nodes are labelled by level and place, so a parent's label is larger than its children's. A priority queue ordered by
label delivers the digests of children to their parent; a second sweep in the reversed order delivers to every child the siblings
on its way up. The queue is external: leaves and the digests between blocks are messages that Spark's shuffle sorts by
label, and a task holds the part of the queue that lies inside one block of 3^7 consecutive leaves. A pass raises the nodes of
all groups by up to seven levels, so four passes reach the root of 2 * 10^13 leaves, and no group, source or level is ever
in one task. The passes are then swept in reverse, a row for each block, down to the leaves.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orfloom.operators.ordering import ordered_prefix
from orfloom.session import cut_lineage

FAN = 3
LEVELS = 7  # of a pass: blocks of 3^7 = 2,187 nodes

STEPS = "array<struct<l:string,r:string>>"


def field_text(value: Column) -> Column:
    """``-`` for null, else the value's length in UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field_text(v) for v in values]), 256)


# ---- inside a block ------------------------------------------------------------------------------------------

def digest_of(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def raise_block(leaves: list[str], levels: int) -> tuple[str, list[tuple[int, list[str]]]]:
    """(digest ``levels`` above the leaves, the nodes met as (label, children)), by forward messages in label order.

    The label of a node is its level times the block's width plus its place; ``leaves`` reach at most one node up there.
    """
    width = len(leaves) + 1
    queue: list[tuple[int, int, str]] = [(width + place // FAN, place % FAN, d) for place, d in enumerate(leaves)]
    heapq.heapify(queue)
    if not levels:
        return leaves[0], []
    met: list[tuple[int, list[str]]] = []
    while True:
        label, _, digest = heapq.heappop(queue)
        children = [digest]
        while queue and queue[0][0] == label:
            children.append(heapq.heappop(queue)[2])
        met.append((label, children))
        level, place = divmod(label, width)
        own = digest_of(children)
        if level == levels:
            return own, met
        heapq.heappush(queue, ((level + 1) * width + place // FAN, place % FAN, own))


def sweep_block(leaves: int, met: list[tuple[int, list[str]]], above: list[dict]) -> list[list[dict]]:
    """For every leaf the steps up to the root, from its own siblings on: messages in reversed label order."""
    width = leaves + 1
    if not met:
        return [above]
    waiting = {met[-1][0]: above}
    steps: list[list[dict]] = [[]] * leaves
    for label, children in reversed(met):
        higher = waiting.pop(label)
        level, place = divmod(label, width)
        for k, _ in enumerate(children):
            own = [{"l": "".join(children[:k]), "r": "".join(children[k + 1 :])}, *higher]
            if level == 1:
                steps[place * FAN + k] = own
            else:
                waiting[(level - 1) * width + place * FAN + k] = own
    return steps


def fold(digest: str, steps: list[dict]) -> str:
    for step in steps:
        digest = hashlib.sha256((step["l"] + digest + step["r"]).encode()).hexdigest()
    return digest


def proof_digest(steps: list[dict]) -> str:
    return hashlib.sha256("".join(s["l"] + s["r"] for s in steps).encode()).hexdigest()


# ---- passes over all groups ----------------------------------------------------------------------------------

def levels_above(count: int) -> int:
    """Levels until one node is left of ``count``."""
    levels, reach = 0, 1
    while reach < count:
        levels, reach = levels + 1, reach * FAN
    return levels


def _left(count: Column) -> Column:
    """``levels_above`` of a column, exact in integers."""
    powers = F.array(*[F.lit(FAN**k) for k in range(40)])
    return F.size(F.filter(powers, lambda p: p < count))


def _raise(levels: int):
    def raised(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("position", "ascending")])
        group, block, left = (rows.column(c)[0].as_py() for c in ("grp", "block", "left"))
        digest, _ = raise_block(rows.column("digest").to_pylist(), min(levels, left))
        return pa.table(
            {"grp": [group], "position": [block], "digest": [digest], "left": [max(0, left - levels)]}, schema=_NODES
        )

    return raised


_NODES = pa.schema([("grp", pa.int64()), ("position", pa.int64()), ("digest", pa.string()), ("left", pa.int32())])
NODES = "grp long, position long, digest string, left int"
_STEPS = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))
_SWEPT = pa.schema([("grp", pa.int64()), ("position", pa.int64()), ("steps", _STEPS)])


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"position div {FAN**levels}"))


def raise_passes(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Written tables of nodes (grp, position, digest, left), from the given ones up to one node for each group.

    ``left`` is the number of levels to go, the same for all nodes of a group.
    """
    passes = [nodes]
    while not passes[-1].where("left > 0").isEmpty():
        raised = _blocks(passes[-1], levels).groupBy("grp", "block").applyInArrow(_raise(levels), NODES)
        passes.append(cut_lineage(raised))
    return passes


def _steps_of(rows: pa.Table, above: pa.Table, levels: int) -> list[list[dict]]:
    """Steps to the root of the nodes of one block, in their order."""
    leaves = rows.column("digest").to_pylist()
    _, met = raise_block(leaves, min(levels, rows.column("left")[0].as_py()))
    return sweep_block(len(leaves), met, above.column("steps")[0].as_py())


def _sweep(levels: int):
    def swept(nodes: pa.Table, above: pa.Table) -> pa.Table:
        rows = nodes.sort_by([("position", "ascending")])
        steps = _steps_of(rows, above, levels)
        return pa.table({"grp": rows.column("grp"), "position": rows.column("position"), "steps": steps}, schema=_SWEPT)

    return swept


def sweep_pass(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """Steps to the root of all ``nodes``; ``above`` has those of their blocks (grp, position, steps)."""
    return (
        _blocks(nodes, levels).groupBy("grp", "block")
        .cogroup(above.select("grp", F.col("position").alias("block"), "steps").groupBy("grp", "block"))
        .applyInArrow(_sweep(levels), f"grp long, position long, steps {STEPS}")
    )


def _leaf_rows(root: str, proofs: bool, levels: int):
    fields = [(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
    schema = pa.schema([("doc_id", pa.int64()), *fields, ("verified", pa.bool_()), *([("proof", _STEPS)] if proofs else [])])

    def rows(nodes: pa.Table, above: pa.Table) -> pa.Table:
        table = nodes.sort_by([("position", "ascending")])
        leaves, steps = table.column("digest").to_pylist(), _steps_of(table, above, levels)
        folded = [fold(d, s) for d, s in zip(table.column("shown").to_pylist(), steps, strict=True)]
        n = len(leaves)
        return pa.table({
            "doc_id": table.column("doc_id"), "leaf": leaves, "subroot": [above.column("subroot")[0].as_py()] * n,
            "root": [root] * n, "proof_sha256": [proof_digest(s) for s in steps], "folded_root": folded,
            "verified": [f == root for f in folded], **({"proof": steps} if proofs else {}),
        }, schema=schema)

    return rows


ROWS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(
    docs: DataFrame, fields: list[str], key: str = "doc_id", group: str = "source", shown: dict[str, Column] | None = None,
    proofs: bool = True, levels: int = LEVELS,
) -> DataFrame:
    """A row per input row: ``key``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``
    and, with ``proofs``, ``proof`` itself: a step of left and right siblings for each level.

    ``shown`` replaces fields by the values that a recipient holds; their leaf is folded with the original siblings. Within a group
    leaves ascend by key (null first; equal keys by leaf, so repeated rows are leaves next to each other); groups ascend
    as UTF-8, null first. Null fields are ``-``, empty ones ``0:``. A table without rows gives none. Other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    real = [F.col(f) for f in fields]
    held = [(shown or {}).get(f, F.col(f)) for f in fields]
    own = docs.select(
        F.col(group).cast("string").alias("grp_name"), F.col(key).cast("long").alias("doc_id"),
        leaf_digest(*real).alias("digest"), leaf_digest(*held).alias("shown"),
    )
    leaves = cut_lineage(ordered_prefix(own, ["grp_name"], ["doc_id", "digest", "shown"]))
    sizes = leaves.groupBy("grp_name").agg(F.count(F.lit(1)).alias("n"))
    groups = cut_lineage(ordered_prefix(sizes, [], ["grp_name"], "grp"))
    tail = groups.agg(F.max("grp")).first()[0]
    schema = f"{ROWS}, proof {STEPS}" if proofs else ROWS
    if tail is None:
        return spark.createDataFrame([], schema).withColumnRenamed("doc_id", key)
    named = leaves.join(groups, leaves.grp_name.eqNullSafe(groups.grp_name)).select(
        groups.grp, "position", "digest", _left(F.col("n")).alias("left"), "doc_id", "shown"
    )
    passes = raise_passes(cut_lineage(named), levels)
    subroots = passes[-1].select("grp", F.col("digest").alias("subroot"))
    top_nodes = passes[-1].select(
        F.lit(0).cast("long").alias("grp"), F.col("grp").alias("position"), "digest",
        F.lit(levels_above(tail + 1)).cast("int").alias("left"),
    )
    top = raise_passes(top_nodes, levels)
    root = top[-1].first()["digest"]
    steps = spark.createDataFrame([(0, 0, [])], f"grp long, position long, steps {STEPS}")
    for nodes in reversed(top[:-1]):
        steps = cut_lineage(sweep_pass(nodes, steps, levels))
    # the place of a subroot is its group's number; its group's topmost node has place 0
    steps = steps.select(F.col("position").alias("grp"), F.lit(0).cast("long").alias("position"), "steps")
    for nodes in reversed(passes[1:-1]):
        steps = cut_lineage(sweep_pass(nodes, steps, levels))
    above = steps.select("grp", F.col("position").alias("block"), "steps").join(subroots, "grp")
    rows = (
        _blocks(passes[0], levels).groupBy("grp", "block").cogroup(above.groupBy("grp", "block"))
        .applyInArrow(_leaf_rows(root, proofs, levels), schema)
    )
    return rows.withColumnRenamed("doc_id", key)


def without_breaks(docs_key: Column, text: Column) -> Column:
    """The contract's tampering: where 2 divides the key's crc32, the text loses its line breaks."""
    return F.when(F.crc32(docs_key.cast("string")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def _sql_leaf(text: str) -> str:
    values = [f"CAST({f} AS VARCHAR)" for f in _FIELDS[:-1]] + [text]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({v})) || ':' || {v}, '-')" for v in values) + ")"


_SQL_EVEN = """(xor(list_reduce(list_prepend(4294967295, list_transform(
    string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
  lambda crc, byte: xor(crc >> 8, list_reduce(list_prepend(xor(crc, byte) & 255, range(8)),
    lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))), 4294967295) % 2 = 0)"""

#: the crc32 is computed byte by byte; nodes are raised level by level within groups (tier 0) and over them (tier 1)
SQL = f"""
WITH RECURSIVE shown AS (
  SELECT *, CASE WHEN {_SQL_EVEN} THEN replace(text, chr(10), '') ELSE text END AS seen FROM documents),
hashed AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS grp,
  {_sql_leaf("text")} AS leaf, {_sql_leaf("seen")} AS held FROM shown),
leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf, held) - 1 AS place,
  count(*) OVER (PARTITION BY grp) AS n FROM hashed),
up AS (
  SELECT grp, 0 AS level, place, leaf AS digest, n FROM leaves
  UNION ALL
  SELECT grp, level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (n + 2) // 3
  FROM up WHERE n > 1 GROUP BY grp, level, place // 3, n),
subroots AS (SELECT grp, digest AS subroot, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, grp AS place, subroot AS digest, n FROM subroots
  UNION ALL
  SELECT level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (n + 2) // 3
  FROM top WHERE n > 1 GROUP BY level, place // 3, n),
near AS (
  SELECT l.grp, l.place AS leaf_place, 0 AS tier, u.level,
    coalesce(string_agg(u.digest, '' ORDER BY u.place) FILTER (u.place < l.place // pow(3, u.level)::BIGINT), '') AS lower,
    coalesce(string_agg(u.digest, '' ORDER BY u.place) FILTER (u.place > l.place // pow(3, u.level)::BIGINT), '') AS upper
  FROM leaves l JOIN up u ON u.grp = l.grp AND u.n > 1 AND u.place // 3 = l.place // pow(3, u.level + 1)::BIGINT
  GROUP BY ALL
  UNION ALL
  SELECT l.grp, l.place, 1, u.level,
    coalesce(string_agg(u.digest, '' ORDER BY u.place) FILTER (u.place < l.grp // pow(3, u.level)::BIGINT), ''),
    coalesce(string_agg(u.digest, '' ORDER BY u.place) FILTER (u.place > l.grp // pow(3, u.level)::BIGINT), '')
  FROM leaves l JOIN top u ON u.n > 1 AND u.place // 3 = l.grp // pow(3, u.level + 1)::BIGINT
  GROUP BY ALL),
proofs AS (SELECT grp, leaf_place AS place, sha256(string_agg(lower || upper, '' ORDER BY tier, level)) AS proof_sha256,
  list(lower || '|' || upper ORDER BY tier, level) AS steps FROM near GROUP BY ALL),
folded AS (SELECT l.doc_id, l.leaf, l.grp, coalesce(proof_sha256, sha256('')) AS proof_sha256,
  list_reduce(list_prepend(held, coalesce(steps, [])),
    lambda d, s: sha256(split_part(s, '|', 1) || d || split_part(s, '|', 2))) AS folded_root
  FROM leaves l LEFT JOIN proofs USING (grp, place))
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM folded JOIN subroots USING (grp), (SELECT digest AS root FROM top WHERE n = 1)
"""
