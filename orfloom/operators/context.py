"""Neighbourhood features and local graphs of ordered groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orfloom.functions import (
    chain_star_rows, is_known, len_norm, same_strand, strand_flags,
)
from orfloom.operators.ordering import with_neighbours
from orfloom.operators.skew import HOT_ROWS

REACH = 4
CENTRE = 4
# Order of the 18 context features and of the 14 node features.
CONTEXT_FEATURES = (
    "center_len_norm", "neighbor_count_norm", "has_left_1", "has_right_1", "has_left_2", "has_right_2",
    "left_1_len_norm", "right_1_len_norm", "left_2_len_norm", "right_2_len_norm", "left_1_same_strand",
    "right_1_same_strand", "left_2_same_strand", "right_2_same_strand", "left_1_has_phrog",
    "right_1_has_phrog", "left_2_has_phrog", "right_2_has_phrog",
)
NODE_WIDTH = 14
GRAPH_VERSION = "context_graph_v2a"


def context_features(
    df: DataFrame,
    part: list[str],
    order: list[str],
    entity: str,
    length: Column,
    strand: Column,
    annotation: Column,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The 18 features from the two rows on either side, plus neighbour ids ordered left 1, right 1, left 2, right 2.

    Neighbours are adjacent rows of the ordered group, whatever the gap between their order values.
    """
    payload = {"id": F.col(entity).cast("string"), "len": len_norm(length), "strand": strand.cast("string"),
               "known": is_known(annotation).cast("double")}
    wide = with_neighbours(df, part, order, payload, reach=2, slots="__slots", hot_rows=hot_rows)

    def slot(i: int) -> Column:
        return F.get("__slots", F.lit(i))

    centre = slot(2)
    columns: dict[str, Column] = {"center_len_norm": centre["len"]}
    places = {("left", 1): 1, ("right", 1): 3, ("left", 2): 0, ("right", 2): 4}
    for (side, step), i in places.items():
        here = slot(i)
        there = here.isNotNull()
        columns[f"has_{side}_{step}"] = there.cast("double")
        columns[f"{side}_{step}_len_norm"] = F.coalesce(here["len"], F.lit(0.0))
        columns[f"{side}_{step}_same_strand"] = (there & same_strand(here["strand"], centre["strand"])).cast("double")
        columns[f"{side}_{step}_has_phrog"] = F.coalesce(here["known"], F.lit(0.0))
    ids = F.transform(F.array_compact(F.array(*[slot(i) for i in (1, 3, 0, 4)])), lambda s: s["id"])
    count = F.size(ids)
    columns["neighbor_count_norm"] = F.least(count / F.lit(4.0), F.lit(1.0))
    return wide.select(
        *df.columns,
        F.lit(2).alias("window_size"),
        count.alias("neighbor_count"),
        ids.alias("neighbor_ids"),
        *[columns[n].alias(n) for n in CONTEXT_FEATURES],
        F.lit(len(CONTEXT_FEATURES)).alias("context_dim"),
    )


def _node(slot: Column, valid: Column, offset: int) -> Column:
    """14 node features of a slot at a fixed offset; an absent slot is all zeros."""
    spot = [F.lit(float(x == offset)) for x in range(-REACH, REACH + 1)]
    features = F.array(slot["len"], slot["forward"], slot["reverse"], slot["known"], F.lit(float(offset == 0)), *spot)
    return F.when(valid, features).otherwise(F.array(*[F.lit(0.0)] * NODE_WIDTH))


def context_graph(
    df: DataFrame,
    part: list[str],
    order: list[str],
    length: Column,
    strand: Column,
    annotation: Column,
    sizes: tuple[int, ...] = (1, 2, 4),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Local graphs of nine slots, one row per (row, window size); the neighbourhood is computed once."""
    flags = strand_flags(strand)
    payload = {
        "len": len_norm(length), "forward": flags["forward"], "reverse": flags["reverse"],
        "known": is_known(annotation).cast("double"),
    }
    wide = with_neighbours(df, part, order, payload, reach=REACH, slots="__slots", hot_rows=hot_rows)
    sized = wide.withColumn("window_size", F.explode(F.array(*[F.lit(w) for w in sizes])))
    slots = range(2 * REACH + 1)
    within = [F.get("__slots", F.lit(i)).isNotNull() & (F.col("window_size") >= abs(i - CENTRE)) for i in slots]
    masked = sized.withColumn("node_mask", F.array(*within))
    valid = [F.get("node_mask", F.lit(i)) for i in slots]
    return masked.select(
        *df.columns,
        "window_size",
        F.lit(CENTRE).alias("center_index"),
        sum((v.cast("int") for v in valid[1:]), valid[0].cast("int")).alias("num_valid_nodes"),
        F.lit(GRAPH_VERSION).alias("graph_version"),
        F.array(*[_node(F.get("__slots", F.lit(i)), valid[i], i - CENTRE) for i in slots]).alias("node_features"),
        chain_star_rows(valid, CENTRE).alias("adjacency"),
        "node_mask",
    )


def graph_neighbor_mean(graphs: DataFrame, out: str = "neighbor_mean") -> DataFrame:
    """Mean of the linked valid slots' features per slot (degree at least 1), as nine rows of 14 values.

    A dense product of small matrices: one Arrow batch is one stacked multiplication.
    """
    slots = 2 * REACH + 1

    def values(column: pa.Array, width: int) -> np.ndarray:
        while pa.types.is_list(column.type):
            column = column.flatten()
        return column.to_numpy(zero_copy_only=False).astype(float).reshape(-1, slots, width)

    def nested(x: np.ndarray) -> pa.Array:
        rows = pa.ListArray.from_arrays(np.arange(0, x.size + 1, NODE_WIDTH, dtype=np.int32), pa.array(x.ravel()))
        return pa.ListArray.from_arrays(np.arange(0, len(rows) + 1, slots, dtype=np.int32), rows)

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, m = values(batch.column("node_features"), NODE_WIDTH), values(batch.column("node_mask"), 1)
            a = values(batch.column("adjacency"), slots) * m * m.transpose(0, 2, 1)
            means = a @ x / np.maximum(a.sum(axis=2, keepdims=True), 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, nested(means)], names=[*batch.schema.names, out])

    return graphs.mapInArrow(mean, graphs.select("*", F.col("node_features").alias(out)).schema)
