"""Sampler-ready packs: labels encoded, vectors attached, rows indexed per split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orfloom.functions import feature_vector
from orfloom.operators.context import CONTEXT_FEATURES
from orfloom.operators.labels import encode_labels, override_split, where_split, where_status
from orfloom.operators.ordering import head_per, ordered_prefix
from orfloom.operators.vectors import attach_embedding, attach_optional, prefetch
from orfloom.session import cut_lineage

LEVELS = {"level1_label": "label_l1", "level2_label": "label_l2", "node_primary": "label_l3_core"}
SPLITS = ("train", "val", "test")


def row_index(df: DataFrame, part: list[str], order: list[Column | str], out: str = "row_index") -> DataFrame:
    """Dense 0-based number of each row within ``part``, without sorting a part in one task."""
    return ordered_prefix(df, part, order, position=out)


def core_rows(
    index: DataFrame,
    vocabs: dict[str, DataFrame],
    order: str = "protein_id",
    limits: dict[str, int | None] | None = None,
    status: str = "trainable_core",
    required: tuple[str, ...] = ("embedding_id",),
) -> DataFrame:
    """Rows of one status and the three splits with labels in all vocabularies, labels encoded."""
    rows = where_split(where_status(index, status), SPLITS).dropna(subset=[*required, *LEVELS])
    for column, out in LEVELS.items():
        rows = encode_labels(rows, vocabs[column], column, out)
    if limits:
        rows = head_per(rows, "split", [F.col(order)], {s: limits.get(s) for s in SPLITS})
    return rows


def core_pack(
    index: DataFrame,
    embeddings: DataFrame,
    vocabs: dict[str, DataFrame],
    key: str = "sequence_embedding_key",
    order: str = "protein_id",
    limits: dict[str, int | None] | None = None,
) -> DataFrame:
    """Single-modality pack; rows without a vector are left out before they are numbered."""
    rows = prefetch(core_rows(index, vocabs, order, limits), embeddings, key)
    numbered = cut_lineage(row_index(rows, ["split"], [order]))
    return attach_embedding(numbered, embeddings, key, required=False)


def multimodal_pack(
    index: DataFrame,
    sequence: DataFrame,
    vocabs: dict[str, DataFrame],
    structure: DataFrame | None = None,
    context: DataFrame | None = None,
    graphs: DataFrame | None = None,
    key: str = "sequence_embedding_key",
    entity: str = "protein_id",
    structure_dim: int = 1280,
    override: DataFrame | None = None,
    limits: dict[str, int | None] | None = None,
) -> DataFrame:
    """Pack of three modalities with a presence mask. The sequence vector is required for every row.

    ``sequence`` and ``structure`` hold (key, vector); ``context`` the 18 named features by entity, or
    ``graphs`` the local graphs, whose presence bit is that of the centre slot. Limits apply before the
    split override, as the rows were numbered then.
    """
    rows = core_rows(index, vocabs, entity, limits)
    if override is not None:
        rows = override_split(rows, override, entity)
    # numbered and written while the rows are ids and labels only; the joins below count keys on this table
    core = rows = cut_lineage(row_index(rows, ["split"], [entity]))
    vec = _vector_column(sequence, key)
    rows = attach_embedding(
        rows, sequence.select(key, F.col(vec).alias("sequence_embedding")), key, required=True,
        what="sequence embedding", hot_from=core,
    )
    if structure is None:
        zeros = F.array_repeat(F.lit(0.0), structure_dim).cast("array<float>")
        rows = rows.withColumns({"structure_embedding": zeros, "__structure": F.lit(False)})
    else:
        named = structure.select(key, F.col(_vector_column(structure, key)).alias("structure_embedding"))
        rows = attach_optional(rows, named, key, "structure_embedding", structure_dim, "__structure", hot_from=core)
    rows = _with_context(rows, core, context, graphs, entity)
    mask = F.array(F.lit(True), F.col("__structure"), F.col("__context"))
    return rows.withColumn("modality_mask", mask).drop("__structure", "__context")


def _vector_column(df: DataFrame, key: str) -> str:
    return next(c for c in df.columns if c != key)


def _with_context(
    rows: DataFrame, core: DataFrame, context: DataFrame | None, graphs: DataFrame | None, entity: str
) -> DataFrame:
    if graphs is not None:
        kept = graphs.select(entity, "node_features", "adjacency", "node_mask", "center_index")
        joined = rows.join(kept, entity, "left")
        centre = F.coalesce(F.get("node_mask", F.col("center_index")), F.lit(False))
        return joined.withColumn("__context", centre)
    if context is None:
        return rows.withColumns(
            {"context_features": F.array_repeat(F.lit(0.0), len(CONTEXT_FEATURES)), "__context": F.lit(False)}
        )
    named = context.select(entity, feature_vector(list(CONTEXT_FEATURES), context.columns).alias("context_features"))
    return attach_optional(rows, named, entity, "context_features", len(CONTEXT_FEATURES), "__context", core)
