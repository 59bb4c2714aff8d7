"""Annotation text to labelled tables: standardise, map, route, expand, index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orfloom.functions import instance_key, nonblank, normalize_annotation, strip
from orfloom.operators.ordering import ordered_prefix
from orfloom.operators.skew import broadcast_or_plain, lookup_join

# Statuses and the ontology version written with mapped rows.
STATUSES = ("trainable_core", "trainable_multilabel", "parent_only", "defer", "open_set")
ONTOLOGY_VERSION = "PFO_v1.0.2"
# Which tasks a status feeds.
ROUTING = (
    ("trainable_core", "l1"), ("trainable_core", "l2"), ("trainable_core", "l3_core"),
    ("trainable_multilabel", "l1"), ("trainable_multilabel", "l2"), ("trainable_multilabel", "l3_multilabel"),
    ("parent_only", "l1"), ("parent_only", "l2"), ("open_set", "open_set"),
)
OPTIONAL_ROUTING = (("defer", "l1"), ("defer", "l2"), ("defer", "open_set"), ("open_set", "l1"))
# Column contracts of the tables written.
STANDARD_COLUMNS = (
    "protein_id", "genome_id", "contig_id", "gene_index", "sequence", "sequence_length", "phrog_annotation",
    "annotation_raw", "annotation_normalized",
)
MAPPED_COLUMNS = (
    "level1_label", "level2_label", "node_primary", "status", "multi_label_flag", "secondary_level1",
    "secondary_level2", "secondary_node",
)
JOIN_INDEX_COLUMNS = (
    "protein_id", "embedding_id", "sequence_embedding_key", "genome_id", "contig_id", "gene_index",
    "sequence_length", "split", "split_strategy", "split_version", "exact_sequence_rep_id",
    "homology_cluster_id", "status", "level1_label", "level2_label", "node_primary", "multi_label_flag",
)


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def standardize(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """``roles`` maps a standard column to a source column; absent optional ones become empty text."""
    require_columns(df, [roles.get(r, r) for r in ("protein_id", "genome_id", "sequence")])

    def role(name: str) -> Column:
        source = roles.get(name, name)
        return F.col(source) if source in df.columns else F.lit("")

    derived = {
        "sequence": role("sequence").cast("string"),
        "sequence_length": F.length(role("sequence").cast("string")),
        "annotation_normalized": normalize_annotation(role("annotation_raw").cast("string")),
    }
    return df.select(*[derived.get(c, role(c)).alias(c) for c in STANDARD_COLUMNS])


def lookup_left(df: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Left join to the pair-deduplicated lookup. Null keys match null keys; a key with two values fans out."""
    return lookup_join(df, lookup.distinct(), key, "left", null_safe=True)


def fill_mapping_defaults(df: DataFrame) -> DataFrame:
    defaults = {"status": "open_set", "multi_label_flag": "no"}
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.lit(defaults.get(c, ""))) for c in MAPPED_COLUMNS if c in df.columns}
    )


def status_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "is_open_set": (F.col("status") == "open_set").cast("int"),
            "is_parent_only": (F.col("status") == "parent_only").cast("int"),
            "is_multilabel": (F.lower("multi_label_flag") == "yes").cast("int"),
            "ontology_version": F.lit(ONTOLOGY_VERSION),
        }
    )


def map_to_ontology(df: DataFrame, mapping: DataFrame, key: str = "annotation_normalized") -> DataFrame:
    """Labels for each row by its normalised annotation, with defaults for unmapped rows and 0/1 flags."""
    full = mapping
    for name in MAPPED_COLUMNS:
        if name not in full.columns:
            full = full.withColumn(name, F.lit(""))
    full = full.select(key, *MAPPED_COLUMNS).distinct()
    return status_flags(fill_mapping_defaults(lookup_join(df, full, key, "left")))


def where_status(df: DataFrame, status: str) -> DataFrame:
    return df.where(F.col("status") == status)


def where_split(df: DataFrame, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    return df.where(F.col("split").isin(*splits))


def where_in_vocab(df: DataFrame, vocabs: dict[str, DataFrame]) -> DataFrame:
    """Rows whose every named column is in its vocabulary (column ``label``)."""
    for column, vocab in vocabs.items():
        keys = vocab.select(F.col("label").alias(column))
        df = df.join(broadcast_or_plain(keys), column, "left_semi")
    return df


def where_available(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on), on, "left_semi")


def task_datasets(wide: DataFrame) -> DataFrame:
    """One row per (row, task it feeds), in one pass over the wide table."""
    status = F.col("status")
    rules = {
        "l1": nonblank(F.col("level1_label")),
        "l2": nonblank(F.col("level2_label")),
        "l3_core": (status == "trainable_core") & nonblank(F.col("node_primary")),
        "l3_multilabel": status == "trainable_multilabel",
        "open_set": status == "open_set",
        "parent_only": status == "parent_only",
        "defer": status == "defer",
    }
    tasks = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return wide.withColumn("task", F.explode(tasks))


def route_by_matrix(wide: DataFrame, optional: bool = False) -> DataFrame:
    """Tasks by the status matrix instead of by label presence."""
    pairs = ROUTING + (OPTIONAL_ROUTING if optional else ())
    matrix = wide.sparkSession.createDataFrame(list(pairs), "status string, task string")
    return wide.join(F.broadcast(matrix), "status")  # a fixed table of at most 13 rows


def to_long(wide: DataFrame, strict: bool = False) -> DataFrame:
    """One row per (row, node, role). ``strict`` also asks for the multilabel flag on secondary rows."""

    def entry(level1: str, level2: str, node: str, role: str) -> Column:
        return F.struct(
            F.col(level1).alias("level1_label"), F.col(level2).alias("level2_label"),
            strip(F.col(node)).alias("node_name"), F.lit(role).alias("label_role"),
        )

    secondary = F.col("secondary_node")
    second_ok = nonblank(strip(secondary))
    if strict:
        second_ok = second_ok & (F.lower("multi_label_flag") == "yes")
    entries = F.array_compact(
        F.array(
            F.when(nonblank(strip(F.col("node_primary"))), entry("level1_label", "level2_label", "node_primary", "primary")),
            F.when(second_ok, entry("secondary_level1", "secondary_level2", "secondary_node", "secondary")),
        )
    )
    kept = [c for c in ("protein_id", "genome_id", "annotation_normalized", "status") if c in wide.columns]
    return wide.select(*kept, F.explode(entries).alias("e")).select(*kept, "e.*")


def secondary_list(wide: DataFrame) -> DataFrame:
    """Secondary nodes as a list column."""
    node = strip(F.col("secondary_node"))
    return wide.withColumn(
        "secondary_nodes", F.when(nonblank(node), F.array(node)).otherwise(F.array().cast("array<string>"))
    )


def build_vocab(df: DataFrame, columns: list[str]) -> DataFrame:
    """Stripped, non-blank, distinct values of the columns in code-point order, indexed from 0."""
    values = df.select(F.explode(F.array(*[strip(F.col(c).cast("string")) for c in columns])).alias("label"))
    labels = values.where(nonblank(F.col("label"))).distinct()
    return ordered_prefix(labels, [], ["label"], position="idx")


def encode_labels(df: DataFrame, vocab: DataFrame, column: str, out: str) -> DataFrame:
    return lookup_join(df, vocab.select(F.col("label").alias(column), F.col("idx").alias(out)), column, "inner")


def join_index(wide: DataFrame) -> DataFrame:
    """Keys, split and label columns of each instance; columns the table lacks are left out."""
    keyed = wide.withColumns(
        {
            "embedding_id": instance_key(F.col("contig_id"), F.col("gene_index")),
            "sequence_embedding_key": F.col("exact_sequence_rep_id").cast("string"),
        }
    )
    return keyed.select(*[c for c in JOIN_INDEX_COLUMNS if c in keyed.columns])


def override_split(df: DataFrame, override: DataFrame, key: str = "protein_id") -> DataFrame:
    """Split columns replaced where the override has a row for the key."""
    names = ["split", "split_strategy", "split_version"]
    renamed = override.select(key, *[F.col(c).alias(f"{c}_new") for c in names])
    joined = lookup_join(df, renamed, key, "left")
    return joined.withColumns({c: F.coalesce(f"{c}_new", c) for c in names}).drop(*[f"{c}_new" for c in names])


def overlay(df: DataFrame, hints: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A hint's value wins over the row's own value in each column."""
    if key not in hints.columns:
        raise ValueError(f"hints lack the key column {key}")
    renamed = hints.select(
        key, *[(F.col(c) if c in hints.columns else F.lit(None)).alias(f"{c}_hint") for c in columns]
    )
    joined = lookup_join(df, renamed, key, "left")
    base = {c: F.coalesce(f"{c}_hint", c) if c in df.columns else F.col(f"{c}_hint") for c in columns}
    return joined.withColumns(base).drop(*[f"{c}_hint" for c in columns])


def join_context(main: DataFrame, context: DataFrame, key: str) -> DataFrame:
    """Inner join; columns both sides have get the suffixes ``_main`` and ``_ctx``."""
    both = (set(main.columns) & set(context.columns)) - {key}
    left = main.select(*[F.col(c).alias(f"{c}_main" if c in both else c) for c in main.columns])
    right = context.select(*[F.col(c).alias(f"{c}_ctx" if c in both else c) for c in context.columns])
    return left.join(right, key, "inner")
