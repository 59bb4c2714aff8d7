"""Mapping review: version differences, tracking counts, processing log, negatives and new-class candidates."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orfloom.functions import nonblank
from orfloom.operators.ordering import hash_uniform
from orfloom.operators.skew import broadcast_or_plain

# Label pairs that must not serve as each other's hard negatives.
NOT_HARD_NEGATIVES = (
    ("Tail_spike", "Cell_wall_depolymerase"),
    ("DNA_ejection_protein", "Internal_virion_protein"),
    ("Anti_CRISPR", "Anti_restriction"),
)


def mapping_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Changed terms between two mapping versions with a change type.

    Both tables have ``node_primary``, ``secondary_node`` and ``status``, one row per key.
    """
    fields = ["node_primary", "secondary_node", "status"]
    before = old.select(key, *[F.col(c).alias(f"old_{c}") for c in fields], F.lit(True).alias("__old"))
    after = new.select(key, *[F.col(c).alias(f"new_{c}") for c in fields], F.lit(True).alias("__new"))
    both = before.join(after, key, "full_outer")
    changed = F.lit(False)
    for c in fields:
        changed = changed | ~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    kind = (
        F.when(F.col("__old").isNull(), F.lit("term_added"))
        .when(F.col("__new").isNull(), F.lit("term_removed"))
        .when((F.col("new_status") == "defer") & ~F.col("old_status").eqNullSafe("defer"), F.lit("downgrade_to_defer"))
        .when((F.col("old_status") == "parent_only") & (F.col("new_status") == "trainable_core"), F.lit("parent_only_to_l3"))
        .when(~F.col("old_node_primary").eqNullSafe(F.col("new_node_primary")), F.lit("primary_reassignment"))
        .when(~nonblank(F.col("old_secondary_node")) & nonblank(F.col("new_secondary_node")), F.lit("secondary_added"))
        .otherwise(F.lit("other"))
    )
    return both.where(changed).select(
        key, *[f"old_{c}" for c in fields], *[f"new_{c}" for c in fields], kind.alias("change_type")
    )


def tracking_rollup(df: DataFrame, status: str, priority: str) -> DataFrame:
    return df.groupBy(status, priority).agg(F.count(F.lit(1)).alias("n"))


def processing_log(wide: DataFrame) -> DataFrame:
    """Input rows, rows with and without a mapping, and rows after expanding to one row per label."""
    primary, secondary = nonblank(F.col("node_primary")), nonblank(F.col("secondary_node"))
    return wide.agg(
        F.count(F.lit(1)).alias("input_rows"),
        F.count_if(primary).alias("matched_rows"),
        F.count_if(~primary).alias("unmatched_rows"),
        F.coalesce(F.sum(primary.cast("int") + secondary.cast("int")), F.lit(0)).cast("long").alias("expanded_rows"),
    )


def allowed_negatives(labels: DataFrame, exclusions: tuple[tuple[str, str], ...] = NOT_HARD_NEGATIVES) -> DataFrame:
    """(label, negatives): all other labels of the vocabulary except the excluded partners."""
    pairs = [p for a, b in exclusions for p in ((a, b), (b, a))]
    partners = labels.sparkSession.createDataFrame(pairs, "label string, partner string")
    excluded = partners.groupBy("label").agg(F.collect_set("partner").alias("partners"))
    everything = labels.agg(F.array_sort(F.collect_set("label"))).scalar()
    joined = labels.select("label").distinct().join(F.broadcast(excluded), "label", "left")  # a fixed table
    banned = F.concat(F.array("label"), F.coalesce("partners", F.array().cast("array<string>")))
    return joined.withColumn("everything", everything).select(
        "label", F.array_except("everything", banned).alias("negatives")
    )


def draw_negative(df: DataFrame, label: str, key: str, negatives: DataFrame, seed: int) -> DataFrame:
    """One seeded negative label per row from those its label allows."""
    table = negatives.select(F.col("label").alias(label), "negatives")
    joined = df.join(broadcast_or_plain(table), label, "left")
    pick = F.floor(hash_uniform(seed, F.col(key)) * F.size("negatives")).cast("int")
    return joined.withColumn("negative", F.get("negatives", pick)).drop("negatives")


def vector_clusters(df: DataFrame, vec: str, k: int, seed: int = 42) -> DataFrame:
    """k-means cluster of each vector; only the centres travel between rounds."""
    featured = df.withColumn("__features", array_to_vector(F.col(vec).cast("array<double>")))
    model = KMeans(k=k, seed=seed, featuresCol="__features", predictionCol="cluster").fit(featured)
    return model.transform(featured).drop("__features")
