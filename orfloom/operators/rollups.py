"""Counts, summaries and group rollups. All aggregate partially before their shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orfloom.functions import nonblank
from orfloom.operators.skew import lookup_join


def value_counts(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Rows per value (null shown as empty text), most frequent first."""
    value = F.coalesce(F.col(column).cast("string"), F.lit("")).alias("value")
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")
    return counts if k is None else counts.limit(k)


def stats_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(section, value, count) of every column in one pass: the columns are unpivoted, then counted."""
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("section"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value"))
            for c in columns
        ]
    )
    return df.select(F.inline(entries)).groupBy("section", "value").agg(F.count(F.lit(1)).alias("count"))


def missing_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_if(~nonblank(F.col(column))).alias("missing"), F.count(F.lit(1)).alias("total"))


def concat_distinct(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per key and column: the sorted distinct non-blank values joined by ``|``."""
    entries = F.array(
        *[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    pairs = df.select(key, F.inline(entries)).where(nonblank(F.col("value"))).distinct()
    joined = pairs.groupBy(key).agg(
        *[
            F.array_join(F.array_sort(F.collect_list(F.when(F.col("name") == c, F.col("value")))), "|").alias(c)
            for c in columns
        ]
    )
    return joined


def rollup_exact(
    df: DataFrame, key: str, order: Column, first: list[str], core: Column, split: str | None = None
) -> DataFrame:
    """Per exact group: first non-null value of each column, whether any row is core, distinct splits."""
    aggs = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in first]
    aggs.append(F.bool_or(core).alias("any_core"))
    if split is not None:
        aggs.append(F.count_distinct(split).cast("int").alias("split_count"))
    return df.groupBy(key).agg(*aggs)


def any_not_null(df: DataFrame, columns: list[str], out: str = "ready") -> DataFrame:
    return df.withColumn(out, F.coalesce(*columns).isNotNull())


def ready_summary(df: DataFrame, flag: str) -> DataFrame:
    """Row count, ready count and ready fraction (6 digits, 0 for an empty table)."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col(flag)).alias("ready_count"),
        F.coalesce(F.round(F.avg(F.col(flag).cast("double")), 6), F.lit(0.0)).alias("ready_fraction"),
    )


def family_rollup(df: DataFrame, family: str, length: str, core: str, archive: str) -> DataFrame:
    """Per family: members, median length, any core member, archive name."""
    return df.groupBy(family).agg(
        F.count(F.lit(1)).alias("members"),
        F.median(length).alias("median_length"),
        F.bool_or(core).alias("any_core"),
        F.min(archive).alias("archive"),
    ).orderBy(F.desc("members"), family)


def coverage_summary(assets: DataFrame, total_exact: int | Column, source: str = "source_name") -> DataFrame:
    """Matched rows and exact groups per source, with a last line ``union`` over all sources."""
    exact = F.col("exact_sequence_rep_id")
    measures = [
        F.count(F.lit(1)).alias("file_count"),
        F.count_if("matched_any").alias("matched_count"),
        F.count_if("matched_core").alias("matched_core_count"),
        F.count_distinct(exact).alias("exact_count"),
        F.count_distinct(F.when(F.col("matched_core"), exact)).alias("core_exact_count"),
        F.array_join(F.array_sort(F.collect_set("confidence_scale")), "|").alias("scales"),
    ]
    per_source = assets.groupBy(source).agg(*measures)
    union = assets.agg(*measures).select(F.lit("union").alias(source), "*")
    total = F.lit(total_exact) if isinstance(total_exact, int) else total_exact
    fraction = F.when(total > 0, F.round(F.col("exact_count") / total, 6)).otherwise(F.lit(0.0))
    return per_source.unionByName(union).withColumn("exact_fraction", fraction)


def run_status_summary(df: DataFrame, status: str, ok: tuple[str, ...]) -> DataFrame:
    return df.groupBy(status).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(status).isin(*ok)).alias("succeeded")
    )


def pack_summary(packs: DataFrame, cluster: str, exact: str) -> DataFrame:
    return packs.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(cluster).alias("clusters"),
        F.count_distinct(exact).alias("exact_groups"),
    )


def fill_stats(packs: DataFrame, mask: str = "modality_mask") -> DataFrame:
    return packs.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        *[
            F.count_if(F.get(mask, F.lit(i))).alias(f"{name}_filled")
            for i, name in enumerate(("sequence", "structure", "context"))
        ],
    )


def class_weights(df: DataFrame, label: str, vocab: DataFrame) -> DataFrame:
    """total / (classes * count) per vocabulary label, 0 for labels without rows."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    present = lookup_join(vocab.select("label"), counts, "label", "left")
    totals = present.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("classes"))
    weight = totals.select(F.col("total") / F.col("classes")).scalar()
    return present.select("label", F.coalesce(weight / F.col("n"), F.lit(0.0)).alias("weight"))


def hierarchy_map(df: DataFrame, child: str, parent: str, vocab: DataFrame | None = None) -> DataFrame:
    """Child to parent; a child with two parents is an error, an unseen vocabulary child gets -1."""
    seen = df.where(F.col(child).isNotNull() & F.col(parent).isNotNull()).groupBy(child).agg(
        F.min(parent).alias(parent), F.max(parent).alias("__other")
    )
    clashes = seen.where(F.col(parent) != F.col("__other")).limit(5).collect()
    if clashes:
        raise ValueError(f"{child} with more than one {parent}: {[r[0] for r in clashes]}")
    seen = seen.drop("__other")
    if vocab is None:
        return seen
    joined = lookup_join(vocab.select(F.col("idx").alias(child)), seen, child, "left")
    return joined.select(child, F.coalesce(parent, F.lit(-1)).alias(parent))


def share_of_total(df: DataFrame, column: str) -> DataFrame:
    """Rows per value with their percentage of all rows."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.withColumn("percent", F.round(F.col("n") * 100.0 / total, 6))
