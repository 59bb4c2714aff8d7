"""Leakage-free splits by unit: balanced by size classes, or seeded random."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orfloom.operators.ordering import hash_order, hash_position
from orfloom.operators.quality import check_ratios
from orfloom.operators.skew import lookup_join
from orfloom.session import cut_lineage

SPLITS = ("train", "val", "test")


def unit_stats(df: DataFrame, unit: str, status: str = "status") -> DataFrame:
    """Rows and supervised rows per unit; a null status counts as supervised, a null unit is a unit."""
    return df.groupBy(unit).agg(
        F.count(F.lit(1)).alias("total_count"),
        F.count_if(F.coalesce(F.col(status), F.lit("")) != "open_set").alias("supervised_count"),
    )


class Quotas:
    """Greedy balancing over size classes (rows, supervised rows, units), largest first, in exact arithmetic.

    A unit goes to the split with the largest remaining share of its target, ties to the first one. Units of a class are
    interchangeable, and a split's score falls by the same step with each of them, so a class is a merge of one falling
    progression for each split: the picks are those above a threshold, found by bisection over integers (all scores on one
    common denominator), and those on it in the order of the splits.
    """

    def __init__(self, rows: int, supervised: int, ratios: tuple[float, ...], alpha: float = 0.5):
        shares = [Fraction(str(r)) for r in ratios]
        targets = [(max(rows * r, Fraction(1)), max(supervised * r, Fraction(1))) for r in shares]
        weight = Fraction(str(alpha))
        per_row = [1 / t for t, _ in targets]
        per_supervised = [weight / s for _, s in targets]
        scores = [rows * r / t + weight * (supervised * r / s) for r, (t, s) in zip(shares, targets, strict=True)]
        unit = math.lcm(*[f.denominator for f in (*per_row, *per_supervised, *scores)])
        self._row, self._supervised, self._scores = (
            [int(f * unit) for f in values] for values in (per_row, per_supervised, scores)
        )

    def place(self, total: int, supervised: int, units: int) -> list[int]:
        """How many of the next class's units go to each split; classes come in their order."""
        steps = [total * r + supervised * s for r, s in zip(self._row, self._supervised, strict=True)]

        def above(level: int) -> list[int]:
            return [max(0, -((level - a) // d)) for a, d in zip(self._scores, steps, strict=True)]

        if not any(steps):
            return [units, *[0] * (len(steps) - 1)]
        low = min(a - units * d for a, d in zip(self._scores, steps, strict=True)) - 1  # more than ``units`` are above
        high = max(self._scores)  # none is
        while high - low > 1:
            middle = (low + high) // 2
            if sum(above(middle)) > units:
                low = middle
            else:
                high = middle
        placed, upto = above(high), above(high - 1)
        left = units - sum(placed)
        for k, more in enumerate(upto):
            give = min(left, more - placed[k])
            placed[k] += give
            left -= give
        self._scores = [a - n * d for a, n, d in zip(self._scores, placed, steps, strict=True)]
        return placed


_QUOTAS = "total_count long, supervised_count long, n_train long, n_val long, n_test long"


def class_quotas(
    histogram: DataFrame, rows: int, supervised: int, ratios: tuple[float, float, float], alpha: float = 0.5
) -> DataFrame:
    """The quotas of every size class (total_count, supervised_count, units), a written table.

    Each class starts from the shares that the larger ones left, so they pass in order through one task, as a sorted stream of
    which one batch is held; a class is one row whatever its number of units.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        quotas = Quotas(rows, supervised, ratios, alpha)
        for pdf in batches:
            classes = zip(*[pdf[c].tolist() for c in ("total_count", "supervised_count", "units")], strict=True)
            placed = [quotas.place(*c) for c in classes]
            out = pdf[["total_count", "supervised_count"]].copy()
            for k, name in enumerate(SPLITS):
                out[f"n_{name}"] = [p[k] for p in placed]
            yield out

    ordered = histogram.repartition(1).sortWithinPartitions(F.desc("total_count"), F.desc("supervised_count"))
    return cut_lineage(ordered.mapInPandas(walk, _QUOTAS))


def balanced_group_split(
    df: DataFrame,
    unit: str,
    status: str = "status",
    ratios: tuple[float, float, float] = (0.70, 0.15, 0.15),
    alpha: float = 0.5,
    seed: int = 42,
    strategy: str = "homology_cluster",
    version: str = "homology_cluster_v1",
) -> DataFrame:
    """Every row with its ``split``; all rows of a unit share it.

    The quotas of the size classes and the units are tables; nothing but two sums reaches the driver.
    """
    check_ratios(*ratios)
    units = cut_lineage(unit_stats(df, unit, status))
    histogram = units.groupBy("total_count", "supervised_count").agg(F.count(F.lit(1)).alias("units"))
    totals = units.agg(F.sum("total_count"), F.sum("supervised_count")).first()
    quotas = class_quotas(histogram, totals[0] or 0, totals[1] or 0, ratios, alpha)
    digests = units.withColumn("__digest", hash_order(F.col(unit), seed))
    placed = lookup_join(
        hash_position(digests, ["total_count", "supervised_count"], "__digest", unit, "__pos"),
        quotas,
        ["total_count", "supervised_count"],
        "inner",
    )
    split = (
        F.when(F.col("__pos") < F.col("n_train"), F.lit("train"))
        .when(F.col("__pos") < F.col("n_train") + F.col("n_val"), F.lit("val"))
        .otherwise(F.lit("test"))
    )
    assigned = cut_lineage(placed.select(unit, split.alias("split")))
    return _named(lookup_join(df, assigned, unit, "left", null_safe=True), strategy, version)


def random_group_split(
    df: DataFrame,
    unit: str,
    seed: int = 20260329,
    train: float = 0.70,
    val: float = 0.15,
    strategy: str = "genome_context",
    version: str = "genome_context_v1",
) -> DataFrame:
    """Units in seeded order, cut at the train and train + val shares."""
    units = cut_lineage(df.select(unit).where(F.col(unit).isNotNull()).distinct())
    placed = hash_position(units.withColumn("__digest", hash_order(F.col(unit), seed)), [], "__digest", unit, "__pos")
    n = units.agg(F.count(F.lit(1)).alias("n")).scalar()
    split = (
        F.when(F.col("__pos") < F.floor(n * train), F.lit("train"))
        .when(F.col("__pos") < F.floor(n * (train + val)), F.lit("val"))
        .otherwise(F.lit("test"))
    )
    joined = lookup_join(df, placed.select(unit, split.alias("split")), unit, "left")
    return _named(joined.withColumn("split", F.coalesce("split", F.lit("test"))), strategy, version)


def _named(df: DataFrame, strategy: str, version: str) -> DataFrame:
    return df.withColumns({"split_strategy": F.lit(strategy), "split_version": F.lit(version)})


def leakage_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """(key_name, crossing): how many values of each key occur in more than one split."""
    named = F.array(*[F.struct(F.lit(k).alias("key_name"), F.col(k).cast("string").alias("value")) for k in keys])
    spans = df.select("split", F.inline(named)).groupBy("key_name", "value").agg(
        F.min("split").alias("low"), F.max("split").alias("high")
    )
    return spans.groupBy("key_name").agg(F.count_if(F.col("low") != F.col("high")).alias("crossing"))


def split_summary(df: DataFrame, unit: str, status: str = "status") -> DataFrame:
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.coalesce(F.col(status), F.lit("")) != "open_set").alias("supervised"),
        F.count_distinct(unit).alias("units"),
    )
