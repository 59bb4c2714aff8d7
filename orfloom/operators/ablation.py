"""Run comparison: deltas against the same-seed baseline and a stability verdict per variant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orfloom.operators.skew import lookup_join

# Variant names that count as baselines, and the limits of the stability verdict.
BASELINE_VARIANTS = ("stage1_seq_only", "seq_only")
HANDCRAFTED_VARIANTS = ("seq_ctx", "seq_ctx_handcrafted")
MIN_SEEDS = 3
STABLE_MEAN, STABLE_MIN, STABLE_SD = 0.010, -0.005, 0.015
UNRELIABLE_MIN = -0.010


def delta_vs_baseline(
    runs: DataFrame, variants: tuple[str, ...], metric: str, out: str, run: str = "run_dir"
) -> DataFrame:
    """Metric minus that of the baseline run with the same seed (null without one).

    Of several baseline runs with one seed the last by (variant, run) counts; negative seeds never match.
    """
    base = (
        runs.where(F.col("variant").isin(*variants) & (F.col("seed") >= 0))
        .groupBy("seed")
        .agg(F.max_by(metric, F.struct("variant", run)).alias("__base"))
    )
    joined = lookup_join(runs, base, "seed", "left")
    return joined.withColumn(out, F.col(metric) - F.col("__base")).drop("__base")


def stability(runs: DataFrame, delta: str, baselines: tuple[str, ...] = BASELINE_VARIANTS) -> DataFrame:
    """One line per variant: number, mean, minimum, wins and population deviation of deltas, and the verdict."""
    d = F.col(delta)
    stats = runs.groupBy("variant").agg(
        F.count(delta).alias("n_deltas"),
        F.avg(delta).alias("mean_delta"),
        F.min(delta).alias("min_delta"),
        F.count_if(d > 0).alias("wins"),
        F.stddev_pop(delta).alias("sd_delta"),
    )
    mean, low, sd = F.col("mean_delta"), F.col("min_delta"), F.col("sd_delta")
    gain = (
        (F.col("wins") == F.col("n_deltas")) & (mean >= STABLE_MEAN) & (low > STABLE_MIN) & (sd <= STABLE_SD)
    )
    none = (mean <= 0) | (F.col("wins") <= 1) | (low <= UNRELIABLE_MIN)
    verdict = (
        F.when(F.col("variant").isin(*baselines), F.lit("baseline"))
        .when(F.col("n_deltas") < MIN_SEEDS, F.lit("insufficient_seeds"))
        .when(gain, F.lit("stable_repeatable_gain"))
        .when(none, F.lit("no_reliable_gain"))
        .otherwise(F.lit("weak_or_unstable_gain"))
    )
    return stats.withColumn("stability_label", verdict)


def ablation_report(runs: DataFrame, metric: str = "best_val_l3_macro_f1") -> DataFrame:
    """Runs with both deltas and their variant's verdict."""
    with_base = delta_vs_baseline(runs, BASELINE_VARIANTS, metric, "relative_to_seq_only_l3")
    both = delta_vs_baseline(with_base, HANDCRAFTED_VARIANTS, metric, "relative_to_ctx_handcrafted_l3")
    verdicts = stability(both, "relative_to_seq_only_l3").select("variant", "stability_label")
    return lookup_join(both, verdicts, "variant", "left")
