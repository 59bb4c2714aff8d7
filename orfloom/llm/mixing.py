"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Token counts are summed per cell (source, language, topic). Raking scales the cells until each marginal has its
target share; the ratio of a cell's fitted weight to its tokens, over the largest such ratio, is the chance
with which each of its documents is drawn. Expected tokens of the sample therefore follow the targets exactly,
and no document is drawn twice. Only sums per cell are shuffled or iterated over, never documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orfloom.session import cut_lineage

BREAK = r"[\x20\x09-\x0D]+"
MARGINS = ("source", "lang", "topic")
EXPONENTS = {"source": 0.7, "lang": 0.7, "topic": 1.0}
ROUNDS = 50
TOLERANCE = 1e-6


def n_tokens(text: Column) -> Column:
    """Words of the text, the weight of a document; null and blank texts weigh nothing."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAK), "")).cast("long")


def topic_of(text: Column) -> Column:
    """Kind of content by its marks: ``table``, ``symbols``, ``numbers`` or ``prose``."""
    body = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(body), F.lit(1))
    bars = F.length(body) - F.length(F.replace(body, F.lit("|"), F.lit("")))
    marks = F.length(body) - F.length(F.regexp_replace(body, r"[#*$%&]+", F.lit("")))
    digits = F.length(body) - F.length(F.regexp_replace(body, r"[0-9]+", F.lit("")))
    return (
        F.when(bars * 20 > n, "table").when(marks * 10 > n, "symbols").when(digits * 5 > n, "numbers").otherwise("prose")
    )


def tempered_targets(cells: DataFrame, margin: str, exponent: float) -> DataFrame:
    """(margin, target): shares of the token sums raised to ``exponent``; 1 keeps the natural shares."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("t")).where("t > 0").select(
        margin, F.pow("t", F.lit(exponent)).alias("w")
    )
    total = sums.agg(F.sum("w")).first()[0] or 1.0
    return sums.select(margin, (F.col("w") / F.lit(total)).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` with ``weight``: shares of the whole that meet every marginal target within ``tolerance``.

    A target value without tokens is left out and the rest keep their proportions; a cell whose value has no
    target gets weight 0. Each round is a written table of cells; the largest deviation ends the loop.
    """
    fitted = cut_lineage(cells.withColumn("weight", F.col("tokens").cast("double")))
    for _ in range(rounds):
        gaps = []
        for margin, target in targets.items():
            now = fitted.groupBy(margin).agg(F.sum("weight").alias("__now")).where("__now > 0")
            both = now.join(target, margin)
            scale = both.select(margin, (F.col("target") / F.col("__now")).alias("__scale"))
            fitted = fitted.join(scale, margin, "left").withColumn(
                f"__g_{margin}", F.coalesce("__scale", F.lit(0.0))
            ).withColumn("weight", F.col("weight") * F.col(f"__g_{margin}")).drop("__scale")
            gaps.append(f"__g_{margin}")
        fitted = cut_lineage(fitted)
        # after the first scaling of a round has settled, every factor of the next ones is 1
        worst = fitted.where("weight > 0").agg(*[F.max(F.abs(F.col(g) - 1)).alias(g) for g in gaps]).first()
        done = all(w is None or w <= tolerance for w in worst)
        fitted = fitted.drop(*gaps)
        if done:
            break
    return fitted


def draw_uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the keys only."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def calibrated(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    exponents: dict[str, float] | None = None,
    targets: dict[str, DataFrame] | None = None,
    topic: Column | None = None,
    seed: int = 8,
) -> DataFrame:
    """The rows with ``n_tokens``, ``topic``, ``probability`` and ``sampled``.

    ``targets`` may give (value, target) tables per margin; others are the tempered shares of ``exponents``. A
    null source or language is a value of its own. Documents without tokens carry no weight and follow their
    cell; a cell without tokens has probability 0. Repeated rows draw alike; an empty table gives no rows.
    """
    marked = docs.withColumns({
        "n_tokens": n_tokens(F.col(text).cast("string")),
        "topic": topic_of(F.col(text).cast("string")) if topic is None else topic,
    })
    safe = {m: F.coalesce(F.col(m).cast("string"), F.lit("\x00")).alias(m) for m in MARGINS}
    cells = cut_lineage(
        marked.select("n_tokens", *safe.values()).groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"))
    )
    powers = EXPONENTS | (exponents or {})
    wanted = {m: (targets or {}).get(m) for m in MARGINS}
    wanted = {m: cut_lineage(tempered_targets(cells, m, powers[m]) if t is None else t) for m, t in wanted.items()}
    ratios = cut_lineage(rake(cells, wanted)).select(
        *[F.col(m).alias(f"__{m}") for m in MARGINS],
        F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(F.lit(0.0)).alias("__ratio"),
    )
    top = ratios.agg(F.max("__ratio")).first()[0] or 1.0
    chances = cut_lineage(ratios.withColumn("__p", F.col("__ratio") / F.lit(top)))
    same = reduce(lambda a, b: a & b, [safe[m] == F.col(f"__{m}") for m in MARGINS])
    joined = marked.join(chances, same, "left")
    out = joined.withColumn("probability", F.col("__p")).withColumn(
        "sampled", draw_uniform(seed, F.col(key)) < F.col("probability")
    )
    return out.drop("__p", "__ratio", *[f"__{m}" for m in MARGINS])
