"""Balanced and shuffled sampling of row ids, reproducible from a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orfloom.operators.ordering import hash_uniform, ordered_prefix, permuted
from orfloom.operators.skew import HOT_ROWS, hot_split_join
from orfloom.session import cut_lineage

LINE = float(1 << 61)
FINE = float(1 << 40)
DIGITS = 1 << 60


def group_sizes(df: DataFrame, cluster: str, exact: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every row with the sizes of its cluster and of its exact group inside the cluster."""
    groups, clusters = _group_tables(df, cluster, exact)
    sized = hot_split_join(groups, clusters.select(cluster, "cluster_size"), cluster, "inner", hot_rows=hot_rows)
    return hot_split_join(df, sized, [cluster, exact], "inner", hot_rows=hot_rows)


def _group_tables(df: DataFrame, cluster: str, exact: str, q: float = 1.0) -> tuple[DataFrame, DataFrame]:
    groups = cut_lineage(df.groupBy(cluster, exact).agg(F.count(F.lit(1)).alias("exact_size")))
    clusters = groups.groupBy(cluster).agg(
        F.sum("exact_size").alias("cluster_size"),
        F.count(F.lit(1)).alias("exact_groups"),
        F.sum(_power("exact_size", q)).alias("exact_weight_sum"),
    )
    return groups, clusters


def _power(size: str, p: float) -> Column:
    value = F.col(size).cast("double")
    return F.lit(1.0) / value if p == 1 else F.pow(value, F.lit(-float(p)))


def sampling_probability(
    df: DataFrame, cluster: str, exact: str, p: float = 1.0, q: float = 1.0, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Every row with the chance that one balanced draw picks it; the chances add up to 1."""
    groups, clusters = _group_tables(df, cluster, exact, q)
    total = clusters.agg(F.sum(_power("cluster_size", p))).scalar()
    chances = clusters.select(
        cluster, (_power("cluster_size", p) / total).alias("__cluster"), "exact_weight_sum"
    )
    joined = hot_split_join(groups, chances, cluster, "inner", hot_rows=hot_rows)
    per_row = joined.select(
        cluster,
        exact,
        (F.col("__cluster") * (_power("exact_size", q) / F.col("exact_weight_sum")) / F.col("exact_size")).alias(
            "sampling_probability"
        ),
    )
    return hot_split_join(df, per_row, [cluster, exact], "inner", hot_rows=hot_rows)


def _place(seed: str, draw: Column, total: Column) -> Column:
    """floor(u * total) for a uniform number given as a 60-bit integer, in exact arithmetic."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.lit("draw"), draw.cast("string")))
    product = F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(38,0)") * total.cast("decimal(20,0)")
    return F.call_function("div", product, F.lit(DIGITS).cast("decimal(20,0)"))


def _cells(lo: Column, hi: Column, total: Column, cells: Column) -> Column:
    """Cells of an even grid over [0, total) that the interval [lo, hi) touches."""
    first = F.floor(lo.cast("double") / total * cells).cast("long") - 1
    last = F.floor(hi.cast("double") / total * cells).cast("long") + 1
    return F.sequence(F.greatest(first, F.lit(0)), F.least(last, cells.cast("long")))


def balanced_draws(
    df: DataFrame,
    cluster: str,
    exact: str,
    key: str,
    n: int,
    seed: int,
    epoch: int = 0,
    p: float = 1.0,
    q: float = 1.0,
    shuffle_within_group: bool = True,
) -> DataFrame:
    """(draw, key): n draws with replacement; cluster by size^-p, exact group by size^-q, then a uniform row.

    Cluster, group and row are one choice: every row is an interval of a line, as long as its chance, and a draw is a place
    on the line. Draws are uniform there whatever the clusters, so they find their interval by an equality join on the cells
    of an even grid, with the interval test on top; no join by cluster or group carries draws. Lengths are whole numbers
    from exact sums, so the line does not depend on the order of rows. Without ``shuffle_within_group`` the first row of a
    group stands for all.
    """
    name = str(seed + epoch)
    lengths = _lengths(df, cluster, exact, key, p, q, shuffle_within_group)
    line = ordered_prefix(lengths, [], [cluster, exact, key], "__i", {"__hi": F.col("__len")})
    line = cut_lineage(line.select(key, "__len", "__hi"))
    count, total = (int(x or 0) for x in line.agg(F.count(F.lit(1)), F.max("__hi")).first())
    if count == 0:
        raise ValueError("no rows to draw from")
    lo, width = F.col("__hi") - F.col("__len"), F.lit(float(total))
    spans = line.select(key, lo.alias("__lo"), "__hi", F.explode(_cells(lo, F.col("__hi"), width, F.lit(count))).alias("__cell"))
    draws = df.sparkSession.range(n).withColumnRenamed("id", "draw")
    at = draws.withColumn("__at", _place(name, F.col("draw"), F.lit(total)))
    at = at.withColumn("__cell", F.floor(F.col("__at").cast("double") / width * F.lit(count)).cast("long"))
    return at.join(spans, "__cell").where("__at >= __lo AND __at < __hi").select("draw", key)


def _lengths(df: DataFrame, cluster: str, exact: str, key: str, p: float, q: float, every_row: bool) -> DataFrame:
    """(cluster, exact, key, __len): the rows that can be drawn with the lengths of their chances, at least 1."""
    groups = cut_lineage(df.groupBy(cluster, exact).agg(F.count(F.lit(1)).alias("exact_size"), F.min(key).alias("__first")))
    fine = groups.withColumn("__group", F.greatest(F.floor(_power("exact_size", q) * FINE).cast("long"), F.lit(1)))
    clusters = fine.groupBy(cluster).agg(F.sum("exact_size").alias("cluster_size"), F.sum("__group").alias("__groups"))
    clusters = cut_lineage(
        clusters.withColumn("__cluster", F.greatest(F.floor(_power("cluster_size", p) * FINE).cast("long"), F.lit(1)))
    )
    whole = clusters.agg(F.sum(F.col("__cluster").cast("decimal(38,0)"))).first()[0] or 0
    share = F.col("__cluster").cast("double") / F.lit(float(whole)) * F.col("__group").cast("double") / F.col("__groups").cast("double")
    owned = hot_split_join(fine, clusters, cluster, "inner")
    if not every_row:
        length = F.greatest(F.floor(share * LINE).cast("long"), F.lit(1))
        return owned.select(cluster, exact, F.col("__first").alias(key), length.alias("__len"))
    length = F.greatest(F.floor(share / F.col("exact_size").cast("double") * LINE).cast("long"), F.lit(1))
    sized = owned.select(cluster, exact, length.alias("__len"))
    return hot_split_join(df.select(cluster, exact, key), sized, [cluster, exact], "inner")


def epoch_permutation(df: DataFrame, key: str, n: int, seed: int, epoch: int = 0) -> DataFrame:
    """(sample_no, key): seeded shuffles of all rows one after another until ``n`` samples are out.

    Rows are numbered once, in the order of their keys; every round is a keyed permutation of these numbers, so further rounds and
    epochs neither sort nor shuffle.
    """
    numbered = cut_lineage(ordered_prefix(df.select(key), [], [key], "__no"))
    size = numbered.count()
    rounds = max(-(-n // size), 1) if size else 1
    repeated = numbered.withColumn("__round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    place = permuted(F.col("__no"), size, seed + epoch, F.col("__round"))
    out = repeated.select((F.col("__round").cast("long") * size + place).alias("sample_no"), key)
    return out.where(F.col("sample_no") < n)


def modality_dropout(df: DataFrame, mask: str, key: str, p: float, seed: int) -> DataFrame:
    """Clear presence bits with chance ``p``, independently per modality; the first modality stays."""
    bits = [F.get(mask, F.lit(0))]
    for i in (1, 2):
        bits.append(F.get(mask, F.lit(i)) & (hash_uniform(f"{seed}|{i}", F.col(key)) > p))
    return df.withColumn(mask, F.array(*bits) if p > 0 else F.col(mask))
