"""Checks: each returns a table of violations or raises; all of them scan whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != 1)


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    examples = duplicate_keys(df, keys).limit(5).collect()
    if examples:
        raise ValueError(f"duplicate keys {keys}: {[tuple(r) for r in examples]}")
    return df


def check_contract(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations): rows for which a rule is false or null, all rules in one pass."""
    counts = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])
    return counts.select(F.inline(pairs))


def require_contract(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    broken = check_contract(df, rules).where("violations > 0").collect()
    if broken:
        raise ValueError(f"contract violated: {[(r.rule, r.violations) for r in broken]}")
    return df


def key_fingerprint(df: DataFrame, key: str | list[str]) -> DataFrame:
    """(rows, low, high): count and two exact sums of hashes, equal for equal multisets of keys in any order.

    Two tables are compared without a join or a sort; multisets that differ agree with a chance below 2^-100.
    """
    keys = [F.col(k).cast("string") for k in ([key] if isinstance(key, str) else key)]
    named = F.to_json(F.array(*keys))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.coalesce(F.sum(F.xxhash64(F.lit(salt), named).cast("decimal(38,0)")), F.lit(0)).alias(n) for salt, n in ((1, "low"), (2, "high"))],
    )


def check_manifest(
    df: DataFrame,
    rules: dict[str, Column],
    vocabularies: dict[str, tuple[DataFrame, int]] | None = None,
    aligned: dict[str, tuple[DataFrame, DataFrame, str | list[str]]] | None = None,
) -> DataFrame:
    """(rule, violations) of a table against its manifest: row rules, sizes of label vocabularies, alignment of keys.

    A vocabulary violates by the difference of its number of rows from the expected one; two tables whose multisets of keys
    differ violate once. All rows are read, in one pass for each table.
    """
    out = check_contract(df, rules)
    for name, (vocabulary, expected) in (vocabularies or {}).items():
        size = vocabulary.agg(F.abs(F.count(F.lit(1)) - F.lit(expected)).alias("violations"))
        out = out.unionByName(size.select(F.lit(name).alias("rule"), F.col("violations").cast("long").alias("violations")))
    for name, (left, right, key) in (aligned or {}).items():
        both = key_fingerprint(left, key).unionByName(key_fingerprint(right, key))
        apart = both.agg((F.count_distinct(F.struct("rows", "low", "high")) - 1).cast("long").alias("violations"))
        out = out.unionByName(apart.select(F.lit(name).alias("rule"), "violations"))
    return out


def ratio_report(df: DataFrame, split: str, ratios: dict[str, float]) -> DataFrame:
    """(split, rows, share, wanted): the shares that a split really has beside those it was made for; absent splits have 0 rows."""
    check_ratios(*ratios.values())
    wanted = F.array(*[F.struct(F.lit(k).alias("split"), F.lit(float(v)).alias("wanted")) for k, v in ratios.items()])
    sums = df.agg(F.count(F.lit(1)).alias("all"), *[F.count_if(F.col(split) == k).alias(f"n_{k}") for k in ratios])
    rows = F.create_map(*[x for k in ratios for x in (F.lit(k), F.col(f"n_{k}"))])
    flat = sums.select("all", rows.alias("m"), F.inline(wanted))
    n = F.element_at("m", F.col("split"))
    return flat.select("split", n.alias("rows"), (n / F.nullif(F.col("all"), F.lit(0))).alias("share"), "wanted")


def column_report(df: DataFrame, required: list[str]) -> DataFrame:
    """(column, present, filled): whether the table has each required column and in how many rows it is not null."""
    filled = {c: F.count(F.col(f"`{c}`")) if c in df.columns else F.lit(0).cast("long") for c in required}
    sums = df.agg(F.count(F.lit(1)).alias("__rows"), *[n.alias(f"__{i}") for i, n in enumerate(filled.values())])
    rows = [
        F.struct(F.lit(c).alias("column"), F.lit(c in df.columns).alias("present"), F.col(f"__{i}").alias("filled"))
        for i, c in enumerate(required)
    ]
    return sums.select(F.inline(F.array(*rows)))


def dims_report(df: DataFrame, dims: dict[str, int]) -> DataFrame:
    """(rule, violations) for vector columns that must have a fixed size."""
    return check_contract(df, {c: F.size(c) == n for c, n in dims.items()})


def require_dims(df: DataFrame, dims: dict[str, int]) -> DataFrame:
    return require_contract(df, {c: F.size(c) == n for c, n in dims.items()})


def missing_keys(df: DataFrame, lookup: DataFrame, on: str) -> DataFrame:
    return df.join(lookup.select(on), on, "left_anti")


def require_covered(df: DataFrame, lookup: DataFrame, on: str, what: str = "rows") -> DataFrame:
    """Every row must find its key; otherwise an error that says how many did."""
    row = missing_keys(df, lookup, on).agg(F.count(F.lit(1)).alias("n")).first()
    if row.n:
        total = df.count()
        raise ValueError(f"{what}: filled {total - row.n}/{total} on {on}")
    return df


def check_ratios(*ratios: float) -> None:
    if abs(sum(ratios) - 1.0) > 1e-6:
        raise ValueError("split ratios must add up to 1")


def is_small(df: DataFrame, n: int) -> bool:
    """Whether the table has fewer than ``n`` rows, without counting all of them."""
    return df.limit(n).count() < n


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def index_metadata(index: DataFrame, key: str) -> DataFrame:
    return index.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct("shard_no").alias("shard_count"),
        F.lit(key).alias("key_name"),
    )
