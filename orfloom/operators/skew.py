"""Joins and sizes that stay sound when one key holds a large share of the rows.

``checked_small`` is the only way this package broadcasts: it sums rows and bytes before it fetches anything, and
returns None when the table is larger, so each caller keeps a shuffle path. ``lookup_join`` attaches a
table that is unique per key. Keys with more than ``hot_rows`` rows on the fact side are few (at most
``rows / hot_rows``); their lookup rows are broadcast, so those facts are not shuffled at all, while the
remaining keys use an ordinary shuffle join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orfloom.session import cut_lineage

SMALL_ROWS = 100_000
SMALL_BYTES = 64 << 20
HOT_ROWS = 2_000_000
PAIRS_PER_TASK = 5_000_000
MAX_PAIR_TASKS = 10_000
PAIR_BLOCK_ROWS = 1_024


def checked_small(df: DataFrame, max_rows: int = SMALL_ROWS, max_bytes: int = SMALL_BYTES) -> DataFrame | None:
    """The table as local rows if it has at most ``max_rows`` rows and ``max_bytes`` bytes, else None.

    One aggregate decides, so a table that is too large never leaves the executors.
    """
    sizes = reduce(lambda a, b: a + b, [_value_bytes(field) for field in df.schema.fields], F.lit(8).cast("long"))
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(sizes), F.lit(0))).first()
    if rows > max_rows or size > max_bytes:
        return None
    return df.sparkSession.createDataFrame(df.toArrow(), schema=df.schema)


def _value_bytes(field: T.StructField) -> Column:
    """Bytes of a value, without the overhead of rows: exact for text and flat arrays, the printed form for nested ones."""
    value, kind = F.col(f"`{field.name.replace('`', '``')}`"), field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(value)
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.NumericType, T.BooleanType)):
        size = F.size(value) * 8
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        size = F.octet_length(F.to_json(F.struct(value)))
    else:
        return F.lit(16).cast("long")
    return F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long")


def small_values(df: DataFrame, column: str, max_rows: int = 10_000) -> list:
    """Sorted distinct non-null values of a class-like column; refuses a column that is not class-like."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    rows = values.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{column} has more than {max_rows} distinct values; it is not a label column")
    return sorted(row[0] for row in rows)


def broadcast_or_plain(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Broadcast hint after a size check; the unchanged table (shuffle join) beyond the bound."""
    small = checked_small(df, max_rows)
    return df if small is None else F.broadcast(small)


def _equal(left: DataFrame, right: DataFrame, keys: list[str], null_safe: bool) -> Column:
    pairs = [left[k].eqNullSafe(right[f"__r_{k}"]) if null_safe else left[k] == right[f"__r_{k}"] for k in keys]
    return reduce(lambda a, b: a & b, pairs)


def _attach(facts: DataFrame, lookup: DataFrame, keys: list[str], how: str, null_safe: bool) -> DataFrame:
    renamed = lookup.select(*[F.col(c).alias(f"__r_{c}" if c in keys else c) for c in lookup.columns])
    return (
        facts.join(_hint_like(lookup, renamed), _equal(facts, renamed, keys, null_safe), how)
        .drop(*[f"__r_{k}" for k in keys])
    )


def _hint_like(lookup: DataFrame, renamed: DataFrame) -> DataFrame:
    return F.broadcast(renamed) if getattr(lookup, "_orfloom_small", False) else renamed


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: str | list[str],
    how: str = "left",
    null_safe: bool = False,
    small_rows: int = SMALL_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Attach ``lookup`` columns to ``facts`` on equal keys (``how``: left or inner).

    Correct for any lookup; meant for one that is unique, or nearly so, per key.
    """
    keys = [on] if isinstance(on, str) else list(on)
    small = checked_small(lookup, small_rows)
    if small is not None:
        small._orfloom_small = True
        return _attach(facts, small, keys, how, null_safe)
    return hot_split_join(facts, lookup, keys, how, null_safe, hot_rows)


def hot_keys(facts: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    """Keys with more than ``hot_rows`` rows: partial counts are combined before the shuffle."""
    return facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_rows).select(*keys)


def checked_hot_keys(facts: DataFrame, keys: list[str], hot_rows: int) -> tuple[DataFrame, int]:
    """The hot keys as a small table and the limit used: the limit grows until the keys fit a broadcast."""
    while True:
        hot = checked_small(hot_keys(facts, keys, hot_rows))
        if hot is not None:
            return hot, hot_rows
        hot_rows *= 8


def _hot_part(
    facts: DataFrame, lookup: DataFrame, keys: list[str], null_safe: bool, hot_rows: int
) -> tuple[DataFrame | None, DataFrame | None]:
    """Hot keys and their lookup rows, both of checked size; (None, None) when no key is hot."""
    while True:
        hot, hot_rows = checked_hot_keys(facts, keys, hot_rows)
        if hot.isEmpty():
            return None, None
        hot._orfloom_small = True
        rows = checked_small(_attach(lookup, hot, keys, "left_semi", null_safe))
        if rows is not None:
            rows._orfloom_small = True
            return hot, rows
        hot_rows *= 8


def hot_split_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: str | list[str],
    how: str = "left",
    null_safe: bool = False,
    hot_rows: int = HOT_ROWS,
    hot_from: DataFrame | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Shuffle join for ordinary keys, broadcast of the lookup rows of the few hot keys.

    ``hot_from`` is a table with the same keys that is cheaper to count, such as a written one. ``rows`` is the number of
    facts, if the caller knows it: keys are not counted where no key can be hot.
    """
    keys = [on] if isinstance(on, str) else list(on)
    hot = hot_lookup = None
    if rows is None or rows > hot_rows:
        hot, hot_lookup = _hot_part(facts if hot_from is None else hot_from, lookup, keys, null_safe, hot_rows)
    any_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    unmatched = None
    if not null_safe:
        # a null key matches nothing: keep such rows out of the shuffle instead of piling them on one task
        unmatched = facts.where(any_null) if how == "left" else None
        facts = facts.where(~any_null)
    if hot is None:
        joined = _attach(facts, lookup, keys, how, null_safe)
    else:
        in_hot = _attach(facts, hot, keys, "left_semi", null_safe)
        in_rest = _attach(facts, hot, keys, "left_anti", null_safe)
        joined = _attach(in_rest, lookup, keys, how, null_safe).unionByName(
            _attach(in_hot, hot_lookup, keys, how, null_safe)
        )
    if unmatched is not None:
        joined = joined.unionByName(unmatched, allowMissingColumns=True)
    return joined


def pairs_join(left: DataFrame, right: DataFrame, on: str, block_rows: int = PAIR_BLOCK_ROWS, pairs_per_task: int = PAIRS_PER_TASK) -> DataFrame:
    """Inner join of two tables whose keys repeat on both sides: the work is the number of pairs, not of rows.

    Each side of a key is dealt to blocks of about ``block_rows`` rows and every pair of blocks is a key of its own, so no task
    has to make all pairs of a key. The number of tasks follows the pairs; tasks planned by bytes would be few. A block of
    ``right`` is one array, so the join makes a row for each block and the pairs come out of a plain loop over it.
    """
    count = F.count(F.lit(1))
    counts = left.groupBy(on).agg(count.alias("__nl")).join(right.groupBy(on).agg(count.alias("__nr")), on)
    counts = cut_lineage(counts)
    pairs = counts.agg(F.sum(F.col("__nl").cast("double") * F.col("__nr"))).first()[0] or 0
    usual = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(usual, min(int(pairs // pairs_per_task) + 1, MAX_PAIR_TASKS))
    sizes = counts.select(on, *[F.ceil(F.col(n) / block_rows).cast("int").alias(b) for n, b in (("__nl", "__bl"), ("__nr", "__br"))])

    def dealt(side: DataFrame, own: str, other: str, at: str, over: str) -> DataFrame:
        rows = lookup_join(side, sizes, on, "inner").withColumn(at, F.pmod(F.xxhash64(*side.columns), F.col(own)).cast("int"))
        blocks = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(over)
        return rows.select(*side.columns, at, blocks).repartition(tasks, on, "__i", "__j")

    first, second = dealt(left, "__bl", "__br", "__i", "__j"), dealt(right, "__br", "__bl", "__j", "__i")
    payload = [c for c in right.columns if c != on]
    blocks = second.groupBy(on, "__i", "__j").agg(F.collect_list(F.struct(*payload)).alias("__block"))
    joined = first.join(blocks.hint("merge"), [on, "__i", "__j"])
    return joined.select(on, *[c for c in left.columns if c != on], F.inline("__block"))
