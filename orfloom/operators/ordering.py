"""Ordered operators without a one-task window: positions, running totals and neighbours.

A window without partition columns, or over one very large partition, sorts everything in one task.
``ordered_prefix`` range-partitions the rows by (partition columns, order columns), keeps the partition
number, adds the counts and sums of earlier ranges, and numbers rows only within a range. The ranged rows
are written out first, because a range partitioning computed twice may cut at different places.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orfloom.operators.skew import HOT_ROWS, checked_hot_keys
from orfloom.session import cut_lineage

RANGE = "__range"


def ordered_prefix(
    df: DataFrame,
    part: list[str],
    order: list[Column | str],
    position: str = "position",
    totals: dict[str, Column] | None = None,
) -> DataFrame:
    """Add the 0-based ``position`` within ``part`` and an inclusive running total per entry of ``totals``.

    ``order`` must end in a unique key.
    """
    totals = totals or {}
    sort_keys = [F.col(p) for p in part] + [F.col(o) if isinstance(o, str) else o for o in order]
    valued = df.withColumns({f"__v_{n}": c for n, c in totals.items()}) if totals else df
    ranged = cut_lineage(valued.repartitionByRange(*sort_keys).withColumn(RANGE, F.spark_partition_id()))
    per_range = ranged.groupBy(*part, RANGE).agg(
        F.count(F.lit(1)).alias("__n"), *[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in totals]
    )
    # a group spans as many ranges as it needs, so this window holds at most one row per range of a group
    earlier = Window.partitionBy(*part).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    before = {"__n": "__n_before", **{f"__s_{n}": f"__b_{n}" for n in totals}}
    offsets = per_range.select(
        *part, RANGE, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(out) for c, out in before.items()]
    )
    keyed = [F.col(f"l.{p}").eqNullSafe(F.col(f"r.{p}")) for p in part] + [F.col(f"l.{RANGE}") == F.col(f"r.{RANGE}")]
    if not part:
        offsets = F.broadcast(offsets)  # one row per range
    joined = ranged.alias("l").join(offsets.alias("r"), keyed, "inner").select(
        "l.*", *[f"r.{c}" for c in before.values()]
    )
    inside = Window.partitionBy(*part, RANGE).orderBy(*sort_keys[len(part):])
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = {position: (F.col("__n_before") + F.row_number().over(inside) - 1).cast("long")}
    added |= {n: F.col(f"__b_{n}") + F.sum(f"__v_{n}").over(so_far) for n in totals}
    return joined.withColumns(added).select(*df.columns, *added)


def hash_order(key: Column, seed: int | str) -> Column:
    """Seeded pseudo-random order of ids: the text digest of ``seed|id``."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def hash_uniform(seed: int | str, *keys: Column) -> Column:
    """Uniform number in [0, 1) from the first 13 hex digits (52 bits) of a digest of the keys."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def hash_position(df: DataFrame, part: list[str], digest: str, tie: str, position: str = "position") -> DataFrame:
    """0-based position within ``part`` in the order of a hex digest column.

    Digests are uniform, so their first three digits cut every group into up to 4096 even ranges: no
    sampling and no checkpoint are needed, and a group of any size spreads over all tasks.
    """
    ranged = df.withColumn(RANGE, F.substring(digest, 1, 3))
    earlier = Window.partitionBy(*part).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*part, RANGE)
        .agg(F.count(F.lit(1)).alias("__rows"))
        .select(*part, RANGE, F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__rows_before"))
    )
    if not part:
        offsets = F.broadcast(offsets)  # at most 4096 rows
    keyed = [F.col(f"l.{p}").eqNullSafe(F.col(f"r.{p}")) for p in part] + [F.col(f"l.{RANGE}") == F.col(f"r.{RANGE}")]
    inside = Window.partitionBy(*part, RANGE).orderBy(digest, tie)
    return (
        ranged.alias("l")
        .join(offsets.alias("r"), keyed, "inner")
        .select("l.*", "r.__rows_before")
        .withColumn(position, (F.col("__rows_before") + F.row_number().over(inside) - 1).cast("long"))
        .drop(RANGE, "__rows_before")
    )


ROUNDS = 6
WALK = 64


def permuted(place: Column, n: int, *seed: Column | str | int) -> Column:
    """Where a seeded permutation of 0 .. n - 1 puts a place: a column expression, without sort, shuffle or group.

    A Feistel network over a * b >= n: a number is a pair, and each round adds a keyed digest of one half to the other.
    Results beyond n are put through it again until they are inside, which keeps the permutation exact. Fewer than a
    numbers lie beyond, about the square root of n, so the walks are short; one of more than ``WALK`` steps (possible above
    n = 4,096 with a chance below 10^-100) raises an error.
    """
    a = math.isqrt(max(n, 1) - 1) + 1
    b = -(-max(n, 1) // a)
    keys = [F.lit(str(s)) if not isinstance(s, Column) else s.cast("string") for s in seed]

    def digest(step: Column, half: Column) -> Column:
        text = F.concat_ws("|", *keys, step.cast("string"), half.cast("string"))
        return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")

    def once(x: Column) -> Column:
        halves = F.struct(F.call_function("div", x, F.lit(b).cast("long")).alias("l"), (x % F.lit(b).cast("long")).alias("r"))

        def turn(s: Column, step: Column) -> Column:
            even = step % 2 == 0
            left = F.when(even, (s["l"] + digest(step, s["r"])) % F.lit(a).cast("long")).otherwise(s["l"])
            right = F.when(even, s["r"]).otherwise((s["r"] + digest(step, s["l"])) % F.lit(b).cast("long"))
            return F.struct(left.alias("l"), right.alias("r"))

        return F.aggregate(
            F.sequence(F.lit(0), F.lit(ROUNDS - 1)), halves, turn, lambda s: s["l"] * F.lit(b).cast("long") + s["r"]
        )

    end = F.lit(n).cast("long")
    found = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)), once(place.cast("long")), lambda y, _: F.when(y < end, y).otherwise(once(y)),
        lambda y: F.when(y < end, y).otherwise(F.raise_error(F.lit("permutation: walk too long")).cast("long")),
    )
    return found


def _slots(payload: Column, reach: int, window) -> Column:
    before = [F.lag(payload, k).over(window) for k in range(reach, 0, -1)]
    after = [F.lead(payload, k).over(window) for k in range(1, reach + 1)]
    return F.array(*before, payload, *after)


def with_neighbours(
    df: DataFrame,
    part: list[str],
    order: list[str],
    payload: dict[str, Column],
    reach: int,
    slots: str = "slots",
    hot_rows: int = HOT_ROWS,
    block_rows: int = 200_000,
) -> DataFrame:
    """Add ``slots``: ``payload`` structs of the ``reach`` rows before, this row, and the rows after it.

    Missing neighbours are null. Rows with a null partition key are dropped, as grouping by them does.
    Groups above ``hot_rows`` rows are numbered, cut into blocks of ``block_rows`` rows that carry
    ``reach`` extra rows on each side, and windowed block by block.
    """
    keyed = df.where(~_any_null(part))
    packed = keyed.withColumn("__payload", F.struct(*[c.alias(n) for n, c in payload.items()]))
    hot, _ = checked_hot_keys(keyed, part, hot_rows)
    window = Window.partitionBy(*part).orderBy(*order)
    if hot.isEmpty():
        return packed.withColumn(slots, _slots(F.col("__payload"), reach, window)).drop("__payload")
    usual = packed.join(F.broadcast(hot), part, "left_anti")
    large = packed.join(F.broadcast(hot), part, "left_semi")
    done = usual.withColumn(slots, _slots(F.col("__payload"), reach, window))
    return done.unionByName(_blockwise(large, part, order, reach, slots, block_rows)).drop("__payload")


def _blockwise(df: DataFrame, part: list[str], order: list[str], reach: int, slots: str, block_rows: int) -> DataFrame:
    numbered = ordered_prefix(df, part, order, position="__pos")
    home = F.floor(F.col("__pos") / F.lit(block_rows))
    offset = F.col("__pos") % F.lit(block_rows)
    # rows near a block edge are copied to the block across that edge, at most twice per row
    copies = F.array_compact(
        F.array(
            home,
            F.when((offset < reach) & (home > 0), home - 1),
            F.when(offset >= block_rows - reach, home + 1),
        )
    )
    halo = numbered.withColumn("__home", home).withColumn("__block", F.explode(copies))
    window = Window.partitionBy(*part, "__block").orderBy("__pos")
    return (
        halo.withColumn(slots, _slots(F.col("__payload"), reach, window))
        .where(F.col("__home") == F.col("__block"))
        .drop("__pos", "__home", "__block")
    )


def _any_null(columns: list[str]) -> Column:
    found = F.lit(False)
    for name in columns:
        found = found | F.col(name).isNull()
    return found


def keep_first(df: DataFrame, key: str | list[str], order: list[Column]) -> DataFrame:
    """First row per key in a total order; Spark limits each key before the shuffle as well."""
    keys = [key] if isinstance(key, str) else list(key)
    ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("__rn") == 1).drop("__rn")


def head_per(df: DataFrame, group: str, order: list[Column], limits: dict[str, int | None]) -> DataFrame:
    """First ``limits[g]`` rows of each group g; groups without a limit stay whole and are never ranked."""
    parts = []
    limited = [g for g, n in limits.items() if n is not None]
    for name in limited:
        rn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
        parts.append(
            df.where(F.col(group) == name).withColumn("__rn", rn).where(F.col("__rn") <= limits[name]).drop("__rn")
        )
    whole = df.where(F.col(group).isin([g for g, n in limits.items() if n is None]))
    for part in parts:
        whole = whole.unionByName(part)
    return whole
