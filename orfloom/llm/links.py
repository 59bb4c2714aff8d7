"""Components over verified links, and the shared-folder tables that cut lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orfloom.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every linked id: the smallest id reachable over ``edges`` (a, b).

    Alternating large-star and small-star steps; every round is a written table. A centre with very many
    neighbours is aggregated before the shuffle, and the joins hold one row per id on their other side.
    """
    links = cut_lineage(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    )
    before = None
    while True:
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            return links.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(
                links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            ).groupBy("id").agg(F.min("component").alias("component"))
        before = now
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.unionByName(lowest.select("u", F.col("m").alias("v"))).where("u <> v")
        links = cut_lineage(
            small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        )
