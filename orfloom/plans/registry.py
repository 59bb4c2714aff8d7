"""Registry of query plans and the shared table roles they start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orfloom.functions.text import WHITESPACE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(plan: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return register


class Tables:
    """``Tables(spark, sf_dir).orders`` reads that table's Parquet file."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")


def sql_strip(column: str) -> str:
    return f"trim({column}, '{WHITESPACE}')"


STATUS_SQL = """CASE WHEN l.quality IS NULL THEN 'open_set'
    WHEN l.quality = 1 AND l.toxic = 0 THEN 'trainable_core'
    WHEN l.quality = 1 THEN 'trainable_multilabel'
    WHEN l.toxic = 0 THEN 'parent_only' ELSE 'defer' END"""

# documents with their labels in the roles of the wide label table; all column names as in the wide schema
WIDE_SQL = f"""wide AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS protein_id, d.doc_id AS gene_index, d.source AS genome_id, d.lang AS contig_id,
    d.text AS sequence, CAST(length(d.text) AS INTEGER) AS sequence_length, {STATUS_SQL} AS status,
    CASE WHEN l.quality IS NULL THEN '' ELSE d.lang END AS level1_label,
    CASE WHEN l.quality = 1 OR l.toxic = 0 THEN d.source ELSE '' END AS level2_label,
    CASE WHEN l.quality = 1 THEN d.source || '/' || d.lang ELSE '' END AS node_primary,
    CASE WHEN l.toxic = 1 THEN 'YES' ELSE 'no' END AS multi_label_flag,
    CASE WHEN l.toxic = 1 THEN 'harm' ELSE '' END AS secondary_level1,
    CASE WHEN l.toxic = 1 THEN 'toxic' ELSE '' END AS secondary_level2,
    CASE WHEN l.toxic = 1 AND l.quality = 1 THEN 'toxic/' || d.lang ELSE '' END AS secondary_node,
    min(d.doc_id) OVER (PARTITION BY d.text) AS exact_sequence_rep_id
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def wide(t: Tables) -> DataFrame:
    """The same table in Spark, without the exact representative (see ``wide_exact``)."""
    d = t.documents.join(t.labels, "doc_id", "left")
    q, x = F.col("quality"), F.col("toxic")
    return d.select(
        F.col("doc_id").cast("string").alias("protein_id"),
        F.col("doc_id").alias("gene_index"),
        F.col("source").alias("genome_id"),
        F.col("lang").alias("contig_id"),
        F.col("text").alias("sequence"),
        F.length("text").alias("sequence_length"),
        F.when(q.isNull(), "open_set").when((q == 1) & (x == 0), "trainable_core").when(q == 1, "trainable_multilabel")
        .when(x == 0, "parent_only").otherwise("defer").alias("status"),
        F.when(q.isNull(), "").otherwise(F.col("lang")).alias("level1_label"),
        F.when((q == 1) | (x == 0), F.col("source")).otherwise("").alias("level2_label"),
        F.when(q == 1, F.concat_ws("/", "source", "lang")).otherwise("").alias("node_primary"),
        F.when(x == 1, "YES").otherwise("no").alias("multi_label_flag"),
        F.when(x == 1, "harm").otherwise("").alias("secondary_level1"),
        F.when(x == 1, "toxic").otherwise("").alias("secondary_level2"),
        F.when((x == 1) & (q == 1), F.concat(F.lit("toxic/"), F.col("lang"))).otherwise("").alias("secondary_node"),
    )


def wide_exact(t: Tables, *columns: str) -> DataFrame:
    """The wide table (only ``columns``, if given) with its exact representative."""
    from orfloom.operators.clusters import exact_dedup
    from orfloom.operators.skew import hot_split_join

    members = exact_dedup(t.documents, "doc_id", "text").select(
        F.col("member").alias("gene_index"), F.col("rep").alias("exact_sequence_rep_id")
    )
    rows = wide(t)
    if columns:
        rows = rows.select("gene_index", *[c for c in columns if c not in ("gene_index", "exact_sequence_rep_id")])
    return hot_split_join(rows, members, "gene_index", "inner")


# a split of the sources (the units) in seeded order; CTE ``sourcesplit(genome_id, split)``
SOURCE_SPLIT_SQL = """sourcesplit AS (
  SELECT genome_id, CASE WHEN rn < floor(n * 0.7) THEN 'train' WHEN rn < floor(n * 0.85) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT genome_id, row_number() OVER (ORDER BY md5('20260329|' || genome_id), genome_id) - 1 AS rn, count(*) OVER () AS n
        FROM (SELECT DISTINCT source AS genome_id FROM documents)))"""


def wide_split(t: Tables, rows: DataFrame | None = None) -> DataFrame:
    from orfloom.operators.splits import random_group_split

    return random_group_split(wide(t) if rows is None else rows, "genome_id")


# customers as three-level predictions: nation under region under hemisphere, shifted by the account balance
PRED_SQL = """preds AS (
  SELECT c_custkey AS row_id, c_mktsegment AS split, n_nationkey AS target_l3, n_regionkey AS target_l2, n_regionkey % 2 AS target_l1,
    (n_nationkey + CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) % 25 AS pred_l3,
    (n_regionkey + CASE WHEN c_acctbal > 9000 THEN 1 ELSE 0 END) % 5 AS pred_l2,
    CASE WHEN c_acctbal BETWEEN 4000 AND 5000 THEN 0 ELSE n_regionkey % 2 END AS pred_l1,
    c_acctbal / 10000 AS gate_sequence, (10000 - c_acctbal) / 20000 AS gate_structure, c_acctbal / 20000 AS gate_context
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def predictions(t: Tables) -> DataFrame:
    from orfloom.operators.skew import lookup_join

    nation = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    rows = lookup_join(t.customer, nation, "c_nationkey", "inner")
    bal, region = F.col("c_acctbal"), F.col("n_regionkey")
    return rows.select(
        F.col("c_custkey").alias("row_id"),
        F.col("c_mktsegment").alias("split"),
        F.col("c_nationkey").alias("target_l3"),
        region.alias("target_l2"),
        (region % 2).alias("target_l1"),
        ((F.col("c_nationkey") + (bal < 0).cast("int")) % 25).alias("pred_l3"),
        ((region + (bal > 9000).cast("int")) % 5).alias("pred_l2"),
        F.when(bal.between(4000, 5000), F.lit(0)).otherwise(region % 2).alias("pred_l1"),
        (bal / 10000).alias("gate_sequence"),
        ((10000 - bal) / 20000).alias("gate_structure"),
        (bal / 20000).alias("gate_context"),
    )


def permuted_sql(rows: str, seed: str) -> str:
    """CTE ``walked(id, kind, place)`` from ``rows`` (id, kind, x, n): the keyed permutation of x in 0 .. n - 1.

    ``seed`` is a text expression over id, kind and n.
    """
    body = f"SELECT id, kind, n, a, b, step, x // b AS l, x % b AS r FROM walk WHERE step = 0 OR x >= n"
    for turn in range(6):
        digest = f"CAST('0x' || substr(md5({seed} || '|{turn}|' || {'r' if turn % 2 == 0 else 'l'}), 1, 13) AS BIGINT)"
        halves = f"(l + {digest}) % a AS l, r" if turn % 2 == 0 else f"l, (r + {digest}) % b AS r"
        body = f"SELECT id, kind, n, a, b, step, {halves} FROM ({body})"
    return f"""sized AS (SELECT *, CAST(ceil((n + a - 1) // a) AS BIGINT) AS b FROM (SELECT *, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM ({rows}))),
walk AS (SELECT id, kind, n, a, b, 0 AS step, x FROM sized
  UNION ALL SELECT id, kind, n, a, b, step + 1, l * b + r FROM ({body})),
walked AS (SELECT id, kind, x AS place, n FROM walk WHERE step > 0 AND x < n)"""
