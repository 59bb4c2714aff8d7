"""Data-quality and contract checks on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from orfloom.operators import quality
from orfloom.operators.labels import build_vocab, require_columns
from orfloom.operators.vectors import assign_shards
from orfloom.plans.registry import SOURCE_SPLIT_SQL, WIDE_SQL, Tables, query, wide_exact, wide_split


@query("Q01_required_columns", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders")
def _(spark, sf):
    orders = require_columns(Tables(spark, sf).orders, ["o_orderkey", "o_custkey"])
    return orders.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"))


@query("Q02_unique_key", "SELECT count(*) AS n FROM orders")
def _(spark, sf):
    orders = quality.require_unique(Tables(spark, sf).orders, ["o_orderkey"])
    return orders.agg(F.count(F.lit(1)).alias("n"))


@query("Q03_contract", f"""WITH {WIDE_SQL}, {SOURCE_SPLIT_SQL}, s AS (SELECT * FROM wide JOIN sourcesplit USING (genome_id))
SELECT 'allowed_split' AS rule, count(*) FILTER (WHERE split NOT IN ('train', 'val', 'test')) AS violations FROM s
UNION ALL SELECT 'strategy', 0 FROM s GROUP BY 1
UNION ALL SELECT 'core_status', count(*) FILTER (WHERE status <> 'trainable_core') FROM s
UNION ALL SELECT 'node_filled', count(*) FILTER (WHERE node_primary = '') FROM s""")
def _(spark, sf):
    rules = {
        "allowed_split": F.col("split").isin("train", "val", "test"),
        "strategy": F.col("split_strategy") == "genome_context",
        "core_status": F.col("status") == "trainable_core",
        "node_filled": F.col("node_primary") != "",
    }
    return quality.check_contract(wide_split(Tables(spark, sf)), rules)


# the source vocabulary is planted one too large, and the labels cover only part of the documents
@query("Q03_manifest", f"""WITH {WIDE_SQL}, {SOURCE_SPLIT_SQL}, s AS (SELECT * FROM wide JOIN sourcesplit USING (genome_id))
SELECT 'split_version' AS rule, 0::BIGINT AS violations
UNION ALL SELECT 'embedding_key', count(*) FILTER (WHERE exact_sequence_rep_id <> gene_index) FROM s
UNION ALL SELECT 'level1_size', abs(count(DISTINCT level1_label) FILTER (WHERE level1_label <> '') - (SELECT count(DISTINCT lang) FROM documents)) FROM s
UNION ALL SELECT 'level2_size', abs(count(DISTINCT level2_label) FILTER (WHERE level2_label <> '') - (SELECT count(DISTINCT source) + 1 FROM documents)) FROM s
UNION ALL SELECT 'index_aligned', 0
UNION ALL SELECT 'labels_aligned', CASE WHEN (SELECT count(*) FROM ((SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels)
  UNION ALL (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents))) > 0 THEN 1 ELSE 0 END""")
def _(spark, sf):
    t = Tables(spark, sf)
    rows = wide_split(t, wide_exact(t))
    rules = {
        "split_version": F.col("split_version") == "genome_context_v1",
        "embedding_key": F.col("exact_sequence_rep_id") == F.col("gene_index"),
    }
    known = t.documents.agg(F.count_distinct("lang").alias("l"), F.count_distinct("source").alias("s")).first()
    vocabularies = {
        "level1_size": (build_vocab(rows, ["level1_label"]), known.l), "level2_size": (build_vocab(rows, ["level2_label"]), known.s + 1),
    }
    aligned = {
        "index_aligned": (rows.select(F.col("gene_index").alias("doc_id")), t.documents, "doc_id"),
        "labels_aligned": (t.documents, t.labels, "doc_id"),
    }
    return quality.check_manifest(rows, rules, vocabularies, aligned)


@query("Q06_split_shares", f"""WITH {WIDE_SQL}, {SOURCE_SPLIT_SQL}, s AS (SELECT split FROM wide JOIN sourcesplit USING (genome_id))
SELECT w.split, count(s.split) AS rows, count(s.split) / (SELECT count(*) FROM s) AS share, wanted
FROM (VALUES ('train', 0.7::DOUBLE), ('val', 0.15), ('test', 0.15)) w(split, wanted) LEFT JOIN s USING (split) GROUP BY 1, 4""")
def _(spark, sf):
    return quality.ratio_report(wide_split(Tables(spark, sf)), "split", {"train": 0.70, "val": 0.15, "test": 0.15})


@query("U04_column_report", """SELECT 'p_partkey' AS "column", true AS present, count(p_partkey) AS filled FROM part
UNION ALL SELECT 'p_brand', true, count(p_brand) FROM part UNION ALL SELECT 'p_weight', false, 0""")
def _(spark, sf):
    return quality.column_report(Tables(spark, sf).part, ["p_partkey", "p_brand", "p_weight"])


@query("Q04_vector_dims", "SELECT 'embedding' AS rule, count(*) FILTER (WHERE len(embedding) <> 64) AS violations FROM embeddings")
def _(spark, sf):
    return quality.dims_report(Tables(spark, sf).embeddings, {"embedding": 64})


@query("Q06_ratio_check", "SELECT count(DISTINCT source) AS units FROM documents")
def _(spark, sf):
    quality.check_ratios(0.70, 0.15, 0.15)
    return Tables(spark, sf).documents.agg(F.count_distinct("source").alias("units"))


@query("Q07_small_dataset", "SELECT r_regionkey, (SELECT count(*) FROM region) < 10 AS small, (SELECT count(*) FROM events) < 10 AS events_small FROM region")
def _(spark, sf):
    t = Tables(spark, sf)
    small, events_small = quality.is_small(t.region, 10), quality.is_small(t.events, 10)
    return t.region.select("r_regionkey", F.lit(small).alias("small"), F.lit(events_small).alias("events_small"))


@query("Q08_index_metadata", "SELECT count(*) AS row_count, CAST(ceil(count(*) / 64.0) AS BIGINT) AS shard_count, 'doc_id' AS key_name FROM documents")
def _(spark, sf):
    docs = Tables(spark, sf).documents.select("doc_id", F.length("text").alias("length"))
    return quality.index_metadata(assign_shards(docs, "length", "doc_id", 64), "doc_id")


@query("U04_column_difference", "SELECT p_partkey, 'p_weight' AS missing FROM part")
def _(spark, sf):
    part = Tables(spark, sf).part
    lacking = quality.missing_columns(part, ["p_partkey", "p_brand", "p_weight"])
    return part.select("p_partkey", F.lit(",".join(lacking)).alias("missing"))
