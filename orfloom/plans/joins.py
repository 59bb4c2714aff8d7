"""Joins and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from orfloom.operators import assets, clusters, labels, quality, vectors
from orfloom.operators.ablation import delta_vs_baseline
from orfloom.operators.rollups import value_counts
from orfloom.operators.skew import lookup_join
from orfloom.plans.registry import (
    SOURCE_SPLIT_SQL, STATUS_SQL, WIDE_SQL, Tables, query, wide, wide_exact, wide_split,
)

# a mapping of part types to labels, the same rows in both languages; one type stays unmapped
MAPPING_ROWS = [
    ("MEDIUM", "Structure", "Tail", "Tail_fiber", "trainable_core", "no", "", "", ""),
    ("ECONOMY", "Structure", "Capsid", "Major_capsid", "trainable_core", "no", "", "", ""),
    ("LARGE", "Entry", "Recognition", "Tail_spike", "trainable_multilabel", "Yes", "Exit", "Degradation", "Depolymerase"),
    ("STANDARD", "Entry", "Exclusion", "", "parent_only", "no", "", "", ""),
    ("SMALL", "", "", "", "defer", "no", "", "", ""),
]
MAPPING_COLUMNS = (
    "p_type string, level1_label string, level2_label string, node_primary string, status string, "
    "multi_label_flag string, secondary_level1 string, secondary_level2 string, secondary_node string"
)
MAPPING_SQL = "mapping AS (SELECT * FROM (VALUES {}) v({}))".format(
    ", ".join(str(row) for row in MAPPING_ROWS), ", ".join(c.split()[0] for c in MAPPING_COLUMNS.split(", "))
)
MAPPED_SQL = f"""{MAPPING_SQL}, mapped AS (
  SELECT p_partkey, p_type, coalesce(level1_label, '') AS level1_label, coalesce(level2_label, '') AS level2_label,
    coalesce(node_primary, '') AS node_primary, coalesce(status, 'open_set') AS status, coalesce(multi_label_flag, 'no') AS multi_label_flag,
    coalesce(secondary_level1, '') AS secondary_level1, coalesce(secondary_level2, '') AS secondary_level2,
    coalesce(secondary_node, '') AS secondary_node
  FROM part LEFT JOIN mapping USING (p_type))"""


def mapped_parts(t: Tables):
    mapping = t.part.sparkSession.createDataFrame(MAPPING_ROWS, MAPPING_COLUMNS)
    return labels.map_to_ontology(t.part.select("p_partkey", "p_type"), mapping, "p_type")


@query("J01_annotation_lookup", """
SELECT o_orderkey, o.o_custkey, c_mktsegment FROM (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS o_custkey FROM orders) o
LEFT JOIN (SELECT DISTINCT CASE WHEN c_acctbal < 0 AND c_custkey < 100 THEN NULL ELSE c_custkey END AS o_custkey, c_mktsegment FROM customer) c
  ON o.o_custkey IS NOT DISTINCT FROM c.o_custkey""")
def _(spark, sf):
    t = Tables(spark, sf)
    orders = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("o_custkey"))
    odd = (F.col("c_acctbal") < 0) & (F.col("c_custkey") < 100)
    lookup = t.customer.select(F.when(~odd, F.col("c_custkey")).alias("o_custkey"), "c_mktsegment")
    return labels.lookup_left(orders, lookup, "o_custkey")


@query("J02_ontology_mapping", f"""WITH {MAPPED_SQL}
SELECT *, CAST(status = 'open_set' AS INTEGER) AS is_open_set, CAST(status = 'parent_only' AS INTEGER) AS is_parent_only,
  CAST(lower(multi_label_flag) = 'yes' AS INTEGER) AS is_multilabel, 'PFO_v1.0.2' AS ontology_version FROM mapped""")
def _(spark, sf):
    return mapped_parts(Tables(spark, sf))


@query("J02_status_counts_after_mapping", f"WITH {MAPPED_SQL} SELECT status AS value, count(*) AS n FROM mapped GROUP BY 1")
def _(spark, sf):
    return value_counts(mapped_parts(Tables(spark, sf)), "status")


@query("J03_cluster_membership", """
SELECT c_custkey, c_nationkey AS nation_id, n_regionkey AS cluster_id FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def _(spark, sf):
    t = Tables(spark, sf)
    members = t.nation.select(F.col("n_nationkey").alias("nation_id"), F.col("n_regionkey").alias("cluster_id"))
    rows = t.customer.select("c_custkey", F.col("c_nationkey").alias("nation_id"))
    return clusters.attach_membership(rows, members, "nation_id", "cluster_id")


TWO_LEVEL_SQL = """membership AS (
  SELECT c_custkey AS protein_id, c_nationkey AS exact_sequence_rep_id, n_regionkey AS homology_cluster_id
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def two_level(t: Tables):
    exact = t.customer.select(F.col("c_nationkey").alias("rep"), F.col("c_custkey").alias("member"))
    upper = t.nation.select(F.col("n_regionkey").alias("rep"), F.col("n_nationkey").alias("member"))
    return clusters.compose_clusters(exact, upper)


@query("J04_two_hop_clusters", f"WITH {TWO_LEVEL_SQL} SELECT * FROM membership")
def _(spark, sf):
    return two_level(Tables(spark, sf))


@query("J05_status_enrichment", "SELECT doc_id, coalesce(CAST(quality AS VARCHAR), '') AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def _(spark, sf):
    t = Tables(spark, sf)
    return clusters.with_status(t.documents.select("doc_id"), t.labels, "doc_id", "quality")


@query("J06_main_context_join", """
SELECT l_orderkey AS orderkey, l_linenumber AS line, l_shipdate::DATE AS date_main, o_orderdate::DATE AS date_ctx, o_orderstatus AS status
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def _(spark, sf):
    t = Tables(spark, sf)
    main = t.lineitem.select(
        F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line"), F.to_date("l_shipdate").alias("date")
    )
    context = t.orders.select(
        F.col("o_orderkey").alias("orderkey"), F.to_date("o_orderdate").alias("date"), F.col("o_orderstatus").alias("status")
    )
    return labels.join_context(main, context, "orderkey")


@query("J07_hint_overlay", """
SELECT doc_id, coalesce(CAST(l.quality AS VARCHAR), d.lang) AS lang, coalesce(CAST(l.toxic AS VARCHAR), d.source) AS source
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def _(spark, sf):
    t = Tables(spark, sf)
    hints = t.labels.select(
        "doc_id", F.col("quality").cast("string").alias("lang"), F.col("toxic").cast("string").alias("source")
    )
    return labels.overlay(t.documents.select("doc_id", "lang", "source"), hints, "doc_id", ["lang", "source"])


ASSET_SQL = f"""train AS (SELECT d.doc_id, d.doc_id AS exact_sequence_rep_id, {STATUS_SQL} AS status
  FROM documents d JOIN labels l USING (doc_id)),
assets AS (SELECT doc_id, d.source AS source_name, d.lang AS confidence_scale, t.exact_sequence_rep_id, t.status,
    t.exact_sequence_rep_id IS NOT NULL AS matched_any, coalesce(t.status = 'trainable_core', false) AS matched_core
  FROM documents d LEFT JOIN train t USING (doc_id))"""


def matched_assets(t: Tables):
    train = wide(t).where("status <> 'open_set'").select(
        F.col("gene_index").alias("doc_id"), F.col("gene_index").alias("exact_sequence_rep_id"), "status"
    )
    rows = t.documents.select("doc_id", F.col("source").alias("source_name"), F.col("lang").alias("confidence_scale"))
    return assets.match_assets(rows, train, "doc_id")


@query("J08_asset_match", f"WITH {ASSET_SQL} SELECT * FROM assets")
def _(spark, sf):
    return matched_assets(Tables(spark, sf))


# customers as exact groups, their orders as member rows, high-priced orders as local assets
GAP_SQL = """w AS (SELECT c_custkey AS exact_sequence_rep_id, o_orderkey, o_orderstatus, o_orderpriority,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'trainable_core' ELSE 'defer' END AS status
  FROM customer JOIN orders ON c_custkey = o_custkey),
local AS (SELECT o_custkey AS exact_sequence_rep_id, count(*) AS local_structure_count,
    string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) AS local_structure_sources,
    string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS local_confidence_scales
  FROM orders WHERE o_totalprice > 400000 GROUP BY 1),
gap AS (SELECT w.exact_sequence_rep_id, min(o_orderkey) AS first_order, bool_or(status = 'trainable_core') AS any_core,
    CAST(count(DISTINCT o_orderstatus) AS INTEGER) AS split_count,
    string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS node_primary,
    coalesce(any_value(local_structure_count), 0) AS local_structure_count,
    any_value(local_structure_sources) AS local_structure_sources, any_value(local_confidence_scales) AS local_confidence_scales,
    coalesce(any_value(local_structure_count), 0) > 0 AS has_local_structure
  FROM w LEFT JOIN local USING (exact_sequence_rep_id) GROUP BY 1)"""


def gap_table(t: Tables):
    rep = F.col("o_custkey").alias("exact_sequence_rep_id")
    core = F.when(F.col("o_orderpriority") == "1-URGENT", "trainable_core").otherwise("defer")
    rows = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey")), "o_custkey").select(
        rep, F.col("o_orderkey").alias("first_order"), core.alias("status"), F.col("o_orderstatus").alias("split"),
        F.col("o_orderpriority").alias("node_primary"),
    )
    local = t.orders.where("o_totalprice > 400000").select(
        rep, F.col("o_orderkey").alias("structure_path"), F.col("o_orderstatus").alias("source_name"),
        F.col("o_orderpriority").alias("confidence_scale"),
    )
    return assets.structure_status(rows, local, F.col("first_order"), ["first_order"], ["node_primary"])


@query("J09_gap_table", f"WITH {GAP_SQL} SELECT * FROM gap")
def _(spark, sf):
    return gap_table(Tables(spark, sf))


@query("J10_gap_split", f"""WITH {GAP_SQL}
SELECT 'all' AS gap, exact_sequence_rep_id FROM gap WHERE NOT has_local_structure
UNION ALL SELECT 'core', exact_sequence_rep_id FROM gap WHERE NOT has_local_structure AND any_core""")
def _(spark, sf):
    status = gap_table(Tables(spark, sf))
    every = assets.missing(status).select(F.lit("all").alias("gap"), "exact_sequence_rep_id")
    core = assets.missing(status, core_only=True).select(F.lit("core").alias("gap"), "exact_sequence_rep_id")
    return every.unionByName(core)


@query("J11_local_status", f"""WITH {GAP_SQL}
SELECT c_custkey AS exact_sequence_rep_id, coalesce(has_local_structure, false) AS has_local_structure
FROM customer LEFT JOIN gap ON c_custkey = gap.exact_sequence_rep_id""")
def _(spark, sf):
    t = Tables(spark, sf)
    local = gap_table(t).select("exact_sequence_rep_id", "has_local_structure")
    joined = lookup_join(t.customer.select(F.col("c_custkey").alias("exact_sequence_rep_id")), local, "exact_sequence_rep_id")
    return joined.withColumn("has_local_structure", F.coalesce("has_local_structure", F.lit(False)))


@query("J12_archive_members", """
SELECT p_partkey AS partkey, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) THEN 'matched' ELSE 'missing' END AS state
FROM part""")
def _(spark, sf):
    t = Tables(spark, sf)
    present = t.lineitem.where("l_quantity > 49").select(F.col("l_partkey").alias("partkey"))
    return assets.reconcile(t.part.select(F.col("p_partkey").alias("partkey")), present, "partkey")


@query("J13_required_embedding", """
SELECT vec_id AS doc_id, source, CAST(len(embedding) AS INTEGER) AS dim FROM embeddings JOIN documents ON doc_id = vec_id""")
def _(spark, sf):
    t = Tables(spark, sf)
    covered = t.documents.join(t.embeddings.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    emb = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    attached = vectors.attach_embedding(covered.select("doc_id", "source"), emb, "doc_id", required=True)
    return attached.select("doc_id", "source", F.size("embedding").alias("dim"))


@query("J14_drop_missing_embedding", """
SELECT doc_id, lang, label FROM documents JOIN embeddings ON doc_id = vec_id""")
def _(spark, sf):
    t = Tables(spark, sf)
    emb = t.embeddings.select(F.col("vec_id").alias("doc_id"), "label")
    return vectors.attach_embedding(t.documents.select("doc_id", "lang"), emb, "doc_id", required=False)


@query("J15_optional_modality", """
SELECT doc_id, vec_id IS NOT NULL AS has_structure,
  round(coalesce(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 0), 6) AS total
FROM documents LEFT JOIN embeddings ON doc_id = vec_id""")
def _(spark, sf):
    t = Tables(spark, sf)
    emb = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    rows = vectors.attach_optional(t.documents.select("doc_id"), emb, "doc_id", "embedding", 64, "has_structure")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rows.select("doc_id", "has_structure", F.round(total, 6).alias("total"))


@query("J16_split_override", f"""WITH {WIDE_SQL}, {SOURCE_SPLIT_SQL}
SELECT protein_id, CASE WHEN quality IS NOT NULL THEN 'val' ELSE split END AS split,
  CASE WHEN quality IS NOT NULL THEN 'manual' ELSE 'genome_context' END AS split_strategy,
  CASE WHEN quality IS NOT NULL THEN 'manual_v1' ELSE 'genome_context_v1' END AS split_version
FROM wide JOIN sourcesplit USING (genome_id) LEFT JOIN labels ON doc_id = gene_index""")
def _(spark, sf):
    t = Tables(spark, sf)
    override = t.labels.select(
        F.col("doc_id").cast("string").alias("protein_id"), F.lit("val").alias("split"),
        F.lit("manual").alias("split_strategy"), F.lit("manual_v1").alias("split_version"),
    )
    rows = wide_split(t).select("protein_id", "split", "split_strategy", "split_version")
    return labels.override_split(rows, override)


# supplier names or account numbers as queries against part-supplier pairs as metadata
HITS_SQL = """targets AS (SELECT s_suppkey AS exact_sequence_rep_id, CASE WHEN s_acctbal > 5000 THEN 'M' || s_suppkey ELSE 'A' || s_nationkey END AS query_id
  FROM supplier),
meta AS (SELECT 'A' || (p_size % 30) AS accession, 'M' || (p_partkey % 150) AS model_id, p_retailprice AS confidence_score, p_partkey AS line FROM part),
idx AS (SELECT 'M' || n AS model_id, n * 10 AS range_offset, n AS range_length FROM (SELECT DISTINCT p_partkey % 150 AS n FROM part) WHERE n > 20),
bymodel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY line DESC) AS rn FROM meta) WHERE rn = 1),
matches AS (SELECT t.*, model_id, accession, confidence_score FROM targets t JOIN bymodel ON model_id = query_id
  UNION ALL SELECT t.*, model_id, accession, confidence_score FROM targets t JOIN meta ON accession = query_id),
hits AS (SELECT * FROM matches JOIN idx USING (model_id))"""


def hit_inputs(t: Tables):
    query_id = F.when(F.col("s_acctbal") > 5000, F.concat(F.lit("M"), "s_suppkey")).otherwise(
        F.concat(F.lit("A"), "s_nationkey")
    )
    targets = t.supplier.select(F.col("s_suppkey").alias("exact_sequence_rep_id"), query_id.alias("query_id"))
    model = F.concat(F.lit("M"), F.col("p_partkey") % 150)
    meta = t.part.select(
        F.concat(F.lit("A"), F.col("p_size") % 30).alias("accession"), model.alias("model_id"),
        F.col("p_retailprice").alias("confidence_score"), F.col("p_partkey").alias("line"),
    )
    n = F.col("n")
    index = t.part.select((F.col("p_partkey") % 150).alias("n")).distinct().where("n > 20").select(
        F.concat(F.lit("M"), n).alias("model_id"), (n * 10).alias("range_offset"), n.alias("range_length")
    )
    return targets, meta, index


@query("J17_hit_lookup", f"WITH {HITS_SQL} SELECT * FROM hits")
def _(spark, sf):
    return assets.lookup_hits(*hit_inputs(Tables(spark, sf)), order="line")


@query("J18_query_log", f"""WITH {HITS_SQL}
SELECT *, 'BFVD' AS source, CASE WHEN query_id IN (SELECT query_id FROM matches) THEN 'hit' ELSE 'miss' END AS status FROM targets""")
def _(spark, sf):
    targets, meta, _ = hit_inputs(Tables(spark, sf))
    return assets.query_log(targets, assets.matched_ids(meta), "BFVD")


# line items as runs: the return flag is the variant, the line number the seed
RUNS_SQL = """runs AS (SELECT l_returnflag || l_linestatus AS variant, l_linenumber AS seed, 'run' || l_linenumber AS run_dir,
    avg(l_discount) AS metric FROM lineitem GROUP BY 1, 2, 3),
deltas AS (SELECT r.*, r.metric - b.metric AS delta FROM runs r LEFT JOIN (SELECT seed, metric FROM runs WHERE variant = 'AF') b USING (seed))"""


def run_table(t: Tables):
    keys = [
        F.concat("l_returnflag", "l_linestatus").alias("variant"), F.col("l_linenumber").alias("seed"),
        F.concat(F.lit("run"), "l_linenumber").alias("run_dir"),
    ]
    return t.lineitem.groupBy(*keys).agg(F.avg("l_discount").alias("metric"))


def run_deltas(t: Tables):
    return delta_vs_baseline(run_table(t), ("AF",), "metric", "delta")


@query("J19_same_seed_delta", f"WITH {RUNS_SQL} SELECT variant, seed, round(delta, 9) AS delta FROM deltas")
def _(spark, sf):
    return run_deltas(Tables(spark, sf)).select("variant", "seed", F.round("delta", 9).alias("delta"))


@query("J20_encode_labels", """
SELECT c_custkey, c_mktsegment, idx FROM customer JOIN (
  SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS idx FROM (SELECT DISTINCT c_mktsegment FROM customer)) USING (c_mktsegment)""")
def _(spark, sf):
    rows = Tables(spark, sf).customer.select("c_custkey", "c_mktsegment")
    return labels.encode_labels(rows, labels.build_vocab(rows, ["c_mktsegment"]), "c_mktsegment", "idx")


@query("J21_prefetch", "SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(spark, sf):
    t = Tables(spark, sf)
    keys = t.labels.where("quality = 1").select(F.col("doc_id").alias("vec_id"))
    return vectors.prefetch(t.embeddings.select("vec_id", "label"), keys, "vec_id")


@query("Q05_coverage", "SELECT count(*) AS missing FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def _(spark, sf):
    t = Tables(spark, sf)
    emb = t.embeddings.select(F.col("vec_id").alias("doc_id"))
    return quality.missing_keys(t.documents, emb, "doc_id").agg(F.count(F.lit(1)).alias("missing"))
