"""Aggregations and evaluation scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from orfloom.functions import nonblank
from orfloom.operators import assets, clusters, context, evaluation, rollups, splits, vectors
from orfloom.operators.ablation import stability
from orfloom.operators.labels import build_vocab
from orfloom.operators.packs import row_index
from orfloom.operators.quality import duplicate_keys
from orfloom.operators.skew import hot_split_join
from orfloom.plans.joins import (
    ASSET_SQL, GAP_SQL, HITS_SQL, RUNS_SQL, TWO_LEVEL_SQL, hit_inputs, matched_assets, run_deltas, two_level,
)
from orfloom.plans.registry import (
    PRED_SQL, SOURCE_SPLIT_SQL, WIDE_SQL, Tables, predictions, query, wide, wide_exact, wide_split,
)

HEADS = {"l1": ("target_l1", "pred_l1"), "l2": ("target_l2", "pred_l2"), "l3": ("target_l3", "pred_l3")}
GATES = ["gate_sequence", "gate_structure", "gate_context"]


@query("A01_value_counts", "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, value LIMIT 3")
def _(spark, sf):
    return rollups.value_counts(Tables(spark, sf).orders, "o_orderpriority", 3)


UNITS_SQL = """units AS (SELECT o_custkey, count(*) AS total_count, count(*) FILTER (WHERE o_orderstatus <> 'O') AS supervised_count
  FROM orders GROUP BY 1)"""


def order_rows(t: Tables):
    status = F.when(F.col("o_orderstatus") == "O", "open_set").otherwise(F.col("o_orderstatus"))
    return t.orders.select("o_orderkey", "o_custkey", status.alias("status"))


@query("A02_unit_stats", f"WITH {UNITS_SQL} SELECT * FROM units")
def _(spark, sf):
    return splits.unit_stats(order_rows(Tables(spark, sf)), "o_custkey")


@query("A03_cluster_stats", """
SELECT o_custkey, count(*) AS cluster_total_proteins, count(*) FILTER (WHERE o_orderstatus <> 'O') AS cluster_supervised_proteins,
  nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS status__F, nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS status__P,
  nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS status__open_set FROM orders GROUP BY 1""")
def _(spark, sf):
    return clusters.cluster_stats(order_rows(Tables(spark, sf)), "o_custkey", ("F", "P", "open_set"))


@query("A04_membership_summary", f"""WITH {TWO_LEVEL_SQL}
SELECT CAST(sum(size) AS BIGINT) AS rows_written, count(*) AS unique_clusters, max(size) AS max_cluster_size, median(size) AS median_cluster_size
FROM (SELECT homology_cluster_id, count(*) AS size FROM membership GROUP BY 1)""")
def _(spark, sf):
    return clusters.membership_summary(two_level(Tables(spark, sf)), "protein_id", "homology_cluster_id")


@query("A05_duplicate_assignments", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) <> 1")
def _(spark, sf):
    return duplicate_keys(Tables(spark, sf).lineitem, ["l_orderkey", "l_linenumber"])


@query("A06_exact_rollup", f"""WITH {WIDE_SQL}, {SOURCE_SPLIT_SQL}
SELECT exact_sequence_rep_id, arg_min(sequence_length, gene_index) AS sequence_length,
  arg_min(node_primary, gene_index) FILTER (WHERE node_primary IS NOT NULL) AS node_primary,
  bool_or(status = 'trainable_core') AS any_core, CAST(count(DISTINCT split) AS INTEGER) AS split_count
FROM wide JOIN sourcesplit USING (genome_id) GROUP BY 1""")
def _(spark, sf):
    t = Tables(spark, sf)
    rows = wide_split(t, wide_exact(t, "genome_id", "sequence_length", "node_primary", "status"))
    return rollups.rollup_exact(
        rows, "exact_sequence_rep_id", F.col("gene_index"), ["sequence_length", "node_primary"],
        F.col("status") == "trainable_core", "split",
    )


@query("A07_concat_distinct", """
SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS o_orderpriority,
  string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) AS o_orderstatus FROM orders GROUP BY 1""")
def _(spark, sf):
    return rollups.concat_distinct(Tables(spark, sf).orders, "o_custkey", ["o_orderpriority", "o_orderstatus"])


@query("A08_pack_summary", f"""WITH {WIDE_SQL}, {SOURCE_SPLIT_SQL}
SELECT split, count(*) AS rows, count(DISTINCT genome_id) AS clusters, count(DISTINCT exact_sequence_rep_id) AS exact_groups
FROM wide JOIN sourcesplit USING (genome_id) GROUP BY 1""")
def _(spark, sf):
    t = Tables(spark, sf)
    return rollups.pack_summary(wide_split(t, wide_exact(t, "genome_id")), "genome_id", "exact_sequence_rep_id")


@query("A09_coverage_summary", f"""WITH {ASSET_SQL}, counted AS (
  SELECT source_name, count(*) AS file_count, count(*) FILTER (WHERE matched_any) AS matched_count,
    count(*) FILTER (WHERE matched_core) AS matched_core_count, count(DISTINCT exact_sequence_rep_id) AS exact_count,
    count(DISTINCT exact_sequence_rep_id) FILTER (WHERE matched_core) AS core_exact_count,
    string_agg(DISTINCT confidence_scale, '|' ORDER BY confidence_scale) AS scales FROM assets GROUP BY 1
  UNION ALL SELECT 'union', count(*), count(*) FILTER (WHERE matched_any), count(*) FILTER (WHERE matched_core),
    count(DISTINCT exact_sequence_rep_id), count(DISTINCT exact_sequence_rep_id) FILTER (WHERE matched_core),
    string_agg(DISTINCT confidence_scale, '|' ORDER BY confidence_scale) FROM assets)
SELECT *, round(exact_count / (SELECT count(DISTINCT doc_id) FROM documents), 6) AS exact_fraction FROM counted""")
def _(spark, sf):
    t = Tables(spark, sf)
    total = t.documents.agg(F.count_distinct("doc_id")).scalar()
    return rollups.coverage_summary(matched_assets(t), total)


@query("A10_ready_summary", f"""WITH {ASSET_SQL}
SELECT count(*) AS row_count, count(*) FILTER (WHERE matched_core) AS ready_count,
  round(avg(CASE WHEN matched_core THEN 1.0 ELSE 0.0 END), 6) AS ready_fraction FROM assets""")
def _(spark, sf):
    return rollups.ready_summary(matched_assets(Tables(spark, sf)), "matched_core")


@query("A11_family_rollup", f"""WITH {WIDE_SQL}
SELECT genome_id, count(*) AS members, median(sequence_length) AS median_length, bool_or(status = 'trainable_core') AS any_core,
  min('phrog_' || genome_id || '.tar.gz') AS archive FROM wide GROUP BY 1""")
def _(spark, sf):
    rows = wide(Tables(spark, sf)).select(
        "genome_id", "sequence_length", (F.col("status") == "trainable_core").alias("core"),
        F.concat(F.lit("phrog_"), "genome_id", F.lit(".tar.gz")).alias("archive_name"),
    )
    return rollups.family_rollup(rows, "genome_id", "sequence_length", "core", "archive_name")


@query("A12_class_weights", """
SELECT v.label, CASE WHEN n IS NULL THEN 0 ELSE round(CAST(sum(n) OVER () AS DOUBLE) / count(*) OVER () / n, 9) END AS weight
FROM (SELECT DISTINCT c_mktsegment AS label FROM customer) v
LEFT JOIN (SELECT c_mktsegment AS label, count(*) AS n FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1) c ON v.label = c.label""")
def _(spark, sf):
    customer = Tables(spark, sf).customer
    vocab = build_vocab(customer, ["c_mktsegment"])
    present = customer.where("c_mktsegment <> 'BUILDING'")  # one class of the vocabulary has no row
    return rollups.class_weights(present, "c_mktsegment", vocab).withColumn("weight", F.round("weight", 9))


@query("A13_hierarchy_map", "SELECT idx AS n_nationkey, coalesce(n_regionkey, -1) AS n_regionkey FROM range(30) r(idx) LEFT JOIN nation ON n_nationkey = idx")
def _(spark, sf):
    t = Tables(spark, sf)
    vocab = spark.range(30).select(F.col("id").alias("idx"))
    return rollups.hierarchy_map(t.nation, "n_nationkey", "n_regionkey", vocab)


@query("A14_vocabulary", """
SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx FROM (
  SELECT p_brand AS label FROM part UNION SELECT p_type FROM part) WHERE trim(label) <> ''""")
def _(spark, sf):
    return build_vocab(Tables(spark, sf).part, ["p_brand", "p_type"])


@query("A15_accuracy", f"""WITH {PRED_SQL}
SELECT round(avg(CAST(target_l1 = pred_l1 AS INT)), 9) AS l1_accuracy, round(avg(CAST(target_l2 = pred_l2 AS INT)), 9) AS l2_accuracy,
  round(avg(CAST(target_l3 = pred_l3 AS INT)), 9) AS l3_accuracy FROM preds""")
def _(spark, sf):
    out = evaluation.accuracy(predictions(Tables(spark, sf)), HEADS)
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


def f1_sql(target: str, pred: str, rows: str = "preds") -> str:
    return f"""(SELECT class, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (
      SELECT {target} AS class, CAST({target} = {pred} AS INT) AS tp, 0 AS fp, CAST({target} <> {pred} AS INT) AS fn FROM {rows}
      UNION ALL SELECT {pred}, 0, CAST({target} <> {pred} AS INT), 0 FROM {rows}) GROUP BY 1)"""


@query("A16_macro_f1", f"""WITH {PRED_SQL}
SELECT round(avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END), 9) AS macro_f1
FROM {f1_sql('target_l3', 'pred_l3')}""")
def _(spark, sf):
    out = evaluation.macro_f1(predictions(Tables(spark, sf)), "target_l3", "pred_l3")
    return out.select(F.round("macro_f1", 9).alias("macro_f1"))


@query("A17_confusion", f"""WITH {PRED_SQL}, k AS (SELECT target_l3 AS k FROM preds UNION SELECT pred_l3 FROM preds)
SELECT a.k AS target, b.k AS pred, count(row_id) AS n FROM k a CROSS JOIN k b LEFT JOIN preds ON target_l3 = a.k AND pred_l3 = b.k GROUP BY 1, 2""")
def _(spark, sf):
    return evaluation.confusion(predictions(Tables(spark, sf)), "target_l3", "pred_l3")


@query("A17_confusion_cells", f"""WITH {PRED_SQL} SELECT target_l3 AS target, pred_l3 AS pred, count(*) AS n,
  CAST(sum(count(*)) OVER (PARTITION BY target_l3) AS BIGINT) AS target_n, CAST(sum(count(*)) OVER (PARTITION BY pred_l3) AS BIGINT) AS pred_n
FROM preds GROUP BY 1, 2""")
def _(spark, sf):
    return evaluation.confusion_cells(predictions(Tables(spark, sf)), "target_l3", "pred_l3")


# every part as a class, confused with the next one where it is cheap: the number of classes grows with the table
@query("A17_class_totals", """WITH preds AS (SELECT p_partkey AS t, p_partkey + CASE WHEN p_size < 10 THEN 1 ELSE 0 END AS p FROM part)
SELECT class, CAST(sum(a) AS BIGINT) AS as_target, CAST(sum(b) AS BIGINT) AS as_pred FROM (
  SELECT t AS class, 1 AS a, 0 AS b FROM preds UNION ALL SELECT p, 0, 1 FROM preds) GROUP BY 1""")
def _(spark, sf):
    parts = Tables(spark, sf).part.select(
        F.col("p_partkey").alias("t"), (F.col("p_partkey") + (F.col("p_size") < 10).cast("int")).alias("p")
    )
    return evaluation.class_totals(evaluation.confusion_cells(parts, "t", "p"))


@query("A17_confusion_wide", f"""WITH {PRED_SQL}
SELECT k AS target, count(row_id) FILTER (WHERE pred_l2 = 0) AS "0", count(row_id) FILTER (WHERE pred_l2 = 1) AS "1",
  count(row_id) FILTER (WHERE pred_l2 = 2) AS "2", count(row_id) FILTER (WHERE pred_l2 = 3) AS "3", count(row_id) FILTER (WHERE pred_l2 = 4) AS "4"
FROM (SELECT target_l2 AS k FROM preds UNION SELECT pred_l2 FROM preds) LEFT JOIN preds ON target_l2 = k GROUP BY 1""")
def _(spark, sf):
    return evaluation.confusion_wide(predictions(Tables(spark, sf)), "target_l2", "pred_l2")


def parent_maps(t: Tables):
    up2 = t.nation.select(F.col("n_nationkey").alias("child"), F.col("n_regionkey").alias("parent"))
    up1 = t.region.select(F.col("r_regionkey").alias("child"), (F.col("r_regionkey") % 2).alias("parent"))
    return up2, up1


@query("A18_hierarchy_violations", f"""WITH {PRED_SQL}
SELECT count(*) AS checked, round(coalesce(avg(CASE WHEN n_regionkey <> pred_l2 OR r_regionkey % 2 <> pred_l1 THEN 1.0 ELSE 0.0 END), 0), 9) AS violation_rate
FROM preds JOIN nation ON n_nationkey = pred_l3 JOIN region ON r_regionkey = pred_l2""")
def _(spark, sf):
    t = Tables(spark, sf)
    out = evaluation.hierarchy_violation_rate(predictions(t), "pred_l1", "pred_l2", "pred_l3", *parent_maps(t))
    return out.select("checked", F.round("violation_rate", 9).alias("violation_rate"))


@query("A19_mean_gates", "SELECT round(avg(value / 100), 6) AS mean_gate_a, round(avg(1 - value / 500), 6) AS mean_gate_b FROM events")
def _(spark, sf):
    events = Tables(spark, sf).events.select(
        (F.col("value") / 100).alias("gate_a"), (1 - F.col("value") / 500).alias("gate_b")
    )
    out = evaluation.mean_gates(events, ["gate_a", "gate_b"])
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("A19_batch_mean_gates", """
SELECT round(avg(g), 6) AS mean_gate_a FROM (
  SELECT avg(value / 100) AS g FROM (SELECT value, row_number() OVER (ORDER BY event_id) - 1 AS rn FROM events) GROUP BY rn // 256)""")
def _(spark, sf):
    events = Tables(spark, sf).events.select("event_id", (F.col("value") / 100).alias("gate_a"))
    indexed = row_index(events, [], ["event_id"])
    out = evaluation.mean_gates(indexed, ["gate_a"], F.floor(F.col("row_index") / 256))
    return out.select(F.round("mean_gate_a", 6).alias("mean_gate_a"))


@query("A20_gates_by_class", "SELECT event_type, round(avg(value / 100), 6) AS gate_a FROM events GROUP BY 1")
def _(spark, sf):
    events = Tables(spark, sf).events.select("event_type", (F.col("value") / 100).alias("gate_a"))
    return evaluation.gates_by(events, "event_type", ["gate_a"]).select("event_type", F.round("gate_a", 6).alias("gate_a"))


STABILITY_SQL = """stable AS (SELECT variant, count(delta) AS n_deltas, avg(delta) AS mean_delta, min(delta) AS min_delta,
    count(*) FILTER (WHERE delta > 0) AS wins, stddev_pop(delta) AS sd_delta FROM deltas GROUP BY 1),
verdicts AS (SELECT *, CASE WHEN variant = 'AF' THEN 'baseline' WHEN n_deltas < 3 THEN 'insufficient_seeds'
    WHEN wins = n_deltas AND mean_delta >= 0.010 AND min_delta > -0.005 AND sd_delta <= 0.015 THEN 'stable_repeatable_gain'
    WHEN mean_delta <= 0 OR wins <= 1 OR min_delta <= -0.010 THEN 'no_reliable_gain' ELSE 'weak_or_unstable_gain' END AS stability_label FROM stable)"""


@query("A21_stability", f"""WITH {RUNS_SQL}, {STABILITY_SQL}
SELECT variant, n_deltas, wins, round(mean_delta, 9) AS mean_delta, round(min_delta, 9) AS min_delta, round(sd_delta, 9) AS sd_delta, stability_label FROM verdicts""")
def _(spark, sf):
    out = stability(run_deltas(Tables(spark, sf)), "delta", ("AF",))
    rounded = {c: F.round(c, 9) for c in ("mean_delta", "min_delta", "sd_delta")}
    return out.withColumns(rounded)


def vector_rows(df, key: str, vec: str):
    return df.select(key, F.posexplode(vec).alias("pos", "x")).select(key, "pos", F.round("x", 6).alias("x"))


@query("A22_weighted_mean_vector", """
SELECT label, CAST(pos - 1 AS INTEGER) AS pos, round(sum(x * w) / greatest(sum(w), 1e-8), 6) AS x FROM (
  SELECT label, vec_id + 1 AS w, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2""")
def _(spark, sf):
    mean = vectors.weighted_mean_vec(Tables(spark, sf).embeddings, "label", "embedding", F.col("vec_id") + 1)
    return vector_rows(mean, "label", "mean_vec")


@query("A23_masked_mean_vector", """
SELECT label, CAST(pos - 1 AS INTEGER) AS pos, round(avg(x), 6) AS x FROM (
  SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings
  WHERE embedding[1] > 0) GROUP BY 1, 2""")
def _(spark, sf):
    mask = F.get("embedding", F.lit(0)) > 0
    return vector_rows(
        vectors.masked_mean_vec(Tables(spark, sf).embeddings, "label", "embedding", mask), "label", "mean_vec"
    )


@query("A24_run_status", "SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE o_orderstatus IN ('F', 'O')) AS succeeded FROM orders GROUP BY 1")
def _(spark, sf):
    return rollups.run_status_summary(Tables(spark, sf).orders, "o_orderstatus", ("F", "O"))


@query("A25_fill_stats", f"""WITH {SOURCE_SPLIT_SQL}
SELECT split, count(*) AS rows, count(*) AS sequence_filled, count(vec_id) AS structure_filled, count(quality) AS context_filled
FROM documents JOIN sourcesplit ON genome_id = source LEFT JOIN embeddings ON vec_id = doc_id LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def _(spark, sf):
    t = Tables(spark, sf)
    rows = wide_split(t, t.documents.select("doc_id", F.col("source").alias("genome_id")))
    emb = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    both = vectors.attach_optional(rows, emb, "doc_id", "embedding", 64, "has_structure").join(t.labels, "doc_id", "left")
    mask = F.array(F.lit(True), F.col("has_structure"), F.col("quality").isNotNull())
    return rollups.fill_stats(both.select("split", mask.alias("modality_mask")))


@query("A26_split_summary", f"""WITH {WIDE_SQL}, {SOURCE_SPLIT_SQL}
SELECT split, count(*) AS rows, count(*) FILTER (WHERE status <> 'open_set') AS supervised, count(DISTINCT genome_id) AS units
FROM wide JOIN sourcesplit USING (genome_id) GROUP BY 1""")
def _(spark, sf):
    return splits.split_summary(wide_split(Tables(spark, sf)), "genome_id")


@query("A27_missing_count", f"WITH {WIDE_SQL} SELECT count(*) FILTER (WHERE node_primary = '') AS missing, count(*) AS total FROM wide")
def _(spark, sf):
    return rollups.missing_count(wide(Tables(spark, sf)), "node_primary")


def event_graph(t: Tables, sizes=(4,)):
    return context.context_graph(
        t.events.select("event_id", "user_id", "ts", "value", "event_type"), ["user_id"], ["ts", "event_id"],
        F.col("value"), F.col("event_type"), F.col("event_type"), sizes,
    )


SLOTS_SQL = """ev AS (SELECT event_id, user_id, least(value / 1000, 1.0) AS len, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
node AS (SELECT c.event_id, CAST(n.rn - c.rn AS INTEGER) AS off, n.len + 2 + CASE WHEN n.rn = c.rn THEN 1 ELSE 0 END AS total
  FROM ev c JOIN ev n ON c.user_id = n.user_id AND abs(n.rn - c.rn) <= 4)"""


@query("A28_neighbor_mean", f"""WITH {SLOTS_SQL},
edge AS (SELECT a.event_id, a.off, b.total FROM node a JOIN node b ON a.event_id = b.event_id AND a.off <> b.off AND (abs(a.off - b.off) = 1 OR a.off = 0 OR b.off = 0))
SELECT event_id, round(sum(m), 9) AS total FROM (
  SELECT n.event_id, n.off, coalesce(sum(e.total), 0) / greatest(count(e.total), 1) AS m
  FROM node n LEFT JOIN edge e ON e.event_id = n.event_id AND e.off = n.off GROUP BY 1, 2) GROUP BY 1""")
def _(spark, sf):
    graphs = context.graph_neighbor_mean(event_graph(Tables(spark, sf)))
    total = F.aggregate(F.flatten("neighbor_mean"), F.lit(0.0), lambda s, x: s + x)
    return graphs.select("event_id", F.round(total, 9).alias("total"))


@query("A29_screen_summary", f"""WITH {HITS_SQL}
SELECT count(*) AS hit_rows, count(DISTINCT exact_sequence_rep_id) AS hit_entities, 'BFVD' AS sources, (SELECT count(*) FROM targets) AS query_rows FROM hits""")
def _(spark, sf):
    targets, meta, index = hit_inputs(Tables(spark, sf))
    hits = hot_split_join(targets, assets.hit_counts(meta, index, "line"), "query_id", "inner").withColumn("source", F.lit("BFVD"))
    log = assets.query_log(targets, assets.matched_ids(meta), "BFVD")
    return assets.screen_summary(hits, log, "n")
