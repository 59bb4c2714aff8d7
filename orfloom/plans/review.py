"""Plans of operators that the project documents describe: routing matrix, extra metrics, review and tracking."""

from __future__ import annotations

from pyspark.sql import functions as F

from orfloom import functions as fn
from orfloom.operators import assets, evaluation, labels, review, rollups
from orfloom.plans.aggregates import f1_sql
from orfloom.plans.joins import MAPPED_SQL, MAPPING_ROWS, mapped_parts
from orfloom.plans.registry import PRED_SQL, WIDE_SQL, Tables, predictions, query, wide

MATRIX_SQL = "matrix(status, task) AS (VALUES {})".format(", ".join(str(p) for p in labels.ROUTING))


@query("X01_routing_matrix", f"WITH {WIDE_SQL}, {MATRIX_SQL} SELECT protein_id, status, task FROM wide JOIN matrix USING (status)")
def _(spark, sf):
    return labels.route_by_matrix(wide(Tables(spark, sf))).select("protein_id", "status", "task")


@query("X02_strict_secondary", f"""WITH {MAPPED_SQL}
SELECT p_partkey AS protein_id, node_primary AS node_name, 'primary' AS label_role FROM mapped WHERE node_primary <> ''
UNION ALL SELECT p_partkey, secondary_node, 'secondary' FROM mapped WHERE secondary_node <> '' AND lower(multi_label_flag) = 'yes' AND p_partkey < 1000""")
def _(spark, sf):
    rows = mapped_parts(Tables(spark, sf)).withColumnRenamed("p_partkey", "protein_id")
    flag = F.when(F.col("protein_id") < 1000, F.col("multi_label_flag")).otherwise(F.lit("no"))
    return labels.to_long(rows.withColumn("multi_label_flag", flag), strict=True).select("protein_id", "node_name", "label_role")


@query("X03_allowed_negatives", """
SELECT a.label, string_agg(b.label, ',' ORDER BY b.label) AS negatives FROM (SELECT DISTINCT p_type AS label FROM part) a
JOIN (SELECT DISTINCT p_type AS label FROM part) b ON a.label <> b.label AND NOT (a.label, b.label) IN (('PROMO', 'SMALL'), ('SMALL', 'PROMO'), ('LARGE', 'MEDIUM'), ('MEDIUM', 'LARGE'))
GROUP BY 1""")
def _(spark, sf):
    kinds = Tables(spark, sf).part.select(F.col("p_type").alias("label"))
    out = review.allowed_negatives(kinds, (("PROMO", "SMALL"), ("LARGE", "MEDIUM")))
    return out.select("label", F.array_join("negatives", ",").alias("negatives"))


@query("X03_drawn_negatives", """
WITH allowed AS (SELECT a.label, list(b.label ORDER BY b.label) AS negatives FROM (SELECT DISTINCT p_type AS label FROM part) a
  JOIN (SELECT DISTINCT p_type AS label FROM part) b ON a.label <> b.label AND NOT (a.label, b.label) IN (('PROMO', 'SMALL'), ('SMALL', 'PROMO')) GROUP BY 1)
SELECT p_partkey, p_type, negatives[CAST(floor(CAST('0x' || substr(md5('42|' || p_partkey), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE * len(negatives)) AS INTEGER) + 1] AS negative
FROM part JOIN allowed ON label = p_type""")
def _(spark, sf):
    part = Tables(spark, sf).part
    allowed = review.allowed_negatives(part.select(F.col("p_type").alias("label")), (("PROMO", "SMALL"),))
    drawn = review.draw_negative(part, "p_type", "p_partkey", allowed, 42)
    return drawn.select("p_partkey", "p_type", "negative")


# long multilabel decisions: quality and toxicity of labelled documents scored by their length
MULTI_SQL = """multi AS (SELECT doc_id, 'quality' AS label, quality AS truth, CAST(n_chars > 800 AS INTEGER) AS pred, n_chars / 1000.0::DOUBLE AS score
  FROM documents JOIN labels USING (doc_id)
  UNION ALL SELECT doc_id, 'toxic', toxic, CAST(n_chars < 600 AS INTEGER), -n_chars / 1000.0::DOUBLE FROM documents JOIN labels USING (doc_id))"""


def multilabel(t: Tables):
    n = F.col("n_chars")
    rows = t.documents.join(t.labels, "doc_id").select("doc_id", "n_chars", "quality", "toxic")
    entry = lambda name, truth, pred, score: F.struct(
        F.lit(name).alias("label"), truth.alias("truth"), pred.cast("int").alias("pred"), score.alias("score")
    )
    entries = F.array(
        entry("quality", F.col("quality"), n > 800, n / 1000.0), entry("toxic", F.col("toxic"), n < 600, -n / 1000.0)
    )
    return rows.select("doc_id", F.inline(entries))


@query("X04_multilabel_f1", f"""WITH {MULTI_SQL}, c AS (SELECT label, count(*) FILTER (WHERE truth = 1 AND pred = 1) AS tp,
  count(*) FILTER (WHERE truth = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE truth = 1 AND pred = 0) AS fn FROM multi GROUP BY 1)
SELECT round(2.0::DOUBLE * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 9) AS micro_f1, round(avg(2.0::DOUBLE * tp / (2 * tp + fp + fn)), 9) AS macro_f1 FROM c""")
def _(spark, sf):
    out = evaluation.multilabel_f1(multilabel(Tables(spark, sf)), "label", "truth", "pred")
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


STEPS_SQL = """steps AS (SELECT label, score, sum(pos) OVER w AS cum_pos, sum(n) OVER w AS cum_n, pos, n FROM (
  SELECT label, score, count(*) FILTER (WHERE truth = 1) AS pos, count(*) AS n FROM multi GROUP BY 1, 2) WINDOW w AS (PARTITION BY label ORDER BY score DESC))"""


@query("X04_mean_average_precision", f"""WITH {MULTI_SQL}, {STEPS_SQL}
SELECT round(avg(ap), 9) AS mean_ap FROM (SELECT label, sum(cum_pos / cum_n * pos) / sum(pos) AS ap FROM steps GROUP BY 1)""")
def _(spark, sf):
    out = evaluation.mean_average_precision(multilabel(Tables(spark, sf)), "label", "score", F.col("truth") == 1)
    return out.select(F.round("mean_ap", 9).alias("mean_ap"))


@query("X04_cooccurrence", """
SELECT least(p_brand, p_type) AS a, greatest(p_brand, p_type) AS b, count(*) AS n FROM part GROUP BY 1, 2""")
def _(spark, sf):
    return evaluation.cooccurrence(Tables(spark, sf).part, ["p_brand", "p_type"])


@query("X04_swap_rate", f"""WITH {PRED_SQL}
SELECT count(*) AS two_label_rows, round(avg(CASE WHEN pred_l1 = target_l2 AND pred_l2 = target_l1 THEN 1.0::DOUBLE ELSE 0 END), 9) AS swap_rate
FROM preds WHERE target_l1 <> target_l2""")
def _(spark, sf):
    out = evaluation.swap_rate(predictions(Tables(spark, sf)), "target_l1", "target_l2", "pred_l1", "pred_l2")
    return out.select("two_label_rows", F.round("swap_rate", 9).alias("swap_rate"))


@query("X05_open_set_scores", """
WITH s AS (SELECT n_chars AS score, count(*) FILTER (WHERE quality IS NULL) AS pos, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1),
c AS (SELECT *, n - pos AS neg, sum(pos) OVER (ORDER BY score DESC) AS cum_pos, sum(n) OVER (ORDER BY score DESC) AS cum_n FROM s)
SELECT round(sum(neg * (cum_pos - pos + pos / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)), 9) AS auroc, round(sum(cum_pos / cum_n * pos) / sum(pos), 9) AS auprc,
  round(sum(CASE WHEN score >= 1000 THEN pos ELSE neg END)::DOUBLE / sum(n), 9) AS reject_accuracy FROM c""")
def _(spark, sf):
    t = Tables(spark, sf)
    rows = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id", "left")
    out = evaluation.open_set_report(rows, "n_chars", F.col("quality").isNull(), 1000)
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query("X05_auroc", f"""WITH {MULTI_SQL}, {STEPS_SQL}
SELECT round(sum((n - pos) * (cum_pos - pos + pos / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(n - pos)), 9) AS auroc FROM steps WHERE label = 'quality'""")
def _(spark, sf):
    rows = multilabel(Tables(spark, sf)).where("label = 'quality'")
    return evaluation.auroc(rows, "score", F.col("truth") == 1).select(F.round("auroc", 9).alias("auroc"))


@query("X06_class_report", f"""WITH {PRED_SQL}
SELECT class, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END, 9) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END, 9) AS recall,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 9) AS f1 FROM {f1_sql('target_l3', 'pred_l3')}""")
def _(spark, sf):
    out = evaluation.class_report(predictions(Tables(spark, sf)), "target_l3", "pred_l3")
    return out.select("class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("X07_most_confused", f"""WITH {PRED_SQL}
SELECT least(target_l3, pred_l3) AS a, greatest(target_l3, pred_l3) AS b, count(*) AS n FROM preds WHERE target_l3 <> pred_l3 GROUP BY 1, 2 ORDER BY n DESC, a, b LIMIT 5""")
def _(spark, sf):
    return evaluation.most_confused(predictions(Tables(spark, sf)), "target_l3", "pred_l3", 5)


PROTO_SQL = """v AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
proto AS (SELECT label, pos, avg(x) AS m FROM v GROUP BY 1, 2),
dist AS (SELECT vec_id, p.label AS nearest, sqrt(sum((x - m) * (x - m))) AS distance FROM v JOIN proto p USING (pos) GROUP BY 1, 2),
near AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, nearest) AS rn FROM dist)"""


@query("X08_prototype_distance", f"WITH {PROTO_SQL} SELECT vec_id, nearest, round(distance, 6) AS distance, distance > 0.9 AS abstain FROM near WHERE rn = 1")
def _(spark, sf):
    out = evaluation.prototype_distance(Tables(spark, sf).embeddings, "label", "embedding", 0.9)
    return out.select("vec_id", "nearest", F.round("distance", 6).alias("distance"), "abstain")


@query("X09_mapping_diff", """
WITH o AS (SELECT p_partkey, p_brand AS node_primary, '' AS secondary_node, CASE WHEN p_size < 10 THEN 'parent_only' ELSE 'trainable_core' END AS status FROM part WHERE p_type <> 'PROMO'),
n AS (SELECT p_partkey, CASE WHEN p_size = 20 THEN p_name ELSE p_brand END AS node_primary, CASE WHEN p_size > 45 THEN 'second' ELSE '' END AS secondary_node,
  CASE WHEN p_size > 5 THEN 'trainable_core' WHEN p_size = 1 THEN 'defer' ELSE 'parent_only' END AS status FROM part WHERE p_type <> 'SMALL')
SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey, o.status AS old_status, n.status AS new_status, CASE WHEN o.p_partkey IS NULL THEN 'term_added' WHEN n.p_partkey IS NULL THEN 'term_removed'
  WHEN n.status = 'defer' AND o.status <> 'defer' THEN 'downgrade_to_defer' WHEN o.status = 'parent_only' AND n.status = 'trainable_core' THEN 'parent_only_to_l3'
  WHEN o.node_primary IS DISTINCT FROM n.node_primary THEN 'primary_reassignment' ELSE 'secondary_added' END AS change_type
FROM o FULL JOIN n ON o.p_partkey = n.p_partkey WHERE o.status IS DISTINCT FROM n.status OR o.node_primary IS DISTINCT FROM n.node_primary OR o.secondary_node IS DISTINCT FROM n.secondary_node""")
def _(spark, sf):
    part, size = Tables(spark, sf).part, F.col("p_size")
    old = part.where("p_type <> 'PROMO'").select(
        "p_partkey", F.col("p_brand").alias("node_primary"), F.lit("").alias("secondary_node"),
        F.when(size < 10, "parent_only").otherwise("trainable_core").alias("status"),
    )
    new = part.where("p_type <> 'SMALL'").select(
        "p_partkey", F.when(size == 20, F.col("p_name")).otherwise(F.col("p_brand")).alias("node_primary"),
        F.when(size > 45, "second").otherwise("").alias("secondary_node"),
        F.when(size > 5, "trainable_core").when(size == 1, "defer").otherwise("parent_only").alias("status"),
    )
    return review.mapping_diff(old, new, "p_partkey").select("p_partkey", "old_status", "new_status", "change_type")


@query("X10_tracking_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def _(spark, sf):
    return review.tracking_rollup(Tables(spark, sf).orders, "o_orderstatus", "o_orderpriority")


@query("X11_frequency_percent", "SELECT p_name, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM part), 6) AS percent FROM part GROUP BY 1")
def _(spark, sf):
    return rollups.share_of_total(Tables(spark, sf).part, "p_name")


@query("X12_processing_log", f"""WITH {MAPPED_SQL}
SELECT count(*) AS input_rows, count(*) FILTER (WHERE node_primary <> '') AS matched_rows, count(*) FILTER (WHERE node_primary = '') AS unmatched_rows,
  CAST(sum(CAST(node_primary <> '' AS INT) + CAST(secondary_node <> '' AS INT)) AS BIGINT) AS expanded_rows FROM mapped""")
def _(spark, sf):
    return review.processing_log(mapped_parts(Tables(spark, sf)))


@query("X13_term_variants", """
SELECT p_partkey, replace(replace(CASE WHEN p_size > 25 THEN 'Anti Restriction ' ELSE 'tailspike ' END || p_name, 'Anti Restriction', 'anti-restriction'), 'tailspike', 'tail spike') AS term FROM part""")
def _(spark, sf):
    term = F.concat(F.when(F.col("p_size") > 25, "Anti Restriction ").otherwise("tailspike "), "p_name")
    return Tables(spark, sf).part.select("p_partkey", fn.term_variants(term).alias("term"))


@query("X14_secondary_list", f"WITH {MAPPED_SQL} SELECT p_partkey, CAST(secondary_node <> '' AS INTEGER) AS n, secondary_node AS joined FROM mapped")
def _(spark, sf):
    out = labels.secondary_list(mapped_parts(Tables(spark, sf)))
    return out.select("p_partkey", F.size("secondary_nodes").alias("n"), F.array_join("secondary_nodes", "|").alias("joined"))


@query("X15_confidence_scale", "SELECT event_id, round(CASE WHEN event_type IN ('view', 'click') THEN value / 100 ELSE value END, 9) AS confidence FROM events")
def _(spark, sf):
    scale = F.when(F.col("event_type").isin("view", "click"), "plddt_0_100").otherwise("score_0_1")
    confidence = fn.unit_confidence(F.col("value"), scale)
    return Tables(spark, sf).events.select("event_id", F.round(confidence, 9).alias("confidence"))


@query("X16_threshold_tuning", f"""WITH {MULTI_SQL}, {STEPS_SQL}, f AS (SELECT label, score AS threshold,
  CASE WHEN cum_pos = 0 THEN 0 ELSE 2.0::DOUBLE * cum_pos / (2 * cum_pos + (cum_n - cum_pos) + (sum(pos) OVER (PARTITION BY label) - cum_pos)) END AS f1 FROM steps)
SELECT label, threshold, round(f1, 9) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY f1 DESC, threshold DESC) AS rn FROM f) WHERE rn = 1""")
def _(spark, sf):
    out = evaluation.tune_thresholds(multilabel(Tables(spark, sf)), "label", "score", F.col("truth") == 1)
    return out.select("label", "threshold", F.round("f1", 9).alias("f1"))


@query("X17_vector_clusters")
def _(spark, sf):
    out = review.vector_clusters(Tables(spark, sf).embeddings, "embedding", 8)
    return out.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
