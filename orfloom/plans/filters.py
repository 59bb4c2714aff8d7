"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from orfloom.functions import nonblank
from orfloom.operators import labels
from orfloom.operators.assets import structure_need
from orfloom.operators.rollups import any_not_null
from orfloom.operators.vectors import valid_sequences
from orfloom.plans.registry import SOURCE_SPLIT_SQL, WIDE_SQL, Tables, query, sql_strip, wide, wide_split

ROLES = {
    "protein_id": "doc_id", "genome_id": "source", "sequence": "text", "annotation_raw": "lang",
}


@query("P01_standardize", """
SELECT doc_id AS protein_id, source AS genome_id, '' AS contig_id, '' AS gene_index, text AS sequence,
  CAST(length(text) AS INTEGER) AS sequence_length, '' AS phrog_annotation, lang AS annotation_raw,
  lang AS annotation_normalized FROM documents""")
def _(spark, sf):
    return labels.standardize(Tables(spark, sf).documents, ROLES)


@query("P02_optional_columns", """
SELECT event_id AS protein_id, user_id AS genome_id, '' AS contig_id, event_id AS gene_index, props AS sequence,
  CAST(length(props) AS INTEGER) AS sequence_length, event_type AS phrog_annotation, '' AS annotation_raw,
  'unresolved_blank_annotation' AS annotation_normalized FROM events""")
def _(spark, sf):
    roles = {"protein_id": "event_id", "genome_id": "user_id", "gene_index": "event_id", "sequence": "props",
             "phrog_annotation": "event_type"}
    return labels.standardize(Tables(spark, sf).events, roles)


@query("P03_status_filter", """
SELECT o_orderkey, o_custkey, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'F'""")
def _(spark, sf):
    orders = Tables(spark, sf).orders.select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"))
    return labels.where_status(orders, "F")


@query("P04_nonblank", f"""WITH {WIDE_SQL}
SELECT protein_id, coalesce(length(node_primary), 0) > 0 AS has_node FROM wide""")
def _(spark, sf):
    return wide(Tables(spark, sf)).select("protein_id", nonblank(F.col("node_primary")).alias("has_node"))


@query("P05_drop_nulls", "SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def _(spark, sf):
    t = Tables(spark, sf)
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return joined.dropna(subset=["quality", "toxic"])


@query("P06_split_membership", f"""WITH {WIDE_SQL}, {SOURCE_SPLIT_SQL}
SELECT protein_id, split FROM wide JOIN sourcesplit USING (genome_id) WHERE split IN ('val', 'test')""")
def _(spark, sf):
    return labels.where_split(wide_split(Tables(spark, sf)), ("val", "test")).select("protein_id", "split")


@query("P07_in_vocabularies", """
SELECT p_partkey, p_brand, p_type, p_size FROM part
WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 HAVING avg(p_retailprice) > 950)
  AND p_type IN (SELECT p_type FROM part GROUP BY 1 HAVING count(*) > 330)
  AND p_size IN (SELECT p_size FROM part GROUP BY 1 HAVING max(p_retailprice) > 998)""")
def _(spark, sf):
    part = Tables(spark, sf).part
    price = F.col("p_retailprice")

    def vocab(column, condition):
        return part.groupBy(F.col(column).alias("label")).agg(condition.alias("ok")).where("ok").select("label")

    vocabs = {
        "p_brand": vocab("p_brand", F.avg(price) > 950),
        "p_type": vocab("p_type", F.count(F.lit(1)) > 330),
        "p_size": vocab("p_size", F.max(price) > 998),
    }
    return labels.where_in_vocab(part, vocabs).select("p_partkey", "p_brand", "p_type", "p_size")


@query("P08_mapping_defaults", """
SELECT doc_id, coalesce(CAST(quality AS VARCHAR), 'open_set') AS status, coalesce(CAST(toxic AS VARCHAR), 'no') AS multi_label_flag,
  coalesce(CAST(quality AS VARCHAR), '') AS level1_label FROM documents LEFT JOIN labels USING (doc_id)""")
def _(spark, sf):
    t = Tables(spark, sf)
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return labels.fill_mapping_defaults(
        joined.select(
            "doc_id", F.col("quality").cast("string").alias("status"),
            F.col("toxic").cast("string").alias("multi_label_flag"),
            F.col("quality").cast("string").alias("level1_label"),
        )
    )


@query("P09_status_flags", f"""WITH {WIDE_SQL}
SELECT protein_id, CAST(status = 'open_set' AS INTEGER) AS is_open_set, CAST(status = 'parent_only' AS INTEGER) AS is_parent_only,
  CAST(lower(multi_label_flag) = 'yes' AS INTEGER) AS is_multilabel, 'PFO_v1.0.2' AS ontology_version FROM wide""")
def _(spark, sf):
    flagged = labels.status_flags(wide(Tables(spark, sf)))
    return flagged.select("protein_id", "is_open_set", "is_parent_only", "is_multilabel", "ontology_version")


@query("P10_any_not_null", """
SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.m') AS m,
  json_extract_string(props, '$.k') IS NOT NULL OR json_extract_string(props, '$.m') IS NOT NULL AS ready FROM events""")
def _(spark, sf):
    keys = Tables(spark, sf).events.select(
        "event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.m").alias("m")
    )
    return any_not_null(keys, ["k", "m"])


@query("P11_structure_need", """
SELECT p_partkey, has_local_structure, family_id, NOT has_local_structure AS needs_structure,
  (NOT has_local_structure) AND family_id IS NOT NULL AS candidate_for_search
FROM (SELECT p_partkey, p_size > 25 AS has_local_structure, CASE WHEN p_type = 'PROMO' THEN NULL ELSE p_brand END AS family_id FROM part)""")
def _(spark, sf):
    part = Tables(spark, sf).part.select(
        "p_partkey", (F.col("p_size") > 25).alias("has_local_structure"),
        F.when(F.col("p_type") != "PROMO", F.col("p_brand")).alias("family_id"),
    )
    return structure_need(part)


@query("P12_available_keys", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    t = Tables(spark, sf)
    return labels.where_available(t.documents.select("doc_id", "source"), t.labels, "doc_id")


@query("P13_valid_sequences", f"""
SELECT doc_id AS id, md5(s) AS digest FROM (
  SELECT doc_id, translate({sql_strip("upper(replace(text, 'ß', 'ss'))")}, 'UZOB', 'XXXX') AS s FROM documents) WHERE length(s) > 0""")
def _(spark, sf):
    rows = valid_sequences(Tables(spark, sf).documents, "doc_id", "text")
    return rows.select("id", F.md5("sequence").alias("digest"))
