"""Window operators, sorts, limits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from orfloom.operators import clusters, context, evaluation, packs, sampling, splits, vectors
from orfloom.operators.assets import canonical
from orfloom.operators.labels import build_vocab
from orfloom.operators.ordering import hash_order, head_per, keep_first, ordered_prefix, permuted
from orfloom.plans.aggregates import event_graph, order_rows
from orfloom.plans.registry import (
    SOURCE_SPLIT_SQL, WIDE_SQL, Tables, permuted_sql, query, wide, wide_exact, wide_split,
)


def _features_sql(table: str, part: str, order: str, entity: str, length: str, strand: str) -> str:
    w = f"OVER (PARTITION BY {part} ORDER BY {order})"
    cols = []
    for side, fn in (("left", "lag"), ("right", "lead")):
        for step in (1, 2):
            there = f"{fn}({entity}, {step}) {w} IS NOT NULL"
            cols += [
                f"CAST({there} AS DOUBLE) AS has_{side}_{step}",
                f"coalesce({fn}(least({length} / 1000, 1.0), {step}) {w}, 0.0) AS {side}_{step}_len_norm",
                f"CAST({there} AND {fn}({strand}, {step}) {w} IS NOT DISTINCT FROM {strand} AS DOUBLE) AS {side}_{step}_same_strand",
                f"CAST({there} AS DOUBLE) AS {side}_{step}_has_phrog",
            ]
    ids = ", ".join(
        f"CAST({fn}({entity}, {s}) {w} AS VARCHAR)" for fn, s in (("lag", 1), ("lead", 1), ("lag", 2), ("lead", 2))
    )
    inner = f"SELECT *, list_filter([{ids}], lambda x: x IS NOT NULL) AS ids, {', '.join(cols)} FROM {table}"
    names = [c.rsplit(" AS ", 1)[1] for c in cols]
    return f"""SELECT {entity}, least({length} / 1000, 1.0) AS center_len_norm, len(ids) / 4 AS neighbor_count_norm,
      CAST(len(ids) AS INTEGER) AS neighbor_count, array_to_string(ids, ',') AS neighbor_ids, {', '.join(names)} FROM ({inner})"""


def _feature_columns(df, entity: str):
    return df.select(
        entity, "neighbor_count", F.array_join("neighbor_ids", ",").alias("neighbor_ids"), *context.CONTEXT_FEATURES
    )


@query("W01_context_features", _features_sql("events", "user_id", "ts, event_id", "event_id", "value", "event_type"))
def _(spark, sf):
    events = Tables(spark, sf).events.select("event_id", "user_id", "ts", "value", "event_type")
    out = context.context_features(
        events, ["user_id"], ["ts", "event_id"], "event_id", F.col("value"), F.col("event_type"), F.col("event_type")
    )
    return _feature_columns(out, "event_id")


LINES_SQL = """(SELECT *, l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey || '/' || printf('%.2f', l_extendedprice) || '/' || CAST(l_shipdate AS DATE) AS line_id FROM lineitem)"""


@query("W01_context_features_short_groups", _features_sql(
    LINES_SQL, "l_orderkey", "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate", "line_id", "l_quantity", "l_returnflag"))
def _(spark, sf):
    line_id = F.concat_ws(
        "/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.format_string("%.2f", "l_extendedprice"),
        F.to_date("l_shipdate"),
    )
    lines = Tables(spark, sf).lineitem.withColumn("line_id", line_id)
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    out = context.context_features(
        lines, ["l_orderkey"], order, "line_id", F.col("l_quantity"), F.col("l_returnflag"), F.col("l_returnflag")
    )
    return _feature_columns(out, "line_id")


@query("W02_context_graph", """
WITH ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events),
sized AS (SELECT event_id, w, list_transform(range(-4, 5), lambda o: abs(o) <= w AND rn + o BETWEEN 1 AND n) AS mask
  FROM ev, (VALUES (1), (2), (4)) s(w)),
adj AS (SELECT *, flatten(list_transform(range(0, 9), lambda i: list_transform(range(0, 9), lambda j:
  CAST(mask[i + 1] AND mask[j + 1] AND i <> j AND (abs(i - j) = 1 OR i = 4 OR j = 4) AS INTEGER)))) AS a FROM sized)
SELECT event_id, CAST(w AS INTEGER) AS window_size, CAST(len(list_filter(mask, lambda m: m)) AS INTEGER) AS num_valid_nodes,
  array_to_string(list_transform(mask, lambda m: CAST(m AS INTEGER)), '') AS mask, array_to_string(a, '') AS adjacency FROM adj""")
def _(spark, sf):
    def digits(column):
        return F.array_join(F.transform(column, lambda x: x.cast("int").cast("string")), "")

    return event_graph(Tables(spark, sf), (1, 2, 4)).select(
        "event_id", "window_size", "num_valid_nodes", digits(F.col("node_mask")).alias("mask"),
        digits(F.flatten("adjacency")).alias("adjacency"),
    )


NODES_SQL = """WITH ev AS (SELECT event_id, user_id, event_type, least(value / 1000, 1.0) AS len,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
SELECT c.event_id, CAST(n.rn - c.rn + 4 AS INTEGER) AS slot, round(n.len, 6) AS len, 1.0::DOUBLE AS known,
  CASE WHEN n.rn = c.rn THEN 1.0::DOUBLE ELSE 0.0 END AS is_center, CAST(n.rn - c.rn + 4 AS INTEGER) AS hot
FROM ev c JOIN ev n ON c.user_id = n.user_id AND abs(n.rn - c.rn) <= 4"""


@query("W02_graph_nodes", NODES_SQL)
def _(spark, sf):
    graphs = event_graph(Tables(spark, sf), (4,))
    nodes = graphs.select("event_id", F.posexplode("node_features").alias("slot", "x"), "node_mask")
    hot = (F.array_position(F.slice("x", 6, 9), F.lit(1.0)) - 1).cast("int")
    return nodes.where(F.get("node_mask", F.col("slot"))).select(
        "event_id", "slot", F.round(F.get("x", F.lit(0)), 6).alias("len"), F.get("x", F.lit(3)).alias("known"),
        F.get("x", F.lit(4)).alias("is_center"), hot.alias("hot"),
    )


@query("W03_row_index", f"""WITH {WIDE_SQL}, {SOURCE_SPLIT_SQL}
SELECT gene_index, split, row_number() OVER (PARTITION BY split ORDER BY gene_index) - 1 AS row_index FROM wide JOIN sourcesplit USING (genome_id)""")
def _(spark, sf):
    rows = wide_split(Tables(spark, sf)).select("gene_index", "split")
    return packs.row_index(rows, ["split"], ["gene_index"])


@query("W04_canonical_hit", """
SELECT l_partkey, l_orderkey, l_linenumber, source, source_version, confidence_score FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY prio, source_version DESC, coalesce(try_cast(confidence_score AS DOUBLE), -1) DESC,
    l_orderkey, l_linenumber, l_suppkey, l_shipdate) AS rn
  FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 'AFDB' WHEN 'N' THEN 'BFVD' ELSE 'Other' END AS source, l_linenumber AS source_version,
    CASE WHEN l_tax = 0 THEN 'none' ELSE CAST(l_discount AS VARCHAR) END AS confidence_score,
    CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 999 END AS prio FROM lineitem)) WHERE rn = 1""")
def _(spark, sf):
    source = F.when(F.col("l_returnflag") == "A", "AFDB").when(F.col("l_returnflag") == "N", "BFVD").otherwise("Other")
    score = F.when(F.col("l_tax") == 0, "none").otherwise(F.col("l_discount").cast("string"))
    hits = Tables(spark, sf).lineitem.select(
        "l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", source.alias("source"),
        F.col("l_linenumber").alias("source_version"), score.alias("confidence_score"),
    )
    tie = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate")]
    return canonical(hits, tie, "l_partkey").select(
        "l_partkey", "l_orderkey", "l_linenumber", "source", "source_version", "confidence_score"
    )


@query("W05_keep_first", "SELECT md5(text) AS digest, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY 1")
def _(spark, sf):
    docs = Tables(spark, sf).documents.select(F.md5("text").alias("digest"), "doc_id", "source")
    return keep_first(docs, "digest", [F.col("doc_id")])


@query("W06_head_per_split", f"""WITH {WIDE_SQL}, {SOURCE_SPLIT_SQL}
SELECT gene_index, split FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY gene_index) AS rn FROM wide JOIN sourcesplit USING (genome_id))
WHERE split = 'train' OR (split = 'val' AND rn <= 20) OR (split = 'test' AND rn <= 30)""")
def _(spark, sf):
    rows = wide_split(Tables(spark, sf)).select("gene_index", "split")
    return head_per(rows, "split", [F.col("gene_index")], {"train": None, "val": 20, "test": 30})


@query("W07_shards", """
SELECT doc_id, CAST(rn // 64 AS INTEGER) AS shard_no, CAST(rn % 64 AS INTEGER) AS row_index FROM (
  SELECT doc_id, row_number() OVER (ORDER BY length(text), doc_id) - 1 AS rn FROM documents)""")
def _(spark, sf):
    docs = Tables(spark, sf).documents.select("doc_id", F.length("text").alias("length"))
    return vectors.assign_shards(docs, "length", "doc_id", 64).select("doc_id", "shard_no", "row_index")


@query("W08_group_sizes", f"""WITH {WIDE_SQL}
SELECT gene_index, count(*) OVER (PARTITION BY genome_id) AS cluster_size, count(*) OVER (PARTITION BY genome_id, exact_sequence_rep_id) AS exact_size FROM wide""")
def _(spark, sf):
    rows = wide_exact(Tables(spark, sf), "genome_id")
    return sampling.group_sizes(rows, "genome_id", "exact_sequence_rep_id").select("gene_index", "cluster_size", "exact_size")


@query("W09_best_epoch", """
SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def _(spark, sf):
    history = Tables(spark, sf).orders.select("o_custkey", "o_orderkey", "o_totalprice")
    return evaluation.best_epoch(history, "o_custkey", "o_orderkey", "o_totalprice")


@query("O01_mixed_sort", """
SELECT o_custkey, total, supervised FROM (SELECT o_custkey, count(*) AS total, count(*) FILTER (WHERE o_orderstatus <> 'O') AS supervised FROM orders GROUP BY 1)
ORDER BY total DESC, supervised DESC, o_custkey""")
def _(spark, sf):
    stats = clusters.cluster_stats(order_rows(Tables(spark, sf)), "o_custkey", ())
    ranked = clusters.by_size(stats, "o_custkey")
    return ranked.select(
        "o_custkey", F.col("cluster_total_proteins").alias("total"), F.col("cluster_supervised_proteins").alias("supervised")
    )


@query("O02_length_sort", "SELECT doc_id, length(text)::INTEGER AS length FROM documents ORDER BY length, doc_id")
def _(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", F.length("text").alias("length")).orderBy("length", "doc_id")


@query("O03_row_limit", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 50")
def _(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", "source").orderBy("doc_id").limit(50)


@query("O04_top_families", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 10")
def _(spark, sf):
    counts = Tables(spark, sf).part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "p_brand").limit(10)


@query("O05_topk_scores", """
SELECT vec_id, confidence, string_agg(CAST(pos - 1 AS VARCHAR), ',' ORDER BY rn) AS topk_indices, string_agg(printf('%.6f', x), ',' ORDER BY rn) AS topk_scores FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, pos) AS rn, max(x) OVER (PARTITION BY vec_id) AS confidence FROM (
    SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)) WHERE rn <= 3 GROUP BY 1, 2""")
def _(spark, sf):
    top = evaluation.with_topk(Tables(spark, sf).embeddings, "embedding", 3)
    return top.select("vec_id", "confidence", "topk_indices", "topk_scores")


@query("O06_seeded_order", "SELECT c_custkey, row_number() OVER (ORDER BY md5('42|' || c_custkey), c_custkey) - 1 AS position FROM customer")
def _(spark, sf):
    from orfloom.operators.ordering import hash_position

    ids = Tables(spark, sf).customer.select("c_custkey").withColumn("digest", hash_order(F.col("c_custkey"), 42))
    return hash_position(ids, [], "digest", "c_custkey").drop("digest")


_CUSTOMERS = "SELECT c_custkey AS id, 0 AS kind, row_number() OVER (ORDER BY c_custkey) - 1 AS x, count(*) OVER () AS n FROM customer"


@query("O06_seeded_permutation", f"""WITH RECURSIVE {permuted_sql(_CUSTOMERS, "'42'")}
SELECT id AS c_custkey, place AS position FROM walked""")
def _(spark, sf):
    rows = Tables(spark, sf).customer.select("c_custkey")
    numbered = ordered_prefix(rows, [], ["c_custkey"], "no")
    return numbered.select("c_custkey", permuted(F.col("no"), rows.count(), 42).alias("position"))


@query("U01_concatenate", "SELECT 'customer' AS part, c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier")
def _(spark, sf):
    t = Tables(spark, sf)
    a = t.customer.select(F.lit("customer").alias("part"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    b = t.supplier.select(F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("part"), F.col("s_suppkey").alias("id"))
    return a.unionByName(b)


@query("U02_union_distinct", "SELECT p_brand AS label FROM part UNION SELECT p_type FROM part")
def _(spark, sf):
    return build_vocab(Tables(spark, sf).part, ["p_brand", "p_type"]).select("label")


@query("U03_distinct_rows", "SELECT DISTINCT p_brand, p_type FROM part")
def _(spark, sf):
    return Tables(spark, sf).part.select("p_brand", "p_type").distinct()


@query("U05_leakage", f"""WITH {WIDE_SQL}, {SOURCE_SPLIT_SQL}, s AS (SELECT * FROM wide JOIN sourcesplit USING (genome_id))
SELECT 'genome_id' AS key_name, count(*) FILTER (WHERE k > 1) AS crossing FROM (SELECT genome_id, count(DISTINCT split) AS k FROM s GROUP BY 1)
UNION ALL SELECT 'exact_sequence_rep_id', count(*) FILTER (WHERE k > 1) FROM (SELECT exact_sequence_rep_id, count(DISTINCT split) AS k FROM s GROUP BY 1)
UNION ALL SELECT 'sequence_digest', count(*) FILTER (WHERE k > 1) FROM (SELECT md5(sequence), count(DISTINCT split) AS k FROM s GROUP BY 1)""")
def _(spark, sf):
    t = Tables(spark, sf)
    rows = wide_split(t, wide_exact(t, "genome_id", "sequence")).withColumn("sequence_digest", F.md5("sequence"))
    return splits.leakage_report(rows, ["genome_id", "exact_sequence_rep_id", "sequence_digest"])


@query("U06_not_done", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    t = Tables(spark, sf)
    return vectors.todo(t.documents.select("doc_id", "source"), t.labels, "doc_id")
