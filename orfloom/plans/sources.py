"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from orfloom import schemas
from orfloom.operators.labels import build_vocab
from orfloom.operators.evaluation import accuracy, class_totals, confusion
from orfloom.operators.rollups import stats_report, value_counts
from orfloom.operators.vectors import embedding_index
from orfloom.plans.registry import (
    PRED_SQL, SOURCE_SPLIT_SQL, WIDE_SQL, Tables, predictions, query, sql_strip, wide, wide_split,
)
from orfloom.session import scratch_dir
from orfloom.sources import tables as io


@query("S01_delimited_scan", "SELECT * FROM part")
def _(spark, sf):
    path, part = scratch_dir(spark, "part-csv"), Tables(spark, sf).part
    io.write_table(part, path, ",")
    return io.read_table(spark, path, part.schema, ",")


@query("S02_pruned_scan", "SELECT p_partkey, p_type FROM part")
def _(spark, sf):
    path, part = scratch_dir(spark, "part-tsv"), Tables(spark, sf).part
    io.write_table(part, path)
    return io.read_table(spark, path, part.schema, columns=["p_partkey", "p_type"])


@query("S03_split_scan", "SELECT count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents")
def _(spark, sf):
    docs = io.read_parquet(spark, f"{sf}/documents.parquet", ["text"])
    return docs.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("text")).alias("n_chars"))


@query("S04_preview", "SELECT * FROM nation ORDER BY n_nationkey LIMIT 5")
def _(spark, sf):
    return io.preview(Tables(spark, sf).nation, "n_nationkey", 5)[1]


@query("S05_parquet_scan", "SELECT * FROM supplier")
def _(spark, sf):
    return io.read_parquet(spark, f"{sf}/supplier.parquet")


@query("S06_parquet_sink", "SELECT * FROM customer")
def _(spark, sf):
    path = scratch_dir(spark, "customer-parquet")
    io.write_parquet(Tables(spark, sf).customer, path)
    return io.read_parquet(spark, path)


@query("S07_tsv_sink", "SELECT * FROM supplier")
def _(spark, sf):
    path, supplier = scratch_dir(spark, "supplier-tsv"), Tables(spark, sf).supplier
    io.write_table(supplier, path)
    return io.read_table(spark, path, supplier.schema)


@query("S08_summary_sink", "SELECT count(*) AS event_rows, count(DISTINCT user_id) AS users FROM events")
def _(spark, sf):
    path = scratch_dir(spark, "summary")
    events = Tables(spark, sf).events
    io.write_summary(
        events.agg(F.count(F.lit(1)).alias("event_rows"), F.count_distinct("user_id").alias("users")), path
    )
    return spark.read.schema("event_rows long, users long").json(path)


@query("S09_stats_report", """
SELECT 'o_orderstatus' AS section, o_orderstatus AS value, count(*) AS count FROM orders GROUP BY o_orderstatus
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority""")
def _(spark, sf):
    return stats_report(Tables(spark, sf).orders, ["o_orderstatus", "o_orderpriority"])


@query("S10_fasta_lines", f"""
SELECT '>' || doc_id || chr(10) || {sql_strip('text')} AS value FROM documents WHERE length({sql_strip('text')}) > 0""")
def _(spark, sf):
    return io.fasta_lines(Tables(spark, sf).documents, "doc_id", "text")


@query("S10_fasta_counts", f"""
SELECT count(*) AS total_rows, count(*) FILTER (WHERE length({sql_strip('text')}) > 0) AS exported_rows,
  count(*) FILTER (WHERE length({sql_strip('text')}) = 0) AS blank_sequence_rows FROM documents""")
def _(spark, sf):
    return io.fasta_counts(Tables(spark, sf).documents, "text")


@query("S11_cluster_tsv", "SELECT 'N' || c_nationkey AS rep, 'C' || c_custkey AS member FROM customer")
def _(spark, sf):
    path = scratch_dir(spark, "clusters")
    pairs = Tables(spark, sf).customer.select(
        F.concat(F.lit("N"), "c_nationkey").alias("rep"), F.concat(F.lit("C"), "c_custkey").alias("member")
    )
    pairs.write.options(sep="\t", header=False).csv(path)
    return io.read_cluster_tsv(spark, path)


@query("S12_hit_tables", """
SELECT 'M' || p_partkey AS model_id, p_brand AS accession, p_retailprice AS confidence_score, CAST(p_size AS DOUBLE) AS ptm_score,
  'v' || p_size AS version, p_type AS dataset_tier, p_partkey * 100 AS range_offset, CAST(p_size AS BIGINT) AS range_length FROM part""")
def _(spark, sf):
    root, part = scratch_dir(spark, "hits"), Tables(spark, sf).part
    model = F.concat(F.lit("M"), "p_partkey")
    meta = part.select(
        "p_brand", model, "p_retailprice", F.col("p_size").cast("double"), F.concat(F.lit("v"), "p_size"), "p_type"
    )
    meta.write.options(sep="\t", header=False).csv(f"{root}/meta")
    part.select(model, F.col("p_partkey") * 100, "p_size").write.options(sep="\t", header=False).csv(f"{root}/index")
    return io.read_hit_metadata(spark, f"{root}/meta").join(io.read_hit_index(spark, f"{root}/index"), "model_id")


@query("S13_list_assets", "SELECT DISTINCT c_mktsegment AS segment, 'txt' AS suffix FROM customer")
def _(spark, sf):
    root = scratch_dir(spark, "assets")
    Tables(spark, sf).customer.select("c_name", "c_mktsegment").write.partitionBy("c_mktsegment").text(root)
    files = io.list_assets(spark, root, ".txt")
    return files.select(
        F.regexp_extract("path", "c_mktsegment=([^/]+)/", 1).alias("segment"),
        F.regexp_extract("path", r"\.([a-z]+)$", 1).alias("suffix"),
    ).distinct()


VOCAB_SQL = """SELECT c_mktsegment AS label, CAST(row_number() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS idx
FROM (SELECT DISTINCT c_mktsegment FROM customer)"""


@query("S14_vocab_list", VOCAB_SQL)
def _(spark, sf):
    path = scratch_dir(spark, "vocab-list")
    io.write_vocab(build_vocab(Tables(spark, sf).customer, ["c_mktsegment"]), path)
    return io.read_vocab(spark, path)


@query("S14_vocab_dict", VOCAB_SQL)
def _(spark, sf):
    path = scratch_dir(spark, "vocab-dict")
    vocab = build_vocab(Tables(spark, sf).customer, ["c_mktsegment"])
    entries = F.map_from_entries(F.collect_list(F.struct("label", F.col("idx").cast("int"))))
    vocab.agg(F.to_json(entries).alias("value")).write.text(path)
    return io.read_vocab(spark, path)


@query("S15_embedding_index", """
SELECT vec_id AS embedding_id, CAST(len(embedding) AS INTEGER) AS orig_seq_len, CAST(len(embedding) AS INTEGER) AS effective_seq_len,
  false AS truncated_flag, CAST(rn // 100 AS INTEGER) AS shard_no, CAST(rn % 100 AS INTEGER) AS row_index,
  printf('shard_%05d', CAST(rn // 100 AS INTEGER)) AS shard_name
FROM (SELECT *, row_number() OVER (ORDER BY len(embedding), vec_id) - 1 AS rn FROM embeddings)""")
def _(spark, sf):
    emb = Tables(spark, sf).embeddings.withColumn("length", F.size("embedding"))
    return embedding_index(emb, "vec_id", "length", shard_rows=100)


@query("S16_optional_source", "SELECT r_regionkey, r_name FROM region")
def _(spark, sf):
    path, region = scratch_dir(spark, "region"), Tables(spark, sf).region
    io.write_table(region, path)
    absent = io.read_optional(spark, f"{path}-absent.parquet", region.schema)
    return io.read_optional(spark, path, region.schema).unionByName(absent)


@query("S17_run_registry", """
SELECT 'multimodal_v2_' || l_returnflag || '_' || l_linenumber AS run, l_returnflag AS variant, CAST(l_linenumber AS BIGINT) AS seed,
  true AS modality_sequence, l_returnflag = 'A' AS modality_structure, false AS modality_context,
  round(avg(l_discount), 6) AS best_val_l1_macro_f1, round(avg(l_tax), 6) AS best_val_l3_macro_f1
FROM lineitem GROUP BY l_returnflag, l_linenumber""")
def _(spark, sf):
    root = scratch_dir(spark, "runs")
    f1 = Tables(spark, sf).lineitem.groupBy("l_returnflag", "l_linenumber").agg(
        F.round(F.avg("l_discount"), 6).alias("l1"), F.round(F.avg("l_tax"), 6).alias("l3")
    )
    seed = F.col("l_linenumber").alias("seed")
    structure = F.struct((F.col("l_returnflag") == "A").alias("structure")).alias("modalities")
    summary = F.to_json(F.struct(F.col("l_returnflag").alias("variant"), seed, structure))
    metrics = F.to_json(F.struct(
        F.struct(F.col("l1").alias("macro_f1")).alias("l1"), F.struct(F.col("l3").alias("macro_f1")).alias("l3")
    ))
    docs = F.array(
        F.struct(F.lit("summary").alias("doc"), summary.alias("value")),
        F.struct(F.lit("metrics").alias("doc"), metrics.alias("value")),
    )
    run = F.concat_ws("_", F.lit("multimodal_v2"), "l_returnflag", "l_linenumber")
    f1.select(run.alias("run"), F.inline(docs)).write.partitionBy("run", "doc").text(root)
    runs = io.read_runs(spark, root, "run=multimodal_v2", "doc=summary/*", "doc=metrics/*")
    return runs.select(
        F.regexp_extract("run_dir", "run=(.*)$", 1).alias("run"), "variant", "seed",
        "modality_sequence", "modality_structure", "modality_context", "best_val_l1_macro_f1", "best_val_l3_macro_f1",
    )


@query("S18_split_packs", f"""WITH {WIDE_SQL}, {SOURCE_SPLIT_SQL}
SELECT protein_id, status, split FROM wide JOIN sourcesplit USING (genome_id)""")
def _(spark, sf):
    path = scratch_dir(spark, "packs")
    rows = wide_split(Tables(spark, sf)).select("protein_id", "status", "split")
    io.write_packs(rows, path)
    return io.read_parquet(spark, path)


@query("S19_eval_exports", f"""WITH {PRED_SQL}, classes AS (SELECT target_l2 AS k FROM preds UNION SELECT pred_l2 FROM preds)
SELECT 'metrics' AS export, NULL::INTEGER AS target, NULL::INTEGER AS pred, NULL::BIGINT AS n,
  round(avg(CASE WHEN target_l3 = pred_l3 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM preds
UNION ALL SELECT 'confusion', a.k, b.k, count(p.row_id), NULL FROM classes a CROSS JOIN classes b LEFT JOIN preds p ON p.target_l2 = a.k AND p.pred_l2 = b.k GROUP BY 1, 2, 3
UNION ALL SELECT 'classes', k, NULL, CAST(sum(n) AS BIGINT), NULL FROM (SELECT target_l2 AS k, 1 AS n FROM preds UNION ALL SELECT pred_l2, 0 FROM preds) GROUP BY k""")
def _(spark, sf):
    root = scratch_dir(spark, "eval")
    preds = predictions(Tables(spark, sf))
    metrics = accuracy(preds, {"l3": ("target_l3", "pred_l3")}).select(F.round("l3_accuracy", 6).alias("accuracy"))
    matrix = confusion(preds, "target_l2", "pred_l2")
    classes = class_totals(matrix).select(F.col("class").alias("target"), F.col("as_target").alias("n"))
    io.write_eval(root, {"predictions": preds, "metrics": metrics, "confusion": matrix, "classes": classes})
    tables = {"metrics": metrics, "confusion": matrix, "classes": classes}
    parts = [io.read_table(spark, f"{root}/{n}", t.schema, ",").withColumn("export", F.lit(n)) for n, t in tables.items()]
    joined = parts[1].unionByName(parts[0], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return joined.select("export", "target", "pred", "n", "accuracy")
