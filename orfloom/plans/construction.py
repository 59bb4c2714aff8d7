"""Dataset-construction plans: splits, clusters, samples, packs, targets, evaluation bundles."""

from __future__ import annotations

from pyspark.sql import functions as F

from orfloom import functions as fn
from orfloom.operators import assets, clusters, evaluation, labels, packs, rollups, sampling, splits, vectors
from orfloom.operators.ablation import ablation_report
from orfloom.plans.aggregates import (
    HEADS, STABILITY_SQL, UNITS_SQL, event_graph, f1_sql, order_rows, parent_maps,
)
from orfloom.plans.functions import WINDOWS_SQL, head_probs
from orfloom.plans.joins import MAPPED_SQL, RUNS_SQL, mapped_parts, run_table
from orfloom.plans.registry import (
    PRED_SQL, SOURCE_SPLIT_SQL, WIDE_SQL, Tables, permuted_sql, predictions, query, wide, wide_exact, wide_split,
)
from orfloom.operators.context import CONTEXT_FEATURES, context_features
from orfloom.plans.registry import sql_strip
from orfloom.session import cut_lineage, scratch_dir
from orfloom.sources import tables as io

# scores times 2 * rows * supervised * 210, so that whole numbers are compared
GREEDY_SQL = f"""{UNITS_SQL}, ranked AS (SELECT *, row_number() OVER (ORDER BY total_count DESC, supervised_count DESC, o_custkey) AS rn FROM units),
goal AS (SELECT CAST(sum(total_count) AS HUGEINT) AS t, CAST(sum(supervised_count) AS HUGEINT) AS s FROM units),
walk(rn, total_count, supervised_count, a0, b0, a1, b1, a2, b2, pick) AS (
  SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), -1
  UNION ALL
  SELECT rn, tc, sc, a0 + CASE WHEN p = 0 THEN tc ELSE 0 END, b0 + CASE WHEN p = 0 THEN sc ELSE 0 END,
    a1 + CASE WHEN p = 1 THEN tc ELSE 0 END, b1 + CASE WHEN p = 1 THEN sc ELSE 0 END,
    a2 + CASE WHEN p = 2 THEN tc ELSE 0 END, b2 + CASE WHEN p = 2 THEN sc ELSE 0 END, p
  FROM (SELECT *, CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS p FROM (
    SELECT r.rn, r.total_count AS tc, r.supervised_count AS sc, a0, b0, a1, b1, a2, b2,
      3 * (2 * s * (70 * t - 100 * a0) + t * (70 * s - 100 * b0)) AS s0,
      14 * (2 * s * (15 * t - 100 * a1) + t * (15 * s - 100 * b1)) AS s1,
      14 * (2 * s * (15 * t - 100 * a2) + t * (15 * s - 100 * b2)) AS s2
    FROM walk w JOIN ranked r ON r.rn = w.rn + 1, goal)))"""


@query("M01_balanced_group_split", f"""WITH RECURSIVE {GREEDY_SQL}
SELECT total_count, supervised_count, CASE pick WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split, count(*) AS units
FROM walk WHERE rn > 0 GROUP BY 1, 2, 3""")
def _(spark, sf):
    rows = splits.balanced_group_split(order_rows(Tables(spark, sf)), "o_custkey")
    units = rows.groupBy("o_custkey", "split").agg(
        F.count(F.lit(1)).alias("total_count"), F.count_if(F.col("status") != "open_set").alias("supervised_count")
    )
    return units.groupBy("total_count", "supervised_count", "split").agg(F.count(F.lit(1)).alias("units"))


@query("M01_split_counts", f"""WITH RECURSIVE {GREEDY_SQL}
SELECT CASE pick WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split, CAST(sum(total_count) AS BIGINT) AS rows,
  CAST(sum(supervised_count) AS BIGINT) AS supervised, count(*) AS units FROM walk WHERE rn > 0 GROUP BY 1""")
def _(spark, sf):
    return splits.split_summary(splits.balanced_group_split(order_rows(Tables(spark, sf)), "o_custkey"), "o_custkey")


# every customer a unit of one row: a class of well over a thousand units, placed unit by unit in the SQL
SINGLE_UNITS_SQL = GREEDY_SQL.replace(UNITS_SQL, """units AS (SELECT c_custkey AS o_custkey, count(*) AS total_count,
  count(*) FILTER (WHERE c_acctbal > 0) AS supervised_count FROM customer GROUP BY 1)""")


@query("M01_large_classes", f"""WITH RECURSIVE {SINGLE_UNITS_SQL}
SELECT total_count, supervised_count, CASE pick WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split, count(*) AS units
FROM walk WHERE rn > 0 GROUP BY 1, 2, 3""")
def _(spark, sf):
    status = F.when(F.col("c_acctbal") > 0, "known").otherwise("open_set").alias("status")
    rows = splits.balanced_group_split(Tables(spark, sf).customer.select("c_custkey", status), "c_custkey")
    units = rows.groupBy("c_custkey", "split").agg(
        F.count(F.lit(1)).alias("total_count"), F.count_if(F.col("status") != "open_set").alias("supervised_count")
    )
    return units.groupBy("total_count", "supervised_count", "split").agg(F.count(F.lit(1)).alias("units"))


@query("M02_random_group_split", """
SELECT c_custkey, c_nationkey, CASE WHEN rn < floor(n * 0.7) THEN 'train' WHEN rn < floor(n * 0.85) THEN 'val' ELSE 'test' END AS split FROM customer
JOIN (SELECT c_nationkey, row_number() OVER (ORDER BY md5('20260329|' || c_nationkey), c_nationkey) - 1 AS rn, count(*) OVER () AS n
  FROM (SELECT DISTINCT c_nationkey FROM customer)) USING (c_nationkey)""")
def _(spark, sf):
    rows = Tables(spark, sf).customer.select("c_custkey", "c_nationkey")
    return splits.random_group_split(rows, "c_nationkey").select("c_custkey", "c_nationkey", "split")


@query("M03_exact_dedup", "SELECT doc_id AS member, min(doc_id) OVER (PARTITION BY text) AS rep FROM documents")
def _(spark, sf):
    return clusters.exact_dedup(Tables(spark, sf).documents, "doc_id", "text")


KMER_SQL = """texts AS (SELECT min(doc_id) AS id, text, length(text) AS L FROM documents WHERE length(text) > 0 GROUP BY text),
kmers AS (SELECT DISTINCT id, L, substring(text, CAST(i AS BIGINT) + 1, 12) AS kmer FROM (SELECT id, text, L, unnest(range(0, greatest(L - 12, 0) + 1)) AS i FROM texts)),
sizes AS (SELECT id, count(*) AS n FROM kmers GROUP BY 1)"""
ALL_PAIRS_SQL = f"""{KMER_SQL},
shared AS (SELECT a.id AS rep, b.id AS member, count(*) AS s FROM kmers a JOIN kmers b ON a.kmer = b.kmer AND a.id < b.id
  WHERE least(a.L, b.L) >= greatest(a.L, b.L) * 0.8 GROUP BY 1, 2),
links AS (SELECT rep, member, s / greatest(x.n, y.n) AS similarity FROM shared JOIN sizes x ON x.id = rep JOIN sizes y ON y.id = member WHERE s / greatest(x.n, y.n) >= 0.3)"""


def representatives(t: Tables):
    """The smallest document id of each text, with the text."""
    return clusters.distinct_texts(t.documents, "doc_id", "text")


@query("M04_near_duplicate_links", f"WITH {ALL_PAIRS_SQL} SELECT rep, member, round(similarity, 9) AS similarity FROM links")
def _(spark, sf):
    links = clusters.near_duplicate_edges(representatives(Tables(spark, sf)), "doc_id", "text")
    return links.withColumn("similarity", F.round("similarity", 9))


@query("M04_near_duplicate_clusters", f"""WITH RECURSIVE {ALL_PAIRS_SQL},
both_ways AS (SELECT rep AS a, member AS b FROM links UNION SELECT member, rep FROM links),
reach(a, b) AS (SELECT id, id FROM texts UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b)
SELECT min(b) AS rep, a AS member FROM reach GROUP BY a""")
def _(spark, sf):
    return clusters.near_dup_cluster(representatives(Tables(spark, sf)), "doc_id", "text")


SIZES_SQL = f"""{WIDE_SQL}, g AS (SELECT genome_id, exact_sequence_rep_id, count(*) AS ne FROM wide GROUP BY 1, 2),
c AS (SELECT genome_id, CAST(sum(ne) AS BIGINT) AS nc, sum(1.0::DOUBLE / ne) AS we, count(*) AS k FROM g GROUP BY 1), z AS (SELECT sum(1.0::DOUBLE / nc) AS w FROM c)"""


@query("M05_sampling_probability", f"""WITH {SIZES_SQL}
SELECT gene_index, round((1.0::DOUBLE / nc / w) * (1.0::DOUBLE / ne / we) / ne, 9) AS sampling_probability
FROM wide JOIN g USING (genome_id, exact_sequence_rep_id) JOIN c USING (genome_id), z""")
def _(spark, sf):
    rows = wide_exact(Tables(spark, sf), "genome_id")
    out = sampling.sampling_probability(rows, "genome_id", "exact_sequence_rep_id")
    return out.select("gene_index", F.round("sampling_probability", 9).alias("sampling_probability"))


DRAWS_SQL = f"""{WIDE_SQL}, g AS (SELECT genome_id, exact_sequence_rep_id, count(*) AS ne, greatest(CAST(floor(1.0::DOUBLE / count(*) * 1099511627776) AS BIGINT), 1) AS gl FROM wide GROUP BY 1, 2),
c AS (SELECT genome_id, sum(gl)::DOUBLE AS gs, greatest(CAST(floor(1.0::DOUBLE / CAST(sum(ne) AS BIGINT) * 1099511627776) AS BIGINT), 1) AS cl FROM g GROUP BY 1),
z AS (SELECT sum(cl)::DOUBLE AS cs FROM c),
lens AS (SELECT gene_index, genome_id, exact_sequence_rep_id,
  greatest(CAST(floor(cl::DOUBLE / cs * gl::DOUBLE / gs / ne::DOUBLE * 2305843009213693952) AS BIGINT), 1) AS len
  FROM wide JOIN g USING (genome_id, exact_sequence_rep_id) JOIN c USING (genome_id), z),
line AS (SELECT *, sum(len) OVER (ORDER BY genome_id, exact_sequence_rep_id, gene_index) AS hi, sum(len) OVER () AS total FROM lens),
d AS (SELECT range AS draw, CAST('0x' || substr(md5('42|draw|' || range), 1, 15) AS BIGINT)::HUGEINT AS u FROM range((SELECT count(*) FROM documents)))"""


@query("M05_balanced_draws", f"""WITH {DRAWS_SQL}
SELECT draw, gene_index FROM (SELECT draw, u * (SELECT max(hi) FROM line) // 1152921504606846976 AS place FROM d)
ASOF JOIN (SELECT gene_index, hi - len AS lo FROM line) ON place >= lo""")
def _(spark, sf):
    t = Tables(spark, sf)
    rows = wide_exact(t, "genome_id")
    return sampling.balanced_draws(rows, "genome_id", "exact_sequence_rep_id", "gene_index", t.documents.count(), seed=42)


_NUMBERED = """SELECT doc_id AS id, range AS kind, row_number() OVER (PARTITION BY range ORDER BY doc_id) - 1 AS x,
  count(*) OVER (PARTITION BY range) AS n FROM documents, range(3)"""


@query("M06_epoch_permutation", f"""WITH RECURSIVE {permuted_sql(_NUMBERED, "'45|' || kind")}
SELECT kind * n + place AS sample_no, id AS doc_id FROM walked WHERE kind * n + place < n * 5 // 2""")
def _(spark, sf):
    docs = Tables(spark, sf).documents.select("doc_id")
    return sampling.epoch_permutation(docs, "doc_id", docs.count() * 5 // 2, seed=42, epoch=3)


TASKS_SQL = """SELECT protein_id, status, 'l1' AS task FROM wide WHERE level1_label <> '' UNION ALL SELECT protein_id, status, 'l2' FROM wide WHERE level2_label <> ''
UNION ALL SELECT protein_id, status, 'l3_core' FROM wide WHERE status = 'trainable_core' AND node_primary <> ''
UNION ALL SELECT protein_id, status, 'l3_multilabel' FROM wide WHERE status = 'trainable_multilabel'
UNION ALL SELECT protein_id, status, status FROM wide WHERE status IN ('open_set', 'parent_only', 'defer')"""


@query("M07_task_routing", f"WITH {WIDE_SQL} {TASKS_SQL}")
def _(spark, sf):
    return labels.task_datasets(wide(Tables(spark, sf))).select("protein_id", "status", "task")


@query("M08_long_labels", f"""WITH {MAPPED_SQL}
SELECT p_partkey AS protein_id, status, level1_label, level2_label, node_primary AS node_name, 'primary' AS label_role FROM mapped WHERE trim(node_primary) <> ''
UNION ALL SELECT p_partkey, status, secondary_level1, secondary_level2, secondary_node, 'secondary' FROM mapped WHERE trim(secondary_node) <> ''""")
def _(spark, sf):
    return labels.to_long(mapped_parts(Tables(spark, sf)).withColumnRenamed("p_partkey", "protein_id"))


# the join index of the documents: exact representative as vector key, source split
INDEX_SQL = f"""{WIDE_SQL}, {SOURCE_SPLIT_SQL}, idx AS (SELECT protein_id, gene_index, contig_id || '_' || gene_index AS embedding_id,
    CAST(exact_sequence_rep_id AS VARCHAR) AS sequence_embedding_key, genome_id, contig_id, sequence_length, split, 'genome_context' AS split_strategy,
    'genome_context_v1' AS split_version, exact_sequence_rep_id, genome_id AS homology_cluster_id, status, level1_label, level2_label, node_primary, multi_label_flag
  FROM wide JOIN sourcesplit USING (genome_id)),
v1 AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx FROM (SELECT DISTINCT level1_label AS label FROM wide WHERE level1_label <> '')),
v2 AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx FROM (SELECT DISTINCT level2_label AS label FROM wide WHERE level2_label <> '')),
v3 AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx FROM (SELECT DISTINCT node_primary AS label FROM wide WHERE node_primary <> '' AND status = 'trainable_core')),
core AS (SELECT idx.*, v1.idx AS label_l1, v2.idx AS label_l2, v3.idx AS label_l3_core FROM idx JOIN v1 ON v1.label = level1_label
  JOIN v2 ON v2.label = level2_label JOIN v3 ON v3.label = node_primary WHERE status = 'trainable_core' AND split IN ('train', 'val', 'test'))"""


def index_table(t: Tables):
    rows = wide_split(t, wide_exact(t)).withColumn("homology_cluster_id", F.col("genome_id"))
    return labels.join_index(rows)


def vocabularies(t: Tables):
    rows = wide(t)
    core = rows.where("status = 'trainable_core'")
    return {
        "level1_label": labels.build_vocab(rows, ["level1_label"]),
        "level2_label": labels.build_vocab(rows, ["level2_label"]),
        "node_primary": labels.build_vocab(core, ["node_primary"]),
    }


def document_vectors(t: Tables):
    """Vectors keyed as the join index keys them."""
    return t.embeddings.select(F.col("vec_id").cast("string").alias("sequence_embedding_key"), "embedding")


@query("M09_core_pack", f"""WITH {INDEX_SQL}
SELECT protein_id, split, label_l1, label_l2, label_l3_core, 64 AS dim, row_number() OVER (PARTITION BY split ORDER BY protein_id) - 1 AS row_index
FROM core JOIN embeddings ON CAST(vec_id AS VARCHAR) = sequence_embedding_key""")
def _(spark, sf):
    t = Tables(spark, sf)
    pack = packs.core_pack(index_table(t), document_vectors(t), vocabularies(t))
    return pack.select(
        "protein_id", "split", "label_l1", "label_l2", "label_l3_core", F.size("embedding").alias("dim"), "row_index"
    )


def text_vectors(t: Tables):
    """A vector for every exact group of documents, so that the required modality covers all rows."""
    reps = clusters.exact_dedup(t.documents, "doc_id", "text").where("member = rep")
    texts = t.documents.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    encoded = vectors.vectorize(texts, "doc_id", "text", vectors.residue_counts(32))
    path = scratch_dir(texts.sparkSession, "vectors")
    io.write_parquet(encoded, path)
    stored = io.read_parquet(texts.sparkSession, path)
    return stored.select(F.col("embedding_id").cast("string").alias("sequence_embedding_key"), "embedding")


@query("M10_multimodal_pack", f"""WITH {INDEX_SQL}
SELECT protein_id, split, label_l3_core, true AS has_sequence, vec_id IS NOT NULL AS has_structure, quality IS NOT NULL AND n_chars > 500 AS has_context,
  round(coalesce(CASE WHEN n_chars > 500 THEN n_chars / 100000.0::DOUBLE END, 0), 6) AS center_len_norm,
  row_number() OVER (PARTITION BY split ORDER BY protein_id) - 1 AS row_index
FROM core LEFT JOIN embeddings ON CAST(vec_id AS VARCHAR) = sequence_embedding_key JOIN documents ON doc_id = gene_index LEFT JOIN labels USING (doc_id)""")
def _(spark, sf):
    t = Tables(spark, sf)
    context = t.documents.join(t.labels, "doc_id").where("n_chars > 500").select(
        F.col("doc_id").cast("string").alias("protein_id"), (F.col("n_chars") / 100000).alias("center_len_norm")
    )
    pack = packs.multimodal_pack(
        index_table(t), text_vectors(t), vocabularies(t), structure=document_vectors(t), context=context, structure_dim=64
    )
    bit = {n: F.get("modality_mask", F.lit(i)).alias(n) for i, n in enumerate(("has_sequence", "has_structure", "has_context"))}
    return pack.select(
        "protein_id", "split", "label_l3_core", *bit.values(),
        F.round(F.get("context_features", F.lit(0)), 6).alias("center_len_norm"), "row_index",
    )


@query("M10_graph_pack", f"""WITH {INDEX_SQL}
SELECT protein_id, split, quality = 1 AS has_context, CAST(least(4, rn) + least(4, n - 1 - rn) + 1 AS INTEGER) AS valid_nodes
FROM core JOIN labels ON doc_id = gene_index JOIN (
  SELECT doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS rn, count(*) OVER (PARTITION BY source, lang) AS n FROM documents) o USING (doc_id)""")
def _(spark, sf):
    from orfloom.operators.context import context_graph

    t = Tables(spark, sf)
    docs = t.documents.select(F.col("doc_id").cast("string").alias("protein_id"), "doc_id", "source", "lang", "n_chars")
    graphs = context_graph(
        docs, ["source", "lang"], ["doc_id"], F.col("n_chars"), F.lit("+"), F.col("lang"), sizes=(4,)
    )
    pack = packs.multimodal_pack(index_table(t), text_vectors(t), vocabularies(t), graphs=graphs, structure_dim=64)
    valid = F.size(F.filter("node_mask", lambda m: m))
    return pack.select("protein_id", "split", F.get("modality_mask", F.lit(2)).alias("has_context"), valid.alias("valid_nodes"))


@query("M11_join_index", f"WITH {INDEX_SQL} SELECT * FROM idx")
def _(spark, sf):
    return index_table(Tables(spark, sf))


@query("M12_structure_targets", f"""WITH {WIDE_SQL}, first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY exact_sequence_rep_id ORDER BY gene_index) AS rn
  FROM wide WHERE status = 'trainable_core') WHERE rn = 1)
SELECT exact_sequence_rep_id, gene_index, sha256(sequence) AS sequence_sha256, CASE WHEN vec_id IS NOT NULL THEN 'BF' || label END AS candidate_bfvd_model_id,
  CASE WHEN vec_id IS NOT NULL THEN 'model' END AS candidate_viro3d_qualifier, vec_id IS NOT NULL AS structure_lookup_ready
FROM first LEFT JOIN embeddings ON vec_id = exact_sequence_rep_id""")
def _(spark, sf):
    t = Tables(spark, sf)
    hints = t.embeddings.select(
        F.col("vec_id").alias("exact_sequence_rep_id"), F.concat(F.lit("BF"), "label").alias("candidate_bfvd_model_id"),
        F.lit("model").alias("candidate_viro3d_qualifier"),
    )
    targets = assets.structure_targets(wide_exact(t, "sequence", "status"), "gene_index", hints=hints)
    return targets.select(
        "exact_sequence_rep_id", "gene_index", "sequence_sha256", "candidate_bfvd_model_id",
        "candidate_viro3d_qualifier", "structure_lookup_ready",
    )


PLAN_SQL = f"""{WIDE_SQL}, exact AS (SELECT exact_sequence_rep_id, arg_min(sequence_length, gene_index) AS sequence_length,
    nullif(regexp_extract(arg_min('PHROG_' || replace(genome_id, 'src', ''), gene_index), '^PHROG_([0-9]+)$', 1), '') AS family_id,
    bool_or(status = 'trainable_core') AS any_core FROM wide GROUP BY 1),
plan AS (SELECT e.*, vec_id IS NOT NULL AND label < 5 AS has_local_structure, printf('phrog_%05d.tar.gz', CAST(family_id AS INTEGER)) AS archive_name
  FROM exact e LEFT JOIN embeddings ON vec_id = exact_sequence_rep_id)"""


def search_plan(t: Tables):
    rows = wide_split(t, wide_exact(t, "genome_id", "sequence_length", "status"))
    rows = rows.withColumn("phrog_annotation", F.concat(F.lit("PHROG_"), F.regexp_replace("genome_id", "src", "")))
    local = t.embeddings.select(
        F.col("vec_id").alias("exact_sequence_rep_id"), (F.col("label") < 5).alias("has_local_structure")
    )
    return assets.retrieval_plan(rows, local, F.col("gene_index"))


@query("M13_retrieval_plan", f"""WITH {PLAN_SQL}
SELECT *, NOT has_local_structure AS needs_structure, NOT has_local_structure AND family_id IS NOT NULL AS candidate_for_search FROM plan""")
def _(spark, sf):
    return search_plan(Tables(spark, sf)).drop("phrog_annotation", "split_count")


@query("M13_plan_families", f"""WITH {PLAN_SQL}
SELECT family_id, count(*) AS members, median(sequence_length) AS median_length, bool_or(any_core) AS any_core, min(archive_name) AS archive
FROM plan WHERE NOT has_local_structure AND family_id IS NOT NULL GROUP BY 1 ORDER BY members DESC, family_id""")
def _(spark, sf):
    return assets.plan_families(search_plan(Tables(spark, sf)))


@query("M14_source_cascade", """
SELECT doc_id, CASE WHEN quality IS NOT NULL THEN 'local' WHEN vec_id IS NOT NULL THEN 'bulk' ELSE 'online' END AS source
FROM documents LEFT JOIN labels USING (doc_id) LEFT JOIN embeddings ON vec_id = doc_id""")
def _(spark, sf):
    t = Tables(spark, sf)
    bulk = labels.where_available(t.embeddings.select(F.col("vec_id").alias("doc_id")), t.documents, "doc_id")
    candidates = (
        t.labels.select("doc_id", F.lit("local").alias("source"))
        .unionByName(bulk.withColumn("source", F.lit("bulk")))
        .unionByName(t.documents.select("doc_id", F.lit("online").alias("source")))
    )
    return assets.first_source(candidates, "doc_id", "source", ["local", "bulk", "online"])


CLEAN_TEXT = "translate({}, 'UZOB', 'XXXX')".format(sql_strip("upper(replace(text, 'ß', 'ss'))"))
VECTOR_SQL = f"""clean AS (SELECT doc_id, s AS text FROM (SELECT doc_id, {CLEAN_TEXT} AS s FROM documents) WHERE length(s) > 0),
{WINDOWS_SQL.replace('FROM documents)', 'FROM clean)')},
codes AS (SELECT doc_id, L, i, weight, "end" - start - 1 AS pairs, list_transform(range(1, "end" - start), lambda k: (unicode(w[k]) * 31 + unicode(w[k + 1])) % 32) AS b
  FROM (SELECT *, string_split(substring(text, start + 1, "end" - start), '') AS w FROM weighted)),
counted AS (SELECT doc_id, L, i, weight, pairs, b, count(*) AS c FROM (SELECT doc_id, L, i, weight, pairs, unnest(b) AS b FROM codes) GROUP BY ALL),
pooled AS (SELECT doc_id, L, b, sum(weight * c / pairs::DOUBLE) / L AS v FROM counted GROUP BY 1, 2, 3)"""


@query("M15_vectorize", f"""WITH {VECTOR_SQL}
SELECT doc_id AS embedding_id, CAST(rn // 64 AS INTEGER) AS shard_no, CAST(rn % 64 AS INTEGER) AS row_index, CAST(L AS INTEGER) AS orig_seq_len,
  CAST(L AS INTEGER) AS effective_seq_len, false AS truncated_flag, round(top, 4) AS top, round(weighted, 3) AS weighted FROM (
  SELECT doc_id, L, max(v) AS top, sum(v * (b + 1)) AS weighted, row_number() OVER (ORDER BY L, doc_id) - 1 AS rn FROM pooled GROUP BY 1, 2)""")
def _(spark, sf):
    out = vectors.vectorize(Tables(spark, sf).documents, "doc_id", "text", vectors.residue_counts(32), shard_rows=64)
    weighted = F.aggregate(
        F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x
    )
    return out.select(
        "embedding_id", "shard_no", "row_index", "orig_seq_len", "effective_seq_len", "truncated_flag",
        F.round(F.array_max("embedding").cast("double"), 4).alias("top"), F.round(weighted, 3).alias("weighted"),
    )


@query("M15_vectorize_resume", f"""WITH clean AS (SELECT doc_id, {CLEAN_TEXT} AS s, doc_id IN (SELECT doc_id FROM labels) AS early FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY early ORDER BY length(s), doc_id) - 1 AS rn, count(*) FILTER (WHERE early) OVER () AS stored
  FROM clean WHERE length(s) > 0)
SELECT doc_id AS embedding_id, CAST(rn // 64 + CASE WHEN early THEN 0 ELSE (stored + 63) // 64 END AS INTEGER) AS shard_no, CAST(rn % 64 AS INTEGER) AS row_index,
  CAST(length(s) AS INTEGER) AS orig_seq_len, CAST(length(s) AS INTEGER) AS effective_seq_len, false AS truncated_flag FROM numbered""")
def _(spark, sf):
    t = Tables(spark, sf)
    encoder = vectors.residue_counts(32)
    columns = ["embedding_id", "shard_no", "row_index", "orig_seq_len", "effective_seq_len", "truncated_flag"]
    early = t.documents.join(t.labels.select("doc_id"), "doc_id", "left_semi")
    stored = cut_lineage(vectors.vectorize(early, "doc_id", "text", encoder, shard_rows=64).select(*columns))
    done = stored.select(F.col("embedding_id").alias("id"), "shard_no")
    added = vectors.vectorize(t.documents, "doc_id", "text", encoder, done=done, shard_rows=64)
    return stored.unionByName(added.select(*columns))


@query("S15_stored_index", f"""WITH clean AS (SELECT doc_id, length(s) AS L FROM (SELECT doc_id, {CLEAN_TEXT} AS s FROM documents) WHERE length(s) > 0),
numbered AS (SELECT *, row_number() OVER (ORDER BY L, doc_id) - 1 AS rn FROM clean)
SELECT strategy, doc_id AS embedding_id, CAST(rn // 64 AS INTEGER) AS shard_no, CAST(rn % 64 AS INTEGER) AS row_index, printf('shard_%05d', CAST(rn // 64 AS INTEGER)) AS shard_name,
  CAST(L AS INTEGER) AS orig_seq_len, CAST(CASE WHEN strategy = 'truncate' THEN least(L, 512) ELSE L END AS INTEGER) AS effective_seq_len,
  strategy = 'truncate' AND L > 512 AS truncated_flag FROM numbered, (SELECT unnest(['sliding_windows', 'truncate']) AS strategy)""")
def _(spark, sf):
    docs, parts = Tables(spark, sf).documents, []
    for strategy in ("sliding_windows", "truncate"):
        path = scratch_dir(spark, "shards")
        vectors.write_shards(vectors.vectorize(docs, "doc_id", "text", vectors.residue_counts(8), strategy=strategy, shard_rows=64), path, shards_per_file=1_024)
        parts.append(vectors.stored_index(spark, path).withColumn("strategy", F.lit(strategy)))
    return parts[0].unionByName(parts[1])


@query("M16_modality_dropout", """
SELECT doc_id, true AS sequence, vec_id IS NOT NULL AND CAST('0x' || substr(md5('7|1|' || doc_id), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE > 0.3 AS structure,
  quality IS NOT NULL AND CAST('0x' || substr(md5('7|2|' || doc_id), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE > 0.3 AS context
FROM documents LEFT JOIN embeddings ON vec_id = doc_id LEFT JOIN labels USING (doc_id)""")
def _(spark, sf):
    t = Tables(spark, sf)
    emb = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    joined = t.documents.join(emb, "doc_id", "left").join(t.labels, "doc_id", "left")
    masked = joined.select("doc_id", fn.modality_mask(F.col("text"), F.col("embedding"), F.col("quality")).alias("m"))
    dropped = sampling.modality_dropout(masked, "m", "doc_id", 0.3, seed=7)
    return dropped.select("doc_id", *[F.get("m", F.lit(i)).alias(n) for i, n in enumerate(("sequence", "structure", "context"))])


@query("M17_gated_fusion", """
SELECT vec_id, round(g1, 6) AS gate_sequence, round(CASE WHEN ok THEN g2 ELSE 0 END, 6) AS gate_structure, round(list_sum(list_transform(range(1, 17), lambda i:
  e[i] + g1 * e[16 + i] + CASE WHEN ok THEN g2 * e[32 + i] ELSE 0 END)), 5) AS fused_total FROM (
  SELECT vec_id, ok, e, exp(e[1]) / (exp(e[1]) + CASE WHEN ok THEN exp(e[2]) ELSE 0 END) AS g1, exp(e[2]) / (exp(e[1]) + exp(e[2])) AS g2
  FROM (SELECT vec_id, label < 6 AS ok, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings))""")
def _(spark, sf):
    e = F.col("embedding")
    mask = F.array(F.lit(True), F.col("label") < 6)
    out = fn.gated_fuse(F.slice(e, 1, 16), [F.slice(e, 17, 16), F.slice(e, 33, 16)], F.slice(e, 1, 2), mask)
    fused = Tables(spark, sf).embeddings.select("vec_id", out.alias("o"))
    gate = [F.round(F.get("o.gates", F.lit(i)), 6).alias(n) for i, n in enumerate(("gate_sequence", "gate_structure"))]
    return fused.select("vec_id", *gate, F.round(fn.total(F.col("o.fused")), 5).alias("fused_total"))


def _head_sql(name: str) -> str:
    return f"(SELECT split, avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END) AS f FROM (SELECT split, class, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (SELECT split, target_{name} AS class, CAST(target_{name} = pred_{name} AS INT) AS tp, 0 AS fp, CAST(target_{name} <> pred_{name} AS INT) AS fn FROM preds UNION ALL SELECT split, pred_{name}, 0, CAST(target_{name} <> pred_{name} AS INT), 0 FROM preds) GROUP BY 1, 2) GROUP BY 1)"


@query("M18_evaluation_bundle", f"""WITH {PRED_SQL}, acc AS (SELECT split, avg(CAST(target_l1 = pred_l1 AS INT)) AS a1, avg(CAST(target_l2 = pred_l2 AS INT)) AS a2,
  avg(CAST(target_l3 = pred_l3 AS INT)) AS a3, avg(gate_sequence) AS g1, avg(gate_structure) AS g2, avg(gate_context) AS g3 FROM preds GROUP BY 1)
SELECT acc.split, round(a1, 6) AS l1_accuracy, round(a2, 6) AS l2_accuracy, round(a3, 6) AS l3_accuracy, round(x1.f, 6) AS l1_macro_f1, round(x2.f, 6) AS l2_macro_f1,
  round(x3.f, 6) AS l3_macro_f1, round(g1, 6) AS gate_sequence, round(g2, 6) AS gate_structure, round(g3, 6) AS gate_context
FROM acc JOIN {_head_sql('l1')} x1 USING (split) JOIN {_head_sql('l2')} x2 USING (split) JOIN {_head_sql('l3')} x3 USING (split)""")
def _(spark, sf):
    gates = ["gate_sequence", "gate_structure", "gate_context"]
    out = evaluation.evaluate(predictions(Tables(spark, sf)), HEADS, "split", gates)
    return out.select("split", *[F.round(c, 6).alias(c) for c in out.columns if c != "split"])


GATES = ["gate_sequence", "gate_structure", "gate_context"]


def bundle(t: Tables) -> evaluation.Bundle:
    return evaluation.Bundle(predictions(t), {f"l{i}": (f"target_l{i}", f"pred_l{i}") for i in (1, 2, 3)}, "split", GATES)


LONG_SQL = " UNION ALL ".join(f"SELECT split, 'l{i}' AS head, target_l{i} AS t, pred_l{i} AS p FROM preds" for i in (1, 2, 3))


@query("M18_bundle_metrics", f"""WITH {PRED_SQL}, long AS ({LONG_SQL}),
counts AS (SELECT split, head, class, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (
  SELECT split, head, t AS class, CAST(t = p AS INT) AS tp, 0 AS fp, CAST(t <> p AS INT) AS fn FROM long
  UNION ALL SELECT split, head, p, 0, CAST(t <> p AS INT), 0 FROM long) GROUP BY ALL),
f1 AS (SELECT split, head, round(avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END), 6) AS macro_f1 FROM counts GROUP BY ALL)
SELECT split, head, count(*) AS rows, round(avg(CAST(t = p AS INT)), 6) AS accuracy, any_value(macro_f1) AS macro_f1 FROM long JOIN f1 USING (split, head) GROUP BY 1, 2""")
def _(spark, sf):
    out = bundle(Tables(spark, sf)).metrics()
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "macro_f1")})


@query("M18_bundle_confusion", f"""WITH {PRED_SQL}, long AS ({LONG_SQL})
SELECT split, head, CAST(t AS VARCHAR) AS target, CAST(p AS VARCHAR) AS pred, count(*) AS n FROM long GROUP BY ALL""")
def _(spark, sf):
    return bundle(Tables(spark, sf)).confusion()


@query("M18_bundle_gates", f"""WITH {PRED_SQL} SELECT split, CAST(target_l3 AS VARCHAR) AS class, count(*) AS rows,
  {", ".join(f"round(avg({g}) + 1e-12, 9) AS {g}" for g in GATES)} FROM preds GROUP BY 1, 2""")
def _(spark, sf):
    out = bundle(Tables(spark, sf)).gates_by_class("l3")
    return out.withColumns({g: F.round(F.col(g) + 1e-12, 9) for g in GATES})


@query("M18_bundle_violations", f"""WITH {PRED_SQL} SELECT split, count(n.n_nationkey) FILTER (WHERE r.r_regionkey IS NOT NULL) AS checked,
  round(coalesce(avg(CASE WHEN n.n_regionkey <> pred_l2 OR r_regionkey % 2 <> pred_l1 THEN 1.0 ELSE 0.0 END) FILTER (WHERE n.n_nationkey IS NOT NULL AND r.r_regionkey IS NOT NULL), 0), 9) AS violation_rate
FROM preds LEFT JOIN nation n ON n.n_nationkey = pred_l3 LEFT JOIN region r ON r.r_regionkey = pred_l2 GROUP BY split""")
def _(spark, sf):
    from orfloom.plans.aggregates import parent_maps

    t = Tables(spark, sf)
    out = bundle(t).violations("pred_l1", "pred_l2", "pred_l3", *parent_maps(t))
    return out.withColumn("violation_rate", F.round("violation_rate", 9))


@query("M18_bundle_topk", """
SELECT vec_id, CASE WHEN vec_id % 10 < 7 THEN 'train' ELSE 'test' END AS split, confidence, string_agg(CAST(pos - 1 AS VARCHAR), ',' ORDER BY rn) AS topk_indices,
  string_agg(printf('%.6f', x), ',' ORDER BY rn) AS topk_scores FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, pos) AS rn, max(x) OVER (PARTITION BY vec_id) AS confidence FROM (
    SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)) WHERE rn <= 3 GROUP BY 1, 2, 3""")
def _(spark, sf):
    rows = Tables(spark, sf).embeddings.select(
        "vec_id", "embedding", F.when(F.col("vec_id") % 10 < 7, "train").otherwise("test").alias("split"),
        F.col("label").alias("t"), F.col("label").alias("p"),
    )
    return evaluation.Bundle(rows, {"label": ("t", "p")}).topk("embedding", "vec_id")


@query("M19_ablation_report", f"""WITH {RUNS_SQL.replace("variant = 'AF'", "variant = 'seq_only'").replace("l_returnflag || l_linestatus AS variant", "CASE WHEN l_returnflag || l_linestatus = 'AF' THEN 'seq_only' WHEN l_returnflag || l_linestatus = 'NO' THEN 'seq_ctx' ELSE l_returnflag || l_linestatus END AS variant")},
{STABILITY_SQL.replace("variant = 'AF'", "variant = 'seq_only'")}
SELECT d.variant, d.seed, round(d.delta, 9) AS relative_to_seq_only_l3, round(d.metric - h.metric, 9) AS relative_to_ctx_handcrafted_l3, stability_label
FROM deltas d JOIN verdicts USING (variant) LEFT JOIN (SELECT seed, metric FROM runs WHERE variant = 'seq_ctx') h ON h.seed = d.seed""")
def _(spark, sf):
    runs = run_table(Tables(spark, sf)).withColumnRenamed("metric", "best_val_l3_macro_f1")
    runs = runs.replace({"AF": "seq_only", "NO": "seq_ctx"}, subset=["variant"])
    out = ablation_report(runs)
    rounded = {c: F.round(c, 9) for c in ("relative_to_seq_only_l3", "relative_to_ctx_handcrafted_l3")}
    return out.withColumns(rounded).select("variant", "seed", *rounded, "stability_label")


@query("M20_asset_reconciliation", """
SELECT c_mktsegment || '/' || CASE WHEN c_nationkey < 10 THEN 'cif' ELSE 'pdb' END AS output_relpath,
  CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'existing' ELSE 'to_fetch' END AS state FROM (SELECT DISTINCT c_mktsegment, c_nationkey < 10, c_nationkey FROM customer) GROUP BY 1, 2""")
def _(spark, sf):
    root = scratch_dir(spark, "structures")
    keys = Tables(spark, sf).customer.select(
        "c_mktsegment", F.when(F.col("c_nationkey") < 10, "cif").otherwise("pdb").alias("fmt")
    ).distinct()
    good = F.when(F.col("fmt") == "cif", "data_x").otherwise("HEADER x")
    body = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), good).otherwise("<html>not found</html>")
    present = keys.where("c_mktsegment <> 'FURNITURE'")
    present.select("c_mktsegment", "fmt", body.alias("value")).coalesce(1).write.partitionBy("c_mktsegment", "fmt").text(root)
    relpath = F.concat_ws(
        "/", F.regexp_extract("path", "c_mktsegment=([^/]+)/", 1), F.regexp_extract("path", "fmt=([^/]+)/", 1)
    )
    files = io.read_texts(spark, root, ".txt").select(relpath.alias("output_relpath"), "text")
    manifest = keys.select(F.concat_ws("/", "c_mktsegment", "fmt").alias("output_relpath"), F.col("fmt").alias("preferred_format"))
    return assets.reconcile_assets(manifest, files).select("output_relpath", "state")
