"""Column functions on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from orfloom import functions as fn
from orfloom.operators import context, evaluation
from orfloom.operators.packs import CONTEXT_FEATURES
from orfloom.plans.registry import PRED_SQL, Tables, predictions, query, sql_strip
from orfloom.plans.windows import _features_sql

# annotation texts made from part columns: padded, upper-cased, aliased or empty
ANNOTATION_SQL = """(SELECT p_partkey, p_size, CASE WHEN p_type = 'PROMO' THEN NULL WHEN p_type = 'SMALL' THEN ' NA ' WHEN p_type = 'LARGE' AND p_size > 25 THEN '<No_PHROG_mapping>'
  WHEN p_type = 'LARGE' THEN '   ' WHEN p_type = 'MEDIUM' AND p_size > 40 THEN 'NaN' ELSE '  ' || p_name || '   ' || p_brand || ' ' END AS a FROM part)"""


def annotated(t: Tables):
    size, kind = F.col("p_size"), F.col("p_type")
    text = (
        F.when(kind == "PROMO", F.lit(None)).when(kind == "SMALL", F.lit(" NA "))
        .when((kind == "LARGE") & (size > 25), F.lit("<No_PHROG_mapping>")).when(kind == "LARGE", F.lit("   "))
        .when((kind == "MEDIUM") & (size > 40), F.lit("NaN"))
        .otherwise(F.concat(F.lit("  "), "p_name", F.lit("   "), "p_brand", F.lit(" ")))
    )
    return t.part.select("p_partkey", "p_size", text.alias("a"))


@query("F01_normalize_annotation", f"""
SELECT p_partkey, CASE WHEN a IS NULL OR s IN ('', 'NA', 'None', 'nan') THEN 'unresolved_blank_annotation'
  WHEN lower(s) IN ('<no_phrog_mapping>', 'no_phrog_mapping') THEN 'no_phrog_mapping' ELSE s END AS annotation
FROM (SELECT *, regexp_replace(trim(a), ' +', ' ', 'g') AS s FROM {ANNOTATION_SQL})""")
def _(spark, sf):
    return annotated(Tables(spark, sf)).select("p_partkey", fn.normalize_annotation(F.col("a")).alias("annotation"))


@query("F02_known", f"""
SELECT p_partkey, CASE WHEN a IS NULL OR lower(trim(a)) IN ('', 'nan', '<no_phrog_mapping>') THEN 0 ELSE 1 END AS known FROM {ANNOTATION_SQL}""")
def _(spark, sf):
    return annotated(Tables(spark, sf)).select("p_partkey", fn.is_known(F.col("a")).alias("known"))


@query("F03_len_norm", "SELECT event_id, CASE WHEN v IS NULL THEN 0.0::DOUBLE ELSE least(v / 100, 1.0) END AS len FROM (SELECT event_id, nullif(value, 0.01) AS v FROM events)")
def _(spark, sf):
    value = F.nullif(F.col("value"), F.lit(0.01))
    return Tables(spark, sf).events.select("event_id", fn.len_norm(value, 100.0).alias("len"))


STRAND_SQL = "(SELECT event_id, CASE event_type WHEN 'view' THEN ' + ' WHEN 'click' THEN 'reverse' WHEN 'signup' THEN 'F' WHEN 'error' THEN '-1' ELSE NULL END AS s FROM events)"


def strands(t: Tables):
    kind = F.col("event_type")
    text = (
        F.when(kind == "view", " + ").when(kind == "click", "reverse").when(kind == "signup", "F").when(kind == "error", "-1")
    )
    return t.events.select("event_id", text.alias("s"))


@query("F04_strand_flags", f"""
SELECT event_id, coalesce(CAST(trim(s) IN ('+', '1', 'forward', 'f') AS DOUBLE), 0) AS forward,
  coalesce(CAST(trim(s) IN ('-', '-1', 'reverse', 'r') AS DOUBLE), 0) AS reverse FROM {STRAND_SQL}""")
def _(spark, sf):
    flags = fn.strand_flags(F.col("s"))
    return strands(Tables(spark, sf)).select("event_id", flags["forward"].alias("forward"), flags["reverse"].alias("reverse"))


@query("F05_same_strand", f"SELECT event_id, trim(s) IS NOT DISTINCT FROM '+' AS plus, s IS NULL AS unknown FROM {STRAND_SQL}")
def _(spark, sf):
    s = F.col("s")
    return strands(Tables(spark, sf)).select(
        "event_id", fn.same_strand(s, F.lit("+ ")).alias("plus"), fn.same_strand(s, F.lit(None)).alias("unknown")
    )


@query("F06_sanitize", f"""
SELECT doc_id, md5(translate({sql_strip("upper(replace(text, 'ß', 'ss'))")}, 'UZOB', 'XXXX')) AS digest FROM documents""")
def _(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", F.md5(fn.sanitize_seq(F.col("text"))).alias("digest"))


@query("F07_residue_text", """
SELECT doc_id, md5(array_to_string(string_split(text, ''), ' ')) AS spaced, md5(array_to_string(string_split(text, ''), '#') || '#') AS placeholder,
  md5(array_to_string(list_transform(range(0, len(p) // 2), lambda i: p[2 * i + 1:2 * i + 2]), '|')) AS pairs
FROM (SELECT doc_id, text, CASE WHEN length(text) % 2 = 1 THEN text || '#' ELSE text END AS p FROM documents)""")
def _(spark, sf):
    even = F.when(F.length("text") % 2 == 1, F.concat("text", F.lit("#"))).otherwise(F.col("text"))
    docs = Tables(spark, sf).documents.select("doc_id", "text", even.alias("p"))
    return docs.select(
        "doc_id",
        F.md5(fn.space_residues(F.col("text"))).alias("spaced"),
        F.md5(fn.placeholder_residues(F.col("text"))).alias("placeholder"),
        F.md5(F.array_join(fn.pair_tokens(F.col("p")), "|")).alias("pairs"),
    )


@query("F08_sequence_length", "SELECT doc_id, CAST(length(text) AS INTEGER) AS n FROM documents")
def _(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", fn.seq_len(F.col("text")).alias("n"))


WINDOWS_SQL = """win AS (SELECT doc_id, text, L, i, CASE WHEN L <= 512 THEN 0 ELSE least(i * 384, L - 512) END AS start,
    CASE WHEN L <= 512 THEN L ELSE least(i * 384, L - 512) + 512 END AS "end"
  FROM (SELECT doc_id, text, L, unnest(range(0, CASE WHEN L <= 512 THEN 1 ELSE CAST(ceil((L - 512) / 384) AS BIGINT) + 1 END)) AS i
    FROM (SELECT doc_id, text, length(text) AS L FROM documents))),
weighted AS (SELECT *, greatest("end" - greatest(start, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY i), 0)), 1) AS weight FROM win)"""


@query("F09_windows", f"""WITH {WINDOWS_SQL}
SELECT doc_id, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", md5(substring(text, start + 1, "end" - start)) AS digest FROM win""")
def _(spark, sf):
    docs = Tables(spark, sf).documents.select("doc_id", "text", F.explode(fn.windows(F.length("text"), 512, 128)).alias("w"))
    return docs.select("doc_id", "w.start", "w.end", F.md5(fn.window_text(F.col("text"), F.col("w"))).alias("digest"))


@query("F10_coverage_weights", f"""WITH {WINDOWS_SQL}
SELECT doc_id, CAST(i AS INTEGER) AS i, CAST(weight AS INTEGER) AS weight FROM weighted""")
def _(spark, sf):
    weights = fn.coverage_weights(fn.windows(F.length("text"), 512, 128))
    return Tables(spark, sf).documents.select("doc_id", F.posexplode(weights).alias("i", "weight"))


@query("F11_effective_length", """
SELECT doc_id, CAST(least(length(text), 512) AS INTEGER) AS cut, length(text) > 512 AS cut_truncated, CAST(length(text) AS INTEGER) AS slid, false AS slid_truncated FROM documents""")
def _(spark, sf):
    n = F.length("text")
    return Tables(spark, sf).documents.select(
        "doc_id",
        fn.effective_len(n, 512, "truncate").alias("cut"), fn.is_truncated(n, 512, "truncate").alias("cut_truncated"),
        fn.effective_len(n, 512, "sliding_windows").alias("slid"),
        fn.is_truncated(n, 512, "sliding_windows").alias("slid_truncated"),
    )


# identifiers of several shapes made from part columns
IDENT_SQL = """(SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'P' || (p_partkey % 10) || 'AB' || (p_size % 10) || '7' WHEN 'SMALL' THEN 'AF-P' || p_partkey || '-F1'
  WHEN 'LARGE' THEN 'NC_' || p_partkey || '.1' WHEN 'MEDIUM' THEN ' PhRog_' || p_size WHEN 'ECONOMY' THEN 'MN' || (100000 + p_partkey) || '.2' ELSE NULL END AS x FROM part)"""


def identifiers(t: Tables):
    key, size, kind = F.col("p_partkey"), F.col("p_size"), F.col("p_type")
    x = (
        F.when(kind == "PROMO", F.concat(F.lit("P"), key % 10, F.lit("AB"), size % 10, F.lit("7")))
        .when(kind == "SMALL", F.concat(F.lit("AF-P"), key, F.lit("-F1")))
        .when(kind == "LARGE", F.concat(F.lit("NC_"), key, F.lit(".1")))
        .when(kind == "MEDIUM", F.concat(F.lit(" PhRog_"), size))
        .when(kind == "ECONOMY", F.concat(F.lit("MN"), key + 100000, F.lit(".2")))
    )
    return t.part.select("p_partkey", x.alias("x"))


@query("F12_identifier_shapes", f"""
SELECT p_partkey, CASE WHEN regexp_full_match(trim(x), '[OPQ][0-9][A-Z0-9]{{3}}[0-9]|[A-NR-Z][0-9][A-Z0-9]{{3}}[0-9]|[A-Z0-9]{{10}}') THEN trim(x) END AS uniprot,
  CASE WHEN starts_with(trim(x), 'AF-') AND contains(trim(x), '-F') THEN trim(x) END AS afdb,
  CASE WHEN regexp_full_match(trim(x), '[A-Z]{{1,4}}_[0-9]+(\\.[0-9]+)?|[A-Z]{{1,2}}[0-9]{{5,}}\\.[0-9]+|[A-Z]{{3}}[0-9]{{5,}}\\.[0-9]+') THEN trim(x) END AS genbank FROM {IDENT_SQL}""")
def _(spark, sf):
    x = F.col("x")
    return identifiers(Tables(spark, sf)).select(
        "p_partkey", fn.uniprot_like(x).alias("uniprot"), fn.afdb_like(x).alias("afdb"), fn.genbank_like(x).alias("genbank")
    )


@query("F13_family_archive", f"""
SELECT p_partkey, f AS family, CASE WHEN f IS NOT NULL THEN printf('phrog_%05d.tar.gz', CAST(f AS INTEGER)) END AS archive
FROM (SELECT p_partkey, nullif(regexp_extract(lower(trim(x)), '^phrog_([0-9]+)$', 1), '') AS f FROM {IDENT_SQL})""")
def _(spark, sf):
    family = fn.family_id(F.col("x"))
    return identifiers(Tables(spark, sf)).select("p_partkey", family.alias("family"), fn.archive_name(family).alias("archive"))


@query("F14_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", fn.seq_sha256(F.col("text")).alias("digest"))


@query("F15_clean_value", f"SELECT p_partkey, CASE WHEN trim(a) <> '' AND lower(trim(a)) <> 'nan' THEN trim(a) END AS a FROM {ANNOTATION_SQL}")
def _(spark, sf):
    return annotated(Tables(spark, sf)).select("p_partkey", fn.clean(F.col("a")).alias("a"))


@query("F16_format_name", """
SELECT p_partkey, CASE WHEN f IS NULL OR f = '' OR lower(f) IN ('mmcif', 'cif') THEN 'cif' ELSE lower(f) END AS format FROM (
  SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'mmCIF' WHEN 'SMALL' THEN 'PDB' WHEN 'LARGE' THEN '' WHEN 'MEDIUM' THEN 'BCIF' END AS f FROM part)""")
def _(spark, sf):
    kind = F.col("p_type")
    f = F.when(kind == "PROMO", "mmCIF").when(kind == "SMALL", "PDB").when(kind == "LARGE", "").when(kind == "MEDIUM", "BCIF")
    return Tables(spark, sf).part.select("p_partkey", fn.norm_format(f).alias("format"))


@query("F17_number_priority", """
SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN -1.0 WHEN p_type = 'SMALL' THEN -1.0 ELSE p_retailprice END AS num,
  CASE p_type WHEN 'MEDIUM' THEN 0 WHEN 'LARGE' THEN 1 ELSE 999 END AS prio FROM part""")
def _(spark, sf):
    kind = F.col("p_type")
    text = F.when(kind == "PROMO", "n/a").when(kind == "SMALL", "nan").otherwise(F.col("p_retailprice").cast("string"))
    return Tables(spark, sf).part.select(
        "p_partkey", fn.to_num(text).alias("num"), fn.priority(kind, {"MEDIUM": 0, "LARGE": 1}).alias("prio")
    )


@query("F18_output_path", """
SELECT p_partkey, lower(p_type) || '/' || p_partkey || '__' || lower(p_type) || '__' || p_brand || CASE WHEN p_size > 25 THEN '.cif' ELSE '.pdb' END AS path FROM part""")
def _(spark, sf):
    fmt = F.when(F.col("p_size") > 25, "cif").otherwise("other")
    path = fn.output_path(F.col("p_type"), F.col("p_partkey"), F.col("p_brand"), fmt)
    return Tables(spark, sf).part.select("p_partkey", path.alias("path"))


@query("F19_instance_key", "SELECT o_orderkey, o_orderstatus || '_' || o_orderkey AS embedding_id FROM orders")
def _(spark, sf):
    key = fn.instance_key(F.col("o_orderstatus"), F.col("o_orderkey").cast("double"))
    return Tables(spark, sf).orders.select("o_orderkey", key.alias("embedding_id"))


@query("F20_first_candidate", f"""
SELECT p_partkey, coalesce(CASE WHEN trim(a) <> '' AND lower(trim(a)) <> 'nan' THEN trim(a) END, CAST(p_size AS VARCHAR)) AS candidate FROM {ANNOTATION_SQL}""")
def _(spark, sf):
    return annotated(Tables(spark, sf)).select("p_partkey", fn.first_candidate(F.col("a"), F.col("p_size")).alias("candidate"))


@query("F21_one_hot", "SELECT o_orderkey, array_to_string(list_transform(range(-4, 5), lambda x: CAST(x = o_custkey % 12 - 5 AS INTEGER)), '') AS bits FROM orders")
def _(spark, sf):
    bits = fn.one_hot((F.col("o_custkey") % 12 - 5).cast("int"), -4, 4)
    text = F.array_join(F.transform(bits, lambda x: x.cast("int").cast("string")), "")
    return Tables(spark, sf).orders.select("o_orderkey", text.alias("bits"))


@query("F22_adjacency", """
SELECT l_orderkey, array_to_string(mask, '') AS mask, array_to_string(flatten(list_transform(range(1, 10), lambda i: list_transform(range(1, 10), lambda j:
  CASE WHEN mask[i] = 1 AND mask[j] = 1 AND i <> j AND (abs(i - j) = 1 OR i = 5 OR j = 5) THEN 1 ELSE 0 END))), '') AS adjacency
FROM (SELECT l_orderkey, list_transform(range(0, 9), lambda k: CAST(k <= n AS INTEGER)) AS mask FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1))""")
def _(spark, sf):
    def digits(column):
        return F.array_join(F.transform(column, lambda x: x.cast("int").cast("string")), "")

    orders = Tables(spark, sf).lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    masked = orders.withColumn("m", F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: k <= F.col("n")))
    return masked.select(
        "l_orderkey", digits(F.col("m")).alias("mask"),
        digits(F.flatten(fn.chain_star_adjacency(F.col("m"), 4))).alias("adjacency"),
    )


@query("F23_array_codec", """
SELECT vec_id, CAST(64 AS INTEGER) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total FROM embeddings""")
def _(spark, sf):
    emb = Tables(spark, sf).embeddings.withColumn("text", fn.encode_array(F.col("embedding")))
    back = emb.withColumn("back", fn.decode_array(F.col("text"), 64))
    return back.select("vec_id", F.size("back").alias("n"), F.round(fn.total(F.col("back")), 5).alias("total"))


@query("F24_feature_vector", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, printf('%.2f', l_quantity) || ',' || printf('%.2f', l_discount) || ',0.00,' || printf('%.2f', l_tax) AS vec FROM lineitem")
def _(spark, sf):
    lines = Tables(spark, sf).lineitem
    vec = fn.feature_vector(["l_quantity", "l_discount", "absent", "l_tax"], lines.columns)
    text = F.array_join(F.transform(vec, lambda x: F.format_string("%.2f", x)), ",")
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("vec"))


@query("F25_vector_validity", """
SELECT vec_id, label <> 3 AND label <> 4 AS ok FROM embeddings""")
def _(spark, sf):
    label = F.col("label")
    zeros = F.array_repeat(F.lit(0.0).cast("float"), 64)
    broken = F.transform("embedding", lambda x: F.lit(float("nan")).cast("float"))
    vec = F.when(label == 3, zeros).when(label == 4, broken).otherwise(F.col("embedding"))
    return Tables(spark, sf).embeddings.select("vec_id", fn.vector_ok(vec).alias("ok"))


@query("F26_softmax", """
SELECT vec_id, round(list_max(p), 9) AS top, round(list_sum(p), 9) AS total, round(exp(x1) / (exp(x1) + exp(x3)), 9) AS gate FROM (
  SELECT vec_id, e[1] AS x1, e[3] AS x3, list_transform(e, lambda x: exp(x - list_max(e)) / list_sum(list_transform(e, lambda y: exp(y - list_max(e))))) AS p
  FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings))""")
def _(spark, sf):
    p = fn.softmax(F.col("embedding"))
    mask = F.array(F.lit(True), F.lit(False), F.lit(True))
    gates = fn.masked_softmax(F.slice("embedding", 1, 3), mask)
    return Tables(spark, sf).embeddings.select(
        "vec_id", F.round(F.array_max(p), 9).alias("top"), F.round(fn.total(p), 9).alias("total"),
        F.round(F.get(gates, F.lit(0)), 9).alias("gate"),
    )


@query("F27_argmax", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS best FROM embeddings")
def _(spark, sf):
    return Tables(spark, sf).embeddings.select("vec_id", fn.argmax(F.col("embedding")).alias("best"))


PROBS_SQL = """p AS (SELECT vec_id, label, list_transform(e[1:10], lambda x: exp(x) / list_sum(list_transform(e[1:10], lambda y: exp(y)))) AS p3,
    list_transform(e[11:15], lambda x: exp(x) / list_sum(list_transform(e[11:15], lambda y: exp(y)))) AS p2,
    list_transform(e[16:17], lambda x: exp(x) / list_sum(list_transform(e[16:17], lambda y: exp(y)))) AS p1
  FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings))"""


def head_probs(t: Tables):
    e = F.col("embedding")
    return t.embeddings.select(
        "vec_id", "label", (F.col("label") % 5).alias("label2"), fn.softmax(F.slice(e, 1, 10)).alias("p3"),
        fn.softmax(F.slice(e, 11, 5)).alias("p2"), fn.softmax(F.slice(e, 16, 2)).alias("p1"),
    )


@query("F28_weighted_loss", f"""WITH {PROBS_SQL}, w AS (SELECT label, 500.0 / (10 * count(*)) AS w FROM embeddings GROUP BY 1),
j AS (SELECT -ln(p3[label + 1]) AS a, -ln(p2[label % 5 + 1]) AS b, w FROM p JOIN w USING (label))
SELECT round(sum(a * w) / sum(w), 6) AS loss_0, round(avg(b), 6) AS loss_1, round(sum(a * w) / sum(w) + 0.5 * avg(b), 6) AS loss_total FROM j""")
def _(spark, sf):
    t = Tables(spark, sf)
    weights = t.embeddings.groupBy("label").agg((500.0 / (10 * F.count(F.lit(1)))).alias("weight"))
    heads = [("p3", "label", weights, 1.0), ("p2", "label2", None, 0.5)]
    out = evaluation.weighted_nll(head_probs(t), heads)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("F29_hierarchy_kl", f"""WITH {PROBS_SQL}, agg AS (SELECT *,
    list_transform(range(0, 5), lambda q: greatest(p3[q + 1] + p3[q + 6], 1e-8)) AS a2,
    [greatest(p2[1] + p2[3] + p2[5], 1e-8), greatest(p2[2] + p2[4], 1e-8)] AS a1 FROM p)
SELECT round(avg(list_sum(list_transform(range(1, 6), lambda i: a2[i] * (ln(a2[i]) - ln(p2[i])))) + list_sum(list_transform(range(1, 3), lambda i: a1[i] * (ln(a1[i]) - ln(p1[i]))))), 6) AS hierarchy_kl FROM agg""")
def _(spark, sf):
    up2, up1 = [c % 5 for c in range(10)], [c % 2 for c in range(5)]
    out = evaluation.hierarchy_kl(head_probs(Tables(spark, sf)), "p1", "p2", "p3", up2, up1, 5, 2)
    return out.select(F.round("hierarchy_kl", 6).alias("hierarchy_kl"))


@query("F30_payload_records", """
SELECT event_id, CAST(CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 1 WHEN 'signup' THEN 1 WHEN 'error' THEN 0 ELSE 1 END AS INTEGER) AS records FROM events""")
def _(spark, sf):
    return payloads(Tables(spark, sf)).select("event_id", F.size(fn.flatten_payload(F.col("payload"))).alias("records"))


def payloads(t: Tables):
    """Service payloads of several shapes around each event's own JSON object."""
    kind, props = F.col("event_type"), F.col("props")
    record = F.concat(F.lit('{"uniq_id": "U'), "event_id", F.lit('", "uniprot_id": "", "genbank_id": "G'), "user_id",
                      F.lit('", "colabfold_json_pLDDT": '), "value", F.lit("}"))
    payload = (
        F.when(kind == "view", F.concat(F.lit('{"results": ['), record, F.lit(", "), props, F.lit("]}")))
        .when(kind == "click", F.concat(F.lit("["), record, F.lit(", 3]")))
        .when(kind == "signup", props)
        .when(kind == "error", F.lit('{"other": [1]}'))
        .otherwise(F.concat(F.lit('{"note": 1, "data": ['), record, F.lit("]}")))
    )
    return t.events.select("event_id", "user_id", "value", "event_type", payload.alias("payload"))


@query("F31_payload_hits", """
SELECT event_id, 'Viro3D' AS source, 'U' || event_id AS source_model_id, 'G' || user_id AS source_accession, value AS confidence_score,
  'cif' AS preferred_format, 'http://h/zip/U' || event_id || '/genbank_id/cif' AS cif_url FROM events WHERE event_type IN ('view', 'click', 'purchase')
UNION ALL SELECT event_id, 'Viro3D', NULL, NULL, NULL, 'cif', NULL FROM events WHERE event_type IN ('view', 'signup')""")
def _(spark, sf):
    records = payloads(Tables(spark, sf)).select("event_id", F.explode(fn.flatten_payload(F.col("payload"))).alias("v"))
    hits = records.select("event_id", fn.payload_to_hit(F.col("v"), "Viro3D", "http://h").alias("h"))
    return hits.select(
        "event_id", "h.source", "h.source_model_id", "h.source_accession", "h.confidence_score", "h.preferred_format", "h.cif_url"
    )


@query("F32_structure_text", """
SELECT doc_id, CASE WHEN n_chars > 1000 THEN lang = 'en' ELSE lang IN ('en', 'fr') END AS ok FROM documents""")
def _(spark, sf):
    lang = F.col("lang")
    body = F.when(lang == "en", F.concat(F.lit("\n  data_x HEADER\nATOM "), "text")).when(
        lang == "fr", F.concat(F.lit(" HEADER "), "text")
    ).otherwise(F.concat(F.lit("x "), F.regexp_replace("text", "\nATOM", "")))
    fmt = F.when(F.col("n_chars") > 1000, "CIF").otherwise("pdb")
    return Tables(spark, sf).documents.select("doc_id", fn.structure_text_ok(body, fmt).alias("ok"))


@query("F33_modality_mask", "SELECT doc_id, true AS sequence, vec_id IS NOT NULL AS structure, quality IS NOT NULL AS context FROM documents LEFT JOIN embeddings ON vec_id = doc_id LEFT JOIN labels USING (doc_id)")
def _(spark, sf):
    t = Tables(spark, sf)
    emb = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    joined = t.documents.join(emb, "doc_id", "left").join(t.labels, "doc_id", "left")
    mask = joined.select("doc_id", fn.modality_mask(F.col("text"), F.col("embedding"), F.col("quality")).alias("m"))
    return mask.select("doc_id", *[F.get("m", F.lit(i)).alias(n) for i, n in enumerate(("sequence", "structure", "context"))])


@query("F34_round6", "SELECT event_id, round(value / 7, 6) AS x FROM events")
def _(spark, sf):
    return Tables(spark, sf).events.select("event_id", fn.round6(F.col("value") / 7).alias("x"))
