"""Sources, sinks, integrity errors and streams."""

import json

import pytest
from pyspark.sql import functions as F

from orfloom import plans
from orfloom import schemas
from orfloom.operators import assets, clusters, evaluation, labels, packs, quality, rollups, vectors
from orfloom.operators.ablation import ablation_report
from orfloom.sources import tables as io
from orfloom.streaming.incremental import dedup_stream, read_files, run_available


def test_required_columns(spark):
    df = spark.createDataFrame([(1,)], "protein_id int")
    with pytest.raises(ValueError, match="genome_id"):
        labels.standardize(df, {})
    with pytest.raises(ValueError, match="key column"):
        labels.overlay(df, spark.createDataFrame([(1,)], "x int"), "protein_id", ["a"])
    assert quality.missing_columns(df, ["a", "protein_id"]) == ["a"]


def test_integrity_errors(spark):
    twice = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    with pytest.raises(ValueError, match="duplicate keys"):
        quality.require_unique(twice, ["k"])
    exact = spark.createDataFrame([("r1", "m1"), ("r2", "m2")], schemas.CLUSTER_PAIRS)
    upper = spark.createDataFrame([("h", "r1")], schemas.CLUSTER_PAIRS)
    with pytest.raises(ValueError, match="r2"):
        clusters.compose_clusters(exact, upper)
    with pytest.raises(ValueError, match="1 rows lack"):
        clusters.attach_membership(
            spark.createDataFrame([("a",), ("b",)], "p string"), spark.createDataFrame([("a", "c")], "p string, cl string"), "p", "cl"
        )
    with pytest.raises(ValueError, match="more than one"):
        rollups.hierarchy_map(spark.createDataFrame([("c", "p"), ("c", "q")], "child string, parent string"), "child", "parent")
    emb = spark.createDataFrame([(1, [0.5])], "k int, v array<float>")
    with pytest.raises(ValueError, match="filled 2/3"):
        vectors.attach_embedding(twice, emb, "k")
    with pytest.raises(ValueError, match="contract violated"):
        quality.require_dims(emb, {"v": 2})


def test_parts_with_two_types_conflict(spark):
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    with pytest.raises(ValueError):
        rollups.hierarchy_map(part, "p_brand", "p_type")


def test_delimited_round_trip_and_bom(spark, tmp_path):
    df = spark.createDataFrame([("a\tb", 'say "x"', 1), ("NA", None, 2)], "s string, t string, n int")
    io.write_table(df, f"{tmp_path}/t")
    assert sorted(map(str, io.read_table(spark, f"{tmp_path}/t", df.schema).collect())) == sorted(map(str, df.collect()))
    with pytest.raises(Exception, match="(?i)already exists"):
        io.write_table(df, f"{tmp_path}/t")
    lines = spark.createDataFrame([("a\nb", 1), ("c", 2)], "s string, n int")
    io.write_table(lines, f"{tmp_path}/m")
    assert {r.s for r in io.read_table(spark, f"{tmp_path}/m", lines.schema, multi_line=True).collect()} == {"a\nb", "c"}
    (tmp_path / "bom.csv").write_bytes("﻿s,n\nx,1\n".encode())
    assert io.read_table(spark, f"{tmp_path}/bom.csv", "s string, n int", ",").collect() == [("x", 1)]


def test_short_cluster_rows_fail(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("r\tm\nonly\n")
    with pytest.raises(Exception):
        io.read_cluster_tsv(spark, f"{tmp_path}/c.tsv").collect()


def test_optional_source(spark, tmp_path):
    assert io.read_optional(spark, None, schemas.HINTS).count() == 0
    assert io.read_optional(spark, f"{tmp_path}/none.tsv", schemas.HINTS).count() == 0
    (tmp_path / "h.tsv").write_text("\t".join(schemas.HINTS.names) + "\nr1\tP12345\t\t\t\t\n")
    assert io.read_optional(spark, f"{tmp_path}/h.tsv", schemas.HINTS).first().candidate_uniprot_accession == "P12345"


def test_runs_and_ablation(spark, tmp_path):
    def run(name, seed, variant, f1, metrics=True):
        root = tmp_path / f"multimodal_v2_{name}"
        (root / "evaluation").mkdir(parents=True)
        summary = {"seed": seed} if variant is None else {"seed": seed, "variant": variant}
        (root / "summary.json").write_text(json.dumps(summary, indent=1))
        if metrics:
            (root / "evaluation" / "metrics_val.json").write_text(json.dumps({"l3": {"macro_f1": f1}}, indent=1))

    # three seeds of a baseline and of a variant whose gains are .0058, .0037 and .0090
    for seed, base, gain in ((42, 0.9592, 0.0058), (52, 0.9671, 0.0037), (62, 0.9553, 0.0090)):
        run(f"base{seed}", seed, "seq_only", base)
        run(f"str{seed}", seed, "seq_str", base + gain)
    run("other", 42, None, 0.5)
    run("broken", 1, "seq_only", 0, metrics=False)
    runs = io.read_runs(spark, str(tmp_path))
    assert runs.count() == 7
    report = {(r.variant, r.seed): r for r in ablation_report(runs).collect()}
    assert report["seq_str", 42].stability_label == "weak_or_unstable_gain"
    assert abs(report["seq_str", 62].relative_to_seq_only_l3 - 0.0090) < 1e-9
    assert report["seq_only", 42].stability_label == "baseline"
    assert report["other", 42].stability_label == "insufficient_seeds"
    with pytest.raises(FileNotFoundError):
        io.read_runs(spark, f"{tmp_path}/nothing")


def test_vocab_files(spark, tmp_path):
    (tmp_path / "list.json").write_text('[\n "b",\n "a"\n]')
    (tmp_path / "dict.json").write_text('{"x": 3, "y": 1}')
    assert {tuple(r) for r in io.read_vocab(spark, f"{tmp_path}/list.json").collect()} == {("b", 0), ("a", 1)}
    assert {tuple(r) for r in io.read_vocab(spark, f"{tmp_path}/dict.json").collect()} == {("x", 3), ("y", 1)}


def test_assets_on_disk(spark, tmp_path):
    for name, text in (("x/p1.pdb", "HEADER"), ("y/z/p2.pdb", "<html>"), ("y/p3.cif", "data_")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    assert [r.id for r in io.list_assets(spark, str(tmp_path), "pdb").collect()] == ["p1", "p2"]
    files = io.read_texts(spark, str(tmp_path), ".pdb").withColumn("output_relpath", F.regexp_extract("path", r"([^/]+)$", 1))
    manifest = spark.createDataFrame([(f"p{i}.pdb", "pdb") for i in (1, 2, 4)], "output_relpath string, preferred_format string")
    state = {r.output_relpath: r.state for r in assets.reconcile_assets(manifest, files).collect()}
    assert state == {"p1.pdb": "existing", "p2.pdb": "to_fetch", "p4.pdb": "to_fetch"}


def test_packs_refuse_overwrite(spark, tmp_path):
    df = spark.createDataFrame([("train", 1), ("val", 2)], "split string, x int")
    io.write_packs(df, f"{tmp_path}/p")
    with pytest.raises(Exception, match="(?i)already exists"):
        io.write_packs(df, f"{tmp_path}/p")
    io.write_packs(df, f"{tmp_path}/p", overwrite=True)
    assert io.read_parquet(spark, f"{tmp_path}/p").count() == 2


def test_canonical_order(spark):
    hits = spark.createDataFrame(
        [("r", "BFVD", "9", "99", 1), ("r", "AFDB", "1", "x", 2), ("r", "AFDB", "2", "10", 3), ("r", "AFDB", "2", "80", 4), ("s", "Else", None, None, 5)],
        "exact_sequence_rep_id string, source string, source_version string, confidence_score string, n int",
    )
    best = {r.exact_sequence_rep_id: r.n for r in assets.canonical(hits, [F.col("n")]).collect()}
    assert best == {"r": 4, "s": 5}


def test_hits_by_model_or_accession(spark):
    meta = spark.createDataFrame(
        [("A", "m1", 1.0, 1), ("B", "m1", 2.0, 2), ("m1", "m2", 3.0, 3)], "accession string, model_id string, confidence_score double, line int"
    )
    targets = spark.createDataFrame([("r1", "m1"), ("r2", "A"), ("r3", "zz")], "exact_sequence_rep_id string, query_id string")
    index = spark.createDataFrame([("m1", 0, 5)], schemas.HIT_INDEX)
    # m1 matches its last metadata row by model and m2's row by accession; m2 has no byte range
    found = {(r.exact_sequence_rep_id, r.model_id, r.confidence_score) for r in assets.hit_matches(targets, meta, "line").collect()}
    assert found == {("r1", "m1", 2.0), ("r1", "m2", 3.0), ("r2", "m1", 1.0)}
    assert assets.lookup_hits(targets, meta, index, "line").count() == 2
    log = assets.query_log(targets, assets.hit_matches(targets, meta, "line"), "BFVD")
    assert {r.query_id: r.status for r in log.collect()} == {"m1": "hit", "A": "hit", "zz": "miss"}


def test_hierarchy_violations_with_nothing_checked(spark):
    preds = spark.createDataFrame([(0, 0, 0)], "a int, b int, c int")
    none = spark.createDataFrame([(0, -1)], "child int, parent int")
    out = evaluation.hierarchy_violation_rate(preds, "a", "b", "c", none, none).first()
    assert (out.checked, out.violation_rate) == (0, 0.0)


def test_long_rows_are_all_filled_labels(spark):
    rows = [("p1", " a ", "b", "yes"), ("p2", None, "b", "no"), ("p3", "", " ", "yes")]
    wide = spark.createDataFrame(rows, "protein_id string, node_primary string, secondary_node string, multi_label_flag string").withColumns(
        {c: F.lit("x") for c in ("level1_label", "level2_label", "secondary_level1", "secondary_level2", "status")}
    )
    assert {(r.protein_id, r.node_name, r.label_role) for r in labels.to_long(wide).collect()} == {
        ("p1", "a", "primary"), ("p1", "b", "secondary"), ("p2", "b", "secondary")
    }
    assert labels.to_long(wide, strict=True).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(300).select((F.col("id") % 40).alias("k"))
    rows.repartition(5).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        stream = read_files(spark, f"{tmp_path}/in", rows.schema, files_per_batch=2)
        run_available(dedup_stream(stream, ["k"]), f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(40))


def test_multimodal_pack_needs_every_sequence_vector(spark):
    index = spark.createDataFrame(
        [("p1", "e1", "k1", "train", "trainable_core", "a", "b", "c"), ("p2", "e2", "k2", "val", "trainable_core", "a", "b", "c")],
        "protein_id string, embedding_id string, sequence_embedding_key string, split string, status string, level1_label string, level2_label string, node_primary string",
    )
    vocabs = {c: spark.createDataFrame([(v, 0)], "label string, idx int") for c, v in (("level1_label", "a"), ("level2_label", "b"), ("node_primary", "c"))}
    half = spark.createDataFrame([("k1", [1.0])], "sequence_embedding_key string, v array<float>")
    with pytest.raises(ValueError, match="filled 1/2"):
        packs.multimodal_pack(index, half, vocabs)
    both = half.unionByName(spark.createDataFrame([("k2", [2.0])], half.schema))
    pack = packs.multimodal_pack(index, both, vocabs, structure=half, structure_dim=1)
    assert {r.protein_id: (r.modality_mask, r.structure_embedding, r.row_index) for r in pack.collect()} == {
        "p1": ([True, True, False], [1.0], 0), "p2": ([True, False, False], [0.0], 0)
    }
    assert packs.core_pack(index, half, vocabs).count() == 1


def test_manifest_finds_planted_violations(spark):
    from pyspark.sql import functions as F

    from orfloom.operators import quality

    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "c")], "k int, v string")
    swapped, fewer = left.orderBy(F.desc("v")).repartition(3), left.where("v <> 'a'")
    doubled = left.where("k = 2").limit(1).unionByName(left.where("k is null or k = 1")).unionByName(left.where("k = 1"))
    found = quality.check_manifest(
        left, {"known": F.col("k").isNotNull()}, {"size": (left.select("v").distinct(), 5), "fits": (left.select("v").distinct(), 3)},
        {"same": (left, swapped, "k"), "fewer": (left, fewer, "k"), "doubled": (left, doubled, ["k", "v"]), "empty": (left.limit(0), left.limit(0), "k")},
    )
    assert {r.rule: r.violations for r in found.collect()} == {
        "known": 1, "size": 2, "fits": 0, "same": 0, "fewer": 1, "doubled": 1, "empty": 0,
    }
    shares = {r.split: (r.rows, r.share) for r in quality.ratio_report(left, "v", {"a": 0.5, "z": 0.5}).collect()}
    assert shares == {"a": (1, 0.25), "z": (0, 0.0)}
    report = {r.column: (r.present, r.filled) for r in quality.column_report(left, ["k", "v", "w"]).collect()}
    assert report == {"k": (True, 3), "v": (True, 4), "w": (False, 0)}


def test_hit_summary_and_log_without_pairs(spark):
    meta = spark.createDataFrame(
        [("A", "m1", 1.0, 1), ("B", "m1", 2.0, 2), ("m1", "m2", 3.0, 3), ("A", "m1", 1.0, 4), (None, "m3", 1.0, 5)],
        "accession string, model_id string, confidence_score double, line int",
    )
    rows = [("r1", "m1"), ("r2", "A"), ("r2", "A"), ("r3", "zz"), ("r4", None), ("r5", "m2"), ("r6", "m3")]
    targets = spark.createDataFrame(rows, "exact_sequence_rep_id string, query_id string")
    index = spark.createDataFrame([("m1", 0, 5), ("m1", 9, 5), ("m3", 1, 1)], schemas.HIT_INDEX)
    hits = assets.lookup_hits(targets, meta, index, "line").withColumn("source", F.lit("BFVD"))
    log = assets.query_log(targets, assets.hit_matches(targets, meta, "line"), "BFVD")
    slim = targets.join(assets.hit_counts(meta, index, "line"), "query_id").withColumn("source", F.lit("BFVD"))
    slim_log = assets.query_log(targets, assets.matched_ids(meta), "BFVD")
    assert slim.count() < hits.count()
    assert assets.screen_summary(slim, slim_log, "n").collect() == assets.screen_summary(hits, log).collect()
    assert sorted(map(str, slim_log.collect())) == sorted(map(str, log.collect()))


def test_eval_exports_hold_the_whole_matrix(spark):
    plans.load()
    rows = plans.QUERIES["S19_eval_exports"](spark, "/root/testdata/sf0.001").collect()
    classes = {r.target for r in rows if r.export == "classes"}
    cells = {(r.target, r.pred): r.n for r in rows if r.export == "confusion"}
    assert set(cells) == {(a, b) for a in classes for b in classes} and 0 in cells.values()


def test_small_shards_share_files(spark, tmp_path):
    cols = "embedding_id long, shard_no int, row_index int, orig_seq_len int, effective_seq_len int, truncated_flag boolean, embedding array<float>"
    places = [(s, r) for s in range(10) for r in range(1 if s == 9 else 4)]
    rows = [(100 - i, s, r, i, i, False, [float(i)]) for i, (s, r) in enumerate(places)]
    df = spark.createDataFrame(rows, cols).repartition(5)
    for per_file, files in ((4, 3), (1, 10)):
        path = f"{tmp_path}/{per_file}"
        vectors.write_shards(df, path, per_file)
        assert spark.read.parquet(path).select("_metadata.file_path").distinct().count() == files
        found = {(r.embedding_id, r.shard_no, r.row_index, r.shard_name) for r in vectors.stored_index(spark, path).collect()}
        assert found == {(r[0], r[1], r[2], f"shard_{r[1]:05d}") for r in rows}


def test_texts_are_dealt_to_the_encoder(spark):
    def where(batches):
        from pyspark import TaskContext

        for batch in batches:
            yield batch.drop(columns=["text"]).assign(vec=[[1.0 + TaskContext.get().partitionId()]] * len(batch))

    docs = spark.range(400).select("id", F.concat(F.lit("ACDEFG"), "id", F.repeat(F.md5(F.col("id").cast("string")), 600)).alias("s"))
    out = vectors.vectorize(docs.coalesce(1), "id", "s", where, strategy="truncate")
    assert out.select("embedding").distinct().count() > 1


def test_ranges_are_looked_up_before_the_pairs_are_made(spark, monkeypatch):
    """Rows without a range make no pair, and a pair needs no lookup of its own."""
    made = []
    real = assets.pairs_join
    monkeypatch.setattr(assets, "pairs_join", lambda left, right, on: made.append(right) or real(left, right, on))
    targets = spark.createDataFrame([(i, "A1") for i in range(50)] + [(99, None), (50, "M3")], "exact_sequence_rep_id int, query_id string")
    meta = spark.createDataFrame([("A1", f"M{i}", float(i), i) for i in range(40)], "accession string, model_id string, confidence_score double, line int")
    index = spark.createDataFrame([("M3", 30, 3), ("M7", 70, 7), ("M7", 71, 7)], "model_id string, range_offset int, range_length int")
    hits = assets.lookup_hits(targets, meta, index, "line")
    assert [r.count() for r in made] == [3] and "range_offset" in made[0].columns
    got = {(r.exact_sequence_rep_id, r.query_id, r.model_id, r.confidence_score, r.range_offset) for r in hits.collect()}
    ranges = [("M3", 3.0, 30), ("M7", 7.0, 70), ("M7", 7.0, 71)]
    assert got == {(i, "A1", *r) for i in range(50) for r in ranges} | {(50, "M3", "M3", 3.0, 30)} and hits.count() == 151
