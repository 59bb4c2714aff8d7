"""Structure coverage: targets, local files, gaps, retrieval plan, hits and the canonical choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orfloom.functions import (
    afdb_like, archive_name, clean, family_id, genbank_like, output_path, priority, seq_sha256,
    structure_text_ok, to_num, uniprot_like,
)
from orfloom.operators.labels import overlay
from orfloom.operators.ordering import keep_first
from orfloom.operators.rollups import concat_distinct, family_rollup, rollup_exact
from orfloom.operators.skew import hot_split_join, lookup_join, pairs_join

# Source preference, candidate columns, and columns of the download manifest.
SOURCE_PRIORITY = {"AFDB": 0, "BFVD": 1, "Viro3D": 2}
CANDIDATES = (
    "candidate_uniprot_accession", "candidate_afdb_entry_id", "candidate_bfvd_model_id",
    "candidate_viro3d_identifier", "candidate_viro3d_qualifier",
)
DOWNLOAD_COLUMNS = (
    "exact_sequence_rep_id", "source", "source_model_id", "expected_id", "preferred_format", "output_relpath",
    "download_mode", "cif_url", "pdb_url", "range_offset", "range_length", "compression", "confidence_score",
    "source_version",
)
REP = "exact_sequence_rep_id"


def infer_candidates(df: DataFrame, key: str = REP) -> DataFrame:
    ident = F.col(key).cast("string")
    return df.withColumns(
        {
            "candidate_uniprot_accession": uniprot_like(ident),
            "candidate_afdb_entry_id": afdb_like(ident),
            "candidate_bfvd_model_id": F.lit(None).cast("string"),
            "candidate_viro3d_identifier": genbank_like(ident),
            "candidate_viro3d_qualifier": F.when(genbank_like(ident).isNotNull(), F.lit("genbank_id")),
        }
    )


def structure_targets(
    wide: DataFrame, order: str, status: str = "trainable_core", hints: DataFrame | None = None
) -> DataFrame:
    """One target per exact group of the status: first row, candidate ids (hints win), digest, ready flag."""
    first = keep_first(wide.where(F.col("status") == status), REP, [F.col(order)])
    named = infer_candidates(first)
    if hints is not None:
        named = overlay(named, hints, REP, list(CANDIDATES))
    ready = F.coalesce(*CANDIDATES[:4]).isNotNull()
    return named.withColumns(
        {"sequence_sha256": seq_sha256(F.col("sequence")), "structure_lookup_ready": ready}
    )


def match_assets(assets: DataFrame, train: DataFrame, key: str = "protein_id") -> DataFrame:
    """Assets with their training columns and whether they match any row, and any core row."""
    joined = hot_split_join(assets, train, key, "left")
    return joined.withColumns(
        {
            "matched_any": F.col(REP).isNotNull(),
            "matched_core": F.col("status").eqNullSafe("trainable_core"),
        }
    )


def structure_status(
    wide: DataFrame, assets: DataFrame, order: Column, first: list[str], labels: list[str]
) -> DataFrame:
    """Per exact group: first values, label sets, local structure count, sources, scales and has-flag."""
    exact = rollup_exact(wide, REP, order, first, F.col("status") == "trainable_core", "split")
    sets = concat_distinct(wide, REP, labels)
    located = assets.where(F.col(REP).isNotNull())
    local = located.groupBy(REP).agg(F.count("structure_path").alias("local_structure_count")).join(
        concat_distinct(located, REP, ["source_name", "confidence_scale"])
        .withColumnsRenamed({"source_name": "local_structure_sources", "confidence_scale": "local_confidence_scales"}),
        REP,
        "left",
    )
    joined = exact.join(sets, REP, "left").join(local, REP, "left")
    filled = joined.withColumns(
        {
            **{c: F.coalesce(c, F.lit("")) for c in labels},
            "local_structure_count": F.coalesce("local_structure_count", F.lit(0)),
        }
    )
    return filled.withColumn("has_local_structure", F.col("local_structure_count") > 0)


def missing(status: DataFrame, core_only: bool = False) -> DataFrame:
    gap = status.where(~F.col("has_local_structure"))
    return gap.where("any_core") if core_only else gap


def structure_need(df: DataFrame) -> DataFrame:
    """``needs_structure`` and, for rows with a family id, ``candidate_for_search``."""
    needs = ~F.col("has_local_structure")
    return df.withColumns(
        {"needs_structure": needs, "candidate_for_search": needs & F.col("family_id").isNotNull()}
    )


def retrieval_plan(
    wide: DataFrame, local: DataFrame | None, order: Column, annotation: str = "phrog_annotation"
) -> DataFrame:
    """Per exact group: family id, archive name, local flag and whether to look in the bulk archive."""
    exact = rollup_exact(
        wide, REP, order, ["sequence_length", annotation], F.col("status") == "trainable_core", "split"
    )
    named = exact.withColumn("family_id", family_id(F.col(annotation)))
    if local is None:
        flagged = named.withColumn("has_local_structure", F.lit(False))
    else:
        joined = named.join(local.select(REP, "has_local_structure"), REP, "left")
        flagged = joined.withColumn("has_local_structure", F.coalesce("has_local_structure", F.lit(False)))
    return structure_need(flagged).withColumn("archive_name", archive_name(F.col("family_id")))


def plan_families(plan: DataFrame) -> DataFrame:
    return family_rollup(plan.where("candidate_for_search"), "family_id", "sequence_length", "any_core", "archive_name")


def reconcile(requested: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """(key, state): requested members as ``matched`` or ``missing``."""
    have = present.select(key).distinct().withColumn("__have", F.lit(True))
    joined = requested.select(key).distinct().join(have, key, "left")
    return joined.select(key, F.when(F.col("__have"), F.lit("matched")).otherwise(F.lit("missing")).alias("state"))


def reconcile_assets(manifest: DataFrame, files: DataFrame, path: str = "output_relpath") -> DataFrame:
    """Manifest rows as ``existing`` (file there and its text valid) or ``to_fetch``."""
    # the texts are judged where they are read: two booleans go through the join, not whole files
    valid = {f"__{kind}": structure_text_ok(F.col("text"), F.lit(kind)) for kind in ("cif", "pdb")}
    judged = files.where(F.col("text").isNotNull()).select(path, *[c.alias(name) for name, c in valid.items()])
    joined = manifest.join(judged, path, "left")
    is_cif = F.lower(F.coalesce(F.col("preferred_format"), F.lit(""))) == "cif"
    ok = F.when(is_cif, F.col("__cif")).otherwise(F.col("__pdb"))
    return joined.withColumn("state", F.when(ok, F.lit("existing")).otherwise(F.lit("to_fetch"))).drop(*valid)


def hit_matches(targets: DataFrame, meta: DataFrame, order: str) -> DataFrame:
    """Metadata rows whose model id or accession equals the query id; a row matching both ways comes twice.

    The OR is written as two equality joins. Of several rows with one model id the last one stands for it. Accessions repeat
    on both sides, so their pairs are dealt to tasks by number.
    """
    by_model, by_accession = _query_sides(meta, order)
    model = hot_split_join(targets, by_model, "query_id", "inner")
    accession = pairs_join(targets, by_accession, "query_id")
    return model.unionByName(accession)


def _query_sides(meta: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Metadata by query id: the last row of each model id, and all rows by their accession."""
    columns = [F.col(c) for c in meta.columns if c != order]
    by_model = keep_first(meta, "model_id", [F.desc(order)]).select(F.col("model_id").alias("query_id"), *columns)
    return by_model, meta.select(F.col("accession").alias("query_id"), *columns)


def matched_ids(meta: DataFrame) -> DataFrame:
    """The query ids that ``hit_matches`` finds, each once: for a log that needs no pairs."""
    ids = meta.select(F.explode(F.array("model_id", "accession")).alias("query_id"))
    return ids.where(F.col("query_id").isNotNull()).distinct()


def hit_counts(meta: DataFrame, index: DataFrame, order: str) -> DataFrame:
    """(query_id, n): how many rows ``lookup_hits`` gives a target with this query id, without the pairs."""
    ranges = index.groupBy("model_id").agg(F.count(F.lit(1)).alias("n"))
    by_model, by_accession = _query_sides(meta.select("model_id", "accession", order), order)
    sides = by_model.unionByName(by_accession).groupBy("query_id", "model_id").agg(F.count(F.lit(1)).alias("rows"))
    counted = lookup_join(sides, ranges, "model_id", "inner")
    return counted.groupBy("query_id").agg(F.sum(F.col("rows") * F.col("n")).alias("n"))


def lookup_hits(targets: DataFrame, meta: DataFrame, index: DataFrame, order: str) -> DataFrame:
    """Matches that also have a byte range in the archive index.

    The range belongs to the metadata row, so it is looked up once for each such row, not for each of its matches.
    """
    by_model, by_accession = [lookup_join(side, index, "model_id", "inner") for side in _query_sides(meta, order)]
    model = hot_split_join(targets, by_model, "query_id", "inner")
    return model.unionByName(pairs_join(targets, by_accession, "query_id"))


def query_log(targets: DataFrame, matches: DataFrame, source: str) -> DataFrame:
    """One line per target and source: hit or miss."""
    found = matches.select("query_id").distinct().withColumn("__hit", F.lit(True))
    joined = hot_split_join(targets, found, "query_id", "left")
    status = F.when(F.col("__hit"), F.lit("hit")).otherwise(F.lit("miss"))
    return joined.select(*targets.columns, F.lit(source).alias("source"), status.alias("status"))


def screen_summary(hits: DataFrame, log: DataFrame, count: str | None = None) -> DataFrame:
    """Hit rows, distinct hit entities and sources, and query rows; a row of ``hits`` stands for ``count`` (column) rows, or for one."""
    rows = F.count(F.lit(1)) if count is None else F.coalesce(F.sum(count), F.lit(0)).cast("long")
    counts = hits.agg(
        rows.alias("hit_rows"),
        F.count_distinct(REP).alias("hit_entities"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
    )
    queries = log.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.withColumn("query_rows", queries)


def canonical(
    hits: DataFrame, tie: list[Column], key: str = REP, order: dict[str, int] | None = None
) -> DataFrame:
    """Best hit per key: source priority, then highest version, then highest confidence, then ``tie``."""
    ranked = hits.withColumns(
        {
            "source_priority": priority(F.col("source"), order or SOURCE_PRIORITY),
            "confidence_score_num": to_num(F.col("confidence_score").cast("string")),
            "source_version_num": to_num(F.col("source_version").cast("string")),
        }
    )
    best = [F.col("source_priority"), F.desc("source_version_num"), F.desc("confidence_score_num"), *tie]
    return keep_first(ranked, key, best)


def download_manifest(chosen: DataFrame, key: str = REP) -> DataFrame:
    """Canonical hits with their output path; columns the hits lack are null."""
    named = chosen.withColumns(
        {
            "output_relpath": output_path(
                F.col("source"), F.col(key), F.col("source_model_id"), F.col("preferred_format")
            ),
            "expected_id": F.col("source_model_id"),
        }
    )
    return named.select(
        *[F.col(c) if c in named.columns else F.lit(None).cast("string").alias(c) for c in DOWNLOAD_COLUMNS]
    )


def first_source(candidates: DataFrame, key: str, source: str, cascade: list[str]) -> DataFrame:
    """Per key the first source of the cascade that offers it."""
    rank = priority(F.col(source), {name: i for i, name in enumerate(cascade)})
    known = candidates.withColumn("__rank", rank).where(F.col("__rank") < len(cascade))
    return known.groupBy(key).agg(F.min_by(source, "__rank").alias(source))


def flag_ready(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    return df.withColumn(out, F.coalesce(*[clean(F.col(c)) for c in columns]).isNotNull())
