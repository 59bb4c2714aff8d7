"""The operators of this folder as queries on the given tables: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orfloom.llm import langid, lattice, linededup, merkle, mixing, ngram_lm, packing, pages, partenum, quality, quotes, recount, secrets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(plan: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_secret_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


@query("op2_lattice_near_duplicates")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.vector_links(table(spark, sf_dir, "embeddings"))


@query("op3_lexical_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op4_page_differencing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"))


@query("op5_quotation_linking", quotes.SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(table(spark, sf_dir, "conversations"))


@query("op6_cross_parsing_language")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_language(table(spark, sf_dir, "documents"))


@query("op7_quality_rules")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measured(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op8_source_mixing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.calibrated(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "lang", "topic", "n_tokens", "probability", "sampled"
    )


@query("op9_ngram_jaccard_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_components(table(spark, sf_dir, "documents"))


@query("op10_trie_lm_scores")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_texts(table(spark, sf_dir, "documents"))


@query("op11_line_dedup", linededup.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op12_merkle_manifest", merkle.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = {"text": merkle.without_breaks(F.col("doc_id"), F.col("text"))}
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    return merkle.manifest(table(spark, sf_dir, "documents"), fields, shown=shown, proofs=False)


@query("op13_source_divergence", recount.SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recount.divergence_audit(table(spark, sf_dir, "documents"))
