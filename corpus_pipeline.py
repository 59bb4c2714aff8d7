"""Corpus pipeline: quality rules, near-duplicate removal, secret redaction, mixing, packing.

Each stage takes what its predecessor kept, with the columns of ``documents``, and its decisions take effect:
rejected documents go, one document of each near-duplicate group stays, secrets are replaced in the text,
documents are drawn to the target weights, and the last stage packs token ids into training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orfloom.llm import mixing, packing, partenum, quality, secrets
from orfloom.operators.skew import lookup_join
from orfloom.session import cut_lineage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the divergence test."""
    return quality.passed(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts, the one with the smallest id (null last).

    A document is an id with its text: other texts under the same id, or without an id, are documents of their own and
    stay unless they are near-duplicates themselves. Of rows with equal id and text one stays. Null and empty texts link with nothing.
    """
    key = "key"
    while key in docs.columns:
        key += "_"
    again = cut_lineage(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").select("doc_id"))
    if again.isEmpty():
        found = cut_lineage(partenum.jaccard_components(docs))
        return docs.join(found.where("doc_id = component_id").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    # ids that several rows share give way to a hash of id and text
    marked = lookup_join(docs, again.withColumn(key, F.lit(True)), "doc_id", "left", null_safe=True)
    own = F.when(F.col(key), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id"))
    keyed = marked.withColumn(key, own)
    found = cut_lineage(partenum.jaccard_components(keyed.select(F.col(key).alias("doc_id"), "text")))
    ids = keyed.select(F.col(key).alias("k"), F.col("doc_id").alias("id")).distinct()
    order = F.struct(F.col("id").isNull().alias("none"), "id", "k")
    stay = found.join(ids, F.col("doc_id") == F.col("k")).groupBy("component_id").agg(F.min(order)["k"].alias(key)).select(key)
    return keyed.join(stay, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced; ``n_chars`` follows the text. A null text stays null."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with the calibrated probability of their source, language and topic; a null one is a value of its own."""
    return mixing.calibrated(docs).where("sampled").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their places in the sequences; a null text is its end token alone."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("secret_scan", secret_scan),
    ("mixing", mixture),
    ("packing", packed),
]

#: Jaccard signatures, lexing and token ids have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
