"""Vectors: attach, pool, shard, and encode long sequences window by window."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orfloom.functions import (
    effective_len, is_truncated, sanitize_seq, vector_ok, windowed_text,
)
from orfloom.operators.ordering import ordered_prefix
from orfloom.operators.quality import require_covered
from orfloom.operators.skew import hot_split_join, lookup_join
from orfloom.session import cut_lineage

Encoder = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def weighted_mean_vec(df: DataFrame, key: str | list[str], vec: str, weight: Column, out: str = "mean_vec") -> DataFrame:
    """Weighted mean vector per key (weights must be positive), with map-side partial means."""
    keys = [key] if isinstance(key, str) else list(key)
    mean = Summarizer.mean(array_to_vector(F.col(vec).cast("array<double>")), weight.cast("double"))
    return df.groupBy(*keys).agg(vector_to_array(mean).alias(out))


def masked_mean_vec(df: DataFrame, key: str | list[str], vec: str, mask: Column, out: str = "mean_vec") -> DataFrame:
    return weighted_mean_vec(df.where(mask), key, vec, F.lit(1.0), out)


def attach_embedding(
    df: DataFrame,
    emb: DataFrame,
    key: str,
    required: bool = True,
    what: str = "embedding",
    hot_from: DataFrame | None = None,
) -> DataFrame:
    """Inner join on the key. ``required``: every row must resolve, else an error that says how many did."""
    if required:
        require_covered(df, emb, key, what)
    return hot_split_join(df, emb, key, "inner", hot_from=hot_from)


def attach_optional(
    df: DataFrame, emb: DataFrame, key: str, vec: str, dim: int, present: str, hot_from: DataFrame | None = None
) -> DataFrame:
    """Left join; a missing vector becomes zeros and ``present`` says whether it was there."""
    joined = hot_split_join(df, emb.select(key, vec), key, "left", hot_from=hot_from)
    zeros = F.array_repeat(F.lit(0.0), dim).cast(emb.schema[vec].dataType)
    return joined.withColumns({present: F.col(vec).isNotNull(), vec: F.coalesce(F.col(vec), zeros)})


def prefetch(features: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return features.join(keys.select(on), on, "left_semi")


def todo(df: DataFrame, done: DataFrame, on: str) -> DataFrame:
    return df.join(done.select(on), on, "left_anti")


def assign_shards(df: DataFrame, length: str, key: str, shard_rows: int = 20_000) -> DataFrame:
    """Shard number and row within the shard, in order of (length, key)."""
    placed = ordered_prefix(df, [], [length, key], position="__pos")
    return placed.withColumns(
        {
            "shard_no": F.floor(F.col("__pos") / shard_rows).cast("int"),
            "row_index": (F.col("__pos") % shard_rows).cast("int"),
        }
    ).drop("__pos")


def embedding_index(emb: DataFrame, key: str, length: str, shard_rows: int = 20_000) -> DataFrame:
    """Where each vector is stored: key, shard, row, lengths and the truncation flag, without the vectors."""
    slim = emb.select(
        F.col(key).alias("embedding_id"), F.col(length).alias("orig_seq_len"),
        F.col(length).alias("effective_seq_len"), F.lit(False).alias("truncated_flag"),
    )
    sharded = assign_shards(slim, "orig_seq_len", "embedding_id", shard_rows)
    return sharded.withColumn("shard_name", F.format_string("shard_%05d", "shard_no"))


def write_shards(vectors: DataFrame, path: str, shards_per_file: int = 1) -> None:
    """Store sharded vectors in the order of their rows; the row numbers themselves are not stored.

    A file holds ``shards_per_file`` consecutive shards: one for large shards, many for small ones, whose number would else be
    the number of files that the driver has to commit and list.
    """
    rows = vectors.withColumn("volume", F.floor(F.col("shard_no") / shards_per_file).cast("int"))
    rows = rows.repartition("volume").sortWithinPartitions("volume", "shard_no", "row_index").drop("row_index")
    rows.write.partitionBy("volume").parquet(path)


def stored_index(spark: SparkSession, path: str) -> DataFrame:
    """Where each vector lies in the shards of ``write_shards``: the row is read from the file's own metadata, counted from the
    first one of the shard, lengths and flag from its columns; the vectors are not read."""
    rows = spark.read.parquet(path).select(
        "embedding_id", "shard_no", F.col("_metadata.row_index").alias("file_row"), "orig_seq_len", "effective_seq_len", "truncated_flag",
    )
    firsts = rows.groupBy("shard_no").agg(F.min("file_row").alias("first_row"))
    return lookup_join(rows, firsts, "shard_no", "inner").select(
        "embedding_id", "shard_no", (F.col("file_row") - F.col("first_row")).cast("int").alias("row_index"),
        F.format_string("shard_%05d", F.col("shard_no")).alias("shard_name"), "orig_seq_len", "effective_seq_len", "truncated_flag",
    )


def residue_counts(dim: int) -> Encoder:
    """Stand-in encoder: counts of adjacent residue pairs in ``dim`` buckets, divided by the pair count."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = []
            for text in batch["text"]:
                codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64)
                pairs = (codes[:-1] * 31 + codes[1:]) % dim if codes.size > 1 else codes % dim
                vectors.append(np.bincount(pairs, minlength=dim) / max(pairs.size, 1))
            yield batch.drop(columns=["text"]).assign(vec=vectors)

    return encode


def valid_sequences(df: DataFrame, key: str, seq: str) -> DataFrame:
    cleaned = sanitize_seq(F.col(seq))
    return df.where(F.length(cleaned) > 0).select(F.col(key).alias("id"), cleaned.alias("sequence"))


def encode_windows(
    df: DataFrame, encoder: Encoder, size: int = 512, overlap: int = 128, strategy: str = "sliding_windows"
) -> DataFrame:
    """(id, length, window, weight, vec): windows of (id, sequence) rows through the encoder.

    Windows have one size, so the work of a task follows the residues it holds, not its longest sequence.
    """
    length = effective_len(F.length("sequence"), size, strategy)
    # Cut before exploding, so that no copy of the sequence travels with each window. The outer form keeps the
    # optimizer from adding a filter on the array's size, which would cut every sequence a second time.
    cut = df.select("id", F.length("sequence").alias("length"), windowed_text(F.col("sequence"), length, size, overlap).alias("ws"))
    rows = cut.select("id", "length", F.posexplode_outer("ws").alias("window", "z")).select("id", "length", "window", "z.weight", "z.text")
    schema = f"id {df.schema['id'].dataType.simpleString()}, length int, window int, weight int, vec array<double>"
    return rows.mapInPandas(encoder, schema)


def pool_windows(encoded: DataFrame) -> DataFrame:
    """One vector per id: coverage-weighted mean over its windows."""
    return weighted_mean_vec(encoded, ["id", "length"], "vec", F.col("weight"), "embedding")


def vectorize(
    df: DataFrame,
    key: str,
    seq: str,
    encoder: Encoder,
    size: int = 512,
    overlap: int = 128,
    strategy: str = "sliding_windows",
    done: DataFrame | None = None,
    shard_rows: int = 20_000,
) -> DataFrame:
    """Sequence table to sharded vectors; ids in ``done`` are skipped. Short sequences need no pooling shuffle.

    New shards are numbered after the highest ``shard_no`` of ``done`` (from 0 if it has no such column).
    """
    source = valid_sequences(df, key, seq)
    first_shard = 0
    if done is not None:
        source = todo(source, done, "id")
        if "shard_no" in done.columns:
            first_shard = done.agg(F.coalesce(F.max("shard_no") + 1, F.lit(0))).first()[0]
    # cleaned once and dealt evenly: the encoder's tasks would else be the splits of the input, of any number and size
    source = cut_lineage(source.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id"))
    fits = F.length("sequence") <= size
    if strategy == "truncate":
        pooled = encode_windows(source, encoder, size, overlap, strategy).select("id", "length", F.col("vec").alias("embedding"))
    else:
        short = encode_windows(source.where(fits), encoder, size, overlap).select(
            "id", "length", F.col("vec").alias("embedding")
        )
        pooled = short.unionByName(pool_windows(encode_windows(source.where(~fits), encoder, size, overlap)))
    # vectors are written once: numbering them would otherwise run the encoder again to sample the order
    good = cut_lineage(pooled.where(vector_ok(F.col("embedding"))))
    length = F.col("length")
    places = assign_shards(good.select("id", "length"), "length", "id", shard_rows).drop("length")
    return good.join(places, "id").select(
        F.col("id").alias("embedding_id"), (F.col("shard_no") + first_shard).alias("shard_no"), "row_index",
        length.alias("orig_seq_len"),
        effective_len(length, size, strategy).alias("effective_seq_len"),
        is_truncated(length, size, strategy).alias("truncated_flag"),
        F.col("embedding").cast("array<float>").alias("embedding"),
    )
