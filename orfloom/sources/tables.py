"""Readers and writers. Schemas are always given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from orfloom import schemas
from orfloom.functions import nonblank, strip
from orfloom.operators.rollups import value_counts


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    sep: str = "\t",
    columns: list[str] | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Delimited text with a header line. Quotes inside a field are doubled.

    ``multi_line`` allows line breaks inside quoted fields, at the price that a file cannot be split.
    """
    df = (
        spark.read.schema(schema)
        .options(header=True, sep=sep, encoding="UTF-8", quote='"', escape='"', multiLine=multi_line, enforceSchema=False)
        .csv(path)
    )
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str, sep: str = "\t", mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(header=True, sep=sep, quote='"', escape='"').csv(path)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", by: str | None = None) -> None:
    writer = df.write.mode(mode).option("compression", "snappy")
    (writer.partitionBy(by) if by else writer).parquet(path)


def preview(df: DataFrame, order: str | list[str], n: int = 5) -> tuple[list[str], DataFrame]:
    keys = [order] if isinstance(order, str) else order
    return df.columns, df.orderBy(*keys).limit(n)


def write_summary(summary: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A one-record table of counts as JSON."""
    summary.coalesce(1).write.mode(mode).json(path)


def report_markdown(report: DataFrame, sections: list[str], rows_per_section: int = 100) -> str:
    """Sections of (section, value, count) as Markdown tables, most frequent values first."""
    lines = ["# Training data report"]
    for section in sections:
        part = report.where(F.col("section") == section)
        lines += [f"\n## {section}", "| value | count |", "| --- | --- |"]
        top = part.orderBy(F.desc("count"), "value").limit(rows_per_section)
        lines += [f"| {r['value']} | {r['count']} |" for r in top.collect()]
    return "\n".join(lines)


def fasta_lines(df: DataFrame, key: str, seq: str) -> DataFrame:
    """One text value per record, ``>id`` and the sequence on two lines; blank sequences are left out."""
    text = strip(F.col(seq).cast("string"))
    head = strip(F.col(key).cast("string"))
    return df.where(nonblank(text)).select(F.concat(F.lit(">"), head, F.lit("\n"), text).alias("value"))


def fasta_counts(df: DataFrame, seq: str) -> DataFrame:
    filled = nonblank(strip(F.col(seq).cast("string")))
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(filled).alias("exported_rows"),
        F.count_if(~filled).alias("blank_sequence_rows"),
    )


def export_fasta(df: DataFrame, key: str, seq: str, path: str, mode: str = "errorifexists") -> None:
    fasta_lines(df, key, seq).write.mode(mode).text(path)


def read_cluster_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(rep, member) pairs without a header; a row with fewer fields is an error."""
    return spark.read.schema(schemas.CLUSTER_PAIRS).options(sep="\t", header=False, mode="FAILFAST").csv(path)


def read_hit_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.HIT_METADATA).options(sep="\t", header=False).csv(path)


def read_hit_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.HIT_INDEX).options(sep="\t", header=False, mode="FAILFAST").csv(path)


def list_assets(spark: SparkSession, root: str, suffix: str, limit: int | None = None) -> DataFrame:
    """(path, id) of the files below ``root`` with a suffix, sorted by path; the id is the file stem."""
    ext = suffix.lower().lstrip(".")
    files = (
        spark.read.format("binaryFile")
        .options(recursiveFileLookup=True, pathGlobFilter=f"*.{ext}")
        .load(root)
        .select("path", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("id"))
        .orderBy("path")
    )
    return files if limit is None else files.limit(limit)


def read_texts(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """(path, text) of whole files below ``root``."""
    return (
        spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*.{suffix.lstrip('.')}")
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """(label, idx) from a JSON list (index is the position) or a JSON object (label to index)."""
    text = spark.read.text(path, wholetext=True)
    as_list = text.where(F.col("value").rlike(r"^\s*\[")).select(
        F.posexplode(F.from_json("value", "array<string>")).alias("idx", "label")
    )
    as_map = text.where(F.col("value").rlike(r"^\s*\{")).select(
        F.explode(F.from_json("value", "map<string,int>")).alias("label", "idx")
    )
    return as_list.select("label", "idx").unionByName(as_map)


def write_vocab(vocab: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Vocabulary as one JSON list in index order. A vocabulary is one class list, so it fits one row."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", "label"))), lambda e: e["label"])
    vocab.agg(F.to_json(ordered).alias("value")).write.mode(mode).text(path)


def read_optional(spark: SparkSession, path: str | None, schema: T.StructType) -> DataFrame:
    """Parquet or tab-separated table by suffix; an absent one is empty."""
    if path is not None:
        try:
            if path.lower().endswith(".parquet"):
                return spark.read.schema(schema).parquet(path)
            return read_table(spark, path, schema)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return spark.createDataFrame([], schema)


def read_runs(
    spark: SparkSession,
    root: str,
    prefix: str = "multimodal_v2",
    summary_tail: str = "summary.json",
    metrics_tail: str = "evaluation/metrics_val.json",
) -> DataFrame:
    """One row per completed run below ``root``: its summary and its validation metrics.

    Runs lacking either document are left out; absent fields get their defaults.
    """

    def documents(tail: str, schema: T.StructType) -> DataFrame:
        run = F.regexp_extract(F.col("_metadata.file_path"), rf"^(.*/{prefix}[^/]*)/", 1)
        read = spark.read.schema(schema).option("multiLine", True).json(f"{root}/{prefix}*/{tail}")
        return read.select(run.alias("run_dir"), "*")

    try:
        summary = documents(summary_tail, schemas.RUN_SUMMARY)
        metrics = documents(metrics_tail, schemas.RUN_METRICS)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no completed runs under {root}") from error
    name = F.regexp_replace(F.regexp_extract("run_dir", r"([^/]+)$", 1), f"^{prefix}_", "")
    nan = F.lit(float("nan"))
    return summary.join(metrics, "run_dir").select(
        "run_dir",
        F.coalesce("variant", name).alias("variant"),
        F.coalesce("seed", F.lit(-1)).alias("seed"),
        F.coalesce("modalities.sequence", F.lit(True)).alias("modality_sequence"),
        F.coalesce("modalities.structure", F.lit(False)).alias("modality_structure"),
        F.coalesce("modalities.context", F.lit(False)).alias("modality_context"),
        *[F.coalesce(f"{h}.macro_f1", nan).alias(f"best_val_{h}_macro_f1") for h in ("l1", "l2", "l3")],
        F.coalesce("hierarchy_violation_rate", nan).alias("hierarchy_violation_rate"),
        *[F.coalesce(f"mean_gates.{g}", nan).alias(f"mean_gate_{g}") for g in ("sequence", "structure", "context")],
        F.concat("run_dir", F.lit("/checkpoints/best.pt")).alias("checkpoint_path"),
    )


def write_packs(packs: DataFrame, path: str, overwrite: bool = False) -> None:
    """One directory per split; an existing target is an error unless ``overwrite``."""
    write_parquet(packs, path, "overwrite" if overwrite else "errorifexists", by="split")


def write_eval(root: str, tables: dict[str, DataFrame], overwrite: bool = False) -> None:
    """Predictions, confusion, gates and metrics of an evaluation as CSV below ``root``."""
    for name, table in tables.items():
        write_table(table, f"{root.rstrip('/')}/{name}", ",", "overwrite" if overwrite else "errorifexists")


def status_report(df: DataFrame, status: str = "status") -> DataFrame:
    return value_counts(df, status)
