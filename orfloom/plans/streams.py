"""Streaming plans: tables rewritten as several files, read back as a stream until nothing is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from orfloom.plans.registry import Tables, query
from orfloom.session import scratch_dir
from orfloom.streaming.firsts import first_by_time, read_firsts, run_first_by_time
from orfloom.streaming.incremental import dedup_stream, read_files, run_available


@query("R01_stream_dedup", "SELECT DISTINCT md5(text) AS digest, length(text)::INTEGER AS n FROM documents")
def _(spark, sf):
    root = scratch_dir(spark, "stream-docs")
    docs = Tables(spark, sf).documents.select("doc_id", F.md5("text").alias("digest"), F.length("text").alias("n"))
    docs.repartition(4, "doc_id").write.parquet(f"{root}/in")
    stream = read_files(spark, f"{root}/in", docs.schema, files_per_batch=2)
    run_available(dedup_stream(stream.select("digest", "n"), ["digest"]), f"{root}/out", f"{root}/state")
    return spark.read.parquet(f"{root}/out")


@query("R01_stream_dedup_bounded", "SELECT DISTINCT event_id, user_id FROM events")
def _(spark, sf):
    root = scratch_dir(spark, "stream-events")
    events = Tables(spark, sf).events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    # every event arrives twice within the watermark
    events.unionByName(events).repartition(2, "event_id").write.parquet(f"{root}/in")
    stream = read_files(spark, f"{root}/in", events.schema)
    unique = dedup_stream(stream, ["event_id"], "ts", "1 hour").select("event_id", "user_id")
    run_available(unique, f"{root}/out", f"{root}/state")
    return spark.read.parquet(f"{root}/out")


@query("R02_stream_resume", "SELECT event_id, event_type FROM events")
def _(spark, sf):
    root = scratch_dir(spark, "stream-resume")
    events = Tables(spark, sf).events.select("event_id", "event_type")
    early = F.col("event_type").isin("view", "click")
    for part in (early, ~early):
        events.where(part).write.mode("append").parquet(f"{root}/in")
        stream = read_files(spark, f"{root}/in", events.schema)
        run_available(stream, f"{root}/out", f"{root}/state")
    return spark.read.parquet(f"{root}/out")


def _feed_firsts(spark, root, chunks, keys, time, delay, order):
    """Each chunk arrives as all the files its tasks write, and a run takes them as one batch; the next run goes on from its state."""
    for chunk in chunks:
        chunk.write.mode("append").parquet(f"{root}/in")
        stream = read_files(spark, f"{root}/in", chunk.schema)
        run_first_by_time(first_by_time(stream, keys, time, delay, order), f"{root}/out", f"{root}/state")


# events arrive in weekly-sized batches; every 7th comes one batch late, every 11th two; the watermark of a batch is three
# days behind the newest event of the earlier ones
@query("R01_stream_first_by_time", """
WITH arriving AS (SELECT user_id, event_type, ts, event_id, value,
    datediff('day', DATE '2024-01-01', ts::DATE) // 8 + CASE WHEN event_id % 11 = 0 THEN 2 WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS batch
  FROM events),
marks AS (SELECT batch, max(max(epoch_ms(ts))) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 259200000 AS mark
  FROM arriving GROUP BY batch),
judged AS (SELECT *, epoch_us(ts) < coalesce(mark, 0) * 1000 AS late FROM arriving JOIN marks USING (batch)),
placed AS (SELECT *, row_number() OVER (PARTITION BY late, user_id, event_type ORDER BY ts, event_id) AS rn FROM judged)
SELECT user_id, event_type, event_id, value, late FROM placed WHERE late OR rn = 1""")
def _(spark, sf):
    root = scratch_dir(spark, "stream-firsts")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    wait = F.when(F.col("event_id") % 11 == 0, 2).when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    events = Tables(spark, sf).events.select(
        "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value",
        (F.floor(day / 8) + wait).alias("batch"),
    )
    batches = sorted(r[0] for r in events.select("batch").distinct().collect())
    beat = events.agg((F.max("ts") + F.expr("INTERVAL 10 DAYS")).alias("ts")).select(
        F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("string").alias("event_type"), "ts",
        F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("double").alias("value"),
    )
    chunks = [events.where(F.col("batch") == batch).drop("batch") for batch in batches]
    _feed_firsts(spark, root, [*chunks, beat], ["user_id", "event_type"], "ts", "3 days", ["event_id"])
    return read_firsts(spark, f"{root}/out").select("user_id", "event_type", "event_id", "value", "late")


# chunks in id order, as the batch job reads them: the first occurrence of every text with its payload
@query("R01_stream_first_occurrence", """
SELECT md5(text) AS digest, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    root = scratch_dir(spark, "stream-occurrences")
    docs = Tables(spark, sf).documents.where("text is not null").select(
        F.md5("text").alias("digest"), "doc_id", "source", F.timestamp_seconds("doc_id").alias("read_at")
    )
    top = (docs.agg(F.max("doc_id")).first()[0] or 0) + 1
    chunks = [docs.where((F.col("doc_id") >= top * c // 3) & (F.col("doc_id") < top * (c + 1) // 3)) for c in range(3)]
    beat = spark.createDataFrame([(None, None, None, top + 10)], "digest string, doc_id long, source string, s long").select(
        "digest", "doc_id", "source", F.timestamp_seconds("s").alias("read_at")
    )
    _feed_firsts(spark, root, [*chunks, beat], ["digest"], "read_at", "0 seconds", ["doc_id"])
    return read_firsts(spark, f"{root}/out").where("not late").select("digest", "doc_id", "source")
