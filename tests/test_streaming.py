"""First rows by event time: several batches, late rows, ties, missing times, forgotten keys, resumed runs."""

import datetime

import pytest

from orfloom.session import scratch_dir
from orfloom.streaming.firsts import first_by_time, read_firsts, run_first_by_time
from orfloom.streaming.incremental import read_files

SCHEMA = "k string, ts timestamp, v int, note string"


def at(minutes):
    return None if minutes is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


def add(spark, root, rows):
    spark.createDataFrame([(k, at(m), v, f"n{v}") for k, m, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")


def run(spark, root, forget=None):
    stream = read_files(spark, f"{root}/in", spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
    firsts = first_by_time(stream, ["k"], "ts", "30 minutes", ["v"], forget)
    run_first_by_time(firsts, f"{root}/out", f"{root}/state")
    rows = read_firsts(spark, f"{root}/out").collect()
    assert all(r.note == f"n{r.v}" for r in rows)
    return sorted((r.k or "", r.v) for r in rows if not r.late), sorted((r.k or "", r.v) for r in rows if r.late)


@pytest.fixture(scope="module", autouse=True)
def narrow(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_first_rows_over_batches_and_a_resumed_run(spark):
    root = scratch_dir(spark, "firsts")
    add(spark, root, [("a", 10, 1), ("b", 20, 2), ("a", 5, 3)])
    add(spark, root, [("a", 4, 4), ("c", 100, 5), ("a", 4, 0)])  # earlier rows still on time; equal times take the least v
    add(spark, root, [("b", 6, 6), ("c", 90, 7), (None, 95, 8), ("d", None, 9)])  # mark 70: late, earlier, null key, no time
    first, late = run(spark, root)
    assert (first, late) == ([("a", 0), ("b", 2)], [("b", 6), ("d", 9)])  # the mark stands at 70
    add(spark, root, [("a", 500, 10), ("c", 92, 11), ("z", 1000, 12)])  # a known key again, and the row that moves the mark on
    first, late = run(spark, root)
    assert (first, late) == ([("", 8), ("a", 0), ("b", 2), ("c", 7)], [("b", 6), ("d", 9)])


def test_forgotten_keys_count_as_new(spark):
    root = scratch_dir(spark, "forgotten")
    for rows in ([("a", 0, 1)], [("z", 50, 2)], [("a", 60, 3), ("z", 300, 4)], [("a", 310, 5)], [("y", 900, 6)]):
        add(spark, root, rows)
    first, late = run(spark, root, "2 hours")
    assert first == [("a", 1), ("a", 5), ("z", 2)] and late == []


def test_a_chunk_of_several_files_is_one_batch(spark):
    from orfloom.plans.streams import _feed_firsts

    root = scratch_dir(spark, "feed-test")
    chunks = [[("a", 50, 1), ("b", 60, 2), ("a", 40, 3), ("c", 90, 4)], [("a", 10, 5), ("c", 80, 6), ("d", 95, 7)], [("z", 900, 9)]]
    frames = [spark.createDataFrame([(k, at(m), v, "") for k, m, v in c], SCHEMA).repartition(3, "v") for c in chunks]
    _feed_firsts(spark, root, frames, ["k"], "ts", "30 minutes", ["v"])
    assert spark.read.parquet(f"{root}/in").select("_metadata.file_path").distinct().count() > len(chunks)
    found = {(r.k, r.v, r.late) for r in read_firsts(spark, f"{root}/out").collect()}
    assert found == {("a", 3, False), ("b", 2, False), ("c", 6, False), ("d", 7, False), ("a", 5, True)}
