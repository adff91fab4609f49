from __future__ import annotations

import time

from pyspark.sql import functions as F

from loomfield.streaming import events as E

DATA = "/root/testdata/sf0.001"


def stream(spark, tmp_path):
    rows = spark.read.parquet(f"{DATA}/events.parquet")
    rows.write.mode("overwrite").parquet(str(tmp_path / "in"))
    return rows, spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))


def run(frame, mode, name, tmp_path):
    q = frame.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
    q.awaitTermination()
    return frame.sparkSession.table(name)


def test_complete_stream_equals_batch(spark, tmp_path):
    rows, s = stream(spark, tmp_path)
    batch = {(r["start"], r["event_type"]): r["n"] for r in E.tumbling(rows).collect()}
    got = {(r["start"], r["event_type"]): r["n"] for r in run(E.tumbling(s), "complete", "tumbling", tmp_path).collect()}
    assert got == batch
    assert sum(r["n"] for r in E.session_counts(rows).collect()) == rows.count()


def test_closed_windows_of_append(spark, tmp_path):
    rows, s = stream(spark, tmp_path)
    batch = {(r["start"], r["event_type"]): r["n"] for r in E.tumbling(rows).collect()}
    got = {(r["start"], r["event_type"]): r["n"] for r in run(E.tumbling(s), "append", "closed", tmp_path).collect()}
    assert got and all(batch[k] == n for k, n in got.items())


def test_late_rows_are_dropped_from_closed_windows(spark, tmp_path):
    """A row that comes after its window was closed by the watermark isn't counted; one that is late but within it is."""
    from datetime import datetime

    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    # after the first file the watermark is the fourth, 10:00; Spark drops by it from the batch after the next on
    for times in (("2024-01-01T10:00:00", "2024-01-05T10:00:00"), ("2024-01-05T11:00:00",), ("2024-01-04T20:00:00", "2024-01-01T11:00:00")):
        rows = [(i, datetime.fromisoformat(t), 1, "view", 1.0, "{}") for i, t in enumerate(times)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "rows"))
        time.sleep(1.1)  # files go by the second of their writing
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "rows"))
    got = {(r["start"].day, r["n"]) for r in run(E.tumbling(s), "update", "late", tmp_path).collect()}
    assert got == {(1, 1), (5, 1), (5, 2), (4, 1)}


def test_first_sightings_by_event_time(spark, tmp_path):
    """Later batches bring earlier rows, ties, rows without a time and new keys."""
    from datetime import datetime

    at = lambda d: None if d is None else datetime(2024, 1, d)
    batches = [[(1, "a", at(9)), (2, "b", None), (3, None, at(4))], [(4, "a", at(2)), (5, "b", at(8)), (6, "c", at(7))], [(7, "a", at(5)), (8, "c", at(7)), (0, "a", at(2)), (9, None, at(3))]]
    for rows in batches:
        spark.createDataFrame(rows, "event_id bigint, k string, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(str(tmp_path / "rows"))
        time.sleep(1.1)  # files go by the second of their writing
    s = spark.readStream.schema("event_id bigint, k string, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "rows"))
    got = [tuple(r) for r in E.finished(E.first_seen(s, ["k"]), "update", f"file://{tmp_path}/first").orderBy("batch", "k").select("batch", "k", "event_id").collect()]
    assert got == [(0, None, 3), (0, "a", 1), (0, "b", 2), (1, "a", 4), (1, "b", 5), (1, "c", 6), (2, None, 9), (2, "a", 0), (2, "c", 6)]
    batch = E.first_seen(spark.read.parquet(str(tmp_path / "rows")), ["k"])
    assert {(r["k"], r["event_id"]) for r in batch.collect()} == {(None, 9), ("a", 0), ("b", 5), ("c", 6)}


def test_joined_streams_forget(spark, tmp_path):
    """Rows meet over batches while they are within the time and the watermark; what is too late meets nothing."""
    from datetime import datetime

    schema = "side string, k int, id int, ts timestamp_ntz"
    batches = [[("l", 1, 1, "2024-01-01T00:00:00"), ("l", 2, 2, "2024-01-01T00:00:00")], [("r", 1, 10, "2024-01-01T11:00:00"), ("r", 2, 11, "2024-01-01T13:00:00"), ("r", None, 12, "2024-01-01T01:00:00")], [("l", 9, 3, "2024-01-20T00:00:00"), ("r", 9, 13, "2024-01-20T00:00:00")], [("l", 5, 4, "2024-01-20T01:00:00")], [("r", 1, 14, "2024-01-01T05:00:00"), ("r", 5, 15, "2024-01-20T02:00:00")]]
    for rows in batches:
        spark.createDataFrame([(*r[:3], datetime.fromisoformat(r[3])) for r in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "rows"))
        time.sleep(1.1)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "rows"))
    of = lambda f, side: f.where(f"side = '{side}'").select("k", F.col("id").alias(side), F.col("ts").alias(f"{side}_at"))
    join = lambda f: E.joined_within(of(f, "l"), of(f, "r"), ["k"], ("l_at", "r_at"), "12 HOURS")
    got = {(r["l"], r["r"]) for r in E.finished(join(s), "append", f"file://{tmp_path}/joined").collect()}
    assert got == {(1, 10), (3, 13), (4, 15)}
    assert {(r["l"], r["r"]) for r in join(spark.read.parquet(str(tmp_path / "rows"))).collect()} == got | {(1, 14)}


def test_ingest_goes_on(spark, tmp_path):
    rows, s = stream(spark, tmp_path)
    seen = []
    for _ in range(2):  # a restart reads nothing twice
        E.ingest(s, lambda f, k: seen.append(f.count()), str(tmp_path / "ingest")).awaitTermination()
    assert sum(seen) == rows.count()
