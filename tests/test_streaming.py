"""Streams: exactly-once ingest and windowed access counts."""

from engram.memory import Memory
from engram.streaming.ingest import access_counts, ingest_stream


def test_stream_is_idempotent(spark, tmp_path):
    memory = Memory(spark, str(tmp_path / "m"))
    memory.set_model("hashing", "16")
    source = str(tmp_path / "in")
    rows = spark.createDataFrame([("alpha", "a"), ("beta", "b"), ("alpha", "c")], "text string, context string")
    for k in range(2):
        rows.write.mode("append").json(source)
        stream = spark.readStream.schema("text string, context string").json(source)
        ingest_stream(memory, stream, str(tmp_path / f"checkpoint{k}")).awaitTermination()
    assert memory.tables["content"].count() == 2


def test_access_counts(spark):
    events = spark.sql("select * from values (1L, timestamp'2024-01-01 00:10:00'), (1L, timestamp'2024-01-01 00:50:00'), (1L, timestamp'2024-01-01 01:00:00'), (2L, timestamp'2024-01-01 00:59:59') as t(hash, at)")
    found = {(r.hash, r.window.start.hour): r.n for r in access_counts(events).collect()}
    assert found == {(1, 0): 2, (1, 1): 1, (2, 0): 1}


def stream_of(spark, folder, batches, schema):
    """A file stream that meets ``batches`` one by one."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(folder)
        yield k


def test_sessions_with_late_and_repeated_rows(spark, tmp_path):
    from datetime import datetime, timedelta

    from engram.streaming.ingest import sessions

    at = lambda minutes: datetime(2024, 1, 1) + timedelta(minutes=minutes)
    batches = [
        [(1, 7, at(0)), (2, 7, at(20)), (3, 8, at(5))],
        [(2, 7, at(20)), (4, 7, at(45)), (5, 7, at(100)), (6, 8, at(10))],  # one again, one of an open session
        [(7, 8, at(400))],
        [(8, 8, at(12)), (9, 9, at(401))],  # too late for its session
        [(10, 9, at(900))],
        [(11, 9, at(901))],
    ]
    schema, folder, out = "id long, hash long, at timestamp", str(tmp_path / "in"), str(tmp_path / "out")
    for _ in stream_of(spark, folder, batches, schema):
        found = sessions(spark.readStream.schema(schema).json(folder))
        found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", out).trigger(availableNow=True).start().awaitTermination()
    got = {(r.hash, r.first.hour * 60 + r.first.minute, r.last.hour * 60 + r.last.minute, r.n) for r in spark.read.parquet(out).collect()}
    closed = {(7, 0, 45, 3), (7, 100, 100, 1), (8, 5, 10, 2), (8, 400, 400, 1), (9, 401, 401, 1)}
    assert got == closed
    flat = [r for b in batches for r in b]
    batch = {(r.hash, r.n) for r in sessions(spark.createDataFrame(flat, schema)).collect()}
    assert batch == {(7, 3), (7, 1), (8, 3), (8, 1), (9, 1), (9, 2)}


def test_a_directory_is_followed(spark, tmp_path):
    from engram.streaming.ingest import follow_directory

    memory = Memory(spark, str(tmp_path / "m"))
    memory.set_model("hashing", "16")
    root = tmp_path / "docs"
    root.mkdir()
    (root / "a.md").write_text("alpha")
    for change in (lambda: None, lambda: (root / "b.md").write_text("beta"), lambda: ((root / "a.md").unlink(), (root / "c.md").write_text("gamma"))):
        change()
        follow_directory(memory, str(root), str(tmp_path / "c"), "docs").awaitTermination()
    assert {(r.value, r.context) for r in memory.tables["content"].collect()} == {("beta", "docs"), ("gamma", "docs")}
