"""The store end to end, its files, and streams into it."""

import pytest
from pyspark.sql import functions as F

from keystate.engine import KeyState
from keystate.schema import ClosedError, CorruptRecordError, EmptyKeyError
from keystate.sources import files
from keystate.streaming import stream


@pytest.fixture
def store(spark, tmp_path):
    return KeyState(spark, str(tmp_path / "store"))


def test_life_of_a_store(spark, store):
    store.put(b"user:1001", b"Alice")
    store.batch_put([(b"product:1", b"p1"), (b"product:2", b""), (b"product:3", b"p3")])
    assert store.get(b"user:1001") == (b"Alice", True) and store.get(b"nobody") == (None, False)
    store.flush()
    store.delete(b"user:1001")
    store.delete(b"never there")
    assert store.get(b"user:1001") == (None, False) and store.get(b"product:2") == (b"", True)
    assert store.batch_get([b"product:3", b"x", b"product:3"]) == [(b"product:3", b"p3", True), (b"x", None, False), (b"product:3", b"p3", True)]
    held = store.snapshot()
    store.put(b"product:1", b"new")
    assert {bytes(r["key"]): bytes(r["value"]) for r in held.collect()}[b"product:1"] == b"p1"
    store.flush()
    assert store.compact(force=True) == 1
    assert [(bytes(r["key"]), bytes(r["value"])) for r in store.scan(b"product:", b"product:~").collect()] == [(b"product:1", b"new"), (b"product:2", b""), (b"product:3", b"p3")]
    assert [bytes(r["key"]) for r in store.scan(limit=2).collect()] == [b"product:1", b"product:2"]
    again = KeyState(spark, store.folder)  # reopened
    assert again.get(b"product:1") == (b"new", True) and again.get(b"user:1001") == (None, False)
    again.view("kv")
    assert spark.sql("SELECT count(*) AS n FROM kv WHERE key LIKE 'product:%'").first()["n"] == 3
    again.close()
    with pytest.raises(ClosedError):
        again.get(b"a")


def test_bad_keys(store):
    for act in (lambda: store.put(b"", b"v"), lambda: store.get(b""), lambda: store.delete(b"")):
        with pytest.raises(EmptyKeyError):
            act()
    with pytest.raises(EmptyKeyError):
        store.batch_put([(b"kept", b"1"), (b"", b"2"), (b"lost", b"3")])
    assert store.get(b"kept") == (b"1", True) and store.get(b"lost") == (None, False)


def test_four_runs_are_due(store):
    for i in range(4):
        store.put(b"k", str(i).encode())
        store.flush()
    assert store.compaction() is not None
    assert store.compact() == 1 and store.compaction() is None
    assert store.get(b"k") == (b"3", True)


def test_binary_files(spark, tmp_path):
    items = [("one", f"key-{i:06d}".encode(), b"v" * (i % 400), i % 7 == 0) for i in range(300)] + [("two", b"only", b"", False)]
    df = spark.createDataFrame(items, "name string, key binary, value binary, tombstone boolean")
    for kind, read in (("log", files.read_log_files), ("run", files.read_run_files)):
        folder = str(tmp_path / kind)
        assert files.write_files(df, folder, kind, order="key").count() == 2
        got = sorted((r["file"].rsplit("/", 1)[-1], bytes(r["key"]), bytes(r["value"]), r["tombstone"]) for r in read(spark, folder).collect())
        assert got == sorted(items)
    image = (tmp_path / "run" / "one").read_bytes()
    assert len(files.run_index(image)) > 5
    assert files.run_get(image, b"key-000123") == (b"v" * 123, False) and files.run_get(image, b"key-000007") == (b"v" * 7, True) and files.run_get(image, b"nope") is None
    with pytest.raises(CorruptRecordError):
        files.run_index(image[:-1] + b"\xff")


def test_stream_is_ingested_once(spark, store, tmp_path):
    source = str(tmp_path / "source")
    changes = spark.range(100).select(F.concat(F.lit("k"), (F.col("id") % 10).cast("string")).cast("binary").alias("key"), F.col("id").cast("string").cast("binary").alias("value"), F.lit(0).cast("byte").alias("op"), F.col("id").alias("pos"))
    changes.coalesce(1).write.parquet(source)
    for _ in range(2):
        feed = stream.read_changes(spark, source, changes.schema)
        stream.ingest(feed, store, "feed", str(tmp_path / "checkpoint")).awaitTermination()
    assert {bytes(r["key"]): bytes(r["value"]) for r in store.state().collect()} == {f"k{i}".encode(): f"{90 + i}".encode() for i in range(10)}
    assert store.write(changes, "feed", 0) is False


def test_commands(store):
    from keystate.__main__ import run

    assert run(store, "batch-put", ["a=1", "b=x=y"]) == ["OK"]
    assert run(store, "get", ["b"]) == ["x=y"] and run(store, "get", ["zz"]) == ["(not found)"]
    run(store, "del", ["a"])
    assert run(store, "batch-get", ["b", "a"]) == ["b\tx=y", "a\t(not found)"]
    assert run(store, "scan", []) == ["b\tx=y"]


def test_config():
    from keystate.config import Config

    assert Config().validated().l0_trigger == 4
    for bad in ({"folder": ""}, {"virtual_nodes": 0}, {"level_factor": 1}, {"log_level": "LOUD"}):
        with pytest.raises(ValueError):
            Config(**bad).validated()


def test_key_ranges_reach_the_scan(store):
    store.batch_put([(f"k{i:03d}".encode(), b"v") for i in range(50)])
    store.flush()
    plan = store.scan(b"k010", b"k020")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan
    # a run outside the asked keys is not opened at all
    assert store.versions(b"x", b"z").inputFiles() == []
