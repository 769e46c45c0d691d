"""Flush by size, compaction when due, split outputs, removal of files; routed stores; a node's kept log."""

import logging
import os

import pytest
from pyspark.errors import PySparkException

from keystate.cluster import Replica, RoutedStores
from keystate.config import Config
from keystate.engine import KeyState
from keystate.operators import replog, ring
from keystate.schema import DELETE, PUT, NotLeaderError
from keystate.sources import files
from keystate.sources.manifest import Manifest, ManifestStore

SMALL = Config(memtable_bytes=2_000, output_bytes=3_000, l0_trigger=2)


def items(a, b, tag="v"):
    return [(f"key-{i:06d}".encode(), f"{tag}-{i:06d}".encode()) for i in range(a, b)]


def test_flush_and_compaction_by_size(spark, tmp_path):
    store = KeyState(spark, str(tmp_path), SMALL)
    store.batch_put(items(0, 20))
    assert store._manifest().segments and not store._manifest().runs
    store.batch_put(items(20, 100))
    m = store._manifest()
    assert not m.segments and m.log_bytes == 0 and [r.level for r in m.runs] == [0]
    store.batch_put(items(50, 150, "w"))  # the second run of level 0: compaction is due, its output is split
    m = store._manifest()
    assert [r.level for r in m.level(1)] == [1] * len(m.level(1)) and len(m.level(1)) >= 2 and not m.level(0)
    spans = [(r.min_key, r.max_key) for r in m.level(1)]
    assert spans == sorted(spans) and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert sum(r.entries for r in m.runs) == 150 and all(r.bytes < 2 * SMALL.output_bytes for r in m.runs)
    assert store.get(b"key-000060") == (b"w-000060", True) and store.get(b"key-000010") == (b"v-000010", True)
    again = KeyState(spark, str(tmp_path), SMALL)
    assert again.state().count() == 150


def test_purge_leaves_what_the_present_version_names(spark, tmp_path):
    store = KeyState(spark, str(tmp_path), SMALL)
    for tag in "abc":
        store.batch_put(items(0, 80, tag))
    os.makedirs(tmp_path / "log" / "orphan")
    (tmp_path / "log" / "orphan" / "part-0.parquet").write_bytes(b"left by a writer that failed")
    before = sorted((bytes(r["key"]), bytes(r["value"])) for r in store.state().collect())
    assert store.purge() > 3
    assert sorted((bytes(r["key"]), bytes(r["value"])) for r in store.state().collect()) == before == items(0, 80, "c")
    assert not os.path.exists(tmp_path / "log" / "orphan") and store.purge() == 0
    store.put(b"key-x", b"1")
    assert store.get(b"key-x") == (b"1", True)


def test_calls_are_logged(spark, tmp_path, caplog):
    store = KeyState(spark, str(tmp_path), Config(log_level="INFO"))
    with caplog.at_level(logging.INFO, "keystate"):
        store.put(b"k", b"v")
        with pytest.raises(ValueError):
            store.put(b"", b"v")
    assert any("put took" in r.message for r in caplog.records) and any("put failed" in r.message for r in caplog.records)


def test_two_writers_never_both_win(spark, tmp_path):
    a, b = ManifestStore(spark, str(tmp_path)), ManifestStore(spark, str(tmp_path))
    a.publish(Manifest(version=1, next_seq=5))
    with pytest.raises(RuntimeError):
        b.publish(Manifest(version=1, next_seq=9))
    assert b.latest().next_seq == 5 and not [n for n in os.listdir(tmp_path / "manifest") if n.startswith(".") and not n.endswith(".crc")]


def test_run_files_are_in_key_order(spark, tmp_path):
    rows = [("r", f"k{i * 37 % 500:04d}".encode(), b"v" * 30, False) for i in range(500)]
    df = spark.createDataFrame(rows, "name string, key binary, value binary, tombstone boolean").repartition(4)
    files.write_files(df, str(tmp_path), "run")
    image = (tmp_path / "r").read_bytes()
    assert all(files.run_get(image, k) == (b"v" * 30, False) for _, k, _, _ in rows)
    with pytest.raises(ValueError):
        files.write_files(df, str(tmp_path), "log")


def test_routed_stores(spark, tmp_path):
    registry = ring.Registry("n1")
    for n in ("n1", "n2"):
        registry.add(n)
    cluster = RoutedStores(registry, {n: KeyState(spark, str(tmp_path / n)) for n in ("n1", "n2")})
    rows = [(k, v, PUT, i) for i, (k, v) in enumerate(items(0, 30))]
    cluster.write(spark.createDataFrame(rows, "key binary, value binary, op byte, pos long"))
    for k, v in items(0, 30)[:3]:
        assert cluster.get(k) == (v, True) == cluster.stores[registry.node_of(k)].get(k)
    cluster.delete(b"key-000001")
    assert cluster.batch_get([b"key-000001", b"key-000002", b"key-000001"]) == [(b"key-000001", None, False), (b"key-000002", b"v-000002", True), (b"key-000001", None, False)]
    assert cluster.state().count() == 29 and {r["node"] for r in cluster.state().collect()} == {"n1", "n2"}
    with pytest.raises(PySparkException):
        ring.route(spark.createDataFrame([(None,)], "key binary"), registry.ring).collect()


def test_replica_keeps_its_log_and_snapshot(spark, tmp_path):
    node = Replica(spark, str(tmp_path / "a"), "a", snapshot_entries=3)
    with pytest.raises(NotLeaderError):
        node.submit([(PUT, b"k", b"v")])
    node.become(2, "a")
    assert node.submit([(PUT, b"x", b"1"), (PUT, b"y", b"2")]) == 2 and node.state().count() == 0
    node.committed(2)
    assert node.submit([(DELETE, b"x", None), (PUT, b"z", b"3"), (PUT, b"y", b"4")]) == 5
    node.committed(4)  # over three entries: a snapshot
    again = Replica(spark, str(tmp_path / "a"), "a", snapshot_entries=3)
    assert (again.term, again.commit, again.snapshot["index"], again.tail()) == (2, 4, 4, (5, 2))
    state = lambda n: {bytes(r["key"]): bytes(r["value"]) for r in n.state().collect()}
    assert state(again) == {b"y": b"2", b"z": b"3"} and [r["index"] for r in again.log().collect()] == [5]
    again.committed(5)
    assert state(again) == {b"y": b"4", b"z": b"3"}

    follower = Replica(spark, str(tmp_path / "b"), "b")
    assert not follower.vote(1, "a", 0, 0) or follower.term == 1
    assert follower.vote(2, "a", 5, 2) and not follower.vote(2, "c", 9, 9)
    assert Replica(spark, str(tmp_path / "b"), "b").voted_for == "a"
    assert not follower.follow(again.log(), 4, 2)  # it lacks entry 4
    follower.install(again.snapshot)
    assert follower.follow(again.log(), 4, 2)
    follower.committed(5)
    assert state(follower) == state(again)


def test_unknown_commands_are_errors(spark):
    log = spark.createDataFrame([(1, 1, "k", 0, "a"), (2, 1, "k", 7, "b")], "index long, term long, key string, op int, value string")
    with pytest.raises(PySparkException, match="unknown command"):
        replog.apply(log, replog.F.lit(2)).collect()
    assert replog.apply(log, replog.F.lit(1)).count() == 1
