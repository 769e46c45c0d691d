"""Log, batches, runs and compaction on small logs."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from keystate.operators import folds, ingest, runs, state
from keystate.schema import CHANGE, EmptyKeyError

PUT, DEL = 0, 1


def log(spark, *changes):
    return spark.createDataFrame([(k, i, op, v) for i, (k, op, v) in enumerate(changes)], CHANGE)


def test_put_get_delete(spark):
    changes = log(spark, (b"key1", PUT, b"value1"), (b"key1", DEL, None), (b"key", PUT, b"value1"), (b"key", PUT, b"value2"), (b"empty", PUT, b""))
    asked = spark.createDataFrame([(b"key1",), (b"key",), (b"empty",), (b"none",)], "key binary")
    found = {bytes(r["key"]): (r["value"] and bytes(r["value"]), r["found"]) for r in state.get(changes, asked).collect()}
    assert found == {b"key1": (None, False), b"key": (b"value2", True), b"empty": (b"", True), b"none": (None, False)}


def test_raw_lookup_shows_tombstones(spark):
    changes = log(spark, (b"key", PUT, b"value"), (b"key", DEL, None))
    assert rows(state.raw_get(changes, changes), "found", "tombstone") == [(True, True)]


def test_order_is_unsigned_bytes(spark):
    keys = [b"\x80", b"\x00", b"", b"\xff", b"\x7f", b"a", b"ab"]
    changes = log(spark, *[(k, PUT, b"v") for k in keys])
    assert [bytes(r["key"]) for r in state.scan(state.visible_state(changes)).collect()] == sorted(keys)
    got = state.scan(state.visible_state(changes), bytearray(b"a"), bytearray(b"\x80"))
    assert [bytes(r["key"]) for r in got.collect()] == [b"a", b"ab", b"\x7f"]


@pytest.mark.parametrize(("limit", "n"), [(0, 10), (1, 1), (3, 3), (99, 10)])
def test_scan_limit(spark, limit, n):
    changes = log(spark, *[(f"key{i}".encode(), PUT, b"v") for i in range(10)])
    assert state.scan(state.visible_state(changes), limit=limit).count() == n


def test_size_counts_latest_versions(spark):
    assert state.state_size(log(spark)).first()["bytes"] == 0
    assert state.state_size(log(spark, (b"key", PUT, b"a"), (b"key", PUT, b"value"))).first()["bytes"] == 8


def test_batch_get_keeps_positions(spark):
    s = state.visible_state(log(spark, (b"a", PUT, b"1"), (b"b", PUT, b"")))
    asked = spark.createDataFrame([(0, b"b"), (1, b"x"), (2, b"b"), (3, b"a")], "pos long, key binary")
    got = sorted((r["pos"], r["value"] and bytes(r["value"]), r["found"]) for r in state.batch_get(s, asked).collect())
    assert got == [(0, b"", True), (1, None, False), (2, b"", True), (3, b"1", True)]


def test_batch_put_stops_at_the_first_bad_item(spark):
    items = spark.createDataFrame([(1, 0, b"a"), (1, 1, b""), (1, 2, b"c"), (2, 0, b"d")], "batch int, pos int, key binary")
    assert rows(ingest.batch_prefix(items, "batch", "pos", ingest.is_bad()), "batch", "pos") == [(1, 0), (2, 0)]
    with pytest.raises(EmptyKeyError):
        ingest.require_keys(items)


def test_numbering_is_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 3).alias("pos")).repartition(7)
    got = ingest.numbered(df, "pos", 11)
    assert [(r["pos"], r["seq"]) for r in got.orderBy("pos").collect()] == [(3 * i, 11 + i) for i in range(1000)]


def test_greedy_cuts(spark):
    sizes = [3, 3, 5, 10, 1, 1, 9, 2]
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate(sizes)], "g string, i int, s int")
    assert [r["cut"] for r in folds.greedy_cuts(df, ["g"], ["i"], F.col("s"), 10).orderBy("i").collect()] == [0, 0, 0, 1, 2, 2, 2, 3]
    assert [r["cut"] for r in folds.greedy_cuts(df, ["g"], ["i"], F.col("s"), 10, over=True).orderBy("i").collect()] == [0, 0, 0, 1, 1, 2, 2, 2]


def test_compaction_never_changes_reads(spark):
    """Random operations in runs of random levels, against a dictionary."""
    rnd = random.Random(7)
    for _ in range(4):
        expected, changes = {}, []
        for i in range(300):
            k = f"k{rnd.randrange(40)}".encode()
            if rnd.random() < 0.3:
                expected.pop(k, None)
                changes.append((k, i, DEL, None))
            else:
                expected[k] = str(i).encode()
                changes.append((k, i, PUT, str(i).encode()))
        cuts = sorted(rnd.sample(range(1, 300), 5))
        run = F.lit(0)
        for c in cuts:
            run = run + (F.col("seq") >= c).cast("int")
        level = F.when(F.col("seq") >= cuts[2], 0).when(F.col("seq") >= cuts[1], 1).otherwise(2)
        flat = spark.createDataFrame(changes, CHANGE)
        # one run in each deeper level
        every = runs.flush(flat, F.when(F.col("seq") >= cuts[2], run).when(F.col("seq") >= cuts[1], 1).otherwise(0), level)
        read = lambda r: {bytes(x["key"]): bytes(x["value"]) for x in runs.multi_run_get(r).collect()}
        assert read(every) == expected
        upper = runs.compact(every.where("level <= 1"), bottom=False).select(F.lit(50).alias("run"), F.lit(1).alias("level"), "key", "seq", "op", "value")
        assert read(upper.unionByName(every.where("level = 2"))) == expected
        bottom = runs.compact(every, bottom=True)
        assert {bytes(x["key"]): bytes(x["value"]) for x in bottom.collect()} == expected


def test_dropping_tombstones_early_would_undo_deletes(spark):
    every = spark.createDataFrame([(2, 1, b"k", 2, DEL, None), (1, 2, b"k", 1, PUT, b"old")], "run int, level int, key binary, seq long, op byte, value binary")
    assert runs.multi_run_get(every).count() == 0
    assert runs.compact(every.where("level = 1"), bottom=False).count() == 1
    assert runs.compact(every.where("level = 1"), bottom=True).count() == 0


def manifest(spark, *entries):
    return spark.createDataFrame([(r, lv, lo, hi, 1, 0, b) for r, lv, lo, hi, b in entries], "run int, level int, min_key string, max_key string, entries long, tombstones long, bytes long")


def test_pick(spark):
    few = manifest(spark, *[(i, 0, "a", "c", 1) for i in range(3)])
    assert runs.pick_compaction(few).count() == 0
    four = manifest(spark, *[(i, 0, "b", "c", 1) for i in range(4)], (9, 1, "a", "b", 1), (8, 1, "d", "e", 1))
    assert rows(runs.pick_compaction(four)) == [(0, 0, 1), (1, 0, 1), (2, 0, 1), (3, 0, 1), (9, 1, 1)]
    full = manifest(spark, (1, 1, "m", "z", 8_000_000), (2, 1, "a", "f", 8_000_000), (3, 2, "e", "g", 1), (4, 2, "h", "i", 1))
    assert rows(runs.pick_compaction(full)) == [(2, 1, 2), (3, 2, 2)]
