"""Ring placement, replicated-log rules, codecs."""

import random
import struct
import zlib
from bisect import bisect_left

import pytest
from conftest import rows
from pyspark.sql import functions as F

from keystate.functions import codec
from keystate.operators import replog, ring
from keystate.schema import NodeError, NotLeaderError
from keystate.sources import files


def by_hand(nodes, points, key):
    at = sorted({zlib.crc32((n + "#" + chr(i)).encode()): n for n in nodes for i in range(points)}.items())
    hashes = [h for h, _ in at]
    return at[bisect_left(hashes, zlib.crc32(key.encode())) % len(at)][1]


def test_route_equals_a_walk(spark):
    keys = [f"key{i}" for i in range(10_000)]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    got = {r["key"]: r["node"] for r in ring.route(df, ring.Ring(["node1", "node2", "node3"])).collect()}
    assert got == {k: by_hand(["node1", "node2", "node3"], 150, k) for k in keys}
    counts = sorted(list(got.values()).count(n) for n in ("node1", "node2", "node3"))
    assert counts == [1968, 3843, 4189]


def test_many_points_need_characters_beyond_a_byte(spark):
    df = spark.createDataFrame([(f"k{i}",) for i in range(300)], "key string")
    got = {r["key"]: r["node"] for r in ring.route(df, ring.Ring(["a", "b"], 400)).collect()}
    assert got == {k: by_hand(["a", "b"], 400, k) for k in got}


def test_ring_rules(spark):
    r = ring.Ring(["node1", "node2", "node3"], 10)
    r.add("node1")
    assert len(r) == 3 and r.nodes() == ["node1", "node2", "node3"]
    assert len(set(r.get_n(b"key1", 3))) == 3 and len(ring.Ring(["a", "b"]).get_n(b"k", 5)) == 2
    r.remove("node2")
    r.remove("unknown")
    assert all(r.get(f"key{i}".encode()) != "node2" for i in range(100))
    assert ring.Ring([]).get(b"k") == "" and ring.Ring([]).get_n(b"k", 3) == [] and ring.Ring([], 0).points == 150
    empty = ring.route(spark.createDataFrame([("k",)], "key string"), ring.Ring([]))
    assert rows(empty, "node", "replicas") == [("", [])]


def test_migration_moves_about_a_quarter(spark):
    keys = spark.createDataFrame([(f"key{i}",) for i in range(1000)], "key string")
    three = ring.Ring(["node1", "node2", "node3"])
    moved = ring.migration(keys, three, ring.Ring(["node1", "node2", "node3", "node4"])).collect()
    assert sum(r["keys"] for r in moved) == 267 and {r["to_node"] for r in moved} == {"node4"}


def test_registry():
    reg = ring.Registry("a")
    with pytest.raises(NodeError):
        reg.node_of(b"k")
    reg.add("a", "host:1")
    for bad in ("", "a"):
        with pytest.raises(NodeError):
            reg.add(bad)
    with pytest.raises(NodeError):
        reg.remove("b")
    assert reg.is_local_key(b"k") and reg.nodes_of(b"k") == ["a"] and len(reg) == 1


def test_append_conflict_commit_votes(spark):
    empty = spark.createDataFrame([], "index long, term long, key string, op int, value string")
    new = spark.createDataFrame([(0, "a", 0, "1"), (1, "b", 0, "2")], "pos long, key string, op int, value string")
    one = replog.append(empty, new, 1)
    assert rows(one, "index", "term") == [(1, 1), (2, 1)]
    with pytest.raises(NotLeaderError):
        replog.append(empty, new, 1, is_leader=False)
    assert rows(replog.tail(empty)) == [(0, 0)]
    entries = spark.createDataFrame([(2, 3), (3, 3)], "index long, term long")
    assert rows(replog.accept(one.select("index", "term"), entries)) == [(1, 1), (2, 3), (3, 3)]
    first = spark.createDataFrame([(1, 2)], "index long, term long")
    assert rows(replog.accept(one.select("index", "term"), first)) == [(1, 2)]
    for matches, expected in (([5, 3, 1], 3), ([4, 4, 2, 1], 2), ([5], 5)):
        log = spark.range(1, 6).select(F.col("id").alias("index"), F.lit(7).alias("term"))
        m = spark.createDataFrame([(str(i), v) for i, v in enumerate(matches)], "peer string, match_index long")
        assert replog.commit_index(log, m, 7).first()[0] == expected
        assert replog.commit_index(log, m, 8, 1).first()[0] == 1  # entries of an older term are not committed by count
    asked = "term long, candidate string, last_index long, last_term long, own_term long, voted_for string, own_last_index long, own_last_term long"
    cases = [((1, "x", 0, 0, 0, None, 0, 0), True), ((1, "x", 0, 0, 2, None, 0, 0), False), ((2, "x", 5, 1, 2, "y", 5, 1), False), ((2, "x", 4, 1, 1, None, 5, 1), False), ((2, "x", 1, 2, 1, None, 5, 1), True)]
    got = replog.vote(spark.createDataFrame([c for c, _ in cases], asked)).collect()
    assert [r["granted"] for r in got] == [g for _, g in cases]


def test_records_equal_struct(spark):
    rnd = random.Random(3)
    items = [(i, rnd.randbytes(rnd.randrange(1, 30)), rnd.randbytes(rnd.randrange(0, 300)), bool(rnd.randrange(2))) for i in range(60)]
    df = spark.createDataFrame(items, "i int, key binary, value binary, tombstone boolean")
    coded = df.withColumn("log", codec.log_record(F.col("key"), F.col("value"), F.col("tombstone"))).withColumn("cmd", codec.command(F.col("tombstone").cast("int"), F.col("key"), F.col("value")))
    for r in coded.collect():
        _, key, value, tombstone = items[r["i"]]
        assert bytes(r["log"]) == files.log_image([(key, value, tombstone)])
        assert bytes(r["cmd"]) == struct.pack(">BI", tombstone, len(key)) + key + struct.pack(">I", len(value)) + value
    read = coded.select("i", codec.decode_log_record(F.col("log")).alias("r"), codec.decode_command(F.col("cmd")).alias("c")).collect()
    for r in read:
        _, key, value, tombstone = items[r["i"]]
        assert r["r"]["ok"] and (bytes(r["r"]["key"]), bytes(r["r"]["value"]), r["r"]["tombstone"]) == (key, value, tombstone)
        assert r["c"]["error"] is None and (bytes(r["c"]["key"]), bytes(r["c"]["value"])) == (key, value)


def test_damaged_commands_and_records(spark):
    good = files.log_image([(b"key", b"value", False)])
    cmd = struct.pack(">BI", 0, 3) + b"key" + struct.pack(">I", 5) + b"value"
    df = spark.createDataFrame([(1, cmd[:5]), (2, cmd[:10]), (3, cmd[:-1]), (4, cmd)], "i int, c binary")
    assert [r["e"] for r in df.orderBy("i").select(codec.decode_command(F.col("c"))["error"].alias("e")).collect()] == ["too short", "key length", "value length", None]
    bad = spark.createDataFrame([(good[:-1],), (good[:-1] + b"x",), (b"",)], "d binary")
    assert [r["ok"] for r in bad.select(codec.decode_log_record(F.col("d"))["ok"].alias("ok")).collect()] == [False] * 3
    two = files.log_image([(b"a", b"1", False), (b"b", b"22", True)])
    assert list(files.parse_log(two[:-1])) == [(b"a", b"1", False)]
    assert list(files.parse_log(two[:3] + b"!" + two[4:])) == []
