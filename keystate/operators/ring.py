"""Placement of keys on a consistent-hash ring.

A node has points at CRC-32(node + "#" + the character of code i). The owner of a key is
the node of the first point at or after CRC-32(key), around the end to the first. Rings
are small (nodes times points), so they are built on the driver; keys never are.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import REPLICATION_FACTOR, VIRTUAL_NODES, NodeError

TOP = (1 << 32) - 1
#: A ring of up to so many intervals is broadcast (about 100 bytes each); a larger one is joined by shuffle.
MOST_SENT = 200_000


class Ring:
    """Nodes and their points. Adding a node twice changes nothing; of nodes that meet in
    a point the last added owns it, and gives it back when it is removed."""

    def __init__(self, nodes: list[str] = (), points: int = VIRTUAL_NODES):
        self.points = points if points > 0 else VIRTUAL_NODES
        self.order: list[str] = []
        for n in nodes:
            self.add(n)

    def add(self, node: str) -> None:
        if node not in self.order:
            self.order.append(node)

    def remove(self, node: str) -> None:
        if node in self.order:
            self.order.remove(node)

    def nodes(self) -> list[str]:
        return sorted(self.order)

    def __len__(self) -> int:
        return len(self.order)

    def owners(self) -> list[tuple[int, str]]:
        """(point, node), sorted by point."""
        at = {zlib.crc32(f"{n}#{chr(i)}".encode()): n for n in self.order for i in range(self.points)}
        return sorted(at.items())

    def get(self, key: bytes) -> str:
        owners = self.owners()
        if not owners:
            return ""
        i = bisect_left(owners, (zlib.crc32(key), ""))
        return owners[i % len(owners)][1]

    def get_n(self, key: bytes, n: int) -> list[str]:
        owners = self.owners()
        if not owners or n <= 0:
            return []
        i = bisect_left(owners, (zlib.crc32(key), ""))
        return _distinct(owners, i, n)

    def intervals(self, replicas: int = REPLICATION_FACTOR) -> list[tuple[int, int, str, list[str]]]:
        """(lo, hi, node, replicas): the hashes over lo up to hi belong to node."""
        owners = self.owners()
        if not owners:
            return []
        lows = [-1, *(p for p, _ in owners)]
        out = [(lows[i], p, n, _distinct(owners, i, replicas)) for i, (p, n) in enumerate(owners)]
        if owners[-1][0] < TOP:  # beyond the last point: the first node
            out.append((owners[-1][0], TOP, owners[0][1], _distinct(owners, 0, replicas)))
        return out


def _distinct(owners: list[tuple[int, str]], at: int, n: int) -> list[str]:
    found: dict[str, None] = {}
    for i in range(len(owners)):
        found.setdefault(owners[(at + i) % len(owners)][1])
        if len(found) == n:
            break
    return list(found)


def points(spark: SparkSession, ring: Ring) -> DataFrame:
    """(hash, node) of all points."""
    return spark.createDataFrame(ring.owners(), "hash long, node string")


def route(keys: DataFrame, ring: Ring, key: str = "key", replicas: int = REPLICATION_FACTOR) -> DataFrame:
    """keys with ``hash``, ``node`` and ``replicas``; node "" and no replicas on an empty ring.

    Intervals are listed under every leading-bits bucket that they meet, so routing is
    an equi-join on the bucket with the interval as a residual condition. A null key is
    an error: it has no place.
    """
    spark = keys.sparkSession
    placed = F.when(F.col(key).isNull(), F.raise_error(F.lit("key cannot be null")).cast("binary")).otherwise(F.col(key).cast("binary"))
    hashed = keys.withColumn("hash", F.crc32(placed))
    intervals = ring.intervals(replicas)
    if not intervals:
        return hashed.withColumn("node", F.lit("")).withColumn("replicas", F.array().cast("array<string>"))
    bits = min(20, max(8, len(intervals).bit_length()))
    shift = 32 - bits
    rows = [(b, lo, hi, n, r) for lo, hi, n, r in intervals for b in range((lo + 1) >> shift, (hi >> shift) + 1)]
    table = spark.createDataFrame(rows, "bucket long, lo long, hi long, node string, replicas array<string>")
    table = F.broadcast(table) if len(rows) <= MOST_SENT else table
    on = (F.shiftright("hash", shift) == F.col("bucket")) & (F.col("hash") > F.col("lo")) & (F.col("hash") <= F.col("hi"))
    return hashed.join(table, on).drop("bucket", "lo", "hi")


def is_local(node: str | Column, local: str) -> Column:
    return (F.col(node) if isinstance(node, str) else node) == F.lit(local)


def distribution(routed: DataFrame) -> DataFrame:
    return routed.groupBy("node").agg(F.count("*").alias("keys"))


def migration(keys: DataFrame, before: Ring, after: Ring, key: str = "key") -> DataFrame:
    """(from_node, to_node, keys) of the keys whose owner changes."""
    a = route(keys.select(key), before, key).select(key, F.col("node").alias("from_node"))
    b = route(a, after, key).withColumnRenamed("node", "to_node")
    return b.where("from_node <> to_node").groupBy("from_node", "to_node").agg(F.count("*").alias("keys"))


class Registry:
    """Nodes with their addresses beside a ring: names are not empty, not twice, and known when removed."""

    def __init__(self, local: str, points: int = VIRTUAL_NODES, replicas: int = REPLICATION_FACTOR):
        self.local, self.replicas, self.ring, self.addresses = local, replicas, Ring([], points), {}

    def add(self, node: str, address: str = "") -> None:
        if not node:
            raise NodeError("node id cannot be empty")
        if node in self.addresses:
            raise NodeError(f"node {node} is already there")
        self.addresses[node] = address
        self.ring.add(node)

    def remove(self, node: str) -> None:
        if node not in self.addresses:
            raise NodeError(f"node {node} is not known")
        del self.addresses[node]
        self.ring.remove(node)

    def node_of(self, key: bytes) -> str:
        if not len(self.ring):
            raise NodeError("there are no nodes")
        return self.ring.get(key)

    def nodes_of(self, key: bytes) -> list[str]:
        return self.ring.get_n(key, self.replicas)

    def is_local_key(self, key: bytes) -> bool:
        return self.node_of(key) == self.local

    def all_nodes(self) -> list[str]:
        return self.ring.nodes()

    def __len__(self) -> int:
        return len(self.addresses)

    def close(self) -> None:
        self.addresses.clear()
        self.ring = Ring([], self.ring.points)
