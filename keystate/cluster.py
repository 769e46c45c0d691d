"""Several stores behind a ring, and a node's replicated log on files."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .engine import KeyState
from .functions import codec
from .operators import replog, ring
from .schema import LOG_ENTRY, SNAPSHOT_ENTRIES, KeyStateError, NotLeaderError
from .sources.manifest import ManifestStore


class RoutedStores:
    """Puts, deletes and lookups over one store for each node, each key at its owner."""

    def __init__(self, registry: ring.Registry, stores: dict[str, KeyState]):
        self.registry, self.stores = registry, stores

    def _of(self, key: bytes) -> KeyState:
        node = self.registry.node_of(key)
        if node not in self.stores:
            raise KeyStateError(f"no store for node {node}")
        return self.stores[node]

    def put(self, key: bytes, value: bytes) -> None:
        self._of(key).put(key, value)

    def get(self, key: bytes) -> tuple[bytes | None, bool]:
        return self._of(key).get(key)

    def delete(self, key: bytes) -> None:
        self._of(key).delete(key)

    def write(self, changes: DataFrame) -> None:
        """(key, value, op, pos) rows, each to its owner's store: one job for each node."""
        routed = ring.route(changes, self.registry.ring).select(*changes.columns, "node")
        for node in self.registry.all_nodes():
            self.stores[node].write(routed.where(F.col("node") == node).drop("node"))

    def batch_get(self, keys: list[bytes]) -> list[tuple[bytes, bytes | None, bool]]:
        """One answer for each requested key, in order."""
        of, found = [self.registry.node_of(k) for k in keys], {}
        for node in dict.fromkeys(of):
            found.update({k: (v, f) for k, v, f in self.stores[node].batch_get([k for k, n in zip(keys, of, strict=True) if n == node])})
        return [(k, *found[k]) for k in keys]

    def state(self) -> DataFrame:
        """The visible state of all nodes."""
        every = [self.stores[n].state().withColumn("node", F.lit(n)) for n in self.registry.all_nodes()]
        out = every[0]
        for more in every[1:]:
            out = out.unionByName(more)
        return out


class Replica:
    """A node's term, vote, log and snapshot, kept as immutable versions; state is applied from them.

    A version names the log's files and the snapshot's; it is published like a store's
    manifest, so of two writers one fails. Elections and transport are not here: ``term``
    and ``leader`` are set by whoever runs them.
    """

    def __init__(self, spark: SparkSession, folder: str, node: str, snapshot_entries: int = SNAPSHOT_ENTRIES):
        self.spark, self.folder, self.node, self.most = spark, folder.rstrip("/"), node, snapshot_entries
        self.versions = ManifestStore(spark, folder)
        self.load()

    def load(self) -> None:
        """The last version, as after a restart; a node without one is in term 0, with an empty log."""
        kept = self.versions.latest_data() or {}
        self.version, self.term, self.voted_for = kept.get("version", 0), kept.get("term", 0), kept.get("voted_for")
        self.leader, self.segments = kept.get("leader"), kept.get("segments", [])
        self.commit, self.snapshot = kept.get("commit", 0), kept.get("snapshot")  # snapshot: index, term, path

    def save(self) -> None:
        self.version += 1
        self.versions.publish_data(self.version, {x: getattr(self, x) for x in ("version", "term", "voted_for", "leader", "segments", "commit", "snapshot")})

    def become(self, term: int, leader: str | None) -> None:
        """A term and its leader, kept before anything is done in it. A lower term is an error."""
        if term < self.term:
            raise KeyStateError(f"term {term} is behind {self.term}")
        self.voted_for = self.voted_for if term == self.term else None
        self.term, self.leader = term, leader
        self.save()

    def vote(self, term: int, candidate: str, last_index: int, last_term: int) -> bool:
        """Grant or refuse a vote; a granted one is kept before it is given."""
        own = self.tail()
        if term < self.term or (term == self.term and self.voted_for not in (None, candidate)) or (last_term, last_index) < (own[1], own[0]):
            return False
        self.term, self.voted_for = term, candidate
        self.save()
        return True

    def log(self) -> DataFrame:
        """(index, term, command) of the entries after the snapshot."""
        return self.spark.read.schema(LOG_ENTRY).parquet(*self.segments) if self.segments else self.spark.createDataFrame([], LOG_ENTRY)

    def tail(self) -> tuple[int, int]:
        """Last index and term, the snapshot's where the log holds none."""
        last = replog.tail(self.log()).first()
        return (last["last_index"], last["last_term"]) if last["last_index"] else (self.snapshot["index"], self.snapshot["term"]) if self.snapshot else (0, 0)

    def _written(self, rows: DataFrame) -> str:
        path = f"{self.folder}/entries/{uuid.uuid4().hex}"
        rows.select(*LOG_ENTRY.names).write.parquet(path)
        return path

    def submit(self, commands: list[tuple[int, bytes, bytes | None]]) -> int:
        """Append commands (op, key, value) in order; the last index. Only the leader may."""
        if self.leader != self.node:
            raise NotLeaderError("not the leader")
        first = self.tail()[0] + 1
        rows = self.spark.createDataFrame([(first + i, self.term, op, k, v) for i, (op, k, v) in enumerate(commands)], "index long, term long, op int, key binary, value binary")
        self.segments = [*self.segments, self._written(rows.select("index", "term", codec.command(F.col("op"), F.col("key"), F.col("value")).alias("command")))]
        self.save()
        return first + len(commands) - 1

    def follow(self, entries: DataFrame, prev_index: int, prev_term: int) -> bool:
        """Accept a leader's entries after (prev_index, prev_term): False if that entry is not here; a conflict cuts the log."""
        log = self.log()
        at_snapshot = self.snapshot and (prev_index, prev_term) == (self.snapshot["index"], self.snapshot["term"])
        asked = self.spark.createDataFrame([(0, prev_index, prev_term)], "request int, prev_index long, prev_term long")
        if not at_snapshot and not replog.previous_matches(log, asked).first()["ok"]:
            return False
        self.segments = [self._written(replog.accept(log, entries))]
        self.save()
        return True

    def committed(self, index: int) -> None:
        """Entries up to index are held by a majority. It never goes back; a snapshot is made when it is due."""
        self.commit = max(self.commit, min(index, self.tail()[0]))
        self.save()
        if self.log().where(F.col("index") <= self.commit).count() > self.most:
            self.take_snapshot()

    def _decoded(self, log: DataFrame) -> DataFrame:
        read = log.select("index", codec.decode_command(F.col("command")).alias("c"))
        wrong = F.raise_error(F.concat(F.lit("damaged command: "), F.col("c.error"))).cast("int")
        return read.select("index", F.when(F.col("c.error").isNotNull(), wrong).otherwise(F.col("c.op")).alias("op"), "c.key", "c.value")

    def state(self) -> DataFrame:
        """(key, index, value) after all committed entries. An unknown or damaged command is an error."""
        log = self._decoded(self.log().where(F.col("index") <= self.commit))
        base = self.snapshot["index"] if self.snapshot else 0
        kept = self.spark.read.parquet(self.snapshot["path"]) if self.snapshot else self.spark.createDataFrame([], T.StructType([T.StructField("key", T.BinaryType()), T.StructField("index", T.LongType()), T.StructField("value", T.BinaryType())]))
        return replog.restore(kept, log, base)

    def take_snapshot(self) -> None:
        """The committed state on files, and the log cut down to what comes after it."""
        log = self.log()
        term = log.where(F.col("index") == self.commit).select("term").first()
        if term is None:
            return
        path = f"{self.folder}/snapshots/{uuid.uuid4().hex}"
        self.state().write.parquet(path)
        rest = self._written(log.where(F.col("index") > self.commit))
        self.snapshot, self.segments = {"index": self.commit, "term": term["term"], "path": path}, [rest]
        self.save()

    def install(self, snapshot: dict) -> None:
        """Another node's snapshot (index, term, path), if it is ahead: the log up to it goes."""
        if self.snapshot and snapshot["index"] <= self.snapshot["index"]:
            return
        rest = self._written(self.log().where(F.col("index") > snapshot["index"]))
        self.snapshot, self.segments, self.commit = dict(snapshot), [rest], max(self.commit, snapshot["index"])
        self.save()
