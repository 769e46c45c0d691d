"""A key-value store on files: puts, deletes, lookups, scans, flush, compaction, snapshots.

Writes append a log segment (one job each, so write batches, not single keys) and
publish a manifest version. Reads bind one version. Every row carries its sequence
number, so the latest version of a key is the highest, wherever it is kept. Durability
is that of the file system, at the granularity of a batch.

Once the log's segments hold ``memtable_bytes`` of keys and values they are flushed to a
run, and compactions that are then due are done. A compaction's output is split by key
into runs of about ``output_bytes``. Files that no present manifest names stay until
``purge``, as snapshots may read them.
"""

from __future__ import annotations

import logging
import math
import time
import uuid
from dataclasses import replace
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .config import Config
from .operators import ingest, state
from .schema import CHANGE, DELETE, ENTRY_HEADER_BYTES, PUT, ClosedError, EmptyKeyError
from .sources.manifest import Manifest, ManifestStore, Run

LOG = logging.getLogger("keystate")


def _logged(f):
    """Log how long a call took, or how it failed."""

    @wraps(f)
    def call(self, *args, **kwargs):
        began = time.perf_counter()
        try:
            out = f(self, *args, **kwargs)
        except Exception as e:
            LOG.error("%s failed after %.1f ms: %s", f.__name__, 1000 * (time.perf_counter() - began), e)
            raise
        LOG.info("%s took %.1f ms", f.__name__, 1000 * (time.perf_counter() - began))
        return out

    return call


class KeyState:
    """keys and values are bytes. Nothing is resident between calls but the manifest's folder name."""

    def __init__(self, spark: SparkSession, folder: str | None = None, config: Config | None = None):
        self.config = (config or Config()).validated()
        folder = folder or self.config.folder
        self.spark, self.folder, self.closed = spark, folder.rstrip("/"), False
        self.manifests = ManifestStore(spark, folder)
        if config:
            LOG.setLevel(config.log_level)

    # writes

    @_logged
    def put(self, key: bytes, value: bytes) -> None:
        self.batch_put([(key, value)])

    @_logged
    def delete(self, key: bytes) -> None:
        """Deleting a key that is not there succeeds."""
        _check(key)
        self._append(self.spark.createDataFrame([(key, None, DELETE, 0)], "key binary, value binary, op byte, pos long"))

    @_logged
    def batch_put(self, items: list[tuple[bytes, bytes]] | dict[bytes, bytes]) -> None:
        """In order; stops with EmptyKeyError at the first empty key, what came before stays."""
        pairs = list(items.items()) if isinstance(items, dict) else list(items)
        bad = next((i for i, (k, _) in enumerate(pairs) if not k), None)
        rows = [(k, v, PUT, i) for i, (k, v) in enumerate(pairs[:bad])]
        if rows:
            self._append(self.spark.createDataFrame(rows, "key binary, value binary, op byte, pos long"))
        if bad is not None:
            raise EmptyKeyError("key cannot be empty")

    @_logged
    def write(self, changes: DataFrame, stream: str | None = None, batch: int | None = None) -> bool:
        """Append (key, value, op, pos) rows, pos distinct. With a stream's name and batch number, once only."""
        if stream is not None and self._manifest().batches.get(stream, -1) >= batch:
            return False
        self._append(ingest.require_keys(changes), stream, batch)
        return True

    def _append(self, changes: DataFrame, stream: str | None = None, batch: int | None = None) -> None:
        m = self._manifest()
        path = f"{self.folder}/log/{uuid.uuid4().hex}"
        rows = ingest.numbered(changes.select("key", "value", F.col("op").cast("byte").alias("op"), "pos"), "pos", m.next_seq)
        rows.select(*CHANGE.names).write.parquet(path)
        written = self.spark.read.schema(CHANGE).parquet(path).agg(F.max("seq").alias("last"), _size().alias("size")).first()
        batches = {**m.batches, stream: batch} if stream is not None else m.batches
        size = m.log_bytes + (written["size"] or 0)
        self.manifests.publish(replace(m, version=m.version + 1, next_seq=(written["last"] or m.next_seq - 1) + 1, segments=[*m.segments, path], batches=batches, log_bytes=size))
        if size >= self.config.memtable_bytes:
            self.flush()
            self.compact()

    # reads

    def versions(self, lo: bytes | None = None, hi: bytes | None = None, manifest: Manifest | None = None) -> DataFrame:
        """The change log of everything kept; files of runs outside the keys lo..hi are not opened."""
        m = manifest or self._manifest()
        paths = [*m.segments, *(r.path for r in m.runs if r.meets(lo and lo.hex(), hi and hi.hex()))]
        return self.spark.read.schema(CHANGE).parquet(*paths) if paths else self.spark.createDataFrame([], CHANGE)

    def state(self, manifest: Manifest | None = None) -> DataFrame:
        return state.visible_state(self.versions(manifest=manifest)).select("key", "value", "seq")

    @_logged
    def get(self, key: bytes) -> tuple[bytes | None, bool]:
        _check(key)
        rows = self.versions(key, key).where(F.col("key") == F.lit(bytes(key)))
        row = state.latest_version(rows).first()
        return (bytes(row["value"]), True) if row and row["op"] == PUT else (None, False)

    @_logged
    def batch_get(self, keys: list[bytes]) -> list[tuple[bytes, bytes | None, bool]]:
        """One answer for each requested key, in order, repeats and misses included."""
        asked = self.spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "pos long, key binary")
        lo, hi = (min(keys), max(keys)) if keys else (None, None)
        log = self.versions(lo or None, hi or None).join(asked.select("key").distinct(), "key", "left_semi")
        found = state.batch_get(state.visible_state(log), asked).orderBy("pos").collect()
        return [(bytes(r["key"]), None if r["value"] is None else bytes(r["value"]), r["found"]) for r in found]

    @_logged
    def scan(self, start: bytes | None = None, end: bytes | None = None, limit: int = 0) -> DataFrame:
        """(key, value) with start <= key < end in order of key."""
        log = self.versions(start, end)
        for value, keep in ((start, lambda v: F.col("key") >= v), (end, lambda v: F.col("key") < v)):
            log = log.where(keep(F.lit(bytes(value)))) if value is not None else log
        return state.scan(state.visible_state(log), limit=limit)

    def snapshot(self) -> DataFrame:
        """The present state, bound to the present manifest version: later writes do not show in it."""
        return self.state(self._manifest())

    def view(self, name: str = "state") -> None:
        """The present state as a temporary view, with key and value as text, for SQL."""
        self.snapshot().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value")).createOrReplaceTempView(name)

    # maintenance

    @_logged
    def flush(self) -> None:
        """The log as a run of level 0: one version of a key, in key order, tombstones kept."""
        m = self._manifest()
        if m.segments:
            runs = self._write_runs(state.latest_version(self.spark.read.schema(CHANGE).parquet(*m.segments)), m.next_run, 0, 1)
            self.manifests.publish(replace(m, version=m.version + 1, next_run=m.next_run + len(runs), segments=[], log_bytes=0, runs=[*m.runs, *runs]))

    def _write_runs(self, rows: DataFrame, run_id: int, level: int, parts: int) -> list[Run]:
        """rows as runs of ``parts`` ranges of keys, each sorted by key; ranges without rows give none."""
        top = f"{self.folder}/runs/{run_id:08d}-{uuid.uuid4().hex}"
        ranged = rows.select(*CHANGE.names).repartitionByRange(parts, "key") if parts > 1 else rows.select(*CHANGE.names).repartitionByRange("key")
        part = F.spark_partition_id() if parts > 1 else F.lit(0)
        ranged.withColumn("part", part).sortWithinPartitions("part", "key").write.partitionBy("part").parquet(top)
        if not self.manifests.exists(f"{top}/part=0") and parts == 1:
            return []
        kept = self.spark.read.schema(T.StructType([*CHANGE.fields, T.StructField("part", T.IntegerType())])).parquet(top)
        # a row for each run
        stats = kept.groupBy("part").agg(F.hex(F.min("key")).alias("lo"), F.hex(F.max("key")).alias("hi"), F.count("*").alias("n"), _size().alias("b")).orderBy("part").collect()
        return [Run(run_id + i, level, s["lo"].lower(), s["hi"].lower(), s["n"], s["b"], f"{top}/part={s['part']}") for i, s in enumerate(stats)]

    def compaction(self, m: Manifest | None = None) -> tuple[list[Run], int] | None:
        """The runs that are due to be merged and the level they go to."""
        m = m or self._manifest()
        if len(m.level(0)) >= self.config.l0_trigger:
            inputs = m.level(0)
            lo, hi = min(r.min_key for r in inputs), max(r.max_key for r in inputs)
            return inputs + [r for r in m.level(1) if r.meets(lo, hi)], 1
        for n in range(1, self.config.max_levels - 1):
            if sum(r.bytes for r in m.level(n)) >= self.config.base_level_bytes * self.config.level_factor ** (n - 1):
                first = m.level(n)[0]
                return [first] + [r for r in m.level(n + 1) if r.meets(first.min_key, first.max_key)], n + 1
        return None

    @_logged
    def compact(self, force: bool = False) -> int:
        """Merge until nothing is due; the number of merges. force: all runs into the deepest level first."""
        merges = 0
        while True:
            m = self._manifest()
            task = (list(m.runs), max(1, max((r.level for r in m.runs), default=1))) if force and m.runs and not merges else self.compaction(m)
            if not task:
                return merges
            inputs, level = task
            lo, hi = min(r.min_key for r in inputs), max(r.max_key for r in inputs)
            # tombstones may go only if no older run outside the merge can hold their keys
            bottom = not any(r.level >= level and r not in inputs and r.meets(lo, hi) for r in m.runs)
            rows = state.latest_version(self.spark.read.schema(CHANGE).parquet(*(r.path for r in inputs)))
            rows = rows.where(F.col("op") == PUT) if bottom else rows
            parts = max(1, math.ceil(sum(r.bytes for r in inputs) / self.config.output_bytes))
            runs = self._write_runs(rows, m.next_run, level, parts)
            self.manifests.publish(replace(m, version=m.version + 1, next_run=m.next_run + len(runs), runs=[r for r in m.runs if r not in inputs] + runs))
            merges += 1

    @_logged
    def purge(self, keep: int = 1) -> int:
        """Delete the files that none of the last ``keep`` manifest versions names: retired
        segments and runs, what failed writes left, and older manifests; how many.

        Only while no other writer is at work and no older snapshot is read any more.
        """
        last = self._manifest().version
        kept = [self.manifests.load(v) for v in range(max(1, last - keep + 1), last + 1)]
        named = {path.removeprefix(self.folder) for m in kept for path in [*m.segments, *(r.path for r in m.runs)]}
        n = 0
        for folder in ("log", "runs"):
            for path in self.manifests.children(f"{self.folder}/{folder}"):
                parts = self.manifests.children(path)
                own = path.rsplit("/", 1)[-1]
                used = {x for x in named if x == f"/{folder}/{own}" or x.startswith(f"/{folder}/{own}/")}
                gone = [] if f"/{folder}/{own}" in used else [p for p in parts if f"/{folder}/{own}/{p.rsplit('/', 1)[-1]}" not in used] if used else [path]
                n += sum(map(self.manifests.delete, gone))
        return n + sum(map(self.manifests.delete, self.manifests.stale(max(1, last - keep + 1))))

    def close(self) -> None:
        """Everything written is already on files."""
        self.closed = True

    def _manifest(self) -> Manifest:
        if self.closed:
            raise ClosedError("the store is closed")
        return self.manifests.latest()


def _size():
    """Bytes of entries: header, key and value."""
    return F.sum(F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + ENTRY_HEADER_BYTES)


def _check(key: bytes) -> None:
    if not key:
        raise EmptyKeyError("key cannot be empty")
