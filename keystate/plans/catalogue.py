"""Queries of the state engine over the driver tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codec
from ..operators import folds, ingest, replog, runs, state
from ..operators import ring as ring_ops
from ..schema import RUN_MAGIC
from ..streaming import stream
from .tables import CRC, EVENTS, GROWN, KEYS, LATEST, LOG, NODES, ORDERS, RING, RUNS, STATS, bytes_sql, crc_sql, events_log, level_of, orders_log, orders_state, ring_keys, ring_sql, routed_sql, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, folder) under its name, with the SQL of its rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _keys(spark: SparkSession, *keys: int) -> DataFrame:
    return spark.createDataFrame([(k,) for k in keys], "key long")


# state of a change log


@query(f"WITH {LATEST} SELECT key, event_id, op, value FROM latest")
def latest_version(spark, d):
    return state.latest_version(events_log(spark, d), ("event_id",)).select("key", "event_id", "op", "value")


@query(f"WITH {LATEST} SELECT key, event_id, value FROM latest WHERE op = 0")
def visible_state(spark, d):
    return state.visible_state(events_log(spark, d), ("event_id",)).select("key", "event_id", "value")


@query(f"WITH {LATEST}, asked AS (SELECT unnest(range(10, 40)) AS key UNION ALL SELECT -1) SELECT a.key, l.op IS NOT NULL AS found, coalesce(l.op = 1, false) AS tombstone, l.value FROM asked a LEFT JOIN latest l USING (key)")
def memtable_get_raw(spark, d):
    return state.raw_get(events_log(spark, d), _keys(spark, *range(10, 40), -1))


@query(f"WITH {LATEST} SELECT 7::BIGINT AS key, max(CASE WHEN op = 0 THEN value END) AS value, coalesce(bool_or(op = 0), false) AS found FROM latest WHERE key = 7")
def point_get(spark, d):
    return state.get(events_log(spark, d).where("key = 7"), _keys(spark, 7))


@query("SELECT -7::BIGINT AS key, NULL::DOUBLE AS value, false AS found")
def point_get_miss(spark, d):
    return state.get(events_log(spark, d).where("key = -7"), _keys(spark, -7))


@query(f"WITH {LATEST} SELECT key, CASE WHEN op = 0 THEN value END AS value, op = 0 AS found FROM latest")
def delete_hide(spark, d):
    log = events_log(spark, d)
    return state.get(log, log)


@query(f"WITH {LATEST} SELECT sum(strlen(key::VARCHAR) + coalesce(strlen(props), 0))::BIGINT AS bytes FROM latest")
def memtable_size(spark, d):
    return state.state_size(events_log(spark, d).select(F.col("key").cast("string").alias("key"), "seq", "op", F.col("props").alias("value")))


@query(f"WITH {LATEST} SELECT key, op, value FROM latest ORDER BY key")
def memtable_iter(spark, d):
    return state.ordered_versions(events_log(spark, d)).select("key", "op", "value")


@query(f"WITH {EVENTS} SELECT key, event_id, op, value FROM log WHERE ts > TIMESTAMP '2024-01-15'")
def log_truncate(spark, d):
    covered = F.struct(F.lit("2024-01-15").cast("timestamp_ntz").alias("ts"), F.lit(2**62).alias("event_id"))
    return state.truncated(events_log(spark, d), covered).select("key", "event_id", "op", "value")


@query(f"WITH {EVENTS}, seen AS (SELECT * FROM log WHERE ts <= TIMESTAMP '2024-01-15' QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) = 1) SELECT key, event_id, value FROM seen WHERE op = 0")
def snapshot_as_of(spark, d):
    at = F.struct(F.lit("2024-01-15").cast("timestamp_ntz").alias("ts"), F.lit(2**62).alias("event_id"))
    return state.visible_state(state.as_of(events_log(spark, d), at), ("event_id",)).select("key", "event_id", "value")


@query(f"WITH {LATEST} SELECT key, value FROM latest WHERE op = 0")
def replay_state(spark, d):
    """The log encoded, decoded again and replayed."""
    log = events_log(spark, d)
    raw = log.select("seq", codec.log_record(F.col("key").cast("string"), F.col("value").cast("string"), F.col("op") == 1).alias("record"))
    read = raw.select("seq", codec.decode_log_record(F.col("record")).alias("r")).where("r.ok")
    again = read.select(F.col("r.key").cast("string").cast("long").alias("key"), "seq", F.col("r.tombstone").cast("int").alias("op"), F.col("r.value").cast("string").cast("double").alias("value"))
    return state.visible_state(again).select("key", "value")


# batches and scans

_REQUESTS = (
    "requests AS (SELECT o_orderkey AS pos, key FROM state UNION ALL SELECT 1000000000 + o_orderkey, key FROM state"
    " UNION ALL SELECT 2000000000 + o_orderkey, 'missing:' || o_orderkey FROM state)"
)


def _requests(orders: DataFrame) -> DataFrame:
    """Every key, every key again, and a miss for each."""
    k = F.col("o_orderkey")
    found = orders.select(k.alias("pos"), "key")
    again = orders.select((k + 1000000000).alias("pos"), "key")
    misses = orders.select((k + 2000000000).alias("pos"), F.concat(F.lit("missing:"), k.cast("string")).alias("key"))
    return found.unionByName(again).unionByName(misses)


@query(f"WITH {ORDERS}, {_REQUESTS} SELECT r.pos, r.key, s.value, s.key IS NOT NULL AS found FROM requests r LEFT JOIN state s USING (key)")
def batch_get_positional(spark, d):
    orders = orders_state(spark, d)
    return state.batch_get(orders, _requests(orders))


@query(f"WITH {ORDERS}, {_REQUESTS} SELECT key, value FROM state WHERE key IN (SELECT key FROM requests)")
def batch_get_hits(spark, d):
    orders = orders_state(spark, d)
    return state.batch_get_hits(orders, _requests(orders))


@query("SELECT role, conv_id, turn, text FROM conversations QUALIFY row_number() OVER (PARTITION BY role ORDER BY conv_id DESC, turn DESC) = 1")
def put_upsert(spark, d):
    c = table(spark, d, "conversations")
    log = c.select(F.col("role").alias("key"), F.struct("conv_id", "turn").alias("seq"), F.lit(0).alias("op"), F.col("text").alias("value"))
    return state.visible_state(log).select(F.col("key").alias("role"), "seq.conv_id", "seq.turn", F.col("value").alias("text"))


_PREFIX = "kept AS (SELECT * FROM conversations QUALIFY max((turn % 5 = 4)::INT) OVER (PARTITION BY conv_id ORDER BY turn) = 0)"


@query(f"WITH {_PREFIX} SELECT conv_id, turn, role FROM kept")
def batch_put_prefix(spark, d):
    return ingest.batch_prefix(table(spark, d, "conversations"), "conv_id", "turn", F.col("turn") % 5 == 4).select("conv_id", "turn", "role")


@query(f"WITH {_PREFIX} SELECT conv_id, role, turn, text FROM kept QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) = 1")
def batch_put_merge(spark, d):
    kept = ingest.batch_prefix(table(spark, d, "conversations"), "conv_id", "turn", F.col("turn") % 5 == 4)
    return ingest.merged_batch(kept, "conv_id", "turn", "role").select("conv_id", "role", "turn", "text")


@query(f"WITH {ORDERS} SELECT key, value FROM state WHERE key >= 'order:0000000100' AND key < 'order:0000000500' ORDER BY key")
def scan_range(spark, d):
    return state.scan(orders_state(spark, d), "order:0000000100", "order:0000000500")


@query(f"WITH {ORDERS} SELECT key, value FROM state WHERE key >= 'order:0000000250' ORDER BY key LIMIT 100")
def scan_limit(spark, d):
    return state.scan(orders_state(spark, d), "order:0000000250", None, 100)


@query(f"WITH {ORDERS} SELECT key, value FROM state WHERE key >= 'order:0000000250' ORDER BY key")
def scan_unbounded(spark, d):
    return state.scan(orders_state(spark, d), "order:0000000250", None, 0)


# runs, levels and compaction


def _runs(spark, d) -> DataFrame:
    return runs.flush(events_log(spark, d), F.col("day"), level_of())


def _sized_runs(spark, d) -> DataFrame:
    """Runs whose values are the events' properties; tombstones have none."""
    log = events_log(spark, d)
    return runs.flush(log.withColumn("value", F.when(F.col("op") == 0, F.col("props"))), F.col("day"), level_of())


def _stats(spark, d) -> DataFrame:
    return runs.run_stats(_sized_runs(spark, d))


@query(f"WITH {RUNS} SELECT run, level, key, event_id, op, value FROM runs")
def flush_run(spark, d):
    return _runs(spark, d).select("run", "level", "key", "seq.event_id", "op", "value")


@query(f"WITH {STATS} SELECT * FROM stats")
def run_stats(spark, d):
    return _stats(spark, d)


@query(f"WITH {RUNS} SELECT key, op, value FROM runs WHERE run = 28 ORDER BY key")
def run_scan(spark, d):
    return _runs(spark, d).where("run = 28").orderBy("key").select("key", "op", "value")


@query(f"WITH {RUNS} SELECT run, key, op, value FROM runs WHERE key = 42")
def run_get(spark, d):
    return _runs(spark, d).where("key = 42").select("run", "key", "op", "value")


_MERGED = "merged AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY key ORDER BY level, run DESC) = 1)"


@query(f"WITH {RUNS}, {_MERGED} SELECT key, event_id, value FROM merged WHERE op = 0")
def multi_run_get(spark, d):
    return runs.multi_run_get(_runs(spark, d)).select("key", "seq.event_id", "value")


@query(f"WITH {RUNS}, {_MERGED.replace('FROM runs', 'FROM runs WHERE level <= 1')} SELECT key, event_id, op, value FROM merged")
def compaction_merge(spark, d):
    return runs.compact(_runs(spark, d).where("level <= 1"), bottom=False).select("key", "seq.event_id", "op", "value")


@query(f"WITH {RUNS}, {_MERGED.replace('FROM runs', 'FROM runs WHERE level <= 1')} SELECT key, op, value FROM merged")
def compaction_upper(spark, d):
    """Level 2 lies below, so tombstones stay."""
    return runs.compact(_runs(spark, d).where("level <= 1"), bottom=False).select("key", "op", "value")


@query(f"WITH {RUNS}, {_MERGED} SELECT key, op, value FROM merged WHERE op = 0")
def compaction_bottom(spark, d):
    return runs.compact(_runs(spark, d), bottom=True).select("key", "op", "value")


@query(f"WITH {RUNS}, {_MERGED} SELECT key, event_id, value FROM merged WHERE op = 0")
def compaction_invariance(spark, d):
    """Levels 0 and 1 compacted into one run of level 1: reads give what they gave before."""
    every = _runs(spark, d)
    upper = runs.compact(every.where("level <= 1"), bottom=False).select(F.lit(100).alias("run"), F.lit(1).alias("level"), "key", "seq", "op", "value")
    return runs.multi_run_get(upper.unionByName(every.where("level = 2"))).select("key", "seq.event_id", "value")


@query(f"WITH {STATS} SELECT a.run AS run_a, b.run AS run_b FROM stats a JOIN stats b ON b.max_key >= a.min_key AND b.min_key <= a.max_key WHERE a.level = 0 AND b.level = 1")
def overlap_join(spark, d):
    s = _stats(spark, d)
    return runs.overlaps(s.where("level = 0"), s.where("level = 1"))


@query(
    f"WITH {STATS}, z AS (SELECT min(min_key) AS lo, max(max_key) AS hi FROM stats WHERE level = 0)"
    " SELECT run, level, 1 AS output_level FROM stats WHERE level = 0 AND (SELECT count(*) FROM stats WHERE level = 0) >= 4"
    " UNION ALL SELECT run, level, 1 FROM stats, z WHERE level = 1 AND max_key >= lo AND min_key <= hi AND (SELECT count(*) FROM stats WHERE level = 0) >= 4"
)
def compaction_pick(spark, d):
    return runs.pick_compaction(_stats(spark, d))


@query(
    f"WITH {STATS}, {_MERGED.replace('FROM runs', 'FROM runs WHERE level <= 1')} SELECT run, level, min_key, max_key, entries, tombstones, bytes FROM stats WHERE level = 2"
    " UNION ALL SELECT 100, 1, min(key), max(key), count(*), sum(op)::BIGINT, sum(9 + strlen(key::VARCHAR) + CASE WHEN op = 0 THEN coalesce(strlen(props), 0) ELSE 0 END)::BIGINT FROM merged"
)
def manifest_apply(spark, d):
    every, manifest = _sized_runs(spark, d), _stats(spark, d)
    picked = runs.pick_compaction(manifest)
    merged = runs.compact(every.join(picked.select("run"), "run", "left_semi"), bottom=False)
    output = runs.run_stats(merged.select(F.lit(100).alias("run"), F.lit(1).alias("level"), "key", "seq", "op", "value"))
    return runs.apply_compaction(manifest, picked, output)


@query(f"WITH {STATS} SELECT level, count(*) AS runs, sum(bytes)::BIGINT AS bytes, CASE WHEN level > 0 THEN (10485760 * pow(10, level - 1))::BIGINT END AS target FROM stats GROUP BY level")
def level_sizes(spark, d):
    return runs.level_sizes(_stats(spark, d))


_DOCS = "docs AS (SELECT lang, doc_id, 9 + strlen(doc_id::VARCHAR) + strlen(text) AS size, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents)"


def _folded(limit: int, over: bool) -> str:
    closes = f"f.total + d.size {'>' if over else '>='} {limit}"
    first = f"d.size {'>' if over else '>='} {limit}"
    return (
        f"{_DOCS}, f AS (SELECT lang, doc_id, size, rn, 0::BIGINT AS cut, CASE WHEN {first} THEN 1::BIGINT ELSE 0::BIGINT END AS next_cut, CASE WHEN {first} THEN 0::BIGINT ELSE d.size::BIGINT END AS total FROM docs d WHERE rn = 1"
        f" UNION ALL SELECT d.lang, d.doc_id, d.size, d.rn, f.next_cut, CASE WHEN {closes} THEN f.next_cut + 1 ELSE f.next_cut END, CASE WHEN {closes} THEN 0 ELSE f.total + d.size END"
        " FROM f JOIN docs d ON d.lang = f.lang AND d.rn = f.rn + 1)"
    )


def _doc_entries(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    size = F.lit(9) + F.octet_length(F.col("doc_id").cast("string")) + F.coalesce(F.octet_length("text"), F.lit(0))
    return docs.select("lang", "doc_id", size.cast("long").alias("size"))


@query(f"WITH RECURSIVE {_folded(65536, False)} SELECT lang, cut AS segment, count(*) AS entries, sum(size)::BIGINT AS bytes FROM f GROUP BY lang, cut")
def flush_segments(spark, d):
    """Memtables of 64 KiB: which entries go to which flush."""
    cut = folds.greedy_cuts(_doc_entries(spark, d), ["lang"], ["doc_id"], F.col("size"), 65536)
    return cut.groupBy("lang", F.col("cut").alias("segment")).agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"))


_BLOCKS = f"{_folded(4096, False)}, b AS (SELECT lang, cut AS block, max(doc_id) AS last_key, count(*) AS entries, sum(size)::BIGINT AS length FROM f GROUP BY lang, cut)"


@query(f"WITH RECURSIVE {_BLOCKS} SELECT *, coalesce(sum(length) OVER (PARTITION BY lang ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM b")
def block_index(spark, d):
    return runs.block_index(_doc_entries(spark, d), ["lang"], "doc_id", F.col("size"))


@query(
    f"WITH RECURSIVE {_BLOCKS}, k AS (SELECT lang, doc_id AS key FROM documents UNION SELECT lang, doc_id + 1 FROM documents)"
    " SELECT k.lang, k.key, min(b.block) AS block FROM k LEFT JOIN b ON b.lang = k.lang AND b.last_key >= k.key GROUP BY ALL"
)
def block_lookup(spark, d):
    """Every key and the one after it, which is mostly another language's."""
    docs = _doc_entries(spark, d)
    asked = docs.select("lang", F.col("doc_id").alias("key")).unionByName(docs.select("lang", (F.col("doc_id") + 1).alias("key")))
    return runs.block_lookup(runs.block_index(docs, ["lang"], "doc_id", F.col("size")), asked, ["lang"])


@query(f"WITH RECURSIVE {_folded(131072, True)} SELECT lang, cut AS file, min(doc_id) AS min_key, max(doc_id) AS max_key, sum(size)::BIGINT AS bytes FROM f GROUP BY lang, cut")
def output_split(spark, d):
    cut = runs.split_outputs(_doc_entries(spark, d), ["lang"], ["doc_id"], F.col("size"), 131072)
    return cut.groupBy("lang", F.col("cut").alias("file")).agg(F.min("doc_id").alias("min_key"), F.max("doc_id").alias("max_key"), F.sum("size").alias("bytes"))


def _le_sql(x: str, size: int) -> str:
    return "(" + " || ".join(f"printf('%02X', ({x} >> {8 * i}) & 255)" for i in range(size)) + ")"


@query(
    f"WITH RECURSIVE {_BLOCKS}, z AS (SELECT lang, sum(length)::BIGINT AS index_offset, (4 + sum(4 + strlen(last_key::VARCHAR) + 12))::BIGINT AS index_length FROM b GROUP BY lang)"
    f" SELECT lang, index_offset, index_length, {_le_sql('index_offset', 8)} || {_le_sql('index_length', 8)} || {_le_sql(str(RUN_MAGIC), 8)} AS footer, true AS ok FROM z"
)
def footer_check(spark, d):
    blocks = runs.block_index(_doc_entries(spark, d), ["lang"], "doc_id", F.col("size"))
    entry = F.octet_length(codec.index_entry(F.col("last_key").cast("string"), F.col("offset"), F.col("length")))
    z = blocks.groupBy("lang").agg(F.sum("length").alias("index_offset"), (F.lit(4) + F.sum(entry)).cast("long").alias("index_length"))
    z = z.withColumn("raw", codec.footer(F.col("index_offset"), F.col("index_length"))).withColumn("f", codec.decode_footer(F.col("raw")))
    return z.select("lang", "f.index_offset", "f.index_length", F.hex("raw").alias("footer"), "f.ok")


# placement on a ring

_R3, _R4 = ring_sql(NODES, "r3"), ring_sql([*NODES, "node4"], "r4")


@query(f"WITH {CRC}, {_R3} SELECT h AS hash, node FROM r3")
def ring_build(spark, d):
    return ring_ops.points(spark, RING)


@query(f"WITH {CRC}, {_R3} SELECT node, count(*) AS points FROM r3 GROUP BY node")
def ring_nodes(spark, d):
    return ring_ops.points(spark, RING).groupBy("node").agg(F.count("*").alias("points"))


@query(f"WITH {CRC}, {ring_sql(['node1', 'node3'], 'r2')} SELECT h AS hash, node FROM r2")
def ring_remove(spark, d):
    smaller = ring_ops.Ring(NODES)
    smaller.remove("node2")
    return ring_ops.points(spark, smaller)


@query(f"WITH {CRC}, {_R3}, {KEYS}, {routed_sql('r3', 'routed')} SELECT key, h AS hash, node FROM routed")
def ring_route(spark, d):
    return ring_ops.route(ring_keys(spark, d), RING).select("key", "hash", "node")


@query(f"WITH {CRC}, {_R3}, {KEYS}, {routed_sql('r3', 'routed')} SELECT key, node = 'node1' AS is_local FROM routed")
def ring_is_local(spark, d):
    return ring_ops.route(ring_keys(spark, d), RING).select("key", ring_ops.is_local("node", "node1").alias("is_local"))


@query(f"WITH {CRC}, {_R3}, {KEYS}, {routed_sql('r3', 'routed')} SELECT node, count(*) AS keys FROM routed GROUP BY node")
def ring_distribution(spark, d):
    return ring_ops.distribution(ring_ops.route(ring_keys(spark, d), RING))


@query(
    f"WITH {CRC}, {_R3}, {KEYS}, {routed_sql('r3', 'routed')} SELECT r.node, o.o_orderstatus AS status, count(*) AS writes FROM routed r JOIN orders o ON 'key' || o.o_orderkey = r.key GROUP BY ALL"
)
def routed_counts(spark, d):
    """Writes by owner: puts (O, F) and deletes (P)."""
    o = table(spark, d, "orders").select(F.concat(F.lit("key"), F.col("o_orderkey").cast("string")).alias("key"), F.col("o_orderstatus").alias("status"))
    return ring_ops.route(o, RING).groupBy("node", "status").agg(F.count("*").alias("writes"))


@query(
    f"WITH {CRC}, {_R3}, {_R4}, {KEYS}, {routed_sql('r3', 'a')}, {routed_sql('r4', 'b')} SELECT a.node AS from_node, b.node AS to_node, count(*) AS keys FROM a JOIN b USING (key) WHERE a.node <> b.node GROUP BY ALL"
)
def ring_migration(spark, d):
    return ring_ops.migration(ring_keys(spark, d), RING, GROWN)


@query(
    f"WITH {CRC}, {_R4}, {KEYS}, "
    # distance from each key to each node's nearest point clockwise; the nodes in that order
    "sp AS (SELECT node, list_sort(list(h)) AS hs FROM r4 GROUP BY node), "
    "near AS (SELECT k.key, s.node, coalesce(list_min(list_filter(s.hs, lambda x: x >= k.h)) - k.h, s.hs[1] + 4294967296 - k.h) AS dist FROM keys k, sp s) "
    "SELECT key, array_to_string(list(node ORDER BY dist)[1:3], ',') AS replicas FROM near GROUP BY key"
)
def ring_replicas(spark, d):
    return ring_ops.route(ring_keys(spark, d), GROWN).select("key", F.array_join(F.slice("replicas", 1, 3), ",").alias("replicas"))


# codecs


def _customers(spark, d) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.col("c_name").alias("key"), F.concat("c_name", F.lit("/"), "c_mktsegment").alias("value"), (F.col("c_custkey") % 4 == 3).alias("tombstone"))


_BODY = (
    "n AS (SELECT c_custkey, c_name AS key, c_name || '/' || c_mktsegment AS value, c_custkey % 4 = 3 AS tombstone FROM customer), "
    f"body AS (SELECT *, (CASE WHEN tombstone THEN '01' ELSE '00' END) || {_le_sql('strlen(key)', 4)} || {_le_sql('strlen(value)', 4)} || hex(key::BLOB) || hex(value::BLOB) AS b FROM n)"
)
_RECORD = f"{CRC}, {_BODY}, rec AS (SELECT *, {crc_sql(bytes_sql('b'))} AS c FROM body, crc_table)"


@query(f"WITH {_RECORD} SELECT c_custkey, {_le_sql('c', 4)} || b AS record FROM rec")
def wal_encode(spark, d):
    return _customers(spark, d).select("c_custkey", F.hex(codec.log_record(F.col("key"), F.col("value"), F.col("tombstone"))).alias("record"))


@query(f"WITH {_BODY} SELECT c_custkey, true AS ok, tombstone, key, value FROM n")
def wal_roundtrip(spark, d):
    raw = _customers(spark, d).select("c_custkey", codec.log_record(F.col("key"), F.col("value"), F.col("tombstone")).alias("record"))
    return raw.select("c_custkey", codec.decode_log_record(F.col("record")).alias("r")).select("c_custkey", "r.ok", "r.tombstone", F.col("r.key").cast("string").alias("key"), F.col("r.value").cast("string").alias("value"))


@query(f"WITH {_BODY} SELECT c_custkey, key FROM n WHERE c_custkey < (SELECT max(c_custkey) - 17 FROM n)")
def wal_torn_tail(spark, d):
    """The record 17 before the last is damaged: what comes before it is read, nothing after."""
    last = table(spark, d, "customer").agg((F.max("c_custkey") - 17).alias("damaged"))
    n = _customers(spark, d).join(F.broadcast(last)).withColumn("record", codec.log_record(F.col("key"), F.col("value"), F.col("tombstone")))
    damaged = F.concat(F.col("record").substr(F.lit(1), F.octet_length("record") - 1), F.lit(b"\x00"))
    n = n.withColumn("stored", F.when(F.col("c_custkey") == F.col("damaged"), damaged).otherwise(F.col("record")))
    read = n.select("c_custkey", codec.decode_log_record(F.col("stored")).alias("r"))
    first_bad = read.where("NOT r.ok").agg(F.min("c_custkey").alias("stop"))
    return read.join(F.broadcast(first_bad)).where("stop IS NULL OR c_custkey < stop").select("c_custkey", F.col("r.key").cast("string").alias("key"))


@query(f"WITH {_BODY} SELECT c_custkey, b AS entry FROM body")
def sst_entry_encode(spark, d):
    return _customers(spark, d).select("c_custkey", F.hex(codec.run_entry(F.col("key"), F.col("value"), F.col("tombstone"))).alias("entry"))


def _be_sql(x: str) -> str:
    return f"printf('%08X', {x})"


@query(
    f"WITH {_BODY} SELECT c_custkey, (CASE WHEN tombstone THEN '01' ELSE '00' END) || {_be_sql('strlen(key)')} || hex(key::BLOB) || {_be_sql('strlen(value)')} || hex(value::BLOB) AS command, NULL::VARCHAR AS error, tombstone::INT AS op, key, value FROM n"
)
def command_roundtrip(spark, d):
    raw = _customers(spark, d).select("c_custkey", codec.command(F.col("tombstone").cast("int"), F.col("key"), F.col("value")).alias("c"))
    read = raw.select("c_custkey", F.hex("c").alias("command"), codec.decode_command(F.col("c")).alias("r"))
    return read.select("c_custkey", "command", F.col("r.error").cast("string").alias("error"), "r.op", F.col("r.key").cast("string").alias("key"), F.col("r.value").cast("string").alias("value"))


# replicated logs


def _before_end(log: DataFrame, n: int) -> int:
    """The index n entries before the last."""
    return replog.tail(log).first()["last_index"] - n


@query(f"WITH {LOG}, z AS (SELECT max(index) AS n FROM rlog) SELECT index, term, key, op, value FROM rlog UNION ALL SELECT n + 1 + n_nationkey, 99, n_nationkey::BIGINT, 0, 1.5 FROM nation, z")
def log_append(spark, d):
    new = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("pos"), F.col("n_nationkey").cast("long").alias("key"), F.lit(0).alias("op"), F.lit(1.5).alias("value"))
    return replog.append(orders_log(spark, d), new, 99)


@query(f"WITH {LOG} SELECT max(index) AS last_index, arg_max(term, index) AS last_term FROM rlog")
def log_tail(spark, d):
    return replog.tail(orders_log(spark, d))


@query(f"WITH {LOG}, p(peer, next_index) AS (SELECT 'n' || r_regionkey, (SELECT max(index) FROM rlog) - 10 * r_regionkey FROM region) SELECT peer, index, term FROM p JOIN rlog ON index >= next_index")
def log_pending(spark, d):
    log = orders_log(spark, d)
    peers = table(spark, d, "region").join(F.broadcast(replog.tail(log))).select(F.concat(F.lit("n"), F.col("r_regionkey").cast("string")).alias("peer"), (F.col("last_index") - 10 * F.col("r_regionkey")).alias("next_index"))
    return replog.pending(log, peers)


@query(f"WITH {LOG} SELECT key, index, value FROM (SELECT * FROM rlog WHERE index <= (SELECT max(index) - 300 FROM rlog) QUALIFY row_number() OVER (PARTITION BY key ORDER BY index DESC) = 1) WHERE op = 0")
def log_apply(spark, d):
    """All but the last 300 entries are committed."""
    log = orders_log(spark, d)
    return replog.apply(log, F.lit(_before_end(log, 300)))


@query(f"WITH {LOG} SELECT count(*) > 1000 AS due, count(*) AS entries FROM rlog")
def log_should_snapshot(spark, d):
    return replog.should_snapshot(orders_log(spark, d))


@query(
    f"WITH {LOG}, s AS (SELECT key, index, value FROM (SELECT * FROM rlog WHERE index <= (SELECT max(index) - 500 FROM rlog) QUALIFY row_number() OVER (PARTITION BY key ORDER BY index DESC) = 1) WHERE op = 0)"
    " SELECT 'state' AS part, key, index, value FROM s UNION ALL SELECT 'log', key, index, value FROM rlog WHERE index >= (SELECT max(index) - 500 FROM rlog)"
)
def log_snapshot(spark, d):
    log = orders_log(spark, d)
    kept, rest = replog.snapshot(log, _before_end(log, 500))
    cols = ["key", "index", "value"]
    return kept.select(F.lit("state").alias("part"), *cols).unionByName(rest.select(F.lit("log").alias("part"), *cols))


@query(f"WITH {LOG} SELECT key, index, value FROM (SELECT * FROM rlog QUALIFY row_number() OVER (PARTITION BY key ORDER BY index DESC) = 1) WHERE op = 0")
def snapshot_plus_tail(spark, d):
    log = orders_log(spark, d)
    at = _before_end(log, 500)
    return replog.restore(replog.apply(log, F.lit(at)), log, at)


@query(
    f"WITH {LOG}, q(request, prev_index, prev_term) AS (VALUES (1, 0::BIGINT, 0::BIGINT), (2, 700, 2), (3, 700, 9), (4, 100000000, 5), (5, 1200, 3)), t AS (SELECT max(index) AS n FROM rlog)"
    " SELECT request, prev_index = 0 OR coalesce(l.term = prev_term, false) AS ok,"
    " CASE WHEN prev_index > 0 AND l.term IS NULL THEN n + 1 WHEN l.term <> prev_term THEN (SELECT min(index) FROM rlog x WHERE x.term = l.term) END AS conflict_index,"
    " CASE WHEN l.term <> prev_term THEN l.term END AS conflict_term FROM q LEFT JOIN rlog l ON l.index = prev_index, t"
)
def log_prev_check(spark, d):
    asked = spark.createDataFrame([(1, 0, 0), (2, 700, 2), (3, 700, 9), (4, 100000000, 5), (5, 1200, 3)], "request int, prev_index long, prev_term long")
    return replog.previous_matches(orders_log(spark, d), asked)


@query(
    f"WITH {LOG}, e AS (SELECT max(index) AS n FROM rlog), own AS (SELECT index, CASE WHEN index > n - 600 THEN 1 ELSE term END AS term FROM rlog, e WHERE index <= n - 500), sent AS (SELECT index, term FROM rlog, e WHERE index BETWEEN n - 700 AND n - 400)"
    " SELECT index, term FROM own WHERE index < (SELECT min(o.index) FROM own o JOIN sent s USING (index) WHERE o.term <> s.term) UNION ALL SELECT index, term FROM sent"
    " WHERE index >= (SELECT min(o.index) FROM own o JOIN sent s USING (index) WHERE o.term <> s.term)"
)
def log_conflict_truncate(spark, d):
    """A follower that ends 500 entries before the leader, with 100 of an old term at its end, gets the 300 around them."""
    log = orders_log(spark, d).select("index", "term")
    n = _before_end(log, 0)
    own = log.where(F.col("index") <= n - 500).withColumn("term", F.when(F.col("index") > n - 600, 1).otherwise(F.col("term")))
    return replog.accept(own, log.where(F.col("index").between(n - 700, n - 400)))


_MATCH = "m AS (SELECT key % 5 AS peer, max(index) AS match_index FROM rlog GROUP BY peer)"


def _matches(log: DataFrame) -> DataFrame:
    return log.groupBy((F.col("key") % 5).alias("peer")).agg(F.max("index").alias("match_index"))


@query(f"WITH {LOG}, {_MATCH}, r AS (SELECT list_reverse_sort(list(match_index))[count(*) // 2 + 1] AS i FROM m) SELECT greatest(coalesce(max(index), 0), 10)::BIGINT AS commit_index FROM r JOIN rlog ON index = i WHERE term = (SELECT max(term) FROM rlog)")
def commit_index(spark, d):
    log = orders_log(spark, d)
    term = replog.tail(log).first()["last_term"]
    return replog.commit_index(log, _matches(log), term, 10)


_VOTES = f"{LOG}, {_MATCH}, v AS (SELECT m.peer, c.peer AS candidate, (c.match_index // 500 > m.match_index // 500) OR (c.match_index // 500 = m.match_index // 500 AND c.match_index >= m.match_index) AS granted FROM m, m c)"


def _votes(log: DataFrame) -> DataFrame:
    m = _matches(log)
    term = F.floor(F.col("match_index") / 500)
    voters = m.select(F.col("peer"), F.lit(9).alias("own_term"), F.lit(None).cast("long").alias("voted_for"), F.col("match_index").alias("own_last_index"), term.alias("own_last_term"))
    candidates = m.select(F.col("peer").alias("candidate"), F.lit(9).alias("term"), F.col("match_index").alias("last_index"), term.alias("last_term"))
    return replog.vote(voters.join(F.broadcast(candidates)))  # nodes by nodes: five by five


@query(f"WITH {_VOTES} SELECT candidate, peer, granted FROM v")
def vote_up_to_date(spark, d):
    return _votes(orders_log(spark, d)).select("candidate", "peer", "granted")


@query(f"WITH {_VOTES} SELECT candidate, sum(granted::INT)::BIGINT AS votes, sum(granted::INT) >= 3 AS elected FROM v GROUP BY candidate")
def election_tally(spark, d):
    return replog.tally(_votes(orders_log(spark, d)), 5)


# workloads and streams


@query(
    "WITH ops AS (SELECT o_orderkey AS i, CASE WHEN o_orderkey % 10 < 7 THEN (o_orderkey * 37) % 5000 ELSE o_orderkey % 5000 END AS key, o_orderkey % 10 < 7 AS is_get, o_totalprice AS value FROM orders)"
    " SELECT i, key, last_value(CASE WHEN NOT is_get THEN value END IGNORE NULLS) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS value FROM ops QUALIFY is_get"
)
def mixed_workload(spark, d):
    """7 of 10 operations get, 3 put, over 5,000 keys: what each get finds."""
    from pyspark.sql import Window

    i = F.col("o_orderkey")
    ops = table(spark, d, "orders").select(i.alias("i"), F.when(i % 10 < 7, (i * 37) % 5000).otherwise(i % 5000).alias("key"), (i % 10 < 7).alias("is_get"), F.col("o_totalprice").alias("put"))
    before = Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.when(~F.col("is_get"), F.col("put")), ignorenulls=True).over(before)
    return ops.withColumn("value", seen).where("is_get").select("i", "key", "value")


@query(f"WITH {LATEST} SELECT key, event_id, value FROM latest WHERE op = 0")
def stream_latest(spark, d):
    """The events as a stream in update mode; the last update of each key."""
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    raw = stream.read_changes(spark, path if spark.read.parquet(path).inputFiles()[0].rstrip("/").rsplit("/", 2)[-2] == "events.parquet" else f"{d}/event[s].parquet", schema)
    log = raw.select(F.col("user_id").alias("key"), F.struct(F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id").alias("seq"), (F.col("event_type") == "error").cast("int").alias("op"), "value", "event_id")
    updates = stream.updates_on_files(stream.latest_updates(log, ("event_id",)).select("key", "seq", "op", "value"))
    return stream.settled(updates).select("key", "seq.event_id", "value")
