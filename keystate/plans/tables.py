"""The driver tables seen as the model's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ring as ring_ops


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events_log(spark: SparkSession, d: str) -> DataFrame:
    """A change log: key user_id, ordered by (ts, event_id); an error deletes."""
    e = table(spark, d, "events")
    return e.select(
        F.col("user_id").alias("key"),
        F.struct(F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id").alias("seq"),
        (F.col("event_type") == "error").cast("int").alias("op"),
        "value",
        "props",
        "event_id",
        F.dayofmonth("ts").alias("day"),
    )


EVENTS = "log AS (SELECT user_id AS key, ts, event_id, (event_type = 'error')::INT AS op, value, props, day(ts)::INT AS day FROM events)"
LATEST = EVENTS + ", latest AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) = 1)"


def level_of(day="day"):
    return F.when(F.col(day) >= 27, 0).when(F.col(day) >= 21, 1).otherwise(2)


RUNS = EVENTS + (
    ", runs AS (SELECT day AS run, CASE WHEN day >= 27 THEN 0 WHEN day >= 21 THEN 1 ELSE 2 END AS level, key, ts, event_id, op, value, props FROM log"
    " QUALIFY row_number() OVER (PARTITION BY day, key ORDER BY ts DESC, event_id DESC) = 1)"
)
STATS = RUNS + (
    ", stats AS (SELECT run, level, min(key) AS min_key, max(key) AS max_key, count(*) AS entries, sum(op)::BIGINT AS tombstones,"
    " sum(9 + strlen(key::VARCHAR) + CASE WHEN op = 0 THEN coalesce(strlen(props), 0) ELSE 0 END)::BIGINT AS bytes FROM runs GROUP BY run, level)"
)


def orders_state(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.format_string("order:%010d", F.col("o_orderkey")).alias("key"), F.col("o_orderstatus").alias("value"), "o_orderkey")


ORDERS = "state AS (SELECT printf('order:%010d', o_orderkey) AS key, o_orderstatus AS value, o_orderkey FROM orders)"


def orders_log(spark: SparkSession, d: str) -> DataFrame:
    """A replicated log: index from the order key, a new term every 500 entries; status P deletes."""
    o = table(spark, d, "orders")
    index = F.col("o_orderkey") + 1
    return o.select(
        index.alias("index"), (F.floor((index - 1) / 500) + 1).alias("term"), F.col("o_custkey").alias("key"), (F.col("o_orderstatus") == "P").cast("int").alias("op"), F.col("o_totalprice").alias("value")
    )


LOG = "rlog AS (SELECT o_orderkey + 1 AS index, o_orderkey // 500 + 1 AS term, o_custkey AS key, (o_orderstatus = 'P')::INT AS op, o_totalprice AS value FROM orders)"

NODES = ["node1", "node2", "node3"]
RING = ring_ops.Ring(NODES)
GROWN = ring_ops.Ring([*NODES, "node4"])

# CRC-32 in SQL: the table of a byte's remainders, then a fold over the bytes of a blob's hex digits.
CRC = """crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t
)"""


def crc_sql(bytes_list: str) -> str:
    """CRC-32 of a list of byte values, with crc_table in scope as t."""
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform({bytes_list}, lambda q: q::BIGINT)), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295)"


def bytes_sql(hex_text: str) -> str:
    """A hex text's bytes as a list of numbers."""
    return f"list_transform(range(0, strlen({hex_text}), 2), lambda i: ('0x' || substr({hex_text}, (i + 1)::BIGINT, 2))::BIGINT)"


def ring_sql(nodes: list[str], name: str, points: int = 150) -> str:
    """A ring's points (h, node) as a common table expression; needs crc_table."""
    listed = ", ".join(f"('{n}')" for n in nodes)
    suffix = "CASE WHEN i < 128 THEN printf('%02X', i) ELSE printf('C2%02X', i) END"
    h = crc_sql(bytes_sql("hx"))
    return (
        f"{name}_raw AS (SELECT n.node, i, hex(n.node::BLOB) || '23' || {suffix} AS hx FROM (VALUES {listed}) n(node), range({points}) r(i)), "
        f"{name} AS (SELECT node, {h} AS h FROM {name}_raw, crc_table)"
    )


KEYS = "keys AS (SELECT 'key' || o_orderkey AS key, " + crc_sql(bytes_sql("hex(('key' || o_orderkey)::BLOB)")) + " AS h FROM orders, crc_table)"


def routed_sql(ring: str, out: str) -> str:
    """keys with the owner of each: the first point at or after, around the end to the first."""
    return (
        f"{out} AS (SELECT k.key, k.h, coalesce(r.node, (SELECT arg_min(node, h) FROM {ring})) AS node "
        f"FROM keys k ASOF LEFT JOIN {ring} r ON k.h <= r.h)"
    )


def ring_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.concat(F.lit("key"), F.col("o_orderkey").cast("string")).alias("key"))
