"""State as a view of a change log: latest versions, lookups, scans, points in time.

A log has columns key, seq, op and value; key and value may be of any type that has an
order, seq a long or a struct. seq must order a key's versions totally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DELETE, PUT


def latest_version(log: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row for each key, its latest version, tombstones included.

    Partial aggregation keeps one version of a key for each task before the shuffle, so
    a hot key costs one row a task.
    """
    fields = ["seq", "op", "value", *extra]
    return log.groupBy("key").agg(F.max_by(F.struct(*fields), "seq").alias("w")).select("key", *[F.col(f"w.{f}").alias(f) for f in fields])


def visible_state(log: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Latest versions that are no tombstones."""
    return latest_version(log, extra).where(F.col("op") == PUT)


def as_of(log: DataFrame, upto: Column) -> DataFrame:
    """The part of the log that a snapshot at ``upto`` sees."""
    return log.where(F.col("seq") <= upto)


def get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, value, found) of distinct keys: a tombstone and a missing key are not found, an empty value is."""
    asked = keys.select("key").distinct()
    state = latest_version(log.join(asked, "key", "left_semi"))
    hit = F.coalesce(F.col("op") == PUT, F.lit(False))
    return asked.join(state, "key", "left").select("key", F.when(hit, F.col("value")).alias("value"), hit.alias("found"))


def raw_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, found, tombstone, value): tombstones count as found here."""
    asked = keys.select("key").distinct()
    state = latest_version(log.join(asked, "key", "left_semi"))
    return asked.join(state, "key", "left").select("key", F.col("op").isNotNull().alias("found"), F.coalesce(F.col("op") == DELETE, F.lit(False)).alias("tombstone"), "value")


def batch_get(state: DataFrame, requests: DataFrame) -> DataFrame:
    """(pos, key, value, found) for each requested position, repeats and misses included."""
    hits = state.join(requests.select("key").distinct(), "key", "left_semi").select("key", "value", F.lit(True).alias("_hit"))
    return requests.join(hits, "key", "left").select("pos", "key", "value", F.coalesce("_hit", F.lit(False)).alias("found"))


def batch_get_hits(state: DataFrame, requests: DataFrame) -> DataFrame:
    """(key, value) of the requested keys that are there, each once."""
    return state.join(requests.select("key"), "key", "left_semi").select("key", "value")


def scan(state: DataFrame, start=None, end=None, limit: int = 0) -> DataFrame:
    """(key, value) with start <= key < end in key order; limit 0 is no limit."""
    rows = state.select("key", "value")
    if start is not None:
        rows = rows.where(F.col("key") >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col("key") < F.lit(end))
    rows = rows.orderBy("key")
    return rows.limit(limit) if limit > 0 else rows


def state_size(log: DataFrame) -> DataFrame:
    """One row: bytes of the keys and values of the latest versions."""
    return latest_version(log).agg(F.coalesce(F.sum(F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))), F.lit(0)).cast("long").alias("bytes"))


def ordered_versions(log: DataFrame) -> DataFrame:
    """Latest versions in key order, tombstones included."""
    return latest_version(log).orderBy("key")


def truncated(log: DataFrame, covered: Column) -> DataFrame:
    """What is left of a log once runs hold everything up to ``covered``."""
    return log.where(F.col("seq") > covered)
