"""Checks and numbering of writes before they are appended to the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DELETE, PUT, EmptyKeyError


def is_bad(key: str = "key"):
    return F.col(key).isNull() | (F.octet_length(key) == 0)


def require_keys(rows: DataFrame) -> DataFrame:
    """rows, or EmptyKeyError if any key is empty. One small job."""
    if rows.where(is_bad()).limit(1).count():
        raise EmptyKeyError("key cannot be empty")
    return rows


def puts(rows: DataFrame) -> DataFrame:
    """(key, seq, value) to log rows."""
    return rows.select("key", "seq", F.lit(PUT).cast("byte").alias("op"), "value")


def deletes(rows: DataFrame) -> DataFrame:
    """(key, seq) to tombstones; a key need not be there to be deleted."""
    return rows.select("key", "seq", F.lit(DELETE).cast("byte").alias("op"), F.lit(None).cast("binary").alias("value"))


def batch_prefix(items: DataFrame, batch: str, pos: str, bad) -> DataFrame:
    """The items of each batch before its first bad one, as a batch is put in order and stops there."""
    first_bad = items.where(bad).groupBy(batch).agg(F.min(pos).alias("_stop"))
    return items.join(first_bad, batch, "left").where(F.col("_stop").isNull() | (F.col(pos) < F.col("_stop"))).drop("_stop")


def merged_batch(items: DataFrame, batch: str, pos: str, key: str) -> DataFrame:
    """The last item of each key of each batch."""
    rest = [c for c in items.columns if c not in (batch, key)]
    return items.groupBy(batch, key).agg(F.max_by(F.struct(*rest), pos).alias("w")).select(batch, key, "w.*")


def from_map(pairs: dict[bytes, bytes]) -> list[tuple[bytes, bytes, int]]:
    """A map of puts as (key, value, position); its order carries no meaning, keys are distinct."""
    return [(k, v, i) for i, (k, v) in enumerate(pairs.items())]


def numbered(rows: DataFrame, by: str, first_seq: int) -> DataFrame:
    """seq from first_seq on for a batch in the order of ``by``, which is distinct in it.

    Ranks come from counts of range partitions, not from one sorted task.
    """
    ranged = rows.repartitionByRange(by).sortWithinPartitions(by).withColumn("_part", F.spark_partition_id())
    sizes = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0
    for p in sorted(sizes):
        before[p] = total
        total += sizes[p]
    if not before:
        return rows.withColumn("seq", F.lit(None).cast("long"))
    offset = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col("_part")]
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(by))
    return ranged.withColumn("seq", (F.lit(first_seq - 1) + offset + nth).cast("long")).drop("_part")
