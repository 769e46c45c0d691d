"""Sorted runs and levels: flush, statistics, reads over runs of different age, compaction.

A run table has columns run, level, key, seq, op and value, one version of a key in a
run. Younger runs win: level 0 from the highest run down, then levels 1 and deeper.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import BASE_LEVEL_BYTES, BLOCK_BYTES, DELETE, ENTRY_HEADER_BYTES, L0_TRIGGER, LEVEL_FACTOR, MAX_LEVELS, OUTPUT_BYTES, PUT
from .folds import greedy_cuts

#: Blocks of an index that are sent to all tasks, at most (some 50 bytes each).
MOST_SENT = 200_000


def flush(log: DataFrame, run: Column, level: Column) -> DataFrame:
    """A log cut into runs: one version of a key in each, tombstones kept."""
    placed = log.withColumn("run", run).withColumn("level", level)
    return placed.groupBy("run", "level", "key").agg(F.max_by(F.struct("seq", "op", "value"), "seq").alias("w")).select("run", "level", "key", "w.seq", "w.op", "w.value")


def entry_bytes(key: str = "key", value: str = "value") -> Column:
    """Bytes of an entry in a run file."""
    return F.lit(ENTRY_HEADER_BYTES) + F.octet_length(F.col(key).cast("string")) + F.coalesce(F.octet_length(F.col(value).cast("string")), F.lit(0))


def run_stats(runs: DataFrame) -> DataFrame:
    """The manifest of runs: range of keys, entries, tombstones and bytes of each."""
    return runs.groupBy("run", "level").agg(
        F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("entries"), F.sum(F.col("op").cast("long")).alias("tombstones"), F.sum(entry_bytes()).cast("long").alias("bytes")
    )


def priority() -> Column:
    """Smaller is younger: the level, and in level 0 the higher run first. Deeper levels do not overlap."""
    return F.struct(F.col("level"), -F.col("run"))


def merged(runs: DataFrame) -> DataFrame:
    """The youngest version of each key over all runs, tombstones included."""
    return runs.groupBy("key").agg(F.min_by(F.struct("seq", "op", "value"), priority()).alias("w")).select("key", "w.seq", "w.op", "w.value")


def multi_run_get(runs: DataFrame) -> DataFrame:
    return merged(runs).where(F.col("op") == PUT)


def compact(inputs: DataFrame, bottom: bool) -> DataFrame:
    """Inputs merged to one version of a key. Tombstones go only at the bottom, where no
    older run can hold the key; anywhere else they must stay, or deletes are undone."""
    out = merged(inputs)
    return out.where(F.col("op") != DELETE) if bottom else out


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of runs of two manifests whose closed key ranges meet. Manifests are small."""
    x = a.select(F.col("run").alias("run_a"), F.col("min_key").alias("lo"), F.col("max_key").alias("hi"))
    y = b.select(F.col("run").alias("run_b"), "min_key", "max_key")
    return x.join(y, (F.col("max_key") >= F.col("lo")) & (F.col("min_key") <= F.col("hi"))).select("run_a", "run_b")


def level_target(level: Column) -> Column:
    return (F.lit(BASE_LEVEL_BYTES) * F.pow(F.lit(LEVEL_FACTOR), level - 1)).cast("long")


def level_sizes(manifest: DataFrame) -> DataFrame:
    """Bytes and runs of each level, and for levels from 1 the target."""
    return manifest.groupBy("level").agg(F.count("*").alias("runs"), F.sum("bytes").alias("bytes")).withColumn("target", F.when(F.col("level") > 0, level_target(F.col("level"))))


def pick_compaction(manifest: DataFrame, base: int = BASE_LEVEL_BYTES) -> DataFrame:
    """The next compaction as rows (run, level, output_level); none if nothing is due.

    From four runs in level 0, all of them with the runs of level 1 that they overlap.
    Else the first level at its target gives its first run by key, with those of the
    next level that it overlaps. The manifest is the table of runs, not of rows.
    """
    of = Window.partitionBy("level")
    m = manifest.withColumn("_n", F.count("*").over(of)).withColumn("_bytes", F.sum("bytes").over(of)).withColumn("_first", F.row_number().over(of.orderBy("min_key", "run")))
    target = F.lit(base) * F.pow(F.lit(LEVEL_FACTOR), F.col("level") - 1)
    due = ((F.col("level") == 0) & (F.col("_n") >= L0_TRIGGER)) | ((F.col("level") >= 1) & (F.col("level") < MAX_LEVELS - 1) & (F.col("_bytes") >= target))
    chosen = m.where(due).agg(F.min("level").alias("from_level"))
    pushed = m.join(chosen, F.col("level") == F.col("from_level")).where((F.col("level") == 0) | (F.col("_first") == 1))
    span = pushed.groupBy("from_level").agg(F.min("min_key").alias("lo"), F.max("max_key").alias("hi"))
    met = m.join(span, F.col("level") == F.col("from_level") + 1).where((F.col("max_key") >= F.col("lo")) & (F.col("min_key") <= F.col("hi")))
    return pushed.select("run", "level", (F.col("from_level") + 1).alias("output_level")).unionByName(met.select("run", "level", (F.col("from_level") + 1).alias("output_level")))


def apply_compaction(manifest: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """The next manifest: the inputs leave, the outputs come."""
    return manifest.join(inputs.select("run"), "run", "left_anti").select(*outputs.columns).unionByName(outputs)


def split_outputs(rows: DataFrame, group: list[str], order: list[str], size: Column, limit: int = OUTPUT_BYTES) -> DataFrame:
    """Output files of a compaction: a file is closed once it holds more than ``limit`` bytes."""
    return greedy_cuts(rows, group, order, size, limit, over=True)


def block_index(rows: DataFrame, group: list[str], order: str, size: Column, limit: int = BLOCK_BYTES) -> DataFrame:
    """(group, block, last_key, entries, length, offset): the sparse index of each group's entries in key order."""
    cut = greedy_cuts(rows.select(*group, order, size.alias("_bytes")), group, [order], F.col("_bytes"), limit)
    blocks = cut.groupBy(*group, F.col("cut").alias("block")).agg(F.max(order).alias("last_key"), F.count("*").alias("entries"), F.sum("_bytes").cast("long").alias("length"))
    before = Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def block_lookup(index: DataFrame, keys: DataFrame, group: list[str]) -> DataFrame:
    """The block of each (group, key) that can hold it: the first whose last key is not
    below it, or null past the last. Keys and last keys are of one type that has an order.

    A block stands for thousands of bytes of rows. Up to ``MOST_SENT`` blocks, their last
    keys are sent to all tasks and searched by halving; more are merged with the keys in
    order, from high to low, where the last block met is the one.
    """
    asked = keys.select(*group, "key").distinct()
    if index.limit(MOST_SENT + 1).count() <= MOST_SENT:
        ordered = F.array_sort(F.collect_list(F.struct("last_key", "block")))
        lists = index.groupBy(*group).agg(ordered.alias("_blocks"))
        # halving: how many last keys are below the key
        found = asked.join(F.broadcast(lists), group, "left").withColumn("_lo", _below(F.col("_blocks"), F.col("key")))
        return found.select(*group, "key", F.get(F.col("_blocks"), F.col("_lo"))["block"].alias("block"))
    none = F.lit(None)
    rows = asked.select(*group, "key", none.cast("long").alias("block")).unionByName(index.select(*group, F.col("last_key").alias("key"), "block"))
    down = Window.partitionBy(*group).orderBy(F.col("key").desc(), F.col("block").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    met = rows.withColumn("_met", F.last("block", ignorenulls=True).over(down))
    return met.where("block IS NULL").select(*group, "key", F.col("_met").alias("block"))


def _below(blocks: Column, key: Column, steps: int = 18) -> Column:
    """How many last keys of the sorted blocks are below key, by halving (for up to 2**steps blocks)."""
    at = F.struct(F.lit(0).alias("lo"), F.coalesce(F.size(blocks), F.lit(0)).alias("hi"))

    def halved(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        up = (s["lo"] < s["hi"]) & (F.get(blocks, mid)["last_key"] < key)
        return F.struct(F.when(up, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(up | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), at, halved)["lo"]
