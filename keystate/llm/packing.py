"""Bulk-synchronous best-fit packing of tokenized documents into sequences.

Pieces of documents and gaps of sequences are rows. A sweep range-sorts both by size,
from large to small, and sends each document to its successor, the smallest gap that
holds it and that no document before it has got: conflicts go by rank in that order.
Then the gaps are updated, and the sweep is repeated with the documents left over.

A sweep takes all documents but those of a hundredth of the longest left (``BAND``), until
all of them are placed. Before it, as many sequences are opened as those documents need that
no gap holds. A gap that can hold several of the longest offers a slot for each, so
short documents do not need a sweep for each one that a gap takes.

Matching is that of brackets: a gap opens, a document closes. With +1 for a gap and -1
for a document, prefix sums give each row its depth, and a document matches the gap
before it at its depth. Prefix sums are of each range partition, whose total and least
value are handed on to the next ones; rows then meet by depth, of which there are as
many as gaps, and at one depth at most as many rows as there are different sizes, twice.
"""

from __future__ import annotations

import math
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

LENGTH, VOCABULARY, END = 2048, "byte_bpe_50k.json", 0
#: A sweep takes the documents over 1 - 1/BAND of the longest left. Nearer to 1, sweeps are
#: fewer; at 1.25 they are half as many again for one sequence in 500 less.
BAND = 1.01
#: Rows of a range partition of a sweep, about 40 bytes each.
ROWS = 500_000
_PIECES = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_lengths(n: int, most: int) -> list[int]:
    """Lengths of a document's pieces: only the first may be shorter than most."""
    pieces = max(1, -(-n // most))
    return [n - (pieces - 1) * most, *[most] * (pieces - 1)]


def _cut(vocabulary: str, end: int, most: int, keep_ids: bool, cache_pieces: int, portion: int):
    names = [*_PIECES, ("ids", pa.binary())] if keep_ids else _PIECES
    schema = pa.schema(names)

    def run(batches):
        cache = tokens.pieces(tokens.BytePieces, vocabulary, cache_pieces)
        for batch in batches:
            for part in tokens.portions(batch, most=portion):
                ids, n = cache.column(part.column("text"))
                ends = np.cumsum(n)
                raw = memoryview(np.insert(ids, ends, end).astype("<u4").tobytes())
                rows, at = [], 0
                for doc_id, length in zip(part.column("doc_id").to_pylist(), (n + 1).tolist(), strict=True):
                    start = 0
                    for piece, size in enumerate(cut_lengths(length, most)):
                        own = raw[4 * at : 4 * (at + size)]
                        rows.append((doc_id, piece, start, size, zlib.crc32(own), bytes(own) if keep_ids else None)[: len(names)])
                        start, at = start + size, at + size
                columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), names, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
            pa.default_memory_pool().release_unused()

    return run


def _prefix(batches):
    """Sorted rows with the sum of brackets up to each in its partition, the least sum so
    far, and whether the row is below all before it. The last row, of no document or
    gap, has what the partition hands on."""
    part, nth, total, least = TaskContext.get().partitionId(), 0, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        sums = total + np.cumsum(np.where(batch.column("doc").to_numpy(zero_copy_only=False), -1, 1))
        mins = np.minimum.accumulate(sums if least is None else np.minimum(sums, least))
        before = np.concatenate([[sums[0] + 1 if least is None else least], mins[:-1]])
        at = np.arange(nth, nth + len(sums))
        nth, total, least = nth + len(sums), int(sums[-1]), int(mins[-1])
        columns = [*batch.columns, pa.array(np.full(len(sums), part, np.int32)), pa.array(at), pa.array(sums), pa.array(mins), pa.array(sums < before)]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part", "nth", "sum", "least", "low"])
    if nth:
        last = [[None], [None], [None], [None], [part], [nth], [total], [least], [None]]
        kinds = [pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(last, kinds, strict=True)], names=["doc", "id", "k", "size", "part", "nth", "sum", "least", "low"])


def _sweep(docs: DataFrame, gaps: DataFrame, n_docs: int, n_gaps: int, top: int) -> tuple[DataFrame, DataFrame]:
    """One sweep of docs (pid, size), none over top, to gaps (seq, size): the slots with
    what they got (seq, size, pid, got), and the documents left (pid, size)."""
    spark = docs.sparkSession
    most_slots = math.ceil(2 * n_docs / max(1, n_gaps)) + 1  # so slots are not many more than documents and gaps
    slots = F.greatest(F.lit(1), F.least(F.floor(F.col("size") / top), F.lit(most_slots))).cast("int")
    offered = gaps.select("seq", "size", slots.alias("m")).select("seq", "size", "m", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("k"))
    size = F.when(F.col("k") < F.col("m"), F.lit(top)).otherwise(F.col("size") - (F.col("m") - 1) * top)
    rows = offered.select(F.lit(False).alias("doc"), F.col("seq").alias("id"), "k", size.cast("int").alias("size"))
    rows = rows.unionByName(docs.select(F.lit(True).alias("doc"), F.col("pid").alias("id"), F.lit(0).alias("k"), F.col("size").cast("int").alias("size")))
    order = [F.col("size").desc(), F.col("doc"), F.col("id"), F.col("k")]
    parts = max(1, math.ceil((n_docs + n_gaps) / ROWS))
    # up to ROWS rows are one range, which needs no exchange
    ranged = rows.repartitionByRange(parts, *order) if parts > 1 else rows.coalesce(1)
    laid = common.stored(ranged.sortWithinPartitions(*order).mapInArrow(_prefix, "doc boolean, id long, k int, size int, part int, nth long, sum long, least long, low boolean"), "sweep")
    here = laid.where("doc IS NOT NULL")
    if parts > 1:  # a row for each range partition: what the partitions before it hand on
        carry, total, least = [], 0, 0
        for r in sorted(laid.where("doc IS NULL").select("part", "sum", "least").collect()):
            carry.append((r["part"], total, least))
            total, least = total + r["sum"], min(least, total + r["least"])
        here = here.join(F.broadcast(spark.createDataFrame(carry, "part int, s0 long, m0 long")), "part")
    else:
        here = here.withColumns({"s0": F.lit(0).cast("long"), "m0": F.lit(0).cast("long")})
    at = F.col("s0") + F.col("sum")
    left = F.col("doc") & F.col("low") & (at < F.col("m0"))
    depth = at - F.least(F.col("m0"), F.col("s0") + F.col("least"))
    here = here.withColumn("left", left).withColumn("depth", depth + F.col("doc").cast("int"))
    along = Window.partitionBy("depth").orderBy("part", "nth")
    met = here.where("NOT left").select("doc", "id", "size", F.lead("id").over(along).alias("pid"), F.lead("size").over(along).alias("got"))
    return common.stored(met.where("NOT doc").select(F.col("id").alias("seq"), "size", "pid", "got"), "slots"), here.where("left").select(F.col("id").alias("pid"), "size")


def place(docs: DataFrame, most: int) -> tuple[DataFrame | None, int]:
    """(pid, seq, size) of all docs (pid, size), and the number of sequences."""
    spark = docs.sparkSession
    none = spark.createDataFrame([], "seq long, size int")
    left, parked, opened, done = docs, none, 0, []
    while (top := left.agg(F.max("size")).first()[0]) is not None:
        floor = top - max(1, int(top / BAND))
        band, left = left.where(F.col("size") > floor), left.where(F.col("size") <= floor)
        gaps, small = parked.where(F.col("size") > floor), [parked.where(F.col("size") <= floor)]
        while True:
            open_gaps = gaps.agg(F.coalesce(F.max("size"), F.lit(0)).alias("largest"), F.count("*").alias("gaps"))
            unfit = F.col("size") > F.col("largest")
            facts = band.join(F.broadcast(open_gaps)).agg(F.count("*").alias("n"), F.max("gaps").alias("gaps"), F.sum(F.when(unfit, F.col("size"))).alias("unfit"), F.count(F.when(unfit & (2 * F.col("size") > most), 1)).alias("alone")).first()
            if not facts["n"]:
                break
            n = max(-(-(facts["unfit"] or 0) // most), facts["alone"])
            if n:
                gaps = gaps.unionByName(spark.range(opened, opened + n, 1, max(1, math.ceil(n / ROWS))).select(F.col("id").alias("seq"), F.lit(most).alias("size")))
                opened += n
            slots, band = _sweep(band, gaps, facts["n"], facts["gaps"] + n, top)
            done.append(slots.where("pid IS NOT NULL").select("pid", "seq", F.col("got").alias("size")))
            if 2 * top > most:  # no gap had more than one slot
                after = slots.select("seq", (F.col("size") - F.coalesce("got", F.lit(0))).alias("size"))
            else:
                after = common.stored(slots.groupBy("seq").agg((F.sum("size") - F.coalesce(F.sum("got"), F.lit(0))).cast("int").alias("size")), "gaps")
            gaps = after.where(F.col("size") > floor)
            small.append(after.where((F.col("size") > 0) & (F.col("size") <= floor)))
        parked = common.stored(reduce(DataFrame.unionByName, small, gaps), "gaps")
    return (reduce(DataFrame.unionByName, done), opened) if done else (None, 0)


def pack(
    docs: DataFrame,
    most: int = LENGTH,
    vocabulary: str = VOCABULARY,
    end: int = END,
    keep_ids: bool = False,
    cache_pieces: int = tokens.CACHE,
    portion: int = tokens.AT_ONCE,
) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    docs needs doc_id and text. A null text is an empty one: its piece is the end id
    alone. Rows that repeat are packed as often as they come; pieces of one size go by
    their place in the table. Other columns of docs are not used. An empty table gives
    an empty table. ``cache_pieces`` and ``portion`` (bytes of text cut at once) trade a
    worker's memory for time; the rows are the same.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cut(vocabulary, end, most, keep_ids, cache_pieces, portion), _DDL + ", ids binary" * keep_ids)
    pieces = common.stored(rows.withColumn("pid", F.monotonically_increasing_id()), "pieces")
    placed, _ = place(pieces.select("pid", F.col("length").cast("int").alias("size")), most)
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    if placed is None:
        return pieces.select(*kept, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    before = Window.partitionBy("seq").orderBy(F.col("size").desc(), "pid").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select("pid", F.col("seq").alias("sequence_id"), F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long").alias("offset"))
    return pieces.join(placed.hint("merge"), "pid").select(*kept, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """pack(..., keep_ids=True) to (sequence_id, n_tokens, ids): the sequences themselves."""
    parts = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    joined = F.aggregate(F.transform("p", lambda x: F.hex(x["ids"])), F.lit(""), lambda a, x: F.concat(a, x))
    return parts.select("sequence_id", "n_tokens", F.unhex(joined).alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir))
