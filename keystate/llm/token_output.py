"""Token ids of documents written as files of range-coded blocks, and read back.

Documents are range-partitioned by id and sorted, so the files' rows in order of
(part, first) hold the documents in ascending order of id. A block holds whole documents
of one part, about a million ids, and is a self-contained file image (see
``range_coder``): an index of its documents, coded ids, a checksum. Blocks are rows of
a Parquet table, which the job's committer writes whole or not at all.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, range_coder, tokens

VOCABULARY, END = "word_bpe_49k.json", 1
#: A block is closed at so many ids; one longer document makes a larger block.
BLOCK_IDS = 1 << 20
#: Bytes of text that are cut at once: a worker holds some ten times as much while it does.
PORTION = 8 << 20
BLOCKS = "part int, first long, n_ids long, data binary"


def _encode(vocabulary: str, end: int, block_ids: int, portion: int = PORTION):
    def run(batches):
        cache = tokens.pieces(tokens.WordPieces, vocabulary)
        part = TaskContext.get().partitionId()
        held, doc_ids, lengths, first, n = [], [], [], 0, 0

        def block():
            data = range_coder.encode_block(doc_ids, lengths, np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first]), pa.array([n]), pa.array([data], pa.binary())], names=["part", "first", "n_ids", "data"])

        for batch in batches:
            for rows in tokens.portions(batch, most=portion):
                ids, sizes = cache.column(rows.column("text"))
                ends = np.cumsum(sizes)
                ids, ends = np.insert(ids, ends, end), ends + np.arange(1, len(ends) + 1)
                since = 0
                for i, doc_id in enumerate(rows.column("doc_id").to_pylist()):
                    doc_ids.append(doc_id)
                    lengths.append(int(sizes[i]) + 1)
                    n += lengths[-1]
                    if n >= block_ids:
                        held.append(ids[since : ends[i]])
                        yield block()
                        first, since = first + n, int(ends[i])
                        held, doc_ids, lengths, n = [], [], [], 0
                held.append(ids[since:])
            pa.default_memory_pool().release_unused()
        if doc_ids:
            yield block()

    return run


def write_ids(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of all texts (null: empty), each with the end id, in ascending order of doc_id.

    Null ids come first; rows that repeat an id go by their text. Other columns are not
    used. An empty table gives files without blocks.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(_encode(vocabulary, end, block_ids), BLOCKS).write.parquet(path)


def _decode(batches):
    for batch in batches:
        for part, first, data in zip(*(batch.column(c).to_pylist() for c in ("part", "first", "data")), strict=True):
            doc_ids, lengths, ids = range_coder.decode_block(data)
            raw, ends = ids.astype("<u4").tobytes(), np.cumsum(lengths)
            starts = ends - lengths
            for at in range(0, len(doc_ids), 4096):
                cut = slice(at, at + 4096)
                own = [raw[4 * a : 4 * b] for a, b in zip(starts[cut].tolist(), ends[cut].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(own), pa.int32()), pa.array(doc_ids[cut], pa.int64()), pa.array(first + starts[cut]), pa.array(lengths[cut]), pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array(own, pa.binary())],
                    names=["part", "doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the files.

    start: the ids of all documents before it, over all files. ids: little-endian
    unsigned 32-bit integers. A damaged block raises DamagedBlock.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    read = blocks.select("part", "first", "data").mapInArrow(_decode, "part int, doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
    # a row for each part, that is for each task that wrote: bounded by the partitions of one stage
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return read.join(F.broadcast(offsets), "part").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", "ids")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "token-blocks")
    write_ids(common.documents(spark, sf_dir), path)
    return read_ids(spark, path).drop("ids")
