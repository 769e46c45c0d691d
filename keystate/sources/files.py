"""Binary log and run files: sources that parse them, and a sink that writes them.

Files are read by Spark's binaryFile source, so any store that Spark reads will do, and
parsed where they are read. They are written by tasks through Arrow's file systems: to a
name of their own first, then renamed, so a task that is run again replaces its file.
"""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..schema import BLOCK_BYTES, LOG_HEADER_BYTES, RUN_MAGIC, CorruptRecordError

_ENTRY = "file string, nth long, tombstone boolean, key binary, value binary"


def log_image(entries) -> bytes:
    """A log file of (key, value or None, tombstone) entries."""
    out = []
    for key, value, tombstone in entries:
        value = value or b""
        body = struct.pack("<BII", int(tombstone), len(key), len(value)) + key + value
        out.append(struct.pack("<I", zlib.crc32(body)) + body)
    return b"".join(out)


def parse_log(data: bytes):
    """Entries up to the first that is cut off or whose checksum is wrong."""
    at = 0
    while at + LOG_HEADER_BYTES <= len(data):
        crc, tombstone, klen, vlen = struct.unpack_from("<IBII", data, at)
        end = at + LOG_HEADER_BYTES + klen + vlen
        if end > len(data) or zlib.crc32(data[at + 4 : end]) != crc:
            return
        key = at + LOG_HEADER_BYTES
        yield data[key : key + klen], data[key + klen : end], tombstone == 1
        at = end


def run_image(entries, block_bytes: int = BLOCK_BYTES) -> bytes:
    """A run file of entries in key order: blocks, sparse index, footer."""
    out, index, block, last, at = [], [], bytearray(), b"", 0
    for key, value, tombstone in entries:
        value = value or b""
        block += struct.pack("<BII", int(tombstone), len(key), len(value)) + key + value
        last = key
        if len(block) >= block_bytes:
            index.append((last, at, len(block)))
            out.append(bytes(block))
            at, block = at + len(block), bytearray()
    if block:
        index.append((last, at, len(block)))
        out.append(bytes(block))
        at += len(block)
    table = struct.pack("<I", len(index)) + b"".join(struct.pack("<I", len(k)) + k + struct.pack("<QI", o, n) for k, o, n in index)
    return b"".join(out) + table + struct.pack("<QQQ", at, len(table), RUN_MAGIC)


def run_index(data: bytes) -> list[tuple[bytes, int, int]]:
    """(last key, offset, length) of a run file's blocks; CorruptRecordError if the footer is not right."""
    if len(data) < 24:
        raise CorruptRecordError("no footer")
    at, size, magic = struct.unpack("<QQQ", data[-24:])
    if magic != RUN_MAGIC or at + size + 24 != len(data):
        raise CorruptRecordError("footer")
    (n,), out, p = struct.unpack_from("<I", data, at), [], at + 4
    for _ in range(n):
        (klen,) = struct.unpack_from("<I", data, p)
        offset, length = struct.unpack_from("<QI", data, p + 4 + klen)
        out.append((data[p + 4 : p + 4 + klen], offset, length))
        p += 16 + klen
    return out


def parse_run(data: bytes):
    """All entries of a run file, in key order."""
    for _, offset, length in run_index(data):
        at = offset
        while at < offset + length:
            tombstone, klen, vlen = struct.unpack_from("<BII", data, at)
            key = at + 9
            yield data[key : key + klen], data[key + klen : key + klen + vlen], tombstone == 1
            at = key + klen + vlen


def run_get(data: bytes, key: bytes):
    """(value, tombstone) of a key in a run file, or None: one block is searched."""
    for last, offset, length in run_index(data):
        if last >= key:
            at = offset
            while at < offset + length:
                tombstone, klen, vlen = struct.unpack_from("<BII", data, at)
                k = data[at + 9 : at + 9 + klen]
                if k >= key:
                    return (data[at + 9 + klen : at + 9 + klen + vlen], tombstone == 1) if k == key else None
                at += 9 + klen + vlen
            return None
    return None


def _read(spark: SparkSession, path: str, parse) -> DataFrame:
    def run(batches):
        for batch in batches:
            for file, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                held = []
                for nth, (key, value, tombstone) in enumerate(parse(data)):
                    held.append((file, nth, tombstone, key, value))
                    if len(held) == 10_000:
                        yield _batch(held)
                        held = []
                if held:
                    yield _batch(held)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _ENTRY)


def _batch(rows) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["file", "nth", "tombstone", "key", "value"])


def read_log_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, nth, tombstone, key, value) of log files; each is read up to its first damaged record."""
    return _read(spark, path, parse_log)


def read_run_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, nth, tombstone, key, value) of run files; a wrong footer is an error."""
    return _read(spark, path, parse_run)


def write_files(rows: DataFrame, folder: str, kind: str, name: str = "name", order: str | None = None) -> DataFrame:
    """Write rows (name, key, value, tombstone) as one file for each name; returns (file,
    bytes) once all are written. kind: "log" or "run". A run is in key order; a log in
    the order of a column, which must be named.

    A file is built in memory by one task, as run and log files are some 64 MiB.
    """
    image = {"log": log_image, "run": run_image}[kind]
    by = "key" if kind == "run" else order
    if not by:
        raise ValueError("a log needs a column that orders it")

    def run(key, table):
        from pyarrow import fs

        target = f"{folder.rstrip('/')}/{key[0].as_py()}"
        store, path = fs.FileSystem.from_uri(target) if ":" in target else (fs.LocalFileSystem(), target)
        table = table.sort_by(by)  # groups arrive in no order
        data = image(zip(*(table.column(c).to_pylist() for c in ("key", "value", "tombstone")), strict=True))
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(path + ".part") as out:
            out.write(data)
        store.move(path + ".part", path)
        return pa.table({"file": [target], "bytes": [len(data)]})

    done = rows.select(*dict.fromkeys([name, "key", "value", "tombstone", by])).groupBy(name).applyInArrow(run, "file string, bytes long")
    return rows.sparkSession.createDataFrame(done.collect(), "file string, bytes long")
