"""Media columns: payloads kept as PNG in binary columns, and hashes of their low frequencies.

A payload is written as an 8-bit grey PNG, 24 samples a row. The writer takes for each
row, of the filters none, sub and up, the one with the least sum of signed differences,
and keeps that picture or the unfiltered one, whichever is smaller.
The reader walks the chunks, tests each CRC-32, inflates the data (zlib tests its own
checksum) and undoes the filters with numpy; it knows all five.

The feature is a cosine-transform hash: the picture is averaged into 32 x 32 cells,
transformed (DCT-II), and the 8 x 8 lowest frequencies without the constant give a bit
each: 1 if over their median. 63 bits as 16 hex digits.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WIDTH, UNIT, PAD = 24, 576, 255
#: PNG's signature: a fixed value.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CELLS, LOW = 32, 8
#: zlib's level.
LEVEL = 6


class DamagedPng(ValueError):
    pass


def padded(data: bytes) -> bytes:
    """data and bytes 255 up to a positive multiple of 576."""
    size = max(1, -(-len(data) // UNIT)) * UNIT
    return data + bytes([PAD]) * (size - len(data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode_png(payload: bytes, width: int = WIDTH) -> bytes:
    """payload, a multiple of width, as an 8-bit grey PNG."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    sub, up = rows.copy(), rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    kinds = np.stack([rows, sub, up])
    cost = np.abs(kinds.view(np.int8).astype(np.int16)).sum(2)
    best = cost.argmin(0)
    data = min((_deflated(choice, kinds) for choice in (best, np.zeros_like(best))), key=len)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", data) + _chunk(b"IEND", b"")


def _deflated(choice: np.ndarray, kinds: np.ndarray) -> bytes:
    filtered = np.empty((kinds.shape[1], kinds.shape[2] + 1), np.uint8)
    filtered[:, 0] = choice
    filtered[:, 1:] = kinds[choice, np.arange(kinds.shape[1])]
    return zlib.compress(filtered.tobytes(), LEVEL)


def _paeth(a: int, b: int, c: int) -> int:
    p = a + b - c
    by_a, by_b, by_c = abs(p - a), abs(p - b), abs(p - c)
    return a if by_a <= by_b and by_a <= by_c else b if by_b <= by_c else c


def unfilter(kinds: np.ndarray, rows: np.ndarray, step: int = 1) -> np.ndarray:
    """The samples of filtered rows. Runs of a kind are undone together: none as they
    are, sub by sums along each row, up by sums down the run."""
    out = rows.copy()
    edges = np.flatnonzero(np.diff(kinds)) + 1
    starts = [0, *edges.tolist()] if len(kinds) else []
    for lo, hi in zip(starts, [*starts[1:], len(kinds)], strict=True):
        kind, above = int(kinds[lo]), out[lo - 1] if lo else np.zeros_like(out[0])
        if kind == 1:
            part = out[lo:hi].reshape(hi - lo, -1, step)
            np.cumsum(part, axis=1, dtype=np.uint8, out=part)
        elif kind == 2:
            out[lo] += above
            np.cumsum(out[lo:hi], axis=0, dtype=np.uint8, out=out[lo:hi])
        elif kind in (3, 4):
            for y in range(lo, hi):
                prior, row = (out[y - 1] if y else np.zeros_like(out[0])).tolist(), out[y].tolist()
                for x in range(len(row)):
                    a = row[x - step] if x >= step else 0
                    c = prior[x - step] if x >= step else 0
                    row[x] = (row[x] + ((a + prior[x]) // 2 if kind == 3 else _paeth(a, prior[x], c))) & 255
                out[y] = row
        elif kind:
            raise DamagedPng(f"filter {kind}")
    return out


def decode_png(png: bytes) -> np.ndarray:
    """rows x samples of an 8-bit grey PNG without interlace; DamagedPng if it is not whole."""
    if png[:8] != SIGNATURE:
        raise DamagedPng("signature")
    at, size, data, ended = 8, None, [], False
    while at < len(png) and not ended:
        if at + 12 > len(png):
            raise DamagedPng("cut off")
        n, kind = struct.unpack(">I4s", png[at : at + 8])
        body = png[at + 8 : at + 8 + n]
        if len(body) < n or struct.unpack(">I", png[at + 8 + n : at + 12 + n].rjust(4, b"\0"))[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise DamagedPng(f"checksum of {kind!r}")
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlace) != (8, 0, 0):
                raise DamagedPng("only 8-bit grey without interlace")
            size = height, width
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if size is None or not ended:
        raise DamagedPng("cut off")
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[0], size[1] + 1)
    except (zlib.error, ValueError) as e:
        raise DamagedPng(str(e)) from e
    return unfilter(raw[:, 0], np.ascontiguousarray(raw[:, 1:]))


def _cosines() -> np.ndarray:
    k, n = np.arange(LOW)[:, None], np.arange(CELLS)[None, :]
    return np.cos(np.pi * (2 * n + 1) * k / (2 * CELLS))


_COSINES = _cosines()


def _averages(n: int) -> np.ndarray:
    """CELLS x n: each cell's mean over its share of n rows, with parts of rows."""
    at = np.arange(CELLS + 1) * (n / CELLS)
    lo, hi = at[:-1, None], at[1:, None]
    rows = np.arange(n)[None, :]
    return np.clip(np.minimum(hi, rows + 1) - np.maximum(lo, rows), 0, None) * (CELLS / n)


def _shrunk(rows: np.ndarray) -> np.ndarray:
    """Means over CELLS equal parts of the first axis, from running sums: linear in the rows."""
    total = np.vstack([np.zeros((1, rows.shape[1])), np.cumsum(rows, axis=0, dtype=np.float64)])
    at = np.arange(CELLS + 1) * (len(rows) / CELLS)
    whole = np.minimum(at.astype(np.int64), len(rows) - 1)
    upto = total[whole] + (at - whole)[:, None] * rows[whole]
    return np.diff(upto, axis=0) * (CELLS / len(rows))


_WIDE = _averages(WIDTH)


def cosine_hash(samples: np.ndarray) -> str:
    """16 hex digits of the picture's low frequencies."""
    across = _WIDE if samples.shape[1] == WIDTH else _averages(samples.shape[1])
    cells = _shrunk(samples) @ across.T
    low = (_COSINES @ cells @ _COSINES.T).round(6).ravel()[1:]
    bits = low > np.median(low)
    return f"{int.from_bytes(np.packbits(np.concatenate([[False], bits])).tobytes(), 'big'):016x}"


_STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_READ = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
#: Texts or pictures that are held encoded and decoded at once.
SLICE = 64


def _write(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array([encode_png(padded(t)) for t in texts], pa.binary())], schema=_STORED)


def _read(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            rows = []
            for png in part.column("media").to_pylist():
                samples = decode_png(png)
                payload = samples.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(samples)))
            columns = [pa.array([r[i] for r in rows], _READ.field(i + 2).type) for i in range(6)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *columns], schema=_READ)


def as_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as UTF-8 in a PNG.

    A null text is an empty one; both give 576 bytes of padding. Repeated rows and ids
    give a row each; other columns are not used; an empty table gives an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_write, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """What the stored pictures give when read back. A damaged one raises DamagedPng."""
    return media.mapInArrow(_read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(common.stored(as_media(common.documents(spark, sf_dir)), "media"))
