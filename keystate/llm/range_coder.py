"""An adaptive context-mixing range coder for token ids, in checksummed blocks.

A block is coded by itself: all statistics start anew. Its ids are dealt to up to 4,096
lanes, runs of equal length, each with a range coder of its own; the lanes go through
their ids in step and share the block's statistics, which are updated after each step.
So a step is a few dozen numpy operations over all lanes.

The prediction of an id mixes three orders: order 2 and order 1 each name the id that
last followed the two ids (or the one id) before, with a confidence of 1 to 4; order 0
is the block's id frequencies so far. How much of the range the named ids get is
learned for each pair of confidences from how often they were right; order 0 shares
the rest. The coder is a carrying range coder with 62 bits of state and 32-bit words.

Layout of a block (little-endian): magic, then the fields of ``HEAD``, then the
deflated document index (null flags, ids, lengths), words of each lane, the words, and
the CRC-32 of all that.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"KSTB\x01"
HEAD = struct.Struct("<QQIIIIQ")  # ids, documents, lanes, steps, alphabet, bytes of the index, words
LANES, LANE_IDS = 4096, 128
BITS = 24
TOTAL, LEAST = 1 << BITS, 1 << 20
#: Order 0 gives each id of the alphabet so much of TOTAL at least.
FLOOR = 16
LOW_BITS = 30
LOW, MASK = 1 << LOW_BITS, (1 << LOW_BITS) - 1
SLOTS = 1 << 18
#: The decoder keeps the id at every so many (a power of two) of TOTAL.
GUIDE_BITS = 8
#: The confidence that follows one of 0 to 4, after a wrong and a right prediction; 0 takes the new id.
THEN = np.array([0, 0, 0, 2, 1, 3, 2, 4, 3, 4])


class DamagedBlock(ValueError):
    pass


class _Mixer:
    """The statistics of a block, the same for coder and decoder."""

    def __init__(self, alphabet: int, lanes: int):
        self.alphabet = alphabet
        self.seen, self.total = np.zeros(alphabet, np.int64), 0
        self.one, self.two = np.full(alphabet, -8, np.int64), np.full(SLOTS, -8, np.int64)  # id * 8 + confidence; id -1 with 0 at first
        self.hits = np.tile(np.array([0.4, 0.4, 0.8]), (25, 1))
        self.before, self.earlier = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.waiting: list[np.ndarray] = []
        self.late = 0
        self.guide: np.ndarray | None = None
        self.rebuild()

    def rebuild(self) -> None:
        if self.waiting:
            self.seen += np.bincount(np.concatenate(self.waiting), minlength=self.alphabet)
            self.total += self.late
        self.waiting, self.late = [], 0
        spare = TOTAL - FLOOR * self.alphabet
        share = (self.seen * spare) // self.total if self.total else np.full(self.alphabet, spare // self.alphabet)
        self.cum = np.zeros(self.alphabet + 1, np.int64)
        np.cumsum(share + FLOOR, out=self.cum[1:])
        self.cum[-1] = TOTAL
        self.upper = self.cum[1:]
        self.guide = None

    def predict(self) -> None:
        self.slot = (h := self.before * 0x9E3779B1 + self.earlier * 0x85EBCA6B) ^ (h >> 15)
        self.slot &= SLOTS - 1
        self.v1, self.v2 = self.one.take(self.before), self.two.take(self.slot)
        self.id1, self.id2 = self.v1 >> 3, self.v2 >> 3
        self.sure1, self.sure2 = self.v1 & 7, self.v2 & 7
        self.pair = self.sure2 * 5 + self.sure1
        share = (self.hits[:, :2].T / self.hits.sum(1) * (TOTAL - LEAST)).astype(np.int64) + 1
        share[0, :5] = 0  # nothing named by order 2
        share[1, ::5] = 0  # nothing named by order 1
        self.named2 = share[0].take(self.pair)
        self.named = self.named2 + share[1].take(self.pair) * (self.id1 != self.id2)
        self.rest = TOTAL - self.named

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of each lane's id in TOTAL."""
        self.hit2, self.right1 = ids == self.id2, ids == self.id1
        self.hit1 = self.right1 & ~self.hit2
        start = self.named + ((self.cum.take(ids) * self.rest) >> BITS)
        end = self.named + ((self.upper.take(ids) * self.rest) >> BITS)
        start = np.where(self.hit1, self.named2, start)
        end = np.where(self.hit1, self.named, end)
        start[self.hit2] = 0
        end = np.where(self.hit2, self.named2, end)
        return start, end - start

    def find(self, value: np.ndarray) -> np.ndarray:
        """The id of each lane whose interval holds value."""
        ids = np.where(value < self.named2, self.id2, self.id1)
        lanes = np.flatnonzero(value >= self.named)
        at = (((value[lanes] - self.named[lanes] + 1) << BITS) - 1) // self.rest[lanes]
        ids[lanes] = self.order0(at)
        return ids

    def order0(self, at: np.ndarray) -> np.ndarray:
        """The id of order 0 whose share holds each of at: by the guide, and where an id starts between two of its marks by search."""
        if self.guide is None:
            first = (self.cum + ((1 << GUIDE_BITS) - 1)) >> GUIDE_BITS
            self.guide = np.repeat(np.arange(self.alphabet), np.diff(first))
        ids = self.guide.take(at >> GUIDE_BITS)
        late = np.flatnonzero(self.upper.take(ids) <= at)
        ids[late] = np.searchsorted(self.cum, at.take(late), "right") - 1
        return ids

    def update(self, ids: np.ndarray) -> None:
        kind = np.where(self.hit2, 0, 2 - self.hit1)
        self.hits += np.bincount(self.pair * 3 + kind, minlength=75).reshape(25, 3)
        anew = ids * 8 + 1
        for table, at, v, sure, right in ((self.one, self.before, self.v1, self.sure1, self.right1), (self.two, self.slot, self.v2, self.sure2, self.hit2)):
            then = THEN.take(sure * 2 + right)
            table[at] = np.where(then > 0, v - sure + then, anew)
        self.earlier, self.before = self.before, ids
        self.waiting.append(ids)
        self.late += len(ids)
        if self.late * 8 >= self.total:
            self.rebuild()


def _coded(ids: np.ndarray, lanes: int, steps: int, alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of each lane, and all words lane by lane."""
    by_step = np.zeros(lanes * steps, np.int64)
    by_step[: len(ids)] = ids
    by_step = np.ascontiguousarray(by_step.reshape(lanes, steps).T)
    mixer = _Mixer(alphabet, lanes)
    low, span = np.zeros(lanes, np.int64), np.full(lanes, 1 << (LOW_BITS + 32), np.int64)
    words, sent = np.zeros((steps + 1, lanes), np.int64), np.ones((steps + 1, lanes), bool)
    for t in range(steps):
        mixer.predict()
        start, width = mixer.interval(by_step[t])
        unit = span >> BITS
        low += unit * start
        span = unit * width
        out = span < LOW
        words[t], sent[t] = low >> LOW_BITS, out
        low = np.where(out, (low & MASK) << 32, low)
        span = np.where(out, span << 32, span)
        mixer.update(by_step[t])
    words[steps] = (low + MASK) >> LOW_BITS  # the one multiple of 2**30 that is surely within
    flat = words.T[sent.T]
    while (carry := flat >> 32).any():
        flat &= 0xFFFFFFFF
        flat[:-1] += carry[1:]
    return sent.sum(0).astype("<u4"), flat.astype("<u4")


def _decoded(counts: np.ndarray, words: np.ndarray, lanes: int, steps: int, alphabet: int) -> np.ndarray:
    # a lane that has ended reads zeros: its words are followed by the next lane's, so bounds are kept
    words = np.append(words.astype(np.int64), 0)
    ends = np.cumsum(counts.astype(np.int64))
    at = ends - counts

    def read() -> np.ndarray:
        return np.where(at < ends, words.take(np.minimum(at, len(words) - 1)), 0)

    first = read()
    at += 1
    second = read()
    at += 1
    code, spare = (first << LOW_BITS) | (second >> 2), second & 3
    span = np.full(lanes, 1 << (LOW_BITS + 32), np.int64)
    mixer, out = _Mixer(alphabet, lanes), np.empty((steps, lanes), np.int64)
    for t in range(steps):
        mixer.predict()
        unit = span >> BITS
        ids = mixer.find(np.minimum(code // unit, TOTAL - 1))
        start, width = mixer.interval(ids)
        code -= unit * start
        span = unit * width
        more = span < LOW
        word = read()
        code = np.where(more, (code << 32) | (spare << LOW_BITS) | (word >> 2), code)
        spare = np.where(more, word & 3, spare)
        span = np.where(more, span << 32, span)
        at += more
        mixer.update(ids)
        out[t] = ids
    return out.T.ravel()


def encode_block(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """A block of whole documents: their ids (null allowed), their numbers of ids, the ids."""
    n = len(ids)
    lanes = max(1, min(LANES, n // LANE_IDS))
    steps = -(-n // lanes)
    alphabet = int(ids.max()) + 1 if n else 1
    if alphabet > TOTAL // FLOOR // 2:
        raise ValueError(f"id {alphabet - 1} is too large")
    counts, words = _coded(ids.astype(np.int64), lanes, steps, alphabet) if n else (np.zeros(1, "<u4"), np.zeros(0, "<u4"))
    null = np.array([d is None for d in doc_ids], np.uint8)
    index = zlib.compress(null.tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array(lengths, "<i8").tobytes())
    body = MAGIC + HEAD.pack(n, len(doc_ids), lanes, steps, alphabet, len(index), len(words)) + index + counts.tobytes() + words.tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


def decode_block(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """The documents' ids, their lengths, and all token ids; DamagedBlock if a bit is wrong."""
    if len(data) < len(MAGIC) + HEAD.size + 4 or data[: len(MAGIC)] != MAGIC:
        raise DamagedBlock("magic")
    if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise DamagedBlock("checksum")
    n, docs, lanes, steps, alphabet, size, n_words = HEAD.unpack_from(data, len(MAGIC))
    at = len(MAGIC) + HEAD.size
    index = zlib.decompress(data[at : at + size])
    null, doc_ids, lengths = np.frombuffer(index, np.uint8, docs), np.frombuffer(index, "<i8", docs, docs), np.frombuffer(index, "<i8", docs, 9 * docs)
    at += size
    counts = np.frombuffer(data, "<u4", lanes, at)
    words = np.frombuffer(data, "<u4", n_words, at + 4 * lanes)
    ids = _decoded(counts, words, lanes, steps, alphabet)[:n] if n else np.zeros(0, np.int64)
    return [None if z else d for z, d in zip(null.tolist(), doc_ids.tolist(), strict=True)], lengths, ids
