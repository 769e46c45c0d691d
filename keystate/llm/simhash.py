"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has 64 bits, so 8 bytes. Two that differ in up to 3 bits differ in up to
3 bytes: they share at least 5 positional bytes (position, value). That is the count
filter: tally the shared positional bytes of a pair, keep pairs with 5 or more, verify
the bits.

Posting lists of single positional bytes would each hold a 256th of all fingerprints,
and their pairs grow with the square. So the lists are intersected beforehand, over
sets of four positions such that any five positions hold one of the sets (``SETS``;
fourteen are enough). A list then holds fingerprints that agree in 32 bits.

Equal fingerprints meet first, so lists are of different fingerprints, and a list
yields a spanning forest of its links, never all its pairs. A list longer than
``LONG`` is split by four groups of the bits in which it varies; a pair agrees in one.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

SEED, SHINGLE, BITS = 42, 3, 3
LEAST_SHARED = 8 - BITS
#: Fingerprints of a list that are compared as they are; longer lists are split further.
LONG = 20_000


def _covering() -> list[tuple[int, ...]]:
    """Sets of four of the eight positions such that any five contain one.

    Greedy: take the set that serves most of the fives not yet served, the first of
    equals. Any cover is right; a smaller one makes fewer rows.
    """
    fives, fours, chosen = set(combinations(range(8), 5)), list(combinations(range(8), 4)), []
    while fives:
        best = max(fours, key=lambda s: sum(set(s) <= set(f) for f in fives))
        fives = {f for f in fives if not set(best) <= set(f)}
        chosen.append(best)
    return chosen


SETS = _covering()


def fingerprint(text: bytes) -> int:
    """64 bits over the text's shingles; a bit is 1 if set in over half their hashes."""
    return int(_fingerprints([text])[0])


def _hashes(text: bytes) -> list[int]:
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(SHINGLE, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist(), strict=True)]


def _fingerprints(texts: list[bytes]) -> np.ndarray:
    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i, t in enumerate(texts):
        if h := _hashes(t):
            bits = np.unpackbits(np.array(h, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            out[i] = weights[bits.sum(0, dtype=np.int64) * 2 > len(h)].sum(dtype=np.uint64)
    return out


def _fingerprint_batches(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
            others = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array(_fingerprints(texts).view(np.int64))], names=[*others, "fp"])


def fingerprints(docs: DataFrame, row: str | None = None) -> DataFrame:
    """(doc_id, fp long), and a long column of docs named by ``row``. A null or empty text has fingerprint zero."""
    more = [F.col(f"`{row}`")] if row else []
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, F.col("text").alias("text"))
    return narrow.mapInArrow(_fingerprint_batches, "doc_id long, " + f"`{row}` long, " * bool(row) + "fp long")


def _byte(i: int):
    return F.shiftrightunsigned("fp", 8 * i).bitwiseAND(255)


def _postings(fps: DataFrame) -> DataFrame:
    """(place int, value long, fp): a row for each set of positions."""
    keys = []
    for place, s in enumerate(SETS):
        value = F.lit(0).cast("long")
        for i in s:
            value = F.shiftleft(value, 8).bitwiseOR(_byte(i))
        keys.append(F.struct(F.lit(place).alias("place"), value.alias("value")))
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.place", "k.value", "fp")


def _near(one: np.uint64, many: np.ndarray) -> np.ndarray:
    """Count filter, then verification: which of many share 5 positional bytes and differ in up to 3 bits."""
    diff = many ^ one
    shared = (diff.view(np.uint8).reshape(-1, 8) == 0).sum(1)
    kept = np.flatnonzero(shared >= LEAST_SHARED)
    return kept[np.bitwise_count(diff[kept]) <= BITS]


def forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between different fingerprints, as (child, root).

    A search from each fingerprint not reached yet; what is reached leaves the list,
    so a group costs its size times the list's, and not all pairs once it is found.
    """
    left, child, root = np.sort(fps), [], []
    while len(left) > 1:
        seed, left = left[0], left[1:]
        queue = [seed]
        while queue and len(left):
            near = _near(queue.pop(), left)
            if len(near):
                found = left[near]
                child.append(found)
                root.append(np.full(len(found), seed))
                queue.extend(found)
                left = np.delete(left, near)
    if not child:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(child), np.concatenate(root)


def _link_batches(batches):
    """Sorted (place, value, fp) to links; a list may run over batches."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        place, value, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        fp = fp.view(np.uint64)
        if rest is not None:
            place, value, fp = (np.concatenate(x) for x in zip(rest, (place, value, fp), strict=True))
        edge = np.flatnonzero((np.diff(place) != 0) | (np.diff(value) != 0)) + 1
        cut = edge[-1] if len(edge) else 0
        rest = place[cut:], value[cut:], fp[cut:]
        yield from _links(edge, fp[:cut])
    if rest is not None:
        yield from _links(np.array([len(rest[2])]), rest[2])


def _by_fifth(fp: np.ndarray):
    """A long list's parts such that each link lies in one of them.

    The bits in which the list varies are dealt into four groups. A link differs in up
    to three bits, so it agrees in all of at least one group, whichever bytes the whole
    list has in common. The most even bits are dealt first, so that each group cuts. A
    part that is still long is split again, unless it is most of its list.
    """
    ones = [np.count_nonzero(fp >> np.uint64(b) & np.uint64(1)) for b in range(64)]
    even = [min(n, len(fp) - n) for n in ones]
    varying = sorted((b for b in range(64) if even[b]), key=lambda b: -even[b])
    if len(varying) <= BITS:  # all are linked
        yield fp
        return
    for i in range(BITS + 1):
        key = fp & np.uint64(sum(1 << b for b in varying[i :: BITS + 1]))
        order = np.argsort(key, kind="stable")
        for part in np.split(fp[order], np.flatnonzero(np.diff(key[order])) + 1):
            if LONG < len(part) <= len(fp) // 2:
                yield from _by_fifth(part)
            else:
                yield part


def _links(edges: np.ndarray, fp: np.ndarray):
    if not len(fp):
        return
    starts = np.concatenate([[0], edges[edges < len(fp)]])
    ends = np.concatenate([starts[1:], [len(fp)]])
    size = ends - starts
    child, root = [], []
    two = starts[size == 2]  # most lists have one or two
    if len(two):
        a, b = fp[two], fp[two + 1]
        shared = ((a ^ b).view(np.uint8).reshape(-1, 8) == 0).sum(1) >= LEAST_SHARED
        ok = shared & (np.bitwise_count(a ^ b) <= BITS)
        child.append(np.maximum(a, b)[ok])
        root.append(np.minimum(a, b)[ok])
    for lo, hi in zip(starts[size > 2].tolist(), ends[size > 2].tolist(), strict=True):
        for part in [fp[lo:hi]] if hi - lo <= LONG else _by_fifth(fp[lo:hi]):
            c, r = forest(part)
            child.append(c)
            root.append(r)
    if child and sum(map(len, child)):
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(child).view(np.int64)), pa.array(np.concatenate(root).view(np.int64))], names=["a", "b"])


def links(fps: DataFrame) -> DataFrame:
    """Different fingerprints (column fp) to links (a, b) that connect what 3 bits connect."""
    lists = _postings(fps).repartition("place", "value").sortWithinPartitions("place", "value")
    return lists.mapInArrow(_link_batches, "a long, b long").distinct()


def _labelled(known: DataFrame) -> DataFrame:
    """(fp, root): each fingerprint's component, named by its smallest fingerprint."""
    classes = common.stored(known.select("fp").distinct(), "classes")
    groups = components(common.stored(links(classes), "links"))  # node, root: only what has links
    return classes.join(groups, classes["fp"] == groups["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs, which needs doc_id and text.

    Texts without words have fingerprint zero and link like any other. A component is
    what links reach; its id is the smallest doc_id in it, null ids aside (null if all
    are). Repeated rows give a row each. Other columns are not used, whatever their
    names. An empty table gives an empty table.
    """
    known = common.stored(fingerprints(docs), "fingerprints")
    first = known.groupBy("fp").agg(F.min("doc_id").alias("first"))
    named = common.stored(first.join(_labelled(known), "fp"), "named")
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = named.join(smallest, "root").select("fp", "component_id")
    return known.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs, with all their columns, with one row of each component: of the smallest id in
    it, and if several rows of that id are in it, the one of the smallest row hash.

    So different texts under one id stay, unless they are near copies; of rows that
    repeat, one stays, the same in every run. Rows without an id cannot be named and
    stay. Null and empty texts are one component. An empty table gives an empty table.
    Rows are told apart by (doc_id, hash of the row), and texts are moved once.
    """
    row = common.fresh("_row", docs.columns)
    hashed = docs.withColumn(row, common.row_hash(docs))
    known = common.stored(fingerprints(hashed.where("doc_id IS NOT NULL"), row), "fingerprints")
    least = F.min(F.struct("doc_id", F.col(row))).alias("w")
    winners = known.groupBy("fp").agg(least).join(_labelled(known), "fp").groupBy("root").agg(F.min("w").alias("w"))
    kept = common.stored(winners.select("w.*"), "kept")
    # the winners grow with the table: joined by a shuffle, whatever their size here
    named = hashed.where("doc_id IS NOT NULL").join(kept.hint("merge"), ["doc_id", row], "left_semi").dropDuplicates(["doc_id", row])
    return named.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))
