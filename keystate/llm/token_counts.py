"""Token counts by a map-side two-tier lookup of pieces; no piece is ever shuffled to count it.

The first tier is a compact table of the frequent pieces' token counts, broadcast once
and read by all workers. Which pieces are frequent is found from all texts: each task
keeps a bounded tally (pieces that fall behind are dropped from it) and hands on its
most frequent ones; their sums decide. The table holds ``TABLE`` pieces at most,
whatever the input. The second tier is each worker's own bounded cache; a miss goes
through the library into it. The tiers only save time: every count is the library's.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

VOCABULARY, LIMIT = "piece_bpe_32k.model", 4096
#: Pieces of the broadcast table (about 10 bytes each), of a task's tally, and of what a task hands on.
TABLE, TALLY, HANDED = 65_536, 200_000, 8_192
LONGEST = 40


class CountPieces:
    """Counts of a text's pieces under a sentence-piece vocabulary.

    The library writes a blank as U+2581, puts one before a text, and merges over the
    whole text. No entry has that mark behind another character, and none holds a line
    end, so merges cross neither: a run of blanks with what follows is a piece, and so
    is a line end with what follows. ``load`` proves both for the vocabulary it gets.
    """

    cuts = re.compile(r" +[^ \n]*|\n[^ \n]*")

    def __init__(self, name: str, table: dict[str, int] | None = None, most: int = tokens.CACHE):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=tokens.vocabulary(name))
        entries = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.cuttable = not any(re.search("[^▁]▁|.\n|\n.", e) for e in entries)
        self.table, self.known, self.most = table or {}, {}, most

    def cut(self, text: str) -> list[str]:
        """Pieces, each with the blanks or the line end before it."""
        return self.cuts.findall(" " + text.replace("▁", " ")) if text else []

    def _asked(self, piece: str) -> tuple[str, int]:
        """A text for the library that holds the piece, and its tokens that are not the piece's."""
        if piece[0] == "\n":
            return piece, 1  # the mark before the text
        return ("a" + piece, 1) if not piece.strip(" ") else (piece[1:], 0)

    def add(self, pieces: list[str]) -> dict[str, int]:
        asked = [self._asked(p) for p in pieces]
        got = self.library.encode([t for t, _ in asked], num_threads=1) if asked else []
        new = {p: len(ids) - extra for p, (_, extra), ids in zip(pieces, asked, got, strict=True)}
        if len(self.known) + len(new) <= self.most:
            self.known.update((p, n) for p, n in new.items() if len(p) <= LONGEST)
        return new

    def counts(self, texts: list[str]) -> list[int]:
        if not self.cuttable:
            return [len(x) for x in self.library.encode(texts, num_threads=1)]
        out, cuts = [], [self.cut(t) for t in texts]
        tallies = [Counter(c) for c in cuts]
        table, known = self.table, self.known
        missing = {p for t in tallies for p in t if p not in table and p not in known}
        new = self.add(list(missing))
        for t in tallies:
            n = 0
            for p, k in t.items():
                c = table.get(p)
                if c is None:
                    c = known.get(p)
                    if c is None:
                        c = new[p]
                n += c * k
            out.append(n)
        return out


def packed_table(table: dict[str, int]) -> bytes:
    """A table of pieces and counts as compressed bytes: what is broadcast."""
    names = sorted(table)
    body = "\0".join(names).encode()
    return zstandard.compress(np.array([len(body)], "<u4").tobytes() + body + np.minimum([table[n] for n in names], 65535).astype("<u2").tobytes())


def unpacked_table(data: bytes) -> dict[str, int]:
    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw[:4], "<u4")[0])
    names = raw[4 : 4 + n].decode().split("\0") if n else []
    return dict(zip(names, np.frombuffer(raw[4 + n :], "<u2").tolist(), strict=True))


_workers: dict[tuple, CountPieces] = {}


def _counter(vocabulary: str, key: object, data: bytes) -> CountPieces:
    if (vocabulary, key) not in _workers:
        _workers.clear()
        _workers[vocabulary, key] = CountPieces(vocabulary, unpacked_table(data))
    return _workers[vocabulary, key]


def frequent_pieces(docs: DataFrame, vocabulary: str, most: int = TABLE) -> list[str]:
    """The pieces of the first tier, from bounded tallies of all texts."""

    def tally(batches):
        cut, seen = CountPieces.cuts.findall, Counter()
        for batch in batches:
            for t in batch.column("text").to_pylist():
                if t:
                    seen.update(cut(" " + t.replace("▁", " ")))
                if len(seen) > TALLY:
                    seen = Counter(dict(seen.most_common(TALLY // 4)))
        top = [(p, n) for p, n in seen.most_common(HANDED) if n > 1 and len(p) <= LONGEST and "\0" not in p]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["piece", "n"])

    sums = common.stored(docs.select("text").mapInArrow(tally, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")), "frequent")
    # from the highest power-of-two-thirds class of counts down, as many classes as the table holds
    level = F.floor(F.log2("n") * 3).cast("int")
    classes = sorted(((r["l"], r["k"]) for r in sums.groupBy(level.alias("l")).agg(F.count("*").alias("k")).collect()), reverse=True)
    total, lowest = 0, None
    for l, k in classes:
        if total + k > most:
            break
        total, lowest = total + k, l
    return [] if lowest is None else sorted(r["piece"] for r in sums.where(level >= lowest).select("piece").collect())


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row; docs needs doc_id and text.

    A null or empty text has no bytes and no tokens. Rows that repeat give a row each.
    Other columns are not used. An empty table gives an empty table.
    """
    pieces = frequent_pieces(docs, vocabulary)
    counter = CountPieces(vocabulary)
    table = packed_table({k: v for k, v in counter.add(pieces).items() if v < 65535})
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        counter = None
        for batch in batches:
            counter = counter or _counter(vocabulary, hash(sent.value), sent.value)
            for at in range(0, batch.num_rows, tokens.GROUP):
                part = batch.slice(at, tokens.GROUP)
                texts = [t or "" for t in part.column("text").to_pylist()]
                n = counter.counts(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.documents(spark, sf_dir))
