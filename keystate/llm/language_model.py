"""LM scoring with a hidden Markov model over words.

Every word is of one class: a frequent word is a class of its own; of the others those
with like endings share one of ``ENDINGS`` classes; the end of a text is the last class.
A hidden state emits a class; a word of a shared class has in it the share of its
smoothed count. So the model is a proper distribution over all texts, unknown words
included, and a text's probability is that of its classes (the scaled forward recursion
over the whole text) times those of the words in them.

Training counts every word of the learning documents, then runs Baum-Welch: each task
sums the expected counts of its sequences, the sums are added up by class, and the
driver makes new parameters from one row for each class. Training sequences are whole
documents, or if longer than ``WINDOW`` consecutive parts of them, each led in and out
by ``AROUND`` tokens of its neighbours, so a move between parts is counted, and starts are
those of texts. The first parameters are drawn at random around the overall shares, from no
document, and every round counts all learning documents.

Counts of words that are not among the ``TABLE`` most frequent are never broadcast: the
rare words of the documents are joined with them by a shuffle.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, hmm, tokens

#: Words with a class of their own, shared classes, hidden states, rounds over all learning documents.
FREQUENT, ENDINGS, STATES, ROUNDS = 16_384, 2_048, 8, 7
#: Words whose counts are broadcast (about 12 bytes each).
TABLE = 262_144
WINDOW, AROUND = 512, 24
#: Added to every count, and the emissions in overall shares that eke out a state's.
ADDED, EKED = 0.1, 50.0
#: Distinct words that a task tallies before it hands them on, and tokens whose recursion
#: runs at once: training keeps every token's states (some 250 bytes each), scoring none.
TALLY, AT_ONCE, TRAINED_AT_ONCE = 300_000, 1_000_000, 250_000
#: Bytes of text that a worker cuts into words at once; a word costs some 100 bytes meanwhile.
CUT = 2 << 20
END_CLASS = FREQUENT + ENDINGS
CLASSES = END_CLASS + 1


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of texts, lower-cased in A-Z, one after the other; and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, n = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = np.flatnonzero(pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False))
    if len(empty):  # around leading and trailing white space
        owner = np.searchsorted(np.cumsum(n), empty, "right")
        n -= np.bincount(owner, minlength=len(n))
        words = words.filter(pc.greater(pc.binary_length(words), 0))
    return words, n


def _cut(batch: pa.RecordBatch):
    """The batch in portions of ``CUT`` bytes of text: (rows, their words, how many each text has)."""
    for part in tokens.portions(batch, most=CUT):
        yield part, *_words(part.column("text"))


def _joined(words: list[pa.Array], batch: pa.RecordBatch) -> pa.ChunkedArray:
    return pa.chunked_array(words, batch.column("text").type)


def _returning(batches):
    """The batches; after each, what Arrow holds in reserve goes back to the system."""
    for batch in batches:
        yield batch
        pa.default_memory_pool().release_unused()


def _tally(batches):
    held, n = [], 0

    def handed():
        # by one thread, as each would have a table of its own
        both = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
        return both.select(["word", "n_sum"]).rename_columns(["word", "n"])

    for batch in _returning(batches):
        counts = pc.value_counts(_joined([words for _, words, _ in _cut(batch)], batch))
        held.append(pa.table({"word": counts.field(0), "n": counts.field(1)}))
        n += len(counts)
        if n > 2 * TALLY:
            held = [handed()]
            n = len(held[0])
            if n > TALLY:
                yield from held[0].to_batches()
                held, n = [], 0
    if held:
        yield from handed().to_batches()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) of all texts; ends are not in it."""
    return docs.select("text").mapInArrow(_tally, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _ending(words: pa.Array) -> np.ndarray:
    """Each word's shared class: from its last three bytes."""
    coded = pc.binary_slice(words.cast(pa.binary()), -3).dictionary_encode()
    of = np.array([zlib.crc32(e) % ENDINGS for e in coded.dictionary.to_pylist()], np.int32)
    return of[coded.indices.to_numpy(zero_copy_only=False)] if len(of) else np.zeros(0, np.int32)


def _ending_column(word: str):
    return (F.crc32(F.substring(F.col(word).cast("binary"), -3, 3)) % ENDINGS).cast("int")


class Table:
    """The frequent words' classes and counts, as it is broadcast. Words are sorted by count."""

    def __init__(self, words: pa.Array, counts: np.ndarray):
        self.words, self.counts = words, counts

    def places(self, words: pa.ChunkedArray) -> np.ndarray:
        """Place of each word in the table (-1: not in it). Each call hashes the whole table."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy()

    def classes(self, words: pa.Array, at: np.ndarray) -> np.ndarray:
        """Class of each word, of which the places are known."""
        code = at.copy()
        other = (at < 0) | (at >= FREQUENT)
        if other.any():
            code[other] = FREQUENT + _ending(words.filter(pa.array(other)))
        return code


def _coder(sent):
    """Documents to class codes, sums over the words that the table holds, and the rare words."""
    names = ["doc_id", "held_out", "n_tokens", "n_table", "sum_base", "sum_shared", "codes", "rare"]

    def run(batches):
        table, end_count = sent.value
        logs = np.log10(table.counts + ADDED)
        for batch in _returning(batches):
            parts = list(_cut(batch))
            places, done = table.places(_joined([words for _, words, _ in parts], batch)), 0
            for part, words, n in parts:
                place = places[done : done + len(words)]
                done += len(words)
                code = table.classes(words, place)
                ends = np.cumsum(n)
                of = np.repeat(np.arange(len(n)), n)
                known = place >= 0
                # (of no words at all, bincount gives whole numbers)
                sums = np.bincount(of[known], logs[place[known]], len(n)).astype(np.float64) + np.log10(end_count + ADDED)
                shared = known & (place >= FREQUENT)
                sums_shared = np.bincount(of[shared], logs[place[shared]], len(n)).astype(np.float64)
                rare = words.filter(pa.array(~known))
                rare_offsets = np.concatenate([[0], np.cumsum(np.bincount(of[~known], minlength=len(n)))]).astype(np.int32)
                full = np.insert(code.astype("<i4"), ends, END_CLASS).astype("<i4")
                bounds = np.concatenate([[0], ends + np.arange(1, len(n) + 1)])
                raw = full.tobytes()
                codes = [raw[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(n + 1), pa.array(np.bincount(of[known], minlength=len(n))), pa.array(sums), pa.array(sums_shared), pa.array(codes, pa.binary()), pa.ListArray.from_arrays(pa.array(rare_offsets), rare)],
                    names=names,
                )

    return run


def _portions(batch: pa.RecordBatch, most: int):
    """The batch's texts in portions of so many tokens: (list of code arrays, documents from, to)."""
    held, n, since = [], 0, 0
    codes = batch.column("codes")
    for i, c in enumerate(codes):
        held.append(np.frombuffer(c.as_buffer(), "<i4"))
        n += len(held[-1])
        if n >= most or i == len(codes) - 1:
            yield held, since, i + 1
            held, n, since = [], 0, i + 1


def _parts(texts: list[np.ndarray], window: int = WINDOW, around: int = AROUND) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Texts as training sequences: codes, offsets, and where each one's own tokens begin and end."""
    parts, lo, hi = [], [], []
    for x in texts:
        for at in range(0, len(x), window):
            since, end = max(0, at - around), min(len(x), at + window)
            parts.append(x[since : end + around])
            lo.append(at - since)
            hi.append(end - since)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])]), (np.array(lo), np.array(hi))


def _sized(codes: np.ndarray, offsets: np.ndarray, own: tuple[np.ndarray, np.ndarray], most: int):
    """Training sequences in like portions of about so many tokens, however long the texts are."""
    size = -(-len(codes) // max(1, round(len(codes) / most)))
    part = (offsets[1:] - 1) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield codes[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], (own[0][a:b], own[1][a:b])


_COUNTS = "class int, " + ", ".join(f"s{j} double" for j in range(STATES))


def _expect(sent):
    """Expected counts of a task: rows by class; moves as classes -1 - state, starts as -100."""

    def run(batches):
        p = hmm.Parameters(*sent.value)
        total = np.zeros((len(p.emit), STATES))
        starts, moves = np.zeros(STATES), np.zeros((STATES, STATES))
        for batch in _returning(batches):
            for texts, _, _ in _portions(batch, TRAINED_AT_ONCE):
                for codes, offsets, own in _sized(*_parts(texts), TRAINED_AT_ONCE):
                    s, m, e, _ = hmm.expected_counts(codes, offsets, p, own)
                    starts += s
                    moves += m
                    total += e
        some = np.flatnonzero(total.any(1))
        classes = np.concatenate([some, -1 - np.arange(STATES), [-100]]).astype(np.int32)
        rows = np.vstack([total[some], moves, starts[None, :]])
        yield pa.RecordBatch.from_arrays([pa.array(classes), *(pa.array(rows[:, j]) for j in range(STATES))], names=["class", *(f"s{j}" for j in range(STATES))])

    return run


def _score(sent):
    def run(batches):
        p = hmm.Parameters(*sent.value)
        for batch in _returning(batches):
            for texts, lo, hi in _portions(batch, AT_ONCE):
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
                value = hmm.log_likelihoods(np.concatenate(texts), offsets, p) / np.log(10)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in ("key", "doc_id", "held_out", "n_tokens", "n_table", "sum_base", "sum_shared")), pa.array(value)], names=["key", "doc_id", "held_out", "n_tokens", "n_table", "sum_base", "sum_shared", "log_p"])

    return run


def frequent(counts: DataFrame, most: int) -> pa.Table:
    """The words of the highest classes of counts, as many classes as hold ``most`` words at most."""
    level = F.floor(F.log2("c") * 8).cast("int")
    sizes = sorted(((r["l"], r["n"]) for r in counts.groupBy(level.alias("l")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, lowest = 0, None
    for l, n in sizes:
        if total + n > most:
            break
        total, lowest = total + n, l
    chosen = counts.where(level >= lowest) if lowest is not None else counts.limit(0)
    return chosen.select("word", "c").toArrow().sort_by([("c", "descending"), ("word", "ascending")])


def score_documents(docs: DataFrame, modulus: int = 10) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row.

    docs needs doc_id and text. Learns from the rows that are not held out (crc32 of the
    id modulo 10 is not 0). A null or empty text is its end alone. Rows that repeat give
    a row each. With nothing to learn from, every word is unknown. Other columns are not
    used; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (common.remainder("doc_id", modulus) == 0).alias("held_out"))
    learning = rows.where("NOT held_out")
    counts = common.stored(count_words(learning), "word-counts")
    n_ends = learning.count()
    by_ending = counts.groupBy(_ending_column("word").alias("e")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    n_words = sum(r["n"] for r in by_ending) + n_ends
    n_distinct = sum(r["v"] for r in by_ending) + (n_ends > 0)
    top = frequent(counts, TABLE)
    table = Table(top.column("word").combine_chunks() if top.num_rows else pa.array([], pa.string()), top.column("c").to_numpy())
    # what the shared classes hold: all words but those with a class of their own
    class_n, class_v = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in by_ending:
        class_n[r["e"]], class_v[r["e"]] = r["n"], r["v"]
    own = _ending(table.words[:FREQUENT])
    class_n -= np.bincount(own, table.counts[:FREQUENT], ENDINGS)
    class_v -= np.bincount(own, minlength=ENDINGS)
    overall = np.concatenate([table.counts[:FREQUENT], np.zeros(FREQUENT - min(FREQUENT, len(table.words))), class_n, [n_ends]]) + ADDED
    overall[min(FREQUENT, len(table.words)) : FREQUENT] = 1e-9  # classes that no word has
    shares = overall / overall.sum()

    coded = rows.mapInArrow(_coder(context.broadcast((table, n_ends))), "doc_id long, held_out boolean, n_tokens long, n_table long, sum_base double, sum_shared double, codes binary, rare array<string>")
    coded = common.stored(coded.withColumn("key", F.monotonically_increasing_id()), "coded")
    p = hmm.seeded(shares, STATES)
    if n_ends:
        for _ in range(ROUNDS):
            sums = coded.where("NOT held_out").select("codes").mapInArrow(_expect(context.broadcast((p.start, p.move, p.emit))), _COUNTS).groupBy("class").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(STATES)])
            found = sums.toArrow()
            at, values = found.column("class").to_numpy(), np.stack([found.column(f"s{j}").to_numpy() for j in range(STATES)], axis=1)
            emissions, moves = np.zeros((CLASSES, STATES)), np.zeros((STATES, STATES))
            emissions[at[at >= 0]] = values[at >= 0]
            moves[-1 - at[(at < 0) & (at > -100)]] = values[(at < 0) & (at > -100)]
            p = hmm.maximised(values[at == -100].sum(0), moves, emissions, shares, EKED)
    # a word of a shared class: (c + 0.1) over this; the first factor comes with the word
    emit = p.emit.copy()
    emit[FREQUENT:END_CLASS] /= (class_n + ADDED * (class_v + 1))[:, None]
    scored = coded.select("key", "doc_id", "held_out", "n_tokens", "n_table", "sum_base", "sum_shared", "codes").mapInArrow(_score(context.broadcast((p.start, p.move, emit))), "key long, doc_id long, held_out boolean, n_tokens long, n_table long, sum_base double, sum_shared double, log_p double")

    rare = coded.select("key", F.explode("rare").alias("word")).join(counts, "word", "left")
    rare = rare.groupBy("key").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(ADDED))).alias("sum_rare"), F.count("c").alias("n_rare"))
    n, log_all = F.col("n_tokens"), F.log10(F.lit(n_words + ADDED * (n_distinct + 1)))
    sum_rare = F.coalesce("sum_rare", F.lit(0.0))
    return scored.join(rare, "key", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_table") + F.coalesce("n_rare", F.lit(0)) + F.lit(int(n_ends > 0))).alias("n_known"),
        F.lit(n_words).cast("long").alias("train_tokens"),
        (F.col("sum_base") + sum_rare - n * log_all).alias("base_score"),
        (F.col("log_p") + F.col("sum_shared") + sum_rare).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(common.documents(spark, sf_dir))
