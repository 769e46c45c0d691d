"""Language identification with a string kernel.

The kernel is a blended spectrum of presence: two texts' common n-grams of 1 to 4 bytes
(in lower case, with all that is no letter as one blank), over the root of the product
of their numbers. Training takes every labelled text, each language with the same weight
in all. Landmarks are ``LANDMARKS`` signed sums of the texts, every text in one of them (a
random sketch, so they span about what the texts' leading directions do). One-versus-rest
ridge regression on the Nyström features over them needs only sums over the texts, which
tasks make; the driver gets the landmarks and those sums, no texts.

A presence kernel is an inner product of presence vectors, so the landmarks fold into
one weight for each n-gram and language; a batch of texts is scored by one product of
its presence matrix with those weights.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Hashed n-grams, their lengths, and documents whose rows are multiplied at once.
GRAMS, LENGTHS, BATCH = 1 << 15, (1, 2, 3, 4), 32
#: Landmarks and the ridge.
LANDMARKS, RIDGE = 256, 1e-3
#: Beginnings of texts that are learned besides the whole ones, in bytes: short texts are to be told as well.
SNIPPETS = (40, 160)
UNDETERMINED = "und"
#: The pipeline rejects documents that score below this part of the least that any text
#: learned from gets for its own language.
REJECTED = 0.9

_BLANKED = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def has_letter(text: str) -> bool:
    """A character of Unicode's letter categories (so neither digits, nor fractions, nor superscripts)."""
    return any(map(str.isalpha, text))


def presence(text: bytes) -> np.ndarray:
    """The hashed n-grams of a text, with repeats."""
    b = np.frombuffer(b" " + b" ".join(text.translate(_BLANKED).split()) + b" ", np.uint8).astype(np.uint32)
    code, out = np.zeros(len(b), np.uint32), []
    for n in LENGTHS:
        if len(b) < n:
            break
        code = (code[: len(b) - n + 1] << np.uint32(8)) | b[n - 1 :]
        out.append(((code + np.uint32(0x9E3779B9 * n & 0xFFFFFFFF)) * np.uint32(2654435761)) >> np.uint32(17))
    return np.concatenate(out)


def matrix(texts: list[bytes]) -> np.ndarray:
    """Presence rows, each over the root of its number: their products are kernels."""
    x = np.zeros((len(texts), GRAMS), np.float32)
    for i, t in enumerate(texts):
        x[i, presence(t)] = 1
    return x / np.sqrt(x.sum(1, keepdims=True))


class Model:
    """languages, and a weight for each n-gram and language, with a constant each."""

    def __init__(self, languages: list[str], weights: np.ndarray, constants: np.ndarray):
        self.languages, self.weights, self.constants = languages, weights, constants

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return matrix(texts) @ self.weights + self.constants


class Landmarks:
    """Sums of presence rows, and what turns kernels with them into Nyström features."""

    def __init__(self, z: np.ndarray, root: np.ndarray):
        self.z, self.root = z, root

    @classmethod
    def of(cls, z: np.ndarray) -> Landmarks:
        """Made once and sent: eigenvectors need not be the same on two machines."""
        values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
        kept = values > max(1e-6 * values.max(), 1e-12)
        return cls(z, vectors[:, kept] / np.sqrt(values[kept]))

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Features of some texts, the last one a constant."""
        return np.hstack([(matrix(texts) @ self.z.T).astype(np.float64) @ self.root, np.ones((len(texts), 1))])

    def sums(self, texts: list[bytes], of: list[int], weights: np.ndarray, languages: int) -> np.ndarray:
        """What the regression needs of some texts: a row for each feature, of its weighted
        products with all features and with each language's texts being of it."""
        phi = self.features(texts)
        return (phi * weights[:, None]).T @ np.hstack([phi, np.eye(languages)[of]])

    def solved(self, sums: np.ndarray, languages: list[str], ridge: float) -> Model:
        n = len(sums)
        penalty = np.full(n, ridge * sums[-1, n - 1])  # the constant with itself: all weights
        penalty[-1] = 1e-9
        w = np.linalg.solve(sums[:, :n] + np.diag(penalty), sums[:, n:])
        return Model(languages, (self.z.T @ (self.root @ w[:-1])).astype(np.float32), w[-1].astype(np.float32))


def fit(texts: list[bytes], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """A model of all of some texts, each of the same weight, in memory."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((GRAMS, 0), np.float32), np.zeros(0, np.float32))
    z = np.zeros((min(landmarks, len(texts)), GRAMS), np.float32)
    for i, t in enumerate(texts):
        z[i % len(z)] += matrix([t])[0] * (1 - 2 * (zlib.crc32(t) & 1))
    marks = Landmarks.of(z)
    total = np.zeros((marks.root.shape[1] + 1, marks.root.shape[1] + 1 + len(languages)))
    for at in range(0, len(texts), 256):
        part = texts[at : at + 256]
        total += marks.sums(part, [languages.index(x) for x in labels[at : at + 256]], np.ones(len(part)), len(languages))
    return marks.solved(total, languages, ridge)


def _lowered(text: str) -> bytes:
    return text.lower().encode()


def _forms(text: str) -> list[bytes]:
    """What is learned of a text: the whole and its beginnings; of one without a letter nothing."""
    if not has_letter(text):
        return []
    whole = _lowered(text)
    return list(dict.fromkeys([whole, *(whole[:n] for n in SNIPPETS)]))


_ROWS = "i int, x binary"


def _rows(numbers, vectors) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array([v.tobytes() for v in vectors], pa.binary())], names=["i", "x"])


def _sketched(root_weights: dict[str, float]):
    """Landmarks of texts that are dealt by landmark: each comes whole from one task."""

    def run(batches):
        held = {}
        for batch in batches:
            for i, h, text, lang in zip(*(batch.column(c) for c in ("i", "h", "text", "lang")), strict=True):
                i, h = i.as_py(), h.as_py()
                for k, t in enumerate(_forms(text.as_py())):
                    if i not in held:
                        held[i] = np.zeros(GRAMS, np.float32)
                    held[i] += matrix([t])[0] * ((1 - 2 * (h >> k & 1)) * root_weights[lang.as_py()])
        for i, z in held.items():
            yield _rows([i], [z])

    return run


def _regressed(sent):
    """A task's sums for the regression, by feature."""

    def run(batches):
        z, root, languages, weights = sent.value
        marks, number, total = Landmarks(z, root), {x: i for i, x in enumerate(languages)}, None
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                forms = [(t, number[lang]) for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True) for t in _forms(text)]
                if forms:
                    texts, of = map(list, zip(*forms, strict=True))
                    sums = marks.sums(texts, of, weights[of], len(languages))
                    total = sums if total is None else total + sums
        if total is not None:
            yield _rows(range(len(total)), total)

    return run


def _added(batches):
    held = {}
    for batch in batches:
        for i, x in zip(batch.column("i").to_pylist(), batch.column("x").to_pylist(), strict=True):
            held[i] = held.get(i, 0) + np.frombuffer(x)
    if held:
        yield _rows(list(held), held.values())


def _stacked(rows: DataFrame, dtype) -> np.ndarray:
    found = rows.toArrow().sort_by("i")
    return np.array([np.frombuffer(x, dtype) for x in found.column("x").to_pylist()], dtype)


def _labelled(docs: DataFrame) -> DataFrame:
    return docs.where("text IS NOT NULL AND lang IS NOT NULL")


def train(docs: DataFrame) -> Model:
    """A model from all labelled rows, all languages of the same weight. Rows without text
    or language have no part, and texts without a letter have none but in their language's
    number of rows. Two passes: landmarks, then the sums of the regression."""
    labelled = _labelled(docs)
    found = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(found)
    weights = np.array([1 / found[x] for x in languages])
    h = F.xxhash64(F.col("doc_id").cast("string"), "text")
    dealt = labelled.select(F.pmod(h, F.lit(LANDMARKS)).cast("int").alias("i"), F.pmod(F.shiftright(h, 32), F.lit(1 << 16)).cast("int").alias("h"), "text", "lang")
    root_weights = dict(zip(languages, np.sqrt(weights).tolist(), strict=True))
    z = _stacked(dealt.repartition("i").mapInArrow(_sketched(root_weights), _ROWS), np.float32)
    if not len(z):
        return fit([], [])
    marks = Landmarks.of(z)
    sent = docs.sparkSession.sparkContext.broadcast((marks.z, marks.root, languages, weights))
    sums = labelled.select("text", "lang").mapInArrow(_regressed(sent), _ROWS)
    total = _stacked(sums.repartition("i").mapInArrow(_added, _ROWS), np.float64)
    sent.destroy()  # the landmarks, which no one needs any more
    return marks.solved(total, languages, RIDGE)


def least(docs: DataFrame, model: Model) -> float:
    """The least score that any labelled text, or a learned beginning of it, gets for its own language."""
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.constants))

    @F.arrow_udf("double")
    def own(texts: pa.Array, langs: pa.Array) -> pa.Array:
        model, out = Model(*sent.value), []
        for text, lang in zip(texts, langs, strict=True):
            forms = _forms(text.as_py())
            out.append(float(model.scores(forms)[:, model.languages.index(lang.as_py())].min()) if forms else None)
        return pa.array(out, pa.float64())

    found = _labelled(docs).select(own("text", "lang").alias("s")).agg(F.min("s")).first()[0]
    sent.destroy()
    return 0.0 if found is None else found


def told(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    """Languages and scores of some texts, ``BATCH`` of them multiplied at once.

    ``und`` with score 0 where the text is null or has no letter (or nothing was
    learned). Score: the regression's value for the language, brought within 0 to 1.
    """
    langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    some = [i for i, t in enumerate(texts) if t and has_letter(t)] if model.languages else []
    for at in range(0, len(some), BATCH):
        part = some[at : at + BATCH]
        values = model.scores([_lowered(texts[i]) for i in part])
        for i, best, v in zip(part, values.argmax(1).tolist(), values.max(1).tolist(), strict=True):
            langs[i], scores[i] = model.languages[best], min(1.0, max(0.0, v))
    return langs, scores


def teller(spark: SparkSession, model: Model):
    """A column function of a text: struct(lang, score). Only texts go to the workers, only this comes back."""
    sent = spark.sparkContext.broadcast((model.languages, model.weights, model.constants))

    @F.arrow_udf("lang string, score double")
    def tell(texts: pa.Array) -> pa.Array:
        model, langs, scores = Model(*sent.value), [], []
        for at in range(0, len(texts), BATCH):
            a, b = told(texts.slice(at, BATCH).to_pylist(), model)
            langs += a
            scores += b
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return tell


def identify(docs: DataFrame, modulus: int = 5) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the rows that are not held out.

    docs needs doc_id, text and lang. Held out: crc32 of the id modulo 5 is 0. Rows
    that repeat give a row each; an empty table gives an empty table; other columns
    are not used.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", (common.remainder("doc_id", modulus) == 0).alias("held_out"))
    tell = teller(docs.sparkSession, train(rows.where("NOT held_out")))
    return rows.select("doc_id", "held_out", tell("text").alias("t")).select("doc_id", "held_out", F.col("t.lang").alias("lang_pred"), "t.score")


def accepted(docs: DataFrame, modulus: int = 5, part: float = REJECTED) -> DataFrame:
    """docs, with all their columns, without the rows whose language cannot be told.

    Those are rows whose text is null, empty or has no letter, and rows whose best score
    is below ``part`` of the least that any text learned from gets for its own language
    (so the bound moves with the number of languages and what was learned of them).
    With nothing to learn from, no language can be told and no row is left. Rows that
    repeat are judged alike; an empty table gives an empty table.
    """
    learning = docs.where(common.remainder("doc_id", modulus) != 0)
    model = train(learning)
    common.give_back(docs.sparkSession)
    judged = teller(docs.sparkSession, model)(F.col("text"))
    return docs.where((judged["lang"] != UNDETERMINED) & (judged["score"] >= part * least(learning, model)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(common.documents(spark, sf_dir))
