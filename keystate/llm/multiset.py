"""Document fingerprints: a homomorphic multiset hash of paragraphs (DataFrame operations only).

A paragraph is a line of the text. It is hashed to a wide vector: a head of 8 lanes of
32 bits from its SHA-256, and a body of 256 lanes of 24 bits, in which each chunk of its
sentences (of up to 64 characters) adds 1 to one lane or takes 1 from it, as the chunk's
MD5 says. The fingerprint of a text is the sum of its paragraphs' vectors, lane by lane,
modulo 2**32 in the head and 2**24 in the body. So the order of paragraphs has no part in
it, adding or removing a paragraph adds or subtracts its vector, and equal texts have
equal fingerprints.

The head decides equality. The body is a random projection of the counts of chunks: the
cosine of two bodies (of their lanes' signed roots, which dampen repeats) follows that of
the counts, with a noise of about 0.06 at any length. Texts that share nothing get about
0, texts that share three quarters of their chunks about 0.75.

An edited text's vector is worked out from the text's: the lines that stay, and the
difference of what goes and what comes.

As text, a fingerprint is 8 * 8 and 256 * 6 lowercase hex digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

HEAD, BODY, CHUNK = 8, 256, 64
HEAD_MOD, BODY_MOD = 2**32, 2**24
#: Rows of a slice in which each document meets the next one, and slices at most.
SLICE_ROWS, SLICES = 4096, 10_000


def _number(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("long")


def _let(value: Column, of) -> Column:
    """of(value), with the value worked out once: lambda bodies else repeat it at each use and element."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def vector(text: Column) -> Column:
    """array<bigint> of HEAD + BODY lanes: the sum of the paragraphs' vectors; zeros for null, which has no paragraph."""

    def head(hashes: Column) -> Column:
        sums = [F.aggregate(hashes, F.lit(0).cast("long"), _adding(1 + 8 * i)) for i in range(HEAD)]
        return F.array(*[F.pmod(x, F.lit(HEAD_MOD)) for x in sums])

    def group(items: Column, g: Column) -> Column:
        """16 lanes, from the items that fall to them."""
        lane = lambda own: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + F.when(F.shiftright(x, 1) % 16 == i, 1 - 2 * (x % 2)).otherwise(0)))
        return _let(F.filter(items, lambda x: F.shiftright(x, 5) == g), lane)

    def body(items: Column) -> Column:
        lanes = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(BODY // 16 - 1)), lambda g: group(items, g)))
        return F.transform(lanes, lambda v: F.pmod(v, F.lit(BODY_MOD)))

    def sums(paragraphs: Column) -> Column:
        sentences = F.flatten(F.transform(paragraphs, lambda p: F.split(p, "\\. ", -1)))
        chunks = F.flatten(F.transform(sentences, lambda x: F.regexp_extract_all(x, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))))
        # of 512 numbers, twice the lane, and one more if the chunk takes 1 from it
        items = F.transform(chunks, lambda c: F.conv(F.substring(F.md5(c), 1, 3), 16, 10).cast("int") % (2 * BODY))
        return F.concat(_let(F.transform(paragraphs, lambda p: F.sha2(p, 256)), head), _let(items, body))

    return F.when(text.isNull(), F.array_repeat(F.lit(0).cast("long"), HEAD + BODY)).otherwise(_let(F.split(text, "\n", -1), sums))


def _adding(at: int):
    return lambda a, h: a + _number(F.substring(h, at, 8))


def fingerprint(lanes: Column) -> Column:
    """A vector as text."""
    digits = F.transform(lanes, lambda v, i: F.lower(F.when(i < HEAD, F.lpad(F.hex(v), 8, "0")).otherwise(F.lpad(F.hex(v), 6, "0"))))
    return F.array_join(digits, "")


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """The vector of the two texts' paragraphs together (or, with -1, of a's without b's)."""
    return F.zip_with(F.transform(a, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), b, lambda x, y: F.pmod(x["v"] + sign * y, F.when(x["i"] < HEAD, F.lit(HEAD_MOD)).otherwise(F.lit(BODY_MOD))))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: 1 for equal vectors, else the cosine of the bodies' signed roots, 0 if it is negative or a body is zero.

    Roots, so that a line that repeats does not outweigh all others; in whole numbers of
    4096ths, so that sums are the same in any order.
    """

    def signed(v: Column) -> Column:
        root = lambda x: F.floor(F.sqrt(x) * 4096)
        return F.transform(F.slice(v, HEAD + 1, BODY), lambda x: F.when(x < BODY_MOD // 2, root(x)).otherwise(-root(BODY_MOD - x)))

    def total(products: Column) -> Column:
        return F.aggregate(products, F.lit(0).cast("long"), lambda s, x: s + x).cast("double")

    def cosine(xy: Column) -> Column:
        x, y = xy["x"], xy["y"]
        across = total(F.zip_with(x, y, lambda p, q: p * q))
        lengths = F.sqrt(total(F.transform(x, lambda p: p * p))) * F.sqrt(total(F.transform(y, lambda p: p * p)))
        return _let(F.struct(across.alias("across"), lengths.alias("lengths")), lambda v: F.when(v["across"] <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), v["across"] / v["lengths"])))

    return F.when(a == b, F.lit(1.0)).otherwise(_let(F.struct(signed(a).alias("x"), signed(b).alias("y")), cosine))


def with_next(docs: DataFrame, rows: int = SLICE_ROWS, vectors: bool = False) -> DataFrame:
    """(doc_id, text, next): each document and the text of the next one by id.

    Ids are cut into slices at quantiles, which are ids of the table. The first
    document of a slice is also sent to the slice before it (the very first to the
    last, as the next of the last), so each slice finds all its neighbours by itself.
    Null ids come first, ties go by text. Slices are some thousands of rows, and more
    where ids repeat or there are over ``SLICES`` times as many rows; a slice spills to disk.
    With ``vectors``, also the texts' vectors, a and next_a: each text is hashed once.
    """
    low = -(2**63)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("k"))
    n, first = keyed.agg(F.count("*"), F.min("k")).first()
    parts = max(1, min(SLICES, n // rows))
    cuts = keyed.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)] or [0.5], 10 * parts)).first()[0] if parts > 1 else []
    cuts = sorted({first if first is not None else 0, *(cuts or [])})
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts])
    # the number of bounds up to k, by halving
    slice_of = _rank(F.col("k"), cuts)
    at_bound = F.element_at(bounds, F.col("slice")) == F.col("k")
    before = F.when(F.col("slice") == 1, F.lit(len(cuts))).otherwise(F.col("slice") - 1)
    here = F.struct(F.col("slice").alias("slice"), F.lit(False).alias("guest"))
    there = F.struct(before.alias("slice"), F.lit(True).alias("guest"))
    spread = keyed.withColumn("slice", slice_of).withColumn("to", F.explode(F.when(at_bound, F.array(here, there)).otherwise(F.array(here))))
    spread = spread.select("doc_id", "text", "k", "to.slice", "to.guest")
    along = Window.partitionBy("slice").orderBy("guest", "k", "text")
    met = spread.withColumn("next", F.lead("text").over(along))
    if not vectors:
        return met.where(~F.col("guest")).select("doc_id", "text", "next")
    # text and edited text are one head and different rests
    n = F.char_length("text")
    kept = F.col("text").substr(F.lit(1), n - F.floor(n / 4).cast("int"))
    at = F.instr(F.reverse(kept), "\n")
    met = met.withColumn("edit", edited(F.col("text"), F.coalesce("next", F.lit("")))).withColumn("at", F.when(at > 0, F.char_length(kept) - at + 1))
    head, rest = F.when(F.col("at").isNotNull(), F.col("text").substr(F.lit(1), F.col("at") - 1)), F.coalesce(F.col("at"), F.lit(0)) + 1
    met = met.withColumn("h", vector(head)).withColumn("removed", vector(F.col("text").substr(rest, n))).withColumn("added", vector(F.col("edit").substr(rest, F.char_length("edit"))))
    met = met.select("guest", "slice", "k", "text", "doc_id", "edit", combined(F.col("h"), F.col("removed")).alias("a"), combined(F.col("h"), F.col("added")).alias("b"))
    return met.withColumn("next_a", F.lead("a").over(along)).where(~F.col("guest")).select("doc_id", "text", "edit", "a", "b", "next_a")


def _rank(k: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are up to k: nested comparisons, as deep as the logarithm."""

    def within(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return F.lit(hi)
        mid = (lo + hi) // 2
        return F.when(k < F.lit(cuts[mid]), within(lo, mid)).otherwise(within(mid, hi))

    return within(0, len(cuts))


def edited(text: Column, following: Column) -> Column:
    """The last quarter of the text's code points replaced by as many of the next text's first."""
    n = F.char_length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    docs needs doc_id and text. A null or empty text is one empty paragraph. A table
    of one row has itself as the next. An empty table gives an empty table. Rows that
    repeat give a row each, ties of the id go by text; other columns are not used.
    """
    pairs = with_next(docs, vectors=True)
    a, b, c = (F.col(x) for x in ("a", "b", "next_a"))
    return pairs.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edit", 256).alias("edited_sha256"), fingerprint(a).alias("fingerprint"), fingerprint(b).alias("edited_fingerprint"), likeness(a, b).alias("near_edited"), likeness(a, c).alias("near_next")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(common.documents(spark, sf_dir))


# In SQL: h a text's paragraph hashes, m its chunks' numbers.
_LANES = """list_concat(
    list_transform(range(8), lambda i: list_sum(list_transform(h, lambda x: ('0x' || substr(x, (1 + 8 * i)::BIGINT, 8))::BIGINT))::BIGINT % 4294967296),
    list_transform(range(256), lambda i: (16777216 + len(list_filter(m, lambda x: x = 2 * i)) - len(list_filter(m, lambda x: x = 2 * i + 1)))::BIGINT % 16777216))"""
_TEXT = "array_to_string(list_transform({0}, lambda v, i: CASE WHEN i <= 8 THEN printf('%08x', v) ELSE printf('%06x', v) END), '')"
_SIGNED = "list_transform(list_slice({0}, 9, 264), lambda x: CASE WHEN x < 8388608 THEN floor(sqrt(x) * 4096)::BIGINT ELSE -floor(sqrt(16777216 - x) * 4096)::BIGINT END) AS s{0}"
_DOT = "list_sum(list_transform(list_zip(s{0}, s{1}), lambda z: z[1] * z[2]))::DOUBLE"
_LIKE = f"CASE WHEN {{0}} = {{1}} THEN 1.0::DOUBLE WHEN {_DOT} > 0 THEN least(1.0::DOUBLE, {_DOT} / (sqrt({_DOT.format('{0}', '{0}')}) * sqrt({_DOT.format('{1}', '{1}')}))) ELSE 0.0::DOUBLE END"


def _hashes(of: str, name: str) -> str:
    lines = f"string_split({of}, chr(10))"
    chunks = f"flatten(list_transform(flatten(list_transform({lines}, lambda x: string_split(x, '. '))), lambda x: regexp_extract_all(x, '(?s).{{1,64}}')))"
    return f"list_transform({lines}, lambda x: sha256(x)) AS h{name}, list_transform({chunks}, lambda x: ('0x' || substr(md5(x), 1, 3))::BIGINT % 512) AS m{name}"


def _lanes(name: str) -> str:
    return _LANES.replace("(h,", f"(h{name},").replace("(m,", f"(m{name},")


SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS n FROM documents
), p AS (
  SELECT a.doc_id, a.t, b.t AS nx, length(a.t) AS n
  FROM d a JOIN d b ON b.n = CASE WHEN a.n = (SELECT max(n) FROM d) THEN 1 ELSE a.n + 1 END
), e AS (
  SELECT doc_id, n, t, nx, substr(t, 1, n - n // 4) || substr(nx, 1, n // 4) AS e FROM p
), hs AS (
  SELECT doc_id, n, sha256(e) AS es, {_hashes("t", "t")}, {_hashes("e", "e")}, {_hashes("nx", "n")} FROM e
), v AS (
  SELECT doc_id, n, es, {_lanes("t")} AS a, {_lanes("e")} AS b, {_lanes("n")} AS c FROM hs
), w AS (
  SELECT *, {_SIGNED.format("a")}, {_SIGNED.format("b")}, {_SIGNED.format("c")} FROM v
)
SELECT doc_id, n::BIGINT AS n_chars, es AS edited_sha256, {_TEXT.format("a")} AS fingerprint, {_TEXT.format("b")} AS edited_fingerprint,
       {_LIKE.format("a", "b")} AS near_edited, {_LIKE.format("a", "c")} AS near_next
FROM w
"""
