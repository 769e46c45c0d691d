"""Mixing sources to target weights by Pareto order sampling (DataFrame operations only).

Each source gets a target number of words. With ``f`` the target over the source's
size, every document is certain of ``floor(f)`` whole copies. What is left of the target
is filled by a sample in which a document's inclusion probability is in proportion to
its words, ``least(1, size / level)``; the level is the one at which the expected words
are what is left. Documents of the level's size and more are certain of one more copy.
The others are ranked by their random odds over their inclusion odds,
``(u / (1 - u)) / (p / (1 - p))``, smallest first, and the first of the ranking are taken
until their words fill what is left. ``u`` comes from SHA-256 of the id, so reruns agree.

No source is ever sorted as a whole: the ranking is cut into 2**12 slices of its
range, whose sums are small, then the slice that the cut falls into once more. Only
the documents of one slice of a slice (1 in 2**24 of a source) are sorted together, and
equal rows of it as one row with a count. The level comes from one row for each size
in words that a source has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source's target is at most so many times its size.
MOST = 3
SLICES = 4096
#: Tables of a row for each source are broadcast up to so many rows, about 100 bytes each.
MOST_SENT = 100_000


def targets(sizes: DataFrame, weights=WEIGHTS, most=MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    The targets share the sum of all sizes by weight; what a target exceeds ``most``
    times its source's size by is shared again. That process ends at
    ``least(most * size, level * weight)`` for one level. Sources run up in order of
    ``most * size / weight``; those before the level are held at their bound.
    One row for each source, so one task is enough.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("n") % len(weights) + 1).cast("int"))
    every = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("n", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("w", w.cast("long"))
    before = every.orderBy(F.col("source_size") / F.col("w"), "n").rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        ranked.withColumn("held", F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0)))
        .withColumn("held_w", F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("total_w", F.sum("w").over(every))
        .withColumn("at", (F.col("total") - F.col("held")).cast("double") / (F.col("total_w") - F.col("held_w")))
        .withColumn("fits", F.col("at") * F.col("w") <= F.lit(most) * F.col("source_size"))
    )
    # of equal ratios the first decides: the later ones count it as held
    level = F.max_by("at", F.when(F.col("fits"), F.struct(-F.col("source_size") / F.col("w"), -F.col("n")))).over(every)
    return levels.withColumn("level", level).select("source", "source_size", F.least(F.lit(float(most)) * F.col("source_size"), F.col("level") * F.col("w")).alias("target"))


def _levels(small: DataFrame, per_source: DataFrame, joined) -> DataFrame:
    """(_s, _level): the size from which on documents are certain of one more copy.

    With the sizes over n certain, the level would be the words squared of the others
    over what is left to them; the largest n that does not exceed its own level decides.
    """
    sizes = small.where("n > 0").groupBy("_s", "n").agg(F.count("*").alias("k"))
    n, k = F.col("n").cast("decimal(38,0)"), F.col("k").cast("decimal(38,0)")
    up = Window.partitionBy("_s").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("_s").orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    squares = F.sum((n * n * k).cast("decimal(38,0)")).over(up).cast("double")
    larger = F.coalesce(F.sum((n * k).cast("decimal(38,0)")).over(down), F.lit(0)).cast("double")
    found = joined(sizes.withColumn("q", squares).withColumn("c", larger), per_source.select("_s", "_left")).where("_left > 0")
    fits = F.col("q") >= F.col("n").cast("double") * (F.col("_left") - F.col("c"))
    level = F.when(F.col("_left") - F.col("c") > 0, F.col("q") / (F.col("_left") - F.col("c")))
    return found.where(fits).groupBy("_s").agg(F.max_by(level, "n").alias("_level"))


def _mixed(docs: DataFrame, size, weights, most, seed: str) -> DataFrame:
    """(_row: docs' columns, size, source_size, target, copies)."""
    words = F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)) if size is None else size
    d = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    x = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), d), 256), 1, 12), 16, 10).cast("long")
    own = [F.col("source").alias("_s"), words.cast("long").alias("n"), x.alias("x"), d.alias("d"), common.row_hash(docs).alias("t")]
    small = common.stored(docs.select(*own), "mix")
    per_source = targets(small.groupBy(F.col("_s").alias("source")).agg(F.sum("n").alias("source_size")), weights, most)
    per_source = (
        per_source.withColumnRenamed("source", "_s")
        .withColumn("_f", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("_whole", F.floor("_f"))
        .withColumn("_left", F.col("target") - F.col("_whole") * F.col("source_size"))
    )
    per_source = common.stored(per_source, "mix-sources")
    n_sources = per_source.count()

    def joined(rows: DataFrame, few: DataFrame) -> DataFrame:
        """few has a row for each source at most; it is sent to all tasks while that is checked to be little."""
        few = few.withColumnRenamed("_s", "_few")
        few = F.broadcast(few) if n_sources <= MOST_SENT else few
        return rows.join(few, F.col("_s").eqNullSafe(F.col("_few")), "left").drop("_few")

    per_source = common.stored(joined(per_source, _levels(small, per_source, joined)), "mix-levels")

    # the rank: random odds over inclusion odds; 0 of the certain, null of documents without words
    p = F.col("n") / F.col("_level")
    u = (F.col("x") + F.lit(0.5)) / F.lit(float(2**48))
    q = F.when((F.col("n") > 0) & (F.col("n") < F.col("_level")), (u / (1 - u)) * ((1 - p) / p)).when(F.col("n") >= F.col("_level"), F.lit(0.0))
    share = F.col("q") / (1 + F.col("q"))
    fine = F.when(F.col("n") >= F.col("_level"), -1).otherwise(F.least(F.floor(share * (SLICES * SLICES)), F.lit(SLICES * SLICES - 1)))
    key = F.struct("q", "x", "d", "n", "t")

    def ranked(rows: DataFrame, few: DataFrame) -> DataFrame:
        return joined(rows, few).withColumn("q", q).withColumn("_fine", fine).withColumn("_coarse", F.floor(F.col("_fine") / SLICES))

    def cut(rows: DataFrame, by: str, base) -> DataFrame:
        """The slice of each source that the cut falls into: its number, and the words below it."""
        sums = rows.groupBy("_s", by).agg(F.sum("n").alias("n"), F.first("_left").alias("_left"), F.first(base).alias("base"))
        to = Window.partitionBy("_s").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.col("base") + F.sum("n").over(to)).where("upto > _left")
        return common.stored(sums.groupBy("_s").agg(F.min(by).alias(f"_at{by}"), F.min_by(F.col("upto") - F.col("n"), by).alias(f"_below{by}")), "mix-cut")

    chosen = ranked(small, per_source).where("q IS NOT NULL AND _left > 0")
    inside = joined(chosen, cut(chosen, "_coarse", F.lit(0).cast("long"))).where("_coarse = _at_coarse")
    at = cut(inside, "_fine", F.col("_below_coarse"))
    edge = joined(chosen, at).where("_fine = _at_fine").groupBy("_s", "q", "x", "d", "n", "t").agg(F.count("*").alias("k"), F.first("_left").alias("_left"), F.first("_below_fine").alias("below"))
    to = Window.partitionBy("_s").orderBy("q", "x", "d", "n", "t").rowsBetween(Window.unboundedPreceding, -1)
    under = F.col("below") + F.coalesce(F.sum(F.col("n") * F.col("k")).over(to), F.lit(0))
    # a row is taken if the words before it and half of its own are up to what is left
    fit = F.floor((2 * F.col("_left") - 2 * under - F.col("n")) / (2 * F.col("n"))) + 1
    edge = edge.withColumn("fit", F.greatest(F.lit(0), F.least(fit, F.col("k"))))
    last = edge.groupBy("_s").agg(F.max(F.when(F.col("fit") == F.col("k"), key)).alias("_last"), F.max(F.when((F.col("fit") > 0) & (F.col("fit") < F.col("k")), F.struct(key.alias("key"), "fit"))).alias("_tied"))
    cuts = common.stored(joined(joined(per_source, at), last).drop("_below_fine"), "mix-cuts")

    # a row's own columns travel in a struct, where no name of theirs can meet one of these
    every = ranked(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *own), cuts)
    tied = F.coalesce(key == F.col("_tied.key"), F.lit(False))
    more = (
        F.when(F.col("q").isNull() | (F.col("_left") <= 0), False)
        .when(F.col("_at_fine").isNull() | (F.col("_fine") < F.col("_at_fine")), True)
        .otherwise((F.col("_fine") == F.col("_at_fine")) & F.coalesce(key <= F.col("_last"), F.lit(False)))
    )
    kept = ["_row", F.col("n").alias("size"), "source_size", "target"]
    if not cuts.where("_tied IS NOT NULL").limit(1).count():
        return every.select(*kept, (F.col("_whole") + more.cast("long")).alias("copies"))
    # the cut goes through rows that repeat: so many of them as fit, counted by task
    held = common.stored(every.where(tied).withColumn("_at", F.monotonically_increasing_id()), "mix-tied").withColumn("_task", F.shiftright("_at", 33))
    before = Window.partitionBy("_s").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = held.groupBy("_s", "_task").agg(F.count("*").alias("k")).select(F.col("_s").alias("_few"), F.col("_task").alias("_of"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_s", "_task").orderBy("_at")) + F.col("_before")
    numbered = held.join(counts.hint("merge"), F.col("_s").eqNullSafe(F.col("_few")) & (F.col("_task") == F.col("_of"))).withColumn("_more", nth <= F.col("_tied.fit"))
    return every.where(~tied).select(*kept, (F.col("_whole") + more.cast("long")).alias("copies")).unionByName(numbered.select(*kept, (F.col("_whole") + F.col("_more").cast("long")).alias("copies")))


def mix(docs: DataFrame, size=None, weights=WEIGHTS, most=MOST, seed: str = "mix") -> DataFrame:
    """docs with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` added.

    docs needs doc_id, source and (unless ``size`` is a column) text. A null text has
    size 0; null sources form one source, the last; a null id is the empty one. A
    document without words has the whole copies only; a source without words has target
    0 and no copies. Rows that repeat are ranked each by itself, so the cut may fall
    among them. Of sources with equal ratios the first decides the level. An empty table
    gives an empty table. Other columns of docs are kept; any with the names of the new
    ones are replaced.
    """
    own = ["size", "source_size", "target", "copies", "taken"]
    rest = [f"_row.`{c}`" for c in docs.columns if c.lower() not in own]
    mixed = _mixed(docs, size, weights, most, seed).withColumn("taken", F.col("copies") * F.col("size"))
    return mixed.select(*rest, *own)


def repeated(docs: DataFrame) -> DataFrame:
    """The mix itself: rows of docs as often as they have copies, with docs' columns.

    Nulls, ties, repeated rows and empty tables as in ``mix``; rows without a copy go.
    """
    mixed = _mixed(docs, None, WEIGHTS, MOST, "mix").where("copies > 0")
    return mixed.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    words = F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0))
    narrow = common.stored(docs.select("doc_id", "source", words.alias("n")), "sizes")
    return mix(narrow, size=F.col("n")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source AS s, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(sha256('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS x
  FROM documents
), z AS (
  SELECT s, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY s ASC NULLS LAST) - 1 AS n FROM d GROUP BY s
), w AS (
  SELECT *, CASE n % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM z
), l AS (
  SELECT *, coalesce(sum(3 * source_size) OVER b, 0) AS held, coalesce(sum(w) OVER b, 0) AS held_w,
         sum(source_size) OVER () AS total, sum(w) OVER () AS total_w
  FROM w WINDOW b AS (ORDER BY source_size::DOUBLE / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), a AS (
  SELECT *, (total - held)::DOUBLE / (total_w - held_w)::DOUBLE AS lev FROM l
), v AS (
  SELECT lev AS level FROM a WHERE lev * w <= 3 * source_size ORDER BY source_size::DOUBLE / w, n LIMIT 1
), t AS (
  SELECT s, source_size, least(3.0::DOUBLE * source_size, level * w) AS target FROM a, v
), f AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS f FROM t
), g AS (
  SELECT *, floor(f)::BIGINT AS whole, target - floor(f) * source_size AS rest FROM f
), k AS (
  SELECT s, size, count(*) AS k FROM d WHERE size > 0 GROUP BY s, size
), c AS (
  SELECT s, size, coalesce(sum(size * k) OVER (PARTITION BY s ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS larger,
         (sum(size::HUGEINT * size * k) OVER (PARTITION BY s ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE AS squares
  FROM k
), e AS (
  SELECT c.s, arg_max(squares / nullif(rest - larger, 0), size) AS level FROM c JOIN g ON c.s IS NOT DISTINCT FROM g.s
  WHERE rest > 0 AND squares >= size::DOUBLE * (rest - larger) GROUP BY c.s
), o AS (
  SELECT d.*, g.source_size, g.target, g.whole, g.rest, e.level, d.size / e.level AS p, (d.x + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
  FROM d JOIN g ON d.s IS NOT DISTINCT FROM g.s LEFT JOIN e ON d.s IS NOT DISTINCT FROM e.s
), q AS (
  SELECT *, CASE WHEN size = 0 THEN NULL WHEN size >= level THEN 0 ELSE (u / (1 - u)) * ((1 - p) / p) END AS q FROM o
), r AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY s ORDER BY q NULLS LAST, x, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under FROM q
)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN rest > 0 AND size > 0 AND 2 * under + size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
