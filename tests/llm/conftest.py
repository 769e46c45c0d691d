import pytest
from pyspark.sql import types as T

from keystate.llm import common

WORDS = {
    "en": "the of and that thing over water house morning river walked quickly because never".split(),
    "de": "der die und über schön straße morgen fluss häuser schnell weil niemals gegangen".split(),
    "fr": "le la et être forêt maison matin rivière jamais parce vite allé école".split(),
}


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    common.ship(spark)


@pytest.fixture(scope="session")
def prose():
    """Deterministic documents in three languages: (doc_id, text, lang, source)."""
    import random

    rnd, out = random.Random(5), []
    for i in range(240):
        lang = ("en", "de", "fr")[i % 3]
        lines = [" ".join(rnd.choice(WORDS[lang]) for _ in range(rnd.randrange(3, 25))).capitalize() + "." for _ in range(rnd.randrange(1, 9))]
        out.append((i, "\n".join(lines), lang, f"s{min(i % 7, 3)}"))
    return out


SCHEMA = "doc_id long, text string, lang string, source string"

# columns whose names the operators also use inside
CLASHING = ["size", "Score", "fp", "key", "copies", "word", "codes", "rank", "h", "part", "k", "slice", "_text", "_s", "_row", "lang_pred", "component_id", "n_chars"]


@pytest.fixture(scope="session")
def messy(spark, prose):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing columns."""
    rows = [list(r) for r in prose[:40]]
    rows += [[900, None, "en", "s0"], [901, "", "en", None], [902, " \t\n ", None, "s1"], [903, "!!! 123 ...", "fr", None], [None, "a text without an id", "en", "s0"], [None, None, None, None]]
    rows += [list(prose[3]), list(prose[3]), [904, prose[3][1], "en", "s9"], [905, "word " * 60_000, "en", "s0"], [906, "x" * 50_000, "de", "s2"], [907, "<|endoftext|> it's 日本 \x00 ẞ é", "fr", "s1"]]
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())]
    fields += [T.StructField(c, T.StringType()) for c in CLASHING]
    data = [(*r, *["x" if i % 2 else None for i in range(len(CLASHING))]) for r in rows]
    return spark.createDataFrame(data, T.StructType(fields)).repartition(3)


@pytest.fixture(scope="session")
def nothing(messy, spark):
    return spark.createDataFrame([], messy.schema)
