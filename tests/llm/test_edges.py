"""Every operator on a messy table and on an empty one: one defined row for each input row."""

import zlib

import pytest
from pyspark.sql import functions as F

from keystate.llm import language_id, language_model, licences, media, mixing, multiset, packing, simhash, token_counts, token_output


def _coded(docs):
    spark = docs.sparkSession
    from keystate.llm import common

    path = common.new_path(spark, "test")
    token_output.write_ids(docs, path)
    return token_output.read_ids(spark, path)


OPERATORS = {
    "op1": language_model.score_documents,
    "op2": _coded,
    "op3": simhash.near_duplicates,
    "op4": token_counts.count_tokens,
    "op6": multiset.compare_edited,
    "op7": mixing.mix,
    "op8": licences.scan,
    "op9": language_id.identify,
    "op10": lambda d: media.features(media.as_media(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_messy_rows_each_have_one_result(messy, name):
    out = OPERATORS[name](messy).collect()
    asked = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in messy.select("doc_id").collect())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out) == asked


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_give_empty_results(nothing, name):
    assert OPERATORS[name](nothing).count() == 0


def test_packing_edges(messy, nothing):
    assert packing.pack(nothing).count() == 0
    out = packing.pack(messy).collect()
    assert len({(r["doc_id"], r["piece"]) for r in out}) > 54
    assert [r["length"] for r in out if r["doc_id"] == 900] == [1]  # a null text is its end id
    assert sum(r["piece"] == 0 for r in out if r["doc_id"] == 3) == 3  # a repeated row is packed each time


def test_defined_results_of_null_and_empty(messy):
    by = lambda df: {r["doc_id"]: r for r in df.collect()}
    counts = by(token_counts.count_tokens(messy))
    assert (counts[900]["n_bytes"], counts[900]["n_tokens"]) == (0, 0) == (counts[901]["n_bytes"], counts[901]["n_tokens"])
    assert not any(map(language_id.has_letter, ("½ ² ¼", "12", "_", ""))) and language_id.has_letter("1 é")
    langs = by(language_id.identify(messy))
    assert [langs[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und"] * 4 and langs[903]["score"] == 0
    near = by(simhash.near_duplicates(messy))
    assert [near[i]["fingerprint"] for i in (900, 901, 902)] == ["0" * 16] * 3 and near[902]["component_id"] == 900
    assert near[904]["component_id"] == 3
    scored = by(language_model.score_documents(messy))
    assert scored[900]["n_tokens"] == scored[902]["n_tokens"] == 1 and scored[905]["n_tokens"] == 60_001
    pictures = by(media.features(media.as_media(messy)))
    assert pictures[900]["payload_bytes"] == 576 and pictures[900]["tail_crc32"] == zlib.crc32(b"\xff" * 32)
    assert pictures[900]["media_sha256"] == pictures[901]["media_sha256"]
    mixed = by(mixing.mix(messy))
    assert mixed[900]["size"] == 0 and mixed[903]["source_size"] == 3  # null sources are one source
    prints = by(multiset.compare_edited(messy))
    assert prints[900]["fingerprint"] == prints[901]["fingerprint"] and prints[3]["fingerprint"] == prints[904]["fingerprint"]


def test_filters_keep_columns_and_rows(messy, nothing):
    for act in (language_id.accepted, simhash.deduplicated, mixing.repeated):
        assert act(messy).columns == messy.columns and act(nothing).columns == messy.columns
        assert act(nothing).count() == 0
    kept = {r["doc_id"] for r in language_id.accepted(messy).collect()}
    assert kept.isdisjoint({900, 901, 902, 903}) and set(range(40)) <= kept
    single = simhash.deduplicated(messy).collect()
    ids = [r["doc_id"] for r in single]
    assert ids.count(3) == 1 and 904 not in ids and ids.count(None) == 2


def test_single_row(spark):
    one = spark.createDataFrame([(5, "only one\nhere", "en", "s")], "doc_id long, text string, lang string, source string")
    r = multiset.compare_edited(one).first()
    assert r["near_next"] == 1.0
    assert mixing.mix(one).first()["taken"] == 3
    assert packing.pack(one).count() == 1
    assert simhash.near_duplicates(one).select(F.col("component_id")).first()[0] == 5


def test_intermediate_tables_can_be_discarded(spark, messy):
    from keystate.llm import common

    kept = common.stored(messy.select("doc_id"), "test")
    assert kept.count() == messy.count()
    common.discard(spark)
    again = common.stored(messy.select("doc_id"), "test")
    assert common.discard(spark) == 1 and again.columns == ["doc_id"]
