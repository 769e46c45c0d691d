"""A training corpus from raw documents: four stages, each written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keystate.llm import common, language_id, mixing, packing, simhash


#: The stages share their workers, so packing keeps fewer pieces and cuts less text at once.
CACHE_PIECES, PORTION = 300_000, 2 << 20


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; learned from the labelled ones.

    Null, empty and letterless texts go, and texts that score far below all that was
    learned. Columns stay as they are; repeated rows are judged alike; empty gives empty.
    """
    common.ship(spark)
    common.give_back(spark)
    return language_id.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest id.

    Rows without an id stay; different texts under one id stay; of repeated rows one
    stays, the same in every run. Columns stay as they are; empty gives empty.
    """
    common.ship(spark)
    common.give_back(spark)
    return simhash.deduplicated(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target weights: a document comes as often as its copies.

    A null source is a source, a null text has no words, rows that repeat are ranked each
    by itself. Columns stay as they are; empty gives empty.
    """
    common.give_back(spark)
    return mixing.repeated(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of up to 2,048 tokens.

    A null text is its end id alone, repeated rows are packed as often as they come;
    empty gives empty.
    """
    common.ship(spark)
    common.give_back(spark)
    return packing.pack(docs, cache_pieces=CACHE_PIECES, portion=PORTION)


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("source_mixing", mixture),
    ("best_fit_packing", packed),
]

#: Token ids and learned kernels are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.stored(docs, f"pipeline-{name}")
    return docs
