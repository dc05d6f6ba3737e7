"""A corpus pipeline of five stages: toxicity, near-dedup, PII, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the
last return the columns of ``documents``, other columns among them, whatever their names.

Nulls, empty and very long texts, repeated rows and ties are the operators' own matter; of the
pipeline they ask: rows with a null text or ``doc_id`` pass every stage that doesn't reject them by
its rule, texts are read whole, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartolith.llm import mixing, neardup, packing, pii, queries, toxicity
from cartolith.llm.common import materialise, table

#: The mix takes as many tokens as there are, from each document at most twice.
BUDGET, EPOCHS, SEED = 1.0, 2, 29


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at the threshold or above go.

    A null or empty text has the score of a text without features and stays; repeated rows share a
    score; labels of unknown or null ids are ignored.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the one with the least ``doc_id``.

    Of repeated rows one stays; documents with a null text are no copies and all stay; empty texts
    are copies of each other; a null ``doc_id`` stays only where its class has no other.
    """
    return neardup.without_copies(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers and dates become pseudonyms of the same format and length; no row goes, a null text stays null."""
    return pii.pseudonymise(docs, pii.secret_key())


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights take them.

    A null language or source is a key of its own; null and empty texts have no tokens and follow
    their place in the epoch; repeated rows are taken one by one.
    """
    return mixing.select_rows(docs, queries.domain_of(), queries.WEIGHTS, BUDGET, EPOCHS, SEED)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences; a null or empty text is its end id."""
    return packing.packed_digests(docs, queries.vocabulary("word_bpe_49k.json"), end_id=2)


STAGES = [("toxicity", drop_toxic), ("near_dedup", near_dedup), ("pii", pseudonyms), ("mixing", mix), ("packing", pack)]

#: Training, consistent sampling and tokenizing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, name)
    return docs
