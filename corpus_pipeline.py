"""A training corpus from ``documents`` in five stages.

Each stage takes the session, its predecessor's documents and the folder of the
tables, and is written as Parquet and read again before the next.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import language, mixing, piece_codec, simhash, toxicity
from riskloom.llm.runtime import materialize, table
from riskloom.plans import storage


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters that are in one language for the larger part."""
    return language.drop_unidentified(docs, language.train(docs, language.learning_rows()))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7, learned from the labels of the documents at hand."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group linked by fingerprints of two bits or fewer."""
    return simhash.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeat_to_mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of ids of every document taken, and the digests of its ids and of their decoding."""
    return piece_codec.piece_round_trips(docs, piece_codec.default_model())


STAGES = [
    ("language ID", identified),
    ("toxicity", not_toxic),
    ("near-dedup by SimHash", one_of_each),
    ("mixing sources to target weights", mixed),
    ("SentencePiece encoding and decoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage has stored goes when its result is written, and that when the next one's is."""
    docs, began = table(spark, sf_dir, "documents"), storage.written()
    for i, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"corpus-stage-{i}")
        storage.forget(spark, began, keep=(f"corpus-stage-{i}-",))
    return docs


#: Learned models and random rounding have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None
