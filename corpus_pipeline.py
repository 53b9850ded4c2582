"""From raw documents to packed training sequences, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet to the session's shared folder and the next stage reads it from there, so a
lost executor costs no more than the stage at work.  All stages but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatt.llm import common, mixing, packing, pii, simhash, toxicity
from tidewatt.llm.queries import WEIGHTS
from tidewatt.session import settled, written_so_far


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that are predicted toxic."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id."""
    return simhash.without_near_copies(docs)


def personal_data_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by the kind in brackets."""
    return pii.without_personal_data(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as its source's target weight asks for, shuffled."""
    return mixing.replicate(docs, WEIGHTS).select("document.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy's pieces with their token ids, sequence and place in it."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("simhash_near_dedup", near_copies_out),
    ("pii", personal_data_out),
    ("source_mixing", mixed),
    ("best_fit_packing", packed),
]

# Tokenising, decoding and the fitted classifiers are beyond SQL; the tests hold a brute-force version against run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    mark = written_so_far()
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), mark)
    return STAGES[-1][1](spark, docs, sf_dir)
