"""A training corpus from raw documents: five stages, each on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwell.llm import dartminhash, linefreq, lpf, packing
from siftwell.llm.langid import keep_identified
from siftwell.llm.queries import bpe_path
from siftwell.session import stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linefreq.without_boilerplate(docs, "source")  # the site of a document, which has no URL


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dartminhash.first_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lpf.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, bpe_path())


STAGES = [("language identification", language), ("line deduplication", lines), ("near-duplicate removal", near_duplicates), ("repeated passages", repeats), ("packing", packed)]

#: Cross-parsing, signatures and packing have no SQL; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
