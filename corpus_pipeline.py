"""The corpus pipeline: known languages, exact copies out, near copies out, source weights, packing.

Each stage works on all that its predecessor kept and, but for the last, returns the columns of
documents; ``run`` writes each stage's rows to the shared folder, reads them again for the next and
deletes what only the stages before needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leadloom.llm import exact_dedup, language_id, mixing, ngram_join, packing
from leadloom.llm.common import documents, dropped, settled


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.kept(docs)


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.kept(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.kept(docs)


def weighted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.query(spark, docs)


STAGES = [
    ("language ID", known_language),
    ("exact dedup", first_copies),
    ("n-gram Jaccard join", one_of_each_group),
    ("mixing sources to target weights", weighted),
    ("packing", packed),
]

#: A trained network and a tokenizer decide here, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{number}")
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
