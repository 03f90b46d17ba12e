"""A corpus pipeline of five stages over the table of documents.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the docs of the next one.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from inkscore.llm.decontaminate import without_items
from inkscore.llm.language import of_known_language
from inkscore.llm.neardup import first_of_each
from inkscore.llm.packing import pack_documents
from inkscore.llm.shared import in_small_batches, settle
from inkscore.llm.spans import with_repeats_removed

# A document goes if no language has this share of its letters' probability. A
# text half in one language and half in another keeps about 0.5, and a sound one
# of a few words may have 0.35.
LEAST_SCORE = 0.3


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def bounded(stage: Stage) -> Stage:
    """The stage with small batches: neither a task nor its Python worker holds much of the texts."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        in_small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and those of no language that was learned."""
    return of_known_language(docs, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: of those that SimHash
    fingerprints of three-word shingles with three or fewer differing bits join."""
    return first_of_each(docs, shingle=3, radius=3)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that stood before are cut out."""
    return with_repeats_removed(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences of 1024 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", bounded(language)),
    ("near_duplicates", bounded(near_duplicates)),
    ("substrings", bounded(substrings)),
    ("decontamination", bounded(decontamination)),
    ("packing", bounded(packing)),
]

# Neural language labels and tokenizer ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
