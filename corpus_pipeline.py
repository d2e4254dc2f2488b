"""Corpus pipeline: quality by language-model perplexity, language, near copies, packing.

Each stage works on all documents that the one before has kept, and is judged on its own input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftmill.llm import language, near_copies, packing, quality
from siftmill.llm.common import cut_lineage, read
from siftmill.llm.queries import trusted

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose perplexity lies above their language's threshold."""
    return quality.keep_good(docs, trusted(spark, sf_dir))


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language stays uncertain or is none of the labelled ones."""
    return language.keep_identified(docs, language.fit(docs))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the smallest id, of each group of near copies: five-word shingles,
    similarity of 0.8 or more."""
    return near_copies.drop_near_copies(docs, width=5, percent=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every piece of every document left into a sequence."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [("quality", good), ("language", identified), ("near copies", distinct), ("packing", packed)]
#: SQL can express none of the first three stages; the tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each on what the one before has written."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        docs = out if name == STAGES[-1][0] else cut_lineage(out)
    return docs
