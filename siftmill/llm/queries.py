"""Queries of this subpackage: one per operator over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.llm import fingerprint, language, main_text, manifest, near_copies, nearest, oracles, packing, piece_lattice, quality, spelling, token_counts, token_files, toxicity
from siftmill.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of documents labelled good and not toxic."""
    return read(spark, sf_dir, "labels").where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), trusted(spark, sf_dir))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = token_files.write_token_files(read(spark, sf_dir, "documents"))
    return token_files.read_token_files(spark, folder, index)


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return main_text.extract(pages, main_text.fit(pages))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(read(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.top_k(read(spark, sf_dir, "embeddings"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.fit(read(spark, sf_dir, "documents"))
    return language.identify(read(spark, sf_dir, "pages"), model, "page_id", "html", url="url", html=True)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


def op6_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_copies(read(spark, sf_dir, "documents"), width=2)


def op10_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_lattice.round_trip(read(spark, sf_dir, "documents"))


def _key_hash() -> Column:
    """Unsigned crc32 of the decimal ``doc_id``."""
    return F.crc32(F.col("doc_id").cast("string"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(read(spark, sf_dir, "documents"), slips=31))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = read(spark, sf_dir, "documents"), _key_hash() % 4 == 2
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels").where(~held)), held_out=held)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(read(spark, sf_dir, "documents"), tampered=_key_hash() % 3 == 0)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_quality_classifier, op2_token_files, op3_main_text, op4_fingerprints, op5_best_fit_packing, op6_near_copies, op7_exact_top_k, op8_language_id, op9_token_counts, op10_piece_lattice, op11_spelling_variants, op12_toxicity, op13_merkle_manifest)}
ORACLES: dict[str, str] = {"op11_spelling_variants": oracles.VARIANTS, "op13_merkle_manifest": oracles.MANIFEST}
