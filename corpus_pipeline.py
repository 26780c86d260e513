"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, mixing, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written and read again
as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodegraph.llm import exact_dedup, langid, mixing, packing, simhash
from lodegraph.llm.common import drop_scratch, keep_decided, materialize, read_table, scratch_of


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence; those the models reject go."""
    return langid.confident(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original, then the smallest id."""
    return keep_decided(docs, exact_dedup.decisions(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id."""
    return keep_decided(docs, simhash.decisions(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target weights of sources, languages and topics."""
    return mixing.sample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in training sequences."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("simhash_near_dedup", near), ("mix_to_targets", mix), ("best_fit_packing", pack)]

#: The language models and the packing can't be expressed in SQL; tests hold run() against a plain Python form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch_of(spark):
            rows = stage(spark, docs, sf_dir)
            written = materialize(rows, f"stage-{name}", keep=True)
        drop_scratch(before)
        docs = before = written
    return docs
