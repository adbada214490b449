"""A corpus pipeline over `documents`: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import bpe, langid, mixing, secrets, simhash
from plinth.llm.common import forget, stored, table

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in none of the languages that the labelled ones show, go.

    Null and empty texts go with them; repeated rows are judged each; without labelled rows nothing
    stays; an empty table gives none. All columns pass.
    """
    return langid.accepted(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of the least id, null ids last.

    Rows of one id but of different groups stay each; all null, empty and blank texts are one group;
    an empty table gives none. All columns pass.
    """
    return simhash.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text, and n_chars follows where the text has changed. Null and empty texts stay as they are; all rows and columns stay."""
    return secrets.redact(docs, length="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. Null and empty texts add no words, whatever their copies; the null source is one of its own; repeated rows count each; an empty table gives none. All columns pass."""
    return mixing.emit(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and the SHA-256 of the text decoded from them, repeats encoded each. Null and empty texts have no ids; an empty table gives none."""
    return bpe.round_trip(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mix_sources", mix_sources), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        forget(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
