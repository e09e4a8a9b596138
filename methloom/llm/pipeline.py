"""The corpus pipeline: language, lines, near-duplicates, benchmark leaks, mixture.

Each stage works on all that the one before kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, language, lines, mixing, simhash
from .common import scratch, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found.

    A row goes if its text is null, empty or without a letter, or if no language has a score of a half or
    more; of equally probable ones the first by name counts. A row goes for its own text: of rows of one
    doc_id, or of none, others stay. Repeated rows stay or go together; texts of any length count whole;
    an empty table, or one without lang, keeps nothing. Further columns pass, whatever their names."""
    return language.accepted(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand, equal or nearly so, at an earlier place.

    No row goes. A null text stays null, an empty one empty; blank lines stay. Of equal places the
    first by doc_id (null last), text hash and line stays; rows equal in doc_id and text are one
    document and stay alike. Lines of any length count whole. n_chars, where there is one, is
    counted anew; further columns pass, whatever their names."""
    return lines.without_duplicates(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: fingerprints at 3 bits or fewer, as op1 links them, or
    five-word shingles of a Jaccard similarity of 0.8.

    The smallest doc_id of a group stays (null last, then the smallest text hash; of repeated rows all).
    Texts without words, null and empty ones, are one group. Texts of any length count whole; an
    empty table stays empty; further columns pass, whatever their names."""
    return simhash.keep_first(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands.

    A row goes for its own text, repeated rows together; null and empty texts stay, as do all rows
    where the benchmark is empty. Texts of any length are searched whole; further columns pass,
    whatever their names."""
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: each document, whole, with its size, its source's target and the words taken of it.

    Null sources are one source, the last; null and empty texts have size 0 and take nothing; equal
    rows share a place and are interchangeable. Of clashing names the mixture's columns count; an
    empty table stays empty."""
    return mixing.mix(docs, whole=True)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_leaks),
    ("source_mixing", mix_sources),
]

#: Learned models and fingerprints of fuzzy lines have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = scratch(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
