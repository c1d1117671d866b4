"""Corpus preparation: language ID, quality rules, exact and near deduplication, then packing.

Each stage works on all that the one before it kept; all but the last return the columns of documents,
and any others that were there.  ``docs`` is a written table.  An empty one gives an empty result in
every stage, rows are judged by their texts alone, and null or repeated ids change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyverify.llm import exact_dedup, langid, packing, quality, simhash
from skyverify.llm.common import cut, drop_cut
from skyverify.llm.entries import VOCABULARY


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has letters and is in a language that the labelled ones teach.

    A null or empty text goes.  Equal texts share a fate.  Without any label nothing is learned and
    everything goes.
    """
    return langid.keep_known(docs, langid.fit(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the compression bands keep; a null or empty text goes, equal texts share a fate."""
    return quality.keep_good(docs)


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each row of ``docs`` as a struct under a number, and (number as doc_id, text).

    ``docs`` is a written table, whose rows get the same numbers in both.  Numbers stand in for ids,
    so that exactly one row of a group stays even where ids are null or repeated.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("nr"), F.struct("*").alias("row"))
    return rows, rows.select(F.col("nr").alias("doc_id"), F.col("row.text").alias("text"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the last row.  Null texts equal empty ones."""
    rows, texts = _numbered(docs)
    keep = exact_dedup.exact_dedup(texts).where("kept").select(F.col("doc_id").alias("nr"))
    return rows.join(keep, "nr", "left_semi").select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, the first row: texts whose sets of 5-word shingles have SimHash fingerprints that differ in at most three bits, or a Jaccard similarity of 0.8 or more.

    See ``simhash.near_copies``.  Texts of fewer than five words are one shingle, so null, empty and
    blank ones equal each other.
    """
    rows, texts = _numbered(docs)
    drop = simhash.near_copies(texts, "doc_id").where("node <> root").select(F.col("node").alias("nr"))
    return rows.join(drop, "nr", "left_anti").select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the documents in training sequences; a null text is an end token alone."""
    return packing.pack(docs, VOCABULARY)


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("exact_dedup", exact), ("near_dedup", near), ("packing", packed)]

#: Learned languages, zstandard and the fitted packing have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder and read again, and deleted after the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        done, docs = docs, cut(stage(spark, docs, sf_dir))
        if k:
            drop_cut(done)
    return docs
