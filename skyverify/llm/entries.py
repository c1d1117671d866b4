"""Queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, langid, licenses, packing, quality, sharding, simhash, suffix_tree, warc

#: Folder of the vocabulary files; by default the installed package's.
VOCABULARY = os.environ.get("TOKENIZER_FILE", public_tokenizers.path("byte_bpe_50k.json"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_crc(doc_id: Column) -> Column:
    """CRC-32 of the id as text; a null id counts as empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(documents(spark, sf_dir))


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return suffix_tree.score(docs, id_crc(docs["doc_id"]) % 10 == 0)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths: a source is a top folder, with folders of 4096 and of 64 neighbouring ids."""
    docs = documents(spark, sf_dir)
    folders = [F.coalesce(F.col("source"), F.lit("unknown")), F.expr("cast(doc_id div 4096 as string)"), F.expr("cast(doc_id div 64 as string)"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))]
    return licenses.scan(docs, F.concat_ws("/", *folders), keep="doc_id")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), VOCABULARY)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.decode(bpe.encode(documents(spark, sf_dir), VOCABULARY), VOCABULARY))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derivatives(warc.responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return made.withColumns({"header_sha256": F.sha2(made["headers"].cast("binary"), 256), "block_sha256": F.sha2(made["block"], 256)}).drop("headers", "block")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = id_crc(docs["doc_id"]) % 4 == 2
    got = langid.predict(docs, langid.fit(docs.where(~held)))
    return got.select("doc_id", (id_crc(got["doc_id"]) % 4 == 2).alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_suffix_tree, op3_licenses, op4_packing, op5_bpe, op6_exact_dedup, op7_sharding, op8_warc, op9_quality, op10_langid)}


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": exact_dedup.SQL}
