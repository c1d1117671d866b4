"""Exact deduplication by deterministic block naming.

A text is cut into blocks of a fixed number of bytes.  All blocks are sorted and each distinct block
gets an integer name.  Names of neighbouring blocks are then paired, distinct pairs are sorted and
named in turn, and so on until one name is left for each text.  Two texts have the same last level
and name if and only if they are equal; no hash decides.

A task sends each distinct block of a batch once, with the list of the places where it stands.  A
block that a third of all rows hold would still meet in one task, so blocks are named twice: first
those of each salt, a number of the task that cut them, and then one block for each of these names.
A name is (number of the hash partition, rank in its sorted blocks), which a repeated task gives
again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, cut, drop_cut, join_counted, partitions, raw_texts, small_batches, text_of

#: A partition's number stands above so many bits of a name.
_RANK_BITS = 40
_CUT = pa.schema([("block", pa.binary()), ("salt", pa.int32()), ("at", pa.list_(pa.struct([("row_key", pa.binary()), ("pos", pa.int64()), ("blocks", pa.int64())])))])
_SALTED = pa.schema([("kind", pa.int32()), ("block", pa.binary()), ("at", _CUT.field("at").type), ("salted", pa.int64())])
_AT = "at array<struct<row_key: binary, pos: bigint, blocks: bigint>>"


def _cutter(size: int, salts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % salts
        for rows in batches:
            places: dict[bytes, list] = {}
            for key, raw in zip(rows.column(0).to_pylist(), raw_texts(rows.column(1)), strict=True):
                blocks = max(1, -(-len(raw) // size))
                for pos in range(blocks):
                    places.setdefault(raw[pos * size : (pos + 1) * size], []).append({"row_key": key, "pos": pos, "blocks": blocks})
            yield batch(_CUT, [list(places), [salt] * len(places), list(places.values())])

    return run


def _name_salted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names for blocks that arrive sorted with their salts: each block once (kind 0), and the places of all (kind 1)."""
    name, last = (TaskContext.get().partitionId() << _RANK_BITS) - 1, None
    for rows in batches:
        names, new = [], []
        for k, own in enumerate(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)):
            if own != last:
                name, last = name + 1, own
                new.append(k)
            names.append(name)
        names = pa.array(names, pa.int64())
        if new:
            first = pa.array(new)
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(new), pa.int32()), rows.column(0).take(first).cast(pa.binary()), pa.nulls(len(new), _SALTED.field("at").type), names.take(first)], schema=_SALTED)
        yield pa.RecordBatch.from_arrays([pa.array([1] * rows.num_rows, pa.int32()), pa.nulls(rows.num_rows, pa.binary()), rows.column(2).cast(_SALTED.field("at").type), names], schema=_SALTED)


def _name_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last names of salted ones, whose blocks arrive sorted."""
    name, last = (TaskContext.get().partitionId() << _RANK_BITS) - 1, None
    for rows in batches:
        names = []
        for block in rows.column(0).to_pylist():
            if block != last:
                name, last = name + 1, block
            names.append(name)
        yield pa.RecordBatch.from_arrays([rows.column(1), pa.array(names, pa.int64())], names=["salted", "name"])


def name_texts(rows: DataFrame, block_bytes: int = 8192) -> DataFrame:
    """The identity (``level``, ``name``) of each ``row_key`` of ``rows`` (``row_key`` binary, ``text``).

    Rows with the same ``row_key`` must have the same text; one row comes back for each key.
    """
    n = partitions(rows.sparkSession)
    blocks = rows.select("row_key", "text").mapInArrow(_cutter(block_bytes, max(1, n // 4)), f"block binary, salt int, {_AT}")
    salted = cut(blocks.repartition(n, "block", "salt").sortWithinPartitions("block", "salt").mapInArrow(_name_salted, f"kind int, block binary, {_AT}, salted bigint"), "kind")
    names = cut(salted.where("kind = 0").select("block", "salted").repartition(n, "block").sortWithinPartitions("block").mapInArrow(_name_sorted, "salted bigint, name bigint"))
    drop_cut(salted, "kind=0")
    now = cut(salted.where("kind = 1").join(names, "salted").select(F.explode("at").alias("p"), "name").select("p.row_key", "p.pos", "p.blocks", "name"))
    drop_cut(salted)
    drop_cut(names)
    most = now.agg(F.max("blocks")).first()[0] or 1
    done = now.where("blocks = 1").select("row_key", F.lit(0).alias("level"), "name").distinct()
    level = 0
    while most > 1:
        level, most = level + 1, -(-most // 2)
        pairs = cut(
            now.where("blocks > 1")
            .groupBy("row_key", F.expr("pos div 2").alias("pos"), F.expr("(blocks + 1) div 2").alias("blocks"))
            .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        )
        names = cut(pairs.groupBy("a", "b").agg(F.count("*").alias("n")).repartition(n, "a", "b").sortWithinPartitions("a", "b").withColumn("name", F.monotonically_increasing_id()))
        total = names.agg(F.sum("n")).first()[0] or 0
        now = cut(join_counted(pairs, names, ["a", "b"], "n", total).select("row_key", "pos", "blocks", "name"))
        drop_cut(pairs)
        drop_cut(names)
        done = done.unionByName(now.where("blocks = 1").select("row_key", F.lit(level).alias("level"), "name"))
    return done


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8192) -> DataFrame:
    """One row for each document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their bytes are; a null text counts as empty, and empty texts equal each
    other.  The row with the largest id of a group stays; a null id is smaller than any other.  Of
    repeated rows with that id exactly one stays.  An empty table gives an empty result; other
    columns of ``docs`` are ignored.
    """
    small_batches(docs.sparkSession)
    text = text_of(docs, text_col)
    own = docs.select(docs[id_col].alias("doc_id"), text.alias("text"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))
    # the digest only tells rows with the same id apart, so that repeated rows share a key
    own = own.withColumn("row_key", F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_sha256"), 256)))
    rows = cut(own.select("row_key", "doc_id", "text_sha256", F.monotonically_increasing_id().alias("nr")))
    known = cut(rows.join(name_texts(own, block_bytes), "row_key"))
    drop_cut(rows)
    groups = cut(known.groupBy("level", "name").agg(F.max(F.struct("doc_id", "nr")).alias("stays"), F.count("*").alias("group_size")))
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    return join_counted(known, groups, ["level", "name"], "group_size", total).select("doc_id", F.col("stays.doc_id").alias("keep_id"), "group_size", (F.col("nr") == F.col("stays.nr")).alias("kept"), "text_sha256")


SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256
FROM t JOIN g ON t.body = g.body
"""
