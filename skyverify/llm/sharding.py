"""Uniform shuffle into shards of exact size through a hypergeometric communication matrix.

How many rows each input partition sends to each shard is drawn first: the matrix has the
distribution that a uniform permutation of all rows would give it.  Each partition then permutes its
rows, deals them out by its row of the matrix, and each shard permutes what it received.  The result
is a uniform permutation cut into shards of exact size.

Everything on rows is a DataFrame expression.  Only row counts of partitions and the matrix pass
through the driver: a number for each partition and shard, none for a document.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_of

#: Rows of a shard that one window of the second permutation is meant to hold.
WINDOW_ROWS = 50_000


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """An exact draw by inversion, outward from the mode; the steps grow with the standard deviation."""
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))
    up = down = mode
    p_up = p_down = math.exp(log_choose(good, mode) + log_choose(bad, drawn - mode) - log_choose(good + bad, drawn))
    left = rng.random() - p_up
    while left > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
    return mode


def communication_matrix(rng: random.Random, rows: list[int], sizes: list[int]) -> list[list[int]]:
    """[partition][shard]: how many rows go where; sums are ``rows`` and ``sizes``."""
    left, out = list(sizes), []
    for n in rows:
        line, rest = [], sum(left)
        for k, size in enumerate(left):
            x = hypergeometric(rng, size, rest - size, n)
            rest -= size
            n -= x
            line.append(x)
            left[k] -= x
        out.append(line)
    return out


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    ``shard`` runs from 0 and shard sizes are at most one apart; which shards take the rows that are
    over is drawn too.  ``slot`` runs from 0 without gaps within a shard, in uniformly random order.
    ``size`` is the text's UTF-8 bytes plus 8 and a null text has none, with CRC 0.  ``grown_shard``
    is null, since the law is ``rows``.  Ids may be null or repeated; equal rows are dealt out like
    any others.  An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    raw = text_of(docs, text_col).cast("binary")
    slim = cut(
        docs.select(
            docs[id_col].alias("doc_id"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
            F.spark_partition_id().alias("from"), F.monotonically_increasing_id().alias("nr"),
        )
    )
    rng = random.Random(seed)
    counts = sorted((r["from"], r["count"]) for r in slim.groupBy("from").count().collect())
    total = sum(n for _, n in counts)
    sizes = [total // shards + (k < total % shards) for k in range(shards)]
    rng.shuffle(sizes)
    matrix = communication_matrix(rng, [n for _, n in counts], sizes)
    ends = [(p, [sum(line[: k + 1]) for k in range(shards)]) for (p, _), line in zip(counts, matrix, strict=True)]
    dealt = spark.createDataFrame(ends, "from int, ends array<bigint>")
    rank = F.row_number().over(Window.partitionBy("from").orderBy(F.xxhash64(F.lit(seed), "nr"), "nr"))
    placed = slim.withColumn("rank", rank).join(dealt, "from").withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("rank"))))
    # the second permutation: random order is by a hash, and ranges of the hash are windows of their own
    bins = max(1, -(-max(sizes, default=0) // WINDOW_ROWS))
    order = F.xxhash64(F.lit(seed + 1), "nr")
    placed = cut(placed.select("doc_id", "size", "text_crc32", "shard", "nr", F.floor((order / F.lit(2.0**64) + 0.5) * bins).cast("int").alias("bin"), order.alias("order")))
    before = placed.groupBy("shard", "bin").count().withColumn("before", F.sum("count").over(Window.partitionBy("shard").orderBy("bin")) - F.col("count")).drop("count")
    within = F.row_number().over(Window.partitionBy("shard", "bin").orderBy("order", "nr")) - 1
    return placed.withColumn("within", within).join(before, ["shard", "bin"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("before") + F.col("within")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
