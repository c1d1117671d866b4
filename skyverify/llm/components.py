"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


#: Rows of a task that writes a round's table, so that small tables take few tasks.
ROWS = 20_000


def _written(df: DataFrame, rows: int) -> DataFrame:
    return cut(df.coalesce(max(2, -(-rows // ROWS))))


def _least(edges: DataFrame, rows: int) -> DataFrame:
    """The least neighbour ``m`` of each ``u``, written: joins with it then have plain sides, of which skewed ones are split."""
    return _written(edges.groupBy("u").agg(F.min("v").alias("m")), rows)


def _large_star(edges: DataFrame, rows: int, used: list[DataFrame]) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    used.append(_least(both, 2 * rows))
    return both.where("v > u").join(used[-1], "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame, rows: int, used: list[DataFrame]) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    used.append(_least(down, rows))
    moved = down.join(used[-1], "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(used[-1].select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``u, v`` long); ``root`` is the least node reachable.

    Each round is written to the shared folder and only its count and a checksum reach the driver.
    The number of rounds grows with the logarithm of the longest path.
    """

    def sum_of(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = cut(edges.where("u <> v").select("u", "v").distinct())
    seen = sum_of(now)
    while seen[0]:
        used: list[DataFrame] = [now]
        rows = seen[0]
        wide = _written(_large_star(now, rows, used), rows)
        after = _written(_small_star(wide, rows, used), rows)
        new = sum_of(after)
        for x in (*used, wide):
            drop_cut(x)
        now = after
        if new == seen:
            break
        seen = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
