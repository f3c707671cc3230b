"""Connected components by alternating large-star and small-star.

Each round is two joins over the edges; the edges of a round are written to the
shared folder, so neither the links nor the labels ever reach the driver. Edges are counted before
each round: ``FEW`` of them, a megabyte, take the same round in one task, without shuffles that
would deal out next to nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annulus.llm.storage import Store

FEW = 1 << 16


def _near(df: DataFrame, few: bool) -> DataFrame:
    return df.coalesce(1) if few else df


def _dealt_anew(least: DataFrame) -> DataFrame:
    """The same rows, but no longer known to be dealt by u: the join then shuffles both sides itself and can split a hot u."""
    return least.select(F.bitwise_not(F.bitwise_not("u")).alias("u"), "m")


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    both = _near(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), few)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(_dealt_anew(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(_dealt_anew(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _near(moved.union(least.select("u", F.col("m").alias("v"))), few)


def connected_components(edges: DataFrame, store: Store, name: str = "components") -> DataFrame:
    """Labels (node, label) of every node with an edge; label is the least node reachable.

    edges: two long columns u and v, in any direction, repeats and loops allowed
    (nulls and loops are ignored). No edges give no labels.
    """
    few = edges.count() <= FEW
    now = store.keep(
        _near(edges, few).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(),
        f"{name}-0",
    )
    mark, turn = None, 0
    while True:
        seen = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if tuple(seen) == mark or seen[0] == 0:
            break
        mark, turn = tuple(seen), turn + 1
        few = seen[0] <= FEW
        large = _large_star(_near(now, few), few).distinct()
        now = store.keep(_small_star(large, few).where("u <> v").distinct(), f"{name}-{turn}")
        if turn > 1:
            store.drop(f"{name}-{turn - 2}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
