"""Order by depth and balanced chunks."""

import random

import pytest
from pyspark.sql import functions as F

from annulus.operators import balance

TILES = "chrom string, start long, end long, weight double"


def skewed(n=400):
    """One tile holds a third of all weight, some hold nothing, many are equal."""
    rng = random.Random(5)
    rows = [(f"chr{k % 3}", 300 * k, 300 * k + 300, float(rng.choice((0, 1, 1, 1, 5, rng.randrange(1, 200))))) for k in range(n)]
    return rows + [("chr9", 0, 300, sum(r[3] for r in rows) / 2)]


@pytest.mark.parametrize("chunks", [1, 7, 40])
def test_no_chunk_takes_over_one_and_a_half_shares(spark, chunks):
    rows = skewed()
    got = balance.balanced_chunks(spark.createDataFrame(rows, TILES), chunks).collect()
    held = [0.0] * chunks
    for r in got:
        held[r.chunk] += r.weight
    total = sum(r[3] for r in rows)
    assert sum(held) == pytest.approx(total) and max(held) <= 1.5 * total / chunks + 1e-9
    pieces = {}
    for r in got:
        pieces.setdefault((r.chrom, r.start, r.end), []).append((r.piece, r.pieces))
    assert set(pieces) == {r[:3] for r in rows}
    assert all(sorted(p) == [(k, len(p)) for k in range(len(p))] for p in pieces.values())


def test_reads_of_a_hot_tile_are_dealt_out(spark):
    reads = [("chr1", 0, 300, k) for k in range(4000)] + [("chr2", 300 * (k // 10), 300 * (k // 10) + 300, k) for k in range(8000)]
    df = spark.createDataFrame(reads, "chrom string, start long, end long, rid long")
    tiles = df.groupBy("chrom", "start", "end").agg(F.count("*").alias("weight"))
    dealt = balance.deal(df, balance.balanced_chunks(tiles, 12), 12, F.col("rid"))
    sizes = dealt.select("chunk", "rid", F.spark_partition_id().alias("p")).collect()
    assert sorted(r.rid for r in sizes) == sorted(r[3] for r in reads) and all(r.p == r.chunk for r in sizes)
    held = [sum(r.chunk == c for r in sizes) for c in range(12)]
    assert max(held) <= 1.5 * 12000 / 12


def test_order_by_depth_with_ties_and_nulls(spark):
    rng = random.Random(6)
    rows = [(f"chr{rng.randrange(3)}", k, k + 10, rng.choice((3.0, 3.0, 3.0, 7.5, None, rng.random()))) for k in range(500)]
    got = balance.by_depth(spark.createDataFrame(rows, "chrom string, start long, end long, mean_depth double")).orderBy("place").collect()
    want = sorted(rows, key=lambda r: (r[3] is None, -(r[3] or 0), *r[:3]))
    assert [tuple(r)[:4] for r in got] == want and [r.place for r in got] == list(range(1, 501))


def test_empty_and_weightless(spark):
    empty = spark.createDataFrame([], TILES)
    assert balance.balanced_chunks(empty, 3).count() == 0
    assert balance.by_depth(empty.withColumnRenamed("weight", "mean_depth")).count() == 0
    none = spark.createDataFrame([("a", 0, 1, None), ("a", 1, 2, -3.0), ("a", 2, 3, 0.0)], TILES)
    assert sorted(r.chunk for r in balance.balanced_chunks(none, 3).collect()) == [0, 1, 2]
    with pytest.raises(ValueError):
        balance.balanced_chunks(none, 0)
