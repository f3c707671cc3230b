"""Discordant spans counted inside split spans, against counting one by one."""

import random

import pytest

from annulus.operators import evidence

SPLITS = "tile_id string, chrom string, start long, end long, sc long"
DISCORDANTS = "tile_id string, chrom string, start long, end long"


def assigned(spark, splits, discordants, reach, keys=("tile_id",)):
    return evidence.assign_discordants(spark.createDataFrame(splits, SPLITS), spark.createDataFrame(discordants, DISCORDANTS), reach, keys)


@pytest.mark.parametrize("reach", (0.0, 1.0, 1.5, 2.0, 7.3, 50.0, 64.0, 129.0))
@pytest.mark.parametrize("keys", (("tile_id",), ()))
def test_counts_equal_counting_one_by_one(spark, reach, keys):
    rng = random.Random(int(reach * 10))
    draw = lambda: (rng.choice(("s", "t", None)), rng.choice(("a", "b")), s := rng.randrange(-90, 160), s + rng.randrange(-5, 300))
    splits = [(*draw(), k) for k in range(120)] + [("s", "a", None, 9, 1), ("s", "a", 9, None, 1), ("s", None, 1, 200, 1)]
    splits += splits[:4]
    discordants = [draw() for _ in range(500)] + [("s", "a", None, 9), ("s", "a", 5, None), ("s", None, 2, 199)]
    discordants += discordants[:60]

    def inside(split):
        t, c, s, e, _ = split
        if None in (c, s, e) or keys and t is None:
            return 0
        return sum(1 for u, d, x, y in discordants if d == c and (u == t or not keys) and None not in (x, y) and s < x < s + reach and e - reach < y < e)

    expected = [(*r, inside(r)) for r in splits]
    got = [(r.tile_id, r.chrom, r.start, r.end, r.sc, r.discordants) for r in assigned(spark, splits, discordants, reach, keys).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_no_span_meets_another(spark):
    """One join, that of the counts; a tile of many spans and many discordants has no pairs of both."""
    splits = spark.range(4000).selectExpr("'t' AS tile_id", "'c' AS chrom", "id % 60 AS start", "5000 + id AS end", "1 AS sc")
    found = evidence.assign_discordants(splits, splits.selectExpr("tile_id", "chrom", "start", "end"), 3000.0)
    assert found._jdf.queryExecution().executedPlan().toString().count("Join") == 1
    expected = sum(1 for e in range(0, 4000, 400) for d in range(max(0, e - 2999), e) if d % 60 > e % 60)
    assert found.where("(end - 5000) % 400 = 0").agg({"discordants": "sum"}).first()[0] == expected
