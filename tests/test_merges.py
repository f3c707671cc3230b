"""Merges, priors and depth of points against plain versions, over many stretches and with hot keys."""

import random
from collections import defaultdict

import pytest

from annulus.operators import evidence, intervals, priors


def spans(n, seed, length=120, chroms=("a", "b", None)):
    rng = random.Random(seed)
    made = [(rng.choice(chroms), s := rng.randrange(3000), s + rng.randrange(1, length)) for _ in range(n)]
    return made + [(c, s, s + 900) for c, s, _ in made[:3]] + made[: n // 3]  # some over many stretches, some again


def by_key(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[0]].append(r)
    return {k: sorted(v, key=lambda r: r[1:3]) for k, v in out.items()}


def share_of_both(a, b):
    shared = min(a[2], b[2]) - max(a[1], b[1])
    return max(shared / (a[2] - a[1]), 0) + max(shared / (b[2] - b[1]), 0)


def plain(rows, begins):
    """Islands of rows (key, start, end, item): begins(rows before, row)."""
    found = []
    for k, own in by_key(rows).items():
        islands, before = [], []
        for r in own:
            if not before or begins(before, r):
                islands.append([])
            islands[-1].append(r)
            before.append(r)
        found += [(k, i[0][1], max(r[2] for r in i), i[-1][2], sum(r[3] for r in i)) for i in islands]
    return found


def ordered(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("stretch", (50, 400, 10**6))
def test_islands_equal_a_plain_version(spark, seed, stretch, monkeypatch):
    monkeypatch.setattr(intervals, "STRETCH", stretch)
    data = [(*r, k % 4) for k, r in enumerate(spans(60, seed))]
    df = spark.createDataFrame(data, "chrom string, start long, end long, item long").repartition(5)
    touching = plain(data, lambda before, r: r[1] > before[-1][2])
    got = intervals.merge_touching(df, ["chrom"], {"item": intervals.F.sum}).collect()
    assert ordered(map(tuple, got)) == ordered((k, s, last, n) for k, s, _, last, n in touching)
    for share in (0.2, 0.6):
        expected = plain(data, lambda before, r: share_of_both(before[-1], r) < 2 * share)  # noqa: B023
        assert ordered(map(tuple, intervals.merge_reciprocal(df, share, {"item": intervals.F.sum}).collect())) == ordered(expected)
    for gap in (0, 25):
        expected = plain(data, lambda before, r: r[1] > max(b[2] for b in before) + gap)  # noqa: B023
        assert ordered(map(tuple, intervals.interval_union(df, gap).collect())) == ordered(r[:3] for r in expected)


def test_peaks_equal_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(intervals, "STRETCH", 70)
    rng, at, runs = random.Random(5), 0, []
    for _ in range(60):
        at += rng.choice((0, 3, 40))
        runs.append(("a", at, at := at + rng.choice((1, 20, 300)), rng.randrange(1, 9)))
    expected = []
    for run in runs:
        if expected and run[1] <= expected[-1][2] + 10:
            expected[-1][2] = run[2]
            expected[-1][3].append(run[3])
        else:
            expected.append([*run[:3], [run[3]]])
    got = intervals.peaks(spark.createDataFrame(runs, "chrom string, start long, end long, depth long"), 10).orderBy("start").collect()
    assert [tuple(r) for r in got] == [(c, s, e, sum(d) / len(d)) for c, s, e, d in expected]


def test_merges_of_nothing_and_of_unknown_places(spark):
    none = spark.createDataFrame([], "chrom string, start long, end long, item long")
    assert intervals.interval_union(none).count() == evidence.merge_repeats(none).count() == evidence.discordant_islands(none).count() == 0
    odd = spark.createDataFrame([("a", None, 5, 1), ("a", None, 5, 1), ("a", 3, 9, 1), ("a", 4, None, 1)], "chrom string, start long, end long, item long")
    got = evidence.discordant_islands(odd)
    assert sum(r.discordants for r in got.collect()) == 4


def exchanges(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.count("Exchange hashpartitioning"), text.count("Join")


def test_a_merge_deals_out_rows_once(spark):
    """Equal spans are summed, spans go to their stretch, islands to their key: three exchanges, of fewer rows each, and no join."""
    df = spark.range(1000).selectExpr("concat('c', id % 3) AS chrom", "id * 7 % 991 AS start", "id * 7 % 991 + 20 AS end", "id AS item")
    assert exchanges(evidence.discordant_islands(df)) == (3, 0)
    assert exchanges(intervals.merge_reciprocal(df, 0.8, {"item": intervals.F.sum})) == (3, 0)
    rows = df.selectExpr("*", "item % 2 AS tile_id", "1 AS iteration", "1 AS discordants", "1 AS sc", "1.0D AS score")
    assert exchanges(evidence.merge_iterations(rows)) == (1, 0)


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("stretch", (16, 1 << 14))
def test_depth_of_points_equals_counting(spark, seed, stretch):
    rng = random.Random(seed)
    data = [r for r in spans(150, seed) if r[0]] + [("a", None, 9), ("b", 7, 7), ("b", 9, 3)]
    points = [(c, rng.randrange(-5, 4200)) for c in ("a", "b", "unseen") for _ in range(40)] + [(None, 4), ("a", None)]
    points += points[:5]
    got = intervals.point_depth(spark.createDataFrame(points, "chrom string, point long"), spark.createDataFrame(data, "chrom string, start long, end long"), stretch)
    depth = lambda c, p: sum(1 for d, s, e in data if d == c and s is not None and s <= p < e) if c and p is not None else 0
    assert ordered((r.chrom, r.point, r.depth) for r in got.collect()) == ordered((c, p, depth(c, p)) for c, p in points)


def plain_intervals(rows, extension, least):
    tiles, out = defaultdict(list), []
    for r in rows:
        tiles[r[0]].append(r)
    for tile, own in tiles.items():
        right = any("R" in r[5] for r in own)
        used = plain([(r[1], r[2], r[3], r[6]) for r in own if r[4] != "SC"], lambda before, r: r[1] > before[-1][2])
        whole = sum(r[4] for r in used)
        ranked = sorted(((round(w / whole, 9), c, s, last) for c, s, _, last, w in used), key=lambda r: (-r[0], r[2], r[3]))
        ranked = [r for r in ranked if r[0] >= least] if least else ranked[:1]
        out += [(tile, k + 1, c, max(0, s - extension), e + (extension if right else 0), p) for k, (p, c, s, e) in enumerate(ranked)]
    return out


@pytest.mark.parametrize("stretch", (300, 10**6))
@pytest.mark.parametrize("least", (0.0, 0.02, 0.2))
def test_mate_intervals_equal_a_plain_version(spark, stretch, least, monkeypatch):
    monkeypatch.setattr(intervals, "STRETCH", stretch)
    rng = random.Random(8)
    data = []
    for k in range(600):
        tile = "hot" if k % 3 == 0 else f"t{rng.randrange(30)}"
        start = rng.randrange(6000)
        sc = rng.random() < 0.2
        # eighths are exact sums in any order
        data.append((tile, "c", 1 if sc else start, 9000 if sc else start + rng.choice((20, 150)), "SC" if sc else "SA", rng.choice("LR") if rng.random() < 0.3 else "L", 0.0 if sc else rng.randrange(1, 9) / 8))
    df = spark.createDataFrame(data, "tile_id string, chrom string, start long, end long, read_type string, orientation string, probability double")
    got = priors.mate_intervals(df, 50, least).collect()
    assert ordered((*r[:5], round(r[5], 9)) for r in got) == ordered(plain_intervals(data, 50, least))


def test_a_tile_of_a_million_priors_runs_in_many_tasks(spark, monkeypatch):
    """All priors of one tile: a task of the merge reads no more than the spans of some stretches."""
    monkeypatch.setattr(intervals, "STRETCH", 10_000)
    n = 1_000_000
    df = spark.range(n).selectExpr(
        "'t' AS tile_id", "'c' AS chrom", "id * 97 % 500009 AS start", "id * 97 % 500009 + 1 AS end", "'SA' AS read_type", "'L' AS orientation", "1.0D AS probability"
    )
    df = df.where("start % 5 < 2")
    found = priors.merge_priors(df)
    pids = found.groupBy(intervals.F.spark_partition_id().alias("p")).count().collect()
    starts = defaultdict(int)
    for i in range(n):
        starts[i * 97 % 500009] += 1
    kept = [s for s in starts if s % 5 < 2]
    assert sum(r["count"] for r in pids) == len({s // 5 for s in kept})
    assert abs(found.agg(intervals.F.sum("probability")).first()[0] - 1) < 1e-6
    assert len(pids) > 1
