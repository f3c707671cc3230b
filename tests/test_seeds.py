"""Pairs of clips and intervals by seeds, against every pair of a tile."""

import random

from pyspark.sql import functions as F

from annulus.operators import kernel, seeds


def stands(clip, bases, share):
    """could_stand, written out over the parts."""
    e = int(len(clip) * share)
    cut = [len(clip) * k // (e + 1) for k in range(e + 2)]
    return any(clip[a:b].upper() in bases.upper() for a, b in zip(cut, cut[1:]))


def made(spark, clips, windows, share):
    c = spark.createDataFrame(clips, "rid long, tile_id long, clip string")
    w = spark.createDataFrame(windows, "tile_id long, iteration long, bases string")
    return seeds.seed_pairs(c, w, share)


def test_pairs_equal_all_pairs_of_a_tile(spark):
    rng = random.Random(11)
    draw = lambda n: "".join(rng.choices("ACGTNacgt", (9, 9, 9, 9, 1, 1, 1, 1, 1), k=n))
    windows = [(t, k, draw(rng.choice((0, 7, 60, 300, 1100)))) for t in range(4) for k in range(1, 7)]
    clips = []
    for rid in range(160):
        tile, _, source = rng.choice(windows)
        n = rng.randrange(1, 90)
        at = rng.randrange(max(1, len(source) - n))
        clip = list(source[at : at + n] or draw(n))
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(clip))
            clip[i : i + 1] = rng.choice(([], ["A"], [clip[i], "C"]))
            clip = clip or ["A"]
        clips.append((rid, tile, "".join(clip)))
    clips += [(200, 1, None), (201, None, "ACGTACGTACGT"), (202, 1, ""), (203, 99, "ACGTACGTACGT"), clips[0], clips[0]]
    windows += [(1, 50, None), (None, 51, "ACGTACGTACGT")]
    for share in (0.05, 0.2):
        want = sorted((r, t, k) for r, t, c in clips if c and t is not None for u, k, b in windows if u == t and b is not None and stands(c, b, share))
        got = sorted((r.rid, r.tile_id, r.iteration) for r in made(spark, clips, windows, share).collect())
        assert got == want
        assert len(want) > 100


def test_no_accepted_hit_is_lost(spark):
    rng = random.Random(12)
    t = "".join(rng.choices("ACGT", k=700))
    clips = []
    for rid in range(60):
        at = rng.randrange(600)
        clip = list(t[at : at + rng.randrange(20, 100)])
        for _ in range(int(len(clip) * 0.05)):
            clip[rng.randrange(len(clip))] = "T"
        clips.append((rid, 1, "".join(clip)))
    found = {r.rid for r in made(spark, clips, [(1, 1, t)], 0.05).collect()}
    hits = kernel.realign_all([c for _, _, c in clips], [[30] * len(c) for _, _, c in clips], [t] * 60, 5, 5, 1, 0.05)
    assert found >= {rid for rid, h in enumerate(hits) if h} and sum(map(bool, hits)) > 40


def test_one_tile_and_one_clip_are_not_one_row_each(spark):
    """A hot tile: equal clips are looked up once, and only pairs with a common part come out."""
    clips = [(k, 1, "ACGTTGCAACGGTACCATGA") for k in range(3000)] + [(k, 1, "TTTTTTTTTTTTTTTTTTTT") for k in range(3000, 4000)]
    windows = [(1, 1, "GG" * 50 + "ACGTTGCAACGGTACCATGA"), (1, 2, "GC" * 60), (1, 3, "T" * 90)]
    got = made(spark, clips, windows, 0.05)
    assert {(r.iteration, r["count"]) for r in got.groupBy("iteration").count().collect()} == {(1, 3000), (3, 1000)}
    asked = seeds.clip_intervals(spark.createDataFrame(clips, "rid long, tile_id long, clip string"), spark.createDataFrame(windows, "tile_id long, iteration long, bases string"))
    assert sorted((r.clip, r.iterations) for r in asked.collect()) == [(clips[0][2], [1]), (clips[-1][2], [3])]


def test_nothing_to_pair(spark):
    empty = made(spark, [], [], 0.05)
    assert empty.count() == 0 and empty.select(F.length("clip"), "bases").count() == 0


def test_small_tiles_need_no_index(spark, monkeypatch):
    """Pairs are the same by index and one by one, where the clips of a tile lie over and under the limit; tiles under it come into no index."""
    rng = random.Random(3)
    draw = lambda n: "".join(rng.choices("ACGTa", k=n))
    windows = [(t, k, draw(rng.choice((60, 300)))) for t in range(3) for k in range(1, 5)]
    clips = []
    for rid in range(90):
        tile, _, source = windows[rng.choice((0, 1, 1, 5, 9, 9, 9, 9))]
        n, at = rng.choice((6, 12, 21, 45, 58)), rng.randrange(3)
        clips.append((rid, tile, source[at : at + n][: n // 2] + rng.choice(("", "G")) + source[at + n // 2 : at + n]))
    pairs = lambda: sorted((r.rid, r.tile_id, r.iteration) for r in made(spark, clips, windows, 0.1).collect())
    expected = sorted((r, t, k) for r, t, c in clips for u, k, b in windows if u == t and stands(c, b, 0.1))
    asked, index = [], seeds.seed_index
    monkeypatch.setattr(seeds, "seed_index", lambda windows: asked.append(windows) or index(windows))
    for few, tiles in ((0, {0, 1, 2}), (40, {2}), (1000, set())):
        monkeypatch.setattr(seeds, "FEW", few)
        asked.clear()
        assert pairs() == expected
        assert {r.tile_id for r in asked[0].select("tile_id").collect()} == tiles
