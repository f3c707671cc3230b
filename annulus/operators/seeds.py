"""Which clips can stand in which intervals of their tile: a join by seeds.

With e edits allowed, one of a clip's e + 1 parts stands unchanged in the interval. So the first bases of each
part, its seed, are looked up among all stretches of that length of the tile's intervals, and only pairs
that share a seed are made; a test of the whole parts follows. No pair that an alignment could accept is lost.

Seeds have one of the lengths of ``SEEDS``, the longest that the clip's parts allow. A clip whose parts are
shorter than the shortest seed meets every interval of its tile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col

#: Lengths of seeds, the shortest first.
SEEDS = (8, 12)
#: Bases of an interval that are cut into stretches at a time; the places of a text are counted from its start, so short texts are cheaper.
_PIECE = 256
#: Clips up to which a tile's clips meet its intervals one by one: that costs less than the index, which has about two rows for each base of an interval.
FEW = 256


def parts(clip: Column, edit_share: float) -> Column:
    """The e + 1 parts of a clip, e being the edits that edit_share allows it."""
    edits = F.floor(F.length(clip) * edit_share).cast("int")
    cut = lambda k: F.floor(F.length(clip) * k / (edits + 1)).cast("int")
    return F.transform(F.sequence(F.lit(0), edits), lambda k: F.substring(clip, cut(k) + 1, cut(k + 1) - cut(k)))


def part_stands(clip: Column, bases: Column, edit_share: float) -> Column:
    """Whether a part of the clip stands unchanged in the bases."""
    return F.exists(parts(F.upper(clip), edit_share), lambda part: F.contains(F.upper(bases), part))


def _seed_length(clip: Column, edit_share: float) -> Column:
    shortest = F.floor(F.length(clip) / (F.floor(F.length(clip) * edit_share) + 1))
    size = F.lit(None).cast("int")
    for k in SEEDS:
        size = F.when(shortest >= k, F.lit(k)).otherwise(size)
    return size


def _stretches(bases: Column, size: int) -> Column:
    """All different stretches of the given length of a piece, as hashes; none if it is shorter."""
    places = F.when(F.length(bases) >= size, F.sequence(F.lit(1), F.length(bases) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda at: F.xxhash64(F.substring(bases, at, F.lit(size)))))


def seed_index(windows: DataFrame) -> DataFrame:
    """(tile_id, size, seed, iterations): the intervals of a tile that hold a stretch; a tile has few intervals, so the list is short."""
    overlap = SEEDS[-1] - 1
    upper = F.upper("bases")
    first = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("bases") - 1) / _PIECE).cast("int")))
    pieces = windows.where("bases IS NOT NULL").select(
        "tile_id", "iteration", F.explode(F.transform(first, lambda k: F.substring(upper, k * _PIECE + 1, F.lit(_PIECE + overlap)))).alias("piece")
    )
    kinds = F.array(*[F.struct(F.lit(k).alias("size"), _stretches(C("piece"), k).alias("seeds")) for k in SEEDS])
    rows = pieces.select("tile_id", "iteration", F.explode(kinds).alias("k")).select("tile_id", "iteration", "k.size", F.explode("k.seeds").alias("seed"))
    return rows.groupBy("tile_id", "size", "seed").agg(F.collect_set("iteration").alias("iterations"))


def clip_intervals(clips: DataFrame, windows: DataFrame, edit_share: float = 0.05) -> DataFrame:
    """(tile_id, clip, iterations) of different clips and the intervals of their tile that share a seed with them, or all for very short clips."""
    texts = clips.select("tile_id", "clip").where("tile_id IS NOT NULL AND clip <> ''").distinct().withColumn("size", _seed_length(C("clip"), edit_share))
    seeds = F.array_distinct(F.transform(parts(F.upper("clip"), edit_share), lambda part: F.xxhash64(F.substring(part, F.lit(1), C("size")))))
    asked = texts.where("size IS NOT NULL").select("tile_id", "clip", "size", F.explode(seeds).alias("seed"))
    found = asked.join(seed_index(windows), ["tile_id", "size", "seed"]).select("tile_id", "clip", F.explode("iterations").alias("iteration"))
    found = found.groupBy("tile_id", "clip").agg(F.collect_set("iteration").alias("iterations"))
    every = windows.groupBy("tile_id").agg(F.collect_set("iteration").alias("iterations"))
    return found.union(texts.where("size IS NULL").join(every, "tile_id").select("tile_id", "clip", "iterations"))


def seed_pairs(clips: DataFrame, windows: DataFrame, edit_share: float = 0.05) -> DataFrame:
    """Clips with the intervals of their tile in which one of their parts stands: all columns of both.

    clips: tile_id, clip and others; windows: tile_id, iteration (unique in its tile), bases and others that clips has not. Rows without a
    tile, a clip or bases have no pair; equal rows of clips stay as many as they are. In tiles of ``FEW`` clips at most every clip is
    held against every interval, and such intervals come into no index; in others equal clips are looked up once, by seeds.
    Every join here is of the kind that Spark splits where one key (a tile's commonest seed, clip or interval) is hot.
    """
    stands = part_stands(C("clip"), C("bases"), edit_share)
    asked = clips.where("tile_id IS NOT NULL AND clip <> ''")
    counted = asked.groupBy("tile_id").agg(F.count("*").alias("_n"))
    few, many = counted.where(C("_n") <= FEW).select("tile_id"), counted.where(C("_n") > FEW).select("tile_id")
    # the parts are cut once a clip and not once a pair; the first ones are columns, as a test of a list is many times as slow
    cut = asked.join(few, "tile_id", "left_semi").withColumn("_parts", parts(F.upper("clip"), edit_share))
    cut = cut.withColumns({f"_p{k}": F.get("_parts", F.lit(k)) for k in range(4)}).withColumn("_rest", F.slice("_parts", 5, 1 << 20)).drop("_parts")
    upper = windows.withColumn("_upper", F.upper("bases"))
    standing = C("_p0").isNotNull() & F.contains(C("_upper"), C("_p0"))
    for k in range(1, 4):
        standing = standing | (C(f"_p{k}").isNotNull() & F.contains(C("_upper"), C(f"_p{k}")))
    standing = standing | ((F.size("_rest") > 0) & F.exists("_rest", lambda part: F.contains(C("_upper"), part)))
    met = cut.join(upper, "tile_id").where(standing).drop("_p0", "_p1", "_p2", "_p3", "_rest", "_upper")
    clips, searched = asked.join(many, "tile_id", "left_semi"), windows.join(many, "tile_id", "left_semi")
    named = clips.join(clip_intervals(clips, searched, edit_share), ["tile_id", "clip"]).withColumn("iteration", F.explode("iterations")).drop("iterations")
    return met.unionByName(named.join(searched, ["tile_id", "iteration"]).where(stands))
