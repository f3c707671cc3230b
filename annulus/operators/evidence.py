"""Evidence for circles from split reads and discordant pairs, and its merges."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annulus.functions import reads as R
from annulus.operators.intervals import box_counts, merge_reciprocal, merge_touching, point_depth
from annulus.schema import REVERSE

C = F.col


def split_evidence(tile_reads: DataFrame, intervals: DataFrame, mapq: int = 20) -> DataFrame:
    """Spans of soft-clipped reads whose SA lies inside a mate interval of their tile.

    tile_reads: reads with tile_id; intervals: tile_id, iteration, chrom, start, end. Returns tile_id,
    iteration, chrom, start, end, read and score (clipped bases weighed by the SA's quality, to two places).
    """
    left, right = R.clip_lengths()
    clipped = tile_reads.where(R.is_soft_clipped() & C("sa").isNotNull()).select(
        "tile_id", C("qname").alias("read"), "pos", R.rightmost().alias("read_end"), R.has_flag(REVERSE).alias("reverse"), R.supplementary().alias("s"), F.greatest(left, right).alias("clip")
    )
    good = clipped.where((C("s.mapq") > mapq) & (C("s.strand") == F.when(C("reverse"), "-").otherwise("+")))
    met = good.join(intervals, "tile_id").where((C("s.chrom") == C("chrom")) & (C("start") < C("s.pos")) & (C("s.pos") < C("end")))
    sa_end = R.rightmost_of_text(C("s.pos"), C("s.cigar"))
    span = F.when(C("pos") < C("s.pos"), F.struct(C("pos").alias("a"), (sa_end - 1).alias("b"))).when(
        C("pos") > C("s.pos"), F.struct((C("s.pos") - 1).alias("a"), C("read_end").alias("b"))
    )
    score = F.round(C("clip") * R.weight(C("s.mapq")), 2)
    return met.withColumn("span", span).where("span IS NOT NULL").select("tile_id", "iteration", "chrom", C("span.a").alias("start"), C("span.b").alias("end"), "read", score.alias("score"))


def realigned_evidence(hits: DataFrame) -> DataFrame:
    """Spans of realigned clips.

    hits: tile_id, iteration, chrom, read, pos, read_end, mate_start, lo, hi (the hit inside the mate
    interval), clip and probability. Same columns out as split_evidence.
    """
    ahead = C("pos") < C("mate_start") + C("lo")
    return hits.select(
        "tile_id",
        "iteration",
        "chrom",
        F.when(ahead, C("pos")).otherwise(C("mate_start") + C("lo")).alias("start"),
        F.when(ahead, C("mate_start") + C("hi") + 1).otherwise(C("read_end")).alias("end"),
        "read",
        F.round(C("clip") * C("probability"), 2).alias("score"),
    )


def support(evidence: DataFrame, keys: tuple[str, ...] = ("tile_id",)) -> DataFrame:
    """Distinct reads (sc) and summed score of each span and iteration."""
    return evidence.groupBy(*keys, "iteration", "chrom", "start", "end").agg(F.countDistinct("read").alias("sc"), F.sum("score").alias("score"))


def assign_discordants(splits: DataFrame, discordants: DataFrame, reach: float, keys: tuple[str, ...] = ("tile_id",)) -> DataFrame:
    """splits with the number of discordant spans just inside each (both ends within reach, strictly).

    Starts and ends are whole numbers. Equal spans of either side are counted once, and no span meets another: see ``box_counts``.
    """
    by, wide = [*keys, "chrom"], ceil(reach) - 1
    points = discordants.groupBy(*by, C("start").alias("x"), C("end").alias("y")).agg(F.count("*").alias("n"))
    boxes = splits.select(*by, (C("start") + 1).alias("x"), (C("end") - wide).alias("y")).distinct()
    counts = box_counts(boxes, points, wide, by).select(*by, (C("x") - 1).alias("start"), (C("y") + wide).alias("end"), C("inside").alias("discordants"))
    return splits.join(counts, [*by, "start", "end"], "left").withColumn("discordants", F.coalesce("discordants", F.lit(0)))


def discordant_islands(discordants: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Islands of touching discordant spans: first start, last end and number of reads."""
    return merge_touching(discordants.withColumn("discordants", F.lit(1).cast("long")), [*keys, "chrom"], {"discordants": F.sum})


def merge_iterations(rows: DataFrame, keys: tuple[str, ...] = ("tile_id",)) -> DataFrame:
    """Rows of one iteration with identical spans as one; in order of their spans they stand one after another."""
    return rows.groupBy(*keys, "iteration", "chrom", "start", "end").agg(
        F.max("discordants").alias("discordants"), F.sum("sc").alias("sc"), F.sum("score").alias("score")
    )


def allele_frequency(rows: DataFrame, reads: DataFrame) -> DataFrame:
    """rows with af: support against the mean depth at both ends; split reads count twice."""
    ends = rows.select("chrom", C("start").alias("point")).union(rows.select("chrom", (C("end") - 1).alias("point"))).distinct()
    depth = point_depth(ends, reads)
    at = lambda name: depth.select("chrom", C("point").alias(f"_{name}p"), C("depth").alias(f"_{name}"))
    joined = rows.withColumn("_sp", C("start")).withColumn("_ep", C("end") - 1).join(at("s"), ["chrom", "_sp"], "left").join(at("e"), ["chrom", "_ep"], "left")
    mean = (C("_s") + C("_e") + F.lit(0.01).cast("double")) / F.lit(2.0)
    af = F.when(C("sc") != 0, F.lit(2.0) * C("sc") / mean).otherwise(C("discordants") / mean)
    return joined.withColumn("af", af).drop("_sp", "_ep", "_s", "_e")


def passes(splits: int = 0, score: float = 0.0, discordants: int = 3, af: float = 0.1) -> Column:
    """The filter on a chunk's circles; a score must lie over its limit."""
    with_splits = (C("sc") >= splits) & (C("score") > score) & (C("af") >= af)
    return F.when(C("sc") != 0, with_splits).otherwise((C("discordants") >= discordants) & (C("af") >= af))


def merge_circles(rows: DataFrame, share: float = 0.99, least: int = 0) -> DataFrame:
    """Final circles: neighbours that overlap enough as one, supported by at least least reads; a start over 0 is moved up by one."""
    merged = merge_reciprocal(rows, share, {"discordants": F.max, "sc": F.sum, "score": F.sum})
    return merged.where(C("sc") + C("discordants") >= least).select(
        "chrom", F.when(C("start") != 0, C("start") + 1).otherwise(C("start")).alias("start"), "end", "discordants", "sc", "score"
    )


def merge_repeats(rows: DataFrame, share: float = 0.8, least: int = 20) -> DataFrame:
    """Two rounds of merging repeat spans (chrom, start, end, item); the first round drops those under least reads.

    Spans of the first round reach to the farthest end, those of the second to the last one.
    """
    once = merge_reciprocal(rows, share, {"item": F.sum}).where(C("item") >= least).drop("last_end")
    return merge_reciprocal(once, share, {"item": F.sum}).select("chrom", "start", C("last_end").alias("end"), "item")


def repeat_spans(reads: DataFrame, most_edits: int = 2) -> DataFrame:
    """Spans between a read and its only alternative place, where that is on the same chromosome."""
    xa = R.alternatives()
    one = reads.where(C("xa").isNotNull() & (C("nm") <= most_edits)).withColumn("_xa", xa).where(F.size("_xa") == 1).withColumn("x", C("_xa")[0])
    same = one.where(C("x.chrom") == C("chrom"))
    before = C("x.pos") < C("pos")
    return same.select(
        "chrom",
        F.when(before, C("x.pos")).otherwise(C("pos")).alias("start"),
        F.when(before, C("pos") + R.query_length(hard=True)).otherwise(R.rightmost_of_text(C("x.pos"), C("x.cigar"))).alias("end"),
        F.lit(1).cast("long").alias("item"),
    )
