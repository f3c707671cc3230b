"""Where the other end of a circle may lie: priors from single reads, merged to mate intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annulus.functions import reads as R
from annulus.operators import intervals as iv
from annulus.schema import MATE_REVERSE, MATE_UNMAPPED, REVERSE, UNMAPPED

C = F.col


def _prior(start: Column, end: Column, kind: str, orientation: str, probability: Column) -> Column:
    return F.struct(
        start.cast("long").alias("start"),
        end.cast("long").alias("end"),
        F.lit(kind).alias("read_type"),
        F.lit(orientation).alias("orientation"),
        probability.cast("double").alias("probability"),
    )


def mate_priors(tile_reads: DataFrame, contigs: DataFrame, mapq: int = 20, only_discordants: bool = True) -> DataFrame:
    """One prior for each read of a tile that gives one; the first rule that applies wins.

    tile_reads: columns of reads and tile_id. Returns tile_id, qname, chrom, start, end, read_type
    (SA, DR or SC), orientation (L, R or LR) and probability. The rules, in order: a soft clip
    with a concordant SA (nothing if its SA is not concordant or only discordants are asked
    for); a reverse read before its forward mate; a forward read behind its reverse mate; same
    strands with a soft clip; same strands with a hard clip and a concordant SA.
    """
    sa = R.supplementary()
    reverse, mate_reverse = R.has_flag(REVERSE), R.has_flag(MATE_REVERSE)
    mapped = ~R.has_flag(UNMAPPED) & ~R.has_flag(MATE_UNMAPPED)
    same_ref = C("chrom") == C("next_chrom")
    strand = F.when(reverse, "-").otherwise("+")
    agrees = F.coalesce((C("_sa.chrom") == C("chrom")) & (C("_sa.mapq") >= mapq) & (C("_sa.strand") == strand), F.lit(False))
    span, sa_weight = R.genome_span(C("_sa.cigar")), R.weight(C("_sa.mapq"))
    soft, hard, has_sa = R.is_soft_clipped(), R.is_hard_clipped(), C("sa").isNotNull()
    alone = F.lit(not only_discordants)
    by_sa = lambda width, side: _prior(C("_sa.pos") - width, C("_sa.pos") + width, "SA", side, sa_weight)
    mate = lambda side: _prior(C("next_pos"), C("next_pos") + R.query_length(), "DR", side, R.weight(C("mq")))
    none = F.lit(None)
    rule = (
        F.when(soft & has_sa, F.when(alone & agrees & (C("pos") > C("_sa.pos")), by_sa(span, "L")).when(alone & agrees & (C("pos") < C("_sa.pos")), by_sa(span, "R")))
        .when(mapped & reverse & ~mate_reverse & (C("pos") < C("next_pos")) & same_ref, mate("R"))
        .when(mapped & ~reverse & mate_reverse & (C("next_pos") < C("pos")) & same_ref, mate("L"))
        .when(mapped & (reverse == mate_reverse) & alone & soft & ~has_sa, _prior(F.lit(1), C("_length"), "SC", "LR", F.lit(0.0)))
        .when(
            mapped & (reverse == mate_reverse) & alone & hard & agrees,
            F.when(C("pos") > C("_sa.pos"), by_sa(2 * span, "L")).when(C("pos") < C("_sa.pos"), by_sa(2 * span, "R")),
        )
        .otherwise(none)
    )
    lengths = contigs.select("chrom", C("length").alias("_length"))
    good = tile_reads.where(C("mapq") >= mapq).withColumn("_sa", sa).join(lengths, "chrom", "left")
    return good.withColumn("p", rule).where("p IS NOT NULL").select("tile_id", "qname", "chrom", "p.*")


#: Decimal places to which shares are compared: those that differ only by the order of their sums are equal.
PLACES = 9


def mate_intervals(priors: DataFrame, extension: float, least: float = 0.01) -> DataFrame:
    """Merged, weighed and widened priors: tile_id, iteration, chrom, start, end and probability.

    Tiles with whole-contig priors alone have none; such priors are dropped beside others. Weights
    come to 1 in a tile. least = 0 keeps only the likeliest interval of a tile. Intervals are
    widened by extension on both sides if any prior of the tile points right, else at their
    start alone. iteration ranks a tile's intervals from the likeliest; equals stand by their place.

    Shares come to 1, so a tile keeps 1 / least intervals at most, and only these are ranked.
    """
    merged = merge_priors(priors).withColumn("_share", F.round("probability", PLACES))
    if least > 0:
        chosen = merged.where(C("_share") >= least)
    else:
        likeliest = F.max_by(F.struct("chrom", "start", "end", "probability", "_share", "_right"), F.struct(C("_share"), -C("start"), -C("end")))
        chosen = merged.groupBy("tile_id").agg(likeliest.alias("m")).select("tile_id", "m.*")
    wide = F.bround(F.lit(float(extension))).cast("long")
    return chosen.select(
        "tile_id",
        F.row_number().over(Window.partitionBy("tile_id").orderBy(C("_share").desc(), "start", "end")).cast("long").alias("iteration"),
        "chrom",
        F.greatest(F.lit(0), C("start") - wide).alias("start"),
        F.when(C("_right"), C("end") + wide).otherwise(C("end")).alias("end"),
        "probability",
    )


def merge_priors(priors: DataFrame) -> DataFrame:
    """Islands of a tile's touching priors, with their first start, last end, share of the tile's weight, and _right (any prior of the tile points right).

    Whole-contig priors (SC) count for _right alone. Priors without a tile or a chromosome are left out. What a tile
    comes to is summed by stretch first and handed back to each of its stretches, so that a
    tile with any number of priors is no single task.
    """
    known = F.coalesce(C("read_type") != "SC", F.lit(False))
    placed = priors.where("tile_id IS NOT NULL AND chrom IS NOT NULL").withColumns({"_kind": known, "_known": known, "_right": C("orientation").contains("R")})
    # one merge serves both sides of the join: _known is a sum of it, so that neither side filters the priors on its own
    merged = iv.merge_touching(placed, ["tile_id", "chrom", "_kind"], {"probability": F.sum, "_right": F.max, "_known": F.max})
    merged = merged.withColumn("_part", F.floor(C("start") / iv.STRETCH))
    stretches = merged.groupBy("tile_id", "chrom", "_part").agg(F.sum(F.when(C("_known"), C("probability"))).alias("_weight"), F.max("_right").alias("_any"))
    tile = Window.partitionBy("tile_id")
    totals = stretches.select("tile_id", "chrom", "_part", F.sum("_weight").over(tile).alias("_weight"), F.max("_any").over(tile).alias("_any"))
    both = merged.where("_known").join(totals, ["tile_id", "chrom", "_part"])
    return both.select("tile_id", "chrom", "start", "end", F.try_divide("probability", "_weight").alias("probability"), C("_any").alias("_right"))
