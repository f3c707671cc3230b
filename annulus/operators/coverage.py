"""Coverage of circles, from runs of equal depth rather than single bases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annulus.functions import reads as R
from annulus.operators.intervals import coverage_runs, overlap_join
from annulus.schema import DUPLICATE, QC_FAIL, SECONDARY, UNMAPPED

C = F.col


def covering_spans(reads: DataFrame) -> DataFrame:
    """Spans of the reads that count for depth, from their place to their rightmost base."""
    return _counted(reads).select("chrom", C("pos").alias("start"), R.rightmost().alias("end"))


def covering_blocks(reads: DataFrame, quality: int = 0) -> DataFrame:
    """Aligned blocks (M, =, X) of the reads that count for depth, split where a base does not.

    A base counts if it is one of A, C, G and T and its quality is at least the given one; at 0
    qualities may be missing, over 0 a read without them has no depth. A read without bases has none.
    """
    cut = _counted(reads).select("chrom", F.explode(R.aligned_blocks()).alias("b"), C("seq").alias("_seq"), C("qual").alias("_qual"))
    cut = cut.select("chrom", C("b.start").alias("_start"), F.explode(R.runs_of_bases(C("_seq"), C("_qual"), C("b.at"), C("b.len"), quality)).alias("r"))
    return cut.select("chrom", (C("_start") + C("r.first")).alias("start"), (C("_start") + C("r.last") + 1).alias("end"))


def _counted(reads: DataFrame) -> DataFrame:
    return reads.where(C("flag").bitwiseAND(UNMAPPED | SECONDARY | QC_FAIL | DUPLICATE) == 0)


def _within(lo: Column, hi: Column) -> Column:
    """Bases of a run (r_start, r_end) between lo and hi."""
    return F.greatest(F.least(C("r_end"), hi) - F.greatest(C("r_start"), lo), F.lit(0))


def coverage_stats(circles: DataFrame, spans: DataFrame, contigs: DataFrame, extension: int = 200, inside: int = 100) -> DataFrame:
    """circles (chrom, start, end, …) with mean, std, start_ratio, end_ratio and continuity.

    mean and std are over all bases, continuity is the share of bases without depth. A ratio is the
    depth of the first (last) inside bases over that of the same and extension bases outside them, within
    the contig; it is null where that is 0. Sums run over depth runs: memory does not depend on lengths.
    """
    lengths = contigs.select("chrom", C("length").alias("_length"))
    keyed = circles.join(lengths, "chrom", "left").withColumn("_hi", F.least(C("end") + extension, F.coalesce("_length", C("end") + extension)))
    keyed = keyed.withColumn("_lo", F.greatest(C("start") - extension, F.lit(0)))
    wide = keyed.select("chrom", C("start").alias("_s"), C("end").alias("_e"), C("_lo").alias("start"), C("_hi").alias("end")).distinct()
    met = overlap_join(wide, coverage_runs(spans))
    s, e, lo, hi, d = C("_s"), C("_e"), C("start"), C("end"), C("depth")
    first, last = F.least(s + inside, e), F.greatest(e - inside, s)
    sums = met.groupBy("chrom", "_s", "_e").agg(
        F.sum(d * _within(s, e)).alias("_d"),
        F.sum(d * d * _within(s, e)).alias("_dd"),
        F.sum(_within(s, e)).alias("_covered"),
        F.sum(d * _within(s, first)).alias("_in0"),
        F.sum(d * _within(lo, first)).alias("_out0"),
        F.sum(d * _within(last, e)).alias("_in1"),
        F.sum(d * _within(last, hi)).alias("_out1"),
    )
    joined = circles.join(sums.withColumnsRenamed({"_s": "start", "_e": "end"}), ["chrom", "start", "end"], "left")
    size = (C("end") - C("start")).cast("double")
    zero = lambda c: F.coalesce(C(c), F.lit(0)).cast("double")
    mean = zero("_d") / size
    return joined.select(
        *circles.columns,
        mean.alias("mean"),
        F.sqrt(F.greatest(zero("_dd") / size - mean * mean, F.lit(0.0))).alias("std"),
        F.try_divide(zero("_in0"), zero("_out0")).alias("start_ratio"),
        F.try_divide(zero("_in1"), zero("_out1")).alias("end_ratio"),
        (F.lit(1.0) - zero("_covered") / size).alias("continuity"),
    )


def filter_by_ratio(circles: DataFrame, least: float = 0.0) -> DataFrame:
    """Circles whose ratio at either end lies over least; a missing ratio or NaN does not."""
    over = lambda c: F.coalesce(~F.isnan(c) & (C(c) > least), F.lit(False))
    return circles.where(over("start_ratio") | over("end_ratio"))
