"""Mate pairing, candidate extraction and the insert size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annulus.functions import reads as R
from annulus.schema import MATE_UNMAPPED, PROPER, READ1, READ2, REVERSE, UNMAPPED

C = F.col


def mate_pairs(reads: DataFrame) -> DataFrame:
    """(r1, r2) structs: each second read with the last first read of its name before it, in file order.

    A second read without one is left out. One shuffle, by name.
    """
    row = F.struct(*reads.columns)
    window = Window.partitionBy("qname").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    marked = reads.select(
        F.last(F.when(R.has_flag(READ1), row), ignorenulls=True).over(window).alias("r1"), row.alias("r2")
    )
    return marked.where(R.has_flag(READ2, C("r2.flag")) & C("r1").isNotNull())


def both_mapped() -> Column:
    return ~R.has_flag(UNMAPPED, C("r1.flag")) & ~R.has_flag(UNMAPPED, C("r2.flag"))


def outward(mapq: int) -> Column:
    """Whether a pair points outward (second reverse and before the first), as over a circle's join."""
    return (
        R.has_flag(REVERSE, C("r2.flag"))
        & ~R.has_flag(REVERSE, C("r1.flag"))
        & (C("r2.pos") < C("r1.pos"))
        & (C("r1.chrom") == C("r2.chrom"))
        & (C("r1.mapq") >= mapq)
        & (C("r2.mapq") >= mapq)
    )


def _clipped(read: str, mate: str, mapq: int, soft: bool, hard: bool, own: Column | None = None) -> Column:
    """The read with its mate's mapping quality if it is kept for its clip, else null. Soft clips win over hard ones."""
    c = C(read)
    quality = own if own is not None else C(f"{mate}.mapq")
    is_soft, is_hard = R.is_soft_clipped(f"{read}.cigar"), R.is_hard_clipped(f"{read}.cigar")
    good, known = c["mapq"] >= mapq, c["mq"].isNotNull()
    keep = F.when(is_soft, F.lit(soft) & good).when(is_hard, F.lit(hard) & (good | known)).otherwise(False)
    return F.when(keep, c.withField("mq", F.when(known, c["mq"]).otherwise(quality).cast("int")))


def extract_candidates(reads: DataFrame, mapq: int = 10, discordant: bool = True, soft: bool = True, hard: bool = True) -> DataFrame:
    """Reads that may come from circles: outward pairs, and clipped reads of all others; mq is filled in."""
    pairs = mate_pairs(reads)
    one_unmapped = R.has_flag(UNMAPPED, C("r1.flag")) != R.has_flag(UNMAPPED, C("r2.flag"))
    pair = F.array(C("r1").withField("mq", C("r2.mapq").cast("int")), C("r2").withField("mq", C("r1.mapq").cast("int")))
    clipped = F.array(_clipped("r1", "r2", mapq, soft, hard), _clipped("r2", "r1", mapq, soft, hard))
    alone = F.array(
        F.when(R.has_flag(UNMAPPED, C("r2.flag")), _clipped("r1", "r2", mapq, soft, hard, C("r1.mapq"))),
        F.when(R.has_flag(UNMAPPED, C("r1.flag")), _clipped("r2", "r1", mapq, soft, hard, C("r2.mapq"))),
    )
    nothing = F.array().cast(pairs.select(pair.alias("x")).schema["x"].dataType)
    chosen = (
        F.when(both_mapped() & outward(mapq), pair if discordant else nothing)
        .when(both_mapped(), clipped)
        .when(one_unmapped, alone)
        .otherwise(nothing)
    )
    return pairs.select(F.explode(chosen).alias("read")).where("read IS NOT NULL").select("read.*")


def insert_size(reads: DataFrame, mapq: int = 60, sample: int = 100_000) -> DataFrame:
    """Mean and population deviation of the template length over the first proper, unclipped, inward pairs."""
    unclipped = lambda r: ~R.is_soft_clipped(f"{r}.cigar") & ~R.is_hard_clipped(f"{r}.cigar")
    good = (
        (C("r1.mapq") >= mapq)
        & (C("r2.mapq") >= mapq)
        & R.has_flag(PROPER, C("r1.flag"))
        & unclipped("r1")
        & unclipped("r2")
        & ~R.has_flag(REVERSE, C("r1.flag"))
        & R.has_flag(REVERSE, C("r2.flag"))
        & (C("r1.tlen") > 0)
    )
    needed = reads.select("qname", "ordinal", "flag", "mapq", "cigar", "tlen")  # whole reads would all be shuffled
    first = mate_pairs(needed).where(good).select(C("r2.ordinal").alias("o"), C("r1.tlen").alias("tlen")).orderBy("o").limit(sample)
    return first.agg(F.count("*").alias("pairs"), F.avg("tlen").alias("mean"), F.stddev_pop("tlen").alias("std"))


def read_side_discordants(reads: DataFrame) -> DataFrame:
    """Spans (chrom, start, end, read) that single reads of outward pairs point over."""
    reverse, mate_reverse = R.has_flag(REVERSE), R.has_flag(32)
    second = reverse & ~mate_reverse & R.has_flag(READ2) & (C("pos") < C("next_pos"))
    first = ~reverse & mate_reverse & ~R.has_flag(READ2) & (C("next_pos") < C("pos"))
    return reads.where(~R.has_flag(MATE_UNMAPPED) & (second | first)).select(
        "chrom", F.least("pos", "next_pos").alias("start"), (F.greatest("pos", "next_pos") + R.query_length()).alias("end"), C("qname").alias("read")
    )
