"""Simulated circles and their reads. Every draw is a hash of the seed and the row's number, so results do not depend on partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annulus.functions import reads as R
from annulus.operators.intervals import exclude_regions
from annulus.sources.text import chunks, fetch

C = F.col


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from the hash of the keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) / F.lit(float(1 << 40))


def normal(seed: int, *keys: Column) -> Column:
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(seed, *keys)))
    return radius * F.cos(F.lit(2 * math.pi) * uniform(seed + 1, *keys))


def contig_weights(contigs: DataFrame) -> DataFrame:
    """contigs with weight (share of the genome's length) and the range lo to hi that it takes of [0, 1)."""
    order = Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, 0)  # a contig list is small
    total = F.sum("length").over(Window.partitionBy())
    upto = F.sum("length").over(order)
    return contigs.select("chrom", "length", (C("length") / total).alias("weight"), ((upto - C("length")) / total).alias("lo"), (upto / total).alias("hi"))


#: Contigs up to which their list is broadcast (some 100 bytes each).
BROADCAST_CONTIGS = 100_000


def circles(spark: SparkSession, contigs: DataFrame, n: int, seed: int = 1, shortest: int = 150, longest: int = 350, exclude: DataFrame | None = None) -> DataFrame:
    """n circles (circle, chrom, start, end) on contigs by their length, less those that meet an excluded region."""
    weights = contig_weights(contigs)
    drawn = spark.range(n).select(C("id").alias("circle"), uniform(seed, C("id")).alias("u"))
    if contigs.limit(BROADCAST_CONTIGS + 1).count() <= BROADCAST_CONTIGS:
        placed = drawn.join(F.broadcast(weights), (C("u") >= C("lo")) & (C("u") < C("hi")))
    else:  # a contig and a draw meet in the cells of [0, 1) that the contig reaches
        cells = lambda c: F.floor(C(c) * BROADCAST_CONTIGS)
        spread = weights.withColumn("cell", F.explode(F.sequence(cells("lo"), cells("hi"))))
        placed = drawn.withColumn("cell", cells("u")).join(spread, "cell").where("u >= lo AND u < hi")
    size = F.least(F.lit(shortest) + F.floor(uniform(seed + 10, C("circle")) * (longest - shortest + 1)), C("length"))
    out = placed.withColumn("_n", size).withColumn("start", F.floor(uniform(seed + 20, C("circle")) * (C("length") - C("_n") + 1)))
    out = out.select("circle", "chrom", C("start").cast("long").alias("start"), (C("start") + C("_n")).cast("long").alias("end"))
    return exclude_regions(out, exclude) if exclude is not None else out


def pairs_of(size: Column, read_length: int, coverage: float) -> Column:
    """Read pairs of a circle of the given size."""
    return F.floor(size * F.lit(coverage) / (2 * read_length)).cast("int")


#: Circles whose pairs are counted along, one stretch a task.
STRETCH = 1 << 16


def circles_for_reads(spark: SparkSession, contigs: DataFrame, reads: int, seed: int = 1, read_length: int = 150, coverage: float = 30.0, exclude: DataFrame | None = None) -> DataFrame:
    """Circles in the order of their numbers, whole ones, until their pairs are more than ``reads``.

    Excluded circles are skipped and others drawn in their place. Raises if no circle has pairs.
    """
    n = int(reads / max(1.0, 150 * coverage / (2 * read_length) - 1)) + 2
    for _ in range(12):
        made = circles(spark, contigs, n, seed, exclude=exclude).withColumn("_pairs", pairs_of(C("end") - C("start"), read_length, coverage)).where("_pairs > 0")
        made = made.withColumn("_part", F.floor(C("circle") / STRETCH))
        parts = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each stretch
        base = made.groupBy("_part").agg(F.sum("_pairs").alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(parts), F.lit(0)))
        along = Window.partitionBy("_part").orderBy("circle").rowsBetween(Window.unboundedPreceding, 0)
        counted = made.join(base.drop("_sum"), "_part").withColumn("_before", C("_base") + F.sum("_pairs").over(along) - C("_pairs"))
        total = made.agg(F.sum("_pairs")).first()[0] or 0
        if total > reads:
            return counted.where(C("_before") <= reads).drop("_part", "_base", "_before", "_pairs")
        n *= 2 if total else 8
    raise ValueError("the contigs leave no room for circles with reads")


def simulate_reads(made: DataFrame, cut: DataFrame, seed: int = 1, read_length: int = 150, insert: int = 300, coverage: float = 30.0) -> DataFrame:
    """Read pairs of circles: name, kind, seq1, seq2 (reverse complement), left and right offsets; cut: the genome in chunks.

    Kinds: 0 no split, 1 the left read runs over the join, 2 the right read does, 3 the gap between them does. A name
    is number|chrom|left|right|kind|circle; left and right are start:end, and of a read over the join both
    ranges, with a dash between them.
    """
    size = C("end") - C("start")
    pairs = pairs_of(size, read_length, coverage)
    with_seq = fetch(made, cut).withColumn("_c", C("bases")).where(F.length("bases") == size)
    rows = with_seq.where(pairs > 0).withColumn("number", F.explode(F.sequence(F.lit(0), pairs - 1)))
    key = (C("circle"), C("number"))
    gap = F.greatest(F.lit(read_length), F.bround(F.lit(float(insert)) + normal(seed + 40, *key) * (insert / 12)).cast("int"))
    rows = rows.withColumn("_left", F.floor(uniform(seed + 30, *key) * size).cast("int")).withColumn("_gap", gap)
    rows = rows.withColumn("_right", F.pmod(C("_left") + C("_gap") - read_length, size).cast("int"))
    around = F.repeat(C("_c"), F.ceil(F.lit(read_length) / size).cast("int") + 1)
    left_over, right_over = C("_left") + read_length > size, C("_right") + read_length > size
    kind = F.when(left_over, 1).when(right_over, 2).when(C("_right") < C("_left"), 3).otherwise(0)
    span = lambda lo, hi: F.concat_ws(":", lo.cast("string"), hi.cast("string"))

    def place(at: str) -> Column:
        lo, over = C("start") + C(at), C(at) + read_length - size
        split = F.concat_ws("-", span(lo, C("end")), span(C("start"), C("start") + over))
        return F.when(over > 0, split).otherwise(span(lo, lo + read_length))

    return rows.withColumn("_a", around).withColumn("kind", kind).select(
        R.simulated_name(C("number"), C("chrom"), place("_left"), place("_right"), C("kind"), C("circle")).alias("name"),
        "kind",
        F.substring(C("_a"), C("_left") + 1, F.lit(read_length)).alias("seq1"),
        R.reverse_complement(F.substring(C("_a"), C("_right") + 1, F.lit(read_length))).alias("seq2"),
        C("_left").alias("left"),
        C("_right").alias("right"),
        "circle",
    )


def with_errors(seq: Column, seed: int, rate: float, *keys: Column) -> Column:
    """seq with bases substituted at the given rate."""
    other = lambda b, i: F.substring(F.replace(F.lit("ACGT"), b, F.lit("")), (F.floor(uniform(seed + 1, i, *keys) * 3) + 1).cast("int"), F.lit(1))
    changed = F.transform(F.split(seq, ""), lambda b, i: F.when(uniform(seed, i, *keys) < rate, other(b, i)).otherwise(b))
    return F.array_join(changed, "")


def with_indels(seq: Column, seed: int, rate: float, *keys: Column) -> Column:
    """seq with bases left out or doubled, each at half the given rate."""
    u = lambda i: uniform(seed, i, *keys)
    return F.array_join(F.transform(F.split(seq, ""), lambda b, i: F.when(u(i) < rate / 2, "").when(u(i) < rate, F.concat(b, b)).otherwise(b)), "")


def mutate(genome: DataFrame, seed: int = 1, substitutions: float = 1e-4, indels: float = 1e-3) -> DataFrame:
    """A genome (chrom, seq) with substitutions and indels, made chunk by chunk."""
    key = (C("chrom"), C("chunk"))
    changed = with_indels(with_errors(C("bases"), seed, substitutions, *key), seed + 5, indels, *key)
    parts = chunks(genome).select("chrom", F.struct("chunk", changed.alias("bases")).alias("p"))
    return parts.groupBy("chrom").agg(F.array_join(F.array_sort(F.collect_list("p"))["bases"], "").alias("seq"))


#: Phred qualities of the error profile: at the first base, how many are lost by the last, and their deviation.
FIRST_QUALITY, LOST_QUALITY, QUALITY_SPREAD = 38, 10, 3


def profile_qualities(length: int, seed: int, *keys: Column) -> Column:
    """A quality for each base: lower towards the end of the read, with a normal spread, from 2 to 41."""
    mean = lambda i: F.lit(float(FIRST_QUALITY)) - F.lit(float(LOST_QUALITY)) * F.pow(i / F.lit(float(max(1, length - 1))), F.lit(2.0))
    each = lambda i: F.least(F.greatest(F.bround(mean(i) + normal(seed, i, *keys) * QUALITY_SPREAD).cast("int"), F.lit(2)), F.lit(41))
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), each)


def sequenced(seq: Column, qualities: Column, seed: int, insertions: float, deletions: float, *keys: Column) -> Column:
    """Bases (base, quality) as read: substituted at the rate that each quality says, and left out or doubled at the given rates."""
    other = lambda b, i: F.substring(F.replace(F.lit("ACGT"), b, F.lit("")), (F.floor(uniform(seed + 1, i, *keys) * 3) + 1).cast("int"), F.lit(1))
    pairs = F.arrays_zip(F.split(seq, "").alias("b"), qualities.alias("q"))
    read = lambda p, i: F.struct(F.when(uniform(seed, i, *keys) < R.phred_to_prob(p["q"]), other(p["b"], i)).otherwise(p["b"]).alias("b"), p["q"].alias("q"))
    gone, twice = (lambda i: uniform(seed + 2, i, *keys) < deletions), (lambda i: uniform(seed + 3, i, *keys) < insertions)
    copies = lambda p, i: F.when(gone(i), F.slice(F.array(p), 1, 0)).when(twice(i), F.array(p, p)).otherwise(F.array(p))
    return F.flatten(F.transform(F.transform(pairs, read), copies))


def fastq(pairs: DataFrame, seed: int = 1, errors: bool = False, insertions: tuple[float, float] = (0.00009, 0.00015), deletions: tuple[float, float] = (0.00011, 0.00023), read_length: int = 150) -> DataFrame:
    """Simulated pairs as FASTQ rows (mate, name, seq, qual), perfect or with errors by the profile; rates are those of the first and second read."""

    def side(mate: int) -> DataFrame:
        name = F.concat("name", F.lit(f"  {mate}:N:0:CGCTGTG"))
        if not errors:
            rows = pairs.select(F.lit(mate).alias("mate"), name.alias("name"), F.upper(f"seq{mate}").alias("seq"))
            return rows.withColumn("qual", F.repeat(F.lit("I"), F.length("seq")))
        seen = sequenced(F.upper(f"seq{mate}"), profile_qualities(read_length, seed + 10 * mate, C("name")), seed + 10 * mate + 2, insertions[mate - 1], deletions[mate - 1], C("name"))
        rows = pairs.select(F.lit(mate).alias("mate"), name.alias("name"), seen.alias("seen"))
        return rows.select("mate", "name", F.array_join("seen.b", "").alias("seq"), F.array_join(F.transform("seen.q", lambda q: F.char(q + 33)), "").alias("qual"))

    return side(1).union(side(2))
