"""The five workflows as DataFrame plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annulus.functions import reads as R
from annulus.operators import coverage as cov
from annulus.operators import evidence as ev
from annulus.operators import simulate as sim
from annulus.operators.intervals import coverage_runs, overlap_join, peaks, tiles
from annulus.operators.kernel import accepted, first_hit, realign_column
from annulus.operators.pairs import extract_candidates, insert_size, mate_pairs, read_side_discordants
from annulus.operators.priors import mate_intervals, mate_priors
from annulus.operators.seeds import seed_pairs
from annulus.shared import Store
from annulus.sources.fasta import Fasta, genome_chunks
from annulus.sources.text import chunks, fetch

C = F.col


@dataclass(frozen=True)
class Params:
    """Options of the workflows, with their defaults."""

    mapq: int = 20
    hits: int = 10
    probability: float = 0.99
    min_clip: int = 8
    gap_open: float = 5.0
    gap_extend: float = 1.0
    edit_share: float = 0.05
    least_score: float = 0.0
    remap_splits: bool = False
    insert_mapq: int = 60
    std_extension: int = 4
    sample: int = 100_000
    merge_share: float = 0.99
    interval_probability: float = 0.01
    cluster_gap: int = 500
    only_discordants: bool = True
    allele_frequency: float = 0.1
    splits: int = 0
    discordants: int = 3
    ratio: float = 0.0
    coverage: bool = True
    extension: int = 200
    inside: int = 100
    coverage_quality: int = 0
    #: Bases by which the sequence of a mate interval begins behind it; places of hits count from the interval's start.
    #: The 1 is a habit of the original method; 0 gives places of hits one higher, which are the true ones.
    sequence_shift: int = 1


def extract(reads: DataFrame, mapq: int = 10, discordant: bool = True, soft: bool = True, hard: bool = True) -> DataFrame:
    return extract_candidates(reads, mapq, discordant, soft, hard)


def unpaired(reads: DataFrame) -> DataFrame:
    """Names of which there is no first read with a second one behind it; extraction passes their reads over."""
    paired = mate_pairs(reads).select(C("r2.qname").alias("qname")).distinct()
    return reads.select("qname").distinct().join(paired, "qname", "left_anti")


def _tiled(candidates: DataFrame, p: Params) -> DataFrame:
    """Reads by the tiles that they overlap; a read comes once for each tile."""
    clusters = peaks(coverage_runs(cov.covering_spans(candidates)), p.cluster_gap)
    cut = tiles(clusters).withColumn("tile_id", F.xxhash64("chrom", "start", "end"))
    spans = candidates.where(C("mapq") >= p.mapq).withColumn("start", C("pos")).withColumn("end", R.rightmost())
    return overlap_join(spans, cut).drop("start", "end", "r_chrom", "r_start", "r_end")


def _evidence(candidates: DataFrame, genome: Fasta | DataFrame | None, contigs: DataFrame, size: tuple[float, float], p: Params, store: Store) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Split evidence, discordant spans and (with a genome) accepted realignments.

    With p.remap_splits reads with an SA tag are realigned like the others, and give no split evidence.
    Every step is kept in the store: later ones read it several times.
    """
    tiled = store.keep(_tiled(candidates, p), "tiled")
    priors = store.keep(mate_priors(tiled, contigs, p.mapq, p.only_discordants), "priors")
    intervals = store.keep(mate_intervals(priors, size[0] + p.std_extension * size[1], p.interval_probability), "intervals")
    splits = ev.split_evidence(tiled.where(F.lit(not p.remap_splits)), intervals, p.mapq)
    visited = intervals.select("tile_id").distinct()
    discordants = store.keep(read_side_discordants_by_tile(tiled.join(visited, "tile_id", "left_semi")), "discordants")
    if genome is None:
        return store.keep(splits, "splits"), discordants, None
    loose = tiled.where(R.is_soft_clipped() & (F.lit(p.remap_splits) | C("sa").isNull())).withColumn("longest", R.longest_clip())
    loose = loose.where(F.length("longest.seq") >= p.min_clip).select(
        "tile_id", "qname", "pos", R.rightmost().alias("read_end"), "cigar", C("longest.seq").alias("clip"), C("longest.qual").alias("clip_qual")
    )
    # kept, as the parts of a clip name it many times over, and each would find the longest clip of the read again
    loose = store.keep(loose, "loose")
    shift = lambda df, by: df.withColumns({"start": C("start") + by, "end": C("end") + by})
    placed = shift(intervals, p.sequence_shift)
    windows = store.keep(shift(fetch(placed, store.keep(genome_chunks(genome, placed), "genome")), -p.sequence_shift), "windows")
    both = seed_pairs(loose, windows, p.edit_share).where(F.coalesce(R.non_colinear(C("cigar"), C("pos"), C("start"), C("end")), F.lit(False)))
    scored = both.withColumn("realigned", realign_column(C("clip"), C("clip_qual"), C("bases"), p.hits, p.gap_open, p.gap_extend, p.edit_share))
    hits = accepted(scored, least=p.probability, edit_share=p.edit_share).drop("bases").withColumn("hit", first_hit())
    return store.keep(splits, "splits"), discordants, store.keep(hits, "hits")


def read_side_discordants_by_tile(tiled: DataFrame) -> DataFrame:
    keyed = tiled.withColumn("qname", F.struct("tile_id", "qname"))
    return read_side_discordants(keyed).select(C("read.tile_id").alias("tile_id"), "chrom", "start", "end", C("read.qname").alias("read"))


def realign(candidates: DataFrame, qname_reads: DataFrame, all_reads: DataFrame, contigs: DataFrame, genome: Fasta | DataFrame | None, p: Params = Params(), store: Store | None = None) -> DataFrame:  # noqa: B008
    """Circles of candidate reads.

    candidates: reads of ``extract``; qname_reads: all reads in name order, for the insert size;
    all_reads: for depth; genome: a Fasta file, or chrom and seq (None leaves realignment out). Returns chrom, start,
    end, discordants, sc and score, and coverage columns where p.coverage. The result reads tables of
    the store, so ``store.close()`` comes after its use.
    """
    store = store or Store(candidates.sparkSession, "realign")
    found = insert_size(qname_reads, p.insert_mapq, p.sample).first()
    size = (found["mean"] or 0.0, found["std"] or 0.0)
    splits, discordants, hits = _evidence(store.keep(candidates, "candidates"), genome, contigs, size, p, store)
    if hits is not None:
        rows = hits.select(
            "tile_id", "iteration", "chrom", C("qname").alias("read"), "pos", "read_end", C("start").alias("mate_start"), C("hit.start").cast("long").alias("lo"),
            C("hit.end").cast("long").alias("hi"), F.length("clip").alias("clip"), C("realigned.probability").alias("probability"),
        )
        splits = splits.unionByName(ev.realigned_evidence(rows))
    supported = ev.assign_discordants(ev.support(splits), discordants, size[0] + 5 * size[1])
    lone = discordants.join(splits.select("tile_id").distinct(), "tile_id", "left_anti")
    alone = ev.discordant_islands(lone, ("tile_id",)).select(
        "tile_id", F.lit(0).cast("long").alias("iteration"), "chrom", "start", "end", F.lit(0).cast("long").alias("sc"), F.lit(0.0).alias("score"), "discordants"
    )
    merged = ev.merge_iterations(supported).select("tile_id", "iteration", "chrom", "start", "end", "sc", "score", "discordants").unionByName(alone)
    merged = store.keep(merged, "merged")
    depth = all_reads.select("chrom", C("pos").alias("start"), R.rightmost().alias("end"))
    good = store.keep(ev.allele_frequency(merged, depth).where(ev.passes(p.splits, p.least_score, p.discordants, p.allele_frequency)), "good")
    circles = ev.merge_circles(good, p.merge_share, p.splits)
    if not p.coverage:
        return circles
    return cov.filter_by_ratio(cov.coverage_stats(store.keep(circles, "circles"), cov.covering_blocks(all_reads, p.coverage_quality), contigs, p.extension, p.inside), p.ratio)


def realign_reads(candidates: DataFrame, qname_reads: DataFrame, contigs: DataFrame, genome: Fasta | DataFrame, p: Params = Params(), store: Store | None = None) -> DataFrame:  # noqa: B008
    """Reads that support circles: SA-supported ones as they are, realigned ones with a new SA tag where the hit lies downstream."""
    store = store or Store(candidates.sparkSession, "realign-reads")
    found = insert_size(qname_reads, p.insert_mapq, p.sample).first()
    candidates = store.keep(candidates, "candidates")
    splits, _, hits = _evidence(candidates, genome, contigs, (found["mean"] or 0.0, found["std"] or 0.0), p, store)
    kept = candidates.join(splits.select(C("read").alias("qname")).distinct(), "qname", "left_semi")
    place = C("start") + C("hit.start")
    clip = F.length("clip").cast("string")
    sa = R.supplementary_text(C("chrom"), place + 1, F.lit("+"), F.concat(clip, F.lit("M")), R.prob_to_phred(C("realigned.probability")), C("hit.edits"))
    tagged = hits.select("qname", "pos", F.when(place < C("pos"), sa).alias("new_sa")).distinct()
    realigned = candidates.join(tagged, ["qname", "pos"]).withColumn("sa", F.coalesce("new_sa", "sa")).drop("new_sa")
    return kept.unionByName(realigned.select(*kept.columns))


def repeats(reads: DataFrame, contigs: DataFrame, most_edits: int = 2, share: float = 0.8, least: int = 20, ratio: float = 0.6, extension: int = 200, inside: int = 100, quality: int = 0, store: Store | None = None) -> DataFrame:
    """Circles between repeats; bases under the given quality do not count for coverage."""
    store = store or Store(reads.sparkSession, "repeats")
    merged = store.keep(ev.merge_repeats(ev.repeat_spans(reads, most_edits), share, least), "merged")
    return cov.filter_by_ratio(cov.coverage_stats(merged, cov.covering_blocks(reads, quality), contigs, extension, inside), ratio)


def simulate(
    spark: SparkSession, genome: DataFrame, reads: int, seed: int = 1, read_length: int = 150, insert: int = 300, coverage: float = 30.0, exclude: DataFrame | None = None, store: Store | None = None
) -> tuple[DataFrame, DataFrame]:
    """Circles (the truth) and their read pairs: whole circles until there are more than ``reads`` pairs."""
    store = store or Store(spark, "simulate")
    cut = store.keep(chunks(genome), "genome")
    contigs = cut.groupBy("chrom").agg(F.sum(F.length("bases")).alias("length"))
    made = store.keep(sim.circles_for_reads(spark, contigs, reads, seed, read_length, coverage, exclude), "circles")
    return made, sim.simulate_reads(made, cut, seed, read_length, insert, coverage)
