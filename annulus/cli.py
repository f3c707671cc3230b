"""Command line: extract, realign, realign-reads, repeats and simulate."""

from __future__ import annotations

import argparse
import sys
from dataclasses import fields

from pyspark.sql import SparkSession

from annulus.plans import pipelines as P
from annulus.session import ship
from annulus.sources import bam, text
from annulus.sources.fasta import Fasta

#: Short options of the realignment commands, by parameter.
SHORT = {
    "hits": "-n", "probability": "-p", "min_clip": "-m", "gap_open": "-g", "gap_extend": "-e", "mapq": "-q", "edit_share": "-d", "least_score": "-Q", "insert_mapq": "-iq", "std_extension": "-sd",
    "sample": "-s", "merge_share": "-f", "interval_probability": "-P", "cluster_gap": "-K", "allele_frequency": "-F", "splits": "-S", "discordants": "-O", "ratio": "-r", "extension": "-b", "inside": "-E",
    "coverage_quality": "-cq",
}
#: Short switches, with what they set: the second one's default is to use discordant reads alone.
SWITCHES = {"remap_splits": ("-R", True), "only_discordants": ("-D", False), "coverage": ("-N", False)}
#: Parameters that only circles have.
OF_CIRCLES = {"merge_share", "allele_frequency", "splits", "discordants", "ratio", "coverage", "extension", "inside", "coverage_quality"}


def _running(command: argparse.ArgumentParser) -> None:
    command.add_argument("-t", "--threads", type=int, default=None, help="cores of a local session that this starts; a cluster's session has its own")
    command.add_argument("-dir", "--directory", default=None, help="folder for the outputs whose paths are relative")
    command.add_argument("-v", "--verbose", type=int, choices=(1, 2, 3), default=3, help="1 errors, 2 warnings, 3 messages")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="annulus")
    subs = top.add_subparsers(dest="command", required=True)
    e = subs.add_parser("extract")
    e.add_argument("-i", required=True)
    e.add_argument("-o", "--output", required=True)
    e.add_argument("-q", "--quality", type=int, default=10)
    for short, name in (("-nd", "--nodiscordant"), ("-nsc", "--nosoftclipped"), ("-nhc", "--nohardclipped")):
        e.add_argument(short, name, action="store_true")
    _running(e)
    for name in ("realign", "realign-reads"):
        r = subs.add_parser(name)
        for flag in ("-i", "-qbam", "-fasta"):
            r.add_argument(flag, required=True)
        r.add_argument("-o", "--output", required=True)
        if name == "realign":
            r.add_argument("-sbam", required=True)
        for f in fields(P.Params):
            if name == "realign-reads" and f.name in OF_CIRCLES:
                continue
            option = f"--{f.name.replace('_', '-')}"
            if f.name in SWITCHES:
                short, value = SWITCHES[f.name]
                r.add_argument(short, option if value else f"--no-{f.name.replace('_', '-')}", dest=f.name, action="store_true" if value else "store_false", default=f.default)
            else:
                r.add_argument(*([SHORT[f.name]] if f.name in SHORT else []), option, dest=f.name, type={"int": int, "float": float}[f.type], default=f.default)
        _running(r)
    x = subs.add_parser("repeats")
    x.add_argument("-i", required=True)
    x.add_argument("-o", "--output", required=True)
    options = (("-m", "--mismatch", int, 2), ("-f", "--fraction", float, 0.8), ("-n", "--read-number", int, 20), ("-r", "--ratio", float, 0.6), ("-b", "--bases", int, 200), ("-E", "--extension", int, 100), ("-cq", "--base-quality", int, 0))
    for short, name, kind, default in options:
        x.add_argument(short, name, type=kind, default=default)
    _running(x)
    s = subs.add_parser("simulate")
    s.add_argument("-g", required=True, help="genome")
    s.add_argument("-N", "--read-number", type=int, required=True, help="read pairs: whole circles are drawn until there are more")
    s.add_argument("-o", "--output", default="simulated.bed")
    s.add_argument("-b", "--base-name", default="simulated")
    s.add_argument("-s", "--skip-region", default=None)
    options = (("-r", "--read-length", int, 150), ("-m", "--mean-insert-size", int, 300), ("-c", "--mean-coverage", float, 30.0), ("-S", "--substitution", float, 1e-4), ("-I", "--Indels", float, 1e-3), ("-ir", "--insRate", float, 9e-5))
    options += (("-ir2", "--insRate2", float, 1.5e-4), ("-dr", "--delRate", float, 1.1e-4), ("-dr2", "--delRate2", float, 2.3e-4), ("-seed", "--seed", int, 1))
    for short, name, kind, default in options:
        s.add_argument(short, name, type=kind, default=default)
    s.add_argument("-v", "--variants", action="store_true", help="simulate from a genome with substitutions (-S) and indels (-I)")
    s.add_argument("-e", "--error", action="store_true", help="sequencing errors, by qualities that fall along the read and the rates -ir, -ir2, -dr and -dr2")
    s.add_argument("-p", "--processes", type=int, default=None, dest="threads")
    s.add_argument("-dir", "--directory", default=None)
    return top


def _at(directory: str | None, path: str) -> str:
    return path if directory is None or path.startswith("/") or ":" in path else f"{directory.rstrip('/')}/{path}"


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    builder = SparkSession.builder.appName("annulus")
    spark = ship((builder.master(f"local[{a.threads}]") if a.threads and SparkSession.getActiveSession() is None else builder).getOrCreate())
    says = (lambda *x: print(*x, file=sys.stderr)) if getattr(a, "verbose", 3) == 3 else lambda *x: None
    at = lambda path: _at(a.directory, path)
    if a.command == "extract":
        bam.require_order(spark, a.i, "queryname")
        contigs = [(r.chrom, r.length) for r in bam.read_contigs(spark, a.i).orderBy("ref_id").collect()]
        reads = bam.read_bam(spark, a.i)
        bam.write_bam(P.extract(reads, a.quality, not a.nodiscordant, not a.nosoftclipped, not a.nohardclipped), at(a.output), contigs, text=bam.header_text(spark, a.i))
        says(f"{P.unpaired(reads).count()} reads have no mate before or behind them in the file")
    elif a.command == "repeats":
        text.write_bed(P.repeats(bam.read_bam(spark, a.i), bam.read_contigs(spark, a.i), a.mismatch, a.fraction, a.read_number, a.ratio, a.bases, a.extension, a.base_quality), at(a.output))
    elif a.command == "simulate":
        from annulus.operators.simulate import fastq, mutate

        exclude = text.read_bed(spark, a.skip_region) if a.skip_region else None
        genome = text.read_fasta(spark, a.g)
        if a.variants:
            genome = mutate(genome, a.seed, a.substitution, a.Indels)
        made, pairs = P.simulate(spark, genome, a.read_number, a.seed, a.read_length, a.mean_insert_size, a.mean_coverage, exclude)
        text.write_bed(made.select("chrom", "start", "end"), at(a.output))
        rows = fastq(pairs, a.seed, a.error, (a.insRate, a.insRate2), (a.delRate, a.delRate2), a.read_length)
        for mate in (1, 2):
            text.write_fastq(rows.where(f"mate = {mate}"), at(f"{a.base_name}_{mate}"))
        drawn = made.agg({"circle": "max"}).first()[0]
        print(f"{made.count()} circles, {0 if drawn is None else drawn + 1 - made.count()} skipped in excluded regions", file=sys.stderr)
    else:
        p = P.Params(**{f.name: getattr(a, f.name) for f in fields(P.Params) if hasattr(a, f.name)})
        bam.require_order(spark, a.qbam, "queryname")
        candidates, named, genome = bam.read_bam(spark, a.i), bam.read_bam(spark, a.qbam), Fasta(spark, a.fasta)
        contigs = bam.read_contigs(spark, a.i)
        if a.command == "realign":
            bam.require_order(spark, a.sbam, "coordinate")
            text.write_bed(P.realign(candidates, named, bam.read_bam(spark, a.sbam), contigs, genome, p), at(a.output))
        else:
            bam.write_bam(P.realign_reads(candidates, named, contigs, genome, p), at(a.output), [(r.chrom, r.length) for r in contigs.orderBy("ref_id").collect()], text=bam.header_text(spark, a.i))


if __name__ == "__main__":
    main()
