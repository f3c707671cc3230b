"""FASTA files by pages of bytes: no contig is ever one row, and bases that nobody asks for are not read.

Tasks look through ranges of a file, a page at a time, and note for each part of a page that belongs
to one contig where its bytes lie and how many bases they hold. Sums along the file give the number
of each part's first base, whatever the length of the lines. From then on a chunk of a contig is a short
read of bytes: ``chunks`` reads the chunks that intervals reach, each in one piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annulus.shared import Store
from annulus.sources.ranges import RANGE, ranges, read_bytes
from annulus.sources.text import CHUNK, chunks

C = F.col
#: Bytes of a page, and of a header line that are read at a time.
PAGE = 1 << 16
_LINE = 1 << 12
_NEWLINE, _HEADER, _BLANK = 10, 62, 32

_PARTS = "path string, at long, lo long, hi long, part int, name string, bases long, first_line long, later_bases long, ended boolean, opens boolean"


def _name(path: str, at: int, size: int) -> str:
    """The name in the header line that begins at a byte: up to the first blank."""
    line = b""
    while at + len(line) < size:
        line += read_bytes(path, at + len(line), min(size, at + len(line) + _LINE))
        if line.split(None, 1)[0] != line or b"\n" in line:
            break
    return (line[1:].split(b"\n", 1)[0].split(None, 1) or [b""])[0].decode()


def _parts(batches: Iterator[pa.RecordBatch], page: int) -> Iterator[pa.RecordBatch]:
    """The parts of each page. The first one goes on with what stood before: its bases are counted from its beginning, and from its second line."""
    names = [x.split()[0] for x in _PARTS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
    for batch in batches:
        for path, lo, hi, size in zip(*(batch.column(c).to_pylist() for c in ("path", "lo", "hi", "size"))):
            for at in range(lo, hi, page):
                end, before = min(at + page, hi), min(at, 1)
                raw = np.frombuffer(read_bytes(path, at - before, end), np.uint8)
                starts_line = np.append(at == 0, raw[:-1] == _NEWLINE) if not before else raw[:-1] == _NEWLINE
                data = raw[before:]
                lines = np.flatnonzero(data == _NEWLINE)
                counted = np.append(0, np.cumsum(data > _BLANK))
                heads = np.flatnonzero((data == _HEADER) & starts_line)
                rows = []
                cuts = [0, *heads.tolist(), len(data)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    i = int(np.searchsorted(lines, a))
                    ended = i < len(lines) and lines[i] < b
                    body = int(lines[i]) + 1 if ended else b  # where the second line begins
                    later = int(counted[b] - counted[body])
                    if k:
                        rows.append((path, at, at + body, at + b, k, _name(path, at + a, size), later, at + body, later, ended, not ended))
                    elif b:
                        rows.append((path, at, at, at + b, 0, None, int(counted[b]), at + body, later, ended, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names=names)


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chrom, chunk, path, lo, hi, base in zip(*(c.to_pylist() for c in batch.columns)):
            raw = np.frombuffer(read_bytes(path, lo, hi), np.uint8)
            first = chunk * size - base  # below 0 where the contig's part begins within the chunk
            bases = raw[raw > _BLANK][max(first, 0) : max(first + size, 0)]
            yield pa.RecordBatch.from_arrays([pa.array([chrom], pa.string()), pa.array([chunk], pa.int64()), pa.array([bases.tobytes()], pa.binary()).cast(pa.string())], names=["chrom", "chunk", "bases"])


class Fasta:
    """A FASTA file (or folder of them, with names that differ) whose pages have been counted."""

    def __init__(self, spark: SparkSession, path: str, store: Store | None = None, range_bytes: int = RANGE, page: int = PAGE):
        found = ranges(spark, path, range_bytes).mapInArrow(partial(_parts, page=page), _PARTS)
        along = Window.partitionBy("path").orderBy("at", "part")
        so_far = along.rowsBetween(Window.unboundedPreceding, -1)
        # a page may begin in a header line that began before it, and such a line may take several pages
        opens = F.when(C("part") > 0, C("opens")).when(C("ended"), F.lit(False))
        found = found.withColumn("_in_header", (C("part") == 0) & F.coalesce(F.last(opens, ignorenulls=True).over(so_far), F.lit(False)))
        found = found.withColumns({"chrom": F.last("name", ignorenulls=True).over(along), "_contig": F.count("name").over(along)})
        found = found.withColumns({"bases": F.when(C("_in_header"), C("later_bases")).otherwise(C("bases")), "lo": F.when(C("_in_header"), C("first_line")).otherwise(C("lo"))})
        within = Window.partitionBy("path", "_contig").orderBy("at", "part").rowsBetween(Window.unboundedPreceding, -1)
        found = found.withColumn("base", F.coalesce(F.sum("bases").over(within), F.lit(0)))
        self.pages = (store or Store(spark, "fasta")).keep(found.where("chrom IS NOT NULL AND (bases > 0 OR name IS NOT NULL)").select("chrom", "path", "lo", "hi", "base", "bases"), "pages")

    def contigs(self) -> DataFrame:
        """chrom and length of each contig."""
        return self.pages.groupBy("chrom").agg(F.sum("bases").alias("length"))

    def wanted(self, intervals: DataFrame | None = None, size: int = CHUNK) -> DataFrame:
        """Where the chunks lie that the intervals reach (all without intervals): chrom, chunk, path, bytes [lo, hi) and the number of the first base there."""
        own = self.pages.where("bases > 0").withColumn("chunk", F.explode(F.sequence(F.floor(C("base") / size), F.floor((C("base") + C("bases") - 1) / size))))
        if intervals is not None:
            own = own.join(reached(intervals, size), ["chrom", "chunk"], "left_semi")
        return own.groupBy("chrom", "chunk").agg(F.first("path").alias("path"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("base").alias("base"))

    def chunks(self, intervals: DataFrame | None = None, size: int = CHUNK) -> DataFrame:
        """chrom, chunk and bases, as ``fetch`` takes them, of the chunks that the intervals reach."""
        return self.wanted(intervals, size).mapInArrow(partial(_chunks, size=size), "chrom string, chunk long, bases string")


def reached(intervals: DataFrame, size: int = CHUNK) -> DataFrame:
    """The chunks (chrom, chunk) that intervals reach."""
    spans = intervals.select("chrom", "start", "end").where("end > start AND end > 0")
    return spans.select("chrom", F.explode(F.sequence(F.floor(F.greatest(C("start"), F.lit(0)) / size), F.floor((C("end") - 1) / size))).alias("chunk")).distinct()


def genome_chunks(genome: Fasta | DataFrame, intervals: DataFrame) -> DataFrame:
    """Chunks for ``fetch`` of the intervals: of a file, those that they reach; of rows (chrom, chunk, bases) or (chrom, seq), all."""
    if isinstance(genome, Fasta):
        return genome.chunks(intervals)
    return genome if "chunk" in genome.columns else chunks(genome)
