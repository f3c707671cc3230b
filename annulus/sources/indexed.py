"""BAM files as a data source that plans by the files' indexes.

    spark.read.format("bam").load("reads.bam").where("chrom = 'chr2' AND pos >= 10000 AND pos < 20000")

A filter on chrom (equal, or in a list) and pos picks, by the index beside each file, the chunks of
the bins that such records lie in, and nothing else of the file is read; Spark still applies the
filter. The option ``regions`` (``chr1:1000-2000;chr2``, half open, from 0) gives the records that overlap regions. A file
without an index is read by ranges. ``register(spark)`` makes the format known to a session.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from annulus.schema import READS
from annulus.sources import bai
from annulus.sources.bam import batches_of, contig_names, header, located
from annulus.sources.ranges import RANGE, opened
from annulus.sources.records import fixed_fields, reference_spans

#: Where no contig reaches.
FAR = 1 << 29


def listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of the BAM files that a path or folder names."""
    from pyarrow import fs

    system, name = opened(path)
    info = system.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else [x for x in system.get_file_info(fs.FileSelector(name)) if x.base_name.endswith(".bam")]
    base = path[: len(path) - len(name)] if path.endswith(name) else ""
    return sorted((base + x.path, x.size) for x in found)


def parse_regions(text: str) -> list[tuple[str, int, int]]:
    """(contig, start, end) of ``name:start-end`` or ``name``, with ; between them."""
    out = []
    for one in filter(None, (x.strip() for x in text.split(";"))):
        name, found, span = one.rpartition(":")
        lo, dash, hi = span.partition("-")
        if found and dash and lo.isdigit() and hi.isdigit():
            out.append((name, int(lo), int(hi)))
        else:
            out.append((one, 0, FAR))
    return out


@dataclass
class Span(InputPartition):
    """A part of a file: bytes [lo, hi), or the records of chunks (from one virtual offset to another); of those, the ones that overlap regions (by contig number), if any are given."""

    path: str
    size: int
    lo: int
    hi: int
    chunks: tuple[tuple[int, int], ...] | None = None
    regions: tuple[tuple[int, int, int], ...] | None = None


class BamReader(DataSourceReader):
    def __init__(self, path: str, regions: list[tuple[str, int, int]] | None, range_bytes: int):
        self.path, self.regions, self.range_bytes = path, regions, range_bytes
        self.chroms: set[str] | None = None
        self.least, self.most = 0, FAR

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """What chrom and pos must be; all filters stay with Spark."""
        for f in filters:
            column = getattr(f, "attribute", None)
            value = getattr(f, "value", None)
            if column == ("chrom",) and isinstance(f, (EqualTo, In)):
                named = set(value) if isinstance(f, In) else {value}
                self.chroms = named if self.chroms is None else self.chroms & named
            elif column == ("pos",) and isinstance(value, int):
                if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                    self.least = max(self.least, value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
                    self.most = min(self.most, value + (not isinstance(f, LessThan)))
            yield f

    def wanted(self) -> list[tuple[str, int, int]] | None:
        """Regions that records of the result overlap; None: any record. Records without a place are in no region."""
        if self.chroms is None:
            return self.regions
        pushed = [(c, self.least, self.most) for c in sorted(c for c in self.chroms if c is not None)]
        if self.regions is None:
            return pushed
        # a record that begins in a pushed region and overlaps a given one: the given ones of the same contigs are enough
        return [r for r in self.regions if r[0] in self.chroms]

    def partitions(self) -> Sequence[InputPartition]:
        wanted, out = self.wanted(), []
        for path, size in listed(self.path):
            index = None if wanted is None else bai.load(path)
            kept = None
            if wanted is not None:
                numbers = {c: i for i, (c, _) in enumerate(header(path)[1])}
                kept = tuple((numbers[c], lo, hi) for c, lo, hi in wanted if c in numbers and lo < hi)
            if index is None:
                if kept is None or kept:
                    out += [Span(path, size, lo, min(lo + self.range_bytes, size), regions=kept) for lo in range(0, size, self.range_bytes)]
                continue
            for number in sorted({k for k, _, _ in kept}):
                own = [(lo, hi) for k, lo, hi in kept if k == number]
                chunks = bai.merged([c for lo, hi in own for c in bai.chunks_of(index[number], lo, hi)])
                regions = tuple((number, lo, hi) for lo, hi in own)
                # small chunks share a task, large ones are cut
                held: list[tuple[int, int]] = []
                for a, b in bai.divided(index[number], chunks, self.range_bytes):
                    if held and sum((y >> 16) - (x >> 16) for x, y in (*held, (a, b))) > self.range_bytes:
                        out.append(Span(path, size, 0, 0, tuple(held), regions))
                        held = []
                    held.append((a, b))
                if held:
                    out.append(Span(path, size, 0, 0, tuple(held), regions))
        return out

    def read(self, partition: Span | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's way to read no partition at all
            return
        p = partition
        names = contig_names(p.path)
        whole = located(p.path, p.lo, p.hi, p.size) if p.chunks is None else (x for a, b in p.chunks for x in located(p.path, 0, 0, p.size, a, b))
        for data, starts, ordinals in whole:
            if p.regions is not None:
                fixed = fixed_fields(data, starts)
                begin = fixed["pos"].astype(np.int64)
                end = begin + np.maximum(reference_spans(data, starts, fixed), 1)
                keep = np.zeros(len(starts), bool)
                for number, lo, hi in p.regions:
                    keep |= (fixed["ref"] == number) & (begin < hi) & (end > lo)
                starts, ordinals = starts[keep], ordinals[keep]
            yield from batches_of(data, starts, ordinals, names)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return READS

    def reader(self, schema) -> BamReader:
        regions = self.options.get("regions")
        return BamReader(self.options["path"], None if regions is None else parse_regions(regions), int(self.options.get("range_bytes", RANGE)))


def register(spark: SparkSession) -> None:
    """Make the format ``bam`` known, and let Spark hand filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BamSource)
