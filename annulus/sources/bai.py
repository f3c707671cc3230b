"""The index of a coordinate-sorted BAM file: bins and a linear index by virtual offset.

A record lies in the smallest bin that holds its whole span; each bin lists the chunks of the file
(from virtual offset, to virtual offset) in which its records stand. The linear index gives, for
each window of 16 kb, the first record that reaches into it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annulus.schema import UNMAPPED
from annulus.sources.bam import MOST_BLOCK, header, located
from annulus.sources.ranges import RANGE, files, opened, ranges, read_bytes
from annulus.sources.records import fixed_fields, reference_spans

#: First bin and size (as a power of two) of each level, the window of the linear index, and the bin of statistics.
LEVELS = ((4681, 14), (585, 17), (73, 20), (9, 23), (1, 26), (0, 29))
WINDOW = 14
STATISTICS = 37450


class Reference(NamedTuple):
    """Of one contig: chunks by bin, and first virtual offsets by window."""

    bins: dict[int, list[tuple[int, int]]]
    linear: np.ndarray


def bins_of(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bin of each span [start, end)."""
    out = np.zeros(len(start), np.int64)
    last = np.maximum(end, start + 1) - 1
    for first, size in LEVELS[::-1]:
        out = np.where(start >> size == last >> size, first + (start >> size), out)
    return out


def reached_bins(start: int, end: int) -> set[int]:
    """Bins whose records may overlap [start, end)."""
    return {first + k for first, size in LEVELS for k in range(start >> size, (max(end, start + 1) - 1 >> size) + 1)}


def parse(raw: bytes) -> list[Reference]:
    """The contigs of an index file."""
    if raw[:4] != b"BAI\x01":
        raise ValueError("not an index of a BAM file")
    n, at, out = struct.unpack_from("<i", raw, 4)[0], 8, []
    for _ in range(n):
        bins: dict[int, list[tuple[int, int]]] = {}
        n_bins, at = struct.unpack_from("<i", raw, at)[0], at + 4
        for _ in range(n_bins):
            number, k = struct.unpack_from("<Ii", raw, at)
            pairs = np.frombuffer(raw, "<u8", 2 * k, at + 8).reshape(-1, 2).tolist()
            if number != STATISTICS:
                bins[number] = [tuple(p) for p in pairs]
            at += 8 + 16 * k
        windows = struct.unpack_from("<i", raw, at)[0]
        out.append(Reference(bins, np.frombuffer(raw, "<u8", windows, at + 4).astype(np.int64)))
        at += 4 + 8 * windows
    return out


def merged(chunks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The chunks in order; those between which less than a block of the file lies are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(chunks):
        if out and a >> 16 <= (out[-1][1] >> 16) + MOST_BLOCK:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def chunks_of(reference: Reference, start: int, end: int) -> list[tuple[int, int]]:
    """Virtual ranges, in order and apart, that hold all records which overlap [start, end)."""
    window = start >> WINDOW
    # windows behind the last one hold no record's beginning, but a record may reach into them from before
    least = int(reference.linear[window]) if window < len(reference.linear) else 0
    wanted = reached_bins(start, end)
    return merged([(max(a, least), b) for k in wanted.intersection(reference.bins) for a, b in reference.bins[k] if b > least])


def divided(reference: Reference, chunks: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """The same ranges, cut at records that the index knows of where they span over size bytes of the file."""
    places = np.unique(reference.linear)
    out = []
    for a, b in chunks:
        while (b >> 16) - (a >> 16) > size:
            k = int(np.searchsorted(places, (((a >> 16) + size) << 16)))
            cut = int(places[k]) if k < len(places) else b
            if not a < cut < b:
                break
            out.append((a, cut))
            a = cut
        out.append((a, b))
    return out


def index_path(path: str) -> str | None:
    """The index beside a file: its name with .bai behind it, or in the place of .bam."""
    from pyarrow import fs

    for name in (f"{path}.bai", f"{path.removesuffix('.bam')}.bai"):
        system, target = opened(name)
        if system.get_file_info(target).type == fs.FileType.File:
            return name
    return None


def load(path: str) -> list[Reference] | None:
    """The index beside a BAM file, if there is one."""
    name = index_path(path)
    if name is None:
        return None
    system, target = opened(name)
    return parse(read_bytes(name, 0, system.get_file_info(target).size))


_CHUNKS = "path string, ref int, bin int, begin long, end long"


def _located_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of records of one bin (from, to), and for each window the first record that reaches into it (bin -1 - window)."""
    for batch in batches:
        for path, lo, hi, size in zip(*(batch.column(c).to_pylist() for c in ("path", "lo", "hi", "size"))):
            for data, starts, ordinals in located(path, lo, hi, size):
                fixed = fixed_fields(data, starts)
                # a placed read without a span counts as one base
                span = np.maximum(reference_spans(data, starts, fixed) * (fixed["flag"] & UNMAPPED == 0), 1)
                begin = fixed["pos"].astype(np.int64)
                placed = np.flatnonzero((fixed["ref"] >= 0) & (begin >= 0))
                ref, bin_ = fixed["ref"].astype(np.int64), bins_of(begin, begin + span)
                run = np.ones(len(placed), bool)
                run[1:] = (np.diff(ref[placed]) != 0) | (np.diff(bin_[placed]) != 0) | (np.diff(placed) != 1)
                first = placed[run]
                last = placed[np.append(np.flatnonzero(run)[1:], len(placed)) - 1] if len(placed) else placed
                # a chunk ends where the next record begins; the last one at the end of the record's block
                after = np.append(ordinals[1:], ((ordinals[-1] >> 16) + 1) << 16)
                lo_w, hi_w = begin[placed] >> WINDOW, (begin + span - 1)[placed] >> WINDOW
                times = hi_w - lo_w + 1
                windows = np.repeat(lo_w, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                key = np.repeat(ref[placed], times) << 32 | windows
                _, at = np.unique(key, return_index=True)  # the first of each, in file order
                reach = np.repeat(ordinals[placed], times)[at]
                columns = [np.append(ref[first], key[at] >> 32), np.append(bin_[first], -1 - (key[at] & 0xFFFFFFFF)), np.append(ordinals[first], reach), np.append(after[last], reach)]
                arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(columns[0]), pa.string()), *arrays], names=["path", "ref", "bin", "begin", "end"])


def _write(batches: Iterator[pa.RecordBatch], counts: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Index files, contig by contig, from chunks sorted by path, ref, bin and begin."""

    def contig(rows: list[tuple[int, int, int]]) -> bytes:
        bins: dict[int, list[list[int]]] = {}
        first: dict[int, int] = {}
        for bin_, begin, end in rows:
            if bin_ < 0:
                first[-1 - bin_] = min(begin, first.get(-1 - bin_, begin))
            elif (own := bins.setdefault(bin_, [])) and begin <= own[-1][1]:
                own[-1][1] = max(own[-1][1], end)
            else:
                own.append([begin, end])
        out = [struct.pack("<i", len(bins))]
        for k in sorted(bins):
            out.append(struct.pack("<Ii", k, len(bins[k])) + b"".join(struct.pack("<QQ", *c) for c in bins[k]))
        linear, before = [], 0
        for w in range(max(first, default=-1) + 1):
            before = first.get(w, before)
            linear.append(before)
        return b"".join(out) + struct.pack(f"<i{len(linear)}Q", len(linear), *linear)

    stream, path, ref, rows = None, None, 0, []

    def upto(target: int) -> None:
        nonlocal ref, rows
        while ref < target:
            stream.write(contig(rows))
            rows, ref = [], ref + 1

    def close() -> None:
        if stream is not None:
            upto(counts[path])
            stream.close()

    for batch in batches:
        for p, r, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if p != path:
                close()
                path, ref, rows = p, 0, []
                system, target = opened(f"{p}.bai")
                stream = system.open_output_stream(target)
                stream.write(b"BAI\x01" + struct.pack("<i", counts[p]))
            upto(r)
            rows.append(tuple(row))
    close()
    yield pa.RecordBatch.from_arrays([pa.array([], pa.string())], names=["path"])


def write_index(spark: SparkSession, path: str, range_bytes: int = RANGE) -> None:
    """Write FILE.bai beside each coordinate-sorted BAM file of a path.

    Ranges of a file are looked through by tasks of their own, and what they find (a row for each run of
    records of a bin) is joined there; one task for each file writes it, contig by contig.
    """
    names = [name for name, _ in files(spark, path) if name.endswith(".bam")]
    counts = {name: len(header(name)[1]) for name in names}
    found: DataFrame = ranges(spark, path, range_bytes).where(F.col("path").endswith(".bam")).mapInArrow(_located_chunks, _CHUNKS)
    # neighbours that touch are one chunk; what is left is small beside the file
    order = Window.partitionBy("path", "ref", "bin").orderBy("begin")
    apart = F.coalesce(F.lag("end").over(order) < F.col("begin"), F.lit(True)).cast("int")
    joined = found.withColumn("_k", F.sum(apart).over(order)).groupBy("path", "ref", "bin", "_k").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    dealt = joined.select("path", "ref", "bin", "begin", "end").repartition(len(names), "path").sortWithinPartitions("path", "ref", "bin", "begin")
    dealt.mapInArrow(partial(_write, counts=counts), "path string").collect()
