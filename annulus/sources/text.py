"""FASTA, FASTQ, SAM and BED as text that Spark splits and reads in parallel."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annulus.functions.reads import parse_cigar
from annulus.schema import FASTQ
from annulus.sources.ranges import RANGE, files, ranges, read_bytes

C = F.col


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """chrom (up to the first blank) and seq of each record."""
    rows = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''")
    return rows.select(F.regexp_extract("value", "^([^\\s]+)", 1).alias("chrom"), F.regexp_replace(F.regexp_replace("value", "^[^\\n]*\\n?", ""), "\\s", "").alias("seq"))


#: Bases of a chunk of a contig.
CHUNK = 1 << 16


def _cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chrom, seq in zip(batch.column("chrom").to_pylist(), batch.column("seq")):
            raw = memoryview(seq.as_buffer() or b"")
            for lo in range(0, len(raw), size * 64):
                parts = [bytes(raw[at : at + size]) for at in range(lo, min(lo + size * 64, len(raw)), size)]
                numbers = range(lo // size, lo // size + len(parts))
                yield pa.RecordBatch.from_arrays([pa.array([chrom] * len(parts), pa.string()), pa.array(numbers, pa.int64()), pa.array(parts, pa.binary()).cast(pa.string())], names=["chrom", "chunk", "bases"])


def chunks(genome: DataFrame, size: int = CHUNK) -> DataFrame:
    """Contigs (chrom, seq; bases are ASCII) in chunks: chrom, chunk (from 0) and bases. A contig is read once, by one task."""
    return genome.where("chrom IS NOT NULL AND seq IS NOT NULL").select("chrom", "seq").mapInArrow(partial(_cut, size=size), "chrom string, chunk long, bases string")


def fetch(intervals: DataFrame, cut: DataFrame, size: int = CHUNK) -> DataFrame:
    """intervals with the bases of [start, end), cut at the contig's ends; cut: the genome in ``chunks`` of the given size.

    Each interval meets the chunks that it reaches, so what is shuffled follows the intervals, not the
    contigs. Intervals without any base of the genome are left out.
    """
    spans = intervals.select("chrom", "start", "end").distinct().where("end > start AND end > 0")
    reached = F.sequence(F.floor(F.greatest(C("start"), F.lit(0)) / size), F.floor((C("end") - 1) / size))
    pieces = spans.withColumn("chunk", F.explode(reached)).join(cut.withColumnRenamed("bases", "_bases"), ["chrom", "chunk"])
    first = F.greatest(C("start") - C("chunk") * size, F.lit(0))
    part = F.substring("_bases", first.cast("int") + 1, (F.least(C("end") - C("chunk") * size, F.lit(size)) - first).cast("int"))
    pieces = pieces.select("chrom", "start", "end", F.struct("chunk", part.alias("part")).alias("p")).where("p.part <> ''")
    joined = pieces.groupBy("chrom", "start", "end").agg(F.array_join(F.array_sort(F.collect_list("p"))["part"], "").alias("bases"))
    return intervals.join(joined, ["chrom", "start", "end"]).select(*intervals.columns, "bases")


def _whole_record(lines: list[bytes]) -> bool:
    return len(lines) >= 4 and lines[0][:1] == b"@" and lines[2][:1] == b"+" and len(lines[1].rstrip(b"\r")) == len(lines[3].rstrip(b"\r"))


def _fastq_records(path: str, lo: int, hi: int, size: int) -> Iterator[tuple[bytes, bytes, bytes]]:
    """Records that begin in a file's bytes [lo, hi). A line of qualities may begin with @, but then its record is not whole from there."""
    begin, tail = max(0, lo - 1), 1 << 16
    raw = read_bytes(path, begin, min(size, hi + tail))
    while begin + len(raw) < size and raw.count(b"\n", hi - begin) < 8:  # the last record, and proof of where the first one begins
        raw += read_bytes(path, begin + len(raw), min(size, begin + len(raw) + tail))
        tail *= 2
    lines = raw.split(b"\n")
    at = begin
    if lo:
        at += len(lines[0]) + 1
        lines = lines[1:]
        skip = next((k for k in range(4) if _whole_record(lines[k : k + 4])), None)
        if skip is None:
            return
        at += sum(len(x) + 1 for x in lines[:skip])
        lines = lines[skip:]
    k = 0
    while at < hi and k + 4 <= len(lines):
        own = lines[k : k + 4]
        if not _whole_record(own):
            if not any(x.strip() for x in lines[k:]):
                return
            raise ValueError(f"no FASTQ record at byte {at} of {path}")
        yield own[0][1:].rstrip(b"\r"), own[1].rstrip(b"\r"), own[3].rstrip(b"\r")
        at += sum(len(x) + 1 for x in own)
        k += 4


def _fastq(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, lo, hi, size in zip(*(batch.column(c).to_pylist() for c in ("path", "lo", "hi", "size"))):
            records = _fastq_records(path, lo, hi, size)
            while rows := list(islice(records, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()).cast(pa.string()) for x in zip(*rows)], names=["name", "seq", "qual"])


def read_fastq(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """name, seq and qual of FASTQ files' records, read by ranges; a compressed file is read by one task."""
    if any(name.endswith((".gz", ".bz2", ".zst")) for name, _ in files(spark, path)):
        lines = spark.read.text(path, wholetext=True)
        groups = F.regexp_extract_all("value", F.lit("@[^\\n]*\\n[^\\n]*\\n\\+[^\\n]*\\n[^\\n]*"), F.lit(0))
        p = lines.select(F.explode(groups).alias("r")).select(F.split("r", "\\n").alias("p"))
        return p.select(F.right(C("p")[0], F.length(C("p")[0]) - 1).alias("name"), C("p")[1].alias("seq"), C("p")[3].alias("qual"))
    return ranges(spark, path, range_bytes).mapInArrow(_fastq, FASTQ)


def write_fastq(rows: DataFrame, path: str) -> None:
    rows.select(F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value")).write.mode("overwrite").text(path)


def read_bed(spark: SparkSession, path: str, columns: str = "chrom string, start long, end long") -> DataFrame:
    return spark.read.schema(columns).option("sep", "\t").option("comment", "#").csv(path)


def write_bed(rows: DataFrame, path: str) -> None:
    """Tab-separated columns without a header (BED, and the wider tables of circles)."""
    rows.write.mode("overwrite").option("sep", "\t").option("header", "false").csv(path)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Records of SAM text: name, flag, chrom, 0-based pos, mapq, cigar, mate, template length, bases, qualities and tags."""
    p = F.split("value", "\t")
    tags = F.map_from_entries(
        F.transform(F.slice(p, F.lit(12), F.greatest(F.size(p) - 11, F.lit(0))), lambda t: F.struct(F.left(t, F.lit(2)).alias("k"), F.right(t, F.length(t) - 3).alias("v")))
    )
    rows = spark.read.text(path).where("value NOT LIKE '@%' AND value <> ''").select(p.alias("p"), tags.alias("tags"))
    x = lambda i: C("p")[i]
    typed = lambda k: F.try_element_at(C("tags"), F.lit(k))
    tag = lambda k: F.right(typed(k), F.length(typed(k)) - 2)
    return rows.select(
        x(0).alias("qname"), x(1).cast("int").alias("flag"), x(2).alias("chrom"), (x(3).cast("long") - 1).alias("pos"), x(4).cast("int").alias("mapq"), parse_cigar(x(5)).alias("cigar"),
        F.when(x(6) == "=", x(2)).otherwise(x(6)).alias("next_chrom"), (x(7).cast("long") - 1).alias("next_pos"), x(8).cast("long").alias("tlen"), x(9).alias("seq"),
        F.transform(F.split(x(10), ""), lambda c: F.ascii(c) - 33).alias("qual"), tag("SA").alias("sa"), tag("XA").alias("xa"), tag("NM").cast("int").alias("nm"), tag("MQ").cast("int").alias("mq"), "tags",
    )


def sam_lines(reads: DataFrame) -> DataFrame:
    """Reads as SAM lines."""
    cigar = F.array_join(F.transform("cigar", lambda c: F.concat(c["len"].cast("string"), F.substring(F.lit("MIDNSHP=X"), c["op"] + 1, F.lit(1)))), "")
    tag = lambda n, kind, c: F.when(C(c).isNotNull(), F.concat(F.lit(f"{n}:{kind}:"), C(c).cast("string")))
    others = F.transform(F.filter(F.map_entries("tags"), lambda t: ~t["key"].isin("SA", "XA", "NM", "MQ")), lambda t: F.concat_ws(":", t["key"], t["value"]))
    qual = F.array_join(F.transform("qual", lambda q: F.char(q + 33)), "")
    fields = ["qname", C("flag").cast("string"), "chrom", (C("pos") + 1).cast("string"), C("mapq").cast("string"), cigar, "next_chrom", (C("next_pos") + 1).cast("string"), C("tlen").cast("string"), "seq", qual]
    fields = [F.coalesce(C(f) if isinstance(f, str) else f, F.lit("*")) for f in fields]
    return reads.select(F.concat_ws("\t", *fields, tag("SA", "Z", "sa"), tag("XA", "Z", "xa"), tag("NM", "i", "nm"), tag("MQ", "i", "mq"), others).alias("value"))


def write_sam(reads: DataFrame, path: str) -> None:
    sam_lines(reads).write.mode("overwrite").text(path)
