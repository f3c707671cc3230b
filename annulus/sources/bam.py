"""BAM files, read and written by ranges and parts, each in a task of its own.

A BAM file is a chain of BGZF blocks (gzip members of at most 64 KB) over a header and records. A
file is cut in ranges of ``RANGE`` bytes. A task looks for the first block of its range (where
several blocks follow one another), and in it for the first record (where several records that make
sense do), and reads all records that begin in its blocks; the last one may run on into the next range. Files
are opened by pyarrow's file systems (local, HDFS, S3, GCS) in the tasks and listed by Spark.
"""

from __future__ import annotations

import struct
import uuid
import warnings
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from annulus.schema import CIGAR_OPS, CONTIGS, READS
from annulus.sources.ranges import RANGE, files, opened, ranges, read_bytes
from annulus.sources.records import BASES, NUMBERS, decoded

_BLOCK = 0xFF00
_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


#: Records that must follow one another where a range begins, and the largest block.
PROOF = 6
MOST_BLOCK = 1 << 16


def block_size(data: bytes, at: int) -> int:
    """Bytes of the BGZF block that begins at a place, or 0 if none does."""
    if data[at : at + 4] != b"\x1f\x8b\x08\x04" or len(data) < at + 18:
        return 0
    extra = struct.unpack_from("<H", data, at + 10)[0]
    p = at + 12
    while p + 4 <= min(len(data), at + 12 + extra):
        size = struct.unpack_from("<H", data, p + 2)[0]
        if data[p : p + 2] == b"BC" and size == 2 and p + 6 <= len(data):
            return struct.unpack_from("<H", data, p + 4)[0] + 1
        p += 4 + size
    return 0


def blocks(data: bytes, at: int = 0) -> Iterator[tuple[int, bytes]]:
    """(place, content) of the whole BGZF blocks from a place on. Time and memory grow with the data alone."""
    view = memoryview(data)
    while at < len(data):
        size = block_size(data, at)
        if not size or at + size > len(data):
            return
        extra = struct.unpack_from("<H", data, at + 10)[0]
        yield at, zlib.decompress(view[at + 12 + extra : at + size - 8], -15, MOST_BLOCK)
        at += size


def inflate(data: bytes) -> bytes:
    """The content of all BGZF blocks."""
    return b"".join(content for _, content in blocks(data))


def first_block(data: bytes, whole: bool) -> int:
    """Where the first block begins in bytes from the middle of a file; whole: whether they end with the file. -1 without any."""
    at = data.find(b"\x1f\x8b\x08\x04")
    while at >= 0:
        p, seen = at, 0
        while seen < 3 and p < len(data) and (size := block_size(data, p)):
            p, seen = p + size, seen + 1
        if seen == 3 or (seen and (p == len(data) if whole else p > len(data) - 18)):
            return at
        at = data.find(b"\x1f\x8b\x08\x04", at + 1)
    return -1


def deflate(data: bytes) -> bytes:
    """BGZF blocks of the data, without the end block."""
    out = []
    for lo in range(0, len(data), _BLOCK):
        part = data[lo : lo + _BLOCK]
        squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = squeeze.compress(part) + squeeze.flush()
        out.append(bytes.fromhex("1f8b08040000000000ff060042430200") + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


def parse_header(raw: bytes) -> tuple[str, list[tuple[str, int]], int]:
    """Header text, contigs and where the records begin."""
    if raw[:4] != b"BAM\x01":
        raise ValueError("not a BAM file")
    size = struct.unpack_from("<i", raw, 4)[0]
    text, at = raw[8 : 8 + size].rstrip(b"\0").decode(), 8 + size
    n, at = struct.unpack_from("<i", raw, at)[0], at + 4
    contigs = []
    for _ in range(n):
        k = struct.unpack_from("<i", raw, at)[0]
        name = raw[at + 4 : at + 3 + k].decode()
        contigs.append((name, struct.unpack_from("<i", raw, at + 4 + k)[0]))
        at += 8 + k
    return text, contigs, at


def sort_order(text: str) -> str:
    """SO of the header; unknown without one."""
    for line in text.splitlines():
        if line.startswith("@HD"):
            for part in line.split("\t")[1:]:
                if part.startswith("SO:"):
                    return part[3:]
    return "unknown"


def _sensible(raw: bytes, at: int, contigs: int) -> int:
    """Bytes of the record that may begin at a place; 0 if it makes no sense, -1 if the data ends before that can be told."""
    if at + 36 > len(raw):
        return -1
    size, ref, pos, n_name, _, _, n_cigar, _, n_seq, next_ref, next_pos, _ = struct.unpack_from("<iiiBBHHHiiii", raw, at)
    if not (-1 <= ref < contigs and -1 <= next_ref < contigs and pos >= -1 and next_pos >= -1 and n_name > 0 and n_seq >= 0):
        return 0
    if size < 32 + n_name + 4 * n_cigar + (n_seq + 1) // 2 + n_seq or size > 1 << 26:
        return 0
    if at + 36 + n_name > len(raw):
        return -1
    name = raw[at + 36 : at + 36 + n_name]
    if name[-1] or not all(33 <= c <= 126 for c in name[:-1]):
        return 0
    cigar = raw[at + 36 + n_name : at + 36 + n_name + 4 * n_cigar]
    if any(c & 15 > 8 for c in cigar[::4]):
        return 0
    return size + 4


def first_record(raw: bytes, contigs: int, limit: int) -> int:
    """Where the first record begins in data from the middle of a stream, before the limit; -1 without any."""
    for at in range(min(limit, len(raw))):
        p, seen = at, 0
        while seen < PROOF and p < len(raw) and (size := _sensible(raw, p, contigs)) > 0:
            p, seen = p + size, seen + 1
        if seen == PROOF or (seen and (p == len(raw) or p > len(raw) or _sensible(raw, p, contigs) < 0)):
            return at
    return -1


def header(path: str) -> tuple[str, list[tuple[str, int]], int, int]:
    """Header text and contigs of a file, and the place in the file and in its block where the records begin."""
    size, head = MOST_BLOCK * 4, b""
    while True:
        raw = read_bytes(path, 0, size)
        found = list(blocks(raw))
        head = b"".join(content for _, content in found)
        try:
            text, contigs, at = parse_header(head)
            if at <= len(head):
                break
        except (struct.error, IndexError):
            pass
        if len(raw) < size:
            raise ValueError("not a whole BAM file")
        size *= 4
    done = 0
    for place, content in found:
        if at < done + len(content):
            return text, contigs, place, at - done
        done += len(content)
    last = found[-1][0]
    return text, contigs, last + block_size(raw, last), 0


def located(path: str, lo: int, hi: int, size: int, begin: int | None = None, end: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Records that begin in the blocks that begin in a file's bytes [lo, hi): their data, where they start in it, and virtual offsets.

    With begin, the virtual offset of a record, what is read begins there, and ends before the virtual offset end.
    """
    if begin is not None:
        contigs, at, inside, hi = [], begin >> 16, begin & 0xFFFF, end >> 16
    else:
        _, contigs, first, inside = header(path)
        if hi <= first:
            return
        at = max(lo, first)
    begun = begin is not None or at == first
    tail = 4 * MOST_BLOCK
    raw = read_bytes(path, at, min(size, hi + tail))
    start = 0 if begun else first_block(raw, at + len(raw) == size)
    if start < 0 or (begin is None and at + start >= hi):
        return
    places, parts, total = [], [], 0
    stop, runs_on = None, begin is None  # without an index, what follows proves where records begin
    while True:
        consumed = start
        for place, content in blocks(raw, start):
            if stop is not None and not runs_on:
                break
            if at + place >= hi and stop is None:
                # records that begin from here on are another's; this block may end the last one
                stop = total + (end & 0xFFFF if at + place == hi else 0)
            places.append((total, at + place))
            parts.append(content)
            total += len(content)
            consumed = place + block_size(raw, place)
        data = b"".join(parts)
        where = inside if begun else first_record(data, len(contigs), len(data) if stop is None else stop)
        if where < 0:
            return
        limit = len(data) if stop is None else stop
        starts, done = [], where
        while done + 4 <= len(data) and done < limit:
            starts.append(done)
            done += 4 + struct.unpack_from("<i", data, done)[0]
        if done <= len(data) or (consumed >= len(raw) and at + len(raw) >= size):
            break
        more = read_bytes(path, at + len(raw), min(size, at + len(raw) + tail))  # the last record runs on
        raw, start, tail, runs_on = raw + more, consumed, 4 * tail, True
    if done > len(data) and starts:
        starts.pop()
    if starts:
        begins, of = (np.array(x, np.int64) for x in zip(*places))
        found = np.array(starts, np.int64)
        block = np.searchsorted(begins, found, side="right") - 1
        yield np.frombuffer(data, np.uint8), found, (of[block] << 16) | (found - begins[block])


#: Records, and bytes of them, that are decoded at a time.
TOGETHER, TOGETHER_BYTES = 5000, 1 << 23


def batches_of(data: np.ndarray, starts: np.ndarray, ordinals: np.ndarray, contigs: pa.Array) -> Iterator[pa.RecordBatch]:
    lo = 0
    while lo < len(starts):
        hi = min(lo + TOGETHER, max(lo + 1, int(np.searchsorted(starts, starts[lo] + TOGETHER_BYTES))))
        last = int(starts[hi]) if hi < len(starts) else len(data)
        first = int(starts[lo])
        yield decoded(data[first:last], starts[lo:hi] - first, ordinals[lo:hi], contigs)
        lo = hi


def contig_names(path: str) -> pa.Array:
    return pa.array([c for c, _ in header(path)[1]], pa.string())


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, lo, hi, size in zip(*(batch.column(c).to_pylist() for c in ("path", "lo", "hi", "size"))):
            for found in located(path, lo, hi, size):
                yield from batches_of(*found, contig_names(path))


def read_bam(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """Reads of BAM files; ordinal is a record's virtual offset, which rises along a file."""
    return ranges(spark, path, range_bytes).mapInArrow(_read, READS)


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """Contigs of a BAM file's header (of several files, the first one's: parts of a file share theirs); nothing else of it is read."""
    contigs = header(files(spark, path)[0][0])[1]
    return spark.createDataFrame([(i, c, n) for i, (c, n) in enumerate(contigs)], CONTIGS)


def header_text(spark: SparkSession, path: str) -> str:
    """The header's text (of several files, the first one's)."""
    return header(files(spark, path)[0][0])[0]


def require_order(spark: SparkSession, path: str, wanted: str) -> None:
    """Raise if the header names another sort order than the wanted one (``unsorted`` among them); warn if it names none."""
    found = sort_order(header(files(spark, path)[0][0])[0])
    if found == "unknown":
        warnings.warn(f"the header of {path} does not say that the reads are sorted by {wanted}", stacklevel=2)
    elif found != wanted:
        raise ValueError(f"the reads are sorted by {found}, not {wanted}")


def tag_bytes(name: str, typed: str) -> bytes:
    """A tag from its name and its type and value as SAM text has them."""
    kind, value = typed[0], typed[2:]
    head = name.encode() + kind.encode()
    if kind in "ZH":
        return head + value.encode() + b"\0"
    if kind == "A":
        return head + value.encode()
    if kind == "B":
        of, *values = value.split(",")
        return head + of.encode() + struct.pack("<i", len(values)) + np.array([float(v) if of == "f" else int(v) for v in values], NUMBERS[of]).tobytes()
    if kind == "f":
        return head + np.float32(value).tobytes()
    number = int(value)
    if kind not in "cCsSiI":
        raise ValueError(f"a tag of type {kind}")
    fits = "i" if number < 1 << 31 else "I"
    return name.encode() + fits.encode() + struct.pack("<" + fits, number)


def ordered_header(text: str, order: str) -> str:
    """A header's text with the given sort order in its first line; the other lines stay."""
    lines = [x for x in text.splitlines() if x and not x.startswith("@HD")]
    old = next((x.split("\t") for x in text.splitlines() if x.startswith("@HD")), ["@HD", "VN:1.6"])
    return "\n".join(["\t".join([*(x for x in old if not x.startswith(("SO:", "GO:", "SS:"))), f"SO:{order}"]), *lines]) + "\n"


def header_bytes(contigs: list[tuple[str, int]], order: str = "unsorted", text: str | None = None) -> bytes:
    """text: of another file's header, whose lines are kept but for the sort order; without it the contigs alone are named."""
    if text is None:
        text = "".join(f"@SQ\tSN:{c}\tLN:{n}\n" for c, n in contigs)
    raw = ordered_header(text, order).encode()
    out = [b"BAM\x01", struct.pack("<i", len(raw)), raw, struct.pack("<i", len(contigs))]
    return b"".join(out + [struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", n) for c, n in contigs])


def record_bytes(r: dict, index: dict[str, int]) -> bytes:
    cigar, seq, name = r["cigar"] or [], r["seq"] or "", r["qname"].encode() + b"\0"
    codes = np.array([BASES.find(b) for b in seq.upper()] + [0] * (len(seq) & 1), np.int16)
    codes = np.where((codes > 15) | (codes < 0), 15, codes).astype(np.uint8)
    packed = ((codes[::2] << 4) | codes[1::2]).tobytes()
    qual = bytes(r["qual"]) if r["qual"] else b"\xff" * len(seq)
    tags = dict(r.get("tags") or {})
    for k, c, kind in (("SA", "sa", "Z"), ("XA", "xa", "Z"), ("NM", "nm", "i"), ("MQ", "mq", "i")):
        if r.get(c) is not None:  # in the place of the one that was read
            tags[k] = f"{kind}:{r[c]}"
    span = sum(c["len"] for c in cigar if CIGAR_OPS[c["op"]] in "MDN=X")
    body = struct.pack(
        "<iiBBHHHiiii", index.get(r["chrom"], -1), r["pos"], len(name), r["mapq"], _bin(r["pos"], r["pos"] + max(1, span)), len(cigar), r["flag"], len(seq), index.get(r["next_chrom"], -1), r["next_pos"], r["tlen"]
    )
    body += name + b"".join(struct.pack("<I", (c["len"] << 4) | c["op"]) for c in cigar) + packed + qual + b"".join(tag_bytes(k, v) for k, v in tags.items())
    return struct.pack("<i", len(body)) + body


def bam_bytes(rows: list[dict], contigs: list[tuple[str, int]], order: str = "unsorted", text: str | None = None) -> bytes:
    """A BAM file of reads."""
    index = {c: i for i, (c, _) in enumerate(contigs)}
    return deflate(header_bytes(contigs, order, text) + b"".join(record_bytes(r, index) for r in rows)) + _END


def _bin(start: int, end: int) -> int:
    """Bin number of the SAM format's index."""
    end -= 1
    for shift, offset in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == end >> shift:
            return offset + (start >> shift)
    return 0


def _written(batches: Iterator[pa.RecordBatch], path: str, contigs: list[tuple[str, int]], order: str, text: str | None) -> Iterator[pa.RecordBatch]:
    """Write a partition to a file of this attempt's own; says where."""
    from pyspark import TaskContext

    index = {c: i for i, (c, _) in enumerate(contigs)}
    part = TaskContext.get().partitionId()
    system, base = opened(path)
    name = f"_attempts/part-{part:05d}-{uuid.uuid4().hex}"
    out, held, rows = None, bytearray(header_bytes(contigs, order, text)), 0
    for batch in batches:
        for row in batch.to_pylist():
            held += record_bytes(row, index)
            rows += 1
            if len(held) >= 64 * _BLOCK:
                out = out or system.open_output_stream(f"{base}/{name}")
                whole = len(held) // _BLOCK * _BLOCK
                out.write(deflate(bytes(held[:whole])))
                del held[:whole]
    if not rows and part:  # the first partition makes a file even without reads
        return
    out = out or system.open_output_stream(f"{base}/{name}")
    out.write(deflate(bytes(held)) + _END)
    out.close()
    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name])], names=["part", "name"])


def write_bam(reads: DataFrame, path: str, contigs: list[tuple[str, int]], order: str = "unsorted", text: str | None = None) -> None:
    """Write path/part-NNNNN.bam, a file a partition; text: of the header that the files continue (read groups, programs, comments).

    Tasks write files of their own, deflated as they go; when all have ended, the driver renames one
    attempt of each partition, so attempts that were lost or ran twice leave nothing behind.
    """
    spark = reads.sparkSession
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = base.getFileSystem(spark._jsc.hadoopConfiguration())
    base = system.makeQualified(base)
    of = lambda name: spark._jvm.org.apache.hadoop.fs.Path(base, name)
    system.mkdirs(of("_attempts"))
    done = reads.mapInArrow(partial(_written, path=base.toString(), contigs=contigs, order=order, text=text), "part int, name string").collect()
    for row in done:
        target = of(f"part-{row.part:05d}.bam")
        system.delete(target, False)
        if not system.rename(of(row.name), target):
            raise OSError(f"could not commit {row.name}")
    system.delete(of("_attempts"), True)
