"""WARC records and a Merkle audit of their replicas.

Archives are stored record by record, each where its page is read, under a slot number; a layout names the
archive, place and offset of every slot, so records are put in order without moving their bytes. A replica's
records (archive, place, offset, length, digest) are made from its stored bytes. The leaves of an
archive's tree hash each record's digest with its offset range, in order; a node hashes
``FANOUT`` children and covers their range. The audit compares the roots of two replicas and
goes down only below nodes that differ, one level at a time, so a damaged record costs a
few nodes a level, and an intact archive one row. Every level is a DataFrame of ``FANOUT`` times fewer rows.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annulus.llm.storage import Store

ARCHIVE_PAGES = 4096
FANOUT = 16
_HEAD = re.compile(rb"WARC/1\.[01]\r\n(.*?)\r\n\r\n", re.S)


def record_bytes(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC response record of a page; a null address or body is empty."""
    body = F.coalesce(html, F.lit(""))
    text = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )
    return text.cast("binary")


def responses(pages: DataFrame) -> DataFrame:
    """page_id and record of pages (page_id, url and html; other columns are ignored, whatever their names)."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), record_bytes(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))


def with_slots(made: DataFrame) -> DataFrame:
    """``responses`` with a slot, a number no other row has. It depends on how the pages are read, so keep the rows before using it."""
    return made.select(F.monotonically_increasing_id().alias("slot"), "page_id", "record")


def measured(stored: DataFrame) -> DataFrame:
    """Rows with length and digest (SHA-256) of the stored bytes in place of the record."""
    others = [c for c in stored.columns if c not in ("record", "length", "digest")]
    return stored.select(*others, F.length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))


def laid_out(sized: DataFrame) -> DataFrame:
    """Where records lie in archives of ARCHIVE_PAGES ids: rows with archive, place (from 0) and offset.

    sized: page_id, length, digest and what else is to be carried along, which travels through the
    shuffle: leave the bytes out where a slot will do. Records stand in the order of page_id, then digest.
    Repeated rows are records of their own. Pages without page_id
    are dealt out over 65,536 archives, -1 and down, by the first four hex digits of their digest.

    Places are counted along the rows of one page_id and first four hex digits (for pages without
    page_id, the first eight), on top of what lies before them in the archive, so pages of one id do not
    meet in one task unless they are equal.
    """
    lost = -1 - F.conv(F.substring("digest", 1, 4), 16, 10).cast("long")
    made = sized.select(
        F.coalesce(F.floor(F.col("page_id") / ARCHIVE_PAGES), lost).cast("long").alias("archive"),
        F.when(F.col("page_id").isNull(), F.substring("digest", 1, 8)).otherwise(F.substring("digest", 1, 4)).alias("lot"),
        "*",
    )
    # rows are dealt out once, by archive and lot, which serves the windows and the join alike
    dealt = made.repartition("archive", "lot")
    lots = ["archive", "page_id", "lot"]
    within = Window.partitionBy("archive").orderBy("page_id", "lot").rowsBetween(Window.unboundedPreceding, -1)
    sizes = made.groupBy(*lots).agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))
    before = lambda c: F.coalesce(F.sum(c).over(within), F.lit(0))
    base = sizes.select("archive", "lot", F.struct(F.col("page_id").alias("of"), before("n").alias("places"), before("bytes").alias("start")).alias("b"))
    base = base.groupBy("archive", "lot").agg(F.collect_list("b").alias("bases"))  # the ids of an archive that share a lot: 4,096 at most
    along = Window.partitionBy(*lots).orderBy("digest")
    counted = dealt.withColumn("k", F.row_number().over(along) - 1).withColumn("upto", F.sum("length").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    own = F.filter("bases", lambda b: b["of"].eqNullSafe(F.col("page_id")))[0]
    return counted.join(base, ["archive", "lot"]).withColumn("own", own).select(
        "archive",
        (F.col("own.places") + F.col("k")).cast("long").alias("place"),
        (F.col("own.start") + F.col("upto") - F.col("length")).alias("offset"),
        *sized.columns,
    )


def records(pages: DataFrame) -> DataFrame:
    """Records of pages, laid out with their bytes: archive, place, page_id, offset, length, digest and record."""
    made = responses(pages)
    sized = made.select("page_id", F.length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"), "record")
    return laid_out(sized).select("archive", "place", "page_id", "offset", "length", "digest", "record")


def stored_records(stored: DataFrame) -> DataFrame:
    """Records (without their bytes) as they are found in storage: length and digest are those of the stored bytes."""
    return measured(stored.select("archive", "place", "page_id", "offset", "record"))


def replica_records(layout: DataFrame, replica: DataFrame) -> DataFrame:
    """Records of a replica (slot and record) at the places of a layout (slot, archive, place, page_id and offset)."""
    return layout.select("slot", "archive", "place", "page_id", "offset").join(measured(replica.select("slot", "record")), "slot")


def leaves(replica: DataFrame) -> DataFrame:
    """Level 0 of the trees: archive, node, lo, hi (the offset range) and hash."""
    hashed = F.sha2(F.concat_ws(":", F.lit("leaf"), F.col("offset").cast("string"), F.col("length").cast("string"), "digest"), 256)
    return replica.select("archive", F.col("place").alias("node"), F.col("offset").alias("lo"), (F.col("offset") + F.col("length")).alias("hi"), hashed.alias("hash"))


def parents(level: DataFrame) -> DataFrame:
    """The next level: each node hashes its children's hashes, in order, and covers their range."""
    return (
        level.groupBy("archive", F.floor(F.col("node") / FANOUT).alias("node"))
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_sort(F.collect_list(F.struct(F.col("node").alias("k"), "hash"))).alias("below"))
        .select("archive", "node", "lo", "hi", F.sha2(F.concat(F.lit("node:"), F.array_join(F.col("below.hash"), ":")), 256).alias("hash"))
    )


def tree(replica: DataFrame, height: int, store: Store, name: str) -> list[DataFrame]:
    """Levels of the trees, leaves first; after ``height`` steps each archive has one root."""
    levels = [store.keep(leaves(replica), f"{name}-0")]
    for k in range(1, height + 1):
        levels.append(store.keep(parents(levels[-1]), f"{name}-{k}"))
    return levels


def audit(first: DataFrame, second: DataFrame, store: Store | None = None) -> DataFrame:
    """Records in which two replicas differ.

    first and second: archive, place, offset, length and digest (other columns are ignored).
    Returns archive, place, lo, hi (the offset range, of the first replica where it has the
    record) and fault: corrupt (the record or its range differs), missing (not in
    the second) or extra (only in the second). Equal replicas, and empty ones, give no rows.
    """
    store = store or Store(first.sparkSession, "audit")
    plain = [r.select("archive", "place", "offset", "length", "digest") for r in (first, second)]
    last = plain[0].select("place").union(plain[1].select("place")).agg(F.max("place")).first()[0] or 0
    height = 0
    while FANOUT**height <= last:
        height += 1
    one, two = (tree(r, height, store, n) for r, n in zip(plain, ("first", "second")))
    differing = None
    for a, b in zip(reversed(one), reversed(two)):
        if differing is not None:  # only below nodes that differ
            below = differing.select("archive", F.col("node").alias("parent"))
            a, b = (x.withColumn("parent", F.floor(F.col("node") / FANOUT)).join(below, ["archive", "parent"], "left_semi").drop("parent") for x in (a, b))
        x, y = a.select("archive", "node", F.struct("lo", "hi", "hash").alias("x")), b.select("archive", "node", F.struct("lo", "hi", "hash").alias("y"))
        differing = x.join(y, ["archive", "node"], "full").where(~F.col("x.hash").eqNullSafe(F.col("y.hash")))
    return differing.select(
        "archive",
        F.col("node").alias("place"),
        F.coalesce("x.lo", "y.lo").alias("lo"),
        F.coalesce("x.hi", "y.hi").alias("hi"),
        F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").otherwise("corrupt").alias("fault"),
    )


def parse_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, body) of the records of an archive's bytes, plain or gzip by record."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        head = _HEAD.match(data, at)
        if head is None:
            raise ValueError(f"no WARC record at {at}")
        headers = dict(line.split(": ", 1) for line in head[1].decode("utf-8").split("\r\n") if ": " in line)
        end = head.end() + int(headers.get("Content-Length", 0))
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} does not end where it says")
        yield at, end + 4 - at, headers, data[head.end() : end]
        at = end + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files: path, place, offset, length, record_id, uri and body. A file is read whole by one task."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows = [(name, k, o, n, h.get("WARC-Record-ID"), h.get("WARC-Target-URI"), b) for k, (o, n, h, b) in enumerate(parse_records(content))]
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["path", "place", "offset", "length", "record_id", "uri", "body"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parsed, "path string, place long, offset long, length long, record_id string, uri string, body binary")


def archives(made: DataFrame) -> DataFrame:
    """The bytes of each archive: its records one behind the other, and their number. An archive is one row, so it must fit in memory."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "record")))
    joined = F.unhex(F.array_join(F.transform(F.col("r.record"), F.hex), ""))
    return made.groupBy("archive").agg(ordered.alias("r")).select("archive", F.size("r").alias("records"), joined.alias("content"))
