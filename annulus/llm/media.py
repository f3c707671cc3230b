"""Texts as media: payload bytes in lossless WebP images, and back to pixel arrays.

A payload is stored as the green samples of images ``ROW`` pixels wide, one byte a pixel.
Very long payloads (over 3.1 MB) take several images, one file behind the other. An image whose rows
mostly repeat the row above is stored with the predictor transform, and one of at most 16
different bytes with the palette transform; in others, lines of ``COPY`` bytes and more that
stood before in the image are back-references.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annulus.llm.webp import MOST_SIDE, Options, WebpError, decode, encode

ROW = 192
OPAQUE = np.uint32(0xFF000000)


def padded(raw: bytes) -> bytes:
    """The bytes with blanks up to a positive multiple of ROW."""
    return raw + b" " * ((-len(raw)) % ROW or (0 if raw else ROW))


#: Bytes from which on a line that comes again is a back-reference, and the most that one reference copies.
COPY, MOST_COPY = 64, 4096


def repeated_lines(raw: bytes) -> list[tuple[int, int, int]]:
    """(place, length, distance) of the lines, with their line feed, that come again; runs of lines at one distance are one copy."""
    seen: dict[bytes, int] = {}
    found: list[tuple[int, int, int]] = []
    at = 0
    for line in raw.splitlines(keepends=True) if b"\n" in raw else ():
        n = len(line)
        if n >= COPY:
            before = seen.setdefault(line, at)
            if before < at:
                if found and found[-1][0] + found[-1][1] == at and found[-1][2] == at - before:
                    found[-1] = (found[-1][0], found[-1][1] + n, at - before)
                else:
                    found.append((at, n, at - before))
        at += n
    return [(place + lo, min(MOST_COPY, n - lo), far) for place, n, far in found for lo in range(0, n, MOST_COPY)]


def to_media(payload: bytes) -> bytes:
    """WebP files that hold a payload of whole rows."""
    files = []
    for lo in range(0, len(payload), ROW * MOST_SIDE):
        samples = np.frombuffer(payload, np.uint8, min(ROW * MOST_SIDE, len(payload) - lo), lo)
        options = Options()
        if (np.bincount(samples, minlength=256) > 0).sum() <= 16:
            options = Options(palette=True)
        elif len(samples) > ROW and (samples[ROW:] == samples[:-ROW]).mean() > 0.5:
            options = Options(modes=np.full(-(-len(samples) // (ROW << 9)), 2), block=9)
        else:
            options = Options(copies=repeated_lines(samples.tobytes()))
        files.append(encode(ROW, len(samples) // ROW, (samples.astype(np.uint32) << np.uint32(8)) | OPAQUE, options))
    return b"".join(files)


def from_media(media: bytes) -> list[np.ndarray]:
    """Pixel arrays (height, width) of ARGB values of the files in media."""
    images, at = [], 0
    while at < len(media):
        if media[at : at + 4] != b"RIFF":
            raise WebpError("no file where one should begin")
        size = 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]
        width, height, pixels = decode(media[at : at + size])
        images.append(pixels.reshape(height, width))
        at += size
    return images


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 200):
            part = batch.slice(lo, 200)
            raw = [(t or "").encode("utf-8") for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array([to_media(padded(r)) for r in raw], pa.binary())],
                names=["doc_id", "n_bytes", "media"],
            )


def encode_media(docs: DataFrame) -> DataFrame:
    """Store each text as media.

    docs: doc_id long and text string; other columns are ignored, whatever their names.
    Returns, for each row, doc_id, n_bytes (of the text) and media. A null text counts as
    empty, and an empty one is a row of blanks. Equal texts give equal media.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _encoded, "doc_id long, n_bytes long, media binary"
    )


def describe(samples: np.ndarray) -> str:
    """Rows, distinct samples, mean sample in thousandths and rows equal to the row above."""
    rows = samples.reshape(-1, ROW)
    counts = np.bincount(samples, minlength=256)
    mean = int(counts @ np.arange(256)) * 1000 // len(samples)
    same = int((rows[1:] == rows[:-1]).all(axis=1).sum())
    return f"rows={len(rows)};distinct={int((counts > 0).sum())};mean={mean};repeats={same}"


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 200):
            part = batch.slice(lo, 200)
            payloads, features = [], []
            for media in part.column("media").to_pylist():
                samples = np.concatenate([((p >> np.uint32(8)) & np.uint32(255)).astype(np.uint8).ravel() for p in from_media(media)])
                payloads.append(samples.tobytes())
                features.append(describe(samples))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(payloads, pa.binary()), pa.array(features, pa.string())], names=[*part.schema.names, "payload", "feature"]
            )


def decode_media(stored: DataFrame) -> DataFrame:
    """Read media back: the columns of ``encode_media`` with payload (the samples of all pixels) and feature."""
    return stored.mapInArrow(_decoded, "doc_id long, n_bytes long, media binary, payload binary, feature string")
