"""Line dedup by a deletion-neighbourhood join.

A line is its sequence of words (A-Z lower-cased). A line goes if an earlier line, by
(doc_id, line number), is equal to it or within one word edit of it (a word replaced,
added or left out), the longer of the two having at least ``MIN_WORDS`` words.
Lines are equal if two independent 61-bit keys over their words are.

1. One scan hashes every line and the first and last halves of longer ones. A partial
   aggregate keeps the earliest place of each distinct line.
2. One edit leaves one half of the words alone, so only lines that share a half with
   another line can have a neighbour; the others leave the join here, which loses none.
3. Every remaining line emits all its variants with one word deleted, as hashed keys.
   Lines with one replaced word agree in a variant with the same gap; a line with a word
   left out is itself a variant of the longer one. Each group of equal variants joins its
   members to its earliest one, never to each other, and each such pair is verified on
   the word sequences.

Hot lines: the aggregates are partial, and the joins are of a kind that Spark splits
when one key is hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annulus.llm.storage import Store, filtered_scans
from annulus.llm.textblocks import SUM_BYTES, hash_words, mix64, seeded, utf8_parts

#: Words from which a line is also compared for one edit: in a shorter line one word is more than an eighth of it,
#: and lines such as headings that differ in a number alone say different things.
MIN_WORDS = 8
_U = np.uint64
#: Keys are polynomials over words in the field of 2**61 - 1 elements: two lines of n words agree for n bases at most.
PRIME = (1 << 61) - 1
_BASES = tuple(int(x) % PRIME for x in seeded(31, 2))
_LENGTHS = seeded(32, 2) | _U(1)
_SIDES = seeded(33, 2)
_KEPT = 1 << 15
_powers: dict[int, np.ndarray] = {}


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME."""
    x = (x & _U(PRIME)) + (x >> _U(61))
    return np.where(x >= _U(PRIME), x - _U(PRIME), x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, for values below it."""
    half, low = _U(31), _U((1 << 31) - 1)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    middle = a1 * b0 + a0 * b1
    return reduced(((a1 * b1) << _U(1)) + (middle >> _U(30)) + ((middle & _U((1 << 30) - 1)) << half) + a0 * b0)


def field_powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo PRIME; at most _KEPT of them stay in memory."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        while len(have) < max(n, 256):
            have = np.concatenate((have, times(have, np.full(len(have), pow(base, len(have), PRIME), np.uint64))))
        if n <= _KEPT:
            _powers[base] = have
    return have[:n]


def _line_sums(words: np.ndarray, begin: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums, over all lines, of word * base**(place in its line); begin: where lines begin, with the end."""
    length = np.diff(begin)
    place = np.arange(len(words)) - np.repeat(begin[:-1], length)
    terms = times(reduced(words), field_powers(base, int(length.max(initial=0)) or 1)[place])
    high, low = (np.concatenate((np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64))) for part in (terms >> _U(31), terms & _U((1 << 31) - 1)))
    return reduced((high >> _U(30)) + ((high & _U((1 << 30) - 1)) << _U(31)) + low)


def _less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a - b modulo PRIME."""
    return np.where(a >= b, a - b, a + _U(PRIME) - b)


def _key(value: np.ndarray, length, which: int = 0) -> np.ndarray:
    return mix64(value ^ (np.asarray(length, np.uint64) * _LENGTHS[which]))


def _keys(words: np.ndarray, begin: np.ndarray, which: int = 0) -> np.ndarray:
    """Key of each line, by the first or second base."""
    sums = _line_sums(words, begin, _BASES[which])
    return _key(_less(sums[begin[1:]], sums[begin[:-1]]), np.diff(begin), which)


def line_key(words: np.ndarray) -> int:
    return int(_keys(words, np.array([0, len(words)]))[0])


def deletion_keys(words: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each word, the key of its line without it."""
    sums, length = _line_sums(words, begin, _BASES[0]), np.diff(begin)
    back = np.full(len(words), pow(_BASES[0], -1, PRIME), np.uint64)
    first, last = (np.repeat(sums[x], length) for x in (begin[:-1], begin[1:]))
    rest = times(_less(last, sums[1:]), back)
    return _key(reduced(_less(sums[:-1], first) + rest), np.repeat(length - 1, length))


def line_tables(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Lines of blocks of whole documents, all hashed at once.

    Yields the first document's index, the block's word hashes, where each line's words
    begin (with the end), each document's first line (with the end), and the lines' keys.
    """
    offsets, data = utf8_parts(batch.column("text"))
    at, n = 0, len(offsets) - 1
    while at < n:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SUM_BYTES, side="right")) - 1)
        raw, lo = data[offsets[at] : offsets[upto]], offsets[at]
        ends = np.flatnonzero(raw == 10) + 1
        bounds = offsets[at : upto + 1] - lo
        # each document begins a line, and so does what follows a line feed
        starts = np.sort(np.concatenate((ends, bounds[:-1])), kind="stable")
        first = np.searchsorted(ends, bounds[:-1], side="right") + np.arange(upto - at)
        words, begin = hash_words(raw, np.append(starts, len(raw)))
        yield at, words, begin, np.append(first, len(starts)), _keys(words, begin)
        at = upto


def _halves(words: np.ndarray, begin: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Half keys of the lines long enough to have neighbours, one line's after another's, and their offsets."""
    sums, length = _line_sums(words, begin, _BASES[0]), np.diff(begin)
    back = field_powers(pow(_BASES[0], -1, PRIME), int(length.max(initial=0)) + 1)
    lo, hi = begin[:-1], begin[1:]
    columns, present = [], []
    for q in (length // 2, np.maximum(length - 1, 0) // 2):
        columns += [_key(_less(sums[lo + q], sums[lo]), q) ^ _SIDES[0], _key(times(_less(sums[hi], sums[hi - q]), back[length - q]), q) ^ _SIDES[1]]
        present += [length >= min_words - 1] * 2
    odd = length % 2 == 1  # then both halves have the same number of words
    present[2], present[3] = present[2] & ~odd, present[3] & ~odd
    chosen = np.stack(present, axis=1)
    return np.stack(columns, axis=1)[chosen], np.concatenate(([0], np.cumsum(chosen.sum(axis=1)))).astype(np.int32)


def _small(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def _places(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document (within the block) and line number of each line."""
    count = np.diff(first)
    return np.repeat(np.arange(len(count)), count), (np.arange(first[-1]) - np.repeat(first[:-1], count)).astype(np.int32)


def _lines(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id").to_numpy()
        for at, words, begin, first, keys in line_tables(batch):
            doc, place = _places(first)
            used = np.diff(begin) > 0
            flat, offsets = _halves(words, begin, min_words)
            halves = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[at + doc]), pa.array(place), pa.array(keys.view(np.int64)), pa.array(_keys(words, begin, 1).view(np.int64)), halves],
                names=["doc_id", "line", "h", "g", "halves"],
            ).filter(pa.array(used))


def _wanted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word sequences of the wanted lines (their keys are in ``wanted``)."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy()
        wanted = batch.column("wanted").to_pylist()
        for at, words, begin, first, keys in line_tables(batch):
            signed, rows, chosen = keys.view(np.int64), [], []
            doc, place = _places(first)
            for d in range(len(first) - 1):
                lo, hi = first[d], first[d + 1]
                found = lo + np.flatnonzero(np.isin(signed[lo:hi], wanted[at + d]))
                found = found[np.sort(np.unique(signed[found], return_index=True)[1])]
                chosen += found.tolist()
                rows += [words[begin[i] : begin[i + 1]] for i in found]
            flat = np.concatenate(rows).view(np.int64) if rows else np.empty(0, np.int64)
            offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            picked = np.array(chosen, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[at + doc[picked]]), pa.array(place[picked]), pa.array(signed[picked]), pa.ListArray.from_arrays(offsets, flat)],
                names=["doc_id", "line", "h", "words"],
            )


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of all deletion variants (gap: the deleted place)."""
    for batch in _small(batches, 2000):
        column = batch.column("words")
        offsets = column.offsets.to_numpy()
        flat = column.values.to_numpy().view(np.uint64)
        sizes = np.diff(offsets)
        if not len(sizes):
            continue
        begin = (offsets - offsets[0]).astype(np.int64)
        keys = deletion_keys(flat[offsets[0] : offsets[-1]], begin)
        gaps = (np.arange(len(keys)) - np.repeat(begin[:-1], sizes)).astype(np.int32)
        repeat = np.repeat(np.arange(batch.num_rows), sizes)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.view(np.int64)), pa.array(gaps)]
            + [batch.column(c).take(pa.array(repeat)) for c in ("doc_id", "line", "h")],
            names=["key", "gap", "doc_id", "line", "h"],
        )


def within_one_edit(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two word sequences are equal or one replaced, added or left-out word apart."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1:
        return False
    differ = np.flatnonzero(x != y[: len(x)])
    if not len(differ):
        return True
    i = int(differ[0])
    return len(differ) == 1 if len(x) == len(y) else bool((x[i:] == y[i + 1 :]).all())


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
        good = [within_one_edit(np.array(a), np.array(b)) for a, b in zip(x, y)]
        yield pa.RecordBatch.from_arrays([batch.column("later_id"), batch.column("later")], names=["doc_id", "h"]).filter(pa.array(good, pa.bool_()))


def _kept(batches: Iterator[pa.RecordBatch], carry: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for batch in _small(batches, 500):
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        winners = batch.column("winners").to_pylist()
        out, n_lines, n_kept = [], [], []
        for at, _, begin, first, keys in line_tables(batch):
            signed, used = keys.view(np.int64), np.diff(begin) > 0
            for d in range(len(first) - 1):
                lo, hi = first[d], first[d + 1]
                own, filled, text = signed[lo:hi], used[lo:hi], texts[at + d]
                keep = np.ones(hi - lo, bool)
                if ids[at + d] is not None:
                    keep = np.isin(own, winners[at + d] or [])
                    keep[np.delete(np.arange(hi - lo), np.unique(own, return_index=True)[1])] = False
                    keep |= ~filled
                n_lines.append(int(filled.sum()))
                n_kept.append(int((keep & filled).sum()))
                if text is None or keep.all():
                    out.append(text)
                else:
                    lines = text.split("\n")
                    out.append("\n".join([lines[i] for i in np.flatnonzero(keep)]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(out, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_kept, pa.int64())]
            + [batch.column(c) for c in carry],
            names=["doc_id", "text", "n_lines", "n_kept", *carry],
        )


def dedup_lines(docs: DataFrame, store: Store | None = None, carry: tuple[str, ...] = (), min_words: int = MIN_WORDS) -> DataFrame:
    """Documents without the lines that repeat an earlier line, exactly or within one word edit.

    docs: doc_id long and text string; other columns are ignored, whatever their names,
    but those in carry are passed on (they may not be called n_lines, n_kept or winners).
    min_words: from how many words on a line is compared for one edit, too (2 or more).
    Returns, for each row, doc_id, text (the lines kept, in order), n_lines and n_kept
    (lines with a word, before and after).

    Lines of white space alone are kept and not counted. A null text stays null and an
    empty one empty, with no lines. Rows of one doc_id are one document: each keeps the
    first copy of the lines that the document may keep. A row without doc_id has no place in
    the order, so it keeps all its lines and takes none from others. Of equal lines in
    one document the first stays. An empty table gives an empty result. A text of any length
    is one row of one task, whose memory grows with it.
    """
    store = store or Store(docs.sparkSession, "lines")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    placed = texts.where("doc_id IS NOT NULL")
    lines = placed.mapInArrow(partial(_lines, min_words=min_words), "doc_id long, line int, h long, g long, halves array<long>")
    # distinct lines are told apart by both keys; from here on a line is known by the document of its first place and h
    first = store.keep(
        lines.groupBy("h", "g")
        .agg(F.min(F.struct("doc_id", "line")).alias("place"), F.first("halves").alias("halves"))
        .select("h", "place.doc_id", "place.line", "halves"),
        "first",
    )
    halves = first.select("h", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select(F.bitwise_not(F.bitwise_not("half")).alias("half"))
    near = halves.join(shared, "half").select("h").distinct()
    wanted = store.keep(
        first.select("h", "doc_id").join(near, "h", "left_semi").groupBy("doc_id").agg(F.collect_list("h").alias("wanted")), "wanted"
    )
    words = (
        placed.join(wanted.where(F.size("wanted") > 0), "doc_id").mapInArrow(_wanted_words, "doc_id long, line int, h long, words array<long>")
        # rows of one doc_id can hold a line at several places
        .groupBy("doc_id", "h").agg(F.min_by(F.struct("line", "words"), "line").alias("place"))
        .select("h", "doc_id", "place.line", "place.words")
    )
    with filtered_scans(docs.sparkSession):  # few documents are wanted, so the others' texts stay where they are
        words = store.keep(words, "words")
    long_enough = words.where(F.size("words") >= min_words)
    variants = long_enough.mapInArrow(_variants, "key long, gap int, doc_id long, line int, h long")
    place = F.struct("doc_id", "line", "h")
    earliest = (
        variants.groupBy("key", "gap")
        .agg(F.min(place).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.bitwise_not(F.bitwise_not("key")).alias("key"), "gap", "first")
    )
    known = lambda later, earlier: [
        later["doc_id"].alias("later_id"), later["h"].alias("later"), earlier["doc_id"].alias("earlier_id"), earlier["h"].alias("earlier")
    ]
    replaced = variants.join(earliest, ["key", "gap"]).select(place.alias("own"), "first").where("own <> first").select(*known(F.col("own"), F.col("first")))
    shorter = words.select(F.col("h").alias("key"), F.struct("doc_id", "line", "h").alias("short"))
    left_out = variants.join(shorter, "key").select(place.alias("long"), "short").where("long <> short")
    left_out = left_out.select(*known(F.greatest("long", "short"), F.least("long", "short")))
    pairs = replaced.union(left_out).distinct()
    dropped = (
        pairs.join(words.select(F.col("doc_id").alias("later_id"), F.col("h").alias("later"), F.col("words").alias("x")), ["later_id", "later"])
        .join(words.select(F.col("doc_id").alias("earlier_id"), F.col("h").alias("earlier"), F.col("words").alias("y")), ["earlier_id", "earlier"])
        .select("later_id", "later", "x", "y")
        .mapInArrow(_verified, "doc_id long, h long")
    )
    winners = first.select("h", "doc_id").join(dropped, ["doc_id", "h"], "left_anti").groupBy("doc_id").agg(F.collect_list("h").alias("winners"))
    wide = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    schema = T.StructType.fromDDL("doc_id long, text string, n_lines long, n_kept long")
    return (
        wide.join(winners, "doc_id", "left")
        .select("doc_id", "text", "winners", *carry)
        .mapInArrow(partial(_kept, carry=carry), T.StructType(schema.fields + wide.schema.fields[2:]))
    )
