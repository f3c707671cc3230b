"""Packing of tokenised examples into sequences under several limits at once.

Vector bin packing by the dot-product heuristic: a sequence has so much left of each limit
(tokens, segments, loss-bearing tokens), and takes next the example that fits and whose demands,
weighted by how scarce each limit is, have the greatest dot product with what is left. Where no
whole example fits, the one with the greatest product is cut to what is left. Where no further
example can enter a sequence that isn't full, it ends at the last power of two, which
needs no padding, and what stands behind goes back to the pool.

Tasks pack what they read, with no shuffle, a pool of bounded size at a time. What is left of a
task's pool is less than a sequence; those rests meet in a second round, in tasks of
bounded input, and are packed to the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annulus.llm.bpe import broadcast_vocabulary, loaded, slices
from annulus.llm.storage import Store

SEQUENCE_TOKENS = 2048
MAX_SEGMENTS = 256
#: Examples and tokens that make a pool; a longer example is a pool of its own.
POOL_ITEMS = 2048
POOL_TOKENS = 1 << 21
#: Words whose ids a worker holds, some 80 MB.
CACHE_WORDS = 400_000
#: Sequence ids of a task: its number is above these bits, the second round's tasks above all of the first.
TASK_BITS, ROUND = 32, 1 << 60

_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, lead long, loss_tokens long, sequence_id long, offset long"


class Pool:
    """Examples that wait for a place: what each has left, from ``start`` on."""

    def __init__(self, tokens: int, segments: int, loss: int, most: int = POOL_ITEMS):
        self.limits = np.array([tokens, segments, loss], np.float64)
        self.tokens, self.segments, self.loss = tokens, segments, loss
        self.items: list[tuple] = []  # (doc_id, ids, start of ids in the document, tokens of the document, lead)
        self.size, self.most = 0, most

    def add(self, doc_id: int | None, ids: bytes, start: int, doc_tokens: int, lead: int) -> None:
        """lead: tokens of the document, from its beginning, that bear no loss."""
        if ids:
            self.items.append((doc_id, ids, start, doc_tokens, lead))
            self.size += len(ids) // 4

    def full(self) -> bool:
        return len(self.items) >= self.most or self.size >= POOL_TOKENS

    def sequences(self, last: bool) -> Iterator[list[tuple]]:
        """Lists of (item, from, to), ids of items counted from 0. The rest, short of a sequence, stays in the pool unless it is the last."""
        items = self.items
        at = np.zeros(len(items), np.int64)
        end = np.array([len(x[1]) // 4 for x in items], np.int64)
        lead = np.array([max(0, x[4] - x[2]) for x in items], np.int64)  # of an item's ids, those without loss
        while (left := end - at).any():
            bare = np.maximum(lead - at, 0)
            demand = np.stack([left, (left > 0).astype(np.int64), np.maximum(left - bare, 0)]).astype(np.float64) / self.limits[:, None]
            scarce = demand.sum(axis=1)
            chosen, ended = self._sequence(left, bare, demand, scarce / scarce.sum())
            if not ended and not last:
                break
            total = sum(n for _, n in chosen)
            keep = total if total == self.tokens else 1 << (total.bit_length() - 1)
            placed = []
            for i, n in chosen:
                n = min(n, keep)
                if n:
                    placed.append((items[i], int(at[i]), int(at[i]) + n))
                    at[i] += n
                    keep -= n
            yield placed
        rest = [(d, x[4 * a :], s + int(a), t, m) for (d, x, s, t, m), a in zip(items, at) if 4 * a < len(x)]
        self.items, self.size = rest, sum(len(x[1]) for x in rest) // 4

    def _sequence(self, left, bare, demand, weight) -> tuple[list[tuple[int, int]], bool]:
        """(item, ids) of one sequence, and whether it ended at a limit and not for want of examples."""
        tokens, segments, loss = self.tokens, self.segments, self.loss
        waits, chosen = left > 0, []
        whole, bears = left, np.maximum(left - bare, 0)
        while tokens and segments:
            if not waits.any():
                return chosen, False
            product = (weight * np.array([tokens, segments, loss]) / self.limits) @ demand
            fits = waits & (whole <= tokens) & (bears <= loss)
            if fits.any():
                i = int(np.where(fits, product, -1.0).argmax())
                n = int(whole[i])
            else:
                # cut one; nothing of it enters if all its next tokens bear loss and none is left
                room = np.minimum(np.minimum(whole, tokens), bare + loss)
                enters = waits & (room > 0)
                if not enters.any():
                    break
                i = int(np.where(enters, product, -1.0).argmax())
                n = int(room[i])
            chosen.append((i, n))
            waits[i] = False
            tokens, segments, loss = tokens - n, segments - 1, loss - max(0, n - int(bare[i]))
        return chosen, True


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    """rows: (item, from, to, sequence_id, offset)."""
    columns = [[] for _ in range(9)]
    for (doc_id, ids, start, doc_tokens, lead), lo, hi, sequence, offset in rows:
        bears = max(0, start + hi - max(start + lo, lead))
        for c, v in zip(columns, (doc_id, start + lo, hi - lo, ids[4 * lo : 4 * hi], doc_tokens, lead, bears, sequence, offset)):
            c.append(v)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in _PIECES.split(", ")])


def _packed(examples: Iterator[tuple], limits: tuple[int, ...], first: int, last: bool) -> Iterator[pa.RecordBatch]:
    """examples: the arguments of ``Pool.add``. Without last, the rest comes with no sequence_id."""
    pool, sequence = Pool(*limits), first

    def emptied(final: bool) -> Iterator[pa.RecordBatch]:
        nonlocal sequence
        rows: list[tuple] = []
        size = 0
        for placed in pool.sequences(final):
            offset = 0
            for item, lo, hi in placed:
                rows.append((item, lo, hi, sequence, offset))
                offset += hi - lo
            sequence, size = sequence + 1, size + offset
            if size >= POOL_TOKENS:
                yield _pieces(rows)
                rows, size = [], 0
        if rows:
            yield _pieces(rows)

    for example in examples:
        pool.add(*example)
        if pool.full():
            yield from emptied(False)
    yield from emptied(last)
    if pool.items:
        yield _pieces([(x, 0, len(x[1]) // 4, None, None) for x in pool.items])


def _first(of: int) -> int:
    return of + (TaskContext.get().partitionId() << TASK_BITS)


def pack(examples: DataFrame, max_tokens: int = SEQUENCE_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss_tokens: int | None = None, store: Store | None = None, pool_items: int = POOL_ITEMS) -> DataFrame:
    """Place examples in sequences of at most max_tokens, max_segments pieces and max_loss_tokens (None: max_tokens) loss-bearing tokens.

    examples: doc_id long, ids binary (little-endian unsigned 32-bit integers) and lead long: so
    many of its first tokens bear no loss (a prompt; null: none). Examples may be cut anywhere. A sequence has
    max_tokens or a power of two of tokens, so none is padded. Returns a row for each piece:
    doc_id, start (ids of the example before it), length, ids (binary), doc_tokens (of the
    example), lead, loss_tokens, sequence_id and offset (in its sequence, gapless from 0).

    An example without ids, or null ids, has no piece. Repeated rows are examples of their own; a null doc_id
    stays. Limits are at least 1. Which examples meet depends on how the rows are dealt out. Other columns are ignored.
    """
    limits = (int(max_tokens), int(max_segments), int(max_tokens if max_loss_tokens is None else max_loss_tokens), int(pool_items))
    if min(limits) < 1:
        raise ValueError("limits are at least 1")

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("doc_id", "ids", "lead"))))
        yield from _packed(((d, x or b"", 0, len(x or b"") // 4, m or 0) for d, x, m in rows), limits, _first(0), False)

    items = examples.select(F.col("doc_id").cast("long").alias("doc_id"), "ids", F.col("lead").cast("long").alias("lead"))
    return _finished(items.mapInArrow(begin, _PIECES), limits, store or Store(examples.sparkSession, "packing"))


def _finished(pieces: DataFrame, limits: tuple[int, ...], store: Store) -> DataFrame:
    """The second round: what the first has left, from all its tasks."""
    pieces = store.keep(pieces, "pieces")

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("doc_id", "ids", "start", "doc_tokens", "lead")
        yield from _packed((row for b in batches for row in zip(*(b.column(c).to_pylist() for c in names))), limits, _first(ROUND), True)

    rests = pieces.where("sequence_id IS NULL").repartition("doc_id", "start").mapInArrow(end, _PIECES)
    return pieces.where("sequence_id IS NOT NULL").unionByName(rests)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, max_segments: int = MAX_SEGMENTS, store: Store | None = None) -> DataFrame:
    """``pack`` over the ids of each document's text (null: empty) with end_id behind them, encoded and packed in the same task.

    A document's first token has nothing before it, so it bears no loss.
    """
    shipped, limits = broadcast_vocabulary(docs.sparkSession, vocabulary), (SEQUENCE_TOKENS, int(max_segments), SEQUENCE_TOKENS, POOL_ITEMS)
    closing = int(end_id).to_bytes(4, "little")

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(shipped)
        bpe.cache.most = CACHE_WORDS

        def examples() -> Iterator[tuple]:
            for batch in batches:
                for part in slices(batch, rows=512):
                    for doc_id, ids in zip(part.column("doc_id").to_pylist(), bpe.ids(part.column("text").to_pylist())):
                        ids += closing
                        yield doc_id, ids, 0, len(ids) // 4, 1

        yield from _packed(examples(), limits, _first(0), False)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _finished(texts.mapInArrow(begin, _PIECES), limits, store or Store(docs.sparkSession, "packing"))
