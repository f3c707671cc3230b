"""Benchmark decontamination by the q-gram lemma.

Texts and items are compared lower-cased, with ASCII punctuation and white space as single
blanks. Items are cut in windows of ``WINDOW`` characters that overlap by half, and again in
short ones of ``SHORT`` characters every ``STRIDE``, so a verbatim passage of SHORT + STRIDE - 1
characters holds a window wherever in its item it begins; a window may be found with
``EDIT_RATE`` of its length as edits. Short windows are sought where no long one is found. Two strings within e edits share at
least L - q + 1 - e q q-grams, on diagonals at most e apart. So one scan looks up each q-gram
of a text among those of the items, counts hits of an item in overlapping diagonal bands of
2 (e + 1), retains the windows whose count meets the bound, and verifies them by
an alignment restricted to the band, free at both ends of the text region. Items too short for
the bound at ``Q`` take the largest q for which it holds; one under Q characters has no edits and is found
as whole words alone.

The items are the query set: they go to all tasks in blocks of about ``BLOCK_CHARS``
characters (an item is never cut). Each block is searched for in a scan of its own and taken back before the
next is sent, so what tasks hold does not grow with the number of items. Documents are
never shuffled, unless the items need several blocks; then those with passages are joined back.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annulus.llm.storage import Store
from annulus.llm.textblocks import mix64, powers, seeded

Q = 10
WINDOW = 120
SHORT = 60
STRIDE = 10
EDIT_RATE = 0.06
BLOCK_CHARS = 4_000_000
#: Characters of texts that are searched at once.
PIECE = 400_000
#: Stands between texts that are searched together; no character.
SEPARATOR = 0xFFFFFFFE
_U = np.uint64
_BASE = int(seeded(51, 1)[0]) | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BREAKS = "".join(map(chr, range(0x20))) + " !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\x7f"
_TO_SPACE = str.maketrans(_BREAKS, " " * len(_BREAKS))
_TABLE_BITS = 22


def normal(text: str | None) -> np.ndarray:
    """Code points of the normalised text."""
    plain = " ".join((text or "").lower().translate(_TO_SPACE).split())
    return np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def grams(chars: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q-gram at each place."""
    n = len(chars)
    if n < q:
        return np.empty(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix64(chars.astype(np.uint64) + _U(1)) * powers(_BASE, n), out=sums[1:])
    return mix64((sums[q:] - sums[:-q]) * powers(_BASE_INV, n)[: n - q + 1])


def band_alignment(patterns: np.ndarray, lengths: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each pattern (rows, of the given lengths) within its region, and the diagonal at its end.

    Region column i + k is compared with pattern column i on diagonal k; the diagonals
    number regions' width - patterns' width + 1. Start and end in the region are free.
    """
    n, width = patterns.shape
    k = np.arange(regions.shape[1] - width + 1)
    row = np.zeros((n, len(k)), np.int32)
    best, where = np.full(n, np.iinfo(np.int32).max), np.zeros(n, np.int64)
    for i in range(width + 1):
        done = lengths == i
        if done.any():
            best[done], where[done] = row[done].min(axis=1), row[done].argmin(axis=1)
        if i == width:
            break
        step = row + (regions[:, i : i + len(k)] != patterns[:, i : i + 1])
        step[:, :-1] = np.minimum(step[:, :-1], row[:, 1:] + 1)
        row = np.minimum.accumulate(step - k, axis=1) + k
    return best, where


class ItemIndex:
    """Windows and q-grams of benchmark items (id and normalised characters) that take one q."""

    def __init__(self, items: list[tuple[int, np.ndarray]], q: int = Q, window: int = WINDOW, rate: float = EDIT_RATE, short: int = SHORT, stride: int = STRIDE):
        self.q, self.window = q, window
        self.width = int(rate * window) + 1
        self.ids, self.chars, self.windows, self.long = [], [], [], []
        hashes, owners, places = [], [], []
        for item, chars in items:
            n, spans = len(chars), []
            places_of = [(max(0, min(lo + window, n) - window), min(lo + window, n)) for lo in range(0, max(1, n - window // 2), window // 2)]
            self.long.append(len(places_of))
            if n > short:
                places_of += [(lo, lo + short) for lo in (*range(0, n - short, stride), n - short)]
            for lo, hi in places_of:
                edits = int(rate * (hi - lo))
                spans.append((lo, hi, edits, hi - lo - q + 1 - edits * q))
            own = grams(chars, q)
            hashes.append(own)
            owners.append(np.full(len(own), len(self.ids)))
            places.append(np.arange(len(own)))
            self.ids.append(item)
            self.chars.append(chars)
            self.windows.append(spans)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        order = np.argsort(join(hashes, np.uint64), kind="stable")
        self.hashes = join(hashes, np.uint64)[order]
        self.owners, self.places = join(owners, np.int64)[order], join(places, np.int64)[order]
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self.hashes >> _U(64 - _TABLE_BITS)] = True
        self.least = np.array([min(s[3] for s in spans) for spans in self.windows] or [1])
        self.longest = max(map(len, self.chars), default=0)

    def find(self, chars: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(item, its start, its end, start in chars, edits) of each window found in chars."""
        own = grams(chars, self.q)
        at = np.flatnonzero(self.table[own >> _U(64 - _TABLE_BITS)])
        if not len(at):
            return []
        lo, hi = np.searchsorted(self.hashes, own[at], "left"), np.searchsorted(self.hashes, own[at], "right")
        count = hi - lo
        entry = np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        owner, place = self.owners[entry], self.places[entry]
        spot = np.repeat(at, count)
        band = (spot - place + self.longest) // self.width
        span = int(band.max() + 2) if len(band) else 2
        keys, back, hits = np.unique(np.concatenate((owner * span + band, owner * span + band - 1)), return_inverse=True, return_counts=True)
        good = (keys >= 0) & (hits >= self.least[np.clip(keys // span, 0, len(self.least) - 1)])
        found = np.flatnonzero(good)
        if not len(found):
            return []
        order = np.argsort(back, kind="stable")
        begin = np.concatenate(([0], np.cumsum(hits)))
        long, short = [], []
        for g in found:
            item, b = divmod(int(keys[g]), span)
            places = place[order[begin[g] : begin[g + 1]] % len(place)]
            for w, (ws, we, edits, least) in enumerate(self.windows[item]):
                if ((places >= ws) & (places <= we - self.q)).sum() >= least:
                    (long if w < self.long[item] else short).append((item, w, b * self.width - self.longest + ws))
        out = self._verify(chars, long)
        if short:
            seen: dict[int, list] = {}
            for f in out:
                seen.setdefault(f[0], []).append(f)
            # a row's diagonal is one of 2 * width from its band's first
            met = lambda i, w, s: any(
                ws <= self.windows[i][w][0] and self.windows[i][w][1] <= we and abs(at - ws - (s - self.windows[i][w][0])) <= 2 * self.width for _, ws, we, at, _ in seen.get(self.ids[i], ())
            )
            out = sorted(out + self._verify(chars, [r for r in short if not met(*r)]))
        return out

    def _verify(self, chars: np.ndarray, rows: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
        out: dict[tuple[int, int, int], tuple[int, int, int, int, int]] = {}
        diagonals = 2 * self.width
        padded = np.concatenate((np.full(self.longest + diagonals, 0xFFFFFFFF, np.uint32), chars, np.full(self.window + self.longest + 2 * diagonals, 0xFFFFFFFF, np.uint32)))
        shift = self.longest + diagonals
        for part in range(0, len(rows), 2000):
            some = rows[part : part + 2000]
            lengths = np.array([self.windows[i][w][1] - self.windows[i][w][0] for i, w, _ in some])
            patterns = np.zeros((len(some), int(lengths.max())), np.uint32)
            for r, (i, w, _) in enumerate(some):
                patterns[r, : lengths[r]] = self.chars[i][self.windows[i][w][0] : self.windows[i][w][1]]
            starts = np.array([s for _, _, s in some]) + shift
            regions = padded[np.clip(starts[:, None] + np.arange(patterns.shape[1] + diagonals - 1), 0, len(padded) - 1)]
            edits, where = band_alignment(patterns, lengths, regions)
            for r, (i, w, s) in enumerate(some):
                ws, we, most, _ = self.windows[i][w]
                if edits[r] <= most:
                    if we - ws < Q and not self._whole_words(chars, s + int(where[r]), we - ws):
                        continue
                    end = s + int(where[r]) + (we - ws)
                    key = (self.ids[i], ws, end // (2 * self.width))
                    new = (self.ids[i], ws, we, max(0, end - (we - ws)), int(edits[r]))
                    if key not in out or new[4] < out[key][4]:
                        out[key] = new
        return sorted(out.values())

    @staticmethod
    def _whole_words(chars: np.ndarray, lo: int, size: int) -> bool:
        """Whether blanks, separators or ends stand on both sides of the text from lo on."""
        edge = lambda i: not 0 <= i < len(chars) or chars[i] in (0x20, SEPARATOR)
        return edge(lo - 1) and edge(lo + size)


def indexes(items: list[tuple[int, str]], rate: float = EDIT_RATE) -> list[ItemIndex]:
    """Indexes over all items that are not empty when normalised, by the largest q up to Q for which the lemma's bound holds."""
    by_q: dict[int, list[tuple[int, np.ndarray]]] = {}
    for item, text in items:
        chars = normal(text)
        if len(chars):
            by_q.setdefault(min(Q, len(chars) // (int(rate * len(chars)) + 1)), []).append((item, chars))
    return [ItemIndex(own, q, rate=rate) for q, own in sorted(by_q.items())]


_PASSAGE = pa.struct([("item_id", pa.int64()), ("item_start", pa.int32()), ("item_end", pa.int32()), ("text_start", pa.int64()), ("edits", pa.int32())])


def _found(found: list[ItemIndex], column: pa.Array) -> pa.Array:
    """Passages of each text."""
    texts = [normal(t) for t in column.to_pylist()]
    passages: list[list] = [[] for _ in texts]
    for index in found:
        overlap = 2 * (index.longest + index.window)
        group: list[tuple[int, int, np.ndarray]] = []
        held = 0
        for d, chars in enumerate(texts):
            for lo in range(0, max(1, len(chars) - overlap), PIECE):
                piece = chars[lo : lo + PIECE + overlap]
                if held and held + len(piece) > PIECE:
                    _search(index, group, passages)
                    group, held = [], 0
                group.append((d, lo, piece))
                held += len(piece)
        _search(index, group, passages)
    names = [f.name for f in _PASSAGE]
    return pa.array([[dict(zip(names, p)) for p in sorted(set(f))] for f in passages], type=pa.list_(_PASSAGE))


def _small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def _searched(batches: Iterator[pa.RecordBatch], shipped) -> Iterator[pa.RecordBatch]:
    for batch in _small(batches):
        rest = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), _found(shipped.value, batch.column("text"))], names=[*rest, "passages"])


def _search(index: ItemIndex, group: list[tuple[int, int, np.ndarray]], found: list[list]) -> None:
    """Search the pieces joined by separators that no item has."""
    if not group:
        return
    gap = np.full(index.longest + 4 * index.width + index.window, SEPARATOR, np.uint32)
    parts, begin, at = [], [], 0
    for _, _, piece in group:
        begin.append(at)
        parts += [piece, gap]
        at += len(piece) + len(gap)
    begin = np.array(begin)
    for item, ws, we, start, edits in index.find(np.concatenate(parts)):
        g = int(np.searchsorted(begin, start, side="right")) - 1
        d, lo, _ = group[g]
        found[d].append((item, ws, we, int(start - begin[g] + lo), edits))


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[tuple[int, object]]:
    """(number of blocks, broadcast indexes) of the items, a block of about block_chars characters at a time."""
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")
    )
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // block_chars))
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).distinct()
        yield blocks, benchmark.sparkSession.sparkContext.broadcast(indexes(sorted((r.item_id, r.text) for r in own.collect())))


def _unleaked(batches: Iterator[pa.RecordBatch], shipped) -> Iterator[pa.RecordBatch]:
    for batch in _small(batches):
        yield batch.filter(pc.equal(pc.list_value_length(_found(shipped.value, batch.column("text"))), 0))


def drop_leaked(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS, store: Store | None = None) -> DataFrame:
    """The rows of docs, with all their columns, in which ``find_leaks`` finds nothing."""
    store = store or Store(docs.sparkSession, "unleaked")
    for block, (blocks, shipped) in enumerate(_blocks(benchmark, block_chars)):
        docs = docs.mapInArrow(partial(_unleaked, shipped=shipped), docs.schema)
        if blocks > 1:
            docs = store.keep(docs, f"after-{block}")
            shipped.destroy()
            if block:
                store.drop(f"after-{block - 1}")
    return docs


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS, store: Store | None = None) -> DataFrame:
    """Benchmark passages in documents.

    docs: doc_id long and text string; benchmark: item_id long and text string; other
    columns are ignored, whatever their names. Returns, for each row of docs, doc_id and
    passages (array of item_id, item_start, item_end, text_start, edits; places count
    characters of the normalised texts), empty where nothing is found. Each passage is a window of its item.

    Null and empty texts hold no passages. Items that are null or, normalised, empty are not
    searched for; one under Q characters is found as whole words and exactly. Repeated items with one id count
    once. Repeated rows give equal rows; a null doc_id stays null. Without items every document is
    clean. The number of blocks does not change the result.
    """
    store = store or Store(docs.sparkSession, "leaks")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    passages = "passages array<struct<item_id:long,item_start:int,item_end:int,text_start:long,edits:int>>"
    # equal texts hold equal passages, so with several blocks a text's digest is the key of what is found in it
    keyed = texts.select(F.sha2("text", 256).alias("key"), "text")
    parts = []
    for block, (blocks, shipped) in enumerate(_blocks(benchmark, block_chars)):
        if blocks == 1:
            return texts.mapInArrow(partial(_searched, shipped=shipped), f"doc_id long, {passages}")
        found = keyed.where("text IS NOT NULL").mapInArrow(partial(_searched, shipped=shipped), f"key string, {passages}").where(F.size("passages") > 0)
        parts.append(store.keep(found.distinct(), f"block-{block}"))
        shipped.destroy()
    every = reduce(DataFrame.union, parts)
    merged = every.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("passages")))).alias("found"))
    rows = texts.select("doc_id", F.sha2("text", 256).alias("key"))
    return rows.join(merged, "key", "left").select("doc_id", F.coalesce("found", F.array().cast(merged.schema["found"].dataType)).alias("passages"))
