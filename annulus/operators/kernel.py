"""Realignment of clipped bases inside a mate interval.

The kernel finds the clip in the interval by infix edit distance (free ends in the
interval). Every equally good place is a hit, scored with a position-specific matrix, and
masked; then the next best places follow, until there are enough hits or a score falls under
``LEAST_SCORE``. A batch of clips is aligned at once with numpy, the clips on one axis and 64 bases of a
clip in one word (bit vectors of the table's differences); a clip none of whose parts stands in its
interval (with e edits allowed one of e + 1 parts must) is never aligned. Everything around the Arrow-batched UDF is column expressions.

Bases other than A, C, G, T match nothing and score 0. Of the alignments that end at one
base the one that starts first counts; of the paths of a place, the one with most pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_SCORE = -10.0
#: Cells (clips by interval bases) that are aligned at a time.
CELLS = 1 << 21
_CODES = np.zeros(256, np.int8)
for _k, _b in enumerate(b"ACGT", 1):
    _CODES[_b] = _k
    _CODES[_b + 32] = _k
_MASK = np.int8(9)
_FAR = np.int64(1) << 40


def encode(seq: str) -> np.ndarray:
    return _CODES[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]


def _stacked(rows: list[np.ndarray], fill: int = 0) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(r) for r in rows])
    out = np.full((len(rows), int(size.max(initial=0))), fill, rows[0].dtype if rows else np.int8)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out, size


def infix_ends(queries: np.ndarray, m: np.ndarray, targets: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edits, first start) of the best alignment of each query that ends before each place of its target (0 to its length)."""
    edits = infix_edits(queries, m, targets, n)
    starts = np.zeros(edits.shape, np.int64)
    row, place = np.nonzero(edits < _FAR)
    starts[row, place] = first_starts(queries, m, targets, row, place, edits[row, place])
    return edits, starts


def _peq(queries: np.ndarray) -> np.ndarray:
    """Where each base stands in each query, as bits: rows by code (0 to 4; none for 0) by words of 64 query bases."""
    words = max(1, -(-queries.shape[1] // 64))
    out = np.zeros((len(queries), 5, words), np.uint64)
    for i in range(queries.shape[1]):
        bit = np.uint64(1 << (i % 64))
        for code in range(1, 5):
            out[:, code, i // 64] |= np.where(queries[:, i] == code, bit, np.uint64(0))
    return out


def _edit_rows(peq: np.ndarray, m: np.ndarray, targets: np.ndarray, anchored: bool) -> np.ndarray:
    """Edits of each whole query against its target up to each place (rows by places, 0 first).

    Columns of the edit table are kept as differences between neighbouring cells, in one bit each, 64 query bases to
    a word; a step takes one target base of all rows. anchored: the alignment begins where the target does, not anywhere.
    """
    rows, words = len(peq), peq.shape[2]
    one, top, zero = np.uint64(1), np.uint64(63), np.zeros(rows, np.uint64)
    plus = [np.full(rows, ~np.uint64(0)) for _ in range(words)]
    minus = [zero.copy() for _ in range(words)]
    last_word, last_bit = (np.maximum(m, 1) - 1) // 64, ((np.maximum(m, 1) - 1) % 64).astype(np.uint64)
    ending = [last_word == w for w in range(words)]
    codes = np.where(targets > 4, 0, targets).T.copy()
    out = np.zeros((targets.shape[1] + 1, rows), np.int32)
    out[0] = m
    each, edits = np.arange(rows), m.astype(np.int32)
    for j in range(targets.shape[1]):
        equal = peq[each, codes[j]]
        rises, falls = (np.ones(rows, np.uint64) if anchored else zero), zero
        change = np.zeros(rows, np.int32)
        for w in range(words):
            pv, mv = plus[w], minus[w]
            eq = equal[:, w]
            vertical = eq | mv
            eq = eq | falls
            horizontal = (((eq & pv) + pv) ^ pv) | eq
            up, down = mv | ~(horizontal | pv), pv & horizontal
            step = ((up >> last_bit) & one).astype(np.int32) - ((down >> last_bit) & one).astype(np.int32)
            change += step * ending[w]
            out_up, out_down = up >> top, down >> top
            up, down = (up << one) | rises, (down << one) | falls
            plus[w], minus[w] = down | ~(vertical | up), up & vertical
            rises, falls = out_up, out_down
        edits = edits + change
        out[j + 1] = edits
    # a query without bases has no edits where it may begin anywhere, and one for each base otherwise
    empty = m == 0
    if empty.any():
        out[:, empty] = np.arange(len(out))[:, None] if anchored else 0
    return out.T


def infix_edits(queries: np.ndarray, m: np.ndarray, targets: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Edits of the best alignment of each query that ends before each place of its target (0 to its length).

    Rows are padded to equal lengths; m and n are the true ones.
    """
    edits = _edit_rows(_peq(queries), m, targets, anchored=False).astype(np.int64)
    edits[np.arange(targets.shape[1] + 1) > n[:, None]] = _FAR
    return edits


def first_starts(queries: np.ndarray, m: np.ndarray, targets: np.ndarray, rows: np.ndarray, ends: np.ndarray, edits: np.ndarray) -> np.ndarray:
    """Where the alignment of queries[rows] that ends before place ends with so many edits starts, the first such place.

    The query and the target before the end are read backwards; the farthest place with these edits is the first start.
    """
    out = np.zeros(len(rows), np.int64)
    step = max(1, CELLS // (2 * queries.shape[1] + 2))
    for lo in range(0, len(rows), step):
        r, e, best = rows[lo : lo + step], ends[lo : lo + step], edits[lo : lo + step]
        size = m[r]
        reach = np.minimum(e, size + best)  # longer alignments have more edits
        back = np.arange(queries.shape[1])
        flipped = np.where(back < size[:, None], np.take_along_axis(queries[r], np.clip(size[:, None] - 1 - back, 0, None), axis=1), 0) if queries.shape[1] else queries[r]
        far = np.arange(int(reach.max(initial=0)))
        before = targets[r[:, None], np.clip(e[:, None] - 1 - far, 0, None)]
        found = _edit_rows(_peq(flipped), size, before, anchored=True)
        fits = (found == best[:, None]) & (np.arange(found.shape[1]) <= reach[:, None])
        out[lo : lo + step] = e - (found.shape[1] - 1 - fits[:, ::-1].argmax(axis=1))
    return out


def paths(queries: np.ndarray, m: np.ndarray, regions: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each query base, how it is aligned to its whole region: = X I, or 0 past its end; in the last column the runs of D, as (number, bases).

    Returns codes (rows by query bases) and, stacked behind them, runs and bases of deletions.
    """
    rows, wide, deep = len(queries), regions.shape[1], queries.shape[1]
    table = np.zeros((deep + 1, rows, wide + 1), np.int32)
    table[0] = np.arange(wide + 1)
    known = (regions > 0) & (regions != _MASK)
    place = np.arange(wide + 1)
    for i in range(deep):
        new = table[i] + 1
        np.minimum(new[:, 1:], table[i][:, :-1] + ~((regions == queries[:, i : i + 1]) & known), out=new[:, 1:])
        table[i + 1] = np.minimum.accumulate(new - place, axis=1) + place
    each = np.arange(rows)
    i, j = m.astype(np.int64).copy(), n.astype(np.int64).copy()
    out = np.zeros((rows, deep + 2), np.int32)
    before = np.zeros(rows, np.int8)
    while ((i > 0) | (j > 0)).any():
        up, left = np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        here = table[i, each, j]
        same = (queries[each, up] == regions[each, left]) & known[each, left] if wide else np.zeros(rows, bool)
        diagonal = (i > 0) & (j > 0) & (here == table[up, each, left] + ~same)
        insertion = ~diagonal & (i > 0) & (here == table[up, each, j] + 1)
        deletion = ~diagonal & ~insertion & (j > 0)
        step = np.where(diagonal, np.where(same, ord("="), ord("X")), np.where(insertion, ord("I"), 0))
        rowed = diagonal | insertion
        out[each[rowed], up[rowed]] = step[rowed]
        out[:, -2] += deletion & (before != 1)
        out[:, -1] += deletion
        before = np.where(deletion, 1, np.where(rowed, 0, before)).astype(np.int8)
        i -= rowed
        j -= diagonal | deletion
    return out


def matrix_scores(queries: np.ndarray, errors: np.ndarray, steps: np.ndarray, background: np.ndarray, gap_open: float, gap_extend: float) -> np.ndarray:
    """Log-odds in bits of the aligned bases, less an affine penalty for each gap; background holds shares of A, C, G, T by row."""
    codes = steps[:, :-2]
    share = np.maximum(np.take_along_axis(background, np.maximum(queries, 1) - 1, axis=1), 1e-9)
    likely = np.where(codes == ord("="), 1 - errors, errors / 3)
    odds = np.log2(np.maximum(likely, 1e-12) / share)
    total = np.where(((codes == ord("=")) | (codes == ord("X"))) & (queries > 0), odds, 0.0).sum(axis=1)
    inside = codes == ord("I")
    inserted = inside.sum(axis=1)
    runs = (inside & ~np.concatenate((np.zeros((len(codes), 1), bool), inside[:, :-1]), axis=1)).sum(axis=1)
    runs, bases = runs + steps[:, -2], inserted + steps[:, -1]
    return total - gap_open * runs - gap_extend * (bases - runs)


def posterior(scores: list[float]) -> float:
    """Share of the first hit's score among all, as powers of two; 0 without any."""
    if not scores:
        return 0.0
    top = max(scores)
    return float(np.exp2(scores[0] - top) / np.exp2(np.array(scores) - top).sum())


def could_stand(clip: str, interval: str, edits: int) -> bool:
    """False only if the clip cannot be in the interval with so many edits: then one of edits + 1 parts is there unchanged."""
    cut = [len(clip) * k // (edits + 1) for k in range(edits + 2)]
    return any(clip[a:b] in interval for a, b in zip(cut, cut[1:]))


def _chunks(order: np.ndarray, n: np.ndarray) -> Iterator[np.ndarray]:
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * (n[order[hi]] + 1) <= CELLS:
            hi += 1
        yield order[lo:hi]
        lo = hi


Hit = tuple[int, int, float, int]


def realign_all(clips: list, qualities: list, intervals: list, hits: int, gap_open: float, gap_extend: float, edit_share: float) -> list[list[Hit]]:
    """Hits (start, end inclusive, score, edits) of each clip in its interval, in the order found; none if the best place has too many edits."""
    found: list[list[Hit]] = [[] for _ in clips]
    some = [
        k for k, (c, q, s) in enumerate(zip(clips, qualities, intervals))
        if c and s and q is not None and could_stand(c.upper(), s.upper(), int(len(c) * edit_share))
    ]
    lengths = np.array([len(s) if s else 0 for s in intervals])
    order = np.array(some, np.int64)
    order = order[np.argsort(lengths[order], kind="stable")]
    for chunk in _chunks(order, lengths):
        _realign_chunk(chunk, clips, qualities, intervals, hits, gap_open, gap_extend, edit_share, found)
    return found


def _realign_chunk(chunk, clips, qualities, intervals, hits, gap_open, gap_extend, edit_share, found) -> None:
    queries, m = _stacked([encode(clips[k]) for k in chunk])
    targets, n = _stacked([encode(intervals[k]) for k in chunk])
    errors = _stacked([np.power(10.0, -np.asarray(qualities[k], float)[: len(clips[k])] / 10) for k in chunk], 1)[0]
    background = np.stack([(targets == b).sum(axis=1) for b in (1, 2, 3, 4)], axis=1) / n[:, None]
    active = np.arange(len(chunk))
    first = True
    while len(active):
        edits = infix_edits(queries[active], m[active], targets[active], n[active])
        best = edits.min(axis=1)
        good = best <= m[active] * edit_share if first else np.ones(len(active), bool)
        active, best, edits = active[good], best[good], edits[good]
        ends = edits == best[:, None]
        starts = np.zeros(edits.shape, np.int64)
        row, place = np.nonzero(ends)
        starts[row, place] = first_starts(queries[active], m[active], targets[active], row, place, best[row])
        ends &= starts < np.arange(edits.shape[1])
        good = ends.any(axis=1)
        active, best, ends, starts = active[good], best[good], ends[good], starts[good]
        if not len(active):
            break
        # the path of the first place scores all places of this round, as they have equal edits
        end = ends.argmax(axis=1)
        start = starts[np.arange(len(active)), end]
        steps = np.zeros((len(active), queries.shape[1] + 2), np.int32)
        steps[:, :-2][np.arange(queries.shape[1]) < m[active][:, None]] = ord("=")
        edited = np.flatnonzero(best > 0)
        if len(edited):
            regions, size = _stacked([targets[active[i], start[i] : end[i]] for i in edited])
            steps[edited] = paths(queries[active[edited]], m[active[edited]], regions, size)
        scores = matrix_scores(queries[active], errors[active], steps, background[active], gap_open, gap_extend)
        on = np.zeros(len(active), bool)
        for i, r in enumerate(active):
            own = found[chunk[r]]
            for e in np.flatnonzero(ends[i]):
                s = int(starts[i, e])
                own.append((s, int(e) - 1, float(scores[i]), int(best[i])))
                targets[r, s : e - 1] = _MASK  # the last base stays
            on[i] = len(own) < hits and scores[i] >= LEAST_SCORE
        active, first = active[on], False


_HITS = "struct<hits:array<struct<start:int,end:int,score:double,edits:int>>,probability:double>"


def realign_column(clip: Column, quality: Column, interval: Column, hits: int = 10, gap_open: float = 5.0, gap_extend: float = 1.0, edit_share: float = 0.05) -> Column:
    """Hits of a clip in an interval's sequence, and the first one's posterior; no hits where an argument is null."""

    @F.pandas_udf(_HITS)
    def kernel(clips: pd.Series, qualities: pd.Series, intervals: pd.Series) -> pd.DataFrame:
        rows = realign_all(list(clips), list(qualities), list(intervals), hits, gap_open, gap_extend, edit_share)
        fields = ("start", "end", "score", "edits")
        return pd.DataFrame({"hits": [[dict(zip(fields, h)) for h in r] for r in rows], "probability": [posterior([h[2] for h in r]) for r in rows]})

    return kernel(clip, quality, interval)


def first_hit(result: str = "realigned") -> Column:
    """The first hit; null without any."""
    return F.get(F.col(result)["hits"], F.lit(0))


def accepted(df: DataFrame, result: str = "realigned", least: float = 0.99, edit_share: float = 0.05) -> DataFrame:
    """Rows whose first hit is likely and close enough."""
    r = F.col(result)
    return df.where((F.size(r["hits"]) > 0) & (r["probability"] >= least) & (first_hit(result)["edits"] <= F.length("clip") * edit_share))
