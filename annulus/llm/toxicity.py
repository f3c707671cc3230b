"""Toxicity: cumulative-link ordinal regression over sparse text features.

A document's features are the hashed words in it and the hashed beginnings of its
words, each counted once. With shared weights w and ordered thresholds t,
P(grade <= k) = sigmoid(t_k - w.x); the output is the expected severity.

The model is fitted on the driver over a bounded sample of labelled documents
(``TRAIN_ROWS`` toxic ones and twice as many others, those of least hash), over the
features whose share differs beyond chance between the two; everything else is one scan.
Labels say toxic or not. The grade of a toxic document is how many distinct toxic cues
it holds, in thirds over the sample; grade 0 is not toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annulus.llm.storage import Store
from annulus.llm.textblocks import SPACE, SUM_BYTES, mix64, powers, seeded

#: Most toxic documents that the model is fitted on, and twice as many others.
TRAIN_ROWS = 3000
#: Grades: 0 and three of severity.
GRADES = 4
BITS = 20
#: Byte lengths of the word beginnings that count as features.
BEGINNINGS = (4, 5, 6)
#: Likelihood-ratio statistic that a feature needs, and the log-odds that make it a cue.
LEAST_RATIO, CUE_ODDS = 22.0, 2.5
_U = np.uint64
_BYTES = seeded(41, 256)
_BASE = int(seeded(42, 1)[0]) | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_KINDS = seeded(43, 1 + len(BEGINNINGS))
_BREAKS = bytes(range(0x20)) + b" !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\x7f"
_TO_SPACE = bytes.maketrans(_BREAKS, b" " * len(_BREAKS))


def text_features(text: str | None) -> np.ndarray:
    """Distinct feature ids, below 2**BITS, of a text."""
    found = []
    raw = (text or "").lower().encode("utf-8").translate(_TO_SPACE)
    lo = 0
    while lo < len(raw):
        hi = lo + SUM_BYTES
        hi = len(raw) if hi >= len(raw) else (raw.find(b" ", hi) if raw.find(b" ", hi) >= 0 else len(raw))
        found.append(_piece_features(np.frombuffer(raw, np.uint8, hi - lo, lo)))
        lo = hi
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def _piece_features(data: np.ndarray) -> np.ndarray:
    n, word = len(data), ~SPACE[data]
    edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * powers(_BASE, n), out=sums[1:])
    back = powers(_BASE_INV, n)[starts]
    parts = [mix64((sums[ends] - sums[starts]) * back ^ _KINDS[0])]
    for kind, size in zip(_KINDS[1:], BEGINNINGS):
        longer = ends - starts > size
        parts.append(mix64((sums[starts[longer] + size] - sums[starts[longer]]) * back[longer] ^ kind))
    return np.unique(np.concatenate(parts) >> _U(64 - BITS)).astype(np.int64)


@dataclass
class OrdinalModel:
    """weights: of the features kept, by id; cuts: the ordered thresholds."""

    ids: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def grades(self, scores: np.ndarray) -> np.ndarray:
        """P(grade = k) for each score, by row."""
        below = 1 / (1 + np.exp(-np.clip(self.cuts[None, :] - scores[:, None], -40, 40)))
        edges = np.concatenate((np.zeros((len(scores), 1)), below, np.ones((len(scores), 1))), axis=1)
        return np.diff(edges, axis=1)


def cuts_of(raw: np.ndarray) -> np.ndarray:
    """Ordered thresholds: the first, and steps made positive."""
    return np.cumsum(np.concatenate((raw[:1], np.log1p(np.exp(raw[1:])))))


def likelihood(w: np.ndarray, raw: np.ndarray, rows: np.ndarray, cols: np.ndarray, grade: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log-likelihood of weighted rows, and its gradients by the shared weights and the raw thresholds.

    rows and cols: where the sparse features are 1.
    """
    cuts = cuts_of(raw)
    score = np.bincount(rows, weights=w[cols], minlength=len(grade))
    below = 1 / (1 + np.exp(-np.clip(cuts[None, :] - score[:, None], -40, 40)))
    edges = np.concatenate((np.zeros((len(score), 1)), below, np.ones((len(score), 1))), axis=1)
    each = np.arange(len(grade))
    p = np.maximum(edges[each, grade + 1] - edges[each, grade], 1e-9)
    k = np.arange(len(cuts))
    d_cut = ((k[None, :] == grade[:, None] - 1) * 1.0 - (k[None, :] == grade[:, None])) * below * (1 - below) / p[:, None] * weight[:, None]
    later = np.cumsum(d_cut.sum(axis=0)[::-1])[::-1]
    g_raw = np.concatenate((later[:1], later[1:] / (1 + np.exp(-raw[1:]))))
    g_w = np.bincount(cols, weights=-d_cut.sum(axis=1)[rows], minlength=len(w))
    return float(-(weight * np.log(p)).sum()), g_w, g_raw


def choose(bad: np.ndarray, good: np.ndarray, n_bad: int, n_good: int) -> tuple[np.ndarray, np.ndarray]:
    """Features (ids, in order) whose share differs beyond chance, and which of them are cues; bad and good: documents with each."""
    odds = np.log((bad + 0.5) / (n_bad + 1)) - np.log((good + 0.5) / (n_good + 1))
    share = (bad + good) / (n_bad + n_good)
    ratio = np.zeros(len(bad))
    for part, expected in (
        (bad, share * n_bad),
        (good, share * n_good),
        (n_bad - bad, (1 - share) * n_bad),
        (n_good - good, (1 - share) * n_good),
    ):
        ratio += 2 * part * np.log(np.where(part > 0, part / np.maximum(expected, 1e-12), 1))
    chosen = np.flatnonzero(ratio > LEAST_RATIO)
    return chosen, odds[chosen] > CUE_ODDS


def fit(
    features: list[np.ndarray], toxic: np.ndarray, picked: tuple[np.ndarray, np.ndarray] | None = None, steps: int = 400, rate: float = 0.05, decay: float = 2e-4
) -> OrdinalModel:
    """Fit by Adam on the negative log-likelihood with an L1 proximal step; picked: features and cues, if they are chosen already."""
    toxic = np.asarray(toxic, bool)
    if not len(toxic) or toxic.all() or not toxic.any():
        far = 40.0 if not toxic.any() else -40.0
        return OrdinalModel(np.empty(0, np.int64), np.empty(0), far + np.arange(GRADES - 1.0))
    rows = np.repeat(np.arange(len(features)), [len(f) for f in features])
    ids = np.concatenate(features)
    size = 1 << BITS
    n_bad, n_good = int(toxic.sum()), int((~toxic).sum())
    if picked is None:
        picked = choose(np.bincount(ids[toxic[rows]], minlength=size), np.bincount(ids[~toxic[rows]], minlength=size), n_bad, n_good)
    chosen, cues_of = picked
    place = np.full(size, -1)
    place[chosen] = np.arange(len(chosen))
    cue = np.zeros(size, bool)
    cue[chosen] = cues_of
    cues = np.bincount(rows[cue[ids]], minlength=len(features))
    limits = np.quantile(cues[toxic], [(g / (GRADES - 1)) for g in range(1, GRADES - 1)])
    grade = np.where(toxic, 1 + (cues[:, None] > limits[None, :]).sum(axis=1), 0)
    inside = place[ids] >= 0
    rows, cols = rows[inside], place[ids[inside]]
    w, raw = np.zeros(len(chosen)), np.concatenate(([1.0], np.full(GRADES - 2, 0.5)))
    m1, m2 = np.zeros(len(w) + len(raw)), np.zeros(len(w) + len(raw))
    weight = np.where(toxic, 0.5 / n_bad, 0.5 / n_good)
    for step in range(1, steps + 1):
        g = np.concatenate(likelihood(w, raw, rows, cols, grade, weight)[1:])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        move = rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        w, raw = w - move[: len(w)], raw - move[len(w) :]
        w = np.sign(w) * np.maximum(np.abs(w) - rate * decay, 0)
    cuts = cuts_of(raw)
    used = np.abs(w) > 1e-6
    return OrdinalModel(chosen[used], w[used], cuts)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [text_features(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("toxic"), pa.array([r.astype(np.int32) for r in rows], type=pa.list_(pa.int32()))], names=["toxic", "ids"]
        )


def _chosen_rows(batches: Iterator[pa.RecordBatch], chosen: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        offsets, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
        inside = np.concatenate(([0], np.cumsum(np.isin(flat, chosen))))
        kept = pa.array(flat[np.diff(inside).astype(bool)], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.ListArray.from_arrays(pa.array(inside[offsets] - inside[offsets[0]], pa.int32()), kept.slice(int(inside[offsets[0]])))], names=["toxic", "ids"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, store: Store | None = None) -> OrdinalModel:
    """Fit on at most ``rows`` toxic documents and twice as many others, those of least hash of doc_id.

    Several labels of a document count as the worst of them; nulls are left out. Rows of one doc_id are one
    document, with the least of their texts, so the sample is never larger than said. Features are counted by
    Spark; the driver gets two numbers for each feature (2**BITS at most) and then, of each document, the
    chosen features alone, so what it gets does not grow with the texts' lengths.
    """
    store = store or Store(docs.sparkSession, "toxicity")
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    sample = known.where("toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = sample.union(known.where("NOT toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the sample has 3 * rows rows at most, so it is broadcast; of several texts of a document the least one is taken
    one = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    found = store.keep(one.select("toxic", "text").mapInArrow(_feature_rows, "toxic boolean, ids array<int>"), "features")
    counts = found.select("toxic", F.explode("ids").alias("id")).groupBy("id").agg(F.sum(F.col("toxic").cast("long")).alias("bad"), F.count("*").alias("n")).toArrow()
    bad, both = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    ids = counts.column("id").to_numpy()
    bad[ids], both[ids] = counts.column("bad").to_numpy(), counts.column("n").to_numpy()
    n_bad, n = found.agg(F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0)), F.count("*")).first()
    picked = choose(bad, both - bad, n_bad, n - n_bad) if 0 < n_bad < n else (np.empty(0, np.int64), np.empty(0, bool))
    got = found.mapInArrow(partial(_chosen_rows, chosen=picked[0]), "toxic boolean, ids array<int>").toArrow()
    own = [np.asarray(x, dtype=np.int64) for x in got.column("ids").combine_chunks().to_numpy(zero_copy_only=False)]
    model = fit(own, got.column("toxic").to_numpy(), picked=picked)
    store.close()
    return model


def _scored(batches: Iterator[pa.RecordBatch], model: OrdinalModel) -> Iterator[pa.RecordBatch]:
    weights = np.zeros(1 << BITS)
    weights[model.ids] = model.weights
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            scores = np.array([weights[text_features(t)].sum() for t in part.column("text").to_pylist()])
            grades = model.grades(scores)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(grades @ np.arange(GRADES)),
                    pa.array(1 - grades[:, 0]),
                    pa.array(grades.argmax(axis=1).astype(np.int32)),
                    pa.array(grades[:, 0] < 0.5),
                ],
                names=["doc_id", "severity", "p_toxic", "grade", "toxic"],
            )


def grade_toxicity(docs: DataFrame, labels: DataFrame, model: OrdinalModel | None = None) -> DataFrame:
    """Expected severity of each document.

    docs: doc_id long and text string; labels: doc_id and toxic (0 or 1); other columns
    are ignored, whatever their names. Returns, for each row of docs, doc_id, severity
    (expected grade, 0 to GRADES - 1), p_toxic, grade (the likeliest) and toxic (p_toxic over 0.5).

    A null or empty text has no features, and so the severity of the thresholds alone.
    Repeated rows give equal rows; a null doc_id stays null. Without labels of both
    kinds every document gets the one kind there is (grade 0 if there is none).
    """
    model = model or train(docs, labels)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(partial(_scored, model=model), "doc_id long, severity double, p_toxic double, grade int, toxic boolean")


def _clean_rows(batches: Iterator[pa.RecordBatch], model: OrdinalModel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pa.RecordBatch.from_arrays([batch.column("text")] * 2, names=["doc_id", "text"])
        for k, graded in enumerate(_scored([texts], model)):
            yield batch.slice(500 * k, 500).filter(pc.invert(graded.column("toxic")))


def drop_toxic(docs: DataFrame, labels: DataFrame, model: OrdinalModel | None = None) -> DataFrame:
    """The rows of docs, with all their columns, that ``grade_toxicity`` does not call toxic."""
    model = model or train(docs, labels)
    return docs.mapInArrow(partial(_clean_rows, model=model), docs.schema)
