"""Language identification: averaged hashed subword embeddings and a linear softmax.

Subwords are the sequences of 2, 3 and 4 bytes of the lower-cased text, hashed to
``BUCKETS`` rows of an embedding. A text is the mean of its rows; a linear layer and a
softmax over temperature give the languages. The model is trained on the driver with
stochastic gradient descent in numpy, over a bounded sample (``TRAIN_ROWS`` documents, in equal
parts by language, those of least hash); an eighth of it is left out to fit the temperature and the score under which
an answer is rejected. Prediction is one scan: the model's size is fixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annulus.llm.textblocks import seeded

#: Most documents that the model is trained on.
TRAIN_ROWS = 3000
BUCKETS_BITS = 15
BUCKETS = 1 << BUCKETS_BITS
DIMENSIONS = 16
#: Share of right answers, in calibration, that the rejection lets pass.
ACCEPTED = 0.99
UNKNOWN = "und"
_SIZES = (2, 3, 4)
_MULTIPLIERS = (seeded(61, len(_SIZES)) | np.uint64(1)).astype(np.uint32)
_BLOCK = 1 << 20


def subwords(data: np.ndarray) -> list[np.ndarray]:
    """Bucket of the n bytes from each place, for each size n; data ends with three bytes that begin none."""
    wide = data.astype(np.uint32)
    n = len(wide) - 3
    value = wide[:n]
    found = []
    for size, multiplier in zip(_SIZES, _MULTIPLIERS):
        value = (value << np.uint32(8)) | wide[size - 1 : n + size - 1]
        mixed = value * multiplier
        found.append((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BUCKETS_BITS))
    return found


def _padded(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8") + b"   "


@dataclass
class LanguageModel:
    """languages: sorted; table: logits that each bucket adds, before the mean; bias, temperature and the rejection's limit."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    limit: float = 0.0

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities of the languages by text."""
        logits = np.zeros((len(texts), len(self.languages)))
        group: list[bytes] = []
        first, held = 0, 0
        for k, text in enumerate([*texts, None]):
            if group and (k == len(texts) or held > _BLOCK):
                logits[first : first + len(group)] = self._means(group)
                group, first, held = [], k, 0
            if k < len(texts):
                group.append(_padded(text or ""))
                held += len(group[-1])
        scaled = (logits + self.bias) / self.temperature
        scaled = np.exp(scaled - scaled.max(axis=1, keepdims=True))
        return scaled / scaled.sum(axis=1, keepdims=True)

    def _means(self, group: list[bytes]) -> np.ndarray:
        if len(group) == 1 and len(group[0]) > 4 * _BLOCK:
            return self._long_mean(group[0])
        ends = np.cumsum([len(g) for g in group])
        starts = ends - [len(g) for g in group]
        data = np.frombuffer(b"".join(group), dtype=np.uint8)
        idle = np.concatenate([ends[:-1] - 3, ends[:-1] - 2, ends[:-1] - 1])
        total = np.zeros((len(group), self.table.shape[1]))
        for buckets in subwords(data):
            buckets[idle] = BUCKETS
            for j in range(self.table.shape[1]):
                total[:, j] += np.add.reduceat(self.table[:, j][buckets], starts)
        return total / (len(_SIZES) * (ends - starts - 3))[:, None]

    def _long_mean(self, raw: bytes) -> np.ndarray:
        total, n = np.zeros((1, self.table.shape[1])), len(raw) - 3
        for lo in range(0, n, _BLOCK):
            data = np.frombuffer(raw[lo : min(lo + _BLOCK, n) + 3], dtype=np.uint8)
            for buckets in subwords(data):
                total[0] += self.table[:, :][buckets].sum(axis=0, dtype=np.float64)
        return total / (len(_SIZES) * n)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def train_model(bags: list[tuple[np.ndarray, np.ndarray]], languages: list[str], epochs: int = 4, rate: float = 2.0, batch: int = 32) -> LanguageModel:
    """Train on (bucket ids, counts) by document and its language; the order of the data does not matter."""
    names = sorted(set(languages))
    target = np.array([names.index(x) for x in languages])
    rng = np.random.default_rng(7)
    order = rng.permutation(len(bags))
    held, used = order[: len(order) // 8], order[len(order) // 8 :]
    table = (rng.random((BUCKETS + 1, DIMENSIONS)) - 0.5) / DIMENSIONS
    table[BUCKETS] = 0
    out, bias = rng.normal(0, 0.1, (DIMENSIONS, len(names))), np.zeros(len(names))
    share = [counts / counts.sum() for _, counts in bags]
    steps, total = 0, epochs * -(-len(used) // batch)
    for _ in range(epochs):
        rng.shuffle(used)
        for lo in range(0, len(used), batch):
            some = used[lo : lo + batch]
            ids = np.concatenate([bags[i][0] for i in some])
            weight = np.concatenate([share[i] for i in some])
            owner = np.repeat(np.arange(len(some)), [len(bags[i][0]) for i in some])
            begin = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1))
            hidden = np.add.reduceat(table[ids] * weight[:, None], begin, axis=0)
            error = _softmax(hidden @ out + bias)
            error[np.arange(len(some)), target[some]] -= 1
            pace = rate * (1 - steps / total)
            back = error @ out.T
            np.add.at(table, ids, -pace * weight[:, None] * back[owner] * 8)
            out -= pace / len(some) * hidden.T @ error * 8
            bias -= 0.1 * pace / len(some) * error.sum(axis=0)
            steps += 1
    model = LanguageModel(names, (table @ out).astype(np.float32), bias)
    return _calibrated(model, bags, share, target, held if len(held) else used)


def _calibrated(model: LanguageModel, bags: list, share: list, target: np.ndarray, held: np.ndarray) -> LanguageModel:
    """Set the temperature of least loss, and the limit that lets ACCEPTED of the right answers pass."""
    logits = np.array([share[i] @ model.table[bags[i][0]] for i in held]) + model.bias
    losses = {}
    for t in np.geomspace(0.05, 5, 40):
        p = _softmax(logits / t)[np.arange(len(held)), target[held]]
        losses[float(t)] = -np.log(np.maximum(p, 1e-12)).mean()
    model.temperature = min(losses, key=losses.get)
    p = _softmax(logits / model.temperature)
    right = p.argmax(axis=1) == target[held]
    model.limit = float(np.quantile(p.max(axis=1)[right], 1 - ACCEPTED)) if right.any() else 0.0
    return model


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, counts = [], []
        for text in batch.column("text").to_pylist():
            found = np.unique(np.concatenate(subwords(np.frombuffer(_padded(text), dtype=np.uint8))), return_counts=True)
            ids.append(found[0].astype(np.int32))
            counts.append(found[1].astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("lang"), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
            names=["doc_id", "lang", "ids", "counts"],
        )


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 modulo 4: such documents are never trained on."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def quotas(counts: dict[str, int], rows: int) -> dict[str, int]:
    """Rows to take of each language: equal parts; what rare ones leave is shared by the others."""
    out, left = {}, rows
    for k, (name, n) in enumerate(sorted(counts.items(), key=lambda c: (c[1], c[0]))):
        out[name] = min(n, left // (len(counts) - k))
        left -= out[name]
    return out


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> LanguageModel | None:
    """Train on about ``rows`` documents (never more) with text and language that are not held out.

    Each language has an equal part of them, its documents of least hash of doc_id, and what rare ones
    leave goes to the others; of more than ``rows`` languages the commonest count. Several rows of a
    doc_id count as the one of least language and text. Texts without a letter are left out.
    """
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    found = known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).orderBy(F.desc("n"), "lang").limit(rows).collect()
    parts = quotas({r.lang: r.n for r in found}, rows)
    # twice the wanted rows and a few have a hash under the limit, so the sample's size does not grow with the table
    limits = [(r.lang, parts[r.lang], min(1.0, (2 * parts[r.lang] + 50) / max(1, r.n))) for r in found if parts[r.lang]]
    if not limits:
        return None
    wanted = docs.sparkSession.createDataFrame(limits, "lang string, part int, share double")
    low = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < F.col("share") * F.lit(float(1 << 40))
    drawn = known.select("doc_id", "lang", "text").join(F.broadcast(wanted), "lang").where(low)  # at most `rows` languages
    single = drawn.groupBy("doc_id").agg(F.min(F.struct("lang", "text", "part")).alias("one")).select("doc_id", "one.*")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), "doc_id"))
    texts = single.where(F.col("text").rlike("\\p{L}")).withColumn("rank", rank).where("rank <= part")
    got = texts.select("doc_id", "lang", "text").mapInArrow(_bags, "doc_id long, lang string, ids array<int>, counts array<int>").toArrow()
    if not got.num_rows:
        return None
    got = got.sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    as_arrays = lambda c: [np.asarray(x) for x in got.column(c).combine_chunks().to_numpy(zero_copy_only=False)]
    return train_model(list(zip(as_arrays("ids"), as_arrays("counts"))), got.column("lang").to_pylist())


def _predicted(batches: Iterator[pa.RecordBatch], model: LanguageModel | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            part = batch.slice(lo, 1000)
            letters = np.array(part.column("has_letter").to_pylist(), bool)
            if model is None:
                names, score, limit = np.array([UNKNOWN] * part.num_rows), np.zeros(part.num_rows), 0.0
            else:
                p = model.predict(part.column("text").to_pylist())
                names = np.where(letters, np.array(model.languages, dtype=object)[p.argmax(axis=1)], UNKNOWN)
                score, limit = np.where(letters, p.max(axis=1), 0.0), model.limit
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(list(names), pa.string()), pa.array(score), pa.array((score < limit) | (names == UNKNOWN))],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )


def identify_languages(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """Language of each document.

    docs: doc_id long, text and lang strings (lang only to train on); other columns are
    ignored, whatever their names. Returns, for each row, doc_id, held_out, lang_pred (a
    language of the training rows), score (its probability) and rejected (score under the
    calibrated limit, or no language).

    A text that is null or has no letter is ``und`` with score 0, and so is every text when
    there is nothing to train on. Repeated rows give equal rows; a null doc_id stays null and
    is not held out.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = model or train(plain)
    texts = plain.select("doc_id", "text", held_out().alias("held_out"), F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("has_letter"))
    return texts.mapInArrow(partial(_predicted, model=model), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
