"""BPE encoding and decoding of whole texts with a given vocabulary file.

The file is in the format of the ``tokenizers`` library: BPE with an end-of-word
suffix over byte-level characters, NFC, white space collapsed, lower case, words split
by a pattern. The vocabulary is given, never trained; its path is a parameter.

A short word is merged over two contiguous arrays, its parts and the ranks of adjacent
parts: scan for the least rank, delete that boundary, refresh the two neighbouring
ranks. A word of over ``SHORT`` parts takes a heap over a linked list, with equal
results, so that a long run of letters costs n log n. What stands between white space is
encoded once per worker while it stays in a bounded cache; what a batch of texts has anew is
merged at once: words of one length are rows of an array, and so are their ranks, each of which
loses its least boundary in each turn.
"""

from __future__ import annotations

import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHORT = 128
CACHE_WORDS = 60_000
NO_RANK = 1 << 60
#: White space of the file's normaliser: Unicode White_Space.
_SPACE = regex.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Letters and numbers of Unicode 17.0, which the library's Unicode 16.0 does not know as such.
_NEWER = regex.compile(
    "[\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    "\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    "\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    "\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f]"
)
#: First byte in UTF-8 of U+0380 and what follows: texts of lower ones alone need none of these values.
_LEAD = 0xCE
_SEPARATORS = regex.compile("[\x1c-\x1f]")
#: Combining marks that the library's normaliser, of an older Unicode, neither orders nor composes.
_APART = regex.compile(
    "([\u07fd\u0898-\u089f\u08ca-\u08d3\u09fe\u0c3c\u0d3b\u0d3c\u0eba\u1715\u1abf-\u1ace\u1df6-\u1dfa\ua82c\U00010d24-\U00010d27"
    "\U00010eab\U00010eac\U00010efd-\U00010eff\U00010f46-\U00010f50\U00010f82-\U00010f85\U00011070\U0001133b\U0001145e\U00011839"
    "\U0001183a\U00011930\U0001193d\U0001193e\U00011943\U000119e0\U00011a34\U00011a47\U00011a99\U00011d42\U00011d44\U00011d45"
    "\U00011d97\U00011f41\U00011f42\U00016ff0\U00016ff1\U0001e08f\U0001e130-\U0001e136\U0001e2ae\U0001e2ec-\U0001e2ef\U0001e4ec-\U0001e4ef])"
)
#: Lower case of Unicode 16.0 and 17.0, which the library knows and Python's tables may not.
_LOWER = {
    0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}
_LOWERED = regex.compile("[" + "".join(map(chr, _LOWER)) + "]")
#: Bytes of a word that is merged with others of its length, slots of the table of ranks, and text bytes of a batch.
TOGETHER = 48
SLOTS = 1 << 19
BATCH_BYTES = 1 << 22


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, source: str | bytes):
        spec = json.loads(source)
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or model.get("byte_fallback"):
            raise ValueError("not a lower-casing byte-level BPE vocabulary with word ends")
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"]
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.lines = regex.compile(self.pattern.pattern + "|\n")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.strings = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.inner = [vocab[c] for c in byte_characters()]
        self.last = [vocab[c + self.suffix] for c in byte_characters()]
        self.rank: list[dict[int, int]] = [{} for _ in range(max(self.strings) + 1)]
        self.merged: list[int] = []
        for rank, (a, b) in enumerate(model["merges"]):
            self.rank[vocab[a]][vocab[b]] = rank
            self.merged.append(vocab[a + b])
        self.cache = _Cache(self)
        self._arrays: tuple | None = None

    def _tables(self) -> tuple:
        """Arrays for many words at once: first ids by byte, within a word and at its end; merged ids; a hash table from pair to rank."""
        if self._arrays is None:
            pairs = [(a << 32 | b, rank) for a, of in enumerate(self.rank) for b, rank in of.items()]
            keys, ranks = np.full(SLOTS, -1, np.int64), np.full(SLOTS, len(self.merged), np.int32)
            for pair, rank in pairs:
                slot = int(_slots(np.array([pair], np.int64))[0])
                while keys[slot] >= 0:
                    slot = (slot + 1) % SLOTS
                keys[slot], ranks[slot] = pair, rank
            self._arrays = (np.array(self.inner, np.int32), np.array(self.last, np.int32), np.array(self.merged, np.int32), keys, ranks)
        return self._arrays

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; the number of merges if there is none."""
        _, _, merged, keys, ranks = self._tables()
        pair = a.astype(np.int64) << 32 | b
        slot = _slots(pair)
        at = keys[slot]
        out = np.where(at == pair, ranks[slot], np.int32(len(merged)))
        open_ = np.flatnonzero((at != pair) & (at >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % SLOTS
            at = keys[slot[open_]]
            out[open_] = np.where(at == pair[open_], ranks[slot[open_]], len(merged))
            open_ = open_[(at != pair[open_]) & (at >= 0)]
        return out

    def _merged_rows(self, parts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, their ids) of words of one length, as rows of parts."""
        merged = self._tables()[2]
        n, width = parts.shape
        rows = np.arange(n)
        if width < 2:
            yield rows, parts
            return
        ranks = self._ranks(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(n, width - 1)
        while len(rows):
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(rows)), at]
            ended = least == len(merged)
            if ended.any():
                yield rows[ended], parts[ended]
                go = ~ended
                rows, parts, ranks, at, least = rows[go], parts[go], ranks[go], at[go], least[go]
                if not len(rows):
                    return
            each = np.arange(len(rows))
            new = merged[least]
            parts[each, at] = new
            width = parts.shape[1] - 1
            parts = parts[np.arange(width + 1) != at[:, None] + 1].reshape(-1, width)
            if width < 2:
                yield rows, parts
                return
            ranks = ranks[np.arange(width) != at[:, None]].reshape(-1, width - 1)
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < width - 1)
            ranks[left, at[left] - 1] = self._ranks(parts[left, at[left] - 1], new[left])
            ranks[right, at[right]] = self._ranks(new[right], parts[right, at[right] + 1])

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokenised words, one behind the other, and where each word's begin (one more value than words)."""
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        text = "".join(words)
        data = np.frombuffer(text.encode("utf-8"), np.uint8)
        if not text.isascii():  # from characters to bytes
            ends = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))[ends]
        sizes = np.diff(ends, prepend=0)
        inner, last = self._tables()[:2]
        parts = inner[data]
        parts[ends - 1] = last[data[ends - 1]]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for size in np.unique(sizes):
            of = np.flatnonzero(sizes == size)
            if size <= TOGETHER:
                found += [(of[rows], ids) for rows, ids in self._merged_rows(parts[(ends[of] - size)[:, None] + np.arange(size)])]
            else:
                found += [(of[i : i + 1], np.array([self.word(words[k])], np.int32)) for i, k in enumerate(of)]
        counts = np.zeros(len(words), np.int64)
        for rows, ids in found:
            counts[rows] = ids.shape[1]
        begin = np.append(0, np.cumsum(counts))
        out = np.empty(begin[-1], np.uint32)
        for rows, ids in found:
            out[begin[rows][:, None] + np.arange(ids.shape[1])] = ids
        return out, begin

    def word(self, word: str) -> list[int]:
        """Ids of one pre-tokenised word."""
        raw = word.encode("utf-8")
        parts = [self.inner[b] for b in raw]
        parts[-1] = self.last[raw[-1]]
        return self._scan(parts) if len(parts) <= SHORT else self._heap(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        rank, merged = self.rank, self.merged
        ranks = [rank[a].get(b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            parts[i] = new = merged[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank[parts[i - 1]].get(new, NO_RANK)
            if i < len(ranks):
                ranks[i] = rank[new].get(parts[i + 1], NO_RANK)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        rank, n = self.rank, len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(rank[parts[i]][parts[i + 1]], i, (parts[i], parts[i + 1])) for i in range(n - 1) if parts[i + 1] in rank[parts[i]]]
        heapq.heapify(heap)
        while heap:
            least, i, pair = heapq.heappop(heap)
            j = after[i]
            if j < 0 or (parts[i], parts[j]) != pair:
                continue
            parts[i], parts[j], after[i] = self.merged[least], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            after[j] = -1
            for k in (before[i], i):
                if k >= 0 and (j := after[k]) >= 0 and parts[j] in rank[parts[k]]:
                    heapq.heappush(heap, (rank[parts[k]][parts[j]], k, (parts[k], parts[j])))
        return [p for p in parts if p >= 0]

    def split(self, chunks: list[str]) -> tuple[list[str], np.ndarray]:
        """Words of texts without white space, one text behind the other, and where each text's begin (one more value)."""
        # a line break ends each text, and no word crosses it
        lowered = "\n".join(chunks) + "\n"
        early = lowered.isascii() or np.frombuffer(lowered.encode("utf-8"), np.uint8).max() < _LEAD
        if not early:
            # no final sigma: characters are lowered one by one
            lowered = "".join([unicodedata.normalize("NFC", part) for part in _APART.split(lowered)]).replace("\u03a3", "\u03c3")
            lowered = _LOWERED.sub(lambda m: chr(_LOWER[ord(m[0])]), lowered)
        elif not lowered.isascii():
            lowered = unicodedata.normalize("NFC", lowered)
        lowered = lowered.lower()
        # letters that the library does not know as such are no letters
        seen = lowered if early else _NEWER.sub("\x01", lowered)
        words = self.lines.findall(seen) if seen == lowered else [lowered[m.start() : m.end()] for m in self.lines.finditer(seen)]
        ends = np.array([i for i, w in enumerate(words) if w == "\n"])
        return [w for w in words if w != "\n"], np.append(0, ends - np.arange(len(ends)))

    def _parts(self, text: str | None) -> list[list[str] | str]:
        """Lists of what stands between white space, and special tokens between them."""
        if not text:
            return []
        if self.specials is None or "<" not in text:
            return [self._chunks(text)]
        return [segment if k % 2 else self._chunks(segment) for k, segment in enumerate(self.specials.split(text)) if segment]

    def _held(self, texts: list[str | None]) -> list[list[list[str] | str]]:
        parts = [self._parts(t) for t in texts]
        chunks: set[str] = set()
        for p in (p for of in parts for p in of if isinstance(p, list)):
            chunks.update(p)
        self.cache.hold(chunks)
        return parts

    def _ids(self, parts: list[list[str] | str]) -> bytes:
        get = self.cache.ids.__getitem__
        return b"".join([struct.pack("<I", self.special[p]) if isinstance(p, str) else b"".join(map(get, p)) for p in parts])

    def _strings(self, parts: list[list[str] | str]) -> str:
        get = self.cache.string
        return " ".join([x for p in parts for x in ([p] if isinstance(p, str) else filter(None, map(get, p)))])

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        return [self._ids(parts) for parts in self._held(texts)]

    def encoded(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """For each text its ids, as ``ids`` gives them, and the decoded text."""
        return [(self._ids(parts), self._strings(parts)) for parts in self._held(texts)]

    def encode(self, text: str | None) -> tuple[bytes, str]:
        return self.encoded([text])[0]

    def _chunks(self, text: str) -> list[str]:
        if _SEPARATORS.search(text):
            return [c for c in _SPACE.split(text) if c]
        return text.split()

    def decode(self, ids: bytes) -> str:
        """The decoded text: the tokens' strings, with blanks between them, as the file names no decoder."""
        return " ".join([self.strings[i] for i in struct.unpack(f"<{len(ids) // 4}I", ids)])


def _slots(pairs: np.ndarray) -> np.ndarray:
    """Where the search for each pair begins in the table."""
    return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)).astype(np.int64) % SLOTS


def slices(batch: pa.RecordBatch, text: str = "text", rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Parts of the batch of so many rows, or of fewer with BATCH_BYTES of text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy())
    lo = 0
    while lo < batch.num_rows:
        most = sizes[lo - 1] + BATCH_BYTES if lo else BATCH_BYTES
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(sizes, most, side="right"))))
        yield batch.slice(lo, hi - lo)
        lo = hi


class _Cache:
    """Ids and strings of what stands between white space. When so many (``most``) are held, those that the next texts don't have go."""

    def __init__(self, bpe: WordBpe, most: int = CACHE_WORDS):
        self.bpe, self.most = bpe, most
        self.ids: dict[str, bytes] = {}
        self.strings: dict[str, str] = {}

    def hold(self, chunks: set[str]) -> None:
        """Hold at least these."""
        if len(self.ids) >= self.most:
            self.ids, held = {c: self.ids[c] for c in chunks.intersection(self.ids)}, self.strings
            self.strings = {c: held[c] for c in self.ids.keys() & held.keys()}
        new = list(chunks.difference(self.ids))
        if not new:
            return
        words, at = self.bpe.split(new)
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids, begin = self.bpe.words(list(number))
        # the ids of each word where it stands in the texts
        of = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        counts = np.diff(begin)[of]
        ends = np.append(0, np.cumsum(counts))
        packed = ids[np.arange(ends[-1]) - np.repeat(ends[:-1] - begin[of], counts)].astype("<u4").tobytes()
        bounds = (4 * ends[at]).tolist()
        self.ids.update(zip(new, [packed[lo:hi] for lo, hi in zip(bounds, bounds[1:])]))

    def string(self, chunk: str) -> str:
        """The decoded form of a text that is held."""
        found = self.strings.get(chunk)
        if found is None:
            found = self.strings[chunk] = self.bpe.decode(self.ids[chunk])
        return found


_loaded: dict[int, WordBpe] = {}


def loaded(source) -> WordBpe:
    """The encoder of a broadcast vocabulary, built once per worker."""
    if source.value["key"] not in _loaded:
        _loaded.clear()
        _loaded[source.value["key"]] = WordBpe(source.value["json"])
    return _loaded[source.value["key"]]


def broadcast_vocabulary(spark: SparkSession, path: str):
    """The bytes of a vocabulary file on the driver (a fixed size, about 2 MB), for the workers."""
    with open(path, "rb") as f:
        source = f.read()
    return spark.sparkContext.broadcast({"key": hash(source), "json": source})


def _encoded(batches: Iterator[pa.RecordBatch], source, carry: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    bpe = loaded(source)
    for batch in batches:
        for part in slices(batch):
            both = bpe.encoded(part.column("text").to_pylist())
            ids = pa.array([x for x, _ in both], type=pa.binary())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pc.cast(pc.divide(pc.binary_length(ids), 4), pa.int64()), ids, pa.array([x for _, x in both], type=pa.string())]
                + [part.column(c) for c in carry],
                names=["doc_id", "n_tokens", "ids", "decoded", *carry],
            )


def encode_documents(docs: DataFrame, vocabulary: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Encode each text and decode it again.

    docs: doc_id long and text string; other columns are ignored, whatever their names,
    but those in carry are passed on. vocabulary: path, on the driver, of the vocabulary file; its bytes (a fixed size, about
    2 MB) are broadcast. Returns, for each row, doc_id, n_tokens, ids (binary, unsigned
    32-bit little-endian integers; ``ids_array`` unpacks them) and decoded.

    A null or empty text has no tokens and decodes to an empty text. Repeated rows give
    equal rows; a null doc_id stays null. No rows are shuffled.
    """
    shipped = broadcast_vocabulary(docs.sparkSession, vocabulary)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    schema = T.StructType.fromDDL("doc_id long, n_tokens long, ids binary, decoded string")
    return texts.mapInArrow(lambda batches: _encoded(batches, shipped, carry), T.StructType(schema.fields + texts.schema.fields[2:]))


def ids_array(ids: str = "ids"):
    """The packed ids as an array<int> column."""
    return F.expr(
        f"transform(sequence(0, length({ids}) div 4 - 1), i -> cast(conv(hex(reverse(substring({ids}, 4 * i + 1, 4))), 16, 10) as int))"
    )
