"""Alignment records of BAM data as Arrow columns, many at a time.

Fields of fixed size are read by one strided view; names, CIGARs, bases and qualities are gathered
by offsets; tags are walked in step, the k-th tag of all records at once. A tag's value keeps its type
in front, as in SAM text (``i:1``, ``Z:c1,5,+,3M7S,40,0;``, ``B:c,1,2``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASES = "=ACMGRSVTWYHKDBN"
_FIXED = np.dtype(
    [("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("n_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_cigar", "<u2"), ("flag", "<u2"), ("n_seq", "<i4"), ("next_ref", "<i4"), ("next_pos", "<i4"), ("tlen", "<i4")]
)
_PAIRS = np.frombuffer("".join(a + b for a in BASES for b in BASES).encode(), np.uint8).reshape(256, 2)
#: Types of numbers in tags.
NUMBERS = {"c": "<i1", "C": "<u1", "s": "<i2", "S": "<u2", "i": "<i4", "I": "<u4", "f": "<f4"}
_WIDTH = np.zeros(256, np.int64)
for _kind, _type in NUMBERS.items():
    _WIDTH[ord(_kind)] = np.dtype(_type).itemsize
_WIDTH[ord("A")] = 1

_CIGAR = pa.list_(pa.struct([("op", pa.int32()), ("len", pa.int32())]))
ARROW = pa.schema(
    [("ordinal", pa.int64()), ("qname", pa.string()), ("flag", pa.int32()), ("ref_id", pa.int32()), ("chrom", pa.string()), ("pos", pa.int64()), ("mapq", pa.int32()), ("cigar", _CIGAR),
     ("next_ref_id", pa.int32()), ("next_chrom", pa.string()), ("next_pos", pa.int64()), ("tlen", pa.int64()), ("seq", pa.string()), ("qual", pa.list_(pa.int32())), ("sa", pa.string()),
     ("xa", pa.string()), ("nm", pa.int32()), ("mq", pa.int32()), ("tags", pa.map_(pa.string(), pa.string()))]
)


def gathered(data: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than pieces) and bytes of pieces of data, one behind the other."""
    offsets = np.append(0, np.cumsum(sizes, dtype=np.int64))
    return offsets, data[np.arange(offsets[-1]) - np.repeat(offsets[:-1] - begin, sizes)]


def _strings(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def fixed_fields(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The fields of fixed size of the records that start there."""
    return np.ascontiguousarray(data[starts[:, None] + np.arange(_FIXED.itemsize)]).view(_FIXED).reshape(-1)


def reference_spans(data: np.ndarray, starts: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """Bases of the reference that each record's CIGAR takes up (M, D, N, = and X)."""
    counts = fixed["n_cigar"].astype(np.int64)
    offsets, raw = gathered(data, starts + 36 + fixed["n_name"], 4 * counts)
    words = raw.view("<u4")
    taken = np.where(np.isin(words & 15, (0, 2, 3, 7, 8)), words >> 4, 0)
    sums = np.append(0, np.cumsum(taken, dtype=np.int64))
    return sums[offsets[1:] // 4] - sums[offsets[:-1] // 4]


class _Tags:
    """The tags of the records, from ``begin`` to ``end``."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray):
        self.data, self.n = data, len(begin)
        zeros = None
        found = []
        of, at = np.flatnonzero(begin < end), begin[begin < end]
        step = 0
        while len(of):
            kind, value = data[at + 2], at + 3
            width = _WIDTH[kind]
            text = (kind == ord("Z")) | (kind == ord("H"))
            if text.any():
                zeros = np.flatnonzero(data == 0) if zeros is None else zeros
                width[text] = zeros[np.searchsorted(zeros, value[text])] - value[text]
            array = kind == ord("B")
            if array.any():
                n = gathered(data, value[array] + 1, np.full(int(array.sum()), 4))[1].view("<i4")
                width[array] = 5 + n * _WIDTH[data[value[array]]]
            found.append((of, np.full(len(of), step), data[at].astype(np.int64) << 8 | data[at + 1], kind, value, width))
            at = value + width + text
            go = at < end[of]
            of, at, step = of[go], at[go], step + 1
        columns = [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, np.int64)] * 6
        order = np.lexsort((columns[1], columns[0]))
        self.of, _, self.name, self.kind, self.value, self.width = (c[order] for c in columns)

    def integers(self, name: str) -> pa.Array:
        """The integer of that name for each record."""
        out, there = np.zeros(self.n, np.int64), np.zeros(self.n, bool)
        mine = self.name == (ord(name[0]) << 8 | ord(name[1]))
        for kind in "cCsSiI":
            rows = np.flatnonzero(mine & (self.kind == ord(kind)))
            out[self.of[rows]] = self._numbers(rows, kind)
            there[self.of[rows]] = True
        return pa.array(out, pa.int64(), mask=~there).cast(pa.int32(), safe=False)

    def texts(self, name: str) -> pa.Array:
        """The text of that name for each record."""
        rows = np.flatnonzero((self.name == (ord(name[0]) << 8 | ord(name[1]))) & (self.kind == ord("Z")))
        where = np.full(self.n, -1)
        where[self.of[rows]] = np.arange(len(rows))
        return _strings(*gathered(self.data, self.value[rows], self.width[rows])).take(pa.array(where, pa.int64(), mask=where < 0))

    def _numbers(self, rows: np.ndarray, kind: str) -> np.ndarray:
        return gathered(self.data, self.value[rows], self.width[rows])[1].view(NUMBERS[kind])

    def map(self) -> pa.Array:
        """Names, and types and values as SAM text has them."""
        rows, parts = [], []
        for kind in np.unique(self.kind):
            mine, letter = np.flatnonzero(self.kind == kind), chr(kind)
            if letter == "B":
                values = pa.array([self._listed(int(v)) for v in self.value[mine]], pa.string())
            elif letter in "ZHA":
                values = _strings(*gathered(self.data, self.value[mine], self.width[mine]))
            else:
                values = pa.array(self._numbers(mine, letter)).cast(pa.string())
            rows.append(mine)
            parts.append(pc.binary_join_element_wise(pa.scalar("i" if letter in "cCsSI" else letter), values, pa.scalar(":")))
        counts = np.bincount(self.of.astype(np.int64), minlength=self.n) if len(self.of) else np.zeros(self.n, np.int64)
        offsets = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
        if not parts:
            return pa.MapArray.from_arrays(offsets, pa.array([], pa.string()), pa.array([], pa.string()))
        values = pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(rows))))
        letters = np.stack([self.name >> 8, self.name & 255], axis=1).astype(np.uint8)
        return pa.MapArray.from_arrays(offsets, _strings(np.arange(len(letters) + 1) * 2, letters.ravel()), values)

    def _listed(self, at: int) -> str:
        kind = chr(self.data[at])
        n = int(self.data[at + 1 : at + 5].view("<i4")[0])
        values = self.data[at + 5 : at + 5 + n * _WIDTH[self.data[at]]].view(NUMBERS[kind])
        return ",".join([kind, *pa.array(values).cast(pa.string()).to_pylist()])


def decoded(data: np.ndarray, starts: np.ndarray, ordinals: np.ndarray, contigs: pa.Array) -> pa.RecordBatch:
    """The reads schema of the records that start there; contigs: names by number."""
    f = fixed_fields(data, starts)
    n_name, n_cigar, n_seq = (f[c].astype(np.int64) for c in ("n_name", "n_cigar", "n_seq"))
    name = starts + 36
    cigar = name + n_name
    seq = cigar + 4 * n_cigar
    qual = seq + (n_seq + 1) // 2
    tags = _Tags(data, qual + n_seq, starts + 4 + f["size"])

    offsets, raw = gathered(data, cigar, 4 * n_cigar)
    words = raw.view("<u4")
    runs = pa.StructArray.from_arrays([pa.array((words & 15).astype(np.int32)), pa.array((words >> 4).astype(np.int32))], names=["op", "len"])
    at, packed = gathered(data, seq, (n_seq + 1) // 2)
    bases = gathered(_PAIRS[packed].ravel(), 2 * at[:-1], n_seq)
    bounds, scores = gathered(data, qual, n_seq)
    none = (n_seq == 0) | (data[np.minimum(qual, len(data) - 1)] == 255)
    chrom = lambda ref: contigs.take(pa.array(ref.astype(np.int64), mask=ref < 0))
    columns = [
        pa.array(ordinals, pa.int64()), _strings(*gathered(data, name, n_name - 1)), pa.array(f["flag"].astype(np.int32)), pa.array(f["ref"]), chrom(f["ref"]), pa.array(f["pos"].astype(np.int64)),
        pa.array(f["mapq"].astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets // 4, pa.int32()), runs), pa.array(f["next_ref"]), chrom(f["next_ref"]), pa.array(f["next_pos"].astype(np.int64)),
        pa.array(f["tlen"].astype(np.int64)), _strings(*bases), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(scores.astype(np.int32)), mask=pa.array(none)),
        tags.texts("SA"), tags.texts("XA"), tags.integers("NM"), tags.integers("MQ"), tags.map(),
    ]
    return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, ARROW.types)], schema=ARROW)
