"""Packing: every id in one piece, limits kept, the heuristic against a plain version."""

import random
import struct
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from annulus.llm.packing import Pool, pack, pack_documents
from annulus.llm.queries import op13_packing, word_vocabulary

DATA = "/root/testdata/sf0.001"


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def whole(pieces, examples, limits):
    """Check pieces (doc_id, start, length, ids, doc_tokens, loss_tokens, sequence_id, offset) of examples {doc_id: (ids, lead)}; number of sequences."""
    of, sequences = {}, {}
    for p in pieces:
        of.setdefault(p.doc_id, []).append(p)
        sequences.setdefault(p.sequence_id, []).append(p)
    assert of.keys() == {d for d, (ids, _) in examples.items() if ids}
    for d, ps in of.items():
        ids, lead = examples[d]
        ps.sort(key=lambda p: p.start)
        assert [p.start for p in ps] == np.cumsum([0] + [p.length for p in ps])[:-1].tolist()
        assert b"".join(bytes(p.ids) for p in ps) == packed(ids) and {p.doc_tokens for p in ps} == {len(ids)}
        assert all(p.loss_tokens == sum(i >= lead for i in range(p.start, p.start + p.length)) for p in ps)
    for ps in sequences.values():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == np.cumsum([0] + [p.length for p in ps])[:-1].tolist()
        n = sum(p.length for p in ps)
        assert n == limits[0] or n & (n - 1) == 0 and n < limits[0]
        assert len(ps) <= limits[1] and sum(p.loss_tokens for p in ps) <= limits[2]
    return len(sequences)


@pytest.mark.parametrize("seed, limits", [(1, (64, 5, 64)), (2, (100, 9, 40)), (3, (16, 1, 3)), (4, (1, 1, 1))])
def test_limits_and_ids(spark, seed, limits):
    rng = random.Random(seed)
    examples = {d: ([rng.randrange(50_000) for _ in range(rng.choice((0, 1, 2, 5, 30, 90, 700)))], rng.choice((0, 1, 20))) for d in range(150)}
    df = spark.createDataFrame([(d, bytearray(packed(i)), m, "x") for d, (i, m) in examples.items()], "doc_id long, ids binary, lead long, start string")
    whole(pack(df.repartition(3), *limits, pool_items=17).collect(), examples, limits)


def test_sequences_are_full(spark):
    rng = random.Random(7)
    examples = {d: ([1] * rng.choice((3, 40, 300, 2500)), 1) for d in range(600)}
    df = spark.createDataFrame([(d, bytearray(packed(i)), m) for d, (i, m) in examples.items()], "doc_id long, ids binary, lead long").coalesce(2)
    n = whole(pack(df).collect(), examples, (2048, 256, 2048))
    tokens = sum(len(i) for i, _ in examples.values())
    assert n <= tokens // 2048 + 12 * 4


def test_heuristic_equals_plain_version():
    """Choices of one sequence, product by product."""
    rng = random.Random(3)
    for _ in range(60):
        limits = (rng.choice((20, 64)), rng.choice((2, 6)), rng.choice((10, 64)))
        pool = Pool(*limits)
        sizes = [(rng.randrange(1, 40), rng.randrange(0, 12)) for _ in range(rng.randrange(1, 15))]
        for d, (n, lead) in enumerate(sizes):
            pool.add(d, b"\0" * 4 * n, 0, n, lead)
        need = [(n, 1, max(0, n - lead)) for n, lead in sizes]
        weight = [sum(x[k] / limits[k] for x in need) for k in range(3)]
        weight = [w / sum(weight) for w in weight]
        left, wait, want = list(limits), set(range(len(sizes))), []
        while left[0] and left[1] and wait:
            score = {i: sum(weight[k] * left[k] / limits[k] * need[i][k] / limits[k] for k in range(3)) for i in wait}
            fits = [i for i in wait if need[i][0] <= left[0] and need[i][2] <= left[2]]
            room = {i: min(need[i][0], left[0], min(sizes[i][1], need[i][0]) + left[2] if sizes[i][1] < need[i][0] else need[i][0]) for i in wait}
            among = fits or [i for i in wait if room[i] > 0]
            if not among:
                break
            i = max(among, key=lambda i: (round(score[i], 12), -i))
            n = need[i][0] if fits else room[i]
            want.append((i, n))
            wait.discard(i)
            left = [left[0] - n, left[1] - 1, left[2] - max(0, n - sizes[i][1])]
        first = next(pool.sequences(True))
        total = sum(n for _, n in want)
        keep = total if total == limits[0] else 1 << (total.bit_length() - 1)
        cut = []
        for i, n in want:
            cut += [(i, min(n, keep))] * (min(n, keep) > 0)
            keep -= min(n, keep)
        assert [(item[0], hi - lo) for item, lo, hi in first] == cut


def test_query_over_documents(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(word_vocabulary())
    library.no_padding()
    library.no_truncation()
    docs = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    ids = {d["doc_id"]: library.encode(d["text"] or "", add_special_tokens=False).ids + [1] for d in docs}
    got = op13_packing(spark, DATA).collect()
    of, sequences = {}, {}
    for r in got:
        of.setdefault(r.doc_id, []).append(r)
        sequences[r.sequence_id] = sequences.get(r.sequence_id, 0) + r.length
    assert of.keys() == ids.keys()
    for d, rs in of.items():
        at = 0
        for r in sorted(rs, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids[d])) and r.ids_crc32 == zlib.crc32(packed(ids[d][at : at + r.length]))
            at += r.length
        assert at == len(ids[d])
    assert all(n == 2048 or n & (n - 1) == 0 for n in sequences.values())
    assert len(sequences) <= sum(map(len, ids.values())) / 2048 + 60


def test_edge_cases(spark):
    rows = [(1, None), (1, None), (None, "a b"), (2, ""), (2, "x " * 40_000), (3, "same"), (3, "same")]
    df = spark.createDataFrame([(*r, "q", 1) for r in rows], "doc_id long, text string, ids string, length int")
    got = pack_documents(df, word_vocabulary(), 1).collect()
    assert sum(r.length for r in got) == 1 + 1 + 3 + 1 + 40_001 + 2 + 2
    assert sum(r.length for r in got if r.doc_id == 3) == 4 and sum(r.doc_id is None for r in got) >= 1
    assert pack_documents(df.limit(0), word_vocabulary(), 1).count() == 0
    none = spark.createDataFrame([(1, None, None), (2, bytearray(), 3)], "doc_id long, ids binary, lead long")
    assert pack(none).count() == 0
    with pytest.raises(ValueError):
        pack(none, max_segments=0)
