"""Columns of BAM records against a reader of one record at a time; tags, headers and the index."""

import random
import struct

import numpy as np
import pyarrow as pa
import pytest

from annulus.sources import bam, records, text

CONTIGS = [("c1", 300_000), ("c2", 90_000)]
TAGS = {"NH": "i:1", "XS": "A:+", "AS": "f:0.5", "ZB": "B:c,-1,2", "ZF": "B:f,0.25,3", "ZI": "i:4000000000", "RG": "Z:group", "HX": "H:1AE3", "ZS": "i:-7", "ZE": "Z:"}
TEXT = "@HD\tVN:1.5\tSO:coordinate\n@SQ\tSN:c1\tLN:300000\tM5:x\n@SQ\tSN:c2\tLN:90000\n@RG\tID:group\tSM:one\n@PG\tID:aligner\n@CO\twords\n"


def invented(seed, n=400):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        length = rng.choice((0, 1, 7, 8, 100))
        tags = dict(rng.sample(sorted(TAGS.items()), rng.randrange(len(TAGS))))
        placed = rng.random() < 0.9
        out.append(
            {
                "qname": f"r{k}", "flag": rng.randrange(4096), "chrom": rng.choice(("c1", "c2")) if placed else None, "pos": rng.randrange(80_000) if placed else -1, "mapq": rng.randrange(61),
                "cigar": [{"op": rng.choice((0, 1, 2, 3, 4, 7, 8)), "len": rng.randrange(1, 300)} for _ in range(rng.randrange(4))], "next_chrom": rng.choice((None, "c1")), "next_pos": rng.choice((-1, 70)), "tlen": rng.randrange(-500, 500),
                "seq": "".join(rng.choices("ACGTN", k=length)), "qual": [rng.randrange(94) for _ in range(length)] if length and rng.random() < 0.8 else None,
                "sa": rng.choice((None, "c1,5,+,3M7S,40,0;")), "xa": rng.choice((None, "c2,-7,9M,1;")), "nm": rng.choice((None, 0, 300)), "mq": rng.choice((None, 60)), "tags": tags,
            }
        )
    return sorted(out, key=lambda r: (r["chrom"] is None, r["chrom"] or "", r["pos"]))


def expected(r):
    typed = {k: f"{t}:{r[c]}" for k, c, t in (("SA", "sa", "Z"), ("XA", "xa", "Z"), ("NM", "nm", "i"), ("MQ", "mq", "i")) if r[c] is not None}
    return r | {"tags": r["tags"] | typed}


@pytest.mark.parametrize("seed", range(2))
def test_records_come_back(spark, tmp_path, seed):
    data = invented(seed)
    (tmp_path / "x.bam").write_bytes(bam.bam_bytes(data, CONTIGS, "coordinate", TEXT))
    reads = bam.read_bam(spark, str(tmp_path / "x.bam"), 4000)
    got = [r.asDict(True) for r in reads.orderBy("ordinal").collect()]
    assert [{k: g[k] for k in w} for g, w in zip(got, map(expected, data))] == list(map(expected, data)) and len(got) == len(data)
    assert [g["ref_id"] for g in got] == [-1 if w["chrom"] is None else int(w["chrom"][1]) - 1 for w in data]
    # through the writer: every tag's type and every line of the header but the order
    bam.write_bam(reads.orderBy("ordinal").coalesce(1), str(tmp_path / "out"), CONTIGS, "queryname", bam.header_text(spark, str(tmp_path / "x.bam")))
    again = bam.read_bam(spark, str(tmp_path / "out"))
    assert [{k: g[k] for k in w} for g, w in zip((r.asDict(True) for r in again.orderBy("ordinal").collect()), map(expected, data))] == list(map(expected, data))
    lines = bam.header_text(spark, str(tmp_path / "out")).splitlines()
    assert lines == ["@HD\tVN:1.5\tSO:queryname", *TEXT.splitlines()[1:]]
    text.write_sam(reads, str(tmp_path / "sam"))
    sam = {r.qname: r.asDict(True) for r in text.read_sam(spark, str(tmp_path / "sam")).collect()}
    assert all(sam[w["qname"]]["tags"] == expected(w)["tags"] and sam[w["qname"]]["nm"] == w["nm"] and sam[w["qname"]]["sa"] == w["sa"] for w in data)


def test_numbers_of_every_width():
    tags = b"NMC\x07" + b"MQs\x2c\x01" + b"XAZp;\0" + b"aaA!" + b"bbI\xff\xff\xff\xff" + b"ccc\xff" + b"ddf" + struct.pack("<f", 0.1)
    body = struct.pack("<iiBBHHHiiii", 0, 4, 2, 9, 0, 0, 0, 0, -1, -1, 0) + b"q\0" + tags
    raw = np.frombuffer(struct.pack("<i", len(body)) + body, np.uint8)
    row = records.decoded(raw, np.array([0]), np.array([5]), pa.array(["c1"])).to_pylist()[0]
    assert (row["nm"], row["mq"], row["xa"], row["sa"], row["qual"], row["seq"]) == (7, 300, "p;", None, None, "")
    assert dict(row["tags"]) == {"NM": "i:7", "MQ": "i:300", "XA": "Z:p;", "aa": "A:!", "bb": "i:4294967295", "cc": "i:-1", "dd": "f:0.1"}
    assert bam.tag_bytes("dd", "f:0.1") == tags[-7:] and bam.tag_bytes("bb", "i:4294967295") == b"bbI\xff\xff\xff\xff"
    with pytest.raises(ValueError):
        bam.tag_bytes("xx", "q:1")
