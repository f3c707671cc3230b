"""Indexed reads of BAM files: the rows of a full scan, from the blocks of their bins alone."""

import random

import numpy as np
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

from annulus.sources import bai, bam, indexed

CONTIGS = [("c0", 5_000), ("c1", 4_000_000), ("c2", 900_000)]


@pytest.fixture(scope="module")
def sorted_reads():
    rng = random.Random(5)
    out = []
    for c, size in CONTIGS[1:]:
        for pos in sorted(rng.randrange(size - 60_000) for _ in range(6000)):
            skip = rng.choice((0, 0, 0, 300, 40_000))
            cigar = [{"op": 0, "len": 50}, {"op": 3, "len": skip}, {"op": 0, "len": 50}] if skip else [{"op": 0, "len": 100}]
            out.append({"qname": f"r{len(out)}", "flag": 0, "chrom": c, "pos": pos, "mapq": 60, "cigar": cigar, "next_chrom": None, "next_pos": -1, "tlen": 0, "seq": "".join(rng.choices("ACGT", k=100)), "qual": [rng.randrange(2, 40) for _ in range(100)]})
    out += [{"qname": f"u{k}", "flag": 4, "chrom": None, "pos": -1, "mapq": 0, "cigar": [], "next_chrom": None, "next_pos": -1, "tlen": 0, "seq": "ACGT", "qual": None} for k in range(50)]
    return out


@pytest.fixture(scope="module")
def file(spark, sorted_reads, tmp_path_factory):
    path = tmp_path_factory.mktemp("bam") / "x.bam"
    path.write_bytes(bam.bam_bytes(sorted_reads, CONTIGS, "coordinate"))
    bai.write_index(spark, str(path), 60_000)
    indexed.register(spark)
    return path


def overlapping(reads, chrom, lo, hi):
    end = lambda r: r["pos"] + sum(c["len"] for c in r["cigar"] if c["op"] in (0, 2, 3, 7, 8))
    return [r["qname"] for r in reads if r["chrom"] == chrom and r["pos"] < hi and end(r) > lo]


def test_bins_by_levels():
    rng = random.Random(1)
    spans = [(a := rng.randrange(1 << 28), a + rng.choice((1, 100, 20_000, 1 << 24))) for _ in range(300)]
    found = bai.bins_of(np.array([a for a, _ in spans]), np.array([b for _, b in spans]))
    assert found.tolist() == [bam._bin(a, b) for a, b in spans]
    assert all(int(f) in bai.reached_bins(max(0, a - 5), b + 5) for f, (a, b) in zip(found, spans))


def test_chunks_hold_all_overlapping_records(file, sorted_reads):
    index = bai.load(str(file))
    assert len(index) == 3 and not index[0].bins
    size = file.stat().st_size
    everything = [(r["qname"], o) for _, starts, ordinals in bam.located(str(file), 0, size, size) for r, o in zip(sorted_reads, ordinals.tolist())]
    at = dict(everything)
    rng = random.Random(2)
    for number, (c, n) in enumerate(CONTIGS):
        for _ in range(40):
            lo = rng.randrange(n)
            hi = lo + rng.choice((1, 500, 100_000))
            chunks = bai.chunks_of(index[number], lo, hi)
            assert all(any(a <= at[q] < b for a, b in chunks) for q in overlapping(sorted_reads, c, lo, hi))
            assert all(x[1] < y[0] for x, y in zip(chunks, chunks[1:]))
            cut = bai.divided(index[number], chunks, 50_000)
            assert sorted({x for c in cut for x in c}) == sorted({x for c in chunks for x in c} | {x for c in cut for x in c}) and all(x[0] < x[1] for x in cut)


def test_filters_give_the_rows_of_a_full_scan(spark, file, sorted_reads):
    full = bam.read_bam(spark, str(file))
    source = spark.read.format("bam").option("range_bytes", 100_000).load(str(file))
    for where in ("chrom = 'c1' AND pos >= 1000000 AND pos < 1010000", "chrom IN ('c2', 'cx') AND pos > 500000", "chrom = 'c0'", "pos = 7 OR chrom = 'c2' AND mapq > 60", "chrom = 'c1' AND pos <= 3000 AND mapq >= 60", "chrom IS NULL"):
        order = lambda df: [str(r) for r in df.where(where).orderBy("ordinal").collect()]  # noqa: B023, E731
        assert order(source) == order(full), where
    assert source.count() == len(sorted_reads)
    for lo, hi in ((1_500_000, 1_500_001), (0, 4_000_000), (2_000_000, 2_030_000)):
        got = spark.read.format("bam").option("regions", f"c1:{lo}-{hi}; c9:1-2").load(str(file)).orderBy("ordinal")
        assert [r.qname for r in got.select("qname").collect()] == overlapping(sorted_reads, "c1", lo, hi)


def test_only_the_blocks_of_the_bins_are_read(spark, file, monkeypatch):
    reader = indexed.BamReader(str(file), None, 1 << 20)
    kept = list(reader.pushFilters([EqualTo(("chrom",), "c1"), GreaterThanOrEqual(("pos",), 1_000_000), LessThan(("pos",), 1_010_000), EqualTo(("mapq",), 60)]))
    assert len(kept) == 4  # Spark applies them, too
    spans = reader.partitions()
    read = []
    monkeypatch.setattr(bam, "blocks", lambda data, at=0, inner=bam.blocks: (read.append(1) or b for b in inner(data, at)))
    rows = sum(b.num_rows for s in spans for b in reader.read(s))
    own = len(read)
    read.clear()
    whole = indexed.BamReader(str(file), None, 1 << 20)
    assert sum(b.num_rows for s in whole.partitions() for b in whole.read(s)) == 12_050
    assert 0 < rows < 400 and own < len(read) / 3
    none = indexed.BamReader(str(file), None, 1 << 20)
    list(none.pushFilters([EqualTo(("chrom",), "c0")]))
    assert none.partitions() == []


def test_without_an_index(spark, file, sorted_reads, tmp_path):
    (tmp_path / "y.bam").write_bytes(file.read_bytes())
    got = spark.read.format("bam").option("regions", "c2:100000-120000").option("range_bytes", 90_000).load(str(tmp_path))
    assert sorted(r.qname for r in got.collect()) == sorted(overlapping(sorted_reads, "c2", 100_000, 120_000))
    with pytest.raises(FileNotFoundError):
        indexed.listed(str(tmp_path / "z.bam"))
    assert indexed.parse_regions("a:1-5;b; HLA:01 ;c:d:2-3") == [("a", 1, 5), ("b", 0, indexed.FAR), ("HLA:01", 0, indexed.FAR), ("c:d", 2, 3)]
