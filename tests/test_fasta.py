"""FASTA by pages: contigs, chunks and intervals equal the text's, whatever its lines, and bytes that nobody reaches stay unread."""

import random

import pytest

from annulus.sources import fasta, text
from annulus.sources.fasta import Fasta, genome_chunks


def written(path, seed, widths, ending="\n"):
    rng = random.Random(seed)
    seqs, out = {}, []
    for k, n in enumerate((0, 1, 59, 60, 700, 3000, 64)):
        seq = "".join(rng.choices("ACGTNacgt", k=n))
        seqs[f"c{k}"] = seq
        out.append(f">c{k}" + rng.choice(("", " words > and more", "\ttab" + "x" * 90)))
        at = 0
        while at < n:
            width = rng.choice(widths)
            out.append(seq[at : at + width])
            at += width
        out += [""] * rng.randrange(2)
    path.write_bytes((ending.join(out) + rng.choice(("", ending))).encode())
    return seqs


@pytest.mark.parametrize("seed, widths, page, ending", [(1, (60,), 97, "\n"), (2, (7, 60, 80), 33, "\r\n"), (3, (10_000,), 40, "\n"), (4, (60,), 1 << 16, "\n")])
def test_intervals_equal_the_text(spark, tmp_path, seed, widths, page, ending):
    seqs = written(tmp_path / "g.fa", seed, widths, ending)
    genome = Fasta(spark, str(tmp_path / "g.fa"), range_bytes=1000 if page < 1000 else 1 << 25, page=page)
    assert {r.chrom: r.length for r in genome.contigs().collect()} == {c: len(s) for c, s in seqs.items()}
    whole = {}
    for r in sorted(genome.chunks(size=64).collect(), key=lambda r: r.chunk):
        assert len(r.bases) == 64 or r.chunk == (len(seqs[r.chrom]) - 1) // 64
        whole[r.chrom] = whole.get(r.chrom, "") + r.bases
    assert whole == {c: s for c, s in seqs.items() if s}
    where = [(c, lo, lo + n) for c in seqs for lo in (-3, 0, 58, 63, 64, 650) for n in (1, 5, 130)] + [("x", 0, 5), ("c4", 9, 9)]
    df = spark.createDataFrame(where, "chrom string, start long, end long")
    got = sorted(tuple(r) for r in text.fetch(df, genome.chunks(df, 64), 64).collect())
    assert got == sorted((c, lo, hi, s) for c, lo, hi in where if c in seqs and hi > 0 and (s := seqs[c][max(lo, 0) : hi]))


def test_chunks_that_nobody_reaches_stay_unread(spark, tmp_path):
    seq = "".join(random.Random(1).choices("ACGT", k=400_000))
    (tmp_path / "g.fa").write_text(">a\n" + "\n".join(seq[i : i + 60] for i in range(0, len(seq), 60)) + "\n>b\nACGT\n")
    genome = Fasta(spark, str(tmp_path / "g.fa"), page=4096)
    df = spark.createDataFrame([("a", 200_000, 200_100), ("a", 200_050, 200_090)], "chrom string, start long, end long")
    reads = genome.wanted(df, 1024).collect()
    assert len(reads) == 1 and reads[0].hi - reads[0].lo <= 2 * 4096
    assert [r.bases for r in text.fetch(df, genome_chunks(genome, df)).orderBy("start").collect()] == [seq[200_000:200_100], seq[200_050:200_090]]
    rows = spark.createDataFrame([("a", 0, "ACGT")], "chrom string, chunk long, bases string")
    assert genome_chunks(rows, df) is rows
    assert fasta.reached(df, 1024).count() == 1


def test_headers_over_several_pages(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">one " + "w" * 500 + "\nACGT\nAC\n>two" + "\n" + "G" * 100 + "\n>" + "n" * 150 + " x\nTT\n>last")
    genome = Fasta(spark, str(tmp_path / "g.fa"), range_bytes=70, page=32)
    assert {r.chrom: r.length for r in genome.contigs().collect()} == {"one": 6, "two": 100, "n" * 150: 2, "last": 0}
    assert {r.chrom: r.bases for r in genome.chunks().collect()} == {"one": "ACGTAC", "two": "G" * 100, "n" * 150: "TT"}
