"""Hand-made tables, slow models and round trips."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from annulus.functions import reads as R
from annulus.operators import coverage, evidence, intervals, kernel, pairs, simulate
from annulus.plans import pipelines
from annulus.sources import bam, text


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_scalar_functions(spark):
    one = spark.range(1)
    cigar = R.parse_cigar(F.lit("20S3M2D70M5S"))
    got = one.select(
        R.cigar_sum(cigar, 0, 2, 3).alias("span"),
        R.rightmost_of_text(F.lit(101), F.lit("30S70M")).alias("right"),
        R.phred_to_prob(F.lit(30)).alias("p"),
        R.prob_to_phred(F.lit(1.0)).alias("q"),
        R.reverse_complement(F.lit("AACG")).alias("rc"),
    ).first()
    assert (got.span, got.right, got.q, got.rc) == (75, 170, 90, "CGTT") and got.p == pytest.approx(0.001)


def test_tiles_run_over_the_end(spark):
    df = spark.createDataFrame([("c", 0, 700), ("c", 0, 500)], "chrom string, start long, end long")
    assert rows(intervals.tiles(df), "start", "end") == [(0, 300), (0, 500), (300, 600), (600, 900)]


def spans(n, seed, far=3000):
    rng = random.Random(seed)
    return [(f"c{rng.randrange(2)}", s := rng.randrange(far), s + rng.randrange(1, 400)) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_overlap_join_equals_nested_loop(spark, seed):
    a, b = spans(60, seed), spans(60, seed + 50)
    left = spark.createDataFrame(a, "chrom string, start long, end long").distinct()
    right = spark.createDataFrame(b, "chrom string, start long, end long").distinct()
    got = rows(intervals.overlap_join(left, right, bin_size=100), "chrom", "start", "end", "r_start", "r_end")
    want = sorted((c, s, e, x, y) for c, s, e in set(a) for d, x, y in set(b) if c == d and s < y and e > x)
    assert got == want
    free = rows(intervals.exclude_regions(left, right), "chrom", "start", "end")
    assert free == sorted(t for t in set(a) if not any(t[0] == d and t[1] < y and t[2] > x for d, x, y in b))


@pytest.mark.parametrize("seed", range(2))
def test_coverage_runs_equal_base_by_base(spark, seed):
    a = spans(80, seed)
    df = spark.createDataFrame(a, "chrom string, start long, end long")
    depth = {}
    for c, s, e in a:
        for x in range(s, e):
            depth[c, x] = depth.get((c, x), 0) + 1
    got = {(r.chrom, x): r.depth for r in intervals.coverage_runs(df, stretch=500).collect() for x in range(r.start, r.end)}
    assert got == depth


def test_reciprocal_merge_compares_with_the_row_before(spark):
    data = [("c", 0, 100, 1), ("c", 2, 102, 1), ("c", 4, 104, 1), ("c", 90, 190, 1), ("d", 4, 104, 1)]
    df = spark.createDataFrame(data, "chrom string, start long, end long, item long")
    assert rows(evidence.merge_repeats(df, 0.9, 1), "chrom", "start", "end", "item") == [("c", 0, 104, 3), ("c", 90, 190, 1), ("d", 4, 104, 1)]


def test_coverage_stats_equal_base_by_base(spark):
    reads = [("c", 10, 60), ("c", 20, 90), ("c", 300, 380)]
    circles = spark.createDataFrame([("c", 15, 85), ("c", 200, 250)], "chrom string, start long, end long")
    contigs = spark.createDataFrame([(0, "c", 400)], "ref_id int, chrom string, length long")
    depth = np.zeros(400)
    for _, s, e in reads:
        depth[s:e] += 1
    got = coverage.coverage_stats(circles, spark.createDataFrame(reads, "chrom string, start long, end long"), contigs, 20, 30).orderBy("start").collect()
    own = depth[15:85]
    assert got[0].mean == pytest.approx(own.mean()) and got[0].std == pytest.approx(own.std()) and got[0].continuity == pytest.approx((own == 0).mean())
    assert got[0].start_ratio == pytest.approx(depth[15:45].sum() / depth[0:45].sum())
    assert got[1].mean == 0 and got[1].start_ratio is None
    assert [r.start for r in coverage.filter_by_ratio(coverage.coverage_stats(circles, spark.createDataFrame(reads, "chrom string, start long, end long"), contigs, 20, 30), 0.1).collect()] == [15]


def counted_bases(reads, quality):
    """Depth by base as pysam's count_coverage has it."""
    depth = {}
    for r in reads:
        if r["flag"] & (4 | 256 | 512 | 1024) or not r["seq"]:
            continue
        at, place = 0, r["pos"]
        for c in r["cigar"]:
            for k in range(c["len"]) if c["op"] in (0, 7, 8) else ():
                if at + k < len(r["seq"]) and r["seq"][at + k].upper() in "ACGT" and (not quality or (r["qual"] and r["qual"][at + k] >= quality)):
                    depth[r["chrom"], place + k] = depth.get((r["chrom"], place + k), 0) + 1
            at += c["len"] if c["op"] in (0, 1, 4, 7, 8) else 0
            place += c["len"] if c["op"] in (0, 2, 3, 7, 8) else 0
    return depth


@pytest.mark.parametrize("quality", [0, 20])
def test_covering_blocks_equal_base_by_base(spark, quality):
    """Reads with deletions, skips, =, X, clips, N bases, low or no qualities and no bases."""
    rng = random.Random(11)
    data = []
    for k in range(80):
        ops = [(5, 4)] * (k % 3 == 0) + [(4, 3)] * (k % 4 == 0) + [(rng.choice((0, 7, 8, 0, 1, 2, 3, 6)), rng.randrange(1, 9)) for _ in range(rng.randrange(1, 7))] + [(4, 2)] * (k % 5 == 0)
        n = sum(x for o, x in ops if o in (0, 1, 4, 7, 8))
        seq, qual = "".join(rng.choices("ACGTNRa", (9, 9, 9, 9, 2, 1, 1), k=n)), [rng.choice((10, 19, 20, 30, 30, 30)) for _ in range(n)]
        data.append(dict(chrom=f"c{k % 2}", pos=rng.randrange(200), flag=rng.choice((0, 16, 0, 2048, 4, 256, 512, 1024)), cigar=[{"op": o, "len": x} for o, x in ops], seq=seq if k % 10 else None, qual=qual if k % 7 else None))
    plain = dict(chrom="d", pos=5, flag=0, seq="ACGT" * 3, qual=[30] * 12)
    data += [plain | {"cigar": [{"op": 7, "len": 5}, {"op": 8, "len": 1}, {"op": 2, "len": 4}, {"op": 7, "len": 6}]}, plain | {"cigar": [{"op": 0, "len": 12}], "qual": [9]}]
    reads = spark.createDataFrame(data, "chrom string, pos long, flag int, cigar array<struct<op:int,len:int>>, seq string, qual array<int>")
    blocks = coverage.covering_blocks(reads, quality)
    data[-1]["qual"] = None
    want = counted_bases(data, quality)
    assert {(r.chrom, x): r.depth for r in intervals.coverage_runs(blocks).collect() for x in range(r.start, r.end)} == want
    contigs = spark.createDataFrame([(0, "d", 400)], "ref_id int, chrom string, length long")
    circle = spark.createDataFrame([("d", 5, 25)], "chrom string, start long, end long")
    own = np.array([want.get(("d", x), 0) for x in range(5, 25)])
    got = coverage.coverage_stats(circle, blocks, contigs).first()
    assert (got.mean, got.std, got.continuity) == pytest.approx((own.mean(), own.std(), (own == 0).mean()))


def test_coverage_quality_is_an_option():
    from annulus.cli import parser

    files = ["-i", "a", "-qbam", "b", "-fasta", "c", "-o", "d"]
    assert parser().parse_args(["realign", "-sbam", "e", *files, "-cq", "7"]).coverage_quality == 7
    assert parser().parse_args(["realign", "-sbam", "e", *files]).coverage_quality == pipelines.Params().coverage_quality == 0
    assert parser().parse_args(["repeats", "-i", "a", "-o", "d", "-cq", "7"]).base_quality == 7


def test_short_options_and_switches():
    from annulus.cli import parser

    files = ["-i", "a", "-qbam", "b", "-fasta", "c", "-o", "d"]
    short = "-n 4 -p 0.5 -m 9 -g 6 -e 2 -q 11 -d 0.1 -Q 1.5 -iq 30 -sd 3 -s 50 -f 0.8 -P 0.2 -K 400 -F 0.3 -S 2 -O 4 -r 0.1 -b 100 -cq 5 -E 50 -t 2 -dir x -v 1".split()
    a = parser().parse_args(["realign", "-sbam", "e", *files, *short, "-R", "-D", "-N"])
    assert (a.hits, a.probability, a.min_clip, a.gap_open, a.gap_extend, a.mapq, a.edit_share, a.least_score) == (4, 0.5, 9, 6, 2, 11, 0.1, 1.5)
    assert (a.insert_mapq, a.std_extension, a.sample, a.merge_share, a.interval_probability, a.cluster_gap, a.allele_frequency) == (30, 3, 50, 0.8, 0.2, 400, 0.3)
    assert (a.splits, a.discordants, a.ratio, a.extension, a.coverage_quality, a.inside, a.threads, a.directory, a.verbose) == (2, 4, 0.1, 100, 5, 50, 2, "x", 1)
    assert (a.remap_splits, a.only_discordants, a.coverage) == (True, False, False)
    b = parser().parse_args(["realign-reads", *files])
    assert (b.remap_splits, b.only_discordants, hasattr(b, "coverage")) == (False, True, False)
    c = parser().parse_args(["simulate", "-g", "g", "-N", "7", "-e", "-v", "-ir", "0.1"])
    assert (c.read_number, c.error, c.variants, c.insRate, c.substitution) == (7, True, True, 0.1, 1e-4)


def brute_ends(q, t):
    """(edits, first start) of the best alignment of q that ends before each place of t."""
    row = [(0, j) for j in range(len(t) + 1)]
    for a in q:
        new = [(row[0][0] + 1, row[0][1])]
        for j, b in enumerate(t, 1):
            new.append(min((row[j - 1][0] + (a != b or a == "N"), row[j - 1][1]), (row[j][0] + 1, row[j][1]), (new[-1][0] + 1, new[-1][1])))
        row = new
    return row


def test_infix_alignment_equals_brute_force():
    rng = random.Random(3)
    draw = lambda most: "".join(rng.choices("ACGTN", (9, 9, 9, 9, 1), k=rng.randrange(1, most)))
    qs, ts = [draw(15) for _ in range(150)], [draw(40) for _ in range(150)]
    queries, m = kernel._stacked([kernel.encode(q) for q in qs])
    targets, n = kernel._stacked([kernel.encode(t) for t in ts])
    edits, starts = kernel.infix_ends(queries, m, targets, n)
    want = [brute_ends(q, t) for q, t in zip(qs, ts)]
    for k, w in enumerate(want):
        assert list(zip(edits[k][: len(w)].tolist(), starts[k][: len(w)].tolist())) == w
    end = edits.argmin(axis=1)
    some = [k for k in range(150) if starts[k, end[k]] < end[k]]
    regions, size = kernel._stacked([targets[k, starts[k, end[k]] : end[k]] for k in some])
    steps = kernel.paths(queries[some], m[some], regions, size)
    for row, k, wide in zip(steps, some, size):
        codes = row[: m[k]]
        assert (codes > 0).all() and (codes != ord("=")).sum() + row[-1] == edits[k, end[k]]
        assert (codes != ord("I")).sum() + row[-1] == wide and row[-2] <= row[-1]


def plain_realign(clip, quality, interval, hits, gap_open, gap_extend, share):
    """The rounds of the search written out: best places, one path, one score, masks."""
    target, found = list(interval), []
    freq = {b: interval.count(b) / len(interval) for b in "ACGT"}
    while True:
        row = brute_ends(clip, target)
        best = min(row)[0]
        if not found and best > len(clip) * share:
            return found
        ends = [j for j, c in enumerate(row) if c[0] == best and c[1] < j]
        if not ends:
            return found
        s, e = row[ends[0]][1], ends[0]
        table = [[j for j in range(e - s + 1)]]
        for i, a in enumerate(clip):
            table.append([i + 1])
            for j in range(e - s):
                table[-1].append(min(table[i][j] + (a != target[s + j] or a == "N"), table[i][j + 1] + 1, table[-1][j] + 1))
        i, j, ops = len(clip), e - s, []
        while i or j:
            same = i and j and clip[i - 1] == target[s + j - 1] and clip[i - 1] != "N"
            if i and j and table[i][j] == table[i - 1][j - 1] + (not same):
                i, j = i - 1, j - 1
                ops.append(("=" if same else "X", i))
            elif i and table[i][j] == table[i - 1][j] + 1:
                i -= 1
                ops.append(("I", i))
            else:
                j -= 1
                ops.append(("D", i))
        score, last = 0.0, ""
        for op, i in ops:
            error = 10 ** (-quality[i] / 10) if op != "D" else 0
            if op in "=X" and clip[i] in freq:
                score += np.log2(max(1 - error if op == "=" else error / 3, 1e-12) / max(freq[clip[i]], 1e-9))
            elif op in "ID":
                score -= gap_extend if op == last else gap_open
            last = op
        for j in ends:
            found.append((row[j][1], j - 1, pytest.approx(score), best))
            target[row[j][1] : j - 1] = "x" * max(0, j - 1 - row[j][1])
        if len(found) >= hits or score < -10:
            return found


def test_kernel_equals_a_plain_version():
    rng = random.Random(7)
    clips, quals, intervals = [], [], []
    for _ in range(60):
        t = "".join(rng.choices("ACGT", k=rng.randrange(20, 90)))
        lo = rng.randrange(len(t) - 10)
        q = list(t[lo : lo + rng.randrange(8, 45)])
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(q))
            q[i : i + 1] = rng.choice(([], ["A"], [q[i], "C"], ["N"]))
        clips.append("".join(q)), quals.append([rng.randrange(2, 41) for _ in q])
        intervals.append(t + t[lo : lo + 30] * rng.randrange(2) + "ACAC" * rng.randrange(3))
    for share in (0.05, 0.3):
        got = kernel.realign_all(clips, quals, intervals, 5, 5, 1, share)
        assert got == [plain_realign(c, q, t, 5, 5, 1, share) for c, q, t in zip(clips, quals, intervals)] and sum(map(bool, got)) > 10


def test_kernel_takes_all_equal_places_and_the_first_ones_posterior():
    clip, other = "ACGTTGCAACGGTACCATGA", "TTTTGGGGCCCCAAAATTTTGGGG"
    run = lambda interval: kernel.realign_all([clip], [np.full(20, 30)], [interval], 10, 5, 1, 0.05)[0]
    found = run(other + clip + other)
    assert found[0][:2] == (len(other), len(other) + 19) and found[0][3] == 0 and kernel.posterior([h[2] for h in found]) > 0.99
    twice = run(other + clip + other + clip)
    assert [h[0] for h in twice[:2]] == [24, 68] and kernel.posterior([h[2] for h in twice]) == pytest.approx(0.5)
    assert run(other) == [] and kernel.posterior([]) == 0
    assert kernel.posterior([1.0, 9.0]) == pytest.approx(2 / (2 + 512))


def test_pairing_takes_the_last_first_read(spark):
    data = [(0, "a", 64), (1, "a", 64), (2, "a", 128), (3, "b", 128), (4, "c", 64), (5, "c", 128), (6, "c", 128)]
    df = spark.createDataFrame(data, "ordinal long, qname string, flag int")
    got = sorted((r.r1.ordinal, r.r2.ordinal) for r in pairs.mate_pairs(df).collect())
    assert got == [(1, 2), (4, 5), (4, 6)]


def some_reads():
    read = dict(flag=99, chrom="c1", pos=10, mapq=60, cigar=[{"op": 4, "len": 3}, {"op": 0, "len": 7}], next_chrom="c2", next_pos=40, tlen=37, seq="ACGTNACGTA", qual=list(range(10, 20)), sa="c1,5,+,3M7S,40,0;", xa=None, nm=1, mq=50)
    return [read | {"qname": "q1"}, read | {"qname": "q2", "seq": "ACGTA", "qual": [1] * 5, "cigar": [{"op": 0, "len": 5}], "sa": None, "chrom": "c2"}]


def test_bam_round_trip(spark, tmp_path):
    contigs = [("c1", 1000), ("c2", 2000)]
    (tmp_path / "x.bam").write_bytes(bam.bam_bytes(some_reads(), contigs, "queryname"))
    got = bam.read_bam(spark, str(tmp_path / "x.bam")).orderBy("ordinal")
    for r, want in zip(got.collect(), some_reads()):
        assert {k: v for k, v in r.asDict(True).items() if k in want} == want
    assert rows(bam.read_contigs(spark, str(tmp_path / "x.bam")), "chrom", "length") == contigs
    bam.require_order(spark, str(tmp_path / "x.bam"), "queryname")
    with pytest.raises(ValueError):
        bam.require_order(spark, str(tmp_path / "x.bam"), "coordinate")
    (tmp_path / "u.bam").write_bytes(bam.bam_bytes(some_reads(), contigs))
    with pytest.raises(ValueError):
        bam.require_order(spark, str(tmp_path / "u.bam"), "queryname")
    (tmp_path / "n.bam").write_bytes(bam.bam_bytes(some_reads(), contigs, "unknown"))
    with pytest.warns(UserWarning):
        bam.require_order(spark, str(tmp_path / "n.bam"), "queryname")
    bam.write_bam(got.coalesce(1), str(tmp_path / "out"), contigs)
    again = bam.read_bam(spark, str(tmp_path / "out"))
    assert rows(again, "qname", "pos", "seq") == rows(got, "qname", "pos", "seq")


@pytest.mark.parametrize("size", [3_000, 70_000, 1 << 25])
def test_bam_ranges_give_each_record_once(spark, tmp_path, size):
    """Ranges smaller than a block, over a block and over the file; some records run over several blocks."""
    rng = random.Random(size)
    data = []
    for k in range(3000):
        n = 90_000 if k in (700, 2999) else rng.randrange(20, 200)
        data.append(some_reads()[0] | {"qname": f"read{k}", "pos": k, "seq": "".join(rng.choices("ACGT", k=n)), "qual": [rng.randrange(2, 41) for _ in range(n)], "cigar": [{"op": 0, "len": n}]})
    contigs = [(f"contig{i}", 10_000 + i) for i in range(9_000)] + [("c1", 1000), ("c2", 2000)]  # the header takes several blocks
    (tmp_path / "x.bam").write_bytes(bam.bam_bytes(data, contigs))
    reads = bam.read_bam(spark, str(tmp_path / "x.bam"), size)
    assert reads.rdd.getNumPartitions() == -(-(tmp_path / "x.bam").stat().st_size // size)
    got = reads.orderBy("ordinal").select("qname", "pos", "chrom", F.length("seq").alias("n")).collect()
    assert [tuple(r) for r in got] == [(d["qname"], d["pos"], "c1", len(d["seq"])) for d in data]
    assert bam.read_contigs(spark, str(tmp_path / "x.bam")).count() == 9_002


@pytest.mark.parametrize("size", [40, 1000, 1 << 25])
def test_fastq_ranges_give_each_record_once(spark, tmp_path, size):
    """Qualities that begin with @ and +, and ranges of less than a record."""
    rng = random.Random(4)
    data = [(f"r{k}", "".join(rng.choices("ACGT", k=(n := rng.randrange(1, 60)))), rng.choice("@+I") + "".join(rng.choices("@+I#", k=n - 1))) for k in range(200 if size < 100 else 3000)]
    (tmp_path / "x.fastq").write_text("".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in data))
    assert rows(text.read_fastq(spark, str(tmp_path / "x.fastq"), size), "name", "seq", "qual") == sorted(data)


def test_sequences_over_chunks(spark):
    rng = random.Random(2)
    seqs = {f"c{i}": "".join(rng.choices("ACGT", k=n)) for i, n in enumerate((700, 64, 3))}
    cut = text.chunks(spark.createDataFrame(list(seqs.items()), "chrom string, seq string"), 32)
    where = [(c, lo, lo + n, k) for c in seqs for lo in (0, 1, 31, 32, 63, 400) for k, n in enumerate((1, 31, 33, 200))] * 2
    df = spark.createDataFrame([*where, ("c0", -5, 3, 9), ("x", 0, 5, 9), ("c0", 5, 5, 9)], "chrom string, start long, end long, k long")
    got = sorted(tuple(r) for r in text.fetch(df, cut, 32).collect())
    assert got == sorted((c, lo, hi, k, s) for c, lo, hi, k in [*where, ("c0", -5, 3, 9)] if (s := seqs[c][max(lo, 0) : hi]))


@pytest.mark.parametrize("seed", range(2))
def test_stretches_do_not_change_islands(spark, seed, monkeypatch):
    data = [(c, s, e, k % 5) for k, (c, s, e) in enumerate(spans(150, seed) * 2)]  # each span twice
    df = spark.createDataFrame(data, "chrom string, start long, end long, item long")

    def all_of():
        out = [rows(intervals.interval_union(df, gap), "chrom", "start", "end") for gap in (0, 30)]
        out += [rows(evidence.merge_repeats(df, share, 1), "chrom", "start", "end", "item") for share in (0.2, 0.6)]
        return out + [rows(evidence.discordant_islands(df), "chrom", "start", "end", "discordants")]

    whole = all_of()
    monkeypatch.setattr(intervals, "STRETCH", 200)
    assert all_of() == whole


def test_sam_fastq_fasta_and_bed(spark, tmp_path):
    (tmp_path / "x.bam").write_bytes(bam.bam_bytes(some_reads(), [("c1", 1000), ("c2", 2000)]))
    reads = bam.read_bam(spark, str(tmp_path / "x.bam"))
    text.write_sam(reads, str(tmp_path / "sam"))
    again = text.read_sam(spark, str(tmp_path / "sam"))
    for c in ("qname", "flag", "chrom", "pos", "seq", "sa", "nm", "mq", "tlen"):
        assert rows(again, "qname", c) == rows(reads, "qname", c)
    assert again.orderBy("qname").first().cigar == reads.orderBy("qname").first().cigar
    fq = spark.createDataFrame([("a", "ACGT", "@@II"), ("b", "GG", "+I")], "name string, seq string, qual string")
    text.write_fastq(fq, str(tmp_path / "fq"))
    assert rows(text.read_fastq(spark, str(tmp_path / "fq")), "name", "seq", "qual") == rows(fq, "name", "seq", "qual")
    (tmp_path / "g.fa").write_text(">c1 first\nACGT\nACG\n>c2\nTT\n")
    genome = text.read_fasta(spark, str(tmp_path / "g.fa"))
    assert rows(genome, "chrom", "seq") == [("c1", "ACGTACG"), ("c2", "TT")]
    where = spark.createDataFrame([("c1", 2, 5), ("c2", 1, 9)], "chrom string, start long, end long")
    assert rows(text.fetch(where, text.chunks(genome)), "bases") == [("GTA",), ("T",)]
    text.write_bed(where, str(tmp_path / "bed"))
    assert rows(text.read_bed(spark, str(tmp_path / "bed")), "chrom", "start", "end") == rows(where, "chrom", "start", "end")


def test_simulated_reads_lie_on_their_circle(spark, tmp_path):
    rng = random.Random(5)
    genome = spark.createDataFrame([(f"c{i}", "".join(rng.choices("ACGT", k=900))) for i in range(2)], "chrom string, seq string")
    made, reads = pipelines.simulate(spark, genome, 150, read_length=60, insert=120, coverage=8.0)
    seqs = {r.circle: (r.chrom, r.start, r.end) for r in made.collect()}
    genomes = {r.chrom: r.seq for r in genome.collect()}
    found = reads.withColumn("n", R.parse_simulated_name(F.col("name"))).collect()
    assert len(found) > 150 >= len(found) - (350 * 8) // 120  # whole circles until there are more
    for r in found:
        c, s, e = seqs[r.circle]
        ring = genomes[c][s:e] * 3
        assert ring[r.left : r.left + 60] == r.seq1 and ring[r.right : r.right + 60] == r.seq2[::-1].translate(str.maketrans("ACGT", "TGCA"))
        assert (r.kind == 1) == (r.left + 60 > e - s)
        for at, seq in ((r.n.left, r.seq1), (r.n.right, r.seq2[::-1].translate(str.maketrans("ACGT", "TGCA")))):
            assert "".join(genomes[c][x.start : x.end] for x in at) == seq
        assert len(r.n.left) == 1 + (r.kind == 1) and (r.n.kind, r.n.circle, r.n.chrom) == (r.kind, r.circle, c)
    assert rows(reads, "name") == rows(pipelines.simulate(spark, genome.repartition(7), 150, read_length=60, insert=120, coverage=8.0)[1], "name")
    skipped, _ = pipelines.simulate(spark, genome, 150, read_length=60, insert=120, coverage=8.0, exclude=spark.createDataFrame([("c0", 0, 900)], "chrom string, start long, end long"))
    assert {r.chrom for r in skipped.collect()} == {"c1"}
    perfect = simulate.fastq(reads).collect()
    assert all(r.name.endswith(f"  {r.mate}:N:0:CGCTGTG") and set(r.qual) == {"I"} for r in perfect)
    seen = simulate.fastq(reads, errors=True, insertions=(0.02, 0.02), deletions=(0.02, 0.02), read_length=60)
    text.write_fastq(seen.where("mate = 1"), str(tmp_path / "fq"))
    back = text.read_fastq(spark, str(tmp_path / "fq")).collect()
    first = {r.name: r.seq for r in perfect if r.mate == 1}
    assert len(back) == len(found) and all(len(r.seq) == len(r.qual) for r in back) and 0 < sum(first[r.name] != r.seq for r in back)
    changed = simulate.mutate(genome, 1, 0.05, 0.02).collect()
    assert all(c.seq != genomes[c.chrom] and abs(len(c.seq) - 900) < 60 for c in changed)


def test_names_of_simulated_reads_are_parsed(spark):
    names = ["0|chr7|143914458:143914558|143914642:143914742|0|0  1:N:0:CGCTGTG", "12|chr7|5:60-1:46|70:170|1|3  2:N:0:CGCTGTG-1"]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "name string").select(R.parse_simulated_name(F.col("name")).alias("n")).collect()]
    assert [tuple(x) for x in got[0].left] == [(143914458, 143914558)] and (got[0].kind, got[0].circle, got[0].mate) == (0, 0, "1")
    assert [tuple(x) for x in got[1].left] == [(5, 60), (1, 46)] and (got[1].number, got[1].kind, got[1].circle, got[1].mate) == (12, 1, 3, "2")


def test_realign_recovers_a_planted_circle(spark):
    """Split reads and outward pairs placed over the join of a circle give its ends."""
    rng = random.Random(9)
    seq = "".join(rng.choices("ACGT", k=6000))
    start, end, data, n = 2000, 2600, [], 0
    base = dict(ref_id=0, chrom="c", next_ref_id=0, next_chrom="c", mapq=60, qual=[30] * 100, xa=None, nm=0, mq=60, tags={})
    cig = lambda *x: [{"op": o, "len": k} for o, k in x]
    for k in range(20):
        left, right = start + 5 * k, end - 150 - 3 * k
        for mate, pos, flag, other in ((1, right, 97, left), (2, left, 145, right)):
            data.append(base | dict(ordinal=n, qname=f"d{k}", flag=flag, pos=pos, cigar=cig((0, 100)), next_pos=other, tlen=0, seq=seq[pos : pos + 100], sa=None))
            n += 1
        clip = 30 + k
        split = seq[end - clip : end] + seq[start : start + 100 - clip]
        data.append(base | dict(ordinal=n, qname=f"s{k}", flag=97, pos=end - 200, cigar=cig((0, 100)), next_pos=start, tlen=0, seq=seq[end - 200 : end - 100], sa=None))
        data.append(base | dict(ordinal=n + 1, qname=f"s{k}", flag=145, pos=start, cigar=cig((4, clip), (0, 100 - clip)), next_pos=end - 200, tlen=0, seq=split, sa=f"c,{end - clip + 1},-,{clip}M{100 - clip}S,60,0;"))
        n += 2
    for k in range(50):
        pos = 100 * k
        data.append(base | dict(ordinal=n, qname=f"p{k}", flag=99, pos=pos, cigar=cig((0, 100)), next_pos=pos + 100, tlen=200 + k % 5, seq=seq[pos : pos + 100], sa=None))
        data.append(base | dict(ordinal=n + 1, qname=f"p{k}", flag=147, pos=pos + 100, cigar=cig((0, 100)), next_pos=pos, tlen=-200, seq=seq[pos + 100 : pos + 200], sa=None))
        n += 2
    from annulus.schema import READS

    reads = spark.createDataFrame(data, READS)
    contigs = spark.createDataFrame([(0, "c", 6000)], "ref_id int, chrom string, length long")
    genome = spark.createDataFrame([("c", seq)], "chrom string, seq string")
    p = pipelines.Params(allele_frequency=0.0, merge_share=0.9)
    circles = pipelines.realign(pipelines.extract(reads), reads, reads, contigs, genome, p).collect()
    assert any(abs(r.start - start) <= 2 and abs(r.end - end) <= 2 and r.sc >= 10 for r in circles), circles
