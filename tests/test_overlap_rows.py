"""Overlaps of many rows with equal spans, against the plain overlap join."""

from itertools import groupby

from annulus.operators import intervals
from annulus.plans import catalog
from test_queries import DATA


def test_rows_equal_the_overlap_join(spark):
    left = spark.createDataFrame([("a", 10, 700, 1), ("a", 10, 700, 2), ("a", 650, 660, 3), ("b", 0, 5, 4), ("a", 5, 5, 5), (None, 0, 90, 6)], "chrom string, start long, end long, tile int")
    spans = [("a", 0, 11), ("a", 0, 10), ("a", 640, 1700), ("b", 4, 9), ("c", 0, 9), (None, 0, 9), ("a", None, 9), ("a", 30, 20)]
    right = spark.createDataFrame([(*s, k) for s in spans for k in range(3)] + [(*spans[0], 0)], "chrom string, start long, end long, rid int")
    plain, rows = intervals.overlap_join(left, right), intervals.overlap_rows(left, right)
    assert plain.columns == rows.columns
    assert sorted(map(str, rows.collect())) == sorted(map(str, plain.collect())) and rows.count() == 2 * 4 + 2 * 3 + 3 + 3


def test_rows_of_a_span_stand_together(spark):
    """So that files keep them as repeats: each span is one run of the result, each row one run inside it, with the same tiles in the same order."""
    place = {r.rid: (r.chrom, r.pos) for r in catalog.aln(spark, str(DATA)).collect()}
    found = [(place[r.rid], r.rid, (r.t0, r.t1)) for r in catalog.queries()["tile_read_overlap_join"](spark, str(DATA)).collect()]
    spans = [at for at, _ in groupby(r[0] for r in found)]
    rows = [rid for rid, _ in groupby(r[1] for r in found)]
    assert len(spans) == len(set(spans)) and len(rows) == len(set(rows))
    for _, same in groupby(found, lambda r: r[0]):
        assert len({tuple(t for _, _, t in one) for _, one in groupby(same, lambda r: r[1])}) == 1
