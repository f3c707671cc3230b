"""Interval algebra: overlap joins, island merges, coverage sweeps and tiles.

Intervals are half-open, [start, end), on a chromosome.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annulus.functions.reads import reciprocal

C = F.col

#: Bases of a bin of the overlap join.
BIN = 500


def overlap_join(left: DataFrame, right: DataFrame, bin_size: int = BIN, how: str = "inner") -> DataFrame:
    """Pairs of overlapping intervals (columns of the right that clash get the prefix r_).

    Both sides are dealt out by (chrom, bin); a pair is kept only in the first bin that
    both reach, so none comes twice and no chromosome is a single key. how: inner, or left_anti
    (rows of the left that overlap nothing).
    """
    if how == "left_anti":
        keyed = left.withColumn("_row", F.struct(*left.columns))
        hit = overlap_join(left.select("chrom", "start", "end").distinct(), right.select("chrom", "start", "end"), bin_size)
        return keyed.drop("_row").join(hit.select("chrom", "start", "end").distinct(), ["chrom", "start", "end"], "left_anti")
    clash = set(left.columns)
    renamed = right.select([F.col(c).alias(f"r_{c}" if c in clash else c) for c in right.columns])
    lo, hi = lambda s: F.floor(F.col(s) / bin_size), lambda e: F.floor((F.col(e) - 1) / bin_size)
    a = left.where("end > start").withColumn("_a0", lo("start")).withColumn("_bin", F.explode(F.sequence(lo("start"), hi("end"))))
    b = renamed.where("r_end > r_start").withColumn("_b0", lo("r_start")).withColumn("_rbin", F.explode(F.sequence(lo("r_start"), hi("r_end"))))
    met = (F.col("chrom") == F.col("r_chrom")) & (F.col("_bin") == F.col("_rbin"))
    near = (F.col("start") < F.col("r_end")) & (F.col("end") > F.col("r_start")) & (F.col("_bin") == F.greatest("_a0", "_b0"))
    return a.join(b, met & near).drop("_a0", "_b0", "_bin", "_rbin")


def overlap_rows(left: DataFrame, right: DataFrame, bin_size: int = BIN) -> DataFrame:
    """overlap_join for a right side with many rows to a span: its different spans meet the left once, its rows then take over their span's pairs.

    The sort-merge join gives the pairs row by row, with the rows of a span one after another and the left's rows each time in
    the same order, so that Parquet keeps what comes again as runs and repeats; in any other order a pair takes some four bytes.
    """
    clash = set(left.columns)
    rows = right.select([F.col(c).alias(f"r_{c}" if c in clash else c) for c in right.columns])
    met = overlap_join(left, right.select("chrom", "start", "end").distinct(), bin_size)
    return rows.hint("merge").join(met, ["r_chrom", "r_start", "r_end"]).select(*left.columns, *rows.columns)


def exclude_regions(intervals: DataFrame, regions: DataFrame) -> DataFrame:
    """Intervals that overlap none of the regions."""
    return overlap_join(intervals, regions, how="left_anti")


#: Bases of the stretches in which the depth of points is counted.
RANK_STRETCH = 1 << 14


def point_depth(points: DataFrame, spans: DataFrame, stretch: int = RANK_STRETCH) -> DataFrame:
    """Number of spans over each point (chrom, point), 0 where there is none.

    The depth is a difference of two ranks: starts up to the point less ends up to it. Starts and ends are
    counted by place before any shuffle, so what moves are counts of places and not reads; a point adds up the
    places of its own stretch on top of one number for all stretches before.
    """
    wanted = points.select("chrom", "point").where("chrom IS NOT NULL AND point IS NOT NULL").distinct().withColumn("_part", F.floor(C("point") / stretch))
    change = lambda at, d: F.struct(C(at).cast("long").alias("at"), F.lit(d).cast("long").alias("d"))
    edges = spans.where("end > start").select("chrom", F.explode(F.array(change("start", 1), change("end", -1))).alias("e")).select("chrom", "e.at", "e.d")
    # counted once, for both uses below: Spark runs the exchange of equal plans once, and with these filters they are equal
    placed = edges.withColumn("_part", F.floor(C("at") / stretch)).where("chrom IS NOT NULL AND _part IS NOT NULL")
    counted = placed.groupBy("chrom", "_part", "at").agg(F.sum("d").alias("d")).where("d <> 0")
    here = wanted.select("chrom", "_part").distinct()
    before = Window.partitionBy("chrom").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = counted.groupBy("chrom", "_part").agg(F.sum("d").alias("d")).union(here.withColumn("d", F.lit(0).cast("long")))
    base = sums.groupBy("chrom", "_part").agg(F.sum("d").alias("d")).withColumn("_base", F.coalesce(F.sum("d").over(before), F.lit(0))).drop("d")
    near = counted.join(here, ["chrom", "_part"], "left_semi")
    rows = near.select("chrom", "_part", "at", "d", F.lit(False).alias("_asked")).union(
        wanted.select("chrom", "_part", C("point").cast("long"), F.lit(0).cast("long"), F.lit(True))
    )
    along = Window.partitionBy("chrom", "_part").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = rows.withColumn("_within", F.sum("d").over(along)).where("_asked").join(base, ["chrom", "_part"])
    hits = ranked.select("chrom", C("at").alias("point"), (C("_base") + C("_within")).alias("depth"))
    return points.join(hits, ["chrom", "point"], "left").withColumn("depth", F.coalesce("depth", F.lit(0)))


def box_counts(boxes: DataFrame, points: DataFrame, wide: int, keys: list[str]) -> DataFrame:
    """boxes (keys, x, y), no two alike, with inside: the sum of n of points (keys, x, y, n) in [x, x + wide) by [y, y + wide).

    A point stands in one block of x of each power of two, and a box's x fall into a few whole blocks (two a power at most); inside a block
    the points up to either border of y are a running sum. So a point gives log2(wide) rows and a box at most some
    six times as many, however many points stand in it. Running sums go along strips little wider than a box. Nulls stand in no box.
    """
    if wide < 1:
        return boxes.select(*keys, "x", "y", F.lit(0).cast("long").alias("inside"))
    powers, strip = range(wide.bit_length()), wide.bit_length()
    block = lambda at, k: F.shiftright(at.cast("long"), k)
    node = lambda k, no: F.struct(F.lit(k).alias("k"), no.alias("no"))
    placed = points.where("x IS NOT NULL AND y IS NOT NULL").withColumn("_b", F.explode(F.array(*[node(k, block(C("x"), k)) for k in powers])))
    blank = F.lit(None).cast("long")
    held = placed.select(*keys, "_b", C("y").cast("long").alias("_at"), "n", blank.alias("x"), blank.alias("y"), F.lit(0).alias("_sign"))
    whole = []
    for k in powers:
        first, behind = block(C("x") + ((1 << k) - 1), k), block(C("x") + wide, k)
        some = first < behind
        whole += [F.when(some & (first % 2 != 0), node(k, first)), F.when(some & (behind % 2 != 0), node(k, behind - 1))]
    edge = lambda at, sign: F.struct(at.cast("long").alias("at"), F.lit(sign).alias("sign"))
    low, high = C("y") - 1, C("y") + (wide - 1)
    between = F.when(block(low, strip) != block(high, strip), edge(((block(low, strip) + 1) * (1 << strip)) - 1, 1))
    asked = boxes.where("x IS NOT NULL AND y IS NOT NULL").withColumn("_b", F.explode(F.array_compact(F.array(*whole))))
    asked = asked.withColumn("_e", F.explode(F.array_compact(F.array(edge(low, -1), edge(high, 1), between))))
    asked = asked.select(*keys, "_b", C("_e.at").alias("_at"), F.lit(0).cast("long").alias("n"), C("x").cast("long").alias("x"), C("y").cast("long").alias("y"), C("_e.sign").alias("_sign"))
    rows = held.union(asked).withColumns({"_k": C("_b.k"), "_no": C("_b.no"), "_strip": block(C("_at"), strip)}).drop("_b")
    along = Window.partitionBy(*keys, "_k", "_no", "_strip").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = rows.withColumn("_up", F.sum("n").over(along)).where("_sign <> 0")
    return ranked.groupBy(*keys, "x", "y").agg(F.sum(C("_sign") * C("_up")).alias("inside"))


#: Bases of the stretches by which a key's rows are dealt out.
STRETCH = 1_000_000

#: A sum of a merge: the function that makes it of rows, and then again of what it made (sum, max, min).
Sums = dict[str, Callable[[str], Column]]


def merge_islands(spans: DataFrame, keys: list[str], begins: Callable[[Column, Column], Column], sums: Sums, stretch: int | None = None) -> DataFrame:
    """One row for each island of spans (keys, start, end): keys, start, end (the farthest), last_end (of its last span) and the sums.

    Spans of a key stand by (start, end). One begins an island where begins(before, span) holds or is null;
    before has start and end of the span just before it, and reach, the farthest end of all before it. A span must not begin an island
    behind itself, as spans that are equal count as one. Null keys are keys like others.

    Nothing that is as large as a key goes through one task: equal spans are summed before any shuffle, the
    rest is dealt out by stretches of a key, and only a stretch's first and last island meet those of the stretches
    beside it. With reach in begins, spans must lie inside their stretch (see ``within_stretches``).
    """
    folded = lambda: [f(name).alias(name) for name, f in sums.items()]
    whole = [F.min("start").alias("start"), F.max("end").alias("end"), F.min("_first").alias("_first"), F.max("_last").alias("_last")]
    once = spans.groupBy(*keys, "start", "end").agg(*folded()) if sums else spans.select(*keys, "start", "end").distinct()
    span = F.struct("start", "end")
    once = once.withColumns({"_part": F.floor(C("start") / (stretch or STRETCH)), "_first": span, "_last": span})

    def running(df: DataFrame, lane: list[str], order: list[str], kept_apart: Column) -> DataFrame:
        along = Window.partitionBy(*lane).orderBy(*order)
        reach = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
        last = F.lag("_last").over(along)
        before = F.struct(last["start"].alias("start"), last["end"].alias("end"), reach.alias("reach"))
        flagged = df.withColumn("_new", (kept_apart | F.coalesce(begins(before, C("_first")), F.lit(True))).cast("int"))
        return flagged.withColumn("_no", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")

    inside = [*keys, "_part"]
    local = running(once, inside, ["start", "end"], F.lit(False)).groupBy(*inside, "_no").agg(*whole, *folded())
    # islands between the first and the last of a stretch are whole; the others go along the key, two for each stretch
    ends = (C("_no") == 1) | F.lead("_no").over(Window.partitionBy(*inside).orderBy("_no")).isNull()
    dealt = local.withColumn("_lane", F.when(~ends, C("_part"))).withColumnRenamed("_no", "_at")
    across = running(dealt, [*keys, "_lane"], ["_part", "_at"], C("_lane").isNotNull() | (C("_at") > 1))
    out = across.groupBy(*keys, "_lane", "_no").agg(*whole, *folded())
    return out.select(*keys, "start", "end", C("_last.end").alias("last_end"), *sums)


def within_stretches(spans: DataFrame, stretch: int | None = None) -> DataFrame:
    """spans cut at the borders of stretches; _own is 1 in the first piece of each, 0 in the others."""
    size = stretch or STRETCH
    first = F.floor(C("start") / size)
    parts = F.sequence(first, F.greatest(first, F.floor((C("end") - 1) / size)))
    piece = spans.withColumn("_own", first).withColumn("_part", F.explode(parts))
    low, high, own = C("_part") * size, (C("_part") + 1) * size, C("_part") == C("_own")
    cut = {"start": F.greatest(C("start"), low), "end": F.least(C("end"), high), "_own": own.cast("int")}
    return piece.withColumns(cut).drop("_part")


def interval_union(df: DataFrame, gap: int = 0, sums: Sums | None = None) -> DataFrame:
    """Unions (chrom, start, end) of intervals that lie no more than gap apart; sums add up columns of within_stretches(df)."""
    apart = lambda before, span: span["start"] > before["reach"] + gap
    pieces = df if "_own" in df.columns else within_stretches(df.select("chrom", "start", "end"))
    return merge_islands(pieces, ["chrom"], apart, sums or {}).drop("last_end")


def merge_touching(df: DataFrame, keys: list[str], sums: Sums) -> DataFrame:
    """Islands of spans that begin at or before the end of the span before them: first start, last end and the sums."""
    found = merge_islands(df, keys, lambda before, span: span["start"] > before["end"], sums)
    return found.withColumn("end", C("last_end")).drop("last_end")


def merge_reciprocal(df: DataFrame, share: float, sums: Sums, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Islands of spans whose overlap with the span before comes to 2 * share of the two lengths together."""
    apart = lambda before, span: reciprocal(before["start"], before["end"], span["start"], span["end"]) < 2 * share
    return merge_islands(df, list(keys), lambda before, span: F.when(before["start"].isNotNull(), apart(before, span)), sums)


def coverage_runs(spans: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Maximal runs (chrom, start, end, depth) of equal depth over 0.

    Changes of depth are summed by place, then along each stretch of a chromosome, on top of
    what the stretches before it come to; so a chromosome is no single task.
    """
    edges = spans.select("chrom", F.col("start").alias("at"), F.lit(1).alias("d")).union(spans.select("chrom", F.col("end").alias("at"), F.lit(-1).alias("d")))
    net = edges.groupBy("chrom", "at").agg(F.sum("d").alias("d")).where("d <> 0").withColumn("part", F.floor(F.col("at") / stretch))
    parts = Window.partitionBy("chrom").orderBy("part")
    before = (
        net.groupBy("chrom", "part")
        .agg(F.sum("d").alias("total"), F.min("at").alias("first"))
        .withColumn("base", F.coalesce(F.sum("total").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("chrom", "part", "base", F.lead("first").over(parts).alias("next"))
    )
    along = Window.partitionBy("chrom", "part").orderBy("at")
    return (
        net.join(before, ["chrom", "part"])
        .withColumn("depth", F.col("base") + F.sum("d").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("end", F.coalesce(F.lead("at").over(along), F.col("next")))
        .where("depth > 0")
        .select("chrom", F.col("at").alias("start"), "end", "depth")
    )


def peaks(runs: DataFrame, gap: int) -> DataFrame:
    """Runs merged over gaps up to gap, with the plain mean of their depths."""
    pieces = within_stretches(runs).withColumn("_depth", C("depth") * C("_own"))
    found = interval_union(pieces, gap, {"_depth": F.sum, "_own": F.sum})
    return found.select("chrom", "start", "end", (C("_depth") / C("_own")).alias("mean_depth"))


def tiles(intervals: DataFrame, longest: int = 500, size: int = 300) -> DataFrame:
    """Intervals longer than longest cut in tiles of size; the last may run over the end."""
    cut = F.sequence(F.col("start"), F.col("end") - 1, F.lit(size).cast("long"))
    parts = F.when(F.col("end") - F.col("start") > longest, F.transform(cut, lambda s: F.struct(s.alias("start"), (s + size).alias("end"))))
    rows = intervals.select("chrom", F.explode(F.coalesce(parts, F.array(F.struct("start", "end")))).alias("t"))
    return rows.select("chrom", "t.start", "t.end")
