"""Steps that the evidence queries and the workflows share do their work once, and on the columns that they need."""

from pyspark.sql import functions as F

from annulus.operators import intervals, pairs
from annulus.plans import catalog, pipelines
from test_queries import DATA


def test_depth_counts_the_spans_once(spark):
    reads = catalog.proxy_reads(spark, str(DATA))
    spans = reads.select("chrom", F.col("pos").alias("start"), (F.col("pos") + 100).alias("end"))
    points = spark.createDataFrame([("chr1", 900), ("chr1", 5000), ("chr2", 10), ("chr9", 3), (None, 5), ("chr1", None)], "chrom string, point long")
    found = intervals.point_depth(points, spans)
    rows = {(r.chrom, r.point): r.depth for r in found.collect()}
    held = spans.collect()
    assert rows == {(c, p): sum(1 for s in held if p is not None and s.chrom == c and s.start <= p < s.end) for c, p in rows} and sum(rows.values()) > 0
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("SortMergeJoin") + plan.count("BroadcastHashJoin") > 0 and "ReusedExchange" in plan


def test_insert_size_reads_no_bases(spark, tmp_path):
    catalog.proxy_reads(spark, str(DATA)).write.parquet(f"{tmp_path}/reads")
    found = pairs.insert_size(spark.read.parquet(f"{tmp_path}/reads"), 30, 1000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.first().pairs > 0 and "cigar" in plan and "seq#" not in plan and "qual#" not in plan


def test_loose_clips_are_kept(spark, monkeypatch):
    names, keep = [], pipelines.Store.keep
    monkeypatch.setattr(pipelines.Store, "keep", lambda self, df, name: names.append(name) or keep(self, df, name))
    reads = catalog.proxy_reads(spark, str(DATA))
    pipelines._evidence(pipelines.extract(reads), catalog.proxy_genome(spark, str(DATA)), catalog.proxy_contigs(spark), (280.0, 200.0), pipelines.Params(only_discordants=False), pipelines.Store(spark, "loose"))
    assert "loose" in names


def test_genome_is_that_of_the_first_reads(spark):
    reads = catalog.orders_view(spark, str(DATA), catalog.READS_SQL).select("chrom", F.floor(F.col("pos") / 100).alias("k"), "rid", "seq").collect()
    first = {}
    for r in sorted(reads, key=lambda r: r.rid):
        first.setdefault((r.chrom, r.k), r.seq)
    genome = catalog.proxy_genome(spark, str(DATA))
    assert {r.chrom: r.seq for r in genome.collect()} == {c: "".join(first[x] for x in sorted(first) if x[0] == c) for c in {c for c, _ in first}}
    aggregated = genome._jdf.queryExecution().optimizedPlan().toString()
    assert aggregated.count("md5") and "min_by" not in aggregated
