"""Alignment records derived from the orders table, for queries over the driver's tables.

READS_SQL is valid in Spark SQL and DuckDB alike; ``proxy_reads`` gives its rows the reads schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col
READ_LENGTH = 100
CONTIG_LENGTH = 20_800

ALN_SQL = """
SELECT o_orderkey AS rid, o_orderkey - o_orderkey % 2 AS qid, o_orderkey % 2 = 0 AS is_read1,
       concat('chr', CAST((o_orderkey - o_orderkey % 2) % 5 AS STRING)) AS chrom,
       ((o_orderkey - o_orderkey % 2) * 7919) % 20000 + (o_custkey * 3) % 700 AS pos,
       20 + o_custkey % 41 AS mapq, (o_custkey + o_orderkey) % 2 = 1 AS rev,
       CASE WHEN o_orderkey % 7 = 0 THEN 5 + o_custkey % 30 ELSE 0 END AS cl,
       CASE WHEN o_orderkey % 11 = 0 THEN 5 + o_custkey % 30 ELSE 0 END AS cr,
       o_orderkey % 13 = 0 AS hard, o_orderkey % 17 = 0 AS unmapped
FROM orders"""

#: Bases of the read a.rid; they follow from its number alone.
BASES_SQL = """substring(translate(concat(md5(CAST(a.rid AS STRING)), md5(CAST(a.rid + 1 AS STRING)), md5(CAST(a.rid + 2 AS STRING)), md5(CAST(a.rid + 3 AS STRING))),
                 '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 100)"""

READS_SQL = f"""
SELECT a.rid, a.qid, a.is_read1, a.chrom, a.pos, a.mapq, a.rev, a.cl, a.cr, a.hard, a.unmapped,
       m.pos AS mpos, m.rev AS mrev, m.mapq AS mmapq, m.unmapped AS munmapped,
       CASE WHEN a.rid % 19 <> 0 THEN m.mapq END AS mq,
       a.cl + a.cr > 15 AND (NOT a.hard OR a.rid % 2 = 0) AS has_sa,
       CASE WHEN a.pos + (a.rid % 9 - 4) * 150 < 1 THEN 1 ELSE a.pos + (a.rid % 9 - 4) * 150 END AS sa_pos,
       CASE WHEN a.rid % 3 = 0 THEN '+' WHEN a.rev THEN '-' ELSE '+' END AS sa_strand,
       a.cl + a.cr AS sa_m, a.rid % 4 AS sa_d, 10 + a.rid % 50 AS sa_mapq,
       a.rid % 4 = 0 AS has_xa, a.rid % 8 = 0 AS two_xa, a.pos + (a.rid % 11 - 5) * 40 AS xa_pos, a.rid % 5 AS nm,
       {BASES_SQL} AS seq
FROM ({ALN_SQL}) a JOIN ({ALN_SQL}) m ON a.qid = m.qid AND a.rid <> m.rid"""


def orders_view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A query over the orders table alone."""
    return spark.sql(sql.replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


def proxy_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = orders_view(spark, sf_dir, READS_SQL)
    op = lambda kind, n: F.struct(F.lit(kind).alias("op"), n.cast("int").alias("len"))
    side = lambda c: F.when(C(c) > 0, F.array(F.struct(F.when(C("hard"), 5).otherwise(4).alias("op"), C(c).cast("int").alias("len")))).otherwise(
        F.array().cast("array<struct<op:int,len:int>>")
    )
    cigar = F.concat(side("cl"), F.array(op(0, READ_LENGTH - C("cl") - C("cr"))), side("cr"))
    bit = lambda c, b: F.when(C(c), b).otherwise(0)
    inward = F.when(C("is_read1"), ~C("rev") & C("mrev")).otherwise(C("rev") & ~C("mrev"))
    flag = F.lit(1) + F.when(inward, 2).otherwise(0) + bit("unmapped", 4) + bit("munmapped", 8) + bit("rev", 16) + bit("mrev", 32) + F.when(C("is_read1"), 64).otherwise(128)
    text = lambda *xs: F.concat(*[x.cast("string") if not isinstance(x, str) else F.lit(x) for x in xs])
    sa = text(C("chrom"), ",", C("sa_pos"), ",", C("sa_strand"), ",", 100 - C("sa_m"), "S", C("sa_m"), "M", C("sa_d"), "D", ",", C("sa_mapq"), ",0;")
    one = text(C("chrom"), ",+", C("xa_pos"), ",60M2D40M,1;")
    xa = F.when(C("two_xa"), F.concat(one, one)).otherwise(one)
    return r.select(
        C("rid").alias("ordinal"),
        C("qid").cast("string").alias("qname"),
        flag.cast("int").alias("flag"),
        F.substring("chrom", 4, 1).cast("int").alias("ref_id"),
        "chrom",
        "pos",
        C("mapq").cast("int").alias("mapq"),
        cigar.alias("cigar"),
        F.substring("chrom", 4, 1).cast("int").alias("next_ref_id"),
        C("chrom").alias("next_chrom"),
        C("mpos").alias("next_pos"),
        F.when(C("is_read1"), C("mpos") + READ_LENGTH - C("pos")).otherwise(C("mpos") - C("pos") - READ_LENGTH).alias("tlen"),
        "seq",
        F.array_repeat(F.lit(30), READ_LENGTH).alias("qual"),
        F.when(C("has_sa"), sa).alias("sa"),
        F.when(C("has_xa"), xa).alias("xa"),
        C("nm").cast("int").alias("nm"),
        C("mq").cast("int").alias("mq"),
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("tags"),
    )


def proxy_contigs(spark: SparkSession) -> DataFrame:
    return spark.range(5).select(C("id").cast("int").alias("ref_id"), F.concat(F.lit("chr"), C("id").cast("string")).alias("chrom"), F.lit(CONTIG_LENGTH).cast("long").alias("length"))
