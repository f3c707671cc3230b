"""Every query of the engine by name, with its SQL.

Queries run over proxies of the orders table; their SQL builds the same rows on its own.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annulus.functions import reads as R
from annulus.operators import balance as ba
from annulus.operators import coverage as cov
from annulus.operators import evidence as ev
from annulus.operators import intervals as iv
from annulus.operators import kernel as kn
from annulus.operators import pairs as pr
from annulus.operators import priors as pi
from annulus.operators import seeds as sd
from annulus.operators import simulate as sm
from annulus.plans import pipelines as pp
from annulus.plans.proxies import ALN_SQL, BASES_SQL, CONTIG_LENGTH, READS_SQL, orders_view, proxy_contigs, proxy_reads
from annulus.shared import Store

C = F.col
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
WITH = f"WITH aln AS ({ALN_SQL}), r AS ({READS_SQL})"
PAIRS = """, p AS (SELECT a.qid, a.chrom, a.pos AS p1, b.pos AS p2, a.rev AS v1, b.rev AS v2, a.mapq AS m1, b.mapq AS m2, a.cl + a.cr AS c1, b.cl + b.cr AS c2,
  a.unmapped AS u1, b.unmapped AS u2, a.rid AS id1, b.rid AS id2, a.mq AS q1, b.mq AS q2, a.hard AS h1, b.hard AS h2 FROM r a JOIN r b ON a.qid = b.qid AND a.is_read1 AND NOT b.is_read1)"""
OUT = "v2 AND NOT v1 AND p2 < p1 AND m1 >= {q} AND m2 >= {q}"
ROUND = lambda c, n=6: F.round(c, n)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def aln(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_view(spark, sf_dir, ALN_SQL)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aln(spark, sf_dir).select("rid", "chrom", C("pos").alias("start"), (C("pos") + 100).alias("end"))


def outward_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, chrom, start, end) over all pairs whose second read lies first."""
    pairs = pr.mate_pairs(proxy_reads(spark, sf_dir)).where("r2.pos < r1.pos")
    return pairs.select(C("r2.qname").cast("long").alias("qid"), C("r1.chrom").alias("chrom"), C("r2.pos").alias("start"), (C("r1.pos") + 100).alias("end"))


OUTWARD_SPANS = ", s AS (SELECT qid, chrom, p2 AS start, p1 + 100 AS \"end\" FROM p WHERE p2 < p1)"

# ---------------------------------------------------------------- pairs and extraction


@query(WITH + PAIRS + " SELECT qid, id1, id2 FROM p")
def mate_pairing(spark, sf_dir):
    return pr.mate_pairs(proxy_reads(spark, sf_dir)).select(C("r2.qname").cast("long").alias("qid"), C("r1.ordinal").alias("id1"), C("r2.ordinal").alias("id2"))


@query(WITH + PAIRS + f" SELECT qid, chrom, p1, p2 FROM p WHERE NOT u1 AND NOT u2 AND {OUT.format(q=30)}")
def discordant_pairs(spark, sf_dir):
    pairs = pr.mate_pairs(proxy_reads(spark, sf_dir)).where(pr.both_mapped() & pr.outward(30))
    return pairs.select(C("r1.qname").cast("long").alias("qid"), C("r1.chrom").alias("chrom"), C("r1.pos").alias("p1"), C("r2.pos").alias("p2"))


def _side(read: str, mate: str, discordant: bool = True, soft: bool = True, hard: bool = True) -> str:
    c, h, m, q, u = f"c{read}", f"h{read}", f"m{read}", f"q{read}", f"u{read}"
    kept = f"({c} > 0 AND NOT {h} AND {m} >= 10 AND {soft} OR {c} > 0 AND {h} AND ({m} >= 10 OR {q} IS NOT NULL) AND {hard})"
    clip = f"(NOT u1 AND NOT u2 OR u1 <> u2 AND NOT {u}) AND {kept}"
    mq = f"CASE WHEN d THEN m{mate} WHEN {q} IS NOT NULL THEN {q} WHEN u1 <> u2 THEN {m} ELSE m{mate} END"
    return f"SELECT id{read} AS rid, CAST({mq} AS INT) AS mq FROM o WHERE " + (f"d OR {clip}" if discordant else f"NOT d AND {clip}")


@query(WITH + PAIRS + f", o AS (SELECT *, NOT u1 AND NOT u2 AND {OUT.format(q=10)} AS d FROM p) {_side('1', '2')} UNION ALL {_side('2', '1')}")
def clip_routing(spark, sf_dir):
    return pp.extract(proxy_reads(spark, sf_dir)).select(C("ordinal").alias("rid"), "mq")


_O = f", o AS (SELECT *, NOT u1 AND NOT u2 AND {OUT.format(q=10)} AS d FROM p) "


@query(WITH + PAIRS + _O + _side("1", "2", discordant=False, soft=False) + " UNION ALL " + _side("2", "1", discordant=False, soft=False))
def clip_routing_hard_alone(spark, sf_dir):
    return pp.extract(proxy_reads(spark, sf_dir), discordant=False, soft=False).select(C("ordinal").alias("rid"), "mq")


@query(WITH + PAIRS + _O + _side("1", "2", hard=False) + " UNION ALL " + _side("2", "1", hard=False))
def clip_routing_without_hard(spark, sf_dir):
    return pp.extract(proxy_reads(spark, sf_dir), hard=False).select(C("ordinal").alias("rid"), "mq")


@query(
    WITH + PAIRS + ", f AS (SELECT p2 + 100 - p1 AS t FROM p WHERE m1 >= 30 AND m2 >= 30 AND NOT v1 AND v2 AND c1 = 0 AND c2 = 0 AND p2 + 100 - p1 > 0 ORDER BY id2 LIMIT 1000)"
    " SELECT count(*) AS pairs, round(avg(CAST(t AS DOUBLE)), 6) AS mean, round(stddev_pop(CAST(t AS DOUBLE)), 6) AS std FROM f"
)
def insert_size_dist(spark, sf_dir):
    return pr.insert_size(proxy_reads(spark, sf_dir), 30, 1000).select("pairs", ROUND("mean").alias("mean"), ROUND("std").alias("std"))


# ---------------------------------------------------------------- scalar functions


@query(
    WITH + " SELECT rid, cl + cr > 0 AND NOT hard AS soft, cl + cr > 0 AND hard AS hard_clipped, pos + 100 - cl - cr AS right_end, 100 - cl - cr AS aligned,"
    " CASE WHEN hard THEN 100 - cl - cr ELSE 100 END AS bases, CAST(100 AS BIGINT) AS read_bases FROM r"
)
def cigar_rightmost(spark, sf_dir):
    return proxy_reads(spark, sf_dir).select(
        C("ordinal").alias("rid"), R.is_soft_clipped().alias("soft"), R.is_hard_clipped().alias("hard_clipped"), R.rightmost().alias("right_end"),
        R.aligned_bases().alias("aligned"), R.query_length().alias("bases"), R.query_length(hard=True).alias("read_bases"),
    )


@query(
    WITH + " SELECT rid, chrom, sa_pos AS pos, sa_strand AS strand, CAST(sa_mapq AS INT) AS mapq, sa_pos - 1 + sa_m + sa_d AS right_end, sa_m AS span, sa_m + sa_d AS wide_span FROM r WHERE has_sa"
)
def sa_tag_parse(spark, sf_dir):
    r = proxy_reads(spark, sf_dir).where("sa IS NOT NULL").withColumn("s", R.supplementary())
    return r.select(
        C("ordinal").alias("rid"), C("s.chrom").alias("chrom"), C("s.pos").alias("pos"), C("s.strand").alias("strand"), C("s.mapq").alias("mapq"),
        R.rightmost_of_text(C("s.pos"), C("s.cigar")).alias("right_end"), R.genome_span(C("s.cigar")).alias("span"), R.genome_span(C("s.cigar"), True).alias("wide_span"),
    )


@query(
    WITH + ' SELECT chrom, CASE WHEN xa_pos < pos THEN xa_pos ELSE pos END AS start, CASE WHEN xa_pos < pos THEN pos + 100 ELSE xa_pos - 1 + 102 END AS "end", CAST(1 AS BIGINT) AS item'
    " FROM r WHERE has_xa AND NOT two_xa AND nm <= 2"
)
def xa_repeat_reads(spark, sf_dir):
    return ev.repeat_spans(proxy_reads(spark, sf_dir))


@query(
    WITH + " SELECT rid, CASE WHEN cl >= cr THEN 'L' ELSE 'R' END AS side, CASE WHEN cl >= cr THEN substring(seq, 1, CAST(cl AS INT)) ELSE substring(seq, CAST(101 - cr AS INT), CAST(cr AS INT)) END AS bases,"
    " CAST(CASE WHEN cl >= cr THEN cl ELSE cr END AS INT) AS quals FROM r WHERE cl + cr > 0 AND NOT hard"
)
def longest_clip(spark, sf_dir):
    r = proxy_reads(spark, sf_dir).withColumn("c", R.longest_clip()).where("c IS NOT NULL")
    return r.select(C("ordinal").alias("rid"), C("c.side").alias("side"), C("c.seq").alias("bases"), F.size("c.qual").alias("quals"))


@query(
    WITH + " SELECT DISTINCT CAST(mapq AS INT) AS mapq, round(pow(CAST(10 AS DOUBLE), -mapq / CAST(10 AS DOUBLE)), 9) AS error, round(1 - pow(CAST(10 AS DOUBLE), -mapq / CAST(10 AS DOUBLE)), 9) AS weight,"
    " CAST(round_even(-10 * log10(1 - CAST(mapq AS DOUBLE) / 64), 0) AS INT) AS phred FROM r"
)
def phred_prob(spark, sf_dir):
    m = C("mapq")
    return proxy_reads(spark, sf_dir).select("mapq").distinct().select(
        "mapq", ROUND(R.phred_to_prob(m), 9).alias("error"), ROUND(R.weight(m), 9).alias("weight"), R.prob_to_phred(m.cast("double") / F.lit(64.0)).alias("phred")
    )


@query(
    WITH + " SELECT rid, reverse(translate(seq, 'ACGT', 'TGCA')) AS revcomp, round((length(seq) - length(replace(seq, 'A', ''))) / CAST(length(seq) AS DOUBLE), 6) AS a,"
    " round((length(seq) - length(replace(seq, 'G', ''))) / CAST(length(seq) AS DOUBLE), 6) AS g, translate(seq, 'ATCG', '1234') AS codes, true AS any_base, seq LIKE '%A%' AS has_a FROM r"
)
def base_freqs(spark, sf_dir):
    s = C("seq")
    return proxy_reads(spark, sf_dir).select(
        C("ordinal").alias("rid"), R.reverse_complement(s).alias("revcomp"), ROUND(R.base_share(s, "A")).alias("a"), ROUND(R.base_share(s, "G")).alias("g"),
        F.array_join(F.transform(R.encode_bases(s), lambda x: x.cast("string")), "").alias("codes"), R.has_base(s).alias("any_base"), R.share_base(s, F.lit("A")).alias("has_a"),
    )


@query(
    WITH + " SELECT rid, concat(chrom, ',', CAST(pos + 1 AS STRING), ',+,', CAST(sa_m AS STRING), 'M,', CAST(mapq AS STRING), ',', CAST(nm AS STRING), ';') AS tag,"
    " concat(CAST(rid AS STRING), '|', chrom, '|', CAST(pos AS STRING), '|', CAST(mpos AS STRING), '|', CAST(rid % 4 AS STRING), '|7') AS name, round(sa_m * CAST(0.05 AS DOUBLE), 6) AS budget FROM r"
)
def read_names_and_tags(spark, sf_dir):
    r = orders_view(spark, sf_dir, READS_SQL)
    return r.select(
        "rid",
        R.supplementary_text(C("chrom"), C("pos") + 1, F.lit("+"), F.concat(C("sa_m").cast("string"), F.lit("M")), C("mapq"), C("nm")).alias("tag"),
        R.simulated_name(C("rid"), C("chrom"), C("pos").cast("string"), C("mpos").cast("string"), C("rid") % 4, F.lit(7)).alias("name"),
        ROUND(R.edit_budget(C("sa_m"), 0.05)).alias("budget"),
    )


@query(
    WITH + ", l AS (SELECT *, lag(pos) OVER (PARTITION BY chrom ORDER BY pos, rid) AS q FROM aln), o AS (SELECT rid, pos, q, least(pos, q) + 100 - greatest(pos, q) AS ov FROM l WHERE q IS NOT NULL)"
    " SELECT rid, ov AS overlap, round(2 * greatest(ov / CAST(100 AS DOUBLE), 0), 6) AS both, round(2 * (1 - 2 * abs(pos - q) / CAST(100 AS DOUBLE)), 6) AS closeness FROM o"
)
def merge_fractions(spark, sf_dir):
    before = F.lag("pos").over(Window.partitionBy("chrom").orderBy("pos", "rid"))
    a0, a1, b0, b1 = C("q"), C("q") + 100, C("pos"), C("pos") + 100
    return aln(spark, sf_dir).withColumn("q", before).where("q IS NOT NULL").select(
        "rid", R.overlap(a0, a1, b0, b1).alias("overlap"), ROUND(R.reciprocal(a0, a1, b0, b1)).alias("both"), ROUND(R.fraction(a0, a1, b0, b1, F.lit(False))).alias("closeness")
    )


# ---------------------------------------------------------------- intervals


@query(
    WITH + ', w AS (SELECT rid, chrom, pos AS start, pos + 100 + rid % 900 AS "end" FROM aln), n AS (SELECT * FROM (SELECT unnest(range(0, 10)) AS k))'
    ' SELECT chrom, start + 300 * k AS start, start + 300 * k + 300 AS "end" FROM w, n WHERE "end" - start > 500 AND start + 300 * k < "end"'
    ' UNION ALL SELECT chrom, start, "end" FROM w WHERE "end" - start <= 500'
)
def interval_tiles(spark, sf_dir):
    return iv.tiles(aln(spark, sf_dir).select("chrom", C("pos").alias("start"), (C("pos") + 100 + C("rid") % 900).alias("end")))


RUNS = """, e AS (SELECT chrom, pos AS place, 1 AS d FROM aln UNION ALL SELECT chrom, pos + 100, -1 FROM aln), net AS (SELECT chrom, place, sum(d) AS d FROM e GROUP BY chrom, place HAVING sum(d) <> 0),
runs AS (SELECT chrom, place AS start, CAST(lead(place) OVER w AS BIGINT) AS "end", CAST(sum(d) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth FROM net WINDOW w AS (PARTITION BY chrom ORDER BY place)),
g AS (SELECT * FROM runs WHERE depth > 0)"""


@query(WITH + RUNS + ' SELECT chrom, start, "end", depth FROM g')
def genomecov_bedgraph(spark, sf_dir):
    return iv.coverage_runs(spans(spark, sf_dir))


@query(
    WITH + RUNS + """, h AS (SELECT * FROM g WHERE depth >= 12), m AS (SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM h),
 i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 5 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM m)
 SELECT chrom, min(start) AS start, max("end") AS "end", round(avg(depth), 6) AS mean_depth FROM i GROUP BY chrom, island"""
)
def merge_peaks_mean(spark, sf_dir):
    return iv.peaks(iv.coverage_runs(spans(spark, sf_dir)).where("depth >= 12"), 5).withColumn("mean_depth", ROUND("mean_depth"))


@query(
    WITH + RUNS + """, h AS (SELECT * FROM g WHERE depth >= 12), m AS (SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM h),
 i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 5 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM m),
 k AS (SELECT chrom, min(start) AS start, max("end") AS "end", round(avg(depth), 6) AS mean_depth FROM i GROUP BY chrom, island)
 SELECT chrom, start, "end", mean_depth, row_number() OVER (ORDER BY mean_depth DESC, chrom, start, "end") AS place FROM k"""
)
def peaks_by_depth(spark, sf_dir):
    """Peaks numbered from the deepest."""
    found = iv.peaks(iv.coverage_runs(spans(spark, sf_dir)).where("depth >= 12"), 5).withColumn("mean_depth", ROUND("mean_depth"))
    return ba.by_depth(found)


@query(
    WITH + """, t AS (SELECT chrom, pos // 300 * 300 AS start, pos // 300 * 300 + 300 AS "end", CAST(sum(CASE WHEN pos < 600 THEN mapq * 40 ELSE mapq END) AS DOUBLE) AS weight FROM aln GROUP BY ALL),
 n AS (SELECT *, greatest(1, CAST(ceil(weight * 2 * 40 / (SELECT sum(weight) FROM t)) AS INT)) AS pieces FROM t),
 p AS (SELECT chrom, start, "end", unnest(range(0, pieces)) AS piece, pieces, weight / pieces AS weight FROM n),
 dealt AS (SELECT *, row_number() OVER (ORDER BY weight DESC, chrom, start, "end", piece) - 1 AS k FROM p)
 SELECT chrom, start, "end", CAST(piece AS INT) AS piece, CAST(pieces AS INT) AS pieces, round(weight, 6) AS weight, CAST(CASE WHEN k // 40 % 2 = 0 THEN k % 40 ELSE 39 - k % 40 END AS INT) AS chunk FROM dealt"""
)
def balanced_chunks(spark, sf_dir):
    """Tiles weighed by the qualities of their reads, those at the start of a contig forty times, dealt out over forty chunks."""
    bin_ = F.floor(C("pos") / 300) * 300
    weight = F.sum(F.when(C("pos") < 600, C("mapq") * 40).otherwise(C("mapq"))).alias("weight")
    tiles = aln(spark, sf_dir).groupBy("chrom", bin_.alias("start"), (bin_ + 300).alias("end")).agg(weight)
    return ba.balanced_chunks(tiles, 40).withColumn("weight", ROUND("weight"))


@query(WITH + ", t AS (SELECT DISTINCT chrom, pos AS t0, pos + 300 AS t1 FROM aln WHERE cl > 20) SELECT t.chrom, t0, t1, rid FROM t JOIN aln a ON a.chrom = t.chrom AND pos < t1 AND pos + 100 > t0")
def tile_read_overlap_join(spark, sf_dir):
    t = aln(spark, sf_dir).where("cl > 20").select("chrom", C("pos").alias("start"), (C("pos") + 300).alias("end")).distinct()
    return iv.overlap_rows(t, spans(spark, sf_dir)).select("chrom", C("start").alias("t0"), C("end").alias("t1"), "rid")


@query(WITH + ', x AS (SELECT DISTINCT chrom, pos AS x0, pos + 150 AS x1 FROM aln WHERE cr > 32) SELECT rid, chrom, pos AS start, pos + 100 AS "end" FROM aln a WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.chrom = a.chrom AND pos < x1 AND pos + 100 > x0)')
def exclude_regions_anti(spark, sf_dir):
    x = aln(spark, sf_dir).where("cr > 32").select("chrom", C("pos").alias("start"), (C("pos") + 150).alias("end")).distinct()
    return iv.exclude_regions(spans(spark, sf_dir), x).select("rid", "chrom", "start", "end")


@query(WITH + ', m AS (SELECT *, max(pos + 100) OVER (PARTITION BY chrom ORDER BY pos, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM aln WHERE cl > 0), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR pos > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY pos, rid ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT chrom, min(pos) AS start, max(pos + 100) AS "end" FROM i GROUP BY chrom, k')
def interval_union(spark, sf_dir):
    return iv.interval_union(aln(spark, sf_dir).where("cl > 0").select("chrom", C("pos").alias("start"), (C("pos") + 100).alias("end")))


@query(WITH + ", q AS (SELECT DISTINCT chrom, pos + 50 AS point FROM aln WHERE cl > 25) SELECT q.chrom, point, count(a.rid) AS depth FROM q LEFT JOIN aln a ON a.chrom = q.chrom AND pos <= point AND point < pos + 100 GROUP BY q.chrom, point")
def breakpoint_depth(spark, sf_dir):
    points = aln(spark, sf_dir).where("cl > 25").select("chrom", (C("pos") + 50).alias("point")).distinct()
    return iv.point_depth(points, spans(spark, sf_dir)).select("chrom", "point", "depth")


@query(WITH + " SELECT chrom, pos AS start FROM aln WHERE cl > 0 UNION ALL SELECT chrom, pos FROM aln WHERE cr > 0")
def union_all_intervals(spark, sf_dir):
    a = aln(spark, sf_dir)
    return a.where("cl > 0").select("chrom", C("pos").alias("start")).unionByName(a.where("cr > 0").select("chrom", C("pos").alias("start")))


# ---------------------------------------------------------------- priors

TILE = "concat(chrom, ':', CAST(pos - pos % 300 AS STRING)) AS tile_id"
PRIORS = f""", k AS (SELECT *, {TILE}, cl + cr > 0 AND NOT hard AS soft, cl + cr > 0 AND hard AS hardc,
 sa_mapq >= 20 AND sa_strand = CASE WHEN rev THEN '-' ELSE '+' END AS agrees, 1 - pow(CAST(10 AS DOUBLE), -sa_mapq / CAST(10 AS DOUBLE)) AS sw, 1 - pow(CAST(10 AS DOUBLE), -mq / CAST(10 AS DOUBLE)) AS mw,
 CASE WHEN hard THEN 100 - cl - cr ELSE 100 END AS qlen FROM r WHERE mapq >= 20),
c AS (SELECT *, CASE WHEN soft AND has_sa THEN CASE WHEN agrees AND pos > sa_pos THEN 'SA-L' WHEN agrees AND pos < sa_pos THEN 'SA-R' END
 WHEN NOT unmapped AND NOT munmapped AND rev AND NOT mrev AND pos < mpos THEN 'DR-R' WHEN NOT unmapped AND NOT munmapped AND NOT rev AND mrev AND mpos < pos THEN 'DR-L'
 WHEN NOT unmapped AND NOT munmapped AND rev = mrev AND soft AND NOT has_sa THEN 'SC-LR'
 WHEN NOT unmapped AND NOT munmapped AND rev = mrev AND hardc AND has_sa AND agrees THEN CASE WHEN pos > sa_pos THEN 'HA-L' WHEN pos < sa_pos THEN 'HA-R' END END AS rule FROM k),
pri AS (SELECT tile_id, qid, chrom, CASE WHEN rule LIKE 'SA%' THEN sa_pos - sa_m WHEN rule LIKE 'HA%' THEN sa_pos - 2 * sa_m WHEN rule LIKE 'DR%' THEN mpos ELSE 1 END AS start,
 CASE WHEN rule LIKE 'SA%' THEN sa_pos + sa_m WHEN rule LIKE 'HA%' THEN sa_pos + 2 * sa_m WHEN rule LIKE 'DR%' THEN mpos + qlen ELSE {CONTIG_LENGTH} END AS "end", CASE WHEN rule LIKE 'HA%' THEN 'SA' ELSE substring(rule, 1, 2) END AS read_type, substring(rule, 4, 2) AS orientation,
 CASE WHEN rule LIKE 'SA%' OR rule LIKE 'HA%' THEN sw WHEN rule LIKE 'DR%' THEN mw ELSE 0 END AS probability FROM c WHERE rule IS NOT NULL)"""


def tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proxy_reads(spark, sf_dir).withColumn("tile_id", F.expr("concat(chrom, ':', CAST(pos - pos % 300 AS STRING))"))


def priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pi.mate_priors(tiled(spark, sf_dir), proxy_contigs(spark), 20, False)


@query(WITH + PRIORS + ' SELECT tile_id, qid, chrom, start, "end", read_type, orientation, round(probability, 6) AS probability FROM pri')
def mate_priors(spark, sf_dir):
    return priors(spark, sf_dir).withColumn("qid", C("qname").cast("long")).withColumn("probability", ROUND("probability")).drop("qname")


MERGED = """, u AS (SELECT * FROM pri WHERE read_type <> 'SC' AND probability IS NOT NULL), b AS (SELECT *, lag("end") OVER (PARTITION BY tile_id, chrom ORDER BY start, "end") AS before FROM u),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR start > before THEN 1 ELSE 0 END) OVER (PARTITION BY tile_id, chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM b),
mg AS (SELECT tile_id, chrom, island, min(start) AS start, max({'a': start, 'b': "end"}).b AS "end", sum(probability) AS w FROM i GROUP BY tile_id, chrom, island),
nm AS (SELECT *, w / sum(w) OVER (PARTITION BY tile_id) AS probability FROM mg)"""


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pi.merge_priors(priors(spark, sf_dir).where("read_type <> 'SC' AND probability IS NOT NULL"))


@query(WITH + PRIORS + MERGED + ' SELECT tile_id, chrom, start, "end", round(probability, 5) AS probability FROM nm')
def prior_merge_normalise(spark, sf_dir):
    return merged(spark, sf_dir).drop("_right").withColumn("probability", ROUND("probability", 5))


RANKED = """, n2 AS (SELECT *, round(probability, 9) AS rp FROM nm), o AS (SELECT tile_id, max(CASE WHEN orientation LIKE '%R%' THEN 1 ELSE 0 END) AS pr FROM pri WHERE probability IS NOT NULL GROUP BY tile_id),
 f AS (SELECT tile_id, row_number() OVER (PARTITION BY tile_id ORDER BY rp DESC, start, "end") AS iteration, chrom, CAST(greatest(0, start - 371) AS BIGINT) AS start, CAST("end" + CASE WHEN pr = 1 THEN 371 ELSE 0 END AS BIGINT) AS "end", rp
 FROM n2 JOIN o USING (tile_id))"""


@query(WITH + PRIORS + MERGED + RANKED + ' SELECT tile_id, iteration, chrom, start, "end", round(rp, 5) AS probability FROM f WHERE rp >= CAST(0.2 AS DOUBLE)')
def mate_interval_extension(spark, sf_dir):
    return pi.mate_intervals(priors(spark, sf_dir).where("probability IS NOT NULL"), 371.4, 0.2).withColumn("probability", ROUND(ROUND("probability", 9), 5))


@query(WITH + PRIORS + MERGED + RANKED + ' SELECT tile_id, iteration, chrom, start, "end", round(rp, 5) AS probability FROM f WHERE iteration = 1')
def prior_argmax(spark, sf_dir):
    return pi.mate_intervals(priors(spark, sf_dir).where("probability IS NOT NULL"), 371.4, 0).withColumn("probability", ROUND(ROUND("probability", 9), 5))


# ---------------------------------------------------------------- evidence


@query(WITH + " SELECT rid, CASE WHEN cl > 0 AND NOT hard AND (mpos > pos OR pos < mpos + 100) THEN true WHEN cr > 0 AND NOT hard THEN mpos + 100 < pos OR pos > mpos WHEN cl > 0 AND NOT hard THEN false END AS away FROM r")
def noncolinearity(spark, sf_dir):
    r = proxy_reads(spark, sf_dir)
    return r.select(C("ordinal").alias("rid"), R.non_colinear(C("cigar"), C("pos"), C("next_pos"), C("next_pos") + 100).alias("away"))


SPLITS = f""", ev AS (SELECT concat(chrom, ':', CAST(pos - pos % 300 AS STRING)) AS tile_id, rid % 3 AS iteration, chrom, CASE WHEN pos < sa_pos THEN pos ELSE sa_pos - 1 END AS start,
 CASE WHEN pos < sa_pos THEN sa_pos - 1 + sa_m + sa_d - 1 ELSE pos + 100 - cl - cr END AS "end", CAST(qid AS STRING) AS read, round(greatest(cl, cr) * (1 - pow(CAST(10 AS DOUBLE), -sa_mapq / CAST(10 AS DOUBLE))), 2) AS score
 FROM r WHERE has_sa AND NOT hard AND cl + cr > 0 AND pos <> sa_pos AND sa_mapq > 20 AND sa_strand = CASE WHEN rev THEN '-' ELSE '+' END)"""
SUPPORT = ', sup AS (SELECT tile_id, iteration, chrom, start, "end", count(DISTINCT read) AS sc, sum(score) AS score FROM ev GROUP BY ALL)'
DISC = """, ds AS (SELECT concat(chrom, ':', CAST(pos - pos % 300 AS STRING)) AS tile_id, chrom, least(pos, mpos) AS start, greatest(pos, mpos) + CASE WHEN hard THEN 100 - cl - cr ELSE 100 END AS "end", CAST(qid AS STRING) AS read
 FROM r WHERE NOT munmapped AND (rev AND NOT mrev AND NOT is_read1 AND pos < mpos OR NOT rev AND mrev AND is_read1 AND mpos < pos))"""


@query(
    WITH + ', iv AS (SELECT DISTINCT tile_id, CAST(1 AS BIGINT) AS iteration, chrom, a AS start, b AS "end" FROM (SELECT concat(chrom, \':\', CAST(pos - pos % 300 AS STRING)) AS tile_id, chrom, pos - pos % 300 - 200 AS a, pos - pos % 300 + 500 AS b FROM aln))'
    + SPLITS + ' SELECT ev.tile_id, ev.chrom, ev.start, ev."end", read, score FROM ev JOIN r ON CAST(r.qid AS STRING) = ev.read AND r.has_sa AND NOT r.hard AND r.cl + r.cr > 0 AND ev.start = CASE WHEN r.pos < r.sa_pos THEN r.pos ELSE r.sa_pos - 1 END'
    ' AND ev."end" = CASE WHEN r.pos < r.sa_pos THEN r.sa_pos - 1 + r.sa_m + r.sa_d - 1 ELSE r.pos + 100 - r.cl - r.cr END AND r.rid % 3 = ev.iteration JOIN iv ON iv.tile_id = ev.tile_id AND iv.start < r.sa_pos AND r.sa_pos < iv."end"'
)
def circle_from_sa(spark, sf_dir):
    t = tiled(spark, sf_dir)
    base = C("pos") - C("pos") % 300
    windows = t.select("tile_id", F.lit(1).cast("long").alias("iteration"), "chrom", (base - 200).alias("start"), (base + 500).alias("end")).distinct()
    return ev.split_evidence(t, windows).drop("iteration")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All split evidence, with three made-up iterations."""
    t = tiled(spark, sf_dir)
    tiles = aln(spark, sf_dir).selectExpr(TILE, "chrom").distinct()  # those of all records; the mates need not be joined for them
    whole = tiles.select("tile_id", "chrom", F.lit(-1000).cast("long").alias("start"), F.lit(1 << 40).alias("end"), F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("iteration"))
    keyed = t.withColumn("qname", F.struct("qname", (C("ordinal") % 3).alias("i")))
    found = ev.split_evidence(keyed, whole).where("read.i = iteration")
    return found.withColumn("read", C("read.qname"))


@query(WITH + SPLITS + SUPPORT + ' SELECT tile_id, iteration, chrom, start, "end", sc, round(score, 4) AS score FROM sup')
def split_support(spark, sf_dir):
    return ev.support(evidence(spark, sf_dir)).withColumn("score", ROUND("score", 4))


def discordant_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pp.read_side_discordants_by_tile(tiled(spark, sf_dir))


@query(WITH + DISC + ' SELECT tile_id, chrom, start, "end", read FROM ds')
def discordant_reads(spark, sf_dir):
    return discordant_rows(spark, sf_dir).select("tile_id", "chrom", "start", "end", "read")


_ASSIGNED = ', asg AS (SELECT s.tile_id, s.iteration, s.chrom, s.start, s."end", s.sc, s.score, count(d.read) AS discordants FROM sup s LEFT JOIN dd d ON d.chrom = s.chrom AND d.start > s.start AND d.start - s.start < 50 AND d."end" < s."end" AND s."end" - d."end" < 50 GROUP BY ALL)'
_WIDE = ", dd AS (SELECT chrom, pos + 10 AS start, pos + 90 AS \"end\", CAST(qid AS STRING) AS read FROM r)"


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = proxy_reads(spark, sf_dir).select("chrom", (C("pos") + 10).alias("start"), (C("pos") + 90).alias("end"))
    supported = Store(spark, "supported").keep(ev.support(evidence(spark, sf_dir)), "spans")
    return ev.assign_discordants(supported, d, 50, ())


@query(WITH + SPLITS + SUPPORT + _WIDE + _ASSIGNED + ' SELECT tile_id, iteration, chrom, start, "end", sc, discordants FROM asg')
def assign_discordants(spark, sf_dir):
    return assigned(spark, sf_dir).select("tile_id", "iteration", "chrom", "start", "end", "sc", "discordants")


@query(
    WITH + PAIRS + f""", d AS (SELECT qid, chrom, p2 AS start, p1 + 100 AS "end" FROM p WHERE NOT u1 AND NOT u2 AND {OUT.format(q=10)}), b AS (SELECT *, lag("end") OVER (PARTITION BY chrom ORDER BY start, "end") AS before FROM d),
 i AS (SELECT *, sum(CASE WHEN before IS NULL OR start > before THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM b)
 SELECT chrom, min(start) AS start, max({{'a': start, 'b': "end"}}).b AS "end", count(*) AS discordants FROM i GROUP BY chrom, island HAVING count(*) >= 3"""
)
def discordant_islands(spark, sf_dir):
    """Circles that three or more outward pairs support."""
    pairs = pr.mate_pairs(proxy_reads(spark, sf_dir)).where(pr.both_mapped() & pr.outward(10))
    d = pairs.select(C("r1.chrom").alias("chrom"), C("r2.pos").alias("start"), (C("r1.pos") + 100).alias("end"))
    return ev.discordant_islands(d).where("discordants >= 3")


@query(
    WITH + SPLITS + SUPPORT + _WIDE + _ASSIGNED + ', x AS (SELECT * FROM asg UNION ALL SELECT * FROM asg WHERE sc = 1)'
    ' SELECT tile_id, iteration, chrom, start, "end", max(discordants) AS discordants, CAST(sum(sc) AS BIGINT) AS sc, round(sum(score), 4) AS score FROM x GROUP BY tile_id, iteration, chrom, start, "end"'
)
def iteration_merge(spark, sf_dir):
    a = assigned(spark, sf_dir)
    return ev.merge_iterations(a.unionByName(a.where("sc = 1"))).withColumn("score", ROUND("score", 4))


_AF = """, af AS (SELECT a.*, (SELECT count(*) FROM aln x WHERE x.chrom = a.chrom AND x.pos <= a.start AND a.start < x.pos + 100) AS ds, (SELECT count(*) FROM aln x WHERE x.chrom = a.chrom AND x.pos <= a."end" - 1 AND a."end" - 1 < x.pos + 100) AS de FROM asg a),
 fr AS (SELECT *, CASE WHEN sc <> 0 THEN 2 * sc / ((ds + de + CAST(0.01 AS DOUBLE)) / 2) ELSE discordants / ((ds + de + CAST(0.01 AS DOUBLE)) / 2) END AS af FROM af)"""


@query(
    WITH + SPLITS + SUPPORT + _WIDE + _ASSIGNED + _AF + ' SELECT tile_id, iteration, chrom, start, "end", round(af, 6) AS af,'
    " coalesce(CASE WHEN sc <> 0 THEN sc >= 1 AND score > 5 AND af >= CAST(0.1 AS DOUBLE) ELSE discordants >= 3 AND af >= CAST(0.1 AS DOUBLE) END, false) AS passes FROM fr"
)
def allele_frequency(spark, sf_dir):
    rows = ev.allele_frequency(assigned(spark, sf_dir), spans(spark, sf_dir).drop("rid"))
    return rows.select("tile_id", "iteration", "chrom", "start", "end", ROUND("af").alias("af"), F.coalesce(ev.passes(1, 5.0), F.lit(False)).alias("passes"))


_RECIPROCAL = """{name} AS (SELECT *, lag(start) OVER (PARTITION BY chrom ORDER BY start, "end"{tie}) AS q0, lag("end") OVER (PARTITION BY chrom ORDER BY start, "end"{tie}) AS q1 FROM {source}),
{name}i AS (SELECT *, sum(CASE WHEN q0 IS NULL OR greatest(coalesce((least(q1, "end") - greatest(q0, start)) / CAST(q1 - q0 AS DOUBLE), 0), 0) + greatest(coalesce((least(q1, "end") - greatest(q0, start)) / CAST("end" - start AS DOUBLE), 0), 0) < {limit} THEN 1 ELSE 0 END)
 OVER (PARTITION BY chrom ORDER BY start, "end"{tie} ROWS UNBOUNDED PRECEDING) AS island FROM {name})"""


def _reciprocal(name: str, source: str, share: float, tie: str = "") -> str:
    return _RECIPROCAL.format(name=name, source=source, limit=f"CAST({2 * share} AS DOUBLE)", tie=tie)


@query(
    WITH + PAIRS + OUTWARD_SPANS + ', z AS (SELECT chrom, start, "end", qid % 4 AS sc, CAST(qid % 7 AS DOUBLE) AS score, qid % 3 AS discordants FROM s), ' + _reciprocal("w", "z", 0.8, ", sc, score")
    + ' SELECT chrom, CASE WHEN min(start) <> 0 THEN min(start) + 1 ELSE 0 END AS start, max("end") AS "end", max(discordants) AS discordants, CAST(sum(sc) AS BIGINT) AS sc, sum(score) AS score FROM wi GROUP BY chrom, island HAVING sum(sc) + max(discordants) >= 2'
)
def reciprocal_merge_final(spark, sf_dir):
    s = outward_spans(spark, sf_dir).select("chrom", "start", "end", (C("qid") % 4).alias("sc"), (C("qid") % 7).cast("double").alias("score"), (C("qid") % 3).alias("discordants"))
    return ev.merge_circles(s, 0.8, 2)


@query(
    WITH + PAIRS + OUTWARD_SPANS + ', z AS (SELECT chrom, start, "end", qid % 4 AS item FROM s), ' + _reciprocal("w", "z", 0.8)
    + ', o AS (SELECT chrom, min(start) AS start, max("end") AS "end", CAST(sum(item) AS BIGINT) AS item FROM wi GROUP BY chrom, island HAVING sum(item) >= 3), ' + _reciprocal("v", "o", 0.8)
    + ' SELECT chrom, min(start) AS start, max({\'a\': start, \'b\': "end"}).b AS "end", CAST(sum(item) AS BIGINT) AS item FROM vi GROUP BY chrom, island'
)
def repeats_two_round_merge(spark, sf_dir):
    return ev.merge_repeats(outward_spans(spark, sf_dir).select("chrom", "start", "end", (C("qid") % 4).alias("item")), 0.8, 3)


# ---------------------------------------------------------------- coverage

_CIRCLES = ', ci AS (SELECT DISTINCT chrom, pos AS start, pos + 200 + rid % 300 AS "end" FROM aln WHERE cl > 28)'
_STATS = f"""{_CIRCLES}, ov AS (SELECT c.chrom, c.start AS s, c."end" AS e, greatest(c.start - 200, 0) AS lo, least(c."end" + 200, {CONTIG_LENGTH}) AS hi, least(c.start + 100, c."end") AS f, greatest(c."end" - 100, c.start) AS l, g.start AS a, g."end" AS b, g.depth AS d
 FROM ci c JOIN g ON g.chrom = c.chrom AND g.start < least(c."end" + 200, {CONTIG_LENGTH}) AND g."end" > greatest(c.start - 200, 0)),
 sm AS (SELECT chrom, s, e, sum(d * greatest(least(b, e) - greatest(a, s), 0)) AS d1, sum(d * d * greatest(least(b, e) - greatest(a, s), 0)) AS d2, sum(greatest(least(b, e) - greatest(a, s), 0)) AS cv, sum(d * greatest(least(b, f) - greatest(a, s), 0)) AS i0,
 sum(d * greatest(least(b, f) - greatest(a, lo), 0)) AS o0, sum(d * greatest(least(b, e) - greatest(a, l), 0)) AS i1, sum(d * greatest(least(b, hi) - greatest(a, l), 0)) AS o1 FROM ov GROUP BY chrom, s, e),
 st AS (SELECT chrom, s AS start, e AS "end", d1 / CAST(e - s AS DOUBLE) AS mean, sqrt(greatest(d2 / CAST(e - s AS DOUBLE) - (d1 / CAST(e - s AS DOUBLE)) * (d1 / CAST(e - s AS DOUBLE)), 0)) AS std, CAST(i0 AS DOUBLE) / nullif(CAST(o0 AS DOUBLE), 0) AS start_ratio,
 CAST(i1 AS DOUBLE) / nullif(CAST(o1 AS DOUBLE), 0) AS end_ratio, 1 - cv / CAST(e - s AS DOUBLE) AS continuity FROM sm)"""


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    circles = aln(spark, sf_dir).where("cl > 28").select("chrom", C("pos").alias("start"), (C("pos") + 200 + C("rid") % 300).alias("end")).distinct()
    return cov.coverage_stats(circles, spans(spark, sf_dir).drop("rid"), proxy_contigs(spark))


@query(WITH + RUNS + _STATS + ' SELECT chrom, start, "end", round(mean, 5) AS mean, round(std, 5) AS std, round(start_ratio, 5) AS start_ratio, round(end_ratio, 5) AS end_ratio, round(continuity, 5) AS continuity FROM st')
def coverage_stats(spark, sf_dir):
    s = stats(spark, sf_dir)
    return s.select("chrom", "start", "end", *[ROUND(c, 5).alias(c) for c in ("mean", "std", "start_ratio", "end_ratio", "continuity")])


@query(WITH + RUNS + _STATS + ' SELECT chrom, start, "end" FROM st WHERE start_ratio > CAST(0.4 AS DOUBLE) OR end_ratio > CAST(0.4 AS DOUBLE)')
def coverage_ratio_filter(spark, sf_dir):
    return cov.filter_by_ratio(stats(spark, sf_dir), 0.4).select("chrom", "start", "end")


# ---------------------------------------------------------------- kernel and simulation


@query(
    WITH + " SELECT rid, round(pow(CAST(2 AS DOUBLE), rid % 13 - 20) / (pow(CAST(2 AS DOUBLE), rid % 13 - 20) + pow(CAST(2 AS DOUBLE), rid % 7 - 12) + pow(CAST(2 AS DOUBLE), rid % 5 - 20)), 9) AS probability FROM aln"
)
def posterior_prob(spark, sf_dir):
    """The kernel's posterior of the first of three scores."""

    @F.pandas_udf("double")
    def share(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([kn.posterior(list(x)) for x in zip(a, b, c)], dtype=float)

    scores = [(C("rid") % 13).cast("double"), (C("rid") % 7 + 8).cast("double"), (C("rid") % 5).cast("double")]
    return aln(spark, sf_dir).select("rid", ROUND(share(*scores), 9).alias("probability"))


@query(
    WITH + " SELECT rid, round((length(seq) - length(replace(seq, 'A', ''))) * log2((1 - CAST(0.001 AS DOUBLE)) / CAST(0.25 AS DOUBLE)) + length(replace(seq, 'A', '')) * log2(CAST(0.001 AS DOUBLE) / 3 / CAST(0.25 AS DOUBLE)) - 7, 4) AS score FROM r"
)
def pssm_score(spark, sf_dir):
    """The kernel's scores of each read against a stretch of A with one gap of three bases, at equal base shares."""

    @F.pandas_udf("double")
    def score(seqs: pd.Series, quals: pd.Series) -> pd.Series:
        queries, _ = kn._stacked([kn.encode(x) for x in seqs])
        errors, _ = kn._stacked([np.power(10.0, -np.asarray(q, float) / 10) for q in quals], 1)
        steps = np.where(queries == 1, ord("="), ord("X"))
        steps = np.concatenate((steps, np.tile([1, 3], (len(steps), 1))), axis=1)
        return pd.Series(kn.matrix_scores(queries, errors, steps, np.full((len(queries), 4), 0.25), 5.0, 1.0))

    return proxy_reads(spark, sf_dir).select(C("ordinal").alias("rid"), ROUND(score("seq", "qual"), 4).alias("score"))


@query()
def realign_kernel(spark, sf_dir):
    """Clips put back into the sequence of the read that they come from."""
    r = proxy_reads(spark, sf_dir).withColumn("c", R.longest_clip()).where("length(c.seq) >= 8")
    done = r.select(C("ordinal").alias("rid"), C("c.seq").alias("clip"), C("c.qual").alias("q"), "seq").withColumn("realigned", kn.realign_column(C("clip"), C("q"), C("seq")))
    return kn.accepted(done, least=0.5).withColumn("hit", kn.first_hit()).select("rid", "hit.start", "hit.edits")


@query(
    WITH + ", c AS (SELECT rid, CASE WHEN cl >= cr THEN substring(seq, 1, CAST(cl AS INT)) ELSE substring(seq, CAST(101 - cr AS INT), CAST(cr AS INT)) END AS clip, seq FROM r WHERE cl + cr > 0 AND NOT hard AND greatest(cl, cr) >= 8 AND greatest(cl, cr) < 20)"
    " SELECT rid, CAST(strpos(seq, clip) - 1 AS INT) AS start, CAST(strpos(seq, clip) + length(clip) - 2 AS INT) AS stop, CAST(0 AS INT) AS edits FROM c"
)
def exact_hits(spark, sf_dir):
    """First hits of clips of under 20 bases, for which no edit is allowed: the clip's first place in its read."""
    r = proxy_reads(spark, sf_dir).withColumn("c", R.longest_clip()).where("length(c.seq) >= 8 AND length(c.seq) < 20")
    done = r.select(C("ordinal").alias("rid"), C("c.seq").alias("clip"), C("c.qual").alias("q"), "seq").withColumn("realigned", kn.realign_column(C("clip"), C("q"), C("seq")))
    return done.withColumn("hit", kn.first_hit()).select("rid", "hit.start", C("hit.end").alias("stop"), "hit.edits")


@query(
    WITH + ", w AS (SELECT rid // 64 AS tile_id, rid AS iteration, seq AS bases FROM r WHERE rid % 3 <> 0),"
    " c AS (SELECT rid, rid // 64 AS tile_id, CASE WHEN cl >= cr THEN substring(seq, 1, CAST(cl AS INT)) ELSE substring(seq, CAST(101 - cr AS INT), CAST(cr AS INT)) END AS clip FROM r WHERE cl + cr > 0 AND NOT hard),"
    " k AS (SELECT *, length(clip) // 2 AS half FROM c)"
    " SELECT rid, tile_id, iteration, CAST(length(clip) AS INT) AS n FROM k JOIN w USING (tile_id) WHERE CASE WHEN length(clip) < 20 THEN contains(bases, clip)"
    " ELSE contains(bases, substring(clip, 1, half)) OR contains(bases, substring(clip, half + 1, length(clip) - half)) END"
)
def clip_seed_pairs(spark, sf_dir):
    """Clips with those of their tile's intervals in which an unchanged part of them stands; clips are of 5 to 34 bases, so one edit is allowed at most."""
    r = proxy_reads(spark, sf_dir).withColumns({"tile_id": F.floor(C("ordinal") / 64), "c": R.longest_clip()})
    store = Store(spark, "seeds")
    clips = store.keep(r.where("length(c.seq) > 0").select(C("ordinal").alias("rid"), "tile_id", C("c.seq").alias("clip")), "clips")
    windows = store.keep(r.where("ordinal % 3 <> 0").select("tile_id", C("ordinal").alias("iteration"), C("seq").alias("bases")), "windows")
    return sd.seed_pairs(clips, windows).select("rid", "tile_id", "iteration", F.length("clip").alias("n"))


@query(WITH + ", n AS (SELECT chrom, count(*) AS length FROM aln GROUP BY chrom) SELECT chrom, length, round(length / CAST(sum(length) OVER () AS DOUBLE), 9) AS weight, round(sum(length) OVER (ORDER BY chrom) / CAST(sum(length) OVER () AS DOUBLE), 9) AS hi FROM n")
def contig_weights(spark, sf_dir):
    lengths = aln(spark, sf_dir).groupBy("chrom").agg(F.count("*").alias("length"))
    return sm.contig_weights(lengths).select("chrom", "length", ROUND("weight", 9).alias("weight"), ROUND("hi", 9).alias("hi"))


def proxy_genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contig for each chromosome: the reads' bases at every hundredth place, those of the first read of a place."""
    r = orders_view(spark, sf_dir, READS_SQL).groupBy("chrom", F.floor(C("pos") / 100).alias("k")).agg(F.min("rid").alias("rid"))
    r = r.withColumn("seq", F.expr(BASES_SQL.replace("a.rid", "rid")))  # bases of the first reads alone
    return r.groupBy("chrom").agg(F.array_sort(F.collect_list(F.struct("k", "seq"))).alias("s")).select("chrom", F.array_join("s.seq", "").alias("seq"))


@query()
def simulate_reads(spark, sf_dir):
    return pp.simulate(spark, proxy_genome(spark, sf_dir), 3000)[1].select("name", "kind", "seq1", "seq2")


@query()
def realign_pipeline(spark, sf_dir):
    """Circles of the proxy reads, their clips realigned to the proxy genome."""
    reads = proxy_reads(spark, sf_dir)
    candidates = pp.extract(reads)
    return pp.realign(candidates, reads, reads, proxy_contigs(spark), proxy_genome(spark, sf_dir), pp.Params(only_discordants=False, merge_share=0.9, insert_mapq=30))


_BASES = """, e AS (SELECT chrom, pos AS place, 1 AS d FROM r WHERE NOT unmapped UNION ALL SELECT chrom, pos + 100 - cl - cr, -1 FROM r WHERE NOT unmapped),
net AS (SELECT chrom, place, sum(d) AS d FROM e GROUP BY chrom, place HAVING sum(d) <> 0),
runs AS (SELECT chrom, place AS start, CAST(lead(place) OVER w AS BIGINT) AS "end", CAST(sum(d) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth FROM net WINDOW w AS (PARTITION BY chrom ORDER BY place)),
g AS (SELECT * FROM runs WHERE depth > 0)"""
_EXTRACTED = f""", o AS (SELECT *, NOT u1 AND NOT u2 AND {OUT.format(q=10)} AS d FROM p), chosen AS ({_side('1', '2')} UNION ALL {_side('2', '1')}),
 cd AS (SELECT r.* EXCLUDE (mq), chosen.mq FROM r JOIN chosen USING (rid)),
 f AS (SELECT p2 + 100 - p1 AS t FROM p WHERE m1 >= 30 AND m2 >= 30 AND NOT v1 AND v2 AND c1 = 0 AND c2 = 0 AND p2 + 100 - p1 > 0 ORDER BY id2 LIMIT 100000),
 size AS (SELECT avg(CAST(t AS DOUBLE)) AS mean, stddev_pop(CAST(t AS DOUBLE)) AS std FROM f)"""
_TILED = """, ce AS (SELECT chrom, pos AS place, 1 AS d FROM cd WHERE NOT unmapped UNION ALL SELECT chrom, pos + 100 - cl - cr, -1 FROM cd WHERE NOT unmapped),
 cs AS (SELECT DISTINCT chrom, pos AS start, pos + 100 - cl - cr AS "end" FROM cd WHERE NOT unmapped),
 cm AS (SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM cs),
 cg AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 500 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM cm),
 cl AS (SELECT chrom, min(start) AS start, max("end") AS "end" FROM cg GROUP BY chrom, island), steps AS (SELECT * FROM (SELECT unnest(range(0, 100)) AS k)),
 tl AS (SELECT chrom, start + 300 * k AS t0, start + 300 * k + 300 AS t1 FROM cl, steps WHERE "end" - start > 500 AND start + 300 * k < "end" UNION ALL SELECT chrom, start, "end" FROM cl WHERE "end" - start <= 500),
 t AS (SELECT cd.*, concat(cd.chrom, ':', CAST(t0 AS STRING)) AS tile_id FROM cd JOIN tl ON tl.chrom = cd.chrom AND pos < t1 AND pos + 100 - cd.cl - cd.cr > t0 WHERE mapq >= 20)"""
_FOUND = """, orient AS (SELECT tile_id, max(CASE WHEN orientation LIKE '%R%' THEN 1 ELSE 0 END) AS pr FROM pri GROUP BY tile_id),
 ints AS (SELECT tile_id, row_number() OVER (PARTITION BY tile_id ORDER BY start, "end") AS iteration, chrom, greatest(0, start - CAST(round_even(mean + 4 * std, 0) AS BIGINT)) AS start,
  "end" + CASE WHEN pr = 1 THEN CAST(round_even(mean + 4 * std, 0) AS BIGINT) ELSE 0 END AS "end" FROM nm JOIN orient USING (tile_id), size WHERE probability >= CAST(0.01 AS DOUBLE)),
 ev AS (SELECT t.tile_id, i.iteration, t.chrom, CASE WHEN pos < sa_pos THEN pos ELSE sa_pos - 1 END AS start, CASE WHEN pos < sa_pos THEN sa_pos - 1 + sa_m + sa_d - 1 ELSE pos + 100 - cl - cr END AS "end",
  CAST(qid AS STRING) AS read, round(greatest(cl, cr) * (1 - pow(CAST(10 AS DOUBLE), -sa_mapq / CAST(10 AS DOUBLE))), 2) AS score FROM t JOIN ints i ON i.tile_id = t.tile_id AND i.chrom = t.chrom AND i.start < sa_pos AND sa_pos < i."end"
  WHERE has_sa AND NOT hard AND cl + cr > 0 AND pos <> sa_pos AND sa_mapq > 20 AND sa_strand = CASE WHEN rev THEN '-' ELSE '+' END)""" + SUPPORT + """,
 ds AS (SELECT tile_id, chrom, least(pos, mpos) AS start, greatest(pos, mpos) + CASE WHEN hard THEN 100 - cl - cr ELSE 100 END AS "end" FROM t
  WHERE NOT munmapped AND (rev AND NOT mrev AND NOT is_read1 AND pos < mpos OR NOT rev AND mrev AND is_read1 AND mpos < pos) AND tile_id IN (SELECT tile_id FROM ints)),
 asg AS (SELECT s.tile_id, s.iteration, s.chrom, s.start, s."end", s.sc, s.score, count(d.chrom) AS discordants FROM (SELECT * FROM sup, size) s LEFT JOIN ds d ON d.tile_id = s.tile_id AND d.chrom = s.chrom
  AND d.start > s.start AND d.start - s.start < s.mean + 5 * s.std AND d."end" < s."end" AND s."end" - d."end" < s.mean + 5 * s.std GROUP BY ALL),
 lone AS (SELECT *, lag("end") OVER (PARTITION BY tile_id, chrom ORDER BY start, "end") AS before FROM ds WHERE tile_id NOT IN (SELECT tile_id FROM ev)),
 loni AS (SELECT *, sum(CASE WHEN before IS NULL OR start > before THEN 1 ELSE 0 END) OVER (PARTITION BY tile_id, chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM lone),
 every AS (SELECT chrom, start, "end", sc, score, discordants FROM asg
  UNION ALL SELECT chrom, min(start), max({'a': start, 'b': "end"}).b, 0, 0.0, count(*) FROM loni GROUP BY tile_id, chrom, island),
 af AS (SELECT a.*, (SELECT count(*) FROM aln x WHERE x.chrom = a.chrom AND x.pos <= a.start AND a.start < x.pos + 100 - x.cl - x.cr) AS ds0, (SELECT count(*) FROM aln x WHERE x.chrom = a.chrom AND x.pos <= a."end" - 1 AND a."end" - 1 < x.pos + 100 - x.cl - x.cr) AS de0 FROM every a),
 z AS (SELECT chrom, start, "end", sc, score, discordants, row_number() OVER () AS rn FROM af WHERE CASE WHEN sc <> 0 THEN score > 0 AND 2 * sc / ((ds0 + de0 + CAST(0.01 AS DOUBLE)) / 2) >= CAST(0.1 AS DOUBLE)
  ELSE discordants >= 3 AND discordants / ((ds0 + de0 + CAST(0.01 AS DOUBLE)) / 2) >= CAST(0.1 AS DOUBLE) END), """
_CALLED = """, calls AS (SELECT chrom, CASE WHEN min(start) <> 0 THEN min(start) + 1 ELSE 0 END AS start, max("end") AS "end", CAST(max(discordants) AS BIGINT) AS discordants, CAST(sum(sc) AS BIGINT) AS sc, round(sum(score), 4) AS score FROM wi GROUP BY chrom, island),
 ci AS (SELECT DISTINCT chrom, start, "end" FROM calls)"""


@query(
    WITH + PAIRS + _EXTRACTED + _TILED + PRIORS.replace(f"{TILE}, ", "").replace("FROM r WHERE mapq >= 20", "FROM t") + MERGED + _FOUND + _reciprocal("w", "z", 0.9, ", sc, score, rn") + _CALLED + _BASES
    + _STATS.replace(_CIRCLES, "") + ' SELECT calls.chrom, calls.start, calls."end", discordants, sc, score, round(mean, 5) AS mean, round(std, 5) AS std, round(start_ratio, 5) AS start_ratio, round(end_ratio, 5) AS end_ratio,'
    ' round(continuity, 5) AS continuity FROM st JOIN calls ON st.chrom = calls.chrom AND st.start = calls.start AND st."end" = calls."end" WHERE start_ratio > 0 OR end_ratio > 0'
)
def realign_splits_pipeline(spark, sf_dir):
    """The whole workflow without a genome, so without realigned clips: from reads to circles with their coverage."""
    reads = proxy_reads(spark, sf_dir)
    found = pp.realign(pp.extract(reads), reads, reads, proxy_contigs(spark), None, pp.Params(only_discordants=False, merge_share=0.9, insert_mapq=30))
    return found.withColumns({"score": ROUND("score", 4)} | {c: ROUND(c, 5) for c in ("mean", "std", "start_ratio", "end_ratio", "continuity")})


@query()
def realign_reads(spark, sf_dir):
    """Reads that support circles, with the SA tags that realignment gives."""
    reads = proxy_reads(spark, sf_dir)
    found = pp.realign_reads(pp.extract(reads), reads, proxy_contigs(spark), proxy_genome(spark, sf_dir), pp.Params(only_discordants=False, insert_mapq=30))
    return found.select(C("ordinal").alias("rid"), "qname", "chrom", "pos", "sa", "mq")


@query(
    WITH + _BASES + """, z AS (SELECT chrom, CASE WHEN xa_pos < pos THEN xa_pos ELSE pos END AS start, CASE WHEN xa_pos < pos THEN pos + 100 ELSE xa_pos - 1 + 102 END AS "end", CAST(1 AS BIGINT) AS item
 FROM r WHERE has_xa AND NOT two_xa AND nm <= 2), """ + _reciprocal("w", "z", 0.8)
    + ', o AS (SELECT chrom, min(start) AS start, max("end") AS "end", CAST(sum(item) AS BIGINT) AS item FROM wi GROUP BY chrom, island HAVING sum(item) >= 2), ' + _reciprocal("v", "o", 0.8)
    + ', ci AS (SELECT chrom, min(start) AS start, max({\'a\': start, \'b\': "end"}).b AS "end", CAST(sum(item) AS BIGINT) AS item FROM vi GROUP BY chrom, island)' + _STATS.replace(_CIRCLES, "")
    + ' SELECT st.chrom, st.start, st."end", item, round(mean, 5) AS mean, round(std, 5) AS std, round(start_ratio, 5) AS start_ratio, round(end_ratio, 5) AS end_ratio, round(continuity, 5) AS continuity'
    ' FROM st JOIN ci ON st.chrom = ci.chrom AND st.start = ci.start AND st."end" = ci."end" WHERE start_ratio > CAST(0.3 AS DOUBLE) OR end_ratio > CAST(0.3 AS DOUBLE)'
)
def repeats_pipeline(spark, sf_dir):
    found = pp.repeats(proxy_reads(spark, sf_dir), proxy_contigs(spark), least=2, ratio=0.3)
    return found.select("chrom", "start", "end", "item", *[ROUND(c, 5).alias(c) for c in ("mean", "std", "start_ratio", "end_ratio", "continuity")])


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
