"""Order by depth over the whole genome, and the dealing of tiles to tasks so that none takes much more than its share.

Rows are placed by Spark's range partitioning, whose borders come from a sample of the keys; a place is what the
partitions before hold and the number within its own, so no task and no driver sees more than one range. Equal
depths stand by their place on the genome, which also cuts up a depth that many rows have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annulus.shared import Store

C = F.col


def ranked(df: DataFrame, order: list[Column], store: Store, name: str = "ranges") -> DataFrame:
    """df with place (1 for the first row of the order, no gaps). Rows that are equal by the order are numbered in any order."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written once: a range partition that is computed again may have other borders
    ranges = store.keep(df.repartitionByRange(partitions, *order).withColumn("_range", F.spark_partition_id()), name)
    # one row a partition, whatever the input
    counts = ranges.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    numbered = ranges.withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return numbered.join(before, "_range").withColumn("place", C("_before") + C("_at")).drop("_range", "_at", "_before")


def by_depth(peaks: DataFrame, store: Store | None = None) -> DataFrame:
    """Peaks (chrom, start, end, mean_depth) with their place from the deepest; equal depths stand by chrom, start and end, null depths last."""
    store = store or Store(peaks.sparkSession, "depth")
    return ranked(peaks, [C("mean_depth").desc_nulls_last(), C("chrom").asc(), C("start").asc(), C("end").asc()], store)


def balanced_chunks(tiles: DataFrame, chunks: int, store: Store | None = None) -> DataFrame:
    """Tiles dealt out over so many chunks, none of which is heavier than one and a half times the mean.

    tiles: chrom, start, end (no two rows alike) and weight, a number (null or less than 0 counts as 0). Returns a row
    for each piece: chrom, start, end, piece (from 0), pieces, weight (a piece's) and chunk (from 0).

    A tile over half of the mean is cut in equal pieces, two a mean of its weight. Pieces are then dealt from the heaviest to the
    lightest, forth and back over the chunks: two chunks differ by one piece's weight at most, so the heaviest is at most the mean and a half.
    """
    if chunks < 1:
        raise ValueError("there must be at least one chunk")
    store = store or Store(tiles.sparkSession, "chunks")
    known = tiles.select("chrom", "start", "end", F.greatest(F.coalesce(C("weight").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("weight"))
    total = known.agg(F.sum("weight")).first()[0] or 0.0
    pieces = F.greatest(F.lit(1), F.ceil(C("weight") * 2 * chunks / F.lit(total))) if total else F.lit(1)
    cut = known.withColumn("pieces", pieces.cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0), C("pieces") - 1)))
    cut = cut.withColumn("weight", C("weight") / C("pieces"))
    placed = ranked(cut, [C("weight").desc(), C("chrom").asc(), C("start").asc(), C("end").asc(), C("piece").asc()], store)
    turn, at = F.floor((C("place") - 1) / chunks), (C("place") - 1) % chunks
    chunk = F.when(turn % 2 == 0, at).otherwise(chunks - 1 - at)
    return placed.select("chrom", "start", "end", "piece", "pieces", "weight", chunk.cast("int").alias("chunk"))


def deal(rows: DataFrame, dealt: DataFrame, chunks: int, spread: Column) -> DataFrame:
    """rows (chrom, start and end of their tile, and more) in one partition for each chunk of ``balanced_chunks``, with the column chunk.

    A row of a tile in pieces goes to the piece that the hash of spread names, so spread should tell a tile's rows apart. Rows whose tile
    was not dealt are left out.
    """
    tile = ["chrom", "start", "end"]
    # the pieces of a tile are 2 a chunk and one at most, so a list of them is short
    lists = dealt.groupBy(*tile).agg(F.sort_array(F.collect_list(F.struct("piece", "chunk"))).alias("_pieces"))
    at = F.pmod(F.xxhash64(spread), F.size("_pieces")).cast("int")
    return rows.join(lists, tile).withColumn("chunk", F.get("_pieces", at)["chunk"]).drop("_pieces").repartitionById(chunks, C("chunk"))
