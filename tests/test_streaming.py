"""Pairs over a stream, batch by batch, against the batch plan."""

from annulus.operators import pairs
from annulus.streaming.candidates import outward_pairs, stream_pairs

READS = "qname string, ordinal long, flag int, chrom string, pos long, mapq int"
FIRST = [("a", 0, 97, "c", 500, 60), ("a", 1, 65, "c", 510, 60), ("b", 2, 145, "c", 5, 60), ("d", 3, 97, "c", 900, 60), ("d", 4, 145, "c", 100, 5), ("e", 5, 97, "c", 900, 60)]
SECOND = [("a", 6, 145, "c", 20, 60), ("e", 7, 145, "c", 30, 60), ("e", 8, 145, "c", 950, 60), ("f", 9, 145, "c", 1, 60)]


def test_streamed_pairs_equal_batch_pairs(spark, tmp_path):
    for k, rows in enumerate((FIRST, SECOND)):
        spark.createDataFrame(rows, READS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    reads = spark.readStream.schema(READS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    for name, plan in (("every", stream_pairs(reads)), ("outward", outward_pairs(stream_pairs(reads)))):
        query = plan.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-state").trigger(availableNow=True).start()
        assert query.awaitTermination(60)
        batch = pairs.mate_pairs(spark.createDataFrame(FIRST + SECOND, READS))
        want = batch if name == "every" else outward_pairs(batch)
        got = spark.read.parquet(f"{tmp_path}/{name}")
        both = [sorted((r.r1.ordinal, r.r2.ordinal) for r in x.collect()) for x in (got, want)]
        assert both[0] == both[1] and both[0], name
