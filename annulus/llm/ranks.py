"""Places of rows in ordered groups, and digests along them, whatever the size of a group.

A window over a group puts all its rows into one task. Here rows are dealt out by ranges of
(group, order), so that a large group lies in many partitions, and a row's place is its place
in its partition plus the counts of the partitions before it: one small row for each group
and partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annulus.llm.storage import Store


def same(a: DataFrame, b: DataFrame, *names: str):
    """Rows of a and b agree in these columns, null with null."""
    condition = F.lit(True)
    for n in names:
        condition = condition & a[n].eqNullSafe(b[n])
    return condition


def ranked(rows: DataFrame, group: str, order: list[str], store: Store, name: str) -> DataFrame:
    """rows with the column ``rank``: the place, from 0, in its group by the columns of order (nulls first, whole ties in any order).

    The rows are kept in the store under the given name. A null group is a group.
    """
    placed = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id())
    placed = store.keep(placed, name).withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col(group).alias("_group"), F.col("_part").alias("_of"), (F.coalesce(earlier, F.lit(0)) - F.col("_first")).alias("_shift"))
    joined = placed.join(counts, placed[group].eqNullSafe(counts["_group"]) & (placed["_part"] == counts["_of"]))
    return joined.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("rank"))


def _digests(batches: Iterator[pa.RecordBatch], separator: bytes) -> Iterator[pa.RecordBatch]:
    kind, key, running, done = None, None, None, ([], [])
    for batch in batches:
        kind = batch.schema.field(0).type
        for k, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
            if running is None or k != key:
                if running is not None:
                    done[0].append(key)
                    done[1].append(running.hexdigest())
                key, running = k, hashlib.sha256()
            else:
                running.update(separator)
            running.update(value or b"")
        if done[0]:
            yield pa.RecordBatch.from_arrays([pa.array(done[0], kind), pa.array(done[1], pa.string())], names=["key", "sha256"])
            done = ([], [])
    if running is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([running.hexdigest()], pa.string())], names=["key", "sha256"])


def joined_sha256(rows: DataFrame, key: str, order: str, value: str, separator: str) -> DataFrame:
    """For each key (sha256 string): the digest of its values in order, joined by the separator; a null value counts as empty.

    Such a digest is sequential: the rows of a key stream through one task, sorted on disk, and never stand in memory together.
    """
    dealt = rows.select(F.col(key).alias("key"), F.col(order).alias("_order"), F.col(value).cast("string").alias("value"))
    dealt = dealt.repartition("key").sortWithinPartitions("key", "_order").select("key", "value")
    schema = T.StructType([T.StructField("key", dealt.schema["key"].dataType), T.StructField("sha256", T.StringType())])
    return dealt.mapInArrow(lambda batches: _digests(batches, separator.encode()), schema).withColumnRenamed("key", key)
