"""Scans that leave out rows which a join does not want; tables of a run are kept in ``annulus.shared``."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from annulus.shared import Store, exists, remove, shared_dir

__all__ = ["Store", "exists", "filtered_scans", "remove", "shared_dir"]

#: Spark drops rows of a scan that a Bloom filter of the join's other side rules out. The filter has 8 MB at most
#: (spark.sql.optimizer.runtime.bloomFilter.maxNumBits), and the join still decides.
_FILTERED = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1000g",
}


@contextmanager
def filtered_scans(spark: SparkSession) -> Iterator[None]:
    """Within it, actions may filter large scans by the keys of a selective join before they shuffle."""
    before = {k: spark.conf.get(k, None) for k in _FILTERED}
    for k, v in _FILTERED.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
