"""Tables in the folder that driver and executors share.

Long jobs cut their lineage here: ``Store.keep`` writes a DataFrame as Parquet and
reads it back, so a lost executor costs its tasks only and never a recomputation
of everything before, and Catalyst plans each step on its own. The folder is
``spark.checkpoint.dir``; a session without one gets a temporary folder if it runs in one
process (as in tests), and an error otherwise.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        named = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _filesystem(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _filesystem(spark, path)
    return system.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    system, target = _filesystem(spark, path)
    system.delete(target, True)


_opened: ContextVar[list[Store] | None] = ContextVar("opened", default=None)


@contextmanager
def closing_stores() -> Iterator[None]:
    """Close, at the end, every store that was made within: for a step whose result has been kept elsewhere by then."""
    own: list[Store] = []
    token = _opened.set(own)
    try:
        yield
    finally:
        _opened.reset(token)
        for store in own:
            store.close()


class Store:
    """Parquet tables of one run, under a folder of their own.

    Results read them, so they stay until ``drop`` or ``close``, or the end of ``closing_stores``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        if (opened := _opened.get()) is not None:
            opened.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        remove(self.spark, self.path(name))

    def close(self) -> None:
        """Remove all tables, once nothing that reads them is needed any more."""
        remove(self.spark, self.root)
