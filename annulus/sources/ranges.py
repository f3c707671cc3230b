"""Ranges of large files, each for a task of its own.

Files are listed by Spark's own file systems and opened in the tasks by pyarrow's (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a file that a task reads.
RANGE = 32 << 20


def opened(path: str):
    """The file system and the path in it of a Hadoop path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else re.sub("^(file:)?/*", "file:///", path))


def read_bytes(path: str, lo: int, hi: int) -> bytes:
    system, name = opened(path)
    with system.open_input_file(name) as f:
        return f.read_at(hi - lo, lo)


def files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, size) of the files that a path, folder or pattern names; their bytes are not read."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in system.globStatus(target) or []:
        inner = system.listStatus(status.getPath()) if status.isDirectory() else [status]
        found += [(x.getPath().toString(), x.getLen()) for x in inner if x.isFile() and not x.getPath().getName().startswith(("_", "."))]
    if not found:
        raise FileNotFoundError(path)
    return sorted(found)


def ranges(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """Ranges (path, lo, hi, size of the file) of files, each a partition."""
    rows = [(name, lo, min(lo + size, n), n) for name, n in files(spark, path) for lo in range(0, n, size)]
    return spark.createDataFrame(rows, "path string, lo long, hi long, size long").repartitionByRange(max(1, len(rows)), "path", "lo")
