"""A table of daily Parquet files that is kept up with rows that arrive late.

The table holds the latest-arrived row of each sale. Its layout cuts each day's rows, in order,
into files of a given number of rows: ``day=<day>/file_no=<number>/<one Parquet file>``.

Late rows come as a signed delta over that view: a late winner takes out (-1) the row that stands
for its sale, and puts in (+1) its own. Days that the delta names are dirty. Only their stored rows
are read, weights are summed row by row, rows of weight 1 are ranked again, and the days' folders
are exchanged; no other file is touched.

Rows are ranked by ranges of (day, order), so that no day is one task; a file is written by one
task, as it has to be whole. The driver sees folders, never rows: their number is bounded by
the days and by the files of the layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annulus.llm.ranks import ranked
from annulus.llm.storage import Store

_DAY_MICROS = 86_400_000_000


def epoch_day(at: str) -> Column:
    """Whole days since 1970 of a timestamp without a zone; -1 for null."""
    return F.coalesce(F.unix_date(F.col(at).cast("date")), F.lit(-1)).cast("long")


def epoch_micros(at: str) -> Column:
    """Microseconds since 1970 of a timestamp without a zone, read as UTC in any session."""
    of_day = F.expr(f"(hour({at}) * 60 + minute({at})) * 60000000L + cast(extract(SECOND FROM {at}) * 1000000 AS long)")
    return F.unix_date(F.col(at).cast("date")).cast("long") * _DAY_MICROS + of_day


def with_resent(sales: DataFrame) -> DataFrame:
    """sales, and second versions of some: where crc32 of the decimal sale_id, h, is a multiple of 3 and the day one of 4, total + 1, sold h % 2 and arrived 1 + h % 97 days later."""
    h = F.crc32(F.col("sale_id").cast("string").cast("binary"))
    days = lambda n: F.make_dt_interval(n.cast("int"))
    again = sales.where((h % 3 == 0) & (epoch_day("sold_at") % 4 == 0)).withColumns(
        {"total": F.col("total") + 1, "sold_at": F.col("sold_at") + days(h % 2), "arrived_at": F.col("arrived_at") + days(1 + h % 97)}
    )
    return sales.unionByName(again.select(sales.columns))


class DailyLayout:
    """The files of one table under root; rows gives their columns, whose names don't begin with ``_`` and aren't day, file_no, path, row_index or weight.

    key names a row, arrived tells which of its versions stands (the latest; null is before all;
    of equal ones the greatest by all columns), sold gives the day (null: -1) and with key the order
    within it. file_rows: rows of a file, but for a day's last.
    """

    def __init__(self, rows: DataFrame, root: str, key: str, sold: str, arrived: str, file_rows: int):
        self.spark, self.types, self.columns = rows.sparkSession, rows.dtypes, rows.columns
        self.root, self.file_rows, self._read = root, int(file_rows), None
        self.key, self.sold, self.arrived = key, sold, arrived
        self.store = Store(self.spark, "layout-work")
        self.runs = 0

    def latest(self, rows: DataFrame) -> DataFrame:
        """One row for each key; combined before the shuffle, so a key that comes often costs no more."""
        rest = [c for c in self.columns if c not in (self.key, self.arrived)]
        best = rows.groupBy(self.key).agg(F.max(F.struct(self.arrived, *rest)).alias("_row"))
        return best.select(*(F.col(c) if c == self.key else F.col(f"_row.{c}") for c in self.columns))

    def _write(self, rows: DataFrame, folder: str) -> None:
        self.runs += 1
        # the day comes under a name that no column has
        placed = ranked(rows.select(*self.columns, epoch_day(self.sold).alias("_day")), "_day", [self.sold, self.key], self.store, f"placed-{self.runs}")
        cut = placed.select(*self.columns, F.col("_day").alias("day_"), F.expr(f"rank div {self.file_rows}").alias("file_"), "rank")
        # files are many and may be small: as many tasks as the session deals out, whatever the rows' bytes
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism)
        dealt = cut.repartition(tasks, "day_", "file_").sortWithinPartitions("day_", "file_", "rank").drop("rank")
        dealt.withColumnsRenamed({"day_": "day", "file_": "file_no"}).write.partitionBy("day", "file_no").mode("overwrite").parquet(folder)
        self.store.drop(f"placed-{self.runs}")

    def create(self, rows: DataFrame) -> None:
        """Write the layout of the latest of rows."""
        self._write(self.latest(rows), self.root)

    def read(self) -> DataFrame:
        """The stored rows with day, file_no, their file's path and their place in it."""
        if self._read is None:  # its files are listed once
            types = ", ".join(f"`{n}` {t}" for n, t in self.types)
            read = self.spark.read.schema(f"{types}, day long, file_no long").parquet(self.root)
            self._read = read.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row_index"))
        return self._read

    def stored_columns(self) -> list[str]:
        """The columns that the files have, in order, as a file tells them."""
        first = self.read().select("path").first()
        return self.spark.read.parquet(first.path).columns if first else self.columns

    def files(self) -> DataFrame:
        """The layout's files by path."""
        return self.read().select("path").distinct()

    def delta(self, late: DataFrame) -> DataFrame:
        """Signed rows (``weight``) that bring the stored rows up to date: late winners, and the rows that they take the place of."""
        new = self.latest(late)
        old = self.read().select(*(F.col(c).alias(f"_{c}") for c in self.columns), F.lit(True).alias("_stood"))
        pairs = new.join(old, F.col(self.key).eqNullSafe(F.col(f"_{self.key}")), "left").withColumn("_stood", F.col("_stood").isNotNull())
        by_age = F.struct(self.arrived, *(c for c in self.columns if c not in (self.key, self.arrived)))
        stood = F.struct(*(F.col(f"_{c}").alias(c) for c in [self.arrived, *(c for c in self.columns if c not in (self.key, self.arrived))]))
        winners = pairs.where(~F.col("_stood") | (by_age > stood))
        plus = F.struct(*self.columns, F.lit(1).alias("weight"))
        minus = F.struct(*(F.col(f"_{c}").alias(c) for c in self.columns), F.lit(-1).alias("weight"))
        both = F.when(F.col("_stood"), F.array(plus, minus)).otherwise(F.array(plus))
        return winners.select(F.explode(both).alias("r")).select("r.*").withColumn("day", epoch_day(self.sold))

    def consolidated(self, delta: DataFrame) -> DataFrame:
        """The rows of the delta's days once it is applied: stored rows weigh 1, and rows whose weights sum to 1 stand."""
        dirty = delta.select("day").distinct()
        stored = self.read().join(dirty, "day", "left_semi").select(*self.columns, F.lit(1).alias("weight"))
        rows = stored.unionByName(delta.select(*self.columns, "weight"))
        # doubles are grouped by their text, in which -0.0 is not 0.0
        same = [F.col(c).cast("string").alias(f"_{c}") if t in ("double", "float") else F.col(c).alias(f"_{c}") for c, t in rows.dtypes if c != "weight"]
        summed = rows.groupBy(*same).agg(F.sum("weight").alias("_weight"), *(F.first(c).alias(c) for c in self.columns))
        return summed.where("_weight > 0").select(*self.columns)

    def overwrite(self, late: DataFrame) -> None:
        """Make the layout that of its rows and the late ones, rewriting the days that change and nothing else."""
        delta = self.store.keep(self.delta(late), "delta")
        staged = f"{self.root}-next"
        self._write(self.consolidated(delta), staged)
        days = [r.day for r in delta.select("day").distinct().collect()]  # folders of the layout, not rows
        self._exchange(days, staged)
        self.store.close()

    def _exchange(self, days: list[int], staged: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        files = path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for day in days:
            before, after = path(f"{self.root}/day={day}"), path(f"{staged}/day={day}")
            files.delete(before, True)
            if files.exists(after) and not files.rename(after, before):
                raise OSError(f"{after} can't be moved to {before}")
        files.delete(path(staged), True)
        self._read = None
