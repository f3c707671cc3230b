"""The daily layout against a plain version, and the bytes that stay."""

import datetime as dt
import hashlib
import math
import random
import zlib
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from annulus.llm.late_rows import DailyLayout, epoch_micros, with_resent
from annulus.llm.queries import op11_late_overwrite
from annulus.llm.storage import Store

EPOCH = dt.datetime(1970, 1, 1)
SCHEMA = "sale_id long, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, note string"


def day(at):
    return -1 if at is None else (at - EPOCH).days


def micros(at):
    return "" if at is None else str((at - EPOCH) // dt.timedelta(microseconds=1))


def resent(rows):
    out = list(rows)
    for x in rows:
        h = zlib.crc32(str(x["sale_id"]).encode())
        if x["sale_id"] is not None and h % 3 == 0 and day(x["sold_at"]) % 4 == 0:
            later = {"sold_at": dt.timedelta(days=h % 2), "arrived_at": dt.timedelta(days=1 + h % 97)}
            out.append(x | {"total": None if x["total"] is None else x["total"] + 1} | {k: x[k] and x[k] + v for k, v in later.items()})
    return out


def latest(rows):
    low = {"arrived_at": EPOCH, "sold_at": EPOCH, "total": 0.0}
    order = lambda x: tuple((x.get(k) is not None, x.get(k) if x.get(k) is not None else low.get(k, "")) for k in ("arrived_at", "total", "sold_at", "note"))
    best = {}
    for x in rows:
        if x["sale_id"] not in best or order(x) > order(best[x["sale_id"]]):
            best[x["sale_id"]] = x
    return best


def layout(rows, size):
    days, out = {}, {}
    for x in latest(rows).values():
        days.setdefault(day(x["sold_at"]), []).append(x)
    for d, v in days.items():
        v.sort(key=lambda x: (x["sold_at"] or EPOCH, x["sale_id"] is not None, x["sale_id"] or 0))
        out |= {(d, i // size): v[i : i + size] for i in range(0, len(v), size)}
    return out


def is_late(x):
    return x["arrived_at"] is None or x["arrived_at"] >= dt.datetime(2024, 3, 20)


def dirty_days(rows):
    start = latest([x for x in rows if not is_late(x)])
    return {day(y["sold_at"]) for k, x in latest(rows).items() if is_late(x) for y in (x, start.get(k, x))}


def test_query_equals_plain_version(spark):
    data = "/root/testdata/sf0.001"
    rows = pq.read_table(f"{data}/sales.parquet").to_pylist()
    every = resent(rows)
    size, dirty = 1 + len(rows) // 1100, dirty_days(every)
    want = {}
    for (d, i), v in layout(every, size).items():
        cents = sum(0 if x["total"] is None else math.floor(100 * x["total"] + 0.5) for x in v)
        crc = sum(zlib.crc32(f"{x['sale_id']}:{micros(x['sold_at'])}:{micros(x['arrived_at'])}".encode()) for x in v)
        want[d, i] = (len(v), cents, crc, hashlib.sha256(",".join(str(x["sale_id"]) for x in v).encode()).hexdigest(), d in dirty)
    got = op11_late_overwrite(spark, data).collect()
    assert {(r.day, r.file_no): (r.n_rows, r.cents, r.rows_crc, r.ids_sha256, r.rewritten) for r in got} == want
    paths = {r.path.removeprefix("file://").removeprefix("file:") for r in got}
    root = Path(min(paths)).parent.parent.parent
    assert {str(p) for p in root.rglob("*.parquet")} == paths == {str(p) for p in root.parent.rglob("*.parquet") if root in p.parents}
    names = ",".join(pq.read_schema(f"{data}/sales.parquet").names)
    assert all(r.columns == names == ",".join(pq.read_schema(p).names) for r, p in zip(got[:20], (r.path.removeprefix("file:") for r in got)))


def invented(seed, n=300):
    rng = random.Random(seed)
    start = dt.datetime(2024, 3, 1)
    out = []
    for i in range(n):
        sold = None if rng.random() < 0.05 else start + dt.timedelta(days=rng.choice((0, 0, 0, rng.randrange(30))), seconds=rng.randrange(5) * 3600)
        arrived = None if rng.random() < 0.05 else start + dt.timedelta(days=rng.randrange(40), microseconds=rng.randrange(3))
        out.append({"sale_id": rng.choice((None, 7, *range(150))), "total": rng.choice((None, -0.0, 0.0, 1.5, 2.25)), "sold_at": sold, "arrived_at": arrived, "note": f"{i}"})
    return out


def stored(root):
    return {(int(p.parent.parent.name[4:]), int(p.parent.name[8:])): p for p in Path(root.removeprefix("file://")).rglob("*.parquet")}


@pytest.mark.parametrize("seed, size", [(1, 7), (2, 1)])
def test_overwrite_equals_layout_of_all_rows(spark, seed, size):
    rows = invented(seed)
    df = spark.createDataFrame([tuple(x.values()) for x in rows], SCHEMA)
    root = Store(spark, "sales").root
    kept = DailyLayout(df, root, "sale_id", "sold_at", "arrived_at", size)
    kept.create(df.where("arrived_at < timestamp_ntz'2024-03-20 00:00:00'"))
    before = {k: (p, p.read_bytes()) for k, p in stored(root).items()}
    assert before.keys() == layout([x for x in rows if not is_late(x)], size).keys()
    kept.overwrite(df.where("arrived_at >= timestamp_ntz'2024-03-20 00:00:00' OR arrived_at IS NULL"))
    after, want, dirty = stored(root), layout(rows, size), dirty_days(rows)
    assert {k: [repr(x) for x in pq.ParquetFile(p).read().to_pylist()] for k, p in after.items()} == {k: [repr(x) for x in v] for k, v in want.items()}
    for k, p in after.items():
        assert (before.get(k) == (p, p.read_bytes())) == (k[0] not in dirty)
    assert not Path(root.removeprefix("file://") + "-next").exists()


def test_rows_that_lose_change_nothing(spark):
    rows = [(i, 1.0, dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 2), "a") for i in range(10)]
    df = spark.createDataFrame(rows, SCHEMA)
    root = Store(spark, "sales").root
    kept = DailyLayout(df, root, "sale_id", "sold_at", "arrived_at", 4)
    kept.create(df)
    before = {k: (p, p.read_bytes()) for k, p in stored(root).items()}
    for late in (df.limit(0), df, spark.createDataFrame([(3, 2.0, None, None, "z"), (4, 2.0, None, dt.datetime(2024, 1, 9), "z")], SCHEMA)):
        kept.overwrite(late)
        assert {k: (p, p.read_bytes()) for k, p in stored(root).items()} == before
    kept.overwrite(spark.createDataFrame([(i, 2.0, dt.datetime(2023, 5, 5), dt.datetime(2024, 3, 9), "z") for i in range(10)], SCHEMA))
    assert {k[0] for k in stored(root)} == {(dt.datetime(2023, 5, 5) - EPOCH).days}  # a day that loses all its rows goes
    assert [r.n for r in spark.sql("SELECT 1 AS n").collect()] == [1]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    kept = DailyLayout(df, Store(spark, "sales").root, "sale_id", "sold_at", "arrived_at", 4)
    kept.create(df)
    kept.overwrite(df)
    assert kept.read().count() == 0 and kept.stored_columns() == df.columns


def test_times_and_second_versions(spark):
    rows = [{"sale_id": i, "total": None if i % 5 == 0 else float(i), "sold_at": None if i % 7 == 0 else dt.datetime(1969, 12, 20, 23, 59, 59, 999999) + dt.timedelta(days=i), "arrived_at": None if i % 11 == 0 else dt.datetime(2024, 3, 9, 1, 2, 3, 4), "note": None} for i in range(60)]
    df = spark.createDataFrame([tuple(x.values()) for x in rows], SCHEMA)
    key = lambda x: tuple(map(str, x))
    assert sorted(map(key, with_resent(df).collect())) == sorted(key(x.values()) for x in resent(rows))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    got = [str(r.m or "") for r in df.select(epoch_micros("sold_at").alias("m")).collect()]
    spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [micros(x["sold_at"]) for x in rows]
