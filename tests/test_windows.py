"""Windows with gaps against their SQL to the last digit, on odd samples too, and over a stream of them."""

import os
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__  # noqa: F401  registers the queries
from terraledger.plans.registry import ORACLES, QUERIES
from terraledger.plans.streams import RULES
from terraledger.streaming import windows

NAME = "sm_02_gap_windows"
HOUR = 3_600_000_000
COLUMNS = ["user_id", "kind", "start", "end", "n", "worst", "recent"]


def both(spark, sf: str) -> tuple[list, list]:
    c = duckdb.connect()
    c.execute(f"create view events as select * from read_parquet('{sf}/events.parquet')")
    want = c.execute(ORACLES[NAME])
    assert [d[0] for d in want.description] == COLUMNS
    return sorted(map(tuple, QUERIES[NAME](spark, sf).select(*COLUMNS).collect()), key=str), sorted(want.fetchall(), key=str)


def odd_events(n: int, path: str, days: tuple = (-400, 10)) -> pa.Table:
    """Steps under a millisecond and halves of one, times before 1970, samples without user, time, value or tie-breaker, values that are no numbers."""
    rng = random.Random(7)
    users = [None, *range(8)]
    now = {u: rng.choice(days) * 24 * HOUR + rng.randrange(1000) for u in users}
    untied, rows = set(), []
    for i in range(n):
        u = rng.choice(users)
        now[u] += rng.choice([0, 1, 250, 500, 1000, HOUR, 5 * HOUR, 12 * HOUR, 12 * HOUR - 500, 36 * HOUR, 36 * HOUR + 500, 60 * HOUR])
        tie = None if u not in untied and rng.random() < 0.1 else n - i
        if tie is None:
            untied.add(u)
        rows.append((tie, None if rng.random() < 0.03 else now[u], u, rng.choice([None, float("nan"), float("inf"), float("-inf"), -1.0, 20.0, 20.0, 89.5, 90.0, 95.0])))
    rng.shuffle(rows)
    t = pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate([pa.int64(), pa.timestamp("us"), pa.int64(), pa.float64()])], names=["event_id", "ts", "user_id", "value"])
    pq.write_table(t, path)
    return t


def test_windows_equal_sql_to_the_millisecond(spark):
    got, want = both(spark, "/root/testdata/sf0.001")
    assert got == want and {r[1] for r in want} == {"window", "episode"}


def test_windows_equal_sql_on_odd_samples(spark, tmp_path):
    odd_events(1500, str(tmp_path / "events.parquet"))
    got, want = both(spark, str(tmp_path))
    assert list(map(str, got)) == list(map(str, want)) and {r[1] for r in want} == {"window", "episode"}
    assert {"nan", "inf", "-inf", "None"} <= {str(r[5]) for r in want} and min(r[2] for r in want) < 0


def test_stream_of_odd_samples_equals_table(spark, tmp_path):
    t = odd_events(400, str(tmp_path / "odd.parquet"), (10, 20))  # a stream's watermark begins at 1970
    last = max(x for x in t["ts"].cast(pa.int64()).to_pylist() if x is not None)
    (tmp_path / "in").mkdir()
    pq.write_table(t, str(tmp_path / "in" / "0.parquet"))
    for i in (1, 2):  # two marks, so that the watermark passes all
        mark = pa.table([pa.array([-i]), pa.array([last + i * 100_000 * HOUR], pa.timestamp("us")), pa.array([99]), pa.array([0.0])], names=t.column_names)
        pq.write_table(mark, str(tmp_path / "in" / f"{i}.parquet"))
    for i in range(3):
        os.utime(tmp_path / "in" / f"{i}.parquet", (1000 + i, 1000 + i))  # files are taken in order of their times
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    stream = spark.readStream.schema("event_id long, ts timestamp, user_id long, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = windows.stream_windows(stream, "user_id", "ts", "value", "event_id", RULES, "1 hour").writeStream.format("memory").queryName("odd").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    try:
        q.processAllAvailable()
        q.awaitTermination(120)
        got = sorted(str(tuple(r)) for r in spark.table("odd").where("user_id is null or user_id < 99").collect())
    finally:
        q.stop()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    table = windows.windows(spark.read.parquet(str(tmp_path / "odd.parquet")), "user_id", "ts", "value", "event_id", RULES)
    want = sorted(str(tuple(r)) for r in table.select(*COLUMNS).collect())
    assert got == want and any("nan" in r for r in want)
