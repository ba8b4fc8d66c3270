"""Streams and queues against plain loops."""

from collections import defaultdict

from pyspark.sql import functions as F

from dossierlake.operators import events as E
from dossierlake.streaming import events as S

SF = "/root/testdata/sf0.001"


def plain_lockouts(rows):
    fails, until, out = defaultdict(int), defaultdict(int), []
    for r in sorted(rows, key=lambda r: (r["ts"], r["event_id"])):
        u, now = r["user_id"], r["ts"].timestamp()
        if now < until[u]:
            continue
        fails[u] = fails[u] + 1 if r["event_type"] == "error" else 0 if r["event_type"] == "signup" else fails[u]
        if fails[u] >= S.LOCK_AFTER:
            fails[u], until[u] = 0, int(now) + 60 * S.LOCK_MINUTES
            out.append((u, r["ts"]))
    return sorted(out)


def test_streams(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    got = S.drain(S.lockouts(S.read_events(spark, SF)), str(tmp_path / "lock"))
    assert sorted((r["user_id"], r["locked_at"]) for r in got.collect()) == plain_lockouts(events.collect())
    rates = S.with_open_windows(S.drain(S.rate_windows(S.read_events(spark, SF), 60), str(tmp_path / "rate")), events, 60)
    want = events.groupBy(F.window("ts", "60 minutes"), "user_id").count().select("user_id", "window.start", "count")
    assert sorted(map(tuple, rates.collect())) == sorted(map(tuple, want.collect()))
    assert S.drain(S.first_of_key(S.read_events(spark, SF), ["event_id"]), str(tmp_path / "first")).count() == events.count()


def test_open_windows_of_nothing_closed(spark):
    none = spark.createDataFrame([], "user_id long, start timestamp, n long")
    events = spark.sql("select timestamp'2024-01-01 00:10:00' ts, 1L user_id")
    assert S.with_open_windows(none, events, 60).count() == 1


def test_throttle(spark):
    calls = spark.createDataFrame([(i, "a", f"2024-01-01 00:00:{i:02d}", i in (1, 3, 4)) for i in range(8)] + [(9, "a", "2024-01-01 00:01:00", True), (10, "b", "2024-01-01 00:00:30", False)], "id int, key string, ts string, failed boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r["id"] for r in E.throttled(calls, 2).filter("rejected").collect()) == [4, 5, 6, 7]


def test_quantiles(spark):
    rows = [("a", 10.0, 50), ("a", 20.0, 50), ("b", None, 5), ("b", 10.0, 1), ("c", 10.0, 0), ("c", 20.0, 4)]
    got = {r["k"]: r["value"] for r in E.histogram_quantile(spark.createDataFrame(rows, "k string, le double, n long"), ["k"], 0.9).collect()}
    assert got == {"a": 18.0, "b": 10.0, "c": 19.0}


def test_fan_out_is_idempotent(spark):
    blocks = spark.createDataFrame([(1, "c", 0, False), (1, "c", 1, False), (1, "c", 2, False), (2, "d", 0, True), (2, "d", 1, False), (3, "e", 0, False)], "doc_id int, case_id string, block int, ambiguous boolean")
    none = spark.createDataFrame([], "key string")
    first = E.fan_out(blocks, none)
    assert sorted(r["key"] for r in first.collect()) == ["1:1", "1:2"] and E.fan_out(blocks, first).count() == 0
