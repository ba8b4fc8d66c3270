"""Versioned tables and the streams that are folded into them."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from dossierlake.operators import alerts
from dossierlake.sources.versions import VersionedTable
from dossierlake.streaming import events as S
from dossierlake.streaming import sinks, state

ROWS = [(i, f"n{i}", i % 7) for i in range(200)]


def table_of(spark, folder, buckets=16):
    table = VersionedTable(spark, f"file://{folder}/table", ["id"], buckets)
    table.create(spark.createDataFrame(ROWS, "id long, name string, v long"))
    return table


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    table = table_of(spark, tmp_path)
    before = table.manifest()
    changes = spark.createDataFrame([(3, "new", 1), (3, "new", 0), (900, "more", 2)], "id long, name string, v long")
    assert table.upsert(changes, spark.createDataFrame([(5,), (901,)], "id long")) == 1
    after = table.manifest()
    touched = {b for b in after if after[b] != before.get(b)}
    assert 0 < len(touched) <= 4 and all(after[b][0] == 1 for b in touched) and all(after[b] == before[b] for b in set(after) - touched)
    want = {i: (i, n, v) for i, n, v in ROWS if i != 5} | {3: (3, "new", 1), 900: (900, "more", 2)}
    assert rows(table.read()) == sorted(want.values()) and rows(table.read(0)) == sorted(ROWS)


def test_rollback_and_diff(spark, tmp_path):
    table = table_of(spark, tmp_path)
    table.upsert(spark.createDataFrame([(3, "new", 3), (4, "n4", 4), (900, None, 2)], "id long, name string, v long"), spark.createDataFrame([(5,)], "id long"))
    assert rows(table.diff(0, 1)) == [(3, "CHANGED", "name"), (5, "REMOVED", None), (900, "ADDED", None)]
    assert len(table.unlike(0, 1)) <= 3 and table.unlike(1, 1) == set() and rows(table.diff(1, 1)) == []
    table.rollback(0)
    assert table.version() == 0 and rows(table.read()) == sorted(ROWS)
    assert table.upsert(spark.createDataFrame([(1, "x", 1)], "id long, name string, v long")) == 2  # numbers are not used again
    assert rows(table.diff(0, 2)) == [(1, "CHANGED", "name")] and len(table.log()) == 4
    with pytest.raises(ValueError):
        table.rollback(9)


def test_second_writer_is_refused(spark, tmp_path):
    table = table_of(spark, tmp_path)
    with pytest.raises(RuntimeError):
        table._append(0, {"version": 7})
    assert table.version() == 0


def test_emptied_table(spark, tmp_path):
    table = table_of(spark, tmp_path, 2)
    none = spark.createDataFrame([], "id long, name string, v long")
    table.upsert(none, table.read().select("id"))
    assert rows(table.read()) == [] and table.upsert(none) == 2 and table.read().columns == ["id", "name", "v"]


def day(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def stream_of(spark, folder, batches, schema):
    """A stream with a file for each batch, in order."""
    import os

    for k, batch in enumerate(batches):
        path = f"{folder}/in/{k}"
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(path)
        for f in os.listdir(path):
            if f.endswith(".parquet"):
                os.utime(f"{path}/{f}", (1_000_000 + k, 1_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")


DECISIONS = "item_id long, ts timestamp, seq long, expected_version long, decision string"


def test_replayed_batch_changes_nothing(spark, tmp_path):
    """Stopped after the table has its log entry and before the stream commits: the batch comes again and is known."""
    batches = [[(1, day(0), 1, 0, "a"), (2, day(1), 2, 0, "b"), (1, day(2), 3, 0, "late")], [(1, day(3), 4, 1, "c"), (2, day(4), 5, 0, "stale")], [(3, day(5), 6, 0, "d")]]
    stream = stream_of(spark, tmp_path, batches, DECISIONS)
    table = VersionedTable(spark, f"file://{tmp_path}/table", ["item_id"], 4)
    table.create(spark.createDataFrame([], sinks.ITEM))
    once = sinks.into(table, sinks.decided)
    stopped = []

    def stops(batch, number):
        once(batch, number)
        if number == 1 and not stopped:
            stopped.append(number)
            raise RuntimeError("stopped before the commit")

    def start():
        return stream.writeStream.foreachBatch(stops).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()

    with pytest.raises(Exception, match="stopped before the commit"):
        start().awaitTermination()
    assert [e["batch"] for e in table.log()] == [None, 0, 1]
    start().awaitTermination()
    assert [e["batch"] for e in table.log()] == [None, 0, 1, 2]
    assert rows(table.read()) == [(1, 2, "c", 1), (2, 1, "b", 1), (3, 1, "d", 0)]


def test_batch_stopped_before_its_log_entry(spark, tmp_path):
    table = table_of(spark, tmp_path)
    changes = spark.createDataFrame([(3, "new", 1)], "id long, name string, v long")
    kept = table._append
    table._append = lambda *_: (_ for _ in ()).throw(RuntimeError("stopped"))
    with pytest.raises(RuntimeError):
        table.upsert(changes, batch=0)
    assert rows(table.read()) == sorted(ROWS)
    table._append = kept
    assert table.upsert(changes, batch=0) == 1 and table.upsert(changes, batch=0) == 1 and len(table.log()) == 2


def test_outbox_and_jobs_over_batches(spark, tmp_path):
    attempts = "id long, ts timestamp, delivered boolean"
    stream = stream_of(spark, tmp_path / "a", [[(1, day(0), False), (2, day(0), True)], [(1, day(9), False), (2, day(9), False)], [(1, day(20), True), (3, day(1), False), (3, day(2), False)]], attempts)
    got = sinks.run(stream, VersionedTable(spark, f"file://{tmp_path}/o", ["id"], 4), sinks.delivered, f"{tmp_path}/oc", sinks.DELIVERY)
    assert rows(got) == [(1, "SENT", 3, None), (2, "SENT", 1, None), (3, "PENDING", 2, day(2 + 4))]
    ended = stream_of(spark, tmp_path / "b", [[(1, "COMPLETED"), (2, "FAILED")], [(1, "FAILED"), (2, "FAILED"), (3, "COMPLETED")]], "job_id long, status string")
    got = sinks.run(ended, VersionedTable(spark, f"file://{tmp_path}/j", ["job_id"], 4), sinks.reconciled("2"), f"{tmp_path}/jc", sinks.JOB)
    assert rows(got) == [(1, 2, 1, 1, "COMPLETED_WITH_ERRORS"), (2, 2, 0, 2, "FAILED"), (3, 2, 1, 0, "RUNNING")]


EVENTS = "event_id long, ts timestamp, user_id long, event_type string"


def event_batches(seed, n, span):
    rnd = random.Random(seed)
    made = sorted((rnd.randrange(span), rnd.randrange(4)) for _ in range(n))
    made = [(i, day(s), u, rnd.choice(["error", "view"])) for i, (s, u) in enumerate(made)]
    return made, [made[: n // 3], made[n // 3 : n // 2], made[n // 2 :]]


def test_admissions_over_batches(spark, tmp_path):
    made, batches = event_batches(1, 240, 6 * 3600)
    with state.keyed_state(spark):
        got = S.drain(state.admissions(stream_of(spark, tmp_path, batches, EVENTS), 120, 4), f"file://{tmp_path}/out").collect()
    held, want = {}, []
    for i, ts, u, _ in made:
        times = [t for t in held.get(u, []) if (ts - t).total_seconds() <= 3600]
        gate = "COOLDOWN" if times and (ts - times[-1]).total_seconds() < 120 else "BUDGET" if len(times) >= 4 else "OK"
        held[u] = times + [ts] * (gate == "OK")
        want.append((i, u, gate))
    assert sorted(map(tuple, got)) == want and {g for *_, g in want} == {"OK", "COOLDOWN", "BUDGET"}


def test_sessions_over_batches(spark, tmp_path):
    made, batches = event_batches(2, 60, 20 * 3600)
    with state.keyed_state(spark):
        got = S.drain(state.sessions(stream_of(spark, tmp_path, batches, EVENTS), 1), f"file://{tmp_path}/out").collect()
    mark = made[-1][1] - dt.timedelta(minutes=10)
    want = []
    for k, (i, ts, u, _) in enumerate(made):
        want.append((i, "OPENED", None))
        after = next((r for r in made[k + 1 :] if r[2] == u), None)
        ends = ts + dt.timedelta(hours=1)
        if after and after[1] < ends:
            want.append((i, "REVOKED", after[0]))
        elif after or ends <= mark:
            want.append((i, "EXPIRED", None))
    assert sorted(((r["event_id"], r["what"], r["by"]) for r in got), key=str) == sorted(want, key=str)
    assert len({w[1] for w in want}) == 3


def test_keys_are_forgotten_after_their_time(spark, tmp_path):
    """A second run within the time to live lets nothing through again; after it the keys are new."""
    import time

    for seconds, pause, again in ((3600, 0, 1), (1, 4, 3)):
        folder = tmp_path / str(seconds)
        rows_ = [(1, day(5), 7, "a"), (2, day(3), 7, "a"), (3, day(9), 8, "b")]
        later = [(4, day(20), 7, "a"), (5, day(21), 9, "c"), (6, day(22), 8, "b")]
        with state.keyed_state(spark):
            stream = stream_of(spark, folder, [rows_], EVENTS)
            first = S.drain(state.once_within(stream, "user_id", seconds), f"file://{folder}/out", at_once=True).collect()
            assert sorted((r["event_id"], r["key"]) for r in first) == [(2, "7"), (3, "8")]
            time.sleep(pause)
            spark.createDataFrame(later, EVENTS).coalesce(1).write.parquet(f"{folder}/in/late")
            both = S.drain(state.once_within(stream, "user_id", seconds), f"file://{folder}/out", at_once=True)
        assert both.count() == 2 + again and {r["key"] for r in both.collect()} == {"7", "8", "9"}


def plain_intervals(held, step, hold):
    out = []
    for at, ratio in sorted(held):
        if out and at == out[-1][1] + step:
            out[-1] = (out[-1][0], at, max(out[-1][2], ratio))
        else:
            out.append((at, at, ratio))
    return [(a, a + hold if z - a >= hold else None, z + step, p) for a, z, p in out]


def test_alerts_in_batch_and_stream(spark, tmp_path):
    made, _ = event_batches(3, 400, 3 * 86400)
    rules = [alerts.Rule("share", "event_type = 'error'", "true", 0.5, 7200, 5400), alerts.Rule("some", "event_type = 'error'", "user_id < 2", 0.6, 1800, 0)]
    events = spark.createDataFrame(made, EVENTS)
    rated = alerts.evaluations(events, rules, 1800)
    seconds = lambda ts: ts.replace(tzinfo=dt.timezone.utc).timestamp()
    want = []
    for r, among in zip(rules, (lambda e: True, lambda e: e[2] < 2)):
        held = []
        for at in range(int(seconds(made[0][1])) // 1800 * 1800, int(seconds(made[-1][1])) + 3 * 7200, 1800):
            own = [e for e in made if at - r.window <= seconds(e[1]) < at and among(e)]
            ratio = sum(e[3] == "error" for e in own) / len(own) if own else 0
            if ratio > r.above:
                held.append((at, ratio))
        want += [(r.name, *x) for x in plain_intervals(held, 1800, r.hold)]
    assert sorted(map(tuple, alerts.intervals(rated, rules, 1800).collect()), key=str) == sorted(want, key=str) and len(want) > 10
    rows_ = sorted(map(tuple, rated.withColumn("ts", F.timestamp_seconds("at")).select("rule", "ts", "at", "ratio", "held").collect()), key=lambda r: r[1])
    stream = stream_of(spark, tmp_path, [rows_[:100], rows_[100:]], "rule string, ts timestamp, at long, ratio double, held boolean")
    with state.keyed_state(spark):
        got = S.drain(state.alert_intervals(stream, 1800, {r.name: r.hold for r in rules}), f"file://{tmp_path}/out").collect()
    last = max(r[2] for r in rows_)
    ended = [w for w in want if w[3] + 1800 <= last or any(r[0] == w[0] and r[2] >= w[3] for r in rows_)]
    assert sorted(map(tuple, got), key=str) == sorted(ended, key=str)
    at = spark.createDataFrame([(10, 30, 50)], "since long, firing long, resolved long")
    assert at.select(*[alerts.state_at(F.lit(x)) for x in (5, 10, 30, 50)]).first()[:] == ("INACTIVE", "PENDING", "FIRING", "INACTIVE")


def test_a_key_costs_few_calls_of_its_state():
    """Rows of a key are rows, not frames, and its timer is known from its state: none are listed."""
    from pyspark.sql import Row

    class Handle:
        def __init__(self):
            self.calls, self.timers, self.held = [], set(), None

        def getValueState(self, *_, **__):
            return self

        def get(self):
            self.calls.append("get")
            return self.held

        def update(self, value):
            self.calls.append("update")
            self.held = value

        def registerTimer(self, at):
            self.timers.add(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

    hour, handle = 3_600_000_000, Handle()
    sessions = state._Sessions(1)
    sessions.init(handle)
    got = list(sessions.handleInputRows((7,), iter([Row(event_id=2, us=hour), Row(event_id=1, us=0)]), None))
    assert [(r.event_id, r.what, r.by) for r in got] == [(1, "OPENED", None), (1, "EXPIRED", None), (2, "OPENED", None)] and handle.timers == {7_200_000}
    got = list(sessions.handleInputRows((7,), iter([Row(event_id=3, us=hour + 5)]), None))
    assert [(r.event_id, r.what, r.by) for r in got] == [(2, "REVOKED", 3), (3, "OPENED", None)] and handle.timers == {7_200_001}
    assert handle.calls == ["get", "update"] * 2
    once, handle = state._Once(5), Handle()
    once.init(handle)
    rows = lambda: iter([Row(event_id=3, us=9), Row(event_id=2, us=9), Row(event_id=1, us=10)])
    assert [r.event_id for r in once.handleInputRows(("k",), rows(), None)] == [2] and list(once.handleInputRows(("k",), rows(), None)) == []
    assert handle.calls == ["get", "update", "get"]
