"""Event queries: rates, cool-downs, lock-outs, sessions, and their streaming forms."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from dossierlake.operators import alerts as A
from dossierlake.operators import events as E
from dossierlake.plans.base import QUERIES, SQL, query, same_sql
from dossierlake.sources.shared import shared_folder
from dossierlake.streaming import events as S
from dossierlake.sources.versions import VersionedTable
from dossierlake.streaming import sinks
from dossierlake.streaming import state as K

same_sql(
    "t2_failure_rate",
    "SELECT user_id, CAST(date_trunc('HOUR', ts) AS TIMESTAMP) AS hour, CAST(count(*) AS BIGINT) AS failures FROM {events} WHERE event_type = 'error' GROUP BY user_id, date_trunc('HOUR', ts) HAVING count(*) >= 2",
    "SELECT user_id, date_trunc('hour', ts)::timestamp AS hour, count(*)::bigint AS failures FROM events WHERE event_type = 'error' GROUP BY 1, 2 HAVING count(*) >= 2",
)
same_sql(
    "t5_single_session",
    "SELECT event_id, user_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS revoked_by FROM {events} WHERE event_type = 'signup'",
)
same_sql("t6_purge", "SELECT event_id FROM {events} WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'")
same_sql("t8_idempotent_intake", "SELECT event_type, user_id, min(event_id) AS event_id FROM {events} GROUP BY event_type, user_id")
same_sql("a21_counters", "SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM {events} GROUP BY event_type")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)::bigint AS n FROM events")
def w12_sliding(t):
    secs = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(secs).rangeBetween(-3_600_000_000, 0)
    return t.events.select("event_id", F.count(F.lit(1)).over(w).alias("n"))


@query("SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*)::bigint AS n, count(*) > 3 AS rejected FROM events GROUP BY 1, 2")
def t1_rate(t):
    g = t.events.groupBy(F.window("ts", "1 hour").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", (F.col("n") > 3).alias("rejected"))


@query("SELECT event_id, CASE WHEN gap < 60 THEN 'COOLDOWN' WHEN n > 5 THEN 'BUDGET' ELSE 'OK' END AS gate FROM (SELECT event_id, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events)")
def t3_cooldown(t):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = t.events.select("event_id", "user_id", us.alias("us"))
    gap = (F.col("us") - F.lag("us").over(Window.partitionBy("user_id").orderBy("us", "event_id"))) / 1e6
    n = F.count(F.lit(1)).over(Window.partitionBy("user_id").orderBy("us").rangeBetween(-3_600_000_000, 0))
    return rows.withColumn("gap", gap).withColumn("n", n).select("event_id", F.when(F.col("gap") < 60, "COOLDOWN").when(F.col("n") > 5, "BUDGET").otherwise("OK").alias("gate"))


@query("""SELECT start, round(errors::double / n, 6) AS ratio FROM (SELECT start, count(*) FILTER (event_type = 'error') AS errors, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS start FROM events) GROUP BY start)""")
def t11_alert(t):
    g = t.events.groupBy(F.window("ts", "12 hours", "6 hours").alias("w")).agg(F.avg((F.col("event_type") == "error").cast("int")).alias("ratio"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.round("ratio", 6).alias("ratio"))


@query("SELECT event_id, ts + (least(300, 2 ** least(event_id % 12, 8)))::int * INTERVAL 1 SECOND AS retry_at FROM events")
def f28_backoff(t):
    wait = E.wait_seconds(F.col("event_id") % 12)
    return t.events.select("event_id", (F.col("ts") + F.make_interval(secs=wait)).alias("retry_at"))


def _stream(name, build, sql=None):
    def run(spark, sf_dir):
        events = S.read_events(spark, sf_dir)
        drained = lambda stream: S.drain(stream, f"{shared_folder(spark)}/stream-{name}-{uuid.uuid4().hex}")
        return build(events, drained, lambda: spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))

    QUERIES[name] = run
    if sql:
        SQL[name] = sql


_stream(
    "t1_stream_rate",
    lambda e, drained, batch: S.with_open_windows(drained(S.rate_windows(e, 60)), batch(), 60).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n"),
    "SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*)::bigint AS n FROM events GROUP BY 1, 2",
)
_stream("t8_stream_intake", lambda e, drained, _: drained(S.first_of_key(e, ["event_id"]).select("event_id", "user_id", "event_type")), "SELECT event_id, user_id, event_type FROM events")
_stream(
    "t4_stream_lockout", lambda e, drained, _: drained(S.lockouts(e)).withColumn("locked_at", F.col("locked_at").cast("timestamp_ntz")),
    """WITH RECURSIVE e AS (SELECT user_id, ts, event_type AS kind, floor(epoch(ts))::bigint AS now, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
      s AS (SELECT DISTINCT user_id, NULL::timestamp AS ts, 0::bigint AS n, 0 AS fails, 0::bigint AS until, false AS locked FROM e
        UNION ALL SELECT user_id, ts, n, CASE WHEN locked THEN 0 ELSE f END, CASE WHEN locked THEN now + 900 ELSE until END, locked FROM (
          SELECT *, now >= until AND f >= 8 AS locked FROM (
            SELECT e.user_id, e.ts, e.n, e.now, s.until, CASE WHEN e.now < s.until THEN s.fails WHEN kind = 'error' THEN s.fails + 1 WHEN kind = 'signup' THEN 0 ELSE s.fails END AS f FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)))
      SELECT user_id, ts AS locked_at FROM s WHERE locked""",
)


@query("SELECT event_id AS id, coalesce(sum((event_type = 'error')::int) OVER (PARTITION BY user_id, time_bucket(INTERVAL 1 DAY, ts) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 2 AS rejected FROM events")
def t2_throttled(t):
    calls = t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("failed"))
    return E.throttled(calls, 2, "1 day").select("id", "rejected")


@query("""WITH o AS (SELECT event_id AS id, event_type IN ('click', 'error') AS pending, event_id % 6 AS attempts, ts AS due, ts + event_id % 3 * INTERVAL 1 HOUR AS available FROM events),
  s AS (SELECT id FROM o WHERE pending AND available <= TIMESTAMP '2024-01-15 00:00:00' ORDER BY due, id LIMIT 500)
  SELECT o.id, CASE WHEN s.id IS NOT NULL AND o.id % 4 = 0 THEN 'SENT' WHEN pending THEN 'PENDING' ELSE 'SENT' END AS status, (attempts + (s.id IS NOT NULL)::int)::int AS attempts,
    CASE WHEN s.id IS NOT NULL AND o.id % 4 <> 0 THEN TIMESTAMP '2024-01-15 00:00:00' + least(300, 2 ** least(attempts + 1, 8))::int * INTERVAL 1 SECOND ELSE available END AS available_at FROM o LEFT JOIN s USING (id)""")
def t7_outbox_sweep(t):
    ts = F.col("ts").cast("timestamp")
    outbox = t.events.select(
        F.col("event_id").alias("id"), F.when(F.col("event_type").isin("click", "error"), "PENDING").otherwise("SENT").alias("status"), (F.col("event_id") % 6).cast("int").alias("attempts"),
        (ts + F.make_interval(hours=(F.col("event_id") % 3).cast("int"))).alias("available_at"), ts.alias("created_at"),
    )
    outcomes = t.events.select(F.col("event_id").alias("id"), (F.col("event_id") % 4 == 0).alias("delivered"))
    got = E.sweep(outbox, outcomes, F.lit("2024-01-15 00:00:00").cast("timestamp"), 900)
    return got.select("id", "status", "attempts", F.col("available_at").cast("timestamp_ntz").alias("available_at"))


@query("SELECT event_id, CASE WHEN event_type <> 'error' THEN 'PARSED' WHEN event_id % 6 <= 3 THEN 'PENDING' ELSE 'FAILED' END AS state FROM events")
def t7_document_state(t):
    return t.events.select("event_id", E.document_state((F.col("event_id") % 6).cast("int"), F.when(F.col("event_type") == "error", F.lit("x"))).alias("state"))


@query("""WITH b AS (SELECT conv_id AS doc_id, turn AS block, count(*) OVER (PARTITION BY conv_id) AS n, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations)
  SELECT 'case_' || left(sha256(doc_id || ':' || block), 12) AS case_id, doc_id, block, doc_id || ':' || block AS key FROM b WHERE n > 1 AND doc_id % 3 <> 0 AND block > 0 AND (doc_id + block) % 5 <> 0""")
def t9_fan_out(t):
    blocks = t.conversations.select(F.col("conv_id").alias("doc_id"), F.lit("x").alias("case_id"), F.col("turn").alias("block"), (F.col("conv_id") % 3 == 0).alias("ambiguous"))
    known = t.conversations.filter("(conv_id + turn) % 5 = 0").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"))
    return E.fan_out(blocks, known)


@query("""WITH r AS (SELECT o_custkey % 200 AS job_id, count(*)::bigint AS total, count(*) FILTER (o_orderstatus = 'P')::bigint AS open, count(*) FILTER (o_orderpriority = '5-LOW' AND o_orderstatus <> 'P')::bigint AS failed FROM orders GROUP BY 1)
  SELECT j.id AS job_id, CASE WHEN j.id % 4 <> 0 AND open = 0 THEN CASE WHEN failed = total THEN 'FAILED' WHEN failed > 0 THEN 'COMPLETED_WITH_ERRORS' ELSE 'COMPLETED' END WHEN j.id % 4 <> 0 THEN 'RUNNING' ELSE 'CANCELLED' END AS status, coalesce(total, 0)::bigint AS total FROM range(200) j(id) LEFT JOIN r ON r.job_id = j.id""")
def t10_reconcile(t):
    status = F.when(F.col("o_orderstatus") == "P", "RUNNING").when(F.col("o_orderpriority") == "5-LOW", "FAILED").otherwise("COMPLETED")
    rows = t.orders.select((F.col("o_custkey") % 200).alias("job_id"), status.alias("status"))
    jobs = t.spark.range(200).select(F.col("id").alias("job_id"), F.when(F.col("id") % 4 != 0, "RUNNING").otherwise("CANCELLED").alias("status"))
    return E.reconcile(jobs, rows)


@query("""WITH v AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, list_filter([10.0, 50.0, 100.0, 500.0], lambda x: x >= value)[1]::double AS le FROM events), b AS (SELECT start, le, count(*) AS n FROM v GROUP BY 1, 2),
  c AS (SELECT *, sum(n) OVER w AS c, coalesce(lag(le) OVER w, 0) AS low, sum(n) OVER (PARTITION BY start) AS total FROM b WINDOW w AS (PARTITION BY start ORDER BY le NULLS LAST))
  SELECT start, round(CASE WHEN le IS NULL THEN low ELSE low + (le - low) * (0.95::double * total - (c - n)) / n END, 6) AS p95 FROM c WHERE c >= 0.95::double * total AND c - n < 0.95::double * total""")
def t11_p95(t):
    le = F.get(F.filter(F.array(*[F.lit(x) for x in (10.0, 50.0, 100.0, 500.0)]), lambda x: x >= F.col("value")), 0)
    buckets = t.events.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("start"), le.alias("le")).agg(F.count(F.lit(1)).alias("n"))
    return E.histogram_quantile(buckets, ["start"], 0.95).select("start", F.round("value", 6).alias("p95"))


def _stateful(name, build, sql, at_once=False):
    """A query of a stream with keyed state over the events, drained into a table."""

    def run(spark, sf_dir):
        with K.keyed_state(spark):
            return build(S.drain(build.stream(spark, sf_dir), f"{shared_folder(spark)}/stream-{name}-{uuid.uuid4().hex}", at_once))

    QUERIES[name] = run
    SQL[name] = sql


def _from(stream):
    def mark(f):
        f.stream = stream
        return f

    return mark


@_from(lambda spark, sf_dir: K.admissions(S.read_events(spark, sf_dir), 4 * 3600, 3, 48 * 3600))
def _gates(table):
    return table.select("event_id", "gate")


#: Admissions one after another: each user's next request meets the times of those admitted in the two days before
_stateful("t3_stream_admissions", _gates, """
  WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  s AS (SELECT user_id, event_id, n, [us] AS admitted, 'OK' AS gate FROM e WHERE n = 1
    UNION ALL SELECT user_id, event_id, n, CASE WHEN gate = 'OK' THEN list_append(live, us) ELSE live END, gate FROM (
      SELECT user_id, event_id, n, us, live, CASE WHEN len(live) > 0 AND us - live[-1] < 14400000000 THEN 'COOLDOWN' WHEN len(live) >= 3 THEN 'BUDGET' ELSE 'OK' END AS gate
      FROM (SELECT e.user_id, e.event_id, e.n, e.us, list_filter(s.admitted, lambda t: e.us - t <= 172800000000) AS live FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)))
  SELECT event_id, gate FROM s""")


@_from(lambda spark, sf_dir: K.sessions(S.read_events(spark, sf_dir).filter("event_type = 'signup'")))
def _session_rows(table):
    return table.select("event_id", "what", F.timestamp_micros("us").cast("timestamp_ntz").alias("at"), "by")


_stateful("t5_stream_sessions", _session_rows, """
  WITH l AS (SELECT event_id, ts, lead(event_id) OVER w AS next, lead(ts) OVER w AS next_ts FROM events WHERE event_type = 'signup' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  e AS (SELECT *, ts + INTERVAL 12 HOUR AS ends FROM l), m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM l)
  SELECT event_id, 'OPENED' AS what, ts AS "at", NULL::bigint AS "by" FROM e
  UNION ALL SELECT event_id, 'REVOKED', next_ts, next FROM e WHERE next_ts < ends
  UNION ALL SELECT event_id, 'EXPIRED', ends, NULL FROM e, m WHERE (next_ts IS NULL OR next_ts >= ends) AND (ends <= next_ts OR ends <= date_trunc('millisecond', mark))""")

@_from(lambda spark, sf_dir: K.once_within(S.read_events(spark, sf_dir).withColumn("key", F.concat_ws(":", F.col("user_id").cast("string"), "event_type")), "key", 86_400))
def _once(table):
    return table.select("key", "event_id")


_stateful("t6_stream_once", _once, "SELECT user_id || ':' || event_type AS key, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1", at_once=True)

STEP = 3600
RULES = [
    A.Rule("errors", "event_type = 'error'", "true", 0.2, 6 * 3600, 3 * 3600),
    A.Rule("refused", "event_type = 'error'", "event_type in ('error', 'purchase')", 0.55, 3 * 3600, 2 * 3600),
    A.Rule("costly", "value > 60", "event_type <> 'view'", 0.3, 3600, 3600),
]
_RULES_SQL = "(VALUES ('errors', 0.2, 6, 10800), ('refused', 0.55, 3, 7200), ('costly', 0.3, 1, 3600)) AS r(rule, above, steps, hold)"
_RATED = f"""WITH e AS (SELECT event_type, value, (epoch_us(ts) // 3600000000) AS h FROM events),
  x AS (SELECT rule, hold, above, (h + 1 + k) * 3600 AS tick, CASE rule WHEN 'costly' THEN value > 60 ELSE event_type = 'error' END AS hit
    FROM e, {_RULES_SQL}, range(0, 6) t(k) WHERE k < steps AND CASE rule WHEN 'errors' THEN true WHEN 'refused' THEN event_type IN ('error', 'purchase') ELSE event_type <> 'view' END),
  g AS (SELECT rule, hold, above, tick, avg(hit::int::double) AS ratio FROM x GROUP BY ALL),
  i AS (SELECT *, tick - 3600 * row_number() OVER (PARTITION BY rule ORDER BY tick) AS island FROM g WHERE ratio > above)"""
_INTERVALS = _RATED + """ SELECT rule, min(tick)::bigint AS since, CASE WHEN max(tick) - min(tick) >= any_value(hold) THEN min(tick) + any_value(hold) END::bigint AS firing, (max(tick) + 3600)::bigint AS resolved, round(max(ratio), 6) AS peak FROM i GROUP BY rule, island"""


@query(_INTERVALS)
def t11_alert_intervals(t):
    """Rules that must hold for some time before they fire."""
    return A.intervals(A.evaluations(t.events, RULES, STEP), RULES, STEP).withColumn("peak", F.round("peak", 6))


def _alert_stream(spark, sf_dir):
    """Evaluations, written as a table by time, then read as a stream."""
    folder = f"{shared_folder(spark)}/evaluations-{uuid.uuid4().hex}"
    rated = A.evaluations(spark.read.parquet(f"{sf_dir}/events.parquet"), RULES, STEP)
    rated.withColumn("ts", F.timestamp_seconds("at")).write.parquet(folder)
    rows = spark.readStream.schema("rule string, at long, ratio double, held boolean, ts timestamp").parquet(folder)
    return K.alert_intervals(rows, STEP, {r.name: r.hold for r in RULES})


@_from(_alert_stream)
def _intervals(table):
    return table.withColumn("peak", F.round("peak", 6))


#: Intervals that had ended when the stream's watermark, the last evaluation, was reached
_stateful("t11_stream_alerts", _intervals, _INTERVALS.replace(_RATED, _RATED + ", z AS (SELECT max(tick) AS mark FROM g)") + " HAVING max(tick) + 7200 <= (SELECT mark FROM z) OR max(tick) < (SELECT max(tick) FROM g WHERE g.rule = i.rule)")


def _sink(name, rows, keys, change, empty, sql, read=lambda table: table):
    """A query of a stream that is folded into a versioned table, batch by batch."""

    def run(spark, sf_dir):
        folder = f"{shared_folder(spark)}/sink-{name}-{uuid.uuid4().hex}"
        table = VersionedTable(spark, f"{folder}/table", keys, 16)
        return read(sinks.run(rows(S.read_events(spark, sf_dir)), table, change, f"{folder}/checkpoint", empty))

    QUERIES[name] = run
    SQL[name] = sql


_sink(
    "t7_stream_outbox", lambda e: e.select(F.col("user_id").alias("id"), "ts", (F.col("event_id") % 40 == 0).alias("delivered")), ["id"], sinks.delivered, sinks.DELIVERY,
    """WITH a AS (SELECT user_id AS id, ts, event_id % 40 = 0 AS ok FROM events), s AS (SELECT id, min(ts) FILTER (ok) AS sent FROM a GROUP BY 1),
      n AS (SELECT id, sent, count(*) FILTER (sent IS NULL OR ts <= sent) AS n, max(ts) AS last FROM a JOIN s USING (id) GROUP BY ALL)
      SELECT id, CASE WHEN sent IS NULL THEN 'PENDING' ELSE 'SENT' END AS status, n::int AS attempts, CASE WHEN sent IS NULL THEN last + least(300, 2 ** least(n, 8))::int * INTERVAL 1 SECOND END AS available_at FROM n""",
    lambda table: table.withColumn("available_at", F.col("available_at").cast("timestamp_ntz")),
)
_sink(
    "t10_stream_reconcile", lambda e: e.filter("event_type in ('purchase', 'error')").select((F.col("user_id") % 40).alias("job_id"), F.when(F.col("event_type") == "error", "FAILED").otherwise("COMPLETED").alias("status")),
    ["job_id"], sinks.reconciled("job_id * 12"), sinks.JOB,
    """WITH r AS (SELECT user_id % 40 AS job_id, count(*) FILTER (event_type = 'purchase') AS ok, count(*) FILTER (event_type = 'error') AS failed FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1)
      SELECT job_id, job_id * 12 AS expected, ok, failed, CASE WHEN ok + failed < job_id * 12 THEN 'RUNNING' WHEN failed = job_id * 12 THEN 'FAILED' WHEN failed > 0 THEN 'COMPLETED_WITH_ERRORS' ELSE 'COMPLETED' END AS status FROM r""",
)
_sink(
    "t12_stream_decisions",
    lambda e: e.select(F.col("user_id").alias("item_id"), "ts", F.col("event_id").alias("seq"), (F.col("event_id") % 4).alias("expected_version"), F.concat("event_type", F.lit("-"), F.col("event_id").cast("string")).alias("decision")),
    ["item_id"], sinks.decided, sinks.ITEM,
    """WITH RECURSIVE e AS (SELECT user_id AS item_id, event_id % 4 AS expects, event_type || '-' || event_id AS decision, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
      s AS (SELECT DISTINCT item_id, 0::bigint AS n, 0::bigint AS version, NULL::varchar AS decision, 0::bigint AS refused FROM e
        UNION ALL SELECT e.item_id, e.n, CASE WHEN expects = version THEN version + 1 ELSE version END, CASE WHEN expects = version THEN e.decision ELSE s.decision END, CASE WHEN expects = version THEN refused ELSE refused + 1 END FROM s JOIN e ON e.item_id = s.item_id AND e.n = s.n + 1)
      SELECT item_id, version, decision, refused FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY n DESC) = 1""",
)
