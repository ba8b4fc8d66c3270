"""Structured Streaming forms of the rate, intake and lock-out operators over (event_id, ts, user_id, event_type)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCK_AFTER, LOCK_MINUTES = 8, 15


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream; a watermark needs the time as TIMESTAMP."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def rate_windows(events: DataFrame, minutes: int = 1, late: str = "10 minutes") -> DataFrame:
    """Calls by user in fixed windows; a window comes out once the watermark has passed it."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("window.start").alias("start"), "n")


def first_of_key(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Idempotent intake: the first event of a key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def lockouts(events: DataFrame, failure: str = "error", success: str = "signup") -> DataFrame:
    """(user_id, locked_at): a user is locked after ``LOCK_AFTER`` failures without a success between; later events wait it out."""

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        fails, until = state.get if state.exists else (0, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        now = 0
        for ts, kind in zip(rows["ts"], rows["event_type"]):
            now = int(ts.timestamp())
            if now < until:
                continue
            fails = fails + 1 if kind == failure else 0 if kind == success else fails
            if fails >= LOCK_AFTER:
                fails, until = 0, now + 60 * LOCK_MINUTES
                out.append((key[0], ts))
        if fails or len(rows) and now < until:
            state.update((fails, until))
        elif state.exists:
            state.remove()  # nothing to remember: users without failures keep no state
        yield pd.DataFrame(out, columns=["user_id", "locked_at"])

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, locked_at timestamp", "fails int, until long", "append", "NoTimeout")


def drain(stream: DataFrame, folder: str, at_once: bool = False) -> DataFrame:
    """Run a stream over what is there into a table under ``folder``, and read that table. A second run adds what is new.

    ``at_once`` takes all of it as one batch: state on processing time asks for batch after batch and would not end.
    """
    out = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/table")
    (out.trigger(once=True) if at_once else out.trigger(availableNow=True)).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/table")


def with_open_windows(closed: DataFrame, events: DataFrame, minutes: int) -> DataFrame:
    """``closed`` windows (user_id, start, n) of a stream, and those of events (ts, user_id) that its watermark has not passed.

    Windows close in order of time, so whatever starts after the last closed one is open; its events alone are counted.
    """
    last = closed.agg(F.max("start").alias("last"))  # one row
    later = events.join(F.broadcast(last)).filter(F.col("last").isNull() | (F.col("ts") >= F.col("last") + F.make_interval(mins=F.lit(minutes))))
    g = later.groupBy(F.window("ts", f"{minutes} minutes"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return closed.unionByName(g.select("user_id", F.col("window.start").alias("start"), "n"))
