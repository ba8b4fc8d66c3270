"""Streams into versioned tables: a batch is one log entry, so a batch that is replayed changes nothing.

The order is data, manifest, log entry, and only then the stream's own commit. Stopped before the log entry, the
batch left nothing that is read; stopped after it, the replay finds its number in the log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierlake.operators.events import wait_seconds
from dossierlake.sources.versions import VersionedTable


def into(table: VersionedTable, change: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame | None]]):
    """A ``foreachBatch`` function that folds each batch into ``table``."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.persist()  # read for its buckets and for its changes
        try:
            table.fold(change, rows, number, f"batch {number}")
        finally:
            rows.unpersist()

    return write


def run(stream: DataFrame, table: VersionedTable, change, checkpoint: str, empty: str) -> DataFrame:
    """Fold what there is of ``stream`` into ``table``, which is made empty where it does not exist; the table's rows."""
    if table.version() < 0:
        table.create(stream.sparkSession.createDataFrame([], empty))
    stream.writeStream.foreachBatch(into(table, change)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return table.read()


DELIVERY = "id long, status string, attempts int, available_at timestamp"


def delivered(now: DataFrame, attempts: DataFrame) -> tuple[DataFrame, None]:
    """Outbox rows (``DELIVERY``) after attempts (id, ts, delivered): once SENT an event stays so and is not attempted again.

    Attempts count up to the one that delivers; a failed one waits longer each time, from its own time on.
    """
    done = attempts.groupBy("id").agg(F.min(F.when(F.col("delivered"), F.struct("ts"))).alias("sent"), F.max("ts").alias("last"))
    counted = attempts.join(done, "id").filter(F.col("sent").isNull() | (F.col("ts") <= F.col("sent.ts")))
    batch = counted.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.bool_or("delivered").alias("ok"), F.max("ts").alias("last"))
    rows = batch.join(now, "id", "left").filter(F.coalesce(F.col("status") != "SENT", F.lit(True)))
    total = (F.coalesce("attempts", F.lit(0)) + F.col("n")).cast("int")
    after = F.when(~F.col("ok"), F.col("last") + F.make_interval(secs=wait_seconds(total)))
    return rows.select("id", F.when(F.col("ok"), "SENT").otherwise("PENDING").alias("status"), total.alias("attempts"), after.alias("available_at")), None


JOB = "job_id long, expected long, ok long, failed long, status string"


def reconciled(expected: str):
    """Jobs (``JOB``) after ended rows (job_id, status): a job ends when as many have ended as ``expected``, an expression of job_id, says."""

    def change(now: DataFrame, rows: DataFrame) -> tuple[DataFrame, None]:
        ended = rows.groupBy("job_id").agg(F.count_if(F.col("status") == "COMPLETED").alias("more_ok"), F.count_if(F.col("status") == "FAILED").alias("more_failed"))
        both = ended.join(now, "job_id", "left")
        ok, failed = F.coalesce("ok", F.lit(0)) + F.col("more_ok"), F.coalesce("failed", F.lit(0)) + F.col("more_failed")
        whole = F.coalesce(F.col("expected"), F.expr(expected)).cast("long")
        end = F.when(failed == whole, "FAILED").when(failed > 0, "COMPLETED_WITH_ERRORS").otherwise("COMPLETED")
        status = F.when(ok + failed >= whole, end).otherwise("RUNNING")
        return both.select("job_id", whole.alias("expected"), ok.alias("ok"), failed.alias("failed"), status.alias("status")), None

    return change


ITEM = "item_id long, version long, decision string, refused long"


def decided(now: DataFrame, decisions: DataFrame) -> tuple[DataFrame, None]:
    """Items (``ITEM``) after decisions (item_id, ts, seq, expected_version, decision) under an optimistic lock.

    In order of (ts, seq), a decision is applied if it expects the item's version, which then rises by one; a stale
    one is refused and counted. An item is at version 0 before its first decision.
    """
    asked = decisions.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "expected_version", "decision"))).alias("asked"))  # one item's decisions of a batch
    both = asked.join(now, "item_id", "left")
    start = F.struct(F.coalesce("version", F.lit(0)).cast("long").alias("version"), F.col("decision").alias("decision"), F.coalesce("refused", F.lit(0)).cast("long").alias("refused"))

    def step(s, x):
        fits = x["expected_version"] == s["version"]
        return F.struct(
            F.when(fits, s["version"] + 1).otherwise(s["version"]).alias("version"), F.when(fits, x["decision"]).otherwise(s["decision"]).alias("decision"),
            F.when(fits, s["refused"]).otherwise(s["refused"] + 1).alias("refused"),
        )

    return both.select("item_id", F.aggregate("asked", start, step).alias("r")).select("item_id", "r.*"), None
