"""Queues, limits and alerts over events, in batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Longest wait in seconds, its greatest power of two, retries of a document.
LONGEST_WAIT, GREATEST_POWER, RETRIES = 300, 8, 3


def wait_seconds(attempts: Column) -> Column:
    """Seconds until the next attempt: two to the number of attempts, bounded."""
    return F.least(F.lit(LONGEST_WAIT), F.pow(F.lit(2), F.least(attempts, F.lit(GREATEST_POWER))).cast("int"))


def throttled(calls: DataFrame, limit: int, window: str = "1 minute") -> DataFrame:
    """Calls (id, key, ts, failed) with ``rejected``: in a window of the key, ``limit`` calls had failed before it.

    A rejected call is not carried out and so counts for nothing; the calls that had failed before are thus the first ones.
    """
    w = Window.partitionBy("key", F.window("ts", window)).orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    return calls.withColumn("rejected", F.coalesce(F.sum(F.col("failed").cast("int")).over(w), F.lit(0)) >= limit)


def sweep(outbox: DataFrame, outcomes: DataFrame, now: Column, limit: int = 100) -> DataFrame:
    """Outbox (id, status, attempts, available_at, created_at) after a sweep at ``now``, with ``swept``.

    The oldest pending events that are due, ``limit`` at most (500 at most), are sent once more; outcomes (id, delivered) tells
    how that ends, no outcome is a failure. A failed one waits longer each time and stays pending.
    """
    due = outbox.filter((F.col("status") == "PENDING") & (F.col("available_at") <= now)).orderBy("created_at", "id").limit(max(1, min(limit, 500)))
    marked = outbox.join(F.broadcast(due.select("id", F.lit(True).alias("due"))), "id", "left").join(outcomes, "id", "left")  # 500 rows at most
    swept, sent = F.coalesce("due", F.lit(False)), F.coalesce("delivered", F.lit(False))
    attempts = F.col("attempts") + swept.cast("int")
    return marked.select(
        "id", F.when(swept & sent, "SENT").otherwise(F.col("status")).alias("status"), attempts.alias("attempts"),
        F.when(swept & ~sent, now + F.make_interval(secs=wait_seconds(attempts))).otherwise(F.col("available_at")).alias("available_at"), "created_at", swept.alias("swept"),
    )


def document_state(attempts: Column, error: Column) -> Column:
    """PARSED without an error; PENDING while retries are left; then FAILED, for the dead letters."""
    return F.when(error.isNull(), "PARSED").when(attempts <= RETRIES, "PENDING").otherwise("FAILED")


def fan_out(blocks: DataFrame, known: DataFrame) -> DataFrame:
    """New cases (case_id, doc_id, block, key) of documents in blocks (doc_id, case_id, block, ambiguous), keyed by document and block.

    A document of one block, or whose first is ambiguous, stays the one case it is, as is the first block of any other. Keys that
    are known (key) give no new case, so that a repeat makes none twice.
    """
    per = blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("ambiguous", "block").alias("unsure"))
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("block").cast("string"))
    many = blocks.join(per.filter("n > 1 and not unsure"), "doc_id").filter("block > 0").select("doc_id", "block", key.alias("key"))
    return many.join(known.select("key"), "key", "left_anti").select(F.concat(F.lit("case_"), F.substring(F.sha2(F.col("key").cast("binary"), 256), 1, 12)).alias("case_id"), "doc_id", "block", "key")


def reconcile(jobs: DataFrame, rows: DataFrame) -> DataFrame:
    """Jobs (job_id, status) after their rows (job_id, status) were counted: those still RUNNING whose rows have all ended take their end."""
    n = lambda s: F.count_if(F.col("status") == s)
    g = rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("total"), n("COMPLETED").alias("ok"), n("FAILED").alias("failed"), n("SKIPPED").alias("skipped"))
    ended = (F.col("ok") + F.col("failed") + F.col("skipped")) == F.col("total")
    end = F.when(F.col("failed") == F.col("total"), "FAILED").when(F.col("failed") > 0, "COMPLETED_WITH_ERRORS").otherwise("COMPLETED")
    return jobs.join(g, "job_id", "left").select("job_id", F.when((F.col("status") == "RUNNING") & ended, end).otherwise(F.col("status")).alias("status"), F.coalesce("total", F.lit(0).cast("long")).alias("total"))


def histogram_quantile(buckets: DataFrame, keys: list[str], q: float) -> DataFrame:
    """(keys, value): the ``q`` quantile of each histogram of buckets (keys, le, n), n values up to ``le`` and above the bucket before.

    Values are spread evenly within a bucket; the first begins at 0; above the last finite bound the bound stands. Null ``le`` is infinity.
    """
    upto = Window.partitionBy(*keys).orderBy(F.col("le").asc_nulls_last())
    rows = buckets.withColumn("c", F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, 0))).withColumn("low", F.coalesce(F.lag("le").over(upto), F.lit(0.0))).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    target = F.col("all") * q
    first = rows.filter((F.col("c") >= target) & (F.col("c") - F.col("n") < target))
    inside = F.col("low") + (F.col("le") - F.col("low")) * (target - (F.col("c") - F.col("n"))) / F.col("n")
    return first.select(*keys, F.when(F.col("le").isNull(), F.col("low")).otherwise(inside).alias("value"))
