"""Helpers shared by the operators: table reading, shared-folder tables and compact components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a local one only where it is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='dossierlake-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, what: str, measure: Column) -> tuple[DataFrame, int]:
    """``df`` as ``materialize`` gives it, and the aggregate ``measure`` of its rows (0 for none), taken as they are written."""
    seen = Observation()
    out = materialize(df.observe(seen, measure.alias("measure")), what)
    return out, seen.get.get("measure") or 0


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, label), label the least reachable node.

    Every round takes the least label among a node and its neighbours and then jumps to that label's
    own label, so chains shrink exponentially. Labels live in shared-folder tables, never on the driver.
    """
    both = materialize(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges"
    )
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    labels = materialize(labels.select("node", F.least("node", "m").alias("label")), "labels")
    for _ in range(max_rounds):
        own = labels.select("node", F.col("label").alias("near"), "label")
        around = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), F.col("label").alias("near"), F.lit(None).cast("long").alias("label"))
        step = own.unionByName(around).groupBy("node").agg(F.min("near").alias("near"), F.max("label").alias("label"))
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        fresh = step.join(hop, "label").select("node", F.least("near", "jump").alias("next"), "label")
        fresh, moved = measured(fresh, "labels", F.count_if(F.col("next") != F.col("label")))
        labels = fresh.select("node", F.col("next").alias("label"))
        if not moved:
            return labels
    raise RuntimeError("components did not settle")


def bounded_sample(rows: DataFrame, by: str, size: int, key: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """About ``size`` rows of each value of ``by``, by a hash of ``key``: alike in every run.

    A hot text takes no more than its share, as its copies hash apart.
    """
    counts = {r[by]: r["n"] for r in rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, size / n))]) if counts else None
    if share is None:
        return rows.limit(0)
    spread = F.pmod(F.xxhash64(*key), F.lit(1_000_003)) / 1_000_003
    return rows.filter(spread < share[F.col(by)])


def labelled_sample(docs: DataFrame, labels: DataFrame, by: str, size: int) -> DataFrame:
    """(doc_id, text, ``by``) of about ``size`` labelled documents of each class, 0 and 1, as a shared table.

    The labels are sampled before they meet the texts, so they can be sent to every task (``size`` rows a
    class) and no text but those chosen is moved. A doc_id that repeats gives one text, the least; null and
    empty texts and null doc_ids give none.
    """
    known = labels.filter(F.col(by).isin(0, 1)).select("doc_id", by).distinct()
    chosen = F.broadcast(bounded_sample(known, by, size, ("doc_id",)))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.length("text") > 0)
    return materialize(texts.join(chosen, "doc_id").groupBy("doc_id", by).agg(F.min("text").alias("text")), "labelled")
