"""Exact top-k search with a vector-approximation file.

Every vector has an approximation: the cell of each component, one byte. A scan of the cells bounds each
inner product from both sides; candidates whose upper bound reaches the k-th best lower bound survive.
Exact vectors are then read in bound order: first each query's best bounds, whose k-th exact score
decides which further survivors must be read until the result is certain.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossierlake.llm.common import materialize

CELLS = 256
CHUNK = 16384  # candidates scanned at once
BLOCK = 2048  # queries that meet a chunk in one task
STEP = 64  # queries scanned at once


def integer_vectors(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v): components as floor(scale * x). Null or non-finite components drop the row, so does a null id."""
    real = F.transform("embedding", lambda x: x.cast("double"))
    odd = F.exists(real, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(~odd)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(real, lambda x: F.floor(x * scale)).alias("v"))


def _cells(low: np.ndarray, width: np.ndarray):
    dims = len(low)

    def run(frames):
        for f in frames:
            m = np.zeros((len(f), dims), np.int64)
            for i, v in enumerate(f["v"]):
                m[i, : len(v)] = v
            cells = np.minimum((m - low) // width, CELLS - 1).astype(np.uint8)
            yield pd.DataFrame({"vec_id": f["vec_id"], "chunk": f["chunk"], "cells": [c.tobytes() for c in cells]})

    return run


def _scan(low: np.ndarray, width: np.ndarray, k: int):
    dims = len(low)

    def run(queries: pd.DataFrame, cands: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(cands):
            cells = np.frombuffer(b"".join(cands["cells"]), np.uint8).reshape(-1, dims).astype(np.int64)
            lo = (low + cells * width).astype(float)
            hi = lo + (width - 1)
            ids = cands["vec_id"].to_numpy(np.int64)
            q = np.zeros((len(queries), dims))
            for i, v in enumerate(queries["v"]):
                q[i, : len(v)] = v
            largest, names = np.maximum(np.abs(lo), np.abs(hi)).max(0), queries["query_id"].to_numpy(np.int64)
            for at in range(0, len(q), STEP):  # a bound of both sides for some queries at a time
                part = q[at : at + STEP]
                up, down = np.maximum(part, 0), np.minimum(part, 0)
                upper, lower = up @ hi.T + down @ lo.T, up @ lo.T + down @ hi.T
                slack = 1e-12 * (np.abs(part) @ largest)
                for i, qid in enumerate(names[at : at + STEP]):
                    own = ids == qid
                    lower[i, own] = upper[i, own] = -np.inf
                    m = int((~own).sum())
                    if not m:
                        continue
                    kth = np.partition(lower[i], -k)[-k] if m > k else -np.inf
                    keep = np.flatnonzero((upper[i] + slack[i] >= kth - slack[i]) & ~own)
                    out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[keep], "low": lower[i, keep] - slack[i], "high": upper[i, keep] + slack[i]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "low": [], "high": []})

    return run


def _clipped_dot(a: list, b: list) -> int:
    """Inner product in whole numbers of any size, clipped to what a long holds."""
    return max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b))))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` greatest inner products of each query over all other rows of ``vectors``.

    ``vectors`` (vec_id, v array<long>), ``queries`` (query_id, v). Returns query_id, rank from 1,
    vec_id, score; ties go to the smaller vec_id; fewer rows where there are fewer candidates. Vectors
    of unequal length count as padded with zeros, so an empty one scores 0 with all. Rows of either table equal in id and
    vector count once; different vectors of one id are candidates of their own. Components may be so large that a
    score exceeds a long: it is worked out exactly and counts as the nearest long. No rows from empty tables.
    """
    vectors, queries = vectors.dropDuplicates(), queries.select("query_id", "v").dropDuplicates()
    spread = vectors.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.min("x").alias("a"), F.max("x").alias("b")).orderBy("d").collect()  # a row a dimension
    n, m = vectors.count(), queries.count()
    if not n or not m:
        return queries.select("query_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("score")).limit(0)
    ranges = [(min(0, r["a"]), max(0, r["b"])) for r in spread] or [(0, 0)]  # empty vectors alone: one component, 0
    fits = sum(max(-a, b) ** 2 for a, b in ranges) < 2**63  # no score can exceed a long
    low = np.array([a for a, _ in ranges], float if not fits else np.int64)
    width = np.array([max(1, -(-(b - a + 1) // CELLS)) for a, b in ranges], float if not fits else np.int64)
    chunks, blocks = -(-n // CHUNK), -(-m // BLOCK)
    placed = vectors.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).alias("chunk"))
    cells = materialize(placed.mapInPandas(_cells(low, width), "vec_id long, chunk long, cells binary"), "cells")
    asks = queries.select("query_id", "v", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"))
    left = asks.select("query_id", "v", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"))
    right = cells.select("vec_id", "cells", F.col("chunk").alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"))
    bounds = left.groupBy("chunk", "block").cogroup(right.groupBy("c", "b")).applyInPandas(_scan(low, width, k), "query_id long, vec_id long, low double, high double")
    bounds = materialize(bounds, "bounds")
    best_low = Window.partitionBy("query_id").orderBy(F.desc("low"))
    floor = bounds.withColumn("r", F.row_number().over(best_low)).filter(F.col("r") <= k).groupBy("query_id").agg(F.min("low").alias("floor"), F.count(F.lit(1)).alias("n"))
    alive = bounds.join(floor, "query_id").filter((F.col("n") < k) | (F.col("high") >= F.col("floor"))).select("query_id", "vec_id", "high")
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("high"), "vec_id")
    alive = materialize(alive.withColumn("turn", F.row_number().over(by_bound)), "alive")

    def exact(pairs: DataFrame) -> DataFrame:
        dot = F.aggregate(F.zip_with("qv", "v", lambda a, b: F.coalesce(a * b, F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)
        dot = dot if fits else F.udf(_clipped_dot, "long", useArrow=True)("qv", "v")
        return pairs.join(vectors, "vec_id").join(queries.withColumnRenamed("v", "qv"), "query_id").select("query_id", "vec_id", dot.alias("score"))

    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = materialize(exact(alive.filter(F.col("turn") <= 2 * k)), "first-read")
    sure = first.withColumn("r", F.row_number().over(ranked)).filter(F.col("r") == k).select("query_id", F.col("score").alias("kth"))
    late = alive.filter(F.col("turn") > 2 * k).join(sure, "query_id").filter(F.col("high") >= F.col("kth")).select("query_id", "vec_id")
    both = first.unionByName(exact(late))
    return both.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
