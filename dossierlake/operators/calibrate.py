"""Fitting the logistic calibration of name matches."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossierlake.operators import ranking, resolve

FEATURES = ("fuzzy", "margin", "bm25", "semantic")
TRAIN_PERCENT, FUZZY_WEIGHT, BM25_WEIGHT, ACCEPT = 70, 0.8, 0.2, 0.90  # fixed values: split, ranking weights, threshold


def match_features(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Best candidate of each query (q_id, name) among docs (d_id, name): q_id, d_id and the features, 0 to 1."""
    rows = ranking.hybrid_candidates(queries, docs, None, 2, (FUZZY_WEIGHT, BM25_WEIGHT, 0.0), (resolve.DECISIVE_FUZZY, resolve.DECISIVE_GAP)).withColumn("fuzzy", F.col("fuzzy") / 100)
    order = Window.partitionBy("q_id").orderBy(F.desc("combined"), "d_id")
    best = rows.withColumn("next", F.lead("combined").over(order)).withColumn("rank", F.row_number().over(order)).filter("rank = 1")
    gap = F.greatest(F.lit(0.0), F.col("combined") - F.coalesce("next", F.col("combined")))
    return best.select("q_id", "d_id", "fuzzy", gap.alias("margin"), "bm25", F.lit(0.0).alias("semantic"))


def fit(rows: DataFrame, key: str) -> DataFrame:
    """One row: coefficients of a balanced logistic regression of ``label`` (0, 1) on the features, and its validation.

    Of either label, the 70 of 100 rows with the least hashes of ``key`` are training. Both labels must occur there; else the error says so.
    """
    parts = rows.select(*FEATURES, F.col("label").cast("double").alias("label"), F.xxhash64(key).alias("hash")).dropna()
    cuts = parts.groupBy("label").agg(F.percentile_approx("hash", TRAIN_PERCENT / 100, 10_000).alias("cut"))
    parts = parts.join(F.broadcast(cuts), "label").select(*FEATURES, "label", (F.col("hash") <= F.col("cut")).alias("train"))  # a row a label
    parts = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(parts).persist()  # read by every pass below; lost blocks are worked out anew
    try:
        return _fit(parts)
    finally:
        parts.unpersist()


def _fit(parts: DataFrame) -> DataFrame:
    counts = {r["label"]: r["count"] for r in parts.filter("train").groupBy("label").count().collect()}  # two rows
    if set(counts) != {0.0, 1.0}:
        raise ValueError(f"training needs both labels, has {sorted(counts)}")
    total = sum(counts.values())
    weight = F.when(F.col("label") == 1, total / (2.0 * counts[1.0])).otherwise(total / (2.0 * counts[0.0]))
    model = LogisticRegression(maxIter=2000, regParam=1.0 / total, standardization=False, weightCol="weight").fit(parts.filter("train").withColumn("weight", weight))
    held = model.transform(parts.filter("not train")).withColumn("p", vector_to_array("probability")[1])
    accepted, right = F.col("p") >= ACCEPT, F.col("label") == 1
    auc = BinaryClassificationEvaluator(rawPredictionCol="probability").evaluate(held)
    scores = held.agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg((F.col("p") - F.col("label")) ** 2).alias("brier"),
        F.coalesce(F.try_divide(F.count_if(accepted & right), F.count_if(accepted)), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(F.count_if(accepted & right), F.count_if(right)), F.lit(0.0)).alias("recall"),
    )
    row = {"intercept": float(model.intercept)} | {f"w_{f}": float(c) for f, c in zip(FEATURES, model.coefficients)} | scores.first().asDict() | {"roc_auc": float(auc)}
    return parts.sparkSession.createDataFrame([tuple(row.values())], ", ".join(f"{c} {'long' if c == 'samples' else 'double'}" for c in row))
