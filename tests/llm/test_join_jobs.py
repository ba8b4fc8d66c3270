"""The similarity join's jobs, its components and the counts taken while rows are written."""

import random

from pyspark.sql import functions as F

from dossierlake.llm import common


def brute_kept(texts, width, num, den):
    sets = [{tuple(w[i : i + width]) for i in range(len(w) - width + 1)} for w in map(str.split, texts)]
    label = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if den * len(a & b) >= num * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    return set(label)


def test_near_duplicates_take_few_jobs(spark):
    """Each job costs the driver megabytes of heap, whatever the table: what its stages need is broadcast in buffers of fixed size."""
    import corpus_pipeline as pipe

    rng = random.Random(5)
    base = [rng.choices([f"w{i}" for i in range(60)], k=30) for _ in range(12)]
    texts = [" ".join([*w[: 30 - j % 3], "end"]) for w in base for j in range(4)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    spark.sparkContext.setJobGroup("near duplicates", "")
    try:
        kept = {r["doc_id"] for r in pipe.one_of_each_group(spark, frame, "").collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("near duplicates"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert kept == brute_kept(texts, 5, 8, 10)
    assert jobs <= 85, jobs


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 120)] + [(200, 200)]
    found = {r["node"]: r["label"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 120)} | {200: 200}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_counts_are_taken_as_rows_are_written(spark):
    rows, total = common.measured(spark.range(10).filter("id > 3"), "rows", F.sum("id"))
    assert (rows.count(), total) == (6, 39)
    assert common.measured(spark.range(10).filter("false"), "rows", F.count(F.lit(1)))[1] == 0
