"""Interaction of document filters: what every subset and every order of them keeps and removes.

Each document fails a set of filters, its mask. Counts per part and mask are all that travels; the subset
zeta transform turns a part's 2**k mask counts into the survivors of every filter subset, and each step
of an order is the difference of two neighbouring subsets.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ("n", "good", "toxic")
SPACE = " \t\n\x0b\f\r"


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions of filters A to D over a text without nulls."""
    bare = F.btrim(text, F.lit(SPACE))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals.cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def marked(docs: DataFrame, labels: DataFrame, failures=text_failures) -> DataFrame:
    """A row for each document: part, good, toxic and mask, whose bit k says that it fails filter k.

    ``failures`` gives named conditions over the text; one more filter, the last, fails a text that a row of
    smaller doc_id has too, in any part. Texts are read once and stay where they are: a digest and the mask
    travel. The least id of each text is found with partial sums, and meets the documents by id and digest
    together, so a text with very many copies loads no task.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    conditions = failures(text)
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(conditions.values())), F.lit(0))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        mask.alias("mask"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
    )
    first = rows.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    joined = rows.join(first, ["digest", "doc_id"], "left").join(known, "doc_id", "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return joined.select(
        "part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"),
        (F.col("mask") + F.when(copy, 1 << len(conditions)).otherwise(0)).alias("mask"),
    )


def zeta(counts: Column, bits: int) -> Column:
    """Sums over all subsets: place T of the result is the sum of the places of ``counts`` that T contains."""
    return F.aggregate(
        F.array(*[F.lit(1 << k) for k in range(bits)]), counts,
        lambda held, bit: F.transform(held, lambda x, i: x + F.when(i.bitwiseAND(bit) != 0, F.get(held, i.bitwiseXOR(bit))).otherwise(0)),
    )


def subset_counts(masks: DataFrame, bits: int) -> DataFrame:
    """part and, for each of ``COUNTS``, an array whose place S holds what survives the filters in S.

    Rows of a hot part are summed before they are shuffled, so a part is at most 2**bits rows for each task.
    """
    all_bits = (1 << bits) - 1
    sums = masks.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum("good").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic")
    )
    at = lambda c, m: F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0))
    wide = sums.groupBy("part").agg(*[F.array(*[at(c, m) for m in range(all_bits + 1)]).alias(c) for c in COUNTS])
    # a document survives the filters in S where its mask is within the others
    turned = [F.reverse(zeta(F.col(c), bits)).alias(c) for c in COUNTS]
    return wide.select("part", *turned)


def audit_orders(masks: DataFrame, names: str) -> DataFrame:
    """A row for each part, order of the filters and step, zeros included.

    filter_order (letters), step (from 1), kept, removed, redundant (failing here, removed earlier),
    unique_fails (failing this filter alone), good_lost, toxic_lost, and shapley: what the step's filter
    removes, summed over all orders. Parts without documents have no rows; an empty table has none.
    """
    k = len(names)
    orders = ["".join(p) for p in permutations(names)]
    steps = []
    for order in orders:
        before = 0
        for i, name in enumerate(order):
            bit = 1 << names.index(name)
            steps.append((order, i + 1, before, bit))
            before |= bit
    plan = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(i).alias("step"), F.lit(b).alias("before"), F.lit(bit).alias("bit")) for o, i, b, bit in steps])
    everything = (1 << k) - 1
    n = lambda place: F.get("n", place)
    # what a filter removes after the set S, times the orders that put exactly S before it
    weights = {bit: F.lit(0).cast("long") for bit in (1 << j for j in range(k))}
    for bit in weights:
        for s in range(everything + 1):
            if not s & bit:
                ways = factorial(s.bit_count()) * factorial(k - 1 - s.bit_count())
                weights[bit] = weights[bit] + ways * (n(F.lit(s)) - n(F.lit(s | bit)))
    shapley = F.create_map(*[x for bit, w in weights.items() for x in (F.lit(bit), w)])
    parts = subset_counts(masks, k).withColumn("shapleys", shapley)
    s, t = F.col("s.before"), F.col("s.before") + F.col("s.bit")
    gone = n(s) - n(t)
    return parts.withColumn("s", F.explode(plan)).select(
        "part", "s.filter_order", "s.step",
        n(t).alias("kept"),
        gone.alias("removed"),
        (n(F.lit(0)) - n(F.col("s.bit")) - gone).alias("redundant"),
        (n(F.lit(everything) - F.col("s.bit")) - n(F.lit(everything))).alias("unique_fails"),
        (F.get("good", s) - F.get("good", t)).alias("good_lost"),
        (F.get("toxic", s) - F.get("toxic", t)).alias("toxic_lost"),
        F.element_at("shapleys", F.col("s.bit")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Audit of filters A to E over whole texts, by language.

    A: under 200 words; B: under half of the words distinct; C: over 3 % capitals A-Z; D: holds one of
    ``#$%&*|``; E: a row of smaller doc_id has this very text. Null and empty texts are empty: they fail A
    only (and E). Very long texts are counted whole. A null lang is the part ``''``. A row without a
    doc_id is nobody's copy, is no original and has no label; rows that repeat id and text are counted
    each and are no copies of each other; a doc_id labelled more than once has a label that any row gives.
    Other columns are ignored. No rows from no documents.
    """
    return audit_orders(marked(docs, labels), "ABCDE")
