"""Scores of readings and extractions against what is true."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossierlake.functions import text as T
from dossierlake.sources.shared import written

#: Letters with Vietnamese marks.
MARKED = "ăâđêôơưáàảãạắằẳẵặấầẩẫậéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ"
FIRST_SIGN, SIGNS = 0x3400, 0xD800 - 0x3400  # signs that stand for words while they are compared
SURE_RELATION = 0.7


def word_error_rate(truth: Column, got: Column) -> Column:
    """Words added, lost or changed over the words of the truth; an empty truth gives 0 for an empty guess, else 1.

    Each distinct word of the pair stands as one sign, so the letters' edit distance counts words. More distinct
    words than there are signs (41,984) raise an error.
    """
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    sign = lambda i: F.decode(F.unhex(F.lpad(F.hex(i + (FIRST_SIGN - 1)), 4, "0")), "UTF-16BE")
    let = lambda v, f: F.element_at(F.transform(F.array(v), lambda x: f(x)), 1)
    spelled = lambda ws, known: F.array_join(F.transform(ws, lambda w: sign(F.array_position(known, w))), "")

    def rate(pair: Column) -> Column:
        return let(F.array_union(pair["a"], pair["b"]), lambda known: F.when(
            F.size(pair["a"]) == 0, F.when(F.size(pair["b"]) == 0, 0.0).otherwise(1.0)
        ).when(F.size(known) > SIGNS, F.raise_error(F.lit("too many distinct words to compare")).cast("double")).otherwise(
            F.levenshtein(spelled(pair["a"], known), spelled(pair["b"], known)) / F.size(pair["a"])
        ))

    return let(F.struct(words(truth).alias("a"), words(got).alias("b")), rate)


def _ranges(letters: str) -> str:
    """Letters as ranges for a class of a pattern: a class of single letters asks them one after the other."""
    out: list[list[int]] = []
    for code in sorted(set(map(ord, letters))):
        if out and code == out[-1][1] + 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "".join(f"{chr(a)}-{chr(b)}" if a < b else chr(a) for a, b in out)


def marked_letters(c: Column) -> Column:
    """The letters with marks of a text, all others dropped."""
    return F.regexp_replace(F.regexp_replace(c, r"[\x00-\x7f]+", ""), f"[^{_ranges(MARKED + MARKED.upper())}]+", "")


def diacritic_accuracy(truth: Column, got: Column) -> Column:
    """One less the error rate of the marked letters alone, 0 at least."""
    pair = F.array(F.struct(marked_letters(truth).alias("truth"), marked_letters(got).alias("got")))
    return F.element_at(F.transform(pair, lambda p: F.greatest(F.lit(0.0), 1 - T.error_rate(p["truth"], p["got"]))), 1)


def reading_scores(readings: DataFrame) -> DataFrame:
    """(engine, samples, cer, wer, diacritic_accuracy, seconds) means of readings (engine, truth, text, seconds); null truths do not count."""
    t, g = F.col("truth"), F.coalesce("text", F.lit(""))
    scored = readings.filter("truth is not null").select("engine", "seconds", T.error_rate(t, g).alias("cer"), word_error_rate(t, g).alias("wer"), diacritic_accuracy(t, g).alias("dia"))
    return scored.groupBy("engine").agg(F.count(F.lit(1)).alias("samples"), F.avg("cer").alias("cer"), F.avg("wer").alias("wer"), F.avg("dia").alias("diacritic_accuracy"), F.avg("seconds").alias("seconds"))


def micro_f1(rows: DataFrame) -> DataFrame:
    """(entity_f1, relation_f1) of rows (field, predicted, gold, confidence): fields without a gold value do not count.

    A wrong value is missed, and false too unless it is empty. A unit's relation is right if the unit is and it is sure.
    """
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    key = lambda c: T.normalize_text(F.coalesce(c, F.lit("")))
    judged = rows.filter(~empty(F.col("gold"))).withColumn("right", key(F.col("predicted")) == key(F.col("gold"))).withColumn("given", ~empty(F.col("predicted")))
    related = (F.col("field") == "UNIT") & F.col("right") & (F.coalesce("confidence", F.lit(0.0)) >= SURE_RELATION)
    n = lambda c: F.count_if(c).cast("double")
    unit = F.col("field") == "UNIT"

    def f1(tp: Column, fp: Column, fn: Column) -> Column:
        p, r = tp / F.greatest(F.lit(1.0), tp + fp), tp / F.greatest(F.lit(1.0), tp + fn)
        return 2 * p * r / F.greatest(F.lit(1e-12), p + r)

    return judged.agg(
        f1(n(F.col("right")), n(~F.col("right") & F.col("given")), n(~F.col("right"))).alias("entity_f1"),
        f1(n(related), n(unit & ~related & F.col("given")), n(unit & ~related)).alias("relation_f1"),
    )


def auc(rows: DataFrame) -> DataFrame:
    """(auc) of rows (score, label 0 or 1): the chance that a row of label 1 scores above one of label 0, ties half; null without both labels.

    Rows are counted by score. Scores are dealt in ranges; ranks are running sums within a range on top of the sums of the
    ranges before it, so no task sees all scores. Null scores or labels do not count.
    """
    known = rows.filter("score is not null and label in (0, 1)")
    counts = known.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"))
    dealt = written(counts.repartitionByRange("score").withColumn("part", F.spark_partition_id()), "scores")
    parts = dealt.groupBy("part").agg(F.sum("n").alias("all"))
    before = F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, 0))
    ranked = dealt.withColumn("upto", upto).join(F.broadcast(parts.select("part", before.alias("before"))), "part")
    rank = F.col("before") + F.col("upto") - F.col("n") + (F.col("n") + 1) / 2
    pos, n = F.sum("pos"), F.sum("n")
    return ranked.agg(F.try_divide(F.sum(rank * F.col("pos")) - pos * (pos + 1) / 2, pos * (n - pos)).alias("auc"))
