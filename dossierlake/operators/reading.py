"""How well a text was read: metrics, the gate over them, and the choice between two readings of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake.functions import text as T
from dossierlake.functions.letters import char_stats
from dossierlake.operators import metrics
from dossierlake.operators.documents import nearest_rank

# fixed values: thresholds of the metrics
CONF_P10, CONF_MIN, LOW_LINE, LOW_RATIO = 0.70, 0.30, 0.70, 0.20
CHARSET, ALPHA_CHARS, TOKENS, TOKEN_RATIO = 0.02, 200, 30, 0.60
DIACRITICS, LEXICON_HITS, COINCIDENCE, ENTROPY = 0.08, 0.35, 1.10, 3.50
BLUR, CONTRAST, UNSURE = 50.0, 12.0, 0.70
CRITICAL = ("cccd", "cmnd", "ho ten", "ho va ten", "don vi", "co quan")
WORD, ALLOWED = "[a-zA-ZÀ-ỹ]+", r"(?U)[a-zA-ZÀ-ỹ0-9\s.,/:\\\-()]+"


def with_metrics(rows: DataFrame, text: str, scores: str, ocr: Column, out: str, known: str | None = None) -> DataFrame:
    """``rows`` with ``out``: (value, passed) by the name of a metric; see ``with_gate``.

    Each count of a text is a column of its own, made once, and only where a metric applies; metrics that nobody reads cost nothing.
    """
    own = T.free_names(rows)
    t, s = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(scores), F.array().cast("array<double>"))
    rows = rows.withColumn(own("alpha"), F.when(F.length(t) >= ALPHA_CHARS, F.length(F.regexp_replace(t, r"[^\p{L}]+", ""))))
    rows = rows.withColumn(own("words"), F.when(F.col(own("alpha")) >= ALPHA_CHARS, F.regexp_count(t, F.lit(WORD))))
    alpha, words = F.col(own("alpha")), F.col(own("words"))
    prose = F.coalesce((words >= TOKENS) & (words / F.greatest(F.lit(1), F.regexp_count(t, F.lit(r"(?U)\S+"))) >= TOKEN_RATIO), F.lit(False))
    rows = rows.withColumn(own("prose"), prose)
    prose = F.col(own("prose"))
    rows = rows.withColumn(own("stats"), char_stats(F.when(prose, t)))
    scored, read, stats = F.size(s) > 0, prose & F.coalesce(ocr, F.lit(False)), F.col(own("stats"))
    low = F.size(F.filter(s, lambda x: x < LOW_LINE)) / F.size(s)
    strange = F.length(F.regexp_replace(t, ALLOWED, "")) / F.length(t)
    share = F.col(known) / words if known else F.lit(None).cast("double")
    at_least = lambda least: lambda v: v >= least
    rules = {
        "conf_p10": (scored, nearest_rank(s, 0.10), at_least(CONF_P10)),
        "conf_min": (scored, F.array_min(s), at_least(CONF_MIN)),
        "low_conf_ratio": (scored, low, lambda v: v <= LOW_RATIO),
        "charset_violation_ratio": (t != "", strange, lambda v: F.coalesce(v <= CHARSET, F.lit(False))),
        "diacritic_ratio": (read, F.length(metrics.marked_letters(t)) / alpha, at_least(DIACRITICS)),
        "dict_hit_ratio": (prose & F.lit(known is not None), share, at_least(LEXICON_HITS)),
        "index_of_coincidence": (prose, stats["coincidence"], at_least(COINCIDENCE)),
        "char_entropy": (prose, stats["dense_entropy"], at_least(ENTROPY)),
    }
    rows = rows.withColumns({own(n): F.when(applies, value).cast("double") for n, (applies, value, _) in rules.items()})
    by = F.struct(*[F.struct(F.col(own(n)).alias("value"), passes(F.col(own(n))).alias("passed")).alias(n) for n, (_, _, passes) in rules.items()])
    return rows.withColumn(out, by).drop(*map(own, ("alpha", "words", "prose", "stats", *rules)))


def with_gate(rows: DataFrame, text: str, scores: str, ocr: Column, out: str, known: str | None = None) -> DataFrame:
    """``rows`` with ``out``: (gate, failed, confidence, metrics) of the columns ``text`` and ``scores`` (an array).

    A metric's ``passed`` is null where it does not apply: confidences without scores, letter statistics of texts that
    are no long prose, diacritics of texts that are not from OCR, words without a lexicon: ``known`` names the column that
    counts those of ``words_of`` that one has (see ``lexicon``). A null or empty text fails.
    """
    own = T.free_names(rows)
    rows = with_metrics(rows, text, scores, ocr, own("by"), known)
    by, names = F.col(own("by")), rows.schema[own("by")].dataType.names
    listed = F.array(*[F.struct(F.lit(n).alias("name"), by[n]["value"].alias("value"), by[n]["passed"].alias("passed")) for n in names])
    rows = rows.withColumn(own("metrics"), listed).drop(own("by"))
    failed = F.transform(F.filter(own("metrics"), lambda m: ~m["passed"]), lambda m: m["name"])
    rows = rows.withColumn(own("failed"), failed)
    up, down = ["conf_p10", "conf_min", "dict_hit_ratio", "diacritic_ratio"], ["low_conf_ratio", "charset_violation_ratio"]
    bounded = F.filter(own("metrics"), lambda m: m["value"].isNotNull() & m["name"].isin(*up, *down))
    parts = F.transform(bounded, lambda m: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(m["name"].isin(*down), 1 - m["value"]).otherwise(m["value"]))))
    rows = rows.withColumn(own("parts"), parts)
    fails = F.size(own("failed")) > 0
    mean = F.aggregate(own("parts"), F.lit(0.0), lambda a, x: a + x) / F.size(own("parts"))
    sure = F.when(F.size(own("parts")) == 0, F.when(fails, 0.0).otherwise(0.75)).when(fails, F.least(mean, F.lit(0.5))).otherwise(mean)
    gate = F.struct(F.when(fails, "FAIL").otherwise("PASS").alias("gate"), F.col(own("failed")).alias("failed"), sure.alias("confidence"), F.col(own("metrics")).alias("metrics"))
    return rows.withColumn(out, gate).drop(own("metrics"), own("failed"), own("parts"))


def words_of(text: Column) -> Column:
    """Words of a text as the gate counts them, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def critical_fields(lines: Column) -> Column:
    """Identity numbers and labelled lines among the texts, sorted: what two readings must agree on."""
    ids = F.transform(F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(r"(?<!\d)(?:\d{9}|\d{12})(?!\d)"), F.lit(0)))), lambda x: F.concat(F.lit("id:"), x))
    keys = F.filter(F.transform(lines, T.ascii_key), lambda k: F.rlike(k, F.lit("|".join(CRITICAL))))
    return F.array_sort(F.array_distinct(F.concat(ids, F.transform(keys, lambda k: F.concat(F.lit("label:"), k)))))


def _judged(read: DataFrame, e: str) -> DataFrame:
    """``read`` with the texts of the lines in column ``e``, the gate over them and their mean confidence (0 without any)."""
    lines = F.coalesce(F.col(f"{e}.text"), F.array().cast("array<string>"))
    read = read.withColumn(f"{e}_lines", lines).withColumn(f"{e}_conf", F.filter(F.col(f"{e}.conf"), lambda x: x.isNotNull()))
    read = with_gate(read.withColumn(f"{e}_text", F.array_join(f"{e}_lines", "\n")), f"{e}_text", f"{e}_conf", F.lit(True), f"{e}_gate")
    mean = F.aggregate(f"{e}_conf", F.lit(0.0), lambda a, x: a + x) / F.size(f"{e}_conf")
    return read.withColumn(f"{e}_mean", F.when(F.size(f"{e}_conf") > 0, mean).otherwise(0.0))


def select_reading(lines: DataFrame, images: DataFrame) -> DataFrame:
    """Per page of images (page_id, blur, contrast): which whole reading of lines (page_id, engine, line, text, conf) holds.

    ``engine`` is 'primary' or 'fallback'. The fallback counts if the primary fails the gate, is unsure or the image is
    poor; it wins if it passes and the primary fails or is less sure. If both count and differ in critical fields the
    page fails with confidence 0. Null texts read as empty; a page without lines was read as nothing.
    """
    per = {}
    for e in ("primary", "fallback"):
        mine = F.when(F.col("engine") == e, F.struct("line", F.coalesce("text", F.lit("")).alias("text"), "conf"))
        per[e] = F.sort_array(F.collect_list(mine)).alias(e)
    read = images.select("page_id", "blur", "contrast").join(lines.groupBy("page_id").agg(*per.values()), "page_id", "left")
    read = _judged(read, "primary")
    poor = ~F.coalesce((F.col("blur") >= BLUR) & (F.col("contrast") >= CONTRAST), F.lit(False))
    fails = F.col("primary_gate.gate") == "FAIL"
    reason = F.when(fails, "PRIMARY_GATE_FAILED").when(poor, "INPUT_IMAGE_QUALITY_LOW").when(F.col("primary_mean") < UNSURE, "PRIMARY_CONFIDENCE_BELOW_THRESHOLD")
    read = read.withColumn("poor", poor).withColumn("reason", reason)
    ran = F.col("reason").isNotNull()
    # where the primary holds the fallback is never asked, and no fields are compared
    read = _judged(read.withColumn("fallback", F.when(ran, F.col("fallback"))), "fallback")
    read = read.withColumns({f"{e}_fields": F.when(ran, critical_fields(F.col(f"{e}_lines"))) for e in per})
    better = ran & (F.col("fallback_gate.gate") == "PASS") & (fails | (F.col("fallback_mean") > F.col("primary_mean")))
    differ = ran & (F.col("primary_fields") != F.col("fallback_fields"))
    read = read.withColumn("better", better).withColumn("disagreement", differ)
    own = lambda f: F.when(F.col("better"), F.col(f"fallback_gate.{f}")).otherwise(F.col(f"primary_gate.{f}"))
    gate = F.when(F.col("poor") | F.col("disagreement"), "FAIL").otherwise(own("gate"))
    sure = F.when(F.col("disagreement"), 0.0).when(F.col("poor"), F.least(own("confidence"), F.lit(0.5))).otherwise(own("confidence"))
    return read.select("page_id", F.when(F.col("better"), "fallback").otherwise("primary").alias("engine"), "reason", "disagreement", gate.alias("gate"), sure.alias("confidence"))
