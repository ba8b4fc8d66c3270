"""Resolution of unit and person mentions in bulk: exact tiers, hybrid ranking, gates that rather abstain.

Every mention of a batch is resolved in one plan. Exact tiers are one equi-join on a table of surface
forms; only spellings that no tier settles meet the ranking (``ranking``), each once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossierlake.functions import text as T
from dossierlake.operators import ranking

# Thresholds, weights and tier scores of the resolver.
FUZZY, MARGIN, TOP_K, ACCEPT = 91.0, 6.0, 10, 0.90
STRONG_FUZZY, STRONG_MARGIN = 97.0, 10.0
WEIGHTS = (0.65, 0.20, 0.15)
K1, B = ranking.K1, ranking.B
TIER_SCORES = (100.0, 99.0, 97.0, 96.0)
DECISIVE_FUZZY, DECISIVE_GAP = FUZZY + 3, MARGIN + 4  # from there on no semantic score is asked for
TIER_METHODS = ("CANONICAL_EXACT", "APPROVED_ALIAS", "ASCII_FOLDED", "ASCII_FOLDED_ALIAS")


def surface_forms(units: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(key, tier, unit_id) of trusted units (unit_id, name) and their aliases (unit_id, name).

    Tiers: 1 the name's key, 2 an alias's, 3 and 4 the same without marks; folded keys are never empty.
    """
    out = [units.select(T.normalize_text(F.col("name")).alias("key"), F.lit(1).alias("tier"), "unit_id"), units.select(T.ascii_key(F.col("name")).alias("key"), F.lit(3).alias("tier"), "unit_id").filter("key <> ''")]
    if aliases is not None:
        out += [aliases.select(T.normalize_text(F.col("name")).alias("key"), F.lit(2).alias("tier"), "unit_id"), aliases.select(T.ascii_key(F.col("name")).alias("key"), F.lit(4).alias("tier"), "unit_id").filter("key <> ''")]
    all_forms = out[0]
    for o in out[1:]:
        all_forms = all_forms.unionByName(o)
    return all_forms.distinct()


def exact_tiers(mentions: DataFrame, forms: DataFrame) -> DataFrame:
    """First tier that any unit answers, per mention (mention_id, name): tier, n_units, unit_id if there is one.

    Names resolve once each, however many mentions share them.
    """
    names = mentions.select("name").distinct()
    keyed = names.select("name", T.normalize_text(F.col("name")).alias("k1"), T.ascii_key(F.col("name")).alias("k3"))
    asked = keyed.select("name", F.explode(F.array(F.struct(F.col("k1").alias("key"), F.lit(False).alias("folded")), F.struct(F.col("k3").alias("key"), F.lit(True).alias("folded")))).alias("q"))
    asked = asked.select("name", F.col("q.key").alias("key"), F.col("q.folded").alias("folded"))
    hits = asked.join(forms, "key").filter(F.col("folded") == F.col("tier").isin(3, 4))
    per_tier = hits.groupBy("name", "tier").agg(F.count_distinct("unit_id").alias("n_units"), F.min("unit_id").alias("unit_id"))
    best = per_tier.groupBy("name").agg(F.min(F.struct("tier", "n_units", "unit_id")).alias("b")).select("name", "b.*")
    return mentions.join(best, "name", "left").withColumn("unit_id", F.when(F.col("n_units") == 1, F.col("unit_id")))


def _merged_spans(codes: DataFrame) -> DataFrame:
    """(k, u, valid_from, valid_to) of units under codes with the spans of a unit that meet made one, so that a day is in one at most."""
    sound = codes.filter("valid_from is null or valid_to is null or valid_from <= valid_to").distinct()
    earlier = Window.partitionBy("k", "u").orderBy(F.asc_nulls_first("valid_from"), F.asc_nulls_last("valid_to")).rowsBetween(Window.unboundedPreceding, -1)
    apart = ~F.coalesce(F.bool_or(F.col("valid_to").isNull()).over(earlier), F.lit(False)) & F.coalesce(F.col("valid_from") > F.max("valid_to").over(earlier), F.lit(False))
    numbered = sound.withColumn("apart", apart.cast("int"))
    numbered = numbered.withColumn("nth", F.coalesce(F.sum("apart").over(earlier), F.lit(0)) + F.col("apart"))
    open_or = lambda c, best: F.when(~F.bool_or(F.col(c).isNull()), best(c)).alias(c)
    return numbered.groupBy("k", "u", "nth").agg(open_or("valid_from", F.min), open_or("valid_to", F.max)).drop("nth")


def by_code(mentions: DataFrame, codes: DataFrame) -> DataFrame:
    """(mention_id, code_unit): least unit whose code equals the mention's, case and outer blanks aside; both valid on the day.

    Units of a code are counted by span of validity, and a code and day are asked once, so that no row is made for a mention and a unit.
    """
    m = mentions.filter("code is not null").select("mention_id", "as_of", F.lower(F.trim("code")).alias("k")).distinct()
    c = codes.select(F.lower(F.trim("code")).alias("k"), F.col("unit_id").alias("u"), "valid_from", "valid_to")
    valid = T.active_on(F.col("as_of"), F.col("valid_from"), F.col("valid_to"))
    m = m.withColumn("asks", F.count(F.lit(1)).over(Window.partitionBy("mention_id")))
    spans = _merged_spans(c).groupBy("k", "valid_from", "valid_to").agg(F.min("u").alias("u"), F.count("u").alias("n"))
    asked = m.filter("asks = 1").select("k", "as_of").distinct()
    found = asked.join(spans, "k").filter(valid).groupBy("k", F.col("as_of").alias("day")).agg(F.min("u").alias("code_unit"), F.sum("n").alias("n_code_units"))
    once = m.filter("asks = 1").join(found.withColumnRenamed("k", "code"), (F.col("k") == F.col("code")) & F.col("as_of").eqNullSafe(F.col("day"))).select("mention_id", "code_unit", "n_code_units")
    # a mention of several codes or days may meet a unit by each of them
    again = m.filter("asks > 1").join(c, "k").filter(valid).groupBy("mention_id").agg(F.min("u").alias("code_unit"), F.count_distinct("u").alias("n_code_units"))
    return once.unionByName(again)


def bm25(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(q_id, d_id, bm25) of queries (q_id, name) over docs (d_id, name); repeated query terms count repeatedly.

    Only pairs that share a term have a row; scores are relative to each query's best.
    """
    d = docs.select("d_id", T.tokens(F.col("name")).alias("ts"))
    stats = d.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("ts")).alias("avg_len"))
    tf = d.select("d_id", F.size("ts").alias("len"), F.explode("ts").alias("t")).groupBy("d_id", "t", "len").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    q = queries.select("q_id", F.explode(T.tokens(F.col("name"))).alias("t")).groupBy("q_id", "t").agg(F.count(F.lit(1)).alias("qn"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("qn") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = q.join(tf, "t").join(df, "t").join(F.broadcast(stats)).groupBy("q_id", "d_id").agg(F.sum(part).alias("raw"))  # stats is one row
    best = scored.groupBy("q_id").agg(F.max("raw").alias("best"))
    return scored.join(best, "q_id").select("q_id", "d_id", F.when(F.col("best") > 0, F.col("raw") / F.col("best")).otherwise(0.0).alias("bm25"))


def nearest_names(queries: DataFrame, docs: DataFrame, k: int = TOP_K) -> DataFrame:
    """(q_id, d_id, fuzzy): the ``k`` rows of ``docs`` with the nearest names, and some others; see ``ranking``."""
    return ranking.nearest_names(queries, docs, k)


def nearest_vectors(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(q_id, d_id, cosine, rank): the ``k`` other rows of docs (d_id, v) with the highest cosine, clipped to 0..1 and to six places, of
    queries (q_id, v) of vectors of length one; ties to the least d_id. Blocks of both meet; each keeps its best."""

    def best(qs: pd.DataFrame, ds: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(qs) and len(ds):
            ids = ds["d_id"].to_numpy()
            scores = np.round(np.clip(np.array(qs["v"].tolist(), float) @ np.array(ds["v"].tolist(), float).T, 0.0, 1.0), 6)
            for q, row in zip(qs["q_id"], scores):
                order = [j for j in np.lexsort((ids, -row))[: k + 1].tolist() if ids[j] != q][:k]
                out += [(q, ids[j], row[j]) for j in order]
        return pd.DataFrame(out, columns=["q_id", "d_id", "cosine"])

    shares, blocks = (max(1, -(-df.count() // size)) for df, size in ((queries, 256), (docs, 8192)))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = queries.select("q_id", "v", F.pmod(F.xxhash64("q_id"), F.lit(shares)).alias("share"), upto(blocks).alias("block"))
    held = docs.select("d_id", "v", F.pmod(F.xxhash64("d_id"), F.lit(blocks)).alias("b"), upto(shares).alias("s"))
    found = asked.groupBy("share", "block").cogroup(held.groupBy("s", "b")).applyInPandas(best, "q_id long, d_id long, cosine double")
    order = Window.partitionBy("q_id").orderBy(F.desc("cosine"), "d_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hybrid_rank(queries: DataFrame, docs: DataFrame, semantic: DataFrame | None = None, k: int = TOP_K) -> DataFrame:
    """Top ``k`` candidates per query by the weighted sum of fuzzy, BM25 and, if given, semantic scores (q_id, d_id, semantic).

    A query whose best name is close and far ahead of the next takes no semantic score. The ranking is that
    of all pairs, though only those are weighed that can be among the best ``k``.
    """
    rows = ranking.hybrid_candidates(queries, docs, semantic, max(k, 2), WEIGHTS, (DECISIVE_FUZZY, DECISIVE_GAP))
    order = Window.partitionBy("q_id").orderBy(F.desc("combined"), F.desc("fuzzy"), "d_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_and_margin(ranked: DataFrame) -> DataFrame:
    """Best candidate of each query, with the gap of its combined score to the runner-up's (to 0 if alone), in hundredths."""
    order = Window.partitionBy("q_id").orderBy("rank")
    second = F.coalesce(F.lead("combined").over(order), F.lit(0.0))
    return ranked.select("*", ((F.col("combined") - second) * 100).alias("margin")).filter("rank = 1")


def display_probability(fuzzy: Column, margin: Column) -> Column:
    """Heuristic probability from the top score and its margin."""
    p = fuzzy / 100 * (0.75 + F.least(F.greatest(margin, F.lit(0.0)), F.lit(30.0)) / 120)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))


def accept(fuzzy: Column, margin: Column, probability: Column, combined: Column, need_probability: bool = True) -> Column:
    """MATCHED, AMBIGUOUS or NOT_FOUND for the best candidate of a name that no tier settled."""
    sure = (fuzzy >= FUZZY) & (margin >= MARGIN)
    if need_probability:
        sure = sure & (probability >= ACCEPT)
    return F.when(sure, "MATCHED").when(combined * 100 >= max(50.0, FUZZY - 15), "AMBIGUOUS").otherwise("NOT_FOUND")


_CANDIDATE = "array<struct<unit_id:{0},score:double,fuzzy:double,bm25:double,semantic:double>>"


def resolve_units(mentions: DataFrame, units: DataFrame, aliases: DataFrame, codes: DataFrame, semantic: DataFrame | None = None, probability=None) -> DataFrame:
    """Resolve mentions (mention_id, name, code, as_of) against units (unit_id, name), aliases (unit_id, name) and codes
    (code, unit_id, valid_from, valid_to), all trusted and, but for codes, valid on the day of the batch.

    A row per mention: mention_id, status, method, unit_id, score, margin, confidence, candidates. The order of
    decision: a name of several units without a code abstains; a code and an exact name of another unit are
    a conflict, so are a code and a name that strongly suggests another; a code decides; an exact name
    decides; an empty name is not found; the ranking decides, or abstains. ``semantic`` has (name, unit_id, semantic)
    for spellings, ``probability`` is a function of fuzzy, margin, bm25 and semantic.
    Mentions that share a name and lack an exact match are ranked once. Null names and codes count as absent.
    """
    probability = probability or (lambda fuzzy, margin, bm25, semantic: display_probability(fuzzy, margin))
    kind = units.schema["unit_id"].dataType.simpleString()
    forms = surface_forms(units, aliases)
    rows = exact_tiers(mentions, forms).join(by_code(mentions, codes).select("mention_id", "code_unit"), "mention_id", "left")
    blank = F.coalesce(F.trim("name"), F.lit("")) == ""
    spellings = rows.filter(F.col("n_units").isNull() & ~blank).select(F.col("name").alias("q_id"), "name").distinct()
    names = units.select(F.col("unit_id").alias("d_id"), "name").unionByName(aliases.select(F.col("unit_id").alias("d_id"), "name"))
    ranked = hybrid_rank(spellings, names, None if semantic is None else semantic.select(F.col("name").alias("q_id"), F.col("unit_id").alias("d_id"), "semantic"))
    shown = F.struct("rank", F.struct(F.col("d_id").alias("unit_id"), F.bround(F.col("combined") * 100, 2).alias("score"), F.bround("fuzzy", 2).alias("fuzzy"), F.bround("bm25", 4).alias("bm25"), F.bround("semantic", 4).alias("semantic")).alias("c"))
    listed = ranked.groupBy("q_id").agg(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["c"]).alias("ranked"))
    top = top_and_margin(ranked).select("q_id", F.col("d_id").alias("top_unit"), "fuzzy", "bm25", "semantic", "combined", "margin").join(listed, "q_id")
    rows = rows.join(top.withColumnRenamed("q_id", "name"), "name", "left")
    chance = probability(F.col("fuzzy"), F.col("margin"), F.col("bm25"), F.col("semantic"))
    rows = rows.withColumn("chance", chance).withColumn("ranked_status", accept(F.col("fuzzy"), F.col("margin"), F.col("chance"), F.col("combined")))
    decided = decide_unit(rows)
    # a tie lists the units of all tiers that the name answers to
    keys = decided.filter("status = 'AMBIGUOUS' and n_units > 1").select("mention_id", F.explode(F.array(T.normalize_text(F.col("name")), T.ascii_key(F.col("name")))).alias("key"))
    tied = keys.join(forms, "key").groupBy("mention_id").agg(F.array_sort(F.collect_set("unit_id")).alias("tied"))
    plain = lambda u: F.struct(u.alias("unit_id"), F.lit(100.0).alias("score"), *[F.lit(None).cast("double").alias(c) for c in ("fuzzy", "bm25", "semantic")])
    exact = F.col("status").isin("AMBIGUOUS", "CONFLICT") & F.col("n_units").isNotNull()
    candidates = (
        F.when(F.col("tied").isNotNull(), F.transform("tied", plain))
        .when(exact, F.array(plain(F.col("code_unit")), plain(F.col("unit_id"))))
        .when(F.col("method").isin("HYBRID_FUZZY_BM25_SEMANTIC", "HYBRID_RANKING", "CODE_STRONG_NAME_CONFLICT"), F.col("ranked"))
    )
    by_tier = F.element_at(F.array(*map(F.lit, TIER_SCORES)), F.col("tier"))
    code, ranking = F.col("method") == "TRUSTED_CODE", F.col("method").isin("HYBRID_FUZZY_BM25_SEMANTIC", "HYBRID_RANKING", "CODE_STRONG_NAME_CONFLICT")
    score = F.when(code | exact, 100.0).when(ranking, F.col("combined") * 100).when(F.col("n_units") == 1, by_tier)
    margin = F.when(code, 100.0).when(exact, 0.0).when(ranking, F.col("margin")).when(F.col("n_units") == 1, by_tier)
    sure = F.when(F.col("method").isin("HYBRID_FUZZY_BM25_SEMANTIC", "HYBRID_RANKING"), F.col("chance")).when(F.col("status") == "MATCHED", 1.0).otherwise(0.0)
    return decided.join(tied, "mention_id", "left").select(
        "mention_id", "status", "method", F.col("resolved_unit").alias("unit_id"), score.alias("score"), margin.alias("margin"), sure.alias("confidence"), F.coalesce(candidates.cast(_CANDIDATE.format(kind)), F.array().cast(_CANDIDATE.format(kind))).alias("candidates")
    )


def decide_unit(resolved: DataFrame) -> DataFrame:
    """Status, method and resolved_unit of rows (name, code_unit, n_units, tier, unit_id, top_unit, fuzzy, margin, ranked_status)."""
    named = F.col("n_units").isNotNull()
    many = F.col("n_units") > 1
    code = F.col("code_unit").isNotNull()
    blank = F.coalesce(F.trim("name"), F.lit("")) == ""
    against = ~named & (F.col("top_unit") != F.col("code_unit")) & (F.col("fuzzy") >= STRONG_FUZZY) & (F.col("margin") >= STRONG_MARGIN)
    other = code & (F.col("n_units") == 1) & (F.col("unit_id") != F.col("code_unit"))
    tier = F.element_at(F.array(*map(F.lit, TIER_METHODS)), F.col("tier"))
    ranked = F.coalesce("ranked_status", F.lit("NOT_FOUND"))
    verdict = lambda status, method: F.struct(F.lit(status).alias("status") if isinstance(status, str) else status.alias("status"), method.alias("method"))
    decision = (
        F.when(many & ~code, verdict("AMBIGUOUS", F.lit("EXACT_NAME_AMBIGUOUS")))
        .when(F.coalesce(other, F.lit(False)), verdict("CONFLICT", F.lit("CODE_NAME_CONFLICT")))
        .when(code & F.coalesce(against, F.lit(False)), verdict("CONFLICT", F.lit("CODE_STRONG_NAME_CONFLICT")))
        .when(code, verdict("MATCHED", F.lit("TRUSTED_CODE")))
        .when(F.col("n_units") == 1, verdict("MATCHED", tier))
        .when(blank | F.col("top_unit").isNull(), verdict("NOT_FOUND", F.lit(None).cast("string")))
        .otherwise(verdict(ranked, F.when(ranked == "MATCHED", "HYBRID_FUZZY_BM25_SEMANTIC").otherwise("HYBRID_RANKING")))
    )
    rows = resolved.withColumn("decision", decision)
    unit = F.when(F.col("decision.status") == "MATCHED", F.coalesce("code_unit", "unit_id", "top_unit"))
    return rows.select("*", F.col("decision.status").alias("status"), F.col("decision.method").alias("method"), unit.alias("resolved_unit")).drop("decision")
