"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.llm import audit, bpe, decontaminate, jaccard, langid, licenses, media, middle, packing, quality, secrets, topk, toxicity
from dossierlake.llm.common import labelled_sample, table


def vocabulary() -> str:
    """Path of the word vocabulary on this machine; the same path holds on every executor."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def remainder(modulus: int):
    """crc32 of the doc_id as text, modulo ``modulus``; it decides which rows are held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def held_out(modulus: int, rest: int):
    """Whether a row is held out; a row without a doc_id is, as nothing is learnt from it."""
    return F.coalesce(remainder(modulus) == rest, F.lit(True)).alias("held_out")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = {r.kind for r in secrets.RULES if r.base}
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    own = F.filter("spans", lambda s: s["kind"].isin(*sorted(base)))
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(F.array_join(F.transform(own, text), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", text), ",").alias("spans"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), 10)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op5_media_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.encode_texts(table(spark, sf_dir, "documents")))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model:
    labels = table(spark, sf_dir, "labels").filter(remainder(5) != 0)
    share = labels.filter(F.col("quality").isin(0, 1)).select("doc_id", "quality").distinct().agg(F.avg("quality")).first()[0]
    return quality.learn(labelled_sample(table(spark, sf_dir, "documents"), labels, "quality", quality.SAMPLE), share=share)


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    labels = table(spark, sf_dir, "labels").filter(remainder(3) != 1)
    docs = table(spark, sf_dir, "documents")
    return toxicity.learn(labelled_sample(docs, labels, "toxic", toxicity.SAMPLE), texts=docs)


def op7_quality_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return scored.select("doc_id", held_out(5, 0), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_toxicity_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", held_out(3, 1), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.learn(docs.filter(remainder(4) != 2)))
    return found.select("doc_id", held_out(4, 2), "lang_pred", "score")


def op10_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(table(spark, sf_dir, "documents"), vocabulary())


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middle.fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    back = middle.restored(F.col("form"), F.col("output"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_secret_scan, op2_license_scan, op3_exact_topk, op4_jaccard_join, op5_media_flac, op6_best_fit_packing,
            op7_quality_compression, op8_toxicity_deobfuscation, op9_language_id, op10_bpe_tree,
            op11_filter_audit, op12_decontaminate, op13_fill_in_middle,
        )
    }


_BASE = (
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"\x27]?\x20*[:=]\x20*[\"\x27]?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    ("webtoken", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    ("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)


def _op1_sql() -> str:
    """Matches and the text between them give the spans; plain regexes over whole texts, no index."""
    parts = []
    for order, (kind, pattern, group, least) in enumerate(_BASE):
        parts.append(f"""
          select rid, {order} as o, '{kind}' as kind, ends[i] - len(found[i]) as a, ends[i] as b, size_of[i] as n from (
            select rid, found, size_of, list_transform(range(1, len(found) + 1), lambda i: list_sum(list_transform(gaps[1:i], lambda g: len(g))) + list_sum(list_transform(found[1:i], lambda g: len(g)))) as ends,
                   unnest(range(1, len(found) + 1)) as i
            from (select rid, regexp_extract_all(t, '{pattern}', 0) as found, string_split_regex(t, '{pattern}') as gaps,
                         list_transform(regexp_extract_all(t, '{pattern}', {group}), lambda g: len(g)) as size_of from d where regexp_matches(t, '{pattern}'))
          ) where size_of[i] >= {least}""")
    return f"""
      with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
      s as ({" union all ".join(parts)}),
      g as (select rid, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
                   string_agg(concat(kind, ':', a::bigint, ':', b::bigint), ',' order by a, o) filter (o <= 2) as base,
                   string_agg(concat(kind, ':', a::bigint, ':', b::bigint), ',' order by a, o) as spans from s group by rid)
      select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
             sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join g using (rid)"""


def _op2_sql() -> str:
    """Every stretch between two bigrams of a template, of any place and length within the size bounds; no anchors."""
    rows = ", ".join(f"('{k}', '{g}', {len(grams)})" for k, v in sorted(licenses.TEMPLATES.items()) for grams in [licenses.bigrams_of(v)] for g in sorted(grams))
    t = licenses.THRESHOLD
    return f"""
      with t(license, gram, size) as (values {rows}), l as (select license, list(gram) as own from t group by 1),
      d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
      w as (select rid, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') as ws from d),
      g as (select rid, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) as gs from w where len(ws) > 1),
      m as (select rid, license, size, i, row_number() over (partition by rid, license order by i) as n from (select rid, unnest(gs) as gram, generate_subscripts(gs, 1) as i from g) join t using (gram)),
      p as (select a.rid, a.license, a.size, a.i as a, b.i as b from m a join m b on a.rid = b.rid and a.license = b.license and b.i >= a.i and b.i - a.i + 1 <= floor({2 - t} / {t} * a.size + 1e-9)
            where b.i - a.i + 1 >= ceil({t} / {2 - t} * a.size - 1e-9) and 2.0 * (b.n - a.n + 1) / (b.i - a.i + 1 + a.size) >= {0.9 * t}),
      x as (select rid, license, size, list_distinct(gs[a : b]) as u, own from p join g using (rid) join l using (license)),
      s as (select rid, license, 2.0::double * len(list_intersect(u, own)) / (len(u) + size) as dice from x),
      best as (select rid, max(dice) as dice, min_by(license, (-dice, license)) as license, count(distinct license) as n from s where dice >= {t} group by rid)
      select doc_id, license, round(coalesce(dice, 0), 6)::double as dice, coalesce(n, 0)::bigint as n_licenses from d left join best using (rid)"""


_OP3_SQL = """
  with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
             where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
  e as (select vec_id, unnest(v) as x, generate_subscripts(v, 1) as d from v),
  s as (select q.vec_id as query_id, c.vec_id, sum(q.x * c.x)::bigint as score from e q join e c using (d) where q.vec_id % 100 = 0 and q.vec_id <> c.vec_id group by 1, 2),
  r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
  select query_id, rank::int as rank, vec_id, score from r where rank <= 10"""

_OP4_SQL = """
  with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents),
  s as (select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
               else list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) end) as g from w),
  n as (select doc_id, len(g) as n from s),
  e as (select doc_id, unnest(g) as g from s),
  p as (select a.doc_id as a, b.doc_id as b, count(*) as c from e a join e b using (g) where a.doc_id <> b.doc_id group by 1, 2),
  l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
  r(doc_id, other) as (select doc_id, doc_id from n union select r.doc_id, l.b from r join l on l.a = r.other)
  select doc_id, any_value(n.n)::bigint as n_shingles, min(other) as component_id from r join n using (doc_id) group by doc_id"""


_OP11_SQL = """
  with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
  w as (select *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from d),
  f as (select part, len(ws) < 200 as a, 100 * len(list_distinct(ws)) < 50 * len(ws) as b,
               100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t) as c, regexp_matches(t, '[#$%&*|]') as d,
               coalesce(doc_id > min(doc_id) over (partition by t), false) as e,
               exists (select 1 from labels l where l.doc_id = w.doc_id and quality = 1) as good, exists (select 1 from labels l where l.doc_id = w.doc_id and toxic = 1) as toxic from w),
  m as (select part, map {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} as fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from f group by all),
  l(x) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
  o as (select a.x || b.x || c.x || d.x || e.x as filter_order from l a, l b, l c, l d, l e
        where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
  s as (select filter_order, step, substr(filter_order, step, 1) as own, list_transform(range(1, step), lambda i: substr(filter_order, i, 1)) as earlier from o, range(1, 6) r(step)),
  p as (select part, filter_order, step, own, n, good, toxic, fails[own] as hit, len(list_filter(earlier, lambda x: fails[x])) > 0 as gone,
               len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: fails[x])) as many from m, s),
  c as (select part, filter_order, step, own, coalesce(sum(n) filter (not hit and not gone), 0) as kept, coalesce(sum(n) filter (hit and not gone), 0) as removed,
               coalesce(sum(n) filter (hit and gone), 0) as redundant, coalesce(sum(n) filter (hit and many = 1), 0) as unique_fails,
               coalesce(sum(good) filter (hit and not gone), 0) as good_lost, coalesce(sum(toxic) filter (hit and not gone), 0) as toxic_lost from p group by all)
  select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
         good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, sum(removed) over (partition by part, own)::bigint as shapley from c"""

_OP12_SQL = r"""
  with d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
  i as (select item_id::varchar as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
  k as (select item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) as a from i where len(ws) > 0),
  p as (select distinct item, array_to_string(ws[a : a + 9], ' ') as phrase, least(len(ws), 10) as size from k),
  g as (select rid, a, size, array_to_string(ws[a : a + size - 1], ' ') as phrase from (select rid, ws, size, unnest(range(1, len(ws) - size + 2)) as a from d, (select distinct size from p))),
  h as (select distinct rid, a, size, phrase from g semi join p using (phrase, size)),
  n as (select rid, count(*) as n_hit from (select distinct rid, unnest(range(a, a + size)) as at from h) group by rid),
  m as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct rid, item from h join p using (phrase, size) where item is not null) group by rid)
  select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
  from d left join n using (rid) left join m using (rid)"""

_OP13_SQL = """
  with d as (select doc_id, coalesce(text, '') as t, sha256(concat('1:', doc_id)) as h from documents),
  n as (select doc_id, t, len(t) as n, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2, ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from d),
  c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
               case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from n),
  p as (select *, substr(t, 1, a) as head, substr(t, a + 1, b - a) as mid, substr(t, b + 1) as tail from c)
  select doc_id, n::bigint as n, form, case when form <> 'plain' then a end::bigint as prefix_chars, case when form <> 'plain' then b - a end::bigint as middle_chars,
         sha256(case form when 'plain' then t when 'psm' then '<P>' || head || '<S>' || tail || '<M>' || mid else '<S>' || tail || '<P>' || head || '<M>' || mid end) as output_sha256,
         sha256(t) as restored_sha256 from p"""


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": _op1_sql(), "op2_license_scan": _op2_sql(), "op3_exact_topk": _OP3_SQL, "op4_jaccard_join": _OP4_SQL, "op11_filter_audit": _OP11_SQL, "op12_decontaminate": _OP12_SQL, "op13_fill_in_middle": _OP13_SQL}
