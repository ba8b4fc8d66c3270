"""Resolution queries: parts as units, customers as persons."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dossierlake.functions import text as T
from dossierlake.operators import decide, persons, ranking, resolve
from dossierlake.plans.base import query

_UNIT_NAME = "p_name || ' ' || p_brand || ' ' || p_type || ' ' || p_size"
#: DuckDB form of the comparison key
KEY = "trim(regexp_replace(regexp_replace(regexp_replace(replace(lower({0}), 'ß', 'ss'), '[\\s\\-_]+', ' ', 'g'), '[^\\p{{L}}\\p{{N}}_ ]', ' ', 'g'), ' +', ' ', 'g'))"


def _units(t):
    return t.part.select(F.col("p_partkey").alias("unit_id"), F.concat_ws(" ", "p_name", "p_brand", "p_type", F.col("p_size").cast("string")).alias("name"))


def _mentions(t):
    """A spelling of every unit: upper case with hyphens, as is, without the last words, or unknown."""
    u = _units(t)
    words = F.split("name", " ")
    name = F.when(F.col("unit_id") % 4 == 0, F.upper(F.replace("name", F.lit(" "), F.lit("-")))).when(F.col("unit_id") % 4 == 1, F.col("name")).when(F.col("unit_id") % 4 == 2, F.array_join(F.slice(words, 1, 3), " ")).otherwise(F.concat(F.lit("x "), F.col("name")))
    return u.select(F.col("unit_id").alias("mention_id"), name.alias("name"))


_MENTIONS = f"""(SELECT p_partkey AS mention_id, CASE p_partkey % 4 WHEN 0 THEN upper(replace(n, ' ', '-')) WHEN 1 THEN n WHEN 2 THEN array_to_string(string_split(n, ' ')[1:3], ' ') ELSE 'x ' || n END AS name
  FROM (SELECT p_partkey, {_UNIT_NAME} AS n FROM part))"""
_FORMS = f"(SELECT {KEY.format('(' + _UNIT_NAME + ')')} AS key, 1 AS tier, p_partkey AS unit_id FROM part UNION ALL SELECT {KEY.format(chr(40) + 'p_name || chr(32) || p_brand' + chr(41))}, 2, p_partkey FROM part WHERE p_size <= 10)"
_TIERS = f"""WITH m AS (SELECT mention_id, name, {KEY.format('name')} AS key FROM {_MENTIONS}), f AS {_FORMS},
  h AS (SELECT mention_id, tier, count(DISTINCT unit_id)::bigint AS n, min(unit_id) AS u FROM m JOIN f USING (key) GROUP BY mention_id, tier),
  b AS (SELECT mention_id, min(tier)::int AS tier, arg_min(n, tier) AS n_units, arg_min(u, tier) AS u FROM h GROUP BY mention_id)"""


def _forms(t):
    aliases = t.part.filter("p_size <= 10").select(F.col("p_partkey").alias("unit_id"), F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    return resolve.surface_forms(_units(t), aliases)


@query(_TIERS + " SELECT m.mention_id, tier, n_units, CASE WHEN n_units = 1 THEN u END AS unit_id FROM m LEFT JOIN b USING (mention_id)")
def j9_exact_tiers(t):
    return resolve.exact_tiers(_mentions(t), _forms(t)).select("mention_id", "tier", "n_units", "unit_id")


@query(_TIERS + """ SELECT split_part(p_brand, '#', 1) || substr(p_brand, -2, 1) AS organisation, CASE WHEN n_units IS NULL THEN 'NOT_FOUND' WHEN n_units = 1 THEN 'MATCHED' ELSE 'AMBIGUOUS' END AS status, count(*)::bigint AS mentions
  FROM m LEFT JOIN b USING (mention_id) JOIN part ON p_partkey = mention_id GROUP BY 1, 2""")
def entry_resolution_totals(t):
    """Flagship: resolve every mention by tier and count statuses per organisation."""
    got = resolve.exact_tiers(_mentions(t), _forms(t))
    status = F.when(F.col("n_units").isNull(), "NOT_FOUND").when(F.col("n_units") == 1, "MATCHED").otherwise("AMBIGUOUS")
    org = F.concat(F.split("p_brand", "#")[0], F.substring("p_brand", -2, 1))
    return got.join(t.part, F.col("p_partkey") == F.col("mention_id")).groupBy(org.alias("organisation"), status.alias("status")).agg(F.count(F.lit(1)).alias("mentions"))


def _marked(t):
    """Units of whom every second has a marked name, aliases of every third, and mentions in capitals: as named, without marks, by alias, by alias without marks."""
    plain, part = F.concat_ws(" ", "p_name", "p_brand", F.col("p_partkey").cast("string")), F.col("p_partkey")
    marks = lambda c: F.translate(c, "aeo", "àéô")
    units = t.part.select(part.alias("unit_id"), F.when(part % 2 == 0, marks(plain)).otherwise(plain).alias("name"))
    alias = F.concat(F.lit("old "), F.floor(part / 6).cast("string"), F.lit(" "), F.col("p_brand"))
    aliases = t.part.filter("p_partkey % 3 = 0").select(part.alias("unit_id"), F.when(part % 2 == 0, marks(alias)).otherwise(alias).alias("name"))
    said = F.when(part % 5 == 0, F.when(part % 2 == 0, marks(plain)).otherwise(plain)).when(part % 5 == 1, plain).when(part % 5 == 2, marks(alias)).when(part % 5 == 3, alias).otherwise("nowhere")
    return t.part.select(part.alias("mention_id"), F.upper(said).alias("name")), units, aliases


_MARKED_SQL = f"""WITH b AS (SELECT p_partkey AS id, p_name || ' ' || p_brand || ' ' || p_partkey AS n, 'old ' || (p_partkey // 6) || ' ' || p_brand AS a FROM part), m AS (SELECT *, translate(n, 'aeo', 'àéô') AS nm, translate(a, 'aeo', 'àéô') AS am FROM b),
  f AS (SELECT id, CASE WHEN id % 2 = 0 THEN nm ELSE n END AS name, 1 AS tier FROM m UNION ALL SELECT id, CASE WHEN id % 2 = 0 THEN am ELSE a END, 2 FROM m WHERE id % 3 = 0),
  k AS (SELECT id, tier, {KEY.format('name')} AS key FROM f UNION ALL SELECT id, tier + 2, {KEY.format('strip_accents(name)')} FROM f),
  q AS (SELECT id AS mention_id, upper(CASE id % 5 WHEN 0 THEN CASE WHEN id % 2 = 0 THEN nm ELSE n END WHEN 1 THEN n WHEN 2 THEN am WHEN 3 THEN a ELSE 'nowhere' END) AS name FROM m),
  h AS (SELECT mention_id, tier, id FROM q JOIN k ON key = CASE WHEN tier > 2 THEN {KEY.format('strip_accents(q.name)')} ELSE {KEY.format('q.name')} END)"""


@query(_MARKED_SQL + ", g AS (SELECT mention_id, tier, count(DISTINCT id) AS n, min(id) AS one FROM h GROUP BY 1, 2) SELECT mention_id, g.tier::int AS tier, n AS n_units, CASE WHEN n = 1 THEN one END AS unit_id FROM q LEFT JOIN (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY tier) = 1) g USING (mention_id)")
def j9_folded_tiers(t):
    """All four tiers are hit: names, aliases, and both without marks."""
    mentions, units, aliases = _marked(t)
    return resolve.exact_tiers(mentions, resolve.surface_forms(units, aliases)).select("mention_id", "tier", "n_units", "unit_id")


@query(_MARKED_SQL + " SELECT mention_id, tier::int AS tier, id AS person_id FROM (SELECT DISTINCT * FROM h) QUALIFY tier = min(tier) OVER (PARTITION BY mention_id)")
def j11_alias_names(t):
    """People of the first tier of spellings that anyone answers, by name or alias, with marks or without."""
    mentions, units, aliases = _marked(t)
    day, none = F.lit("2026-01-01").cast("date"), F.lit(None).cast("date")
    people = units.select(F.col("unit_id").alias("person_id"), "name", none.alias("valid_from"), none.alias("valid_to"))
    got = persons.name_candidates(mentions.withColumn("as_of", day), people, aliases.select(F.col("unit_id").alias("person_id"), "name"))
    return got.select("mention_id", "tier", "person_id")


@query("""SELECT m.o_orderkey AS mention_id, min(p_partkey) AS code_unit, count(DISTINCT p_partkey)::bigint AS n_code_units FROM orders m JOIN part ON lower(trim(p_brand)) = lower(trim('  brand#' || (10 + o_custkey % 45) || ' '))
          WHERE (p_size > 20 OR DATE '1995-01-01' <= o_orderdate::date) GROUP BY 1""")
def j8_code_lookup(t):
    mentions = t.orders.select(F.col("o_orderkey").alias("mention_id"), F.concat(F.lit("  brand#"), (10 + F.col("o_custkey") % 45).cast("string"), F.lit(" ")).alias("code"), F.col("o_orderdate").cast("date").alias("as_of"))
    codes = t.part.select(F.col("p_brand").alias("code"), F.col("p_partkey").alias("unit_id"), F.when(F.col("p_size") <= 20, F.lit("1995-01-01").cast("date")).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    return resolve.by_code(mentions, codes)


_BM = f"""WITH d AS (SELECT DISTINCT p_name || ' ' || p_brand AS name FROM part), dt AS (SELECT name AS d_id, string_split({KEY.format('name')}, ' ') AS ts FROM d),
  tf AS (SELECT d_id, len(ts) AS len, t, count(*) AS tf FROM (SELECT d_id, ts, unnest(ts) AS t FROM dt) GROUP BY ALL), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
  st AS (SELECT count(*) AS n, avg(len(ts)) AS al FROM dt), q AS (SELECT DISTINCT p_name AS q_id FROM part), qt AS (SELECT q_id, t, count(*) AS qn FROM (SELECT q_id, unnest(string_split({KEY.format('q_id')}, ' ')) AS t FROM q) GROUP BY ALL),
  s AS (SELECT q_id, d_id, sum(qn * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / al))) AS raw FROM qt JOIN tf USING (t) JOIN df USING (t), st GROUP BY q_id, d_id),
  bm AS (SELECT q_id, d_id, raw / max(raw) OVER (PARTITION BY q_id) AS bm25 FROM s)"""


def _name_queries(t):
    q = t.part.select(F.col("p_name").alias("q_id")).distinct().withColumn("name", F.col("q_id"))
    d = t.part.select(F.concat_ws(" ", "p_name", "p_brand").alias("d_id")).distinct().withColumn("name", F.col("d_id"))
    return q, d


@query(_BM + " SELECT q_id, d_id, round(bm25, 6) AS bm25 FROM bm")
def f9_bm25(t):
    return resolve.bm25(*_name_queries(t)).select("q_id", "d_id", F.round("bm25", 6).alias("bm25"))


@query(_BM + """, r AS (SELECT q_id, d_id, raw, row_number() OVER (PARTITION BY q_id ORDER BY round(raw, 9) DESC, d_id)::int AS rank FROM s)
  SELECT q_id, d_id, rank, round(raw, 6) AS raw FROM r WHERE rank <= 10""")
def a10_bm25_top(t):
    """The ten best names by words, from the postings of essential terms."""
    q, d = _name_queries(t)
    return ranking.Postings(d).top(q, 10).select("q_id", "d_id", "rank", F.round("raw", 6).alias("raw"))


@query()
def b5_semantic_rank(t):
    """Ranking that hears a semantic score: the cosine of vectors of names, for each name's fifty nearest."""
    q, d = _name_queries(t)
    first = lambda rows, name: t.part.groupBy(name.alias("name")).agg(F.min("p_partkey").alias("vec_id")).join(rows.select("q_id" if rows is q else "d_id", "name"), "name")
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    unit = lambda: t.embeddings.select("vec_id", F.transform("embedding", lambda x: x / length).alias("v"))
    asked = first(q, F.col("p_name")).join(unit(), "vec_id").select(F.col("vec_id").alias("q_id"), "v", F.col("q_id").alias("said"))
    held = first(d, F.concat_ws(" ", "p_name", "p_brand")).join(unit(), "vec_id").select(F.col("vec_id").alias("d_id"), "v", F.col("d_id").alias("named"))
    near = resolve.nearest_vectors(asked.select("q_id", "v"), held.select("d_id", "v"), 50)
    semantic = near.join(asked.select("q_id", "said"), "q_id").join(held.select("d_id", "named"), "d_id").select(F.col("said").alias("q_id"), F.col("named").alias("d_id"), F.col("cosine").alias("semantic"))
    return resolve.hybrid_rank(q, d, semantic).select("q_id", "d_id", "rank", F.round("combined", 6).alias("combined"), F.round("semantic", 6).alias("semantic"))


@query()
def b5_hybrid_rank(t):
    q, d = _name_queries(t)
    return resolve.hybrid_rank(q, d).select("q_id", "d_id", "rank", F.round("combined", 6).alias("combined"), F.round("fuzzy", 6).alias("fuzzy"))


@query()
def b6_accept_gate(t):
    q, d = _name_queries(t)
    top = resolve.top_and_margin(resolve.hybrid_rank(q, d))
    p = resolve.display_probability(F.col("fuzzy"), F.col("margin"))
    return top.select("q_id", "d_id", F.round("margin", 6).alias("margin"), F.round(p, 6).alias("probability"), resolve.accept(F.col("fuzzy"), F.col("margin"), p, F.col("combined")).alias("status"))



@query("SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(l_discount * 40 - 2 + l_tax * 10))), 6) AS p FROM lineitem")
def f11_calibrate(t):
    z = F.col("l_discount") * 40 - 2 + F.col("l_tax") * 10
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(T.logistic(z), 6).alias("p"))


@query(_TIERS + """, x AS (SELECT m.mention_id, m.name, CASE WHEN mention_id % 3 = 0 THEN mention_id WHEN mention_id % 7 = 0 THEN mention_id + 1 END AS code_unit, tier, n_units, CASE WHEN n_units = 1 THEN u END AS unit_id FROM m LEFT JOIN b USING (mention_id))
  SELECT mention_id, CASE WHEN n_units > 1 AND code_unit IS NULL THEN 'AMBIGUOUS' WHEN code_unit IS NOT NULL AND n_units = 1 AND unit_id <> code_unit THEN 'CONFLICT' WHEN code_unit IS NOT NULL OR n_units = 1 THEN 'MATCHED' ELSE 'NOT_FOUND' END AS status FROM x""")
def b7_unit_decision(t):
    got = resolve.exact_tiers(_mentions(t), _forms(t))
    code = F.when(F.col("mention_id") % 3 == 0, F.col("mention_id")).when(F.col("mention_id") % 7 == 0, F.col("mention_id") + 1)
    none = F.lit(None)
    rows = got.withColumn("code_unit", code).withColumn("top_unit", none.cast("long")).withColumn("fuzzy", none.cast("double")).withColumn("margin", none.cast("double")).withColumn("ranked_status", none.cast("string"))
    return resolve.decide_unit(rows).select("mention_id", "status")


def _people(t):
    """Customers as people, named by segment and nation, so that names are shared; those valid from a day on have a one-letter
    word, as a name that nobody has yet is not compared with others then, which SQL could not say."""
    born = (1950 + F.col("c_custkey") % 40).cast("int")
    start = F.when(F.col("c_custkey") % 9 == 0, F.lit("1996-01-01").cast("date"))
    kind = F.when(F.col("c_nationkey") < 5, "SYNTHETIC_DEMO").otherwise(F.when(F.col("c_custkey") % 2 == 0, "ROSTER").otherwise("CURATED"))
    return t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select(  # 25 nations
        F.col("c_custkey").alias("person_id"), F.concat_ws(" ", F.lower("c_mktsegment"), F.lower(F.replace("n_name", F.lit(" "), F.lit(""))), F.when(F.col("c_custkey") % 9 == 0, "q")).alias("name"), born.alias("birth_year"),
        (F.col("c_custkey") % 60).alias("unit_id"), kind.alias("source_kind"), start.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"),
    )


def _person_mentions(t):
    """Orders as mentions of their customers: by code, by name with a year or a unit, or by an unfinished name."""
    k = F.col("o_orderkey")
    rows = t.orders.join(_people(t).select("person_id", "name", F.col("birth_year").alias("year"), F.col("unit_id").alias("unit")), F.col("person_id") == F.col("o_custkey"))
    name = F.when(k % 11 == 0, F.concat("name", F.lit(" x"))).when(k % 13 == 0, None).when(k % 2 == 0, F.upper("name")).otherwise(F.col("name"))
    return rows.select(
        k.alias("mention_id"), name.alias("name"), F.when(k % 5 == 0, F.concat(F.lit(" p"), (F.col("o_custkey") + F.when(k % 3 == 0, 1).otherwise(0)).cast("string"))).alias("code"),
        F.when(k % 4 == 0, F.col("year") + F.when(k % 28 == 0, 100).otherwise(0)).cast("int").alias("birth_year"), F.when(k % 6 == 1, F.col("unit")).alias("unit_id"),
        F.when(k % 6 == 2, F.concat(F.lit("unit "), (F.col("unit") + F.when(k % 7 == 0, 90).otherwise(0)).cast("string"))).alias("unit_name"), F.col("o_orderdate").cast("date").alias("as_of"),
    )


def _codes(t):
    return _people(t).select("person_id", F.concat(F.lit("P"), F.col("person_id").cast("string")).alias("code"))


def _unit_names(t):
    return t.spark.range(60).select(F.concat(F.lit("unit "), F.col("id").cast("string")).alias("name"), F.col("id").alias("unit_id"))


_PEOPLE = """p AS (SELECT c_custkey AS person_id, lower(c_mktsegment) || ' ' || lower(replace(n_name, ' ', '')) || CASE WHEN c_custkey % 9 = 0 THEN ' q' ELSE '' END AS name, (1950 + c_custkey % 40)::int AS birth_year, c_custkey % 60 AS unit_id,
    CASE WHEN c_nationkey < 5 THEN 'SYNTHETIC_DEMO' WHEN c_custkey % 2 = 0 THEN 'ROSTER' ELSE 'CURATED' END AS source_kind, CASE WHEN c_custkey % 9 = 0 THEN DATE '1996-01-01' END AS valid_from FROM customer JOIN nation ON c_nationkey = n_nationkey),
  m AS (SELECT o_orderkey AS mention_id, CASE WHEN o_orderkey % 11 = 0 THEN name || ' x' WHEN o_orderkey % 13 <> 0 THEN name END AS name, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey + (o_orderkey % 3 = 0)::int END AS code,
    CASE WHEN o_orderkey % 4 = 0 THEN birth_year + CASE WHEN o_orderkey % 28 = 0 THEN 100 ELSE 0 END END AS year, CASE WHEN o_orderkey % 6 IN (1, 2) THEN CASE WHEN o_orderkey % 6 = 2 AND o_orderkey % 7 = 0 THEN -1 ELSE unit_id END END AS unit, o_orderdate::date AS as_of FROM orders JOIN p ON person_id = o_custkey),
  c AS (SELECT mention_id, person_id AS code_person FROM m JOIN p ON person_id = code AND (valid_from IS NULL OR valid_from <= as_of)),
  x AS (SELECT mention_id, person_id, (year IS NULL OR year = birth_year) AND (unit IS NULL OR unit = unit_id) AS fits, year IS NOT NULL OR unit IS NOT NULL AS narrowing FROM m JOIN p USING (name) WHERE valid_from IS NULL OR valid_from <= as_of)"""


@query(f"WITH {_PEOPLE} SELECT mention_id, person_id, 1 AS tier FROM x")
def j11_person_names(t):
    people = _people(t)
    return persons.name_candidates(_person_mentions(t), people, people.select("person_id", "name").limit(0)).select("mention_id", "person_id", "tier")


@query(f"WITH {_PEOPLE} SELECT mention_id, person_id, narrowing, fits FROM x")
def j12_narrowing(t):
    people, mentions = _people(t), _person_mentions(t)
    return persons.narrowed_names(mentions, people, people.select("person_id", "name").limit(0), _unit_names(t)).select("mention_id", "person_id", "narrowing", "fits")


_DECIDED = f"""WITH {_PEOPLE}, n AS (SELECT mention_id, count(*) AS n, min(person_id) AS one, bool_or(narrowing) AS narrowing, count(*) FILTER (fits) AS f, min(person_id) FILTER (fits) AS fit, list_sort(list(person_id)) AS ns, list_sort(list(person_id) FILTER (fits)) AS fs FROM x GROUP BY 1),
  d AS (SELECT m.mention_id, CASE WHEN code_person IS NOT NULL AND n = 1 AND one <> code_person THEN 'CONFLICT' WHEN code_person IS NOT NULL OR f = 1 THEN 'MATCHED' WHEN f = 0 THEN 'CONFLICT' WHEN n > 0 THEN 'AMBIGUOUS' ELSE 'NOT_FOUND' END AS status,
    CASE WHEN code_person IS NOT NULL AND n = 1 AND one <> code_person THEN 'PERSON_CODE_NAME_CONFLICT' WHEN code_person IS NOT NULL THEN 'TRUSTED_PERSON_CODE' WHEN f = 1 THEN 'CANONICAL_EXACT' || CASE WHEN narrowing THEN '_NARROWED' ELSE '' END
      WHEN f = 0 THEN 'PERSON_NARROWING_CONFLICT' WHEN n > 0 THEN 'PERSON_EXACT_NAME_AMBIGUOUS' WHEN name IS NOT NULL THEN 'INCOMPLETE_NAME_QUERY' END AS method,
    CASE WHEN code_person IS NOT NULL AND n = 1 AND one <> code_person THEN NULL WHEN code_person IS NOT NULL THEN code_person WHEN f = 1 THEN fit END AS person_id,
    CASE WHEN code_person IS NOT NULL AND n = 1 AND one <> code_person THEN [code_person, one] WHEN code_person IS NOT NULL OR f = 1 THEN [] WHEN f = 0 THEN ns WHEN n > 0 THEN fs ELSE [] END AS cs FROM m LEFT JOIN c USING (mention_id) LEFT JOIN n USING (mention_id))"""


@query(_DECIDED + """, k AS (SELECT mention_id, count(DISTINCT source_kind) AS n, min(source_kind) AS kind FROM (SELECT mention_id, unnest(CASE WHEN person_id IS NOT NULL THEN [person_id] ELSE cs END) AS person_id FROM d) JOIN p USING (person_id) GROUP BY 1)
  SELECT mention_id, status, method, person_id, CASE WHEN k.n = 1 THEN kind ELSE 'PROVIDED' END AS source_kind, array_to_string(cs, ',') AS candidates FROM d LEFT JOIN k USING (mention_id)""")
def b9_person_resolution(t):
    people = _people(t)
    shown = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    got = persons.resolve_persons(_person_mentions(t), people, people.select("person_id", "name").limit(0), _codes(t), _unit_names(t), shown)
    return got.select("mention_id", "status", "method", "person_id", "source_kind", "candidates")


@query(_DECIDED + """ SELECT mention_id, string_agg(person_id || ':unit ' || unit_id, ',' ORDER BY place) AS candidates FROM (SELECT mention_id, unnest(cs) AS person_id, generate_subscripts(cs, 1) AS place FROM d) JOIN p USING (person_id) GROUP BY 1""")
def j13_candidate_units(t):
    people = _people(t)
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["person_id"].cast("string"), F.lit(":"), x["unit_name"])), ",")
    return persons.candidate_units(_person_mentions(t), people, people.select("person_id", "name").limit(0), _codes(t), _unit_names(t), shown)


@query()
def b4_unit_resolution(t):
    """Orders as mentions of parts' names: spelled as they are, by alias, without marks, with a slip, unknown; some with a code."""
    units = t.part.select(F.concat_ws(" ", "p_name", "p_brand").alias("name"), "p_partkey").groupBy("name").agg(F.min("p_partkey").alias("unit_id"))
    units = units.withColumn("name", F.when(F.col("unit_id") % 5 == 0, F.translate("name", "aeo", "àéô")).otherwise(F.col("name")))
    aliases = units.filter("unit_id % 3 = 0").select("unit_id", F.regexp_replace("name", " .*#", " no ").alias("name"))
    codes = units.select(F.concat(F.lit("U-"), F.col("unit_id").cast("string")).alias("code"), "unit_id", F.lit(None).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    k = F.col("o_orderkey")
    named = t.part.select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("part_name"))
    own = t.part.groupBy(F.concat_ws(" ", "p_name", "p_brand").alias("part_name")).agg(F.min("p_partkey").alias("unit_id"))
    first = t.lineitem.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")  # an order's first line names its unit
    rows = t.orders.join(first, "o_orderkey").join(named, F.col("p_partkey") == F.col("l_partkey")).join(own, "part_name").join(units, "unit_id")
    spelled = F.when(k % 7 == 0, resolve.T.strip_marks(F.col("name"))).when(k % 7 == 1, F.regexp_replace("name", " .*#", " no ")).when(k % 7 == 2, F.regexp_replace("name", "[rn]", "")).when(k % 7 == 3, F.lit("nowhere at all")).when(k % 7 == 4, "").otherwise(F.upper("name"))
    code = F.when(k % 6 == 0, F.concat(F.lit("u-"), (F.col("unit_id") + F.when(k % 12 == 0, 1).otherwise(0)).cast("string")))
    mentions = rows.select(F.concat_ws("/", k.cast("string"), F.col("unit_id").cast("string")).alias("mention_id"), spelled.alias("name"), code.alias("code"), F.col("o_orderdate").cast("date").alias("as_of"))
    got = resolve.resolve_units(mentions, units, aliases, codes)
    return got.select("mention_id", "status", "method", "unit_id", F.bround("score", 4).alias("score"), F.bround("margin", 4).alias("margin"), F.bround("confidence", 4).alias("confidence"), F.size("candidates").alias("n_candidates"))


@query(f"SELECT doc_id, md5({KEY.format('text')}) AS key_md5 FROM documents")
def f1_normalize(t):
    return t.documents.select("doc_id", F.md5(T.normalize_text(F.col("text")).cast("binary")).alias("key_md5"))


@query(f"SELECT doc_id, md5({KEY.format('strip_accents(text)')}) AS key_md5 FROM documents")
def f2_ascii_key(t):
    return t.documents.select("doc_id", F.md5(T.ascii_key(F.col("text")).cast("binary")).alias("key_md5"))


@query("SELECT p_partkey, upper(left(sha1(p_brand || '|' || p_name), 12)) AS unit_id, sha256(p_name || '|' || p_type) AS row_hash FROM part")
def f13_ids(t):
    return t.part.select("p_partkey", T.stable_id(F.col("p_brand"), F.col("p_name")).alias("unit_id"), F.sha2(F.concat_ws("|", "p_name", "p_type").cast("binary"), 256).alias("row_hash"))


@query("""SELECT c_custkey, base || CASE WHEN r = 1 THEN '' ELSE r::varchar END AS username FROM (SELECT c_custkey, base, row_number() OVER (PARTITION BY base ORDER BY c_custkey) AS r FROM (
  SELECT c_custkey, w[-1] || array_to_string(list_transform(w[1:len(w) - 1], lambda x: x[1]), '') AS base FROM (SELECT c_custkey, regexp_split_to_array(lower(c_mktsegment || ' ' || n_name), '[ _]+') AS w FROM customer JOIN nation ON c_nationkey = n_nationkey)))""")
def f25_username(t):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    base = rows.select("c_custkey", T.username(F.concat_ws(" ", "c_mktsegment", "n_name")).alias("base"))
    r = F.row_number().over(Window.partitionBy("base").orderBy("c_custkey"))
    return base.withColumn("r", r).select("c_custkey", F.concat("base", F.when(F.col("r") == 1, "").otherwise(F.col("r").cast("string"))).alias("username"))


_LCS = """WITH RECURSIVE p AS (SELECT DISTINCT p_name AS a, p_type AS b FROM part),
  r(a, b, i, row) AS (SELECT a, b, 0, list_transform(range(0, length(b) + 1), lambda x: 0) FROM p
    UNION ALL SELECT a, b, i + 1, list_transform(range(1, length(b) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(row[k], CASE WHEN k > 1 AND substr(b, (k - 1)::int, 1) = substr(a, i + 1, 1) THEN row[k - 1] + 1 ELSE 0 END)))) FROM r WHERE i < length(a))"""


@query(_LCS + " SELECT a, b, row[length(b) + 1]::int AS lcs, round(200.0::double * row[length(b) + 1] / (length(a) + length(b)), 6) AS ratio FROM r WHERE i = length(a)")
def f5_lcs_ratio(t):
    p = t.part.select(F.col("p_name").alias("a"), F.col("p_type").alias("b")).distinct()
    return p.select("a", "b", T.lcs_length(F.col("a"), F.col("b")).alias("lcs"), F.round(T.ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


@query("""WITH e AS (SELECT vec_id, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), s AS (SELECT a.vec_id AS q_id, b.vec_id AS d_id, round(greatest(0, least(1, sum(a.x * b.x))), 6) AS cosine
          FROM e a JOIN e b USING (d) WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY cosine DESC, d_id) AS rank FROM s) SELECT q_id, d_id, cosine, rank::int AS rank FROM r WHERE rank <= 5""")
def f10_cosine_topk(t):
    q = t.embeddings.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("v"))
    return resolve.nearest_vectors(q, t.embeddings.select(F.col("vec_id").alias("d_id"), F.col("embedding").alias("v")), 5)


@query("""SELECT o_orderkey, CASE o_custkey % 8 WHEN 0 THEN 'CAND' WHEN 2 THEN 'CAND' WHEN 4 THEN 'QUAN_NHAN' WHEN 6 THEN 'CO_YEU_HUONG_LUONG_NHU_QUAN_NHAN' END AS subject_group, [1.0, 0.0, 0.95, 0.0, 0.92, 0.0, 0.9, 0.0][(o_custkey % 8)::int + 1]::double AS confidence,
  ['EXPLICIT_FIELD', 'INVALID_EXPLICIT_GROUP', 'RULE_TEXT', 'INSUFFICIENT_EVIDENCE', 'RULE_TEXT', 'INSUFFICIENT_EVIDENCE', 'RULE_TEXT', 'INSUFFICIENT_EVIDENCE'][(o_custkey % 8)::int + 1] AS method FROM orders""")
def b10_subject_group(t):
    """Orders as subjects: a known and an unknown group, keywords affirmed and negated, a role that was left, another organisation."""
    k = F.col("o_custkey") % 8
    explicit = F.when(k == 0, " cand ").when(k == 1, "other")
    text = F.element_at(F.array(*map(F.lit, (
        "", "", "Không phải là chiến sĩ công an, nhưng bố là chiến sĩ Công an", "không còn là sĩ quan công an", "là quân nhân", "từng là sĩ quan, nay đã thôi công tác", "ngành cơ yếu và quân nhân", "là quân nhân",
    ))), (k + 1).cast("int"))
    org = F.when(k.isin(4, 5, 6), "BQP").otherwise("BCA")
    return t.orders.select("o_orderkey", decide.subject_group(org, F.lit(None).cast("string"), F.concat(text, F.lit(" "), F.col("o_orderpriority")), explicit).alias("g")).select("o_orderkey", "g.*")
