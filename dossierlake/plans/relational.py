"""Listing, totals, search, comparison and set queries over orders as cases, line items as results, parts as units."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dossierlake.functions import text as T
from dossierlake.operators import decide, registry, synthetic
from dossierlake.plans.base import query, same_sql
from dossierlake.sources.shared import fresh_folder

same_sql("p3_trusted_rows", "SELECT p_partkey, p_brand FROM {part} WHERE p_size >= 10 AND p_type = 'ECONOMY' OR p_size = 5")
same_sql(
    "p4_latest_version",
    "SELECT o_custkey, max(o_orderdate) AS latest, CAST(count(*) AS BIGINT) AS versions FROM {orders} WHERE o_orderstatus = 'F' GROUP BY o_custkey",
)
same_sql(
    "p5_scope",
    "SELECT o_orderkey, o_orderpriority FROM {orders} WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND (o_custkey IS NULL OR o_custkey <= 50)",
)
same_sql(
    "p6_owner_or_scope",
    "SELECT o_orderkey FROM {orders} WHERE o_custkey = 7 OR o_orderkey IN (SELECT l_orderkey FROM {lineitem} WHERE l_quantity >= 49)",
)
same_sql(
    "p7_day_range",
    "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1995-04-01 00:00:00'",
)
same_sql("p8_literal_contains", "SELECT p_partkey, p_name FROM {part} WHERE position('re' IN lower(p_name)) > 0")
same_sql(
    "p9_multi_search",
    "SELECT c_custkey, c_name FROM {customer} WHERE lower(coalesce(c_name, '')) LIKE '%00001%' OR lower(coalesce(c_mktsegment, '')) LIKE '%auto%'",
)
same_sql("p10_prefix", "SELECT c_custkey FROM {customer} WHERE c_name LIKE 'Customer#00000%'")
same_sql(
    "p11_first_present",
    "SELECT event_id, coalesce(nullif(get_json_object(props, '$.missing'), ''), nullif(get_json_object(props, '$.k'), '')) AS k FROM {events}",
    "SELECT event_id, coalesce(nullif(json_extract_string(props, '$.missing'), ''), nullif(json_extract_string(props, '$.k'), '')) AS k FROM events",
)
same_sql(
    "j1_case_totals",
    """SELECT o_orderstatus, l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM {orders} LEFT JOIN
       (SELECT l_orderkey, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM {lineitem} GROUP BY l_orderkey) r
       ON o_orderkey = l_orderkey GROUP BY o_orderstatus, l_returnflag, l_linestatus""",
)
same_sql(
    "j2_page_lookup",
    """SELECT p.o_orderkey, p.o_totalprice, c.c_name FROM (SELECT * FROM {orders} ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100) p
       LEFT JOIN {customer} c ON c.c_custkey = p.o_custkey""",
)
same_sql(
    "j4_exists_or_search",
    """SELECT o_orderkey FROM {orders} o WHERE o_orderpriority = '5-LOW' OR EXISTS
       (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey AND l.l_discount >= 0.1 AND l.l_returnflag = 'R')""",
)
same_sql(
    "j5_semi",
    "SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 200000)",
)
same_sql(
    "j6_pending_anti",
    """SELECT a.c_custkey, a.c_name FROM {customer} a WHERE a.c_custkey % 3 <> 0 AND NOT EXISTS
       (SELECT 1 FROM {customer} b WHERE b.c_custkey % 2 = 0 AND b.c_custkey = a.c_custkey AND b.c_mktsegment = a.c_mktsegment)""",
)
same_sql("o1_page", "SELECT o_orderkey, o_orderdate FROM {orders} ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 25")
same_sql("o2_queue", "SELECT o_orderkey, o_orderdate FROM {orders} WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 25")
same_sql("o3_multi_order", "SELECT c_custkey, c_mktsegment FROM {customer} ORDER BY CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END, c_acctbal DESC, c_custkey LIMIT 40")
same_sql("o4_audit_top", "SELECT event_id, ts FROM {events} ORDER BY ts DESC, event_id DESC LIMIT 500")
same_sql("o5_outbox", "SELECT event_id, ts FROM {events} WHERE event_type <> 'view' ORDER BY ts, event_id LIMIT 500")
same_sql(
    "o7_table_order",
    """SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY coalesce(l_linenumber, 1000000000),
       CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END, l_partkey, l_suppkey) AS BIGINT) AS pos FROM {lineitem}""",
)
same_sql("o8_admin_listing", "SELECT s_suppkey, s_name, CAST((SELECT count(*) FROM {supplier}) AS BIGINT) AS total FROM {supplier} ORDER BY s_name, s_suppkey LIMIT 20")
same_sql("u1_union", "SELECT 'c' AS kind, c_custkey AS id, c_name AS name FROM {customer} UNION ALL SELECT 's', s_suppkey, s_name FROM {supplier}")
same_sql("u2_except", "SELECT c_custkey AS id FROM {customer} EXCEPT SELECT o_custkey FROM {orders} WHERE o_totalprice > 350000")
same_sql("u3_intersect", "SELECT c_custkey AS id FROM {customer} INTERSECT SELECT o_custkey FROM {orders} WHERE o_totalprice > 100000")
same_sql(
    "u4_signatures_differ",
    """SELECT a.l_orderkey FROM (SELECT l_orderkey, array_join(sort_array(collect_set(l_returnflag)), ',') AS s FROM {lineitem} WHERE l_linenumber % 2 = 0 GROUP BY l_orderkey) a
       JOIN (SELECT l_orderkey, array_join(sort_array(collect_set(l_returnflag)), ',') AS s FROM {lineitem} WHERE l_linenumber % 2 = 1 GROUP BY l_orderkey) b
       ON a.l_orderkey = b.l_orderkey WHERE a.s <> b.s""",
    """SELECT a.l_orderkey FROM (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS s FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY l_orderkey) a
       JOIN (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS s FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY l_orderkey) b
       ON a.l_orderkey = b.l_orderkey WHERE a.s <> b.s""",
)
same_sql("a1_count", "SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT o_orderkey FROM {orders} WHERE o_totalprice > 50000) x")
same_sql(
    "a3_pivot_totals",
    """SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS verified, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS need_review,
       CAST(sum(CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 1 ELSE 0 END) AS BIGINT) AS no_conclusion FROM {orders} GROUP BY o_orderpriority""",
)
same_sql(
    "a5_child_counts",
    """SELECT 'customer' AS child, n_regionkey AS version, CAST(count(*) AS BIGINT) AS n FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_regionkey
       UNION ALL SELECT 'supplier', n_regionkey, CAST(count(*) AS BIGINT) FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey GROUP BY n_regionkey
       UNION ALL SELECT 'nation', n_regionkey, CAST(count(*) AS BIGINT) FROM {nation} GROUP BY n_regionkey""",
)
same_sql("a8_value_counts", "SELECT p_brand, CAST(count(*) AS BIGINT) AS n FROM {part} GROUP BY p_brand")
same_sql("a9_leakage", "SELECT p_name, CAST(count(DISTINCT p_brand) AS BIGINT) AS brands FROM {part} GROUP BY p_name HAVING count(DISTINCT p_brand) > 1")
same_sql("a19_duplicates", "SELECT p_name, p_brand, CAST(count(*) AS BIGINT) AS n FROM {part} GROUP BY p_name, p_brand HAVING count(*) > 1")
same_sql("w11_latest_per_key", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM {orders}) x WHERE r = 1")
same_sql(
    "b33_seed_counters",
    """SELECT CAST(sum(CASE WHEN n_nationkey IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS no_unit, CAST(sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS BIGINT) AS untrusted,
       CAST(sum(CASE WHEN n_nationkey IS NOT NULL AND c_acctbal >= 0 THEN 1 ELSE 0 END) AS BIGINT) AS seeded FROM {customer} LEFT JOIN (SELECT n_nationkey FROM {nation} WHERE n_regionkey <> 2) n ON c_nationkey = n_nationkey""",
)


@query("SELECT o_orderkey FROM orders WHERE (o_orderdate::date IS NULL OR o_orderdate::date <= DATE '1996-06-15') AND (o_orderdate::date + 90 >= DATE '1996-06-15')")
def p1_active_on(t):
    start = F.col("o_orderdate").cast("date")
    return t.orders.filter(T.active_on(F.lit("1996-06-15").cast("date"), start, F.date_add(start, 90))).select("o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'no_conclusion' WHEN l_linestatus = 'F' AND l_returnflag IN ('A', 'R') THEN 'verified' WHEN l_linestatus = 'F' THEN 'out_of_scope'
          WHEN o_orderpriority = '1-URGENT' THEN 'need_review' ELSE 'no_conclusion' END AS category FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1""")
def p12_status_category(t):
    j = t.orders.join(t.lineitem.filter("l_linenumber = 1"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    workflow = F.when(F.col("o_orderstatus") == "P", "FAILED").when(F.col("o_orderpriority") == "1-URGENT", "NEED_REVIEW").otherwise("COMPLETED")
    org = F.when(F.col("l_returnflag").isin("A", "R"), "BCA").otherwise("OTHER")
    return j.select("o_orderkey", decide.status_category(workflow, F.when(F.col("l_linestatus") == "F", "MATCHED"), org).alias("category"))


@query("SELECT o_orderkey, 'HS-' || year(o_orderdate)::varchar || '-' || upper(left(lpad(o_orderkey::varchar, 10, '0'), 8)) AS code FROM orders")
def p14_case_code(t):
    return t.orders.select("o_orderkey", T.case_code(F.concat(F.lit("case_"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")), F.col("o_orderdate")).alias("code"))


@query("""SELECT a.l_orderkey, concat_ws('|', CASE WHEN nullif(a.l_returnflag, '') IS DISTINCT FROM nullif(b.l_returnflag, '') THEN 'flag' END, CASE WHEN a.l_quantity IS DISTINCT FROM b.l_quantity THEN 'quantity' END,
          CASE WHEN nullif(a.l_linestatus, '') IS DISTINCT FROM nullif(b.l_linestatus, '') THEN 'status' END) AS changed FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2""")
def p16_field_diff(t):
    a = t.lineitem.filter("l_linenumber = 1").select("l_orderkey", F.col("l_returnflag").alias("f"), F.col("l_quantity").alias("q"), F.col("l_linestatus").alias("s"))
    b = t.lineitem.filter("l_linenumber = 2").select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("f2"), F.col("l_quantity").alias("q2"), F.col("l_linestatus").alias("s2"))
    same = lambda x, y: F.nullif(F.col(x), F.lit("")).eqNullSafe(F.nullif(F.col(y), F.lit("")))
    names = F.array(F.when(~same("f", "f2"), F.lit("flag")), F.when(~F.col("q").eqNullSafe(F.col("q2")), F.lit("quantity")), F.when(~same("s", "s2"), F.lit("status")))
    return a.join(b, F.col("l_orderkey") == F.col("k")).select("l_orderkey", F.array_join(F.sort_array(F.array_compact(names)), "|").alias("changed"))


@query("""SELECT o_orderkey, coalesce(strftime(coalesce(try_strptime(d, '%d/%m/%Y'), try_strptime(d, '%d-%m-%Y')), '%Y-%m-%d'), d) AS day FROM (SELECT o_orderkey,
          CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN strftime(o_orderdate, '%d-%m-%Y') ELSE 'x' || o_orderpriority END AS d FROM orders)""")
def p17_parse_date(t):
    d = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "dd-MM-yyyy")).otherwise(F.concat(F.lit("x"), F.col("o_orderpriority")))
    return t.orders.select("o_orderkey", T.iso_date(d).alias("day"))


@query("""SELECT p_brand, string_agg(p_name || ':' || p_partkey, ',' ORDER BY p_name, p_partkey) AS units, count(*)::bigint AS n FROM part GROUP BY p_brand""")
def j3_nested_index(t):
    entry = F.struct("p_name", "p_partkey")
    g = t.part.groupBy("p_brand").agg(F.sort_array(F.collect_list(entry)).alias("u"), F.count(F.lit(1)).alias("n"))
    return g.select("p_brand", F.array_join(F.transform("u", lambda x: F.concat_ws(":", x["p_name"], x["p_partkey"].cast("string"))), ",").alias("units"), "n")


@query("""SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN a.c_custkey IS NULL THEN 'ADDED' WHEN b.c_custkey IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS change,
          CASE WHEN a.c_custkey IS NOT NULL AND b.c_custkey IS NOT NULL THEN concat_ws('|', CASE WHEN a.seg IS DISTINCT FROM b.seg THEN 'seg' END, CASE WHEN a.bal IS DISTINCT FROM b.bal THEN 'bal' END) END AS fields
          FROM (SELECT c_custkey, c_mktsegment AS seg, c_acctbal AS bal FROM customer WHERE c_custkey % 5 <> 0) a FULL JOIN
          (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'MOVED' ELSE c_mktsegment END AS seg, CASE WHEN c_custkey % 11 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS bal FROM customer WHERE c_custkey % 4 <> 0) b
          ON a.c_custkey = b.c_custkey WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL OR a.seg IS DISTINCT FROM b.seg OR a.bal IS DISTINCT FROM b.bal""")
def j7_version_diff(t):
    old = t.customer.filter("c_custkey % 5 <> 0").select("c_custkey", F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal"))
    new = t.customer.filter("c_custkey % 4 <> 0").select("c_custkey", F.expr("CASE WHEN c_custkey % 7 = 0 THEN 'MOVED' ELSE c_mktsegment END").alias("seg"), F.expr("CASE WHEN c_custkey % 11 = 0 THEN c_acctbal + 1 ELSE c_acctbal END").alias("bal"))
    return registry.version_diff(old, new, "c_custkey", ["seg", "bal"])


_CANDIDATES = "SELECT p_brand AS org, p_name AS name, p_type AS url, p_size > 45 AS strong, lower(p_name) AS key FROM part"


def _found(t):
    return t.part.select(F.col("p_brand").alias("org"), F.col("p_name").alias("name"), F.col("p_type").alias("url"), (F.col("p_size") > 45).alias("strong"))


@query(f"""SELECT org, key, name, strong, evidence, url, CASE WHEN strong OR evidence >= 2 THEN 'APPROVED' ELSE 'PENDING_QA' END AS qa_status FROM (SELECT org, key,
           min_by(name, (length(name), name)) AS name, bool_or(strong) AS strong, count(DISTINCT url)::bigint AS evidence, min(url) AS url FROM ({_CANDIDATES}) GROUP BY org, key)""")
def a6_registry_group(t):
    return registry.group_candidates(_found(t)).select("org", "key", "name", "strong", "evidence", "url", "qa_status")


@query("""SELECT p_name, p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY (p_size > 25) DESC, p_size DESC, p_partkey) AS r FROM part) WHERE r = 1""")
def w1_dedupe(t):
    return registry.dedupe(t.part, ["p_name"], [F.desc(F.col("p_size") > 25), F.desc("p_size"), F.col("p_partkey")]).select("p_name", "p_partkey", "p_size")


@query(f"""WITH g AS (SELECT org, key, min_by(name, (length(name), name)) AS name, CASE WHEN bool_or(strong) OR count(DISTINCT url) >= 2 THEN 'APPROVED' ELSE 'PENDING_QA' END AS qa_status,
           count(DISTINCT url)::bigint AS evidence, 1 AS src FROM ({_CANDIDATES}) GROUP BY org, key),
           c AS (SELECT DISTINCT p_brand AS org, lower(p_name) AS key, upper(p_name) AS name, 'APPROVED' AS qa_status, 1::bigint AS evidence, 0 AS src FROM part WHERE p_size = 1),
           r AS (SELECT *, row_number() OVER (PARTITION BY org, key ORDER BY (qa_status = 'APPROVED') DESC, evidence DESC, src, name) AS n FROM (SELECT * FROM g UNION ALL SELECT * FROM c))
           SELECT org, key, name, qa_status, evidence, upper(left(sha1(org || '|' || key), 12)) AS unit_id FROM r WHERE n = 1""")
def b1_build(t):
    curated = t.part.filter("p_size = 1").select(F.col("p_brand").alias("org"), F.lower("p_name").alias("key"), F.upper("p_name").alias("name"), F.lit("APPROVED").alias("qa_status"), F.lit(1).cast("long").alias("evidence")).distinct()
    return registry.build(_found(t), curated).select("org", "key", "name", "qa_status", "evidence", "unit_id")


@query("""WITH e AS (SELECT p_partkey AS id, 'PUBLISHED' AS qa_status, 'old' AS note FROM part WHERE p_partkey % 3 = 0),
  f AS (SELECT p_partkey AS id, CASE WHEN p_size > 20 THEN 'APPROVED' ELSE 'PENDING_QA' END AS qa_status, 'fresh' AS note FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'APPROVED', 'twice' FROM part WHERE p_partkey % 2 = 0 AND p_size > 40),
  w AS (SELECT p_partkey AS id, 'PENDING_QA' AS qa_status, 'waits' AS note FROM part WHERE p_partkey % 4 < 2),
  p AS (SELECT * FROM e UNION ALL SELECT id, 'APPROVED', min(note) FROM f WHERE qa_status = 'APPROVED' AND id NOT IN (SELECT id FROM e) GROUP BY id),
  q AS (SELECT * FROM w UNION ALL SELECT * FROM f WHERE qa_status <> 'APPROVED' AND id NOT IN (SELECT id FROM w))
  SELECT 'published' AS part, id, qa_status, note FROM p UNION ALL SELECT 'pending', id, qa_status, note FROM q WHERE id NOT IN (SELECT id FROM p)""")
def b2_publish(t):
    row = lambda keep, status, note: t.part.filter(keep).select(F.col("p_partkey").alias("id"), status.alias("qa_status"), F.lit(note).alias("note"))
    fresh = row("p_partkey % 2 = 0", F.when(F.col("p_size") > 20, "APPROVED").otherwise("PENDING_QA"), "fresh").unionByName(row("p_partkey % 2 = 0 and p_size > 40", F.lit("APPROVED"), "twice"))
    published, pending = registry.publish(row("p_partkey % 3 = 0", F.lit("PUBLISHED"), "old"), fresh, ["id"], row("p_partkey % 4 < 2", F.lit("PENDING_QA"), "waits"))
    return published.select(F.lit("published").alias("part"), "*").unionByName(pending.select(F.lit("pending").alias("part"), "*"))


@query("""WITH a AS (SELECT 0 AS file, p_partkey AS k, p_name AS canonical_name, p_brand AS organization_type, CASE WHEN p_size > 25 THEN 'APPROVED' ELSE 'PENDING_QA' END AS qa_status, CASE WHEN p_size % 3 = 0 THEN 'some' ELSE (p_size % 5)::varchar END AS evidence FROM part
    UNION ALL SELECT 1, p_partkey, upper(p_name), p_brand, CASE WHEN p_size > 45 THEN 'APPROVED' ELSE '' END, '9' FROM part UNION ALL SELECT 2, s_suppkey, s_name, 'Supplier', 'APPROVED', '' FROM supplier UNION ALL SELECT 3, s_suppkey, s_name, 'Supplier', 'APPROVED', '' FROM supplier),
  o AS (SELECT *, row_number() OVER (ORDER BY file, k) - 1 AS ordinal FROM a),
  r AS (SELECT *, row_number() OVER (PARTITION BY organization_type, lower(replace(canonical_name, '#', ' ')) ORDER BY qa_status = 'APPROVED' DESC, coalesce(try_cast(evidence AS double), 1) DESC, ordinal) AS nth FROM o)
  SELECT canonical_name, organization_type, qa_status, ordinal, row_number() OVER (ORDER BY ordinal) - 1 AS place FROM r WHERE nth = 1""")
def b3_merge_registries(t):
    """Four registry files, each of parts in its order, in one: the first file wins ties, and the order of the input stays."""
    folder = fresh_folder(t.spark, "registries")
    row = lambda df, key, name, org, status, evidence: df.repartitionByRange(3, key).sortWithinPartitions(key).select(name.alias("canonical_name"), org.alias("organization_type"), status.alias("qa_status"), evidence.alias("evidence_count"))
    approved = lambda least, other: F.when(F.col("p_size") > least, "APPROVED").otherwise(other)
    counted = F.when(F.col("p_size") % 3 == 0, "some").otherwise((F.col("p_size") % 5).cast("string"))
    suppliers = row(t.supplier, "s_suppkey", F.col("s_name"), F.lit("Supplier"), F.lit("APPROVED"), F.lit(""))
    files = [row(t.part, "p_partkey", F.col("p_name"), F.col("p_brand"), approved(25, "PENDING_QA"), counted), row(t.part, "p_partkey", F.upper("p_name"), F.col("p_brand"), approved(45, ""), F.lit("9")), suppliers, suppliers]
    paths = [f"{folder}/{k}" for k in range(len(files))]
    for rows, path in zip(files, paths):
        rows.write.option("header", True).csv(path)
    merged = registry.merge_registries(registry.read_registries(t.spark, paths))
    return registry.numbered(merged, "ordinal").select("canonical_name", "organization_type", "qa_status", "ordinal", "place")


@query("""SELECT n_name, expected, n, CASE WHEN n = 0 THEN 'MISSING' WHEN roster THEN 'ROSTER_REQUIRED' WHEN n >= expected THEN 'COMPLETE' ELSE 'PARTIAL' END AS status FROM (SELECT n_name, (n_nationkey * 3)::int AS expected, n_regionkey = 1 AS roster,
          coalesce(n, 0)::bigint AS n FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) ON c_nationkey = n_nationkey)""")
def a7_coverage(t):
    targets = t.nation.select(F.col("n_nationkey").alias("grp"), "n_name", (F.col("n_nationkey") * 3).alias("expected"), (F.col("n_regionkey") == 1).alias("roster"))
    counts = t.customer.groupBy(F.col("c_nationkey").alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    return registry.coverage(targets, counts, "grp").select("n_name", "expected", "n", "status")


@query("""SELECT DISTINCT rule, item FROM (SELECT 'NEGATIVE_BALANCE' AS rule, c_custkey::varchar AS item FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'DUPLICATE_NAME', p_name FROM part GROUP BY p_name HAVING count(*) > 1) ORDER BY rule, item LIMIT 200""")
def a20_violations(t):
    return registry.violations([("NEGATIVE_BALANCE", t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("item"))), ("DUPLICATE_NAME", registry.duplicates(t.part, ["p_name"]).select(F.col("p_name").alias("item")))])


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_type, '^(?:STANDARD|SMALL)') THEN 'DISTRICT' WHEN regexp_matches(p_type, '^(?:ECONOMY)') THEN 'PROVINCE' ELSE 'OTHER' END AS level FROM part")
def f22_taxonomy(t):
    return t.part.select("p_partkey", registry.taxonomy(F.col("p_type"), [("STANDARD|SMALL", "DISTRICT"), ("ECONOMY", "PROVINCE")]).alias("level"))


_RULES = [(1, ["BUILDING", "MACHINERY"], ["balance"], "1990-01-01", None), (2, ["*"], ["balance", "bonus"], "1995-01-01", "1996-12-31"), (3, [], [], None, None), (4, ["AUTOMOBILE"], [], None, "1994-12-31")]


def _assessed(t):
    rules = t.spark.createDataFrame([(*r, True) for r in _RULES], "rule_id int, groups array<string>, required array<string>, f string, u string, active boolean")
    rules = rules.select("rule_id", "groups", "required", F.col("f").cast("date").alias("effective_from"), F.col("u").cast("date").alias("effective_to"), "active")
    facts = F.create_map(F.lit("balance"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast("string")), F.lit("bonus"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("y")).otherwise(F.lit("")))
    cases = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("case_id"), F.col("o_orderdate").cast("date").alias("day"), F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment")).alias("subject_group"), facts.alias("facts"))
    return decide.evaluate_policies(cases, rules)


_POLICY_SQL = """WITH c AS (SELECT o_orderkey AS case_id, o_orderdate::date AS day, CASE WHEN c_custkey % 10 <> 0 THEN c_mktsegment END AS grp, c_acctbal > 0 AS bal, o_orderkey % 2 = 0 AS bonus FROM orders JOIN customer ON o_custkey = c_custkey),
  s AS (SELECT case_id, 1 AS rule_id, CASE WHEN grp IS NULL THEN 'INSUFFICIENT_DATA' WHEN grp NOT IN ('BUILDING', 'MACHINERY') THEN 'NOT_APPLICABLE' WHEN NOT bal THEN 'INSUFFICIENT_DATA' ELSE 'ELIGIBLE' END AS status FROM c WHERE day >= DATE '1990-01-01'
  UNION ALL SELECT case_id, 2, CASE WHEN grp IS NULL THEN 'INSUFFICIENT_DATA' WHEN NOT bal OR NOT bonus THEN 'INSUFFICIENT_DATA' ELSE 'ELIGIBLE' END FROM c WHERE day BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'
  UNION ALL SELECT case_id, 3, 'NOT_APPLICABLE' FROM c UNION ALL SELECT case_id, 4, CASE WHEN grp IS NULL THEN 'INSUFFICIENT_DATA' WHEN grp <> 'AUTOMOBILE' THEN 'NOT_APPLICABLE' ELSE 'ELIGIBLE' END FROM c WHERE day <= DATE '1994-12-31')"""


@query(_POLICY_SQL + " SELECT case_id, rule_id, status FROM s")
def b11_policy(t):
    return _assessed(t).select("case_id", "rule_id", "status")


@query(_POLICY_SQL + " SELECT case_id, CASE WHEN bool_or(status = 'INSUFFICIENT_DATA') THEN 'INSUFFICIENT_DATA' WHEN bool_or(status = 'ELIGIBLE') THEN 'ELIGIBLE' ELSE 'NOT_ELIGIBLE' END AS status FROM s GROUP BY case_id")
def p15_status_fold(t):
    return decide.fold_statuses(_assessed(t))


@query("SELECT p_partkey, CASE WHEN pr <= 0.7 THEN 'train' WHEN pr <= 0.85 THEN 'valid' ELSE 'test' END AS split FROM (SELECT p_partkey, percent_rank() OVER (ORDER BY sha256(p_partkey::varchar), p_partkey) AS pr FROM part)")
def w10_split(t):
    return synthetic.ranked_split(t.part, "p_partkey", {"train": 0.7, "valid": 0.85, "test": 1.0}).select("p_partkey", "split")


@query("""SELECT o_orderkey, CASE WHEN k = 0 THEN 'MULTI_UNIT' WHEN k = 1 THEN 'PERSON_UNIT_CONFLICT' WHEN k = 2 THEN 'PERSON_AMBIGUOUS' WHEN k = 3 THEN 'CONFLICT' WHEN k = 4 THEN 'ORGANIZATION_TYPE_UNKNOWN' WHEN k = 5 THEN 'DOCUMENT_PARSE_LOW_CONFIDENCE' WHEN k = 6 THEN 'DOCUMENT_EXTRACTION_LOW_CONFIDENCE'
  WHEN k = 7 AND o_orderkey % 2 = 0 THEN 'CURRENT_WORK_UNIT_UNCERTAIN' WHEN k = 8 THEN 'SUBJECT_GROUP_INSUFFICIENT' WHEN k = 9 THEN 'POLICY_INSUFFICIENT_DATA' END AS reason FROM (SELECT o_orderkey, o_custkey % 11 AS k FROM orders)""")
def b12_case_reason(t):
    k = F.col("o_custkey") % 11
    at = lambda n, yes, no: F.when(k == n, yes).otherwise(no)
    c = {
        "warning": F.when(k == 0, "MULTI_UNIT"), "conflict": k == 1, "person": at(2, "AMBIGUOUS", "MATCHED"), "unit": at(3, "CONFLICT", "MATCHED"), "organization": at(4, "UNKNOWN", "BCA"), "parse": k == 5,
        "extraction": at(6, F.lit(0.2), F.lit(0.9)), "relation": at(7, F.lit(0.3), F.lit(0.9)), "lookup": F.col("o_orderkey") % 2 == 1, "group": F.when(k != 8, "CAND"), "insufficient": k == 9,
    }
    return t.orders.select("o_orderkey", decide.case_reason(c).alias("reason"))


@query("""SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 9 = 0 THEN 'NOT_FOUND' WHEN o_custkey % 6 = 0 THEN 'ALREADY_OPEN' WHEN o_orderstatus = 'P' THEN 'IN_FLIGHT' WHEN o_custkey % 4 = 1 THEN 'CONCLUDED' ELSE 'CREATED' END AS outcome FROM orders""")
def b32_review_request(t):
    cases = t.orders.filter("o_orderkey % 9 <> 0").select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderstatus") == "P", "RUNNING").otherwise("COMPLETED").alias("workflow"), (F.col("o_custkey") % 4 == 1).alias("concluded"))
    reviews = t.orders.select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_custkey") % 6 == 0, "OPEN").otherwise("RESOLVED").alias("status"))
    asked = t.orders.select(F.col("o_orderkey").alias("case_id"))
    return decide.request_reviews(asked.unionByName(asked.limit(5)), cases, reviews)


#: the values of a decided case by its key; SQL and plan choose them alike, the decision is each one's own
_CASE = """SELECT o_orderkey AS case_id, o_orderdate::date AS day, o_orderkey % 5 <> 4 AS named, o_orderkey % 7 IN (0, 1, 2) AS united, o_orderkey % 11 = 5 AS coded, o_custkey % 9 AS p, o_custkey % 10 AS u, o_orderkey % 13 AS w, o_orderkey % 17 AS r, o_orderkey % 19 AS q,
  round(0.7 + o_orderkey % 31 / 100.0::double, 2) AS name_score, round(0.65 + o_orderkey % 29 / 100.0::double, 2) AS extraction, round(0.6 + o_custkey % 41 / 100.0::double, 2) AS relation, round(0.55 + o_orderkey % 23 / 50.0::double, 2) AS parse, o_custkey % 3 AS m, o_custkey, o_orderstatus FROM orders"""


@query(f"""WITH c AS ({_CASE}),
  d AS (SELECT *, named AS asked, united OR coded AS asserted, (named AND NOT united AND NOT coded) OR (coded AND NOT united) AS lookup, p <> 0 AS person_ok, u <> 0 AS unit_ok, p % 4 <> u % 4 AS unlike FROM c),
  e AS (SELECT *, asserted AND asked AND person_ok AND unit_ok AND unlike AS conflict, CASE WHEN lookup THEN CASE WHEN named THEN name_score ELSE 0 END ELSE extraction END AS identity, q = 0 OR (q <> 1 AND parse < CASE WHEN m = 0 THEN 0.7 ELSE 0.6 END) AS bad FROM d),
  f AS (SELECT *, CASE WHEN w = 12 THEN 'AMBIGUOUS_UNIT' WHEN conflict THEN 'PERSON_UNIT_CONFLICT' WHEN asked AND NOT person_ok THEN 'PERSON_AMBIGUOUS' WHEN NOT unit_ok THEN 'NOT_FOUND' WHEN u = 9 THEN 'ORGANIZATION_TYPE_UNKNOWN' WHEN bad THEN 'DOCUMENT_PARSE_LOW_CONFIDENCE'
    WHEN identity < 0.75 THEN 'DOCUMENT_EXTRACTION_LOW_CONFIDENCE' WHEN NOT lookup AND relation < 0.7 THEN 'CURRENT_WORK_UNIT_UNCERTAIN' WHEN r = 0 THEN 'SUBJECT_GROUP_INSUFFICIENT' END AS upstream,
    CASE WHEN conflict THEN 0 ELSE least(identity, CASE WHEN unit_ok THEN 0.97 ELSE 0 END, CASE WHEN NOT lookup THEN relation END, CASE WHEN asked THEN CASE WHEN person_ok THEN 0.99 ELSE 0 END END) END AS confidence FROM e),
  g AS (SELECT *, upstream IS NULL AND day >= DATE '1994-01-01' AND r % 2 = 1 AND o_orderstatus = 'P' AS insufficient FROM f)
  SELECT case_id, CASE WHEN conflict THEN 'CONFLICT' WHEN asserted AND asked AND person_ok AND unit_ok THEN 'MATCHED' WHEN asserted AND asked THEN 'UNVERIFIED' ELSE 'NOT_APPLICABLE' END AS consistency, round(confidence, 4)::double AS decision_confidence,
    CASE WHEN upstream IS NULL AND NOT insufficient THEN 'COMPLETED' ELSE 'NEED_REVIEW' END AS workflow, CASE WHEN insufficient THEN 'POLICY_INSUFFICIENT_DATA' ELSE upstream END AS reason,
    CASE WHEN upstream IS NOT NULL THEN '' WHEN day < DATE '1994-01-01' THEN '2:NOT_APPLICABLE' ELSE concat('1:', CASE WHEN r % 2 = 0 THEN 'NOT_APPLICABLE' WHEN insufficient THEN 'INSUFFICIENT_DATA' ELSE 'ELIGIBLE' END, ',2:NOT_APPLICABLE') END AS policies FROM g""")
def b12_case_decision(t):
    """Orders as cases: consistency of person and unit, the least confidence, the review gate, its reason, and policies where nothing else decides."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    part = lambda base, of, n, by: F.round(base + (of % n) / by, 2)
    named = k % 5 != 4
    rows = t.orders.select(
        k.alias("case_id"), F.col("o_orderdate").cast("date").alias("day"), F.when(named, "A B").alias("subject_name"), F.lit("").alias("subject_code"), F.when((k % 7).isin(0, 1, 2), "Cục").alias("unit_name"), F.when(k % 11 == 5, "U1").alias("unit_code"),
        F.when(named, part(0.7, k, 31, 100.0)).alias("name_score"), F.lit(None).cast("double").alias("code_score"), part(0.65, k, 29, 100.0).alias("extraction"), part(0.6, c, 41, 100.0).alias("relation"),
        F.when(k % 19 != 1, part(0.55, k, 23, 50.0)).alias("parse_confidence"), F.when(c % 3 == 0, "OCR").otherwise("TEXT").alias("parse_method"), F.when(k % 19 == 0, "fail").otherwise("PASS").alias("parse_gate"),
        F.when(c % 9 == 0, "AMBIGUOUS").otherwise("MATCHED").alias("person_status"), ((c % 9) % 4).alias("person_unit"), F.when(c % 9 != 0, 0.99).alias("person_confidence"),
        F.when(c % 10 == 0, "NOT_FOUND").otherwise("MATCHED").alias("unit_status"), ((c % 10) % 4).alias("unit_id"), F.when(c % 10 != 0, 0.97).alias("unit_confidence"), F.when(c % 10 == 9, "UNKNOWN").otherwise("BCA").alias("organization"),
        F.when(k % 17 != 0, F.when((k % 17) % 2 == 1, "CAND").otherwise("QUAN_NHAN")).alias("subject_group"), F.create_map(F.lit("rank"), F.when(F.col("o_orderstatus") != "P", "x")).alias("facts"),
        F.when(k % 13 == 12, F.array(F.lit("AMBIGUOUS_UNIT"), F.lit("OTHER"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )
    rules = t.spark.createDataFrame([(1, ["CAND"], ["rank"], "1994-01-01", True), (2, [], [], None, True), (3, ["*"], ["none"], None, False)], "rule_id int, groups array<string>, required array<string>, f string, active boolean")
    rules = rules.select("rule_id", "groups", "required", F.col("f").cast("date").alias("effective_from"), F.lit(None).cast("date").alias("effective_to"), "active")
    got = decide.decide_cases(rows, rules)
    shown = F.array_join(F.transform("policies", lambda x: F.concat_ws(":", x["rule_id"].cast("string"), x["status"])), ",")
    return got.select("case_id", "consistency", F.round("decision_confidence", 4).alias("decision_confidence"), "workflow", "reason", shown.alias("policies"))
