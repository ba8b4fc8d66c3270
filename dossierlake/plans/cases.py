"""Queries on cases, uploads, logs, versions and reviews."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dossierlake.functions import records as R
from dossierlake.functions import text as T
from dossierlake.operators import decide, registry
from dossierlake.plans.base import query, same_sql

_CASES = """SELECT o_orderkey AS case_id, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END AS workflow,
  CASE o_custkey % 5 WHEN 0 THEN 'MATCHED' WHEN 1 THEN 'AMBIGUOUS' WHEN 2 THEN 'NOT_FOUND' WHEN 3 THEN 'MATCHED' END AS resolution, CASE WHEN o_custkey % 5 = 3 THEN 'OTHER' WHEN o_custkey % 5 = 0 THEN 'BCA' END AS org FROM orders"""


@query(f"""SELECT case_id, CASE WHEN workflow = 'FAILED' THEN 'Không xử lý được' WHEN resolution = 'MATCHED' AND org IN ('BCA', 'BQP') THEN 'Đã xác định' WHEN resolution = 'MATCHED' AND org = 'OTHER' THEN 'Ngoài phạm vi CA/BQP'
  WHEN workflow = 'NEED_REVIEW' OR resolution IN ('AMBIGUOUS', 'CONFLICT') THEN 'Chưa có kết luận' WHEN workflow <> 'COMPLETED' THEN 'Đang xử lý' ELSE 'Chưa có kết luận' END AS shown FROM ({_CASES})""")
def p13_display_status(t):
    k = F.col("o_custkey") % 5
    workflow = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("FAILED")
    resolution = F.when(k.isin(0, 3), "MATCHED").when(k == 1, "AMBIGUOUS").when(k == 2, "NOT_FOUND")
    category = decide.status_category(workflow, resolution, F.when(k == 3, "OTHER").when(k == 0, "BCA"))
    return t.orders.select(F.col("o_orderkey").alias("case_id"), R.display_status(category, workflow).alias("shown"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'CASE' || lpad(o_orderkey::varchar, 4, '0') ELSE 'case_x' || o_orderkey END AS fragment FROM orders""")
def p14_search_fragment(t):
    shown = F.concat(F.lit(" #hs-"), F.year("o_orderdate").cast("string"), F.lit("-CASE"), F.lpad(F.col("o_orderkey").cast("string"), 4, "0"), F.lit(" "))
    typed = F.when(F.col("o_orderkey") % 2 == 0, F.when(F.length(F.col("o_orderkey").cast("string")) <= 4, shown).otherwise(F.concat(F.lit("HS-1999-CASE"), F.substring(F.col("o_orderkey").cast("string"), 1, 4)))).otherwise(F.concat(F.lit(" case_x"), F.col("o_orderkey").cast("string")))
    return t.orders.select("o_orderkey", R.search_fragment(typed).alias("fragment"))


same_sql(
    "p18_business_date",
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) >= DATE '1945-09-02' AND CAST(o_orderdate AS DATE) <= DATE '1997-01-01' AS fine FROM {orders}",
)


@query("SELECT page_id, h IN ('example.org', 'example.net') OR suffix(h, '.example.org') OR suffix(h, '.example.net') AS allowed FROM (SELECT page_id, regexp_extract(lower(url), '^https?://([^/:?#]+)', 1) AS h FROM pages)")
def p19_host_allowed(t):
    return t.pages.select("page_id", R.host_allowed(F.col("url"), ["example.org", "example.net"]).alias("allowed"))


@query("""SELECT doc_id, ['pdf', 'png', 'jpeg', 'zip', 'xls', 'text', 'unknown', 'docx'][(doc_id % 8)::int + 1] AS kind, CASE WHEN doc_id % 8 = 5 THEN NULL WHEN doc_id % 3 = 0 THEN 'UNSUPPORTED_EXTENSION' ELSE 'SIGNATURE_MISMATCH' END AS error FROM documents""")
def p21_upload_kind(t):
    heads = F.array(*[F.unhex(F.lit(h)) for h in ("255044462D", "89504E470D0A1A0A", "FFD8FFE0", "504B0304", "D0CF11E0A1B11AE1", "", "00", "504B0304" + b"word/document.xml".hex())])
    k = (F.col("doc_id") % 8 + 1).cast("int")
    plain = F.encode(F.when(k == 6, F.regexp_replace("text", "[^ -~]", "")).otherwise(F.substring("lang", 1, 1)), "UTF-8")
    files = t.documents.select("doc_id", F.concat(F.element_at(heads, k), plain).alias("content"), F.when((F.col("doc_id") % 3 == 0) & (k != 6), "a.exe").otherwise("b.txt").alias("name"))
    return files.select("doc_id", R.file_kind(F.col("content")).alias("kind"), R.upload_error(F.col("name"), F.col("content")).alias("error"))


@query("SELECT event_id, '***' AS token, user_id::varchar AS user_id, '***' AS deep, 'x' AS plain FROM events")
def p22_redaction(t):
    log = F.struct(F.col("event_type").alias("Token"), F.col("user_id").cast("string").alias("user"), F.array(F.create_map(F.lit("PASSWORD"), F.col("props"), F.lit("k"), F.lit("x"))).alias("deep"))
    rows = t.events.select("event_id", log.alias("log"))
    rows = rows.select("event_id", R.redacted(F.col("log"), rows.schema["log"].dataType).alias("log"))
    return rows.select("event_id", F.col("log.Token").alias("token"), F.col("log.user").alias("user_id"), F.col("log.deep")[0]["PASSWORD"].alias("deep"), F.col("log.deep")[0]["k"].alias("plain"))


@query("SELECT o_orderkey AS version FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def p4_latest_published(t):
    versions = t.orders.select(F.col("o_orderkey").alias("version"), F.when(F.col("o_orderstatus") == "F", "PUBLISHED").otherwise("DRAFT").alias("status"), F.col("o_orderdate").alias("published_at"))
    return registry.latest_published(versions).select("version")


@query("""SELECT u, o_orderkey FROM orders CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS u) WHERE u = 0 OR (u = 1 AND o_custkey % 25 IN (3, 7) AND (o_custkey % 4 = 0 OR o_orderkey % 7 = 1)) OR u = 2""")
def p5_scope_rules(t):
    """What an administrator, a member of two groups, a viewer of all without groups and one without either may see."""
    rows = t.orders.select("o_orderkey", (F.col("o_custkey") % 25).alias("coverage_group"), F.when(F.col("o_custkey") % 4 == 0, None).otherwise(F.col("o_orderkey") % 7).alias("assigned_to"))
    users = [(0, True, [], False), (1, False, [3, 7], False), (2, False, [], True), (3, False, [], False)]
    out = None
    for me, admin, groups, view_all in users:
        part = rows.filter(decide.in_scope(me, admin, groups, view_all)).select(F.lit(me).alias("u"), "o_orderkey")
        out = part if out is None else out.unionByName(part)
    return out


@query("""WITH c AS (SELECT event_id AS case_id, user_id AS owner, event_type AS document, (event_id % 4)::int AS block FROM events), q AS (SELECT owner, max(case_id) AS case_id FROM c GROUP BY owner)
  SELECT x.case_id, y.case_id AS sibling, y.block FROM q JOIN c x USING (case_id) JOIN c y ON x.owner = y.owner AND x.document = y.document AND x.case_id <> y.case_id""")
def j16_siblings(t):
    """The other cases of the document that each owner's latest case was split from."""
    cases = t.events.select(F.col("event_id").alias("case_id"), F.col("user_id").alias("owner"), F.concat("event_type", F.lit(":"), (F.col("event_id") % 4).cast("string")).alias("key"))
    latest = cases.groupBy("owner").agg(F.max("case_id").alias("case_id")).select("case_id")
    return decide.siblings(cases.join(latest, "case_id"), cases)


@query("SELECT event_id, user_id, (event_id % 4)::int AS block FROM events ORDER BY block, event_id LIMIT 50")
def o6_block_order(t):
    return t.events.select("event_id", "user_id", (F.col("event_id") % 4).cast("int").alias("block")).orderBy("block", "event_id").limit(50)


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem)
  SELECT l_orderkey, CASE WHEN count(DISTINCT g) = 1 THEN min(g) ELSE 'UNASSIGNED' END AS scope FROM r WHERE n <= 5 GROUP BY 1""")
def a22_review_scope(t):
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    rows = t.lineitem.select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("g"), n.alias("n"))
    return rows.groupBy("l_orderkey").agg(F.array_agg(F.when(F.col("n") <= decide.SCOPE_CANDIDATES, F.col("g"))).alias("gs")).select("l_orderkey", decide.review_scope(F.col("gs")).alias("scope"))


@query("SELECT l_orderkey, l_linenumber, round_even(l_quantity * 0.125::double, 2) AS score FROM lineitem")
def f27_half_even(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.bround(F.col("l_quantity") * 0.125, 2).alias("score"))


_VERSIONS = """WITH v AS (SELECT o_orderkey AS version, CASE o_orderkey % 4 WHEN 0 THEN 'DRAFT' WHEN 1 THEN 'VALIDATED' WHEN 2 THEN 'APPROVED' ELSE 'PUBLISHED' END AS status, ['validate', 'approve', 'publish'][(o_custkey % 3)::int + 1] AS step, o_custkey % 7 = 0 AS bad FROM orders),
  w AS (SELECT *, CASE WHEN (step = 'validate' AND status <> 'DRAFT') OR (step = 'approve' AND status <> 'VALIDATED') OR (step = 'publish' AND status <> 'APPROVED') THEN 'WRONG_STATUS' WHEN step = 'validate' AND bad THEN 'INVALID_SNAPSHOT' END AS error FROM v),
  x AS (SELECT *, CASE WHEN error IS NULL THEN CASE step WHEN 'validate' THEN 'VALIDATED' WHEN 'approve' THEN 'APPROVED' ELSE 'PUBLISHED' END ELSE status END AS now FROM w)"""


@query(_VERSIONS + " SELECT version, error, CASE WHEN now = 'PUBLISHED' AND version <> (SELECT max(version) FROM x WHERE now = 'PUBLISHED' AND error IS NULL) THEN 'DEPRECATED' ELSE now END AS status FROM x")
def b26_registry_life(t):
    k = F.col("o_orderkey") % 4
    versions = t.orders.select(F.col("o_orderkey").alias("version"), F.when(k == 0, "DRAFT").when(k == 1, "VALIDATED").when(k == 2, "APPROVED").otherwise("PUBLISHED").alias("status"), F.col("o_orderdate").alias("published_at"))
    asked = t.orders.select(F.col("o_orderkey").alias("version"), F.element_at(F.array(*map(F.lit, ("validate", "approve", "publish"))), (F.col("o_custkey") % 3 + 1).cast("int")).alias("step"))
    errors = t.orders.filter("o_custkey % 7 = 0").select(F.col("o_orderkey").alias("version"), F.lit("x").alias("error"))
    return registry.advance(versions, asked, errors, F.lit("2026-01-01").cast("timestamp_ntz")).select("version", "status", "error")


_SNAP = "SELECT p_size::varchar AS version, p_partkey AS unit_id, p_brand AS org, p_name AS key, CASE WHEN p_partkey % 11 <> 0 THEN 's' ELSE '' END AS source_id, CASE WHEN p_partkey % 13 <> 0 THEN 'APPROVED' ELSE 'PENDING_QA' END AS qa FROM part"


@query(f"""WITH s AS ({_SNAP}) SELECT version, 'duplicate_normalized_unit:' || org || ':' || key AS error FROM s GROUP BY version, org, key HAVING count(DISTINCT unit_id) > 1
  UNION ALL SELECT version, 'unit_not_approved:' || unit_id FROM s WHERE qa <> 'APPROVED' UNION ALL SELECT version, 'unit_missing_source:' || unit_id FROM s WHERE source_id = ''""")
def b26_snapshot_errors(t):
    return registry.snapshot_errors(_snapshot(t), t.part.select(F.col("p_partkey").alias("unit_id"), F.when(F.col("p_partkey") % 13 != 0, "APPROVED").otherwise("PENDING_QA").alias("qa_status")))


def _snapshot(t):
    return t.part.select(
        F.col("p_size").cast("string").alias("version"), F.col("p_partkey").alias("unit_id"), F.col("p_brand").alias("org"), F.col("p_name").alias("key"), F.when(F.col("p_partkey") % 11 != 0, "s").otherwise("").alias("source_id"),
        F.lit(None).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.upper("p_name").alias("ascii_key"),
    )


@query(f"WITH s AS ({_SNAP}) SELECT version, unit_id, key, upper(key) AS folded FROM s UNION ALL SELECT 'draft', unit_id, key, NULL FROM s WHERE version = '7'")
def b27_snapshot_copy(t):
    snap = _snapshot(t)
    return snap.unionByName(registry.copy_snapshot(snap, "7", "draft"), allowMissingColumns=True).select("version", "unit_id", "key", F.col("ascii_key").alias("folded"))


_REVIEWS = """WITH r AS (SELECT o_orderkey AS review_id, (o_custkey % 3)::int AS version, CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'P' THEN 'OPEN' ELSE 'RESOLVED' END AS status FROM orders),
  d AS (SELECT o_orderkey AS review_id, 1 AS expected, ['CONFIRM', 'UNKNOWN', 'INSUFFICIENT', 'DISMISS', 'SING'][(o_custkey % 5)::int + 1] AS decision FROM orders WHERE o_orderkey % 2 = 0)"""


@query(_REVIEWS + """ SELECT review_id, CASE WHEN decision IS NULL THEN NULL WHEN decision = 'SING' THEN 'UNKNOWN_DECISION' WHEN status <> 'OPEN' THEN 'NOT_OPEN' WHEN version <> expected THEN 'STALE_VERSION' END AS error,
  CASE WHEN decision IN ('CONFIRM', 'UNKNOWN', 'INSUFFICIENT') AND status = 'OPEN' AND version = expected THEN 'RESOLVED' WHEN decision = 'DISMISS' AND status = 'OPEN' AND version = expected THEN 'DISMISSED' ELSE status END AS status,
  (version + (decision IS NOT NULL AND decision <> 'SING' AND status = 'OPEN' AND version = expected)::int)::int AS version_no FROM r LEFT JOIN d USING (review_id)""")
def t12_review_decisions(t):
    k = F.col("o_custkey")
    reviews = t.orders.select(F.col("o_orderkey").alias("review_id"), (k % 3).cast("int").alias("version_no"), F.when(F.col("o_orderstatus").isin("O", "P"), "OPEN").otherwise("RESOLVED").alias("status"))
    asked = t.orders.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("review_id"), F.lit(1).alias("expected_version"), F.element_at(F.array(*map(F.lit, ("CONFIRM", "UNKNOWN", "INSUFFICIENT", "DISMISS", "SING"))), (k % 5 + 1).cast("int")).alias("decision"))
    return decide.apply_decisions(reviews, asked).select("review_id", "error", "status", "version_no")


@query("SELECT doc_id, p - 1 AS s, p + 3 AS e FROM (SELECT doc_id, instr(text, 'the ') AS p FROM documents) WHERE p > 0")
def j19_mention_spans(t):
    from dossierlake.operators import synthetic

    found = t.documents.select("doc_id", synthetic.span(F.col("text"), F.lit("the ")).alias("x")).filter("x is not null")
    return found.select("doc_id", F.col("x.start").cast("long").alias("s"), F.col("x.end").cast("long").alias("e"))


@query(r"SELECT event_id, '/api/cases/:id/' || event_type AS route FROM events")
def f29_route_key(t):
    path = F.concat(F.lit("/api/cases/"), F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise(F.concat(F.lit("case_"), F.lpad(F.col("event_id").cast("string"), 8, "a"))), F.lit("/"), F.col("event_type"))
    return t.events.select("event_id", T.route_key(path).alias("route"))
