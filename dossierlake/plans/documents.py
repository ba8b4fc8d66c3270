"""Document queries: pages, documents, benchmark passages and bulk rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from dossierlake.functions import text as T
from dossierlake.operators import documents as D
from dossierlake.operators import metrics, registry, robots
from dossierlake.plans.base import query

from dossierlake.sources.shared import shared_folder


@query("SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, regexp_replace(url, '#.*$', '') AS bare, lower(url) LIKE '%.pdf' AS pdf FROM pages")
def p19_url_host(t):
    return t.pages.select("page_id", F.coalesce(F.parse_url("url", F.lit("HOST")), F.lit("")).alias("host"), F.regexp_replace("url", "#.*$", "").alias("bare"), F.lower("url").endswith(".pdf").alias("pdf"))


@query("SELECT page_id, contains(lower(url), 'page') OR contains(lower(url), '7') OR contains(lower(html), 'cookie') OR contains(lower(html), 'the ') AS relevant FROM pages")
def p20_page_relevance(t):
    words = lambda c, ws: F.exists(F.array(*map(F.lit, ws)), lambda w: F.contains(F.lower(c), w))
    return t.pages.select("page_id", (words("url", ["page", "7"]) | words("html", ["cookie", "the "])).alias("relevant"))




_STOPS = "đã|đang|sẽ|và|cùng|tổ chức|chủ trì|tham dự|phối hợp|thực hiện|triển khai|cho biết|tại|theo|trong"


@query(f"""WITH c AS (SELECT doc_id AS page_id, text || ' The Bureau đã họp và bàn. The Office of Trade, tại Huế.' AS text FROM documents),
  f AS (SELECT page_id, 'EN' AS org, unnest(regexp_extract_all(text, 'The [A-Za-z]+ [^.\\n]+')) AS raw FROM c UNION ALL SELECT page_id, 'LIC', unnest(regexp_extract_all(text, '[Ll]icensed under [A-Za-z ]+')) FROM c),
  b AS (SELECT page_id, org, trim(regexp_replace(trim(regexp_replace(raw, '\\s+', ' ', 'g'), ' ,;:.–-()[]{{}}'), '(?i) ({_STOPS})($|[^\\p{{L}}\\p{{N}}_].*$)', '')) AS cut FROM f),
  n AS (SELECT page_id, org, trim(array_to_string(string_split(cut, ' ')[1:24], ' '), ' ,;:.-') AS name FROM b) SELECT page_id, org, name FROM n WHERE length(name) BETWEEN 5 AND 180""")
def b25_candidates(t):
    pages = t.documents.select(F.col("doc_id").alias("page_id"), F.concat("text", F.lit(" The Bureau đã họp và bàn. The Office of Trade, tại Huế.")).alias("text"))
    return registry.page_candidates(pages, [("EN", "The [A-Za-z]+ [^.\n]+"), ("LIC", "[Ll]icensed under [A-Za-z ]+")])


@query("""SELECT o_orderkey, sorted[greatest(ceil(0.1 * len(sorted)), 1)::int] AS p10, sorted[floor((len(sorted) - 1) * 0.1)::int + 1] AS p10_floor FROM (SELECT l_orderkey AS o_orderkey, list_sort(list(l_quantity)) AS sorted FROM lineitem GROUP BY l_orderkey)""")
def a12_percentiles(t):
    g = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_quantity").alias("q"))
    return g.select("o_orderkey", D.nearest_rank(F.col("q"), 0.1).alias("p10"), D.floor_rank(F.col("q"), 0.1).alias("p10_floor"))


@query("""WITH c AS (SELECT doc_id, unnest(string_split(lower(regexp_replace(text, '[^\\p{L}]', '', 'g')), '')) AS ch FROM documents), k AS (SELECT doc_id, ch, count(*) AS k FROM c WHERE ch <> '' GROUP BY doc_id, ch)
  SELECT doc_id, sum(k)::bigint AS letters, round(CASE WHEN sum(k) > 1 THEN sum(k * (k - 1))::double / (sum(k)::double * (sum(k)::double - 1)) * 26 END, 6) AS ioc, round(log2(sum(k)::double) - sum(k * log2(k::double)) / sum(k)::double, 6) AS entropy FROM k GROUP BY doc_id""")
def a23_letter_statistics(t):
    return D.text_quality(t.documents).select("doc_id", "letters", F.round("ioc", 6).alias("ioc"), F.round("entropy", 6).alias("entropy"))


@query("""SELECT doc_id, round(length(regexp_replace(text, '[\\p{L}\\p{N}\\s.,;:!?\\x27"()/%&+\\-]', '', 'g'))::double / length(text), 6) AS charset_violation FROM documents WHERE length(text) > 0""")
def f26_ratios(t):
    return t.documents.filter("length(text) > 0").select("doc_id", F.round(T.char_profile(F.col("text"))["charset_violation"], 6).alias("charset_violation"))




def _bulk(t):
    """Customers as rows of bulk lists: codes of digits, of too few, spaced, with letters, or none; days that are none or implausible."""
    k = F.col("c_custkey")
    number = F.lpad((k % 400).cast("string"), 9, "1")
    spaced = F.concat(F.substring(number, 1, 3), F.lit(" "), F.substring(number, 4, 3), F.lit("-"), F.substring(number, 7, 3))
    code = F.element_at(F.array(number, F.lit("12-3"), F.lit(""), F.concat(F.lit("AB-"), (k % 50).cast("string")), F.lit("12 3456"), spaced, F.lit("Mã cũ"), F.lit(None).cast("string")), (k % 8 + 1).cast("int"))
    day = F.element_at(F.array(*map(F.lit, ("2026-01-02", "2026-99-01", "1900-05-01", "2999-01-01", "", "1945-09-02"))), (k % 6 + 1).cast("int"))
    unit = F.element_at(F.array(*map(F.lit, ("Cục A", "Cục A | Cục B", "Cục A ; ", "x;y", ""))), (k % 5 + 1).cast("int"))
    confidence = F.element_at(F.array(F.lit("0.95"), F.lit("0.5"), F.lit("low"), F.lit(None).cast("string")), (k % 4 + 1).cast("int"))
    return t.customer.select((k % 20).alias("job_id"), k.alias("row_index"), F.when(k % 17 == 0, F.lit(" ")).otherwise(F.col("c_name")).alias("name"), code.alias("code"), day.alias("day"), unit.alias("unit"), confidence.alias("confidence"))


_BULK = """WITH b AS (SELECT c_custkey AS k, c_custkey % 20 AS job_id, c_custkey % 17 = 0 AS no_name, lpad((c_custkey % 400)::varchar, 9, '1') AS n FROM customer),
  c AS (SELECT *, [n, '12-3', '', 'AB-' || (k % 50), '12 3456', n[1:3] || ' ' || n[4:6] || '-' || n[7:9], 'Mã cũ', NULL][(k % 8)::int + 1] AS code,
    ['2026-01-02', '2026-99-01', '1900-05-01', '2999-01-01', '', '1945-09-02'][(k % 6)::int + 1] AS day FROM b),
  d AS (SELECT *, regexp_replace(code, '[^0-9]', '', 'g') AS digits, regexp_full_match(code, '[0-9 .-]+') AS numeric FROM c),
  e AS (SELECT *, numeric AND length(digits) NOT IN (9, 12) AS bad, coalesce(nullif(digits, ''), code) AS key, code <> '' AND NOT no_name AND NOT (numeric AND length(digits) NOT IN (9, 12)) AS usable FROM d),
  f AS (SELECT *, usable AND row_number() OVER (PARTITION BY job_id, key, usable ORDER BY k) > 1 AS again FROM e),
  v AS (SELECT job_id, k AS row_index, CASE WHEN no_name THEN 'MISSING_NAME' WHEN bad THEN 'BAD_FORMAT_CODE' WHEN again THEN 'DUPLICATE' WHEN k % 6 IN (1, 2, 3) THEN 'BAD_FORMAT_DATE' END AS error, k FROM f)"""


@query(_BULK + """ SELECT job_id, row_index, error, CASE WHEN error = 'DUPLICATE' THEN 'SKIPPED' WHEN error IS NOT NULL THEN 'FAILED' ELSE 'READY' END AS status,
  concat_ws(',', CASE WHEN k % 4 IN (1, 2) THEN 'LOW_TABLE_CONFIDENCE' END, CASE WHEN error IS NULL AND k % 5 IN (1, 3) THEN 'AMBIGUOUS_UNIT' END) AS warnings FROM v""")
def b19_validate(t):
    return D.validate_rows(_bulk(t)).select("job_id", "row_index", "error", "status", F.array_join("warnings", ",").alias("warnings"))


@query(_BULK + """ SELECT job_id, count(*)::bigint AS total, count(*) FILTER (error IS NULL)::bigint AS ok, count(*) FILTER (error <> 'DUPLICATE')::bigint AS failed, count(*) FILTER (error = 'DUPLICATE')::bigint AS skipped,
  CASE WHEN count(*) FILTER (error <> 'DUPLICATE') = count(*) THEN 'FAILED' WHEN count(*) FILTER (error <> 'DUPLICATE') > 0 THEN 'COMPLETED_WITH_ERRORS' ELSE 'COMPLETED' END AS job_status FROM v GROUP BY job_id""")
def b20_finalise(t):
    return D.finalise(D.validate_rows(_bulk(t)))


@query("SELECT conv_id, turn, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)::bigint AS block FROM conversations")
def w5_blocks(t):
    return D.blocks(t.conversations, F.col("role") == "user", ["conv_id"], "turn").select("conv_id", "turn", "block")



_BOXES = "SELECT l_orderkey AS page, l_linenumber AS id, l_quantity AS x0, l_discount * 100 AS y0, l_quantity + 8 AS x1, l_discount * 100 + 4 AS y1 FROM lineitem"


@query(f"""WITH b AS ({_BOXES}), j AS (SELECT a.page, a.id AS label_id, b.id AS value_id, CASE WHEN b.x0 >= a.x1 AND least(a.y1, b.y1) - greatest(a.y0, b.y0) > 0.5 * least(a.y1 - a.y0, b.y1 - b.y0) THEN 0 ELSE 1 END AS kind, a.x1, a.y1, b.x0, b.y0
  FROM b a JOIN b ON a.page = b.page AND a.id % 2 = 1 AND b.id % 2 = 0 AND ((b.x0 >= a.x1 AND least(a.y1, b.y1) - greatest(a.y0, b.y0) > 0.5 * least(a.y1 - a.y0, b.y1 - b.y0)) OR (b.y0 >= a.y1 AND abs(b.x0 - a.x0) <= 0.5 * (a.x1 - a.x0)))),
  r AS (SELECT *, row_number() OVER (PARTITION BY page, label_id ORDER BY kind, CASE WHEN kind = 0 THEN x0 - x1 ELSE y0 - y1 END, value_id) AS n FROM j) SELECT page, label_id, value_id, kind::int AS kind FROM r WHERE n = 1""")
def j15_spatial(t):
    b = t.lineitem.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("id"), F.col("l_quantity").alias("x0"), (F.col("l_discount") * 100).alias("y0"), (F.col("l_quantity") + 8).alias("x1"), (F.col("l_discount") * 100 + 4).alias("y1"))
    return D.spatial_values(b.filter("id % 2 = 1"), b.filter("id % 2 = 0")).select("page", "label_id", "value_id", "kind")


_PRED = "SELECT doc_id, quality AS y, (contains(text, '$$$') OR contains(text, ' | '))::int AS flagged, length(text) % 97 / 97.0::double AS p FROM labels JOIN documents USING (doc_id)"


@query(f"SELECT 1 AS one, round(count(*) FILTER (flagged = 0 AND y = 1)::double / count(*) FILTER (flagged = 0), 6) AS precision, round(count(*) FILTER (flagged = 0 AND y = 1)::double / count(*) FILTER (y = 1), 6) AS recall, round(avg((p - y) * (p - y)), 6) AS brier FROM ({_PRED})")
def a15_scores(t):
    j = _predictions(t)
    hit = F.count_if((F.col("flagged") == 0) & (F.col("y") == 1))
    return j.agg(F.lit(1).alias("one"), F.round(hit / F.count_if(F.col("flagged") == 0), 6).alias("precision"), F.round(hit / F.count_if(F.col("y") == 1), 6).alias("recall"), F.round(F.avg((F.col("p") - F.col("y")) ** 2), 6).alias("brier"))


def _predictions(t):
    flagged = F.contains("text", F.lit("$$$")) | F.contains("text", F.lit(" | "))
    return t.labels.join(t.documents, "doc_id").select("doc_id", F.col("quality").alias("y"), flagged.cast("int").alias("flagged"), ((F.length("text") % 97) / 97.0).alias("p"))


@query(f"""WITH x AS ({_PRED}), c AS (SELECT p, count(*) AS n, sum(y) AS pos FROM x GROUP BY p), r AS (SELECT p, n, pos, sum(n) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING) - n + (n + 1) / 2.0::double AS rnk FROM c)
  SELECT 1 AS one, round((sum(rnk * pos) - sum(pos)::double * (sum(pos) + 1) / 2) / (sum(pos)::double * (sum(n) - sum(pos))), 6) AS auc FROM r""")
def a18_auc(t):
    rows = _predictions(t).select(F.col("p").alias("score"), F.col("y").alias("label"))
    return metrics.auc(rows).select(F.lit(1).alias("one"), F.round("auc", 6).alias("auc"))


@query("SELECT source, count(*)::bigint AS n, round(avg(CASE WHEN n_chars >= 500 THEN 1.0 ELSE 0 END), 6) AS pass_rate FROM documents GROUP BY source")
def a17_pass_rate(t):
    return t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("n_chars") >= 500).cast("int")), 6).alias("pass_rate"))


_TITLE = "trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&'), '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, {_TITLE} AS title, list_count(list_distinct(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)))::int AS links, regexp_extract(url, '^(https?://[^/]+)', 1) || regexp_extract(html, '<a href=\"([^\"]*)\"', 1) AS first_link FROM pages")
def s9_html_page(t):
    """Title, number of links and first link of every page; the text is compared in tests."""
    links = D.html_links(F.col("html"), F.col("url"))
    rows = t.pages.select("page_id", D.html_title(F.col("html")).alias("title"), D.html_text(F.col("html")).alias("text"), links.alias("links"))
    return rows.select("page_id", "title", F.size("links").alias("links"), F.get("links", 0).alias("first_link"))


@query("""SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) || '/' || lower(h) || '.xml' AS url FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="/([A-Za-z]+)"', 1)) AS h FROM pages)""")
def s11_sitemap(t):
    """Sitemaps made of the pages' own links, and the addresses that they list."""
    origin = F.regexp_extract("url", "^(https?://[^/]+)", 1)
    entry = F.transform(F.regexp_extract_all("html", F.lit('<a href="/([A-Za-z]+)"'), F.lit(1)), lambda h: F.concat(F.lit("<url><LOC> "), origin, F.lit("/"), F.lower(h), F.lit(".xml\n</loc></url>")))
    maps = t.pages.select("page_id", F.concat(F.lit("<urlset>"), F.array_join(entry, ""), F.lit("</urlset>")).alias("content"))
    return maps.select("page_id", F.explode(D.sitemap_urls(F.col("content"))).alias("url"))


#: robots files: the page's own host, and another whose rules are not asked for
_ROBOTS = "# rules\nUser-agent: other\nDisallow: /\n\nUser-agent: *\nUser-Agent: reader\nDisallow: /th\nAllow: /the\nDisallow: /*a$\nDisallow:\nAllow: /la\n"
_ADDRESSES = """w AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<a href="/([^"]+)"', 1))) AS h FROM pages),
  p AS (SELECT lower(h) AS h, min(page_id) AS page_id, min(page_id) % 7 <> 3 AS relevant FROM w GROUP BY 1)"""
_REFUSED = "NOT starts_with(h, 'the') AND (regexp_matches(h, '^[^#]*a(#|$)') OR starts_with(h, 'th'))"  # of two as long, the one that allows


def _addressed(t):
    """Addresses, each the page of least page_id that links to it, and that page's links."""
    words = F.regexp_extract_all("html", F.lit('<a href="/([^"]+)"'), F.lit(1))
    own = t.pages.select("page_id", F.explode(words).alias("h")).select("page_id", F.concat(F.lit("http://a.example.org/"), F.lower("h")).alias("target")).distinct()
    pages = own.groupBy(F.col("target").alias("url")).agg(F.min("page_id").alias("page_id")).withColumn("relevant", F.col("page_id") % 7 != 3)
    return pages, pages.select("url", "page_id").join(own, "page_id").select("url", "target")


@query(f"WITH {_ADDRESSES} SELECT 'http://a.example.org/' || h AS url, NOT ({_REFUSED}) AS allowed FROM (SELECT DISTINCT lower(h) AS h FROM w)")
def s10_robots(t):
    """Which of the addresses that pages link to the rules of their host let a reader read."""
    rules = robots.parse_rules(t.spark.createDataFrame([("http://a.example.org", _ROBOTS), ("http://b.example.org", "User-agent: *\nDisallow: /")], "origin string, content string"))
    return robots.may_read(_addressed(t)[0], rules, "Reader/1.0")


@query(f"""WITH RECURSIVE {_ADDRESSES}, q AS (SELECT * FROM p WHERE NOT ({_REFUSED})), l AS (SELECT DISTINCT q.h AS src, lower(w.h) AS dst FROM q JOIN w USING (page_id)),
  r(h, depth) AS (SELECT h, 0 FROM q WHERE page_id < 5 UNION SELECT d.h, depth + 1 FROM r JOIN q s ON s.h = r.h JOIN l ON src = r.h JOIN q d ON d.h = dst WHERE depth < 3 AND (s.relevant OR depth <= 1))
  SELECT 'http://a.example.org/' || h AS url, min(depth)::int AS depth FROM r GROUP BY h""")
def s10_crawl(t):
    """A crawl over the pages' own links, three deep, under the robots rules of their host."""
    pages, links = _addressed(t)
    rules = robots.parse_rules(t.spark.createDataFrame([("http://a.example.org", _ROBOTS)], "origin string, content string"))
    folder = f"{shared_folder(t.spark)}/crawl-{uuid.uuid4().hex}"
    return D.crawl(pages.select("url", "relevant"), links, pages.filter("page_id < 5").select("url"), ["example.org"], folder, depth=3, rules=rules, agent="Reader/1.0")


_ENTROPY = """h AS (SELECT doc_id, log2(sum(k)) - sum(k * log2(k)) / sum(k) AS e FROM (SELECT doc_id, ch, count(*)::double AS k FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents WHERE text <> '') GROUP BY 1, 2) GROUP BY 1)"""


@query(f"""WITH {_ENTROPY}, c AS (SELECT doc_id, coalesce(e, 0) AS e, length(trim(text, ' ' || chr(10) || chr(9) || chr(13))) AS chars, (doc_id % 10)::int AS m FROM documents LEFT JOIN h USING (doc_id)),
  s AS (SELECT doc_id, chars, m, ((chars < 50)::int + CASE WHEN m > 7 THEN 2 ELSE 0 END + (m % 3 = 0)::int + CASE WHEN chars >= 50 AND e < 3.5 THEN 2 ELSE 0 END)::int AS score FROM c)
  SELECT doc_id, score, CASE WHEN score >= 2 OR (chars < 50 AND m <= 7 AND m % 3 = 0) THEN 'OCR' ELSE 'TEXT' END AS route FROM s""")
def b15_page_route(t):
    m = F.col("doc_id") % 10
    pages = t.documents.select("doc_id", F.lit(1).alias("page"), "text", F.when(m > 7, 0.9).otherwise(0.05).alias("coverage"), F.when(m % 3 == 0, 0).otherwise(2).alias("fonts"))
    return D.route_pages(pages).select("doc_id", "score", "route")


@query("SELECT l_orderkey AS doc_id, CASE WHEN bool_and(l_linenumber % 2 = 1) THEN 'PDF_TEXT' WHEN bool_and(l_linenumber % 2 = 0) THEN 'PDF_SCAN' ELSE 'PDF_HYBRID' END AS kind FROM lineitem GROUP BY 1")
def b15_document_kind(t):
    text = F.when(F.col("l_linenumber") % 2 == 1, F.repeat(F.lit("các chữ khác nhau abcdefghijk "), 4)).otherwise(F.lit(""))
    pages = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), text.alias("text"), F.lit(0.5).alias("coverage"), F.when(F.col("l_linenumber") % 2 == 1, 1).otherwise(0).alias("fonts"))
    return D.document_kinds(D.route_pages(pages))


@query("""SELECT l_orderkey AS sheet, CASE WHEN l_orderkey % 4 = 0 OR l_orderkey % 4 = 1 OR count(*) < 2 THEN 'KEY_VALUE_SHEET' ELSE 'TABULAR_LIST' END AS kind, CASE WHEN l_orderkey % 4 <> 0 THEN 0 END::int AS header, CASE WHEN l_orderkey % 4 = 0 THEN 2 ELSE 4 END::int AS columns FROM lineitem GROUP BY l_orderkey""")
def b16_profile(t):
    """Orders as sheets of their lines: two columns, rows that begin with a label, or lists."""
    k = F.col("l_orderkey") % 4
    label = F.when(k == 1, F.lit("nhãn:")).otherwise(F.lit("x"))
    row = lambda r, vs: [F.struct(r.alias("row"), F.lit(c).alias("col"), v.alias("value"), F.lit(is_text).alias("is_text")) for c, (v, is_text) in enumerate(vs)]
    number = lambda c: (F.col(c).cast("string"), False)
    lines = t.lineitem.withColumn("r", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    cells = F.array(*row(F.col("r"), [(label, True), number("l_quantity"), number("l_tax"), number("l_discount")]))
    rows = lines.select(F.col("l_orderkey").alias("sheet"), F.explode(F.filter(cells, lambda c: (k != 0) | (c["col"] < 2))).alias("c"))
    heads = t.lineitem.select(F.col("l_orderkey").alias("sheet")).distinct()
    head = F.array(*row(F.lit(0), [(F.lit(w), True) for w in ("a", "b", "c", "d")]))
    heads = heads.select("sheet", F.explode(F.filter(head, lambda c: (F.col("sheet") % 4 != 0) | (c["col"] < 2))).alias("c"))
    return D.profile_sheets(rows.unionByName(heads).select("sheet", "c.*")).select("sheet", "kind", "header", "columns")


@query("""SELECT c_custkey AS doc_id, 0::bigint AS block, CASE WHEN c_custkey % 4 IN (1, 3) THEN false WHEN c_custkey % 4 = 2 THEN true ELSE c_custkey % 8 = 0 END AS ambiguous, CASE WHEN c_custkey % 4 = 2 THEN 'MULTIPLE_SUBJECTS_OCR_UNSUPPORTED' WHEN c_custkey % 8 = 0 THEN 'MULTIPLE_SUBJECTS_AMBIGUOUS_BOUNDARY' END AS reason FROM customer
  UNION ALL SELECT c_custkey, 1, false, NULL FROM customer WHERE c_custkey % 4 = 0""")
def b24_split(t):
    k = F.col("c_custkey")
    one = F.concat(F.lit("Họ và tên: "), F.col("c_name"), F.when(k % 8 == 0, F.lit("\n\n")).otherwise(F.lit("\nNăm sinh: 1990\n")))
    text = F.when(k % 4 == 1, F.lit("nothing here\nat all")).when(k % 4 == 3, F.concat(F.lit("title\nHọ và tên: "), F.col("c_name"))).otherwise(F.concat(F.lit("Danh sách\n"), one, F.lit("Ho ten: B\nChức vụ: x")))
    docs = t.customer.select(k.alias("doc_id"), text.alias("text"), F.when(k % 4 == 2, "OCR").otherwise("TEXT").alias("method"))
    return D.split_subjects(docs).select("doc_id", "block", "ambiguous", "reason")
