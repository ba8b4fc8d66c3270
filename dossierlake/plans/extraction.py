"""Queries of extraction, bulk lists, synthetic dossiers and their scores; customers, parts and documents stand in."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossierlake.functions import text as T
from dossierlake.operators import bulk, extract, metrics, synthetic
from dossierlake.plans.base import query


def _dossiers(t):
    """A dossier of every customer: labelled lines, a list in one line, a narrative, or a bare name."""
    k = F.col("c_custkey")
    year = (1950 + k % 50).cast("string")
    unit = F.concat(F.lit("Cục "), F.lower("c_mktsegment"), F.lit(" "), F.col("c_nationkey").cast("string"))
    name = F.concat(F.lit("Nguyễn Văn "), F.element_at(F.array(*map(F.lit, ("An", "Bình", "Chi", "Dũng", "Hà"))), (k % 5 + 1).cast("int")))
    text = (
        F.when(k % 4 == 0, F.concat(F.lit("Họ và tên: "), name, F.lit("\nNăm sinh: 01/02/"), year, F.lit("\nĐơn vị công tác: "), unit, F.lit("\nGhi: x")))
        .when(k % 4 == 1, F.concat(F.lit("Họ và tên: "), name, F.lit(", Năm sinh: "), year, F.lit(", Chức vụ: Đội trưởng")))
        .when(k % 4 == 2, F.concat(F.lit("Đồng chí "), name, F.lit(" từng công tác tại Cục cũ "), F.col("c_nationkey").cast("string"), F.lit(". Hiện công tác tại "), unit, F.lit("; mã: AB-"), k.cast("string")))
        .otherwise(name)
    )
    return t.customer.select(k.alias("doc_id"), text.alias("text"))


_DOSSIERS = """d AS (SELECT c_custkey AS doc_id, c_custkey % 4 AS k, 'Nguyễn Văn ' || ['An', 'Bình', 'Chi', 'Dũng', 'Hà'][(c_custkey % 5)::int + 1] AS name, (1950 + c_custkey % 50)::varchar AS year, 'Cục ' || lower(c_mktsegment) || ' ' || c_nationkey AS unit, c_nationkey AS n FROM customer)"""


@query(f"""WITH {_DOSSIERS} SELECT doc_id, 'subject_name' AS field, name AS value FROM d WHERE k < 2 UNION ALL SELECT doc_id, 'birth_year', CASE k WHEN 0 THEN '01/02/' ELSE '' END || year FROM d WHERE k < 2
  UNION ALL SELECT doc_id, 'unit_name', unit FROM d WHERE k = 0 UNION ALL SELECT doc_id, 'position', 'Đội trưởng' FROM d WHERE k = 1""")
def b22_labels(t):
    return extract.label_values(_dossiers(t)).select("doc_id", "field", "value")


def _cells(t):
    """A table of every customer: a label with its value to the right, one with its value below, one with both in a cell."""
    k = F.col("c_custkey")
    cell = lambda r, c, v: F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), v.alias("content"))
    cells = F.array(
        cell(0, 0, F.lit("Họ tên")), cell(0, 1, F.when(k % 2 == 0, F.lit("")).otherwise(F.col("c_name"))), cell(0, 2, F.when(k % 2 == 0, F.col("c_name"))),
        cell(1, 0, F.lit("CCCD")), cell(1, 1, F.lit("Chức vụ")), cell(2, 0, F.lpad(k.cast("string"), 9, "1")), cell(2, 1, F.when(k % 3 == 0, F.lit("Phó"))), cell(3, 0, F.lit("Năm sinh: 1990")),
    )
    return t.customer.select(k.alias("doc_id"), F.lit(0).alias("table"), F.explode(cells).alias("c")).select("doc_id", "table", "c.*")


@query("""SELECT c_custkey AS doc_id, 'subject_name' AS field, c_name AS value, 'table_right_cell' AS rule FROM customer UNION ALL SELECT c_custkey, 'subject_code', lpad(c_custkey::varchar, 9, '1'), 'table_below_cell' FROM customer
  UNION ALL SELECT c_custkey, 'position', 'Phó', 'table_below_cell' FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'birth_year', '1990', 'table_inline_cell' FROM customer""")
def b23_table_values(t):
    return extract.table_values(_cells(t)).select("doc_id", "field", "value", "rule")


@query(f"""WITH {_DOSSIERS} SELECT doc_id, name AS subject_name, CASE WHEN k = 2 THEN 'AB-' || doc_id END AS subject_code, CASE WHEN k = 1 THEN 'Đội trưởng' END AS position, CASE WHEN k IN (0, 2) THEN unit END AS unit_name,
  CASE WHEN k < 2 THEN year END AS birth_year, CASE WHEN k = 2 THEN 'Cục cũ ' || n ELSE '' END AS former, [0.736, 0.736, 0.738, 0.686][k::int + 1]::double AS confidence, CASE k WHEN 0 THEN 0.92 WHEN 2 THEN 0.9 ELSE 0.0 END::double AS relation FROM d""")
def b21_extract(t):
    none = t.spark.createDataFrame([], "doc_id long, field string, value string")
    cells = t.spark.createDataFrame([], "doc_id long, table int, row int, col int, content string")
    got = extract.extract(_dossiers(t), none, cells)
    return got.select("doc_id", "subject_name", "subject_code", "position", "unit_name", "birth_year", F.array_join("former_units", "|").alias("former"), F.col("extraction_confidence").alias("confidence"), F.col("relation_confidence").alias("relation"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN n = 0 THEN 0.0 ELSE round_even(least(0.99, s / n * (0.6 + 0.4 * n / 4)), 4) END AS confidence FROM (SELECT l_orderkey, l_linenumber, (l_quantity > 10)::int + (l_tax > 0.02)::int + (l_discount > 0.05)::int + (l_linestatus = 'O')::int AS n,
  CASE WHEN l_quantity > 10 THEN 0.5::double ELSE 0 END + CASE WHEN l_tax > 0.02 THEN 0.75::double ELSE 0 END + CASE WHEN l_discount > 0.05 THEN 0.25::double ELSE 0 END + CASE WHEN l_linestatus = 'O' THEN 1.0::double ELSE 0 END AS s FROM lineitem)""")
def a11_overall_confidence(t):
    scores = F.array(F.when(F.col("l_quantity") > 10, 0.5), F.when(F.col("l_tax") > 0.02, 0.75), F.when(F.col("l_discount") > 0.05, 0.25), F.when(F.col("l_linestatus") == "O", 1.0))
    return t.lineitem.select("l_orderkey", "l_linenumber", extract.overall_confidence(scores).alias("confidence"))


@query(r"""SELECT p_partkey, regexp_matches(c, '^[A-Z][A-Z0-9]{0,9}(-[A-Z0-9]{1,10}){0,2}$') AND regexp_matches(c, '[0-9-]') AS code FROM (SELECT p_partkey, trim(CASE p_partkey % 3 WHEN 0 THEN upper(left(p_name, 3)) || '-' || p_size WHEN 1 THEN p_brand ELSE upper(left(p_type, 4)) || p_size END) AS c FROM part)""")
def f14_unit_code(t):
    k = F.col("p_partkey") % 3
    size = F.col("p_size").cast("string")
    c = F.when(k == 0, F.concat(F.upper(F.substring("p_name", 1, 3)), F.lit("-"), size)).when(k == 1, F.col("p_brand")).otherwise(F.concat(F.upper(F.substring("p_type", 1, 4)), size))
    return t.part.select("p_partkey", extract.looks_like_unit_code(c).alias("code"))


@query(r"""SELECT p_partkey, CASE WHEN regexp_matches(c, '^[A-Za-z]+( [A-Za-z]+){1,5}$') THEN c END AS name FROM (SELECT p_partkey, trim(CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || ' ' || p_brand END) AS c FROM part)""")
def f15_bare_name(t):
    c = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), F.col("p_name"), F.lit("."))).otherwise(F.concat_ws(" ", "p_name", "p_brand"))
    return t.part.select("p_partkey", extract.bare_person_name(c).alias("name"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 4 END::int AS first, CASE WHEN o_orderkey % 3 = 0 THEN 4 + length('đang công tác tại') END::int AS last, CASE WHEN o_orderkey % 3 = 0 THEN 'Ông' ELSE 'Ông ' || o_orderpriority END AS before FROM orders""")
def f17_markers(t):
    said = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Ông ĐANG  cong-tác tại Cục "), F.col("o_orderpriority"))).otherwise(F.concat(F.lit("Ông "), F.col("o_orderpriority")))
    m = extract.earliest_marker(said, extract.CURRENT)
    return t.orders.select("o_orderkey", m["start"].alias("first"), (m["end"] - F.when(F.col("o_orderkey") % 3 == 0, 1)).alias("last"), extract.clean_unit(extract.cut_at_markers(said, extract.CURRENT)).alias("before"))


@query(f"""WITH {_DOSSIERS} SELECT doc_id, 'subject_name' AS field, name AS value, CASE k WHEN 2 THEN 'narrative_name' ELSE 'bare_name_query' END AS rule FROM d WHERE k > 1
  UNION ALL SELECT doc_id, 'subject_code', 'AB-' || doc_id, 'regex_code' FROM d WHERE k = 2 UNION ALL SELECT doc_id, 'unit_name', unit, 'current_marker' FROM d WHERE k = 2""")
def f19_narrative(t):
    return extract.narrative(_dossiers(t).filter("doc_id % 4 > 1"))


def _sheets(t):
    """A sheet of customers of each nation: a title, a header of ours and the rows, in cells."""
    k = F.col("c_custkey")
    cell = lambda c, v, text=True: F.struct(F.lit(c).alias("col"), v.alias("value"), F.lit(text).alias("is_text"))
    values = F.array(cell(0, F.when(k % 10 == 0, F.lit("N/A")).otherwise(F.lit("Nguyễn Văn An"))), cell(1, F.lpad(k.cast("string"), 9, "1"), False), cell(2, F.concat(F.lit("Cục "), F.col("c_mktsegment"))), cell(3, F.when(k % 2 == 0, "2024-01-02").otherwise("later")))
    rows = t.customer.select(F.col("c_nationkey").alias("sheet"), (F.col("c_custkey") + 2).cast("int").alias("row"), F.explode(values).alias("c"))
    heads = F.array(*[F.struct(F.lit(r).alias("row"), cell(c, F.lit(v)).alias("c")) for r, c, v in ((0, 0, "Danh sách"), (1, 0, "Họ và tên"), (1, 1, "CCCD"), (1, 2, "remark"), (1, 3, "seen on"))])
    heads = t.nation.select(F.col("n_nationkey").alias("sheet"), F.explode(heads).alias("h")).select("sheet", "h.row", "h.c")
    return rows.unionByName(heads).select("sheet", "row", "c.*")


@query("SELECT n_nationkey AS sheet, 1 AS header FROM nation")
def b18_header_row(t):
    return bulk.header_rows(_sheets(t))


_FIRST = """f AS (SELECT c_nationkey AS sheet, avg((c_custkey % 10 <> 0)::int) AS names, avg((c_custkey % 2 = 0)::int) AS days FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer) WHERE r <= 50 GROUP BY 1)"""


@query(f"""WITH {_FIRST} SELECT sheet, 0 AS col, 'subject_name' AS field, round(names, 6) AS score FROM f UNION ALL SELECT sheet, 1, 'subject_code', 1 FROM f UNION ALL SELECT sheet, 2, 'unit_name', 1 FROM f UNION ALL SELECT sheet, 2, 'subject_name', 1 FROM f UNION ALL SELECT sheet, 3, 'as_of_date', round(days, 6) FROM f WHERE days > 0""")
def f16_value_scores(t):
    got = bulk.value_scores(_sheets(t).filter("row > 1"))
    return got.select("sheet", "col", F.explode("scores").alias("field", "score")).filter("score > 0").select("sheet", "col", "field", F.round("score", 6).alias("score"))


@query(f"""WITH {_FIRST}, c AS (SELECT sheet, 0 AS col, 'subject_name' AS field, 1.0::double AS header_score, round_even(names, 4) AS value_score FROM f UNION ALL SELECT sheet, 1, 'subject_code', 1, 1 FROM f UNION ALL SELECT sheet, 2, 'unit_name', NULL, 1 FROM f UNION ALL SELECT sheet, 3, CASE WHEN 0.92 * days >= 0.6 THEN 'as_of_date' END, NULL, NULL FROM f
    UNION ALL SELECT sheet, 4, NULL, 1, 0 FROM f UNION ALL SELECT sheet, 5, 'position', 1, 0 FROM f)
  SELECT * FROM c""")
def b17_header_mapping(t):
    """All columns: named ones, one known by its values, one that is neither, a second name that is filled beside the first, and one never filled."""
    cells = _sheets(t)
    again = cells.filter("col = 0 and row > 1").withColumn("col", F.lit(4)).withColumn("value", F.concat_ws(" ", F.lit("7"), F.col("row").cast("string")))
    heads = cells.filter("row = 1").select("sheet", "col", F.col("value").alias("header"))
    more = t.nation.select(F.col("n_nationkey").alias("sheet"), F.explode(F.array(F.struct(F.lit(4).alias("col"), F.lit("Full name").alias("header")), F.struct(F.lit(5).alias("col"), F.lit("Chức vụ").alias("header")))).alias("x")).select("sheet", "x.*")
    got = bulk.infer_mapping(heads.unionByName(more), cells.filter("row > 1").unionByName(again).select("sheet", "row", "col", "value"))
    # how like a header is to unlike names is no SQL; such scores are tested against worked cases
    named, known = F.col("col").isin(0, 1, 4, 5), F.col("col") != 3
    return got.select("sheet", "col", "field", F.when(named, F.col("header_score")).alias("header_score"), F.when(known, F.col("value_score")).alias("value_score"))


@query("""WITH m AS (SELECT o_custkey AS sheet, o_orderpriority AS header, CASE o_orderkey % 5 WHEN 0 THEN 'position' WHEN 1 THEN 'unit_name' WHEN 2 THEN 'salary' WHEN 3 THEN '' ELSE 'birth_year' END AS field FROM orders),
  h AS (SELECT c_custkey AS sheet, unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', c_mktsegment]) AS header FROM customer), d AS (SELECT DISTINCT sheet, header, field FROM m)
  SELECT DISTINCT sheet, 'NO_SUCH_COLUMN' AS rule, header AS item FROM d WHERE (sheet, header) NOT IN (SELECT sheet, header FROM h)
  UNION ALL SELECT DISTINCT sheet, 'NO_SUCH_FIELD', 'salary' FROM d WHERE field = 'salary' UNION ALL SELECT sheet, 'FIELD_TWICE', field FROM d WHERE field <> '' GROUP BY sheet, field HAVING count(*) > 1""")
def u5_mapping_violations(t):
    """Orders as mappings that operators gave: a sheet for each customer, columns by priority."""
    fields = F.element_at(F.array(*map(F.lit, ("position", "unit_name", "salary", "", "birth_year"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    given = t.orders.select(F.col("o_custkey").alias("sheet"), F.col("o_orderpriority").alias("header"), fields.alias("field"))
    names = F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM")), F.col("c_mktsegment"))
    headers = t.customer.select(F.col("c_custkey").alias("sheet"), F.posexplode(names).alias("col", "header"))
    return bulk.mapping_violations(headers, given)


@query("SELECT c_nationkey AS sheet, (c_custkey + 2)::int AS row, CASE WHEN c_custkey % 10 = 0 THEN 'N/A' ELSE 'Nguyễn Văn An' END AS subject_name, lpad(c_custkey::varchar, 9, '1') AS subject_code FROM customer")
def b18_records(t):
    cells = _sheets(t)
    heads = cells.filter("row = 1").select("sheet", "col", F.col("value").alias("header"))
    mapping = bulk.infer_mapping(heads, cells.filter("row > 1").select("sheet", "row", "col", "value"))
    got = bulk.records(cells, bulk.header_rows(cells), mapping)
    return got.select("sheet", "row", F.col("values")["subject_name"].alias("subject_name"), F.col("values")["subject_code"].alias("subject_code"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN lower(p_type) WHEN 1 THEN array_to_string(list_transform(regexp_extract_all(p_name || ' ' || p_brand, '[A-Za-z0-9]+')[1:8], lambda w: upper(left(w, 1))), '') WHEN 2 THEN replace(replace(p_name, 'rn', 'm'), 'cl', 'd') ELSE p_name END AS noisy FROM part""")
def f23_noise(t):
    k = F.col("p_partkey") % 4
    noise = F.when(k == 0, "LOWERCASE").when(k == 1, "ABBREVIATION").when(k == 2, "OCR_LIKE").otherwise("NONE")
    name = F.when(k == 0, F.col("p_type")).when(k == 1, F.concat_ws(" ", "p_name", "p_brand")).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", synthetic.noisy_name(name, noise, F.col("p_partkey").cast("string")).alias("noisy"))


_VARIANTS = """[s, s, lower(s), replace(s, '-', ' '), array_to_string(w[-2:], ' '), w[-1], array_to_string(w[1:len(w) - 1], ' '), array_to_string(w[1:2], ' '), array_to_string(w[1:3], ' '), left(s, length(s) - 2), s, left(s, length(s) // 2) || substr(s, length(s) // 2 + 2)]"""


@query(f"SELECT DISTINCT s AS name, unnest({_VARIANTS}) AS variant FROM (SELECT DISTINCT p_name || ' ' || p_type AS s, string_split(p_name || ' ' || p_type, ' ') AS w FROM part)")
def f24_variants(t):
    return t.part.select(F.concat_ws(" ", "p_name", "p_type").alias("name")).distinct().select("name", F.explode(T.mention_variants(F.col("name"))).alias("variant"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 6 = 0 THEN 'SYN-POL-MISSING' WHEN o_orderdate::date < DATE '1993-01-01' OR o_orderdate::date > DATE '1997-01-01' THEN 'SYN-POL-NO-EFFECTIVE-RULE' WHEN o_orderpriority = '5-LOW' THEN 'SYN-POL-CONTRACT'
  WHEN o_custkey % 6 IN (1, 2) AND o_orderstatus IN ('F', 'O') THEN 'SYN-POL-ACTIVE' ELSE 'SYN-POL-FALLBACK' END AS policy_id FROM orders""")
def b29_policy(t):
    k = F.col("o_custkey") % 6
    facts = {
        "organization_type": F.when(k == 0, "").when(k == 1, "BCA").when(k == 2, "BQP").otherwise("OTHER"), "subject_group": F.when(F.col("o_orderpriority") == "5-LOW", "CONTRACT_WORKER").otherwise("STAFF"),
        "employment_status": F.when(F.col("o_orderstatus") == "F", "ACTIVE").when(F.col("o_orderstatus") == "O", "TEMPORARY").otherwise("RETIRED"), "assessment_date": F.col("o_orderdate").cast("date"),
    }
    day = lambda d: F.lit(d).cast("date")
    return t.orders.select("o_orderkey", synthetic.policy(facts, day("1993-01-01"), day("1997-01-01"))["policy_id"].alias("policy_id"))


@query("SELECT 'duplicate_record_id' AS gate, 0::bigint AS violations, (SELECT count(*) * 4 FROM part)::bigint AS records UNION ALL SELECT 'split_leakage', 0, (SELECT count(*) * 4 FROM part) UNION ALL SELECT 'not_found_is_not_other', 0, (SELECT count(*) * 4 FROM part)")
def b28_synthesise(t):
    units = t.part.select(F.col("p_partkey").alias("unit_id"), F.col("p_name").alias("name"), F.when(F.col("p_size") > 25, "BCA").otherwise("BQP").alias("org"))
    rows = synthetic.generate(units, 4, {"NONE": 5, "NO_ACCENT": 2, "LOWERCASE": 1, "TYPO_UNIT": 1, "ABBREVIATION": 1, "OCR_LIKE": 1}, 0.25, "2024-06-01", None)
    counted = rows.groupBy().agg(F.count(F.lit(1)).alias("records"))
    return synthetic.gates(rows).join(F.broadcast(counted)).select("gate", "violations", "records")  # one row


@query("""WITH r AS (SELECT 'PERSON' AS field, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE ' ' || upper(o_clerk) END AS pred, CASE WHEN o_orderkey % 9 <> 0 THEN o_clerk END AS gold, NULL::double AS confidence FROM (SELECT *, 'clerk ' || o_custkey AS o_clerk FROM orders)
    UNION ALL SELECT 'POSITION', CASE o_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'other' ELSE ' ' || upper(o_orderpriority) END, o_orderpriority, NULL FROM orders
    UNION ALL SELECT 'UNIT', CASE o_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'elsewhere' ELSE 'Unit-' || o_orderstatus END, 'unit ' || lower(o_orderstatus), o_orderkey % 10 / 10.0::double FROM orders),
  j AS (SELECT *, coalesce(lower(replace(trim(pred), '-', ' ')) = lower(replace(gold, '-', ' ')), false) AS ok, coalesce(pred, '') <> '' AS given FROM r WHERE gold IS NOT NULL),
  c AS (SELECT count(*) FILTER (ok)::double AS tp, count(*) FILTER (NOT ok AND given)::double AS fp, count(*) FILTER (NOT ok)::double AS fn,
    count(*) FILTER (field = 'UNIT' AND ok AND confidence >= 0.7)::double AS rtp, count(*) FILTER (field = 'UNIT' AND NOT (ok AND confidence >= 0.7) AND given)::double AS rfp, count(*) FILTER (field = 'UNIT' AND NOT (ok AND confidence >= 0.7))::double AS rfn FROM j)
  SELECT 1 AS one, round(2 * tp / (2 * tp + fp + fn), 6) AS entity_f1, round(2 * rtp / (2 * rtp + rfp + rfn), 6) AS relation_f1 FROM c""")
def a15_micro_f1(t):
    """Three fields of every order, some unread, wrong, without a gold value or unsure."""
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    clerk = F.concat(F.lit("clerk "), c.cast("string"))
    row = lambda field, predicted, gold, confidence=F.lit(None): F.struct(F.lit(field).alias("field"), predicted.alias("predicted"), gold.alias("gold"), confidence.cast("double").alias("confidence"))
    rows = F.array(
        row("PERSON", F.when(c % 4 != 0, F.concat(F.lit(" "), F.upper(clerk))), F.when(k % 9 != 0, clerk)),
        row("POSITION", F.when(c % 5 == 0, "").when(c % 5 == 1, "other").otherwise(F.concat(F.lit(" "), F.upper("o_orderpriority"))), F.col("o_orderpriority")),
        row("UNIT", F.when(c % 6 == 0, "").when(c % 6 == 1, "elsewhere").otherwise(F.concat(F.lit("Unit-"), F.col("o_orderstatus"))), F.concat(F.lit("unit "), F.lower("o_orderstatus")), (k % 10) / 10.0),
    )
    got = metrics.micro_f1(t.orders.select(F.explode(rows).alias("r")).select("r.*"))
    return got.select(F.lit(1).alias("one"), F.round("entity_f1", 6).alias("entity_f1"), F.round("relation_f1", 6).alias("relation_f1"))


_MARKS = "ăâđêôơưáàảãạắằẳẵặấầẩẫậéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ"


@query(f"""WITH b AS (SELECT item_id % 2 = 0 AS p, item_id % 3 AS seconds, text AS t, CASE WHEN item_id % 2 = 0 THEN strip_accents(text) ELSE regexp_replace(text, '\\b(the|der|la|de) ', '', 'g') END AS r FROM benchmark),
  c AS (SELECT *, len(list_filter(string_split_regex(t, '\\s+'), lambda w: w <> '')) AS words, len(list_filter(string_split_regex(t, '\\s+'), lambda w: w <> '' AND strip_accents(w) <> w)) AS changed, len(list_filter(string_split_regex(r, '\\s+'), lambda w: w <> '')) AS left_,
    CASE WHEN p THEN len(list_filter(range(1, len(t) + 1), lambda i: t[i] <> r[i])) ELSE len(t) - len(r) END AS letters, length(regexp_replace(t, '[^{_MARKS}{_MARKS.upper()}]', '', 'g')) AS marks FROM b)
  SELECT CASE WHEN p THEN 'primary' ELSE 'fallback' END AS engine, count(*) AS samples, avg(letters::double / len(t)) AS cer, avg(CASE WHEN p THEN changed ELSE words - left_ END::double / words) AS wer, avg(CASE WHEN p AND marks > 0 THEN 0.0 ELSE 1.0 END)::double AS diacritic_accuracy, avg(seconds)::double AS seconds FROM c GROUP BY p""")
def a16_reading_scores(t):
    """Benchmark passages against readings that lost marks or words."""
    engine = F.when(F.col("item_id") % 2 == 0, "primary").otherwise("fallback")
    read = F.when(F.col("item_id") % 2 == 0, T.strip_marks(F.col("text"))).otherwise(F.regexp_replace("text", r"\b(the|der|la|de) ", ""))
    rows = t.benchmark.select(engine.alias("engine"), F.col("text").alias("truth"), read.alias("text"), (F.col("item_id") % 3).cast("double").alias("seconds"))
    return metrics.reading_scores(rows)


@query("SELECT item_id, CASE WHEN length(text) = 0 THEN 0.0 ELSE round((length(text) - length(replace(text, 'e', '')))::double / length(text), 6) END::double AS cer FROM benchmark")
def f7_cer(t):
    """Whole passages against readings that lost every e: as many letters are missing as there were."""
    return t.benchmark.select("item_id", F.round(T.error_rate(F.col("text"), F.replace("text", F.lit("e"), F.lit(""))), 6).alias("cer"))


@query("""SELECT item_id, round(1 - len(list_filter(ws, lambda w: lower(w) IN ('the', 'der', 'la', 'de')))::double / len(ws), 6) AS kept FROM (SELECT item_id, list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda w: w <> '') AS ws FROM benchmark) WHERE len(ws) > 0""")
def f7_wer(t):
    """Whole passages against readings that lost their articles."""
    words = F.filter(F.split("text", r"[ \t\n\r]+"), lambda w: w != "")
    rows = t.benchmark.select("item_id", words.alias("ws")).filter("size(ws) > 0")
    lost = F.filter("ws", lambda w: ~F.lower(w).isin("the", "der", "la", "de"))
    return rows.select("item_id", F.round(1 - metrics.word_error_rate(F.array_join("ws", " "), F.array_join(lost, " ")), 6).alias("kept"))


@query("SELECT doc_id, CASE WHEN m = 0 THEN 1.0 ELSE 0.0 END::double AS accuracy FROM (SELECT doc_id, length(regexp_replace(text, '[^âăêôơưáàéèíìóòúùÂĂÊÔƠƯÁÀÉÈÍÌÓÒÚÙãõÃÕđĐýÝ]', '', 'g')) AS m FROM documents)")
def f8_diacritic_accuracy(t):
    return T.dealt(t.documents.select("doc_id", "text")).select("doc_id", metrics.diacritic_accuracy(F.col("text"), T.strip_marks(F.col("text"))).alias("accuracy"))
