"""Queries over tables in documents, readings of pages and the calibration fit."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dossierlake.functions import text as T
from dossierlake.operators import calibrate, lattice, layout, lexicon, reading
from dossierlake.plans.base import query


@query("SELECT p_partkey, 0 AS nth, p_name || '|' || p_brand || '|' AS cells FROM part UNION ALL SELECT p_partkey, 1, p_name || '|' || p_type || '|' || p_size FROM part")
def f30_grid(t):
    cell = lambda c, more="": F.concat(F.lit(f"<td{more}>"), F.col(c).cast("string"), F.lit("</td>"))
    page = F.concat(F.lit("<p>x<table><tr>"), cell("p_name", ' rowspan="2"'), cell("p_brand", " colspan=2"), F.lit("</tr><tr>"), cell("p_type"), cell("p_size"), F.lit("</tr></table>"))
    rows = T.dealt(t.part.select("p_partkey", page.alias("page"))).select("p_partkey", F.posexplode(layout.html_grids("page")[0]).alias("nth", "cells"))
    return rows.select("p_partkey", "nth", F.array_join("cells", "|").alias("cells"))


@query()
def w8_aligned_boxes(t):
    x, y = F.floor(F.col("l_discount") * 100) % 4 * 90, F.col("l_quantity") * 14
    boxes = t.lineitem.select(F.col("l_partkey").alias("page"), x.alias("x0"), y.alias("y0"), (x + 40).alias("x1"), (y + 10).alias("y1"))
    return layout.aligned_boxes(boxes)


@query("""WITH RECURSIVE t AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k, CASE WHEN l_quantity <> 10 THEN l_linenumber + (l_quantity > 45)::int END AS page,
    CASE WHEN l_discount < 0.03 THEN l_returnflag || l_linenumber END AS header, (l_quantity % 4)::bigint AS n_rows FROM lineitem),
  s AS (SELECT doc_id, 0::bigint AS k, NULL::varchar AS used_header, NULL::varchar AS held, NULL::int AS held_page FROM t GROUP BY doc_id UNION ALL
    SELECT t.doc_id, t.k, CASE WHEN n_rows > 0 THEN coalesce(header, CASE WHEN page = held_page + 1 THEN held END) END,
      CASE WHEN n_rows > 0 AND (header IS NOT NULL OR (page = held_page + 1 AND held IS NOT NULL)) THEN coalesce(header, held) WHEN page IS NULL THEN held END,
      CASE WHEN n_rows > 0 AND (header IS NOT NULL OR (page = held_page + 1 AND held IS NOT NULL)) THEN page WHEN page IS NULL THEN held_page END
    FROM s JOIN t ON t.doc_id = s.doc_id AND t.k = s.k + 1) SELECT doc_id, k, used_header FROM s WHERE k > 0""")
def w9_continued_headers(t):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    tables = t.lineitem.select(
        F.col("l_orderkey").alias("doc_id"), k.cast("long").alias("table_index"), F.when(F.col("l_quantity") != 10, F.col("l_linenumber") + (F.col("l_quantity") > 45).cast("int")).alias("page"),
        F.when(F.col("l_discount") < 0.03, F.concat("l_returnflag", F.col("l_linenumber").cast("string"))).alias("header"), (F.col("l_quantity") % 4).cast("long").alias("n_rows"),
    )
    return layout.continued_headers(tables).select("doc_id", F.col("table_index").alias("k"), "used_header")


@query(r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, doc_id % 2 = 0 AS ocr, CASE WHEN doc_id % 3 = 0 THEN 0.25::double + (doc_id % 50) / 100.0::double END AS c FROM documents),
  m AS (SELECT *, length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS alpha, len(regexp_extract_all(t, '[A-Za-zÀ-ỹĐđ]+')) AS words, len(regexp_extract_all(t, '\S+')) AS spans, CASE WHEN c < 0.7 THEN 1 ELSE 0 END / 3.0::double AS low,
    length(regexp_replace(t, '[A-Za-zÀ-ỹĐđ0-9\s.,/:\\\-()]', '', 'g'))::double / nullif(length(t), 0) AS strange FROM d),
  l AS (SELECT doc_id, ch, count(*)::double AS k FROM (SELECT doc_id, unnest(string_split(lower(regexp_replace(t, '[^\p{L}]', '', 'g')), '')) AS ch FROM d) GROUP BY 1, 2),
  i AS (SELECT doc_id, 26 * sum(k * (k - 1)) / nullif(sum(k) * (sum(k) - 1), 0) AS ioc FROM l WHERE ch <> '' GROUP BY 1),
  h AS (SELECT doc_id, ch, count(*)::double AS k FROM (SELECT doc_id, unnest(string_split(regexp_replace(t, '\s+', '', 'g'), '')) AS ch FROM d) GROUP BY 1, 2),
  e AS (SELECT doc_id, log2(sum(k)) - sum(k * log2(k)) / sum(k) AS entropy FROM h WHERE ch <> '' GROUP BY 1),
  p AS (SELECT *, coalesce(alpha >= 200 AND words >= 30 AND words::double / greatest(spans, 1) >= 0.6, false) AS prose FROM m LEFT JOIN i USING (doc_id) LEFT JOIN e USING (doc_id)),
  g AS (SELECT *, coalesce(c < 0.7, false) OR coalesce(low > 0.2 AND c IS NOT NULL, false) OR strange IS NULL OR strange > 0.02 OR (prose AND (ioc < 1.1 OR entropy < 3.5)) AS fails FROM p),
  a AS (SELECT doc_id, fails, list_filter([c, c, CASE WHEN c IS NOT NULL THEN 1 - low END, 1 - strange], lambda x: x IS NOT NULL) AS parts FROM g)
  SELECT doc_id, CASE WHEN fails THEN 'FAIL' ELSE 'PASS' END AS gate, round(CASE WHEN len(parts) = 0 THEN CASE WHEN fails THEN 0 ELSE 0.75 END WHEN fails THEN least(0.5, list_avg(parts)) ELSE list_avg(parts) END::double, 6) AS confidence FROM a""")
def b13_quality(t):
    scores = F.when(F.col("doc_id") % 3 == 0, F.array(0.25 + (F.col("doc_id") % 50) / 100.0, F.lit(0.9), F.lit(0.95)))
    rows = reading.with_gate(t.documents.withColumn("scores", scores), "text", "scores", F.lit(False), "q")
    return rows.select("doc_id", F.col("q.gate").alias("gate"), F.round("q.confidence", 6).alias("confidence"))


_KNOWN = r"""w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[A-Za-zÀ-ỹĐđ]+')) AS word FROM documents), x AS (SELECT word FROM w GROUP BY word HAVING count(DISTINCT doc_id) > 2),
  k AS (SELECT doc_id, count(*) AS words, count(x.word) AS known FROM w LEFT JOIN x USING (word) GROUP BY 1)"""


def _corpus_words(t):
    """A lexicon of the words that more than two documents have."""
    return lexicon.shared_words(t.documents, "doc_id", reading.words_of(F.col("text")), 2)


@query(f"WITH {_KNOWN} SELECT doc_id, coalesce(words, 0)::bigint AS words, coalesce(known, 0)::bigint AS known FROM documents LEFT JOIN k USING (doc_id)")
def f26_dictionary_hits(t):
    """Words of every document that a lexicon of the corpus knows."""
    rows = lexicon.with_known_words(t.documents.select("doc_id", reading.words_of(F.col("text")).alias("ws")), F.col("ws"), _corpus_words(t))
    return rows.select("doc_id", F.size("ws").cast("long").alias("words"), "known")


@query(f"WITH {_KNOWN} SELECT doc_id, coalesce(words, 0)::bigint AS words, coalesce(known, 0)::bigint AS known FROM documents LEFT JOIN k USING (doc_id)")
def f26_large_lexicon(t):
    """The same with a lexicon that is too large to be sent."""
    texts = t.documents.select("doc_id", reading.words_of(F.col("text")).alias("ws"))
    rows = lexicon.with_known_words(texts.withColumn("words", F.size("ws").cast("long")), F.col("ws"), _corpus_words(t), sent_words=0)
    return rows.select("doc_id", "words", "known")


@query(rf"""WITH {_KNOWN}, d AS (SELECT doc_id, coalesce(words, 0) AS words, coalesce(known, 0) AS known, doc_id % 2 = 0 AS ocr, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS alpha, len(regexp_extract_all(text, '\S+')) AS spans,
    len(regexp_extract_all(text, '[ăâđêôơưĂÂĐÊÔƠƯáàảãạÁÀẢÃẠéèẻẽẹÉÈẺẼẸíìỉĩịÍÌỈĨỊóòỏõọÓÒỎÕỌúùủũụÚÙỦŨỤýỳỷỹỵÝỲỶỸỴấầẩẫậẤẦẨẪẬắằẳẵặẮẰẲẴẶếềểễệẾỀỂỄỆốồổỗộỐỒỔỖỘớờởỡợỚỜỞỠỢứừửữựỨỪỬỮỰ]')) AS marks FROM documents LEFT JOIN k USING (doc_id)),
  p AS (SELECT *, alpha >= 200 AND words >= 30 AND words::double / greatest(spans, 1) >= 0.6 AS prose FROM d)
  SELECT doc_id, CASE WHEN prose THEN round(known::double / words, 6) END AS dict_hit_ratio, CASE WHEN prose THEN known::double / words >= 0.35 END AS dict_passed,
    CASE WHEN prose AND ocr THEN round(marks::double / alpha, 6) END AS diacritic_ratio, CASE WHEN prose AND ocr THEN marks::double / alpha >= 0.08 END AS diacritic_passed FROM p""")
def b13_dictionary_gate(t):
    """The gate's metrics for texts from OCR and with a lexicon."""
    rows = lexicon.with_known_words(t.documents, reading.words_of(F.col("text")), _corpus_words(t), "hits")
    judged = reading.with_metrics(rows.withColumn("none", F.array().cast("array<double>")), "text", "none", F.col("doc_id") % 2 == 0, "q", "hits")
    shown = lambda name, short: [F.round(f"q.{name}.value", 6).alias(name), F.col(f"q.{name}.passed").alias(f"{short}_passed")]
    return judged.select("doc_id", *shown("dict_hit_ratio", "dict"), *shown("diacritic_ratio", "diacritic"))


@query()
def b14_select_reading(t):
    text = F.when(F.col("l_discount") > 0.08, F.concat(F.lit("CCCD: "), F.lpad((F.col("l_partkey") % 3).cast("string"), 9, "1"))).otherwise(F.col("l_returnflag"))
    engine = F.when(F.col("l_linenumber") % 2 == 1, "primary").otherwise("fallback")
    lines = t.lineitem.select(F.col("l_orderkey").alias("page_id"), engine.alias("engine"), F.col("l_linenumber").alias("line"), text.alias("text"), (0.6 + F.col("l_tax") * 5).alias("conf"))
    images = t.orders.select(F.col("o_orderkey").alias("page_id"), (F.col("o_orderkey") % 100 + 20).cast("double").alias("blur"), F.lit(20.0).alias("contrast"))
    return reading.select_reading(lines, images).withColumn("confidence", F.round("confidence", 6))


@query()
def b30_calibration_fit(t):
    names = t.part.select(F.concat_ws(" ", "p_name", "p_brand").alias("d_id")).distinct().withColumn("name", F.col("d_id"))
    noisy = names.select(F.col("d_id").alias("q_id"), F.when(F.length("name") % 2 == 0, F.regexp_replace("name", "[aeiou]", "")).otherwise(F.col("name").substr(F.lit(1), F.length("name") - 3)).alias("name"))
    rows = calibrate.match_features(noisy, names).withColumn("label", (F.col("q_id") == F.col("d_id")).cast("int"))
    fitted = calibrate.fit(rows, "q_id")
    return fitted.select(*[F.round(c, 4).alias(c) if c != "samples" else F.col(c) for c in fitted.columns])


@query("""WITH n AS (SELECT c_nationkey AS doc_id, c_custkey AS k, c_mktsegment AS s, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i FROM customer),
  p AS (SELECT *, i // 8 AS page, i % 8 AS row, count(*) OVER (PARTITION BY doc_id, i // 8) AS rows FROM n),
  c AS (SELECT doc_id, page, row, rows, k % 7 = 0 AND rows >= 3 AS merged, k, s FROM p WHERE rows > 1)
  SELECT doc_id, page AS "table", page, row, col, CASE col WHEN 0 THEN CASE WHEN merged THEN k || ' ' || s ELSE k::varchar END WHEN 1 THEN CASE WHEN merged THEN '' ELSE s END ELSE 'r' || row END AS content FROM c, range(0, 3) t(col)""")
def s5_tables(t):
    """Customers of a nation as ruled pages of eight rows, some with a cell over two columns; a short last page is known by its white space."""
    order = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    rows = t.customer.select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("s"), order.alias("i"))
    rows = rows.select("doc_id", "k", "s", F.floor(F.col("i") / 8).alias("page"), (F.col("i") % 8).alias("row")).withColumn("y", F.col("row") * 20.0)
    xs = (0.0, 60.0, 160.0, 230.0)
    line = lambda x0, y0, x1, y1: F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    y = F.col("y")
    drawn = [F.when((F.col("k") % 7 != 0) | F.lit(n != 1), line(F.lit(x), y, F.lit(x + 0.5), y + 20)) for n, x in enumerate(xs)] + [line(F.lit(xs[0]), y + h, F.lit(xs[-1]), y + h) for h in (0.0, 20.0)]
    segments = rows.select("doc_id", "page", F.explode(F.array_compact(F.array(*drawn))).alias("g")).select("doc_id", "page", "g.*")
    texts = (F.col("k").cast("string"), F.col("s"), F.concat(F.lit("r"), F.col("row").cast("string")))
    boxes = rows.select("doc_id", "page", F.explode(F.array(*[F.struct(F.lit(x + 5).alias("x0"), (y + 5).alias("y0"), F.lit(x + 45).alias("x1"), (y + 12).alias("y1"), text.alias("text")) for x, text in zip(xs, texts)])).alias("g"))
    return lattice.tables_of(segments, boxes.select("doc_id", "page", "g.*"))
