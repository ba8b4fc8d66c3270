"""Grids, alignments, continued headers, readings and similarity against worked cases."""

import itertools
import unicodedata

import numpy as np
import pandas as pd
import pytest

from dossierlake.functions import similarity as S
from dossierlake.operators import calibrate, layout, reading


def brute_partial(a, b):
    if len(a) > len(b):
        a, b = b, a
    parts = {b[i:j] for i, j in itertools.combinations(range(len(b) + 1), 2) if j - i == len(a) or (j - i < len(a) and (i == 0 or j == len(b)))}
    best = max((S.ratio(a, p) for p in parts), default=0.0)
    if len(a) == len(b):
        best = max([best] + [S.ratio(b, p) for k in range(1, len(a)) for p in (a[:k], a[k:])])
    return best


@pytest.mark.parametrize("a,b", [("abc", "xxabcxx"), ("abcd", "bcda"), ("zz", "abcdef"), ("river", "driver run"), ("aab", "baa"), ("x", "x"), ("cuc canh sat", "phong canh sat giao thong")])
def test_partial_ratio(a, b):
    assert S.partial_ratio(a, b) == pytest.approx(brute_partial(a, b)) == pytest.approx(S.partial_ratio(b, a))


def test_weighted_ratio():
    assert S.weighted_ratio("", "a") == 0 and S.weighted_ratio("a", "a") == 100
    assert S.weighted_ratio("bo cong an", "cong an bo") == 95  # tokens in another order
    assert S.weighted_ratio("cong an", "cong an tinh ha nam") == 90  # a part
    assert S.weighted_ratio("a", "a b c d e f g h") == 60  # a part of a far longer text
    assert S.token_ratio("so so far", "so far") == 100


def test_grid(spark):
    page = "<TABLE><tr><td rowspan=2>a&amp;b</td><td colspan='2'>c<br>d</td></tr><tr><td>e</td><td rowspan=3> f <table><tr><td>no</td></tr></table></td></tr></TABLE>"
    texts = [page, None, "", "<table></table>", "no table", "<table><tr><td colspan=0>x</td><td rowspan=y>z</td></tr>" + "</table>" + page, "<table><tr><td>open"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, html string")
    got = {r["id"]: r["g"] for r in frame.select("id", layout.html_grids("html").alias("g")).collect()}
    grid = [["a&b", "c d", ""], ["a&b", "e", "f"], ["", "", "f"], ["", "", "f"]]
    assert got == {0: [grid], 1: [], 2: [], 3: [], 4: [], 5: [[["x", "z"]], grid], 6: []}
    assert layout.place([[("x", 2, 1), ("y", 1, 1)], [], [("z", 1, 1)]]) == [["x", "y"], ["x"], ["z"]]


def test_aligned_boxes(spark):
    table = [(1, x, y, x + 30, y + 10) for y in (0, 21, 40) for x in (0, 103, 200)]
    prose = [(2, 0, 20 * k, 400, 20 * k + 10) for k in range(9)]
    odd = [(3, 0, 0, 1, 1), (4, None, 0, 1, 1), (None, 0, 0, 1, 1), (5, 3, 3, 3, 9)]
    got = {r["page"]: tuple(r)[1:] for r in layout.aligned_boxes(spark.createDataFrame(table + prose + odd, "page int, x0 int, y0 int, x1 int, y1 int")).collect()}
    assert got == {1: (9, 3, 3, 3, True), 2: (9, 9, 0, 0, False), 3: (1, 0, 0, 0, False)}


def plain_columns(rows, near):
    """Column means and sizes of left edges, row after row, each edge in the oldest column that is near."""
    columns = []
    for edges in rows:
        for x in edges:
            hit = [c for c in columns if abs(sum(c) / len(c) - x) <= near][:1]
            hit[0].append(x) if hit else columns.append([x])
    return [len(c) for c in columns]


def test_columns_depend_on_the_order_of_boxes():
    import random

    rnd = random.Random(3)
    for _ in range(200):
        rows = [sorted(rnd.randrange(0, 120) for _ in range(rnd.randrange(2, 6))) for _ in range(rnd.randrange(1, 7))]
        assert layout._first_fit(np.array([float(x) for r in rows for x in r]), 20.0).tolist() == plain_columns(rows, 20.0)
    frame = pd.DataFrame([(x, 30.0 * k, x + 5.0, 30.0 * k + 10) for k, r in enumerate([[0, 60], [18, 60], [36, 60], [0, 54]]) for x in r], columns=["x0", "y0", "x1", "y1"])
    # the first column's mean moves from 0 to 9, so that 36 founds one of its own, which sorted edges would not
    assert layout._clusters(frame) == (4, 4, 2)


def test_continued_headers(spark):
    rows = [(1, "h", 5), (2, None, 4), (3, None, 0), (4, None, 2), (5, "k", 1), (None, None, 3), (6, None, 2), (8, None, 2), (9, "m", 0), (10, None, 1), (None, "n", 2), (11, None, 1)]
    frame = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "doc_id int, table_index int, page int, header string, n_rows int")
    got = [r["used_header"] for r in layout.continued_headers(frame).orderBy("table_index").collect()]
    assert got == ["h", "h", None, None, "k", None, "k", None, None, None, "n", None]


def test_gate(spark):
    prose = " ".join(["cục cảnh sát phòng cháy và trường đại học quân y miền bắc"] * 6)
    bare = unicodedata.normalize("NFD", prose).encode("ascii", "ignore").decode()
    rows = [(0, None, None), (1, "", []), (2, "Ho ten: A", None), (3, "Ho ten: A", [0.9, 0.95]), (4, "§§§", [0.9]), (5, prose, [0.9]), (6, bare, [0.9]), (7, "a" * 5, [0.2, 0.9]), (8, " ".join(["aaaaaaa"] * 40), [0.9])]
    frame = spark.createDataFrame(rows, "id int, text string, scores array<double>")
    from pyspark.sql import functions as F

    got = {r["id"]: r["q"] for r in reading.with_gate(frame, "text", "scores", F.lit(True), "q").collect()}
    failed = {i: list(q["failed"]) for i, q in got.items()}
    empty, shaky = ["charset_violation_ratio"], ["conf_p10", "conf_min", "low_conf_ratio"]
    assert failed == {0: empty, 1: empty, 2: [], 3: [], 4: empty, 5: [], 6: ["diacritic_ratio"], 7: shaky, 8: ["diacritic_ratio", "char_entropy"]}
    assert got[0]["confidence"] == 0 and got[2]["confidence"] == 1 and got[3]["confidence"] == pytest.approx((0.9 + 0.9 + 1 + 1) / 4) and got[7]["confidence"] <= 0.5


def test_gate_reads_only_what_is_asked(spark):
    """A metric that nobody reads is not counted: no call of Python for two ratios; marks are asked as ranges."""
    from pyspark.sql import functions as F

    prose = " ".join(["cục cảnh sát phòng cháy và trường đại học quân y miền bắc ĐĂNG KÝ İ"] * 6)
    frame = spark.createDataFrame([(0, prose, None, 7), (1, "x", None, 1), (2, None, None, 0)], "id int, text string, scores array<double>, n int")
    judged = reading.with_metrics(frame, "text", "scores", F.col("id") == 0, "q", "n")
    assert judged.columns == [*frame.columns, "q"]
    two = judged.select("id", "q.diacritic_ratio.value", "q.dict_hit_ratio.value")
    assert "Python" not in two._jdf.queryExecution().executedPlan().toString() and "Python" in judged._jdf.queryExecution().executedPlan().toString()
    got = {r[0]: r[1:] for r in two.collect()}
    letters = [c for c in prose if c.isalpha()]
    held = set(reading.metrics.MARKED + reading.metrics.MARKED.upper())
    assert got[0] == (pytest.approx(sum(c in held for c in letters) / len(letters)), pytest.approx(7 / len(prose.split()))) and got[1] == got[2] == (None, None)


def test_select_reading(spark):
    lines = [
        (1, "primary", 1, "A", 0.9), (2, "primary", 1, "A", 0.6), (2, "fallback", 1, "A", 0.95), (3, "primary", 1, "CCCD 123456789", 0.6), (3, "fallback", 1, "CCCD 123456780", 0.9),
        (4, "primary", 2, None, 0.9), (4, "primary", 1, "B", 0.9), (4, "fallback", 1, "B", 0.95), (9, "primary", 1, "no image", 0.9),
    ]
    images = [(1, 80.0, 20.0), (2, 80.0, 20.0), (3, 80.0, 20.0), (4, 10.0, 20.0), (5, 80.0, 20.0)]
    got = reading.select_reading(spark.createDataFrame(lines, "page_id int, engine string, line int, text string, conf double"), spark.createDataFrame(images, "page_id int, blur double, contrast double"))
    rows = {r["page_id"]: (r["engine"], r["reason"], r["disagreement"], r["gate"]) for r in got.collect()}
    assert rows == {
        1: ("primary", None, False, "PASS"), 2: ("fallback", "PRIMARY_GATE_FAILED", False, "PASS"), 3: ("fallback", "PRIMARY_GATE_FAILED", True, "FAIL"),
        4: ("fallback", "INPUT_IMAGE_QUALITY_LOW", False, "FAIL"), 5: ("primary", "PRIMARY_GATE_FAILED", False, "FAIL"),
    }


def test_fit(spark):
    rows = [(i, 0.5 + (i % 50) / 100, (i % 7) / 10, (i % 11) / 11, 0.0, int(i % 50 > 20)) for i in range(400)]
    frame = spark.createDataFrame(rows, "k int, fuzzy double, margin double, bm25 double, semantic double, label int")
    r = calibrate.fit(frame, "k").collect()[0]
    assert r["w_fuzzy"] > 1 and r["w_semantic"] == 0 and r["roc_auc"] > 0.95 and 0 < r["samples"] < 200
    with pytest.raises(ValueError):
        calibrate.fit(frame.filter("label = 1"), "k")


def test_pages_go_on_over_batches(spark):
    """Pages of all sizes, cut by Arrow's batches, against a page alone; a task holds many pages."""
    import random

    from pyspark.sql import functions as F

    rnd = random.Random(5)
    rows = [(page, 90.0 * rnd.randrange(4), 14.0 * rnd.randrange(12)) for page in range(60) for _ in range(rnd.choice((1, 5, 6, 7, 40)))]
    boxes = spark.createDataFrame(rows, "page long, x0 double, y0 double").selectExpr("page", "x0", "y0", "x0 + 40 x1", "y0 + 10 y1")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["page"]: tuple(r)[1:] for r in layout.aligned_boxes(boxes).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    frame = boxes.toPandas()
    for page, f in frame.groupby("page"):
        n, multi, stable = layout._clusters(f) if len(f) >= 6 else (0, 0, 0)
        assert got[page] == (len(f), n, multi, stable, multi >= 3 and stable >= 2)
    assert len(got) == 60
    assert "FlatMapGroups" not in layout.aligned_boxes(boxes)._jdf.queryExecution().executedPlan().toString()  # a call of Python for every page
