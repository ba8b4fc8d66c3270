"""Planted grids come back from their lines and boxes."""

import pytest

from dossierlake.operators import lattice


def grid(doc, page, xs, ys, cells, missing=(), jitter=0.0):
    """Segments and boxes of a table: ``cells`` {(row, col): text}; ``missing`` borders are ('v', row, line) or ('h', line, col)."""
    lines, boxes = [], []
    for k, x in enumerate(xs):
        for r in range(len(ys) - 1):
            if ("v", r, k) not in missing:
                lines.append((doc, page, x + jitter * (r % 2), ys[r], x - jitter * (r % 2), ys[r + 1]))
    for k, y in enumerate(ys):
        for c in range(len(xs) - 1):
            if ("h", k, c) not in missing:
                lines.append((doc, page, xs[c], y, xs[c + 1], y + jitter))
    for (r, c), text in cells.items():
        for n, word in enumerate(text.split()):
            boxes.append((doc, page, xs[c] + 4 + 9 * n, ys[r] + 4.0, xs[c] + 10 + 9 * n, ys[r] + 9.0, word))
    return lines, boxes


def found(spark, *parts):
    lines, boxes = [x for p in parts for x in p[0]], [x for p in parts for x in p[1]]
    s = spark.createDataFrame(lines, "doc_id int, page int, x0 double, y0 double, x1 double, y1 double")
    b = spark.createDataFrame(boxes, "doc_id int, page int, x0 double, y0 double, x1 double, y1 double, text string")
    return {tuple(r)[:2] + tuple(r)[3:5]: r["content"] for r in lattice.tables_of(s, b).collect()}


XS, YS = [10.0, 60.0, 140.0, 200.0], [10.0, 30.0, 50.0, 70.0]
TEXTS = {(r, c): f"a{r} b{c}" for r in range(3) for c in range(3)}


@pytest.mark.parametrize("jitter", [0.0, 0.9])
def test_plain_grid(spark, jitter):
    got = found(spark, grid(1, 1, XS, YS, TEXTS, jitter=jitter))
    assert got == {(1, 0, r, c): t for (r, c), t in TEXTS.items()}


def test_merged_cells(spark):
    """A cell over two columns, one over two rows, and one over both: the first field has the text."""
    wide = grid(1, 1, XS, YS, {k: t for k, t in TEXTS.items() if k != (0, 1)}, {("v", 0, 1)})
    got = found(spark, wide)
    assert got[1, 0, 0, 0] == "a0 b0" and got[1, 0, 0, 1] == "" and got[1, 0, 0, 2] == "a0 b2" and len(got) == 9
    late = grid(1, 1, XS, YS, {**{k: t for k, t in TEXTS.items() if k != (0, 0)}}, {("v", 0, 1)})  # the text stands in the second field
    assert found(spark, late)[1, 0, 0, 0] == "a0 b1"
    tall = found(spark, grid(1, 1, XS, YS, TEXTS, {("h", 1, 2)}))
    assert tall[1, 0, 0, 2] == "a0 b2 a1 b2" and tall[1, 0, 1, 2] == ""
    block = found(spark, grid(1, 1, XS, YS, TEXTS, {("v", 0, 1), ("v", 1, 1), ("h", 1, 0), ("h", 1, 1)}))
    assert block[1, 0, 0, 0] == "a0 b0 a0 b1 a1 b0 a1 b1" and block[1, 0, 1, 0] == block[1, 0, 0, 1] == block[1, 0, 1, 1] == ""


def test_tables_in_page_order(spark):
    """Two tables on a page, of unlike columns; pages of other documents and later pages; a page of white space; texts outside."""
    one = grid(1, 2, XS, YS, TEXTS)
    two = grid(1, 2, [10.0, 100.0, 200.0], [110.0, 130.0, 150.0], {(r, c): f"t{r}{c}" for r in range(2) for c in range(2)})
    first = grid(1, 1, XS, YS, {(0, 0): "first"})
    other = grid(2, 1, XS, YS, {(2, 2): "other"})
    space = ([], [(1, 3, 10.0 + 100 * c, 10.0 + 20 * r, 40.0 + 100 * c, 18.0 + 20 * r, f"s{r}{c}") for r in range(2) for c in range(2) if (r, c) != (1, 0)])
    stray = ([], [(1, 2, 400.0, 20.0, 420.0, 28.0, "stray"), (2, 2, 1.0, 1.0, 5.0, 5.0, "alone"), (1, 1, 12.0, 12.0, 14.0, 14.0, None)])
    got = found(spark, one, two, first, other, space, stray)
    tables = {}
    for (doc, table, r, c), text in got.items():
        tables.setdefault((doc, table), {})[r, c] = text
    assert set(tables) == {(1, 0), (1, 1), (1, 2), (1, 3), (2, 0)}
    assert tables[1, 0][0, 0] == "first" and tables[1, 1] == TEXTS and tables[1, 2] == {(r, c): f"t{r}{c}" for r in range(2) for c in range(2)}
    assert tables[1, 3] == {(0, 0): "s00", (0, 1): "s01", (1, 0): "", (1, 1): "s11"} and tables[2, 0][2, 2] == "other"


def test_no_pages(spark):
    assert found(spark, ([], [])) == {}
    assert found(spark, ([(1, 1, 0.0, 0.0, 50.0, 50.0)], [(1, 1, 0.0, 0.0, 5.0, 5.0, "x")])) == {}


def test_lines_are_found_once(spark, tmp_path):
    """The fields of all pages are a table; what uses them does not find the lines again."""
    path = str(tmp_path / "segments-of-pages")
    spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 0.0)], "doc_id int, page int, x0 double, y0 double, x1 double, y1 double").write.parquet(path)
    boxes = spark.createDataFrame([(1, 0, 1.0, 1.0, 2.0, 2.0, "x")], "doc_id int, page int, x0 double, y0 double, x1 double, y1 double, text string")
    leaves = lattice.tables_of(spark.read.parquet(path), boxes)._jdf.queryExecution().optimizedPlan().collectLeaves()
    of = [leaves.apply(k).output().mkString(" ") for k in range(leaves.size())]
    assert not [c for c in of if "x0" in c and "text" not in c], of  # no segment is read once more
