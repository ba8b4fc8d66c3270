"""Tables in documents: grids from HTML, rows and columns from boxes, headers that go on over pages."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

MOST_ACROSS, MOST_DOWN = 1000, 65534  # fixed values: the spans that HTML allows
LEAST_BOXES, LEAST_ROWS, LEAST_COLUMNS, LEAST_IN_COLUMN = 6, 3, 2, 3  # fixed values: what makes boxes look like a table

_TAG = re.compile(r"<!--.*?-->|<(/?)(table|tr|td|th|br)\b([^>]*)>|<[/a-zA-Z][^>]*>", re.S | re.I)


class _Element:
    """A part of a page: its kind, its attributes, texts and elements in it, and whether it was closed."""

    def __init__(self, kind: str, attributes: str = ""):
        self.kind, self.attributes, self.closed = kind, attributes, False
        self.content: list[str | _Element] = []

    def within(self, kinds: set[str]) -> Iterator[_Element]:
        """Closed elements of ``kinds`` in it, in order, but none inside a table that it holds."""
        for x in self.content:
            if isinstance(x, _Element):
                if x.kind in kinds and x.closed:
                    yield x
                if x.kind != "table":
                    yield from x.within(kinds)

    def text(self) -> str:
        return "".join(x if isinstance(x, str) else "" if x.kind == "table" else x.text() for x in self.content)

    def number(self, name: str, most: int) -> int:
        found = re.search(rf"\b{name}\s*=\s*[\"']?\s*(\d+)", self.attributes, re.I)
        return min(max(int(found[1]), 1), most) if found else 1


def _tree(page: str) -> _Element:
    """The page as a tree of tables, rows and cells. A closing tag closes the nearest open element of its kind in its table."""
    root = _Element("page")
    open_ones, at = [root], 0
    for tag in [*_TAG.finditer(page), None]:
        open_ones[-1].content.append(entities.unescape(page[at : tag.start() if tag else len(page)]))
        at = tag.end() if tag else at
        kind = tag[2].lower() if tag and tag[2] else ""
        if kind == "br":
            open_ones[-1].content.append("\n")
        elif kind and not tag[1]:
            new = _Element(kind, tag[3])
            open_ones[-1].content.append(new)
            open_ones.append(new)
        elif kind:
            inside = max((k for k, e in enumerate(open_ones) if e.kind == "table"), default=0)
            k = max((k for k, e in enumerate(open_ones) if e.kind == kind and k >= inside), default=0)
            if k:
                open_ones[k].closed = True
                del open_ones[k:]
    return root


def _tables(page: str) -> list[list[list[tuple[str, int, int]]]]:
    """Rows of (text, rows down, columns across) of each outermost table; what was never closed is left out."""
    cells = lambda row: [(" ".join(c.text().split()), c.number("rowspan", MOST_DOWN), c.number("colspan", MOST_ACROSS)) for c in row.within({"td", "th"})]
    tables = [[cells(row) for row in table.within({"tr"})] for table in _tree(page).within({"table"})]
    return [rows for rows in tables if rows]


def place(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """The grid of cells: each takes the first free place of its row and all places that it spans.

    A cell's text stands in its first column, in every row it reaches down to; its other columns are blank.
    """
    grid: list[dict[int, str]] = [{} for _ in rows]
    for r, cells in enumerate(rows):
        free = 0
        for text, down, across in cells:
            while free in grid[r]:
                free += 1
            grid += [{} for _ in range(r + down - len(grid))]
            for line in grid[r : r + down]:
                line |= dict.fromkeys(range(free, free + across), "") | {free: text.strip()}
            free += across
    return [[line.get(c, "") for c in range(max(line, default=-1) + 1)] for line in grid]


@F.pandas_udf(T.ArrayType(T.ArrayType(T.ArrayType(T.StringType()))))
def html_grids(pages: pd.Series) -> pd.Series:
    """Every outermost table of a page as a grid of texts, spans expanded; null pages have none."""
    return pd.Series([[place(rows) for rows in _tables(page)] if page else [] for page in pages])


def _runs(values: np.ndarray, near: float) -> np.ndarray:
    """Run numbers of sorted values; a run ends before the value that is further than ``near`` from the mean of the run so far."""
    sums, cuts = np.r_[0.0, np.cumsum(values)], []
    start = 0
    while start < len(values):
        cuts.append(start)
        k = np.arange(start + 1, len(values))
        far = values[k] - (sums[k] - sums[start]) / (k - start) > near
        start = int(k[far][0]) if far.any() else len(values)
    return np.searchsorted(cuts, np.arange(len(values)), "right") - 1


def _first_fit(values: np.ndarray, near: float) -> np.ndarray:
    """Sizes of clusters of values that come in their order: each joins the oldest cluster whose mean is ``near``, or founds one."""
    mean, size, many = np.zeros(len(values)), np.zeros(len(values), np.int64), 0
    for v in values:
        fits = np.abs(mean[:many] - v) <= near
        k = int(fits.argmax()) if fits.any() else many
        many = max(many, k + 1)
        size[k] += 1
        mean[k] += (v - mean[k]) / size[k]
    return size[:many]


def _clusters(boxes: Mapping[str, np.ndarray]) -> tuple[int, int, int]:
    """Rows, rows of two boxes or more, and columns that three of the boxes in such rows, or more, share."""
    x, y0, y1 = (np.asarray(boxes[c], float) for c in ("x0", "y0", "y1"))
    height = np.sort(np.maximum(y1 - y0, 1.0))[len(x) // 2]
    order = np.lexsort((x, (y0 + y1) / 2))
    row = _runs(((y0 + y1) / 2)[order], max(6.0, 0.75 * height))
    boxes_in = np.bincount(row)
    columns = _first_fit(x[order][boxes_in[row] > 1], max(12.0, 2.0 * height))
    return len(boxes_in), int((boxes_in > 1).sum()), int((columns >= LEAST_IN_COLUMN).sum())


def aligned_boxes(boxes: DataFrame) -> DataFrame:
    """(page, boxes, rows, multi, stable, table) of boxes (page, x0, y0, x1, y1): does repeated alignment hint at a table?

    Rows are runs of sorted box centres around their running mean. Boxes of rows of two or more are taken by row, centre and left
    Rows are runs of sorted box centres around their running mean. Boxes of rows of two or more are taken by row, centre and left
    edge; each joins the oldest column whose mean left edge is near, which depends on that order. A page is read by one task, which
    reads its pages one after the other and holds one batch and one page. Boxes without an extent or with nulls are left out, and with them pages that have no other.
    """
    sides = ("x0", "y0", "x1", "y1")

    def judged(ends: list[tuple], values: np.ndarray) -> pd.DataFrame:
        out, start = [], 0
        for page, end in ends:
            rows, multi, stable = _clusters(dict(zip(sides, values[start:end].T))) if end - start >= LEAST_BOXES else (0, 0, 0)
            out.append((page, end - start, rows, multi, stable, multi >= LEAST_ROWS and stable >= LEAST_COLUMNS))
            start = end
        return pd.DataFrame(out, columns=["page", "boxes", "rows", "multi", "stable", "table"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # boxes of a page that may go on in the next batch
        shaped = lambda frame: pa.RecordBatch.from_pandas(frame, schema, preserve_index=False)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("page")
            cuts = np.flatnonzero(np.asarray(pc.not_equal(ids[1:], ids[:-1]))) + 1
            if held and held[-1].column("page")[-1] != ids[0]:
                whole = pa.concat_tables(held)
                yield shaped(judged([(whole.column("page")[0].as_py(), whole.num_rows)], _values(whole)))
                held = []
            if len(cuts):
                whole = pa.concat_tables([*held, pa.Table.from_batches([batch.slice(0, int(cuts[-1]))])])
                before = sum(t.num_rows for t in held)
                yield shaped(judged([(ids[int(c) - 1].as_py(), before + int(c)) for c in cuts], _values(whole)))
                held = []
            held.append(pa.Table.from_batches([batch.slice(int(cuts[-1]) if len(cuts) else 0)]))
        if held:
            whole = pa.concat_tables(held)
            yield shaped(judged([(whole.column("page")[0].as_py(), whole.num_rows)], _values(whole)))

    def _values(table: pa.Table) -> np.ndarray:
        return np.column_stack([table.column(c).to_numpy() for c in sides])

    kind = boxes.schema["page"].dataType
    out = T.StructType([T.StructField("page", kind), *[T.StructField(c, T.LongType()) for c in ("boxes", "rows", "multi", "stable")], T.StructField("table", T.BooleanType())])
    schema = to_arrow_schema(out)
    sound = boxes.filter("page is not null and x1 > x0 and y1 > y0").select("page", *[F.col(c).cast("double") for c in sides])
    return sound.repartition("page").sortWithinPartitions("page").mapInArrow(each, out)


def continued_headers(tables: DataFrame) -> DataFrame:
    """Tables (doc_id, table_index, page, header, n_rows) with ``used_header``: their own, or that of the pages before.

    A header holds for the next table if that stands on the very next page, and on from there. A table without
    data rows, a gap in the pages or a table that finds no header ends it. Tables without a page and without
    a usable header of their own change nothing.
    """
    filled = F.coalesce(F.col("n_rows") > 0, F.lit(False))
    own = F.col("header").isNotNull() & filled
    counts = F.col("page").isNotNull() | own
    w = Window.partitionBy("doc_id", counts).orderBy("table_index")
    follows = F.coalesce(F.col("page") == F.lag("page").over(w) + 1, F.lit(False))
    starts = (F.col("header").isNotNull() | ~filled | ~follows).cast("int")
    marked = tables.select(F.struct(*tables.columns).alias("row"), "doc_id", "table_index", counts.alias("counts"), F.when(own, F.col("header")).alias("own"), starts.alias("starts"), filled.alias("filled"))
    so_far = Window.partitionBy("doc_id", "counts").orderBy("table_index").rowsBetween(Window.unboundedPreceding, 0)
    chained = marked.withColumn("chain", F.sum("starts").over(so_far))
    first = F.first("own").over(Window.partitionBy("doc_id", "counts", "chain").orderBy("table_index").rowsBetween(Window.unboundedPreceding, 0))
    kept = [F.col("row")[c].alias(c) for c in tables.columns if c != "used_header"]
    return chained.withColumn("used", F.when(F.col("counts") & F.col("filled"), first)).select(*kept, F.col("used").alias("used_header"))
