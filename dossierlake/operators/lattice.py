"""Tables from the ruled lines and text boxes of pages: lines are snapped, crossed into a lattice, and filled with the texts.

Pages without enough lines fall back to columns of white space. Everything is windows and joins within a
page; tables are numbered in the order of pages, so that a table that goes on on the next page follows its start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossierlake.sources.shared import written

# How far a line may lean, and how many lines of either kind a ruled page has at least.
LEAN, LINES = 2.0, 4
SNAP = 3.0  # lines and gaps closer than this are one
_PAGE = ["doc_id", "page"]


def _islands(rows: DataFrame, keys: list[str], start: Column, end: Column, gap: float) -> DataFrame:
    """``rows`` with the number of the run of intervals that each is part of: runs are more than ``gap`` apart."""
    order = Window.partitionBy(*keys).orderBy("from_", "to_")
    rows = rows.withColumn("from_", start).withColumn("to_", end)
    upto = F.max("to_").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("fresh_", F.coalesce(F.col("from_") > upto + gap, F.lit(True)))
    number = F.sum(F.col("fresh_").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return rows.withColumn("run", number).drop("from_", "to_", "fresh_")


def ruled_lines(segments: DataFrame) -> DataFrame:
    """(doc_id, page, upright, line, at, low, high) of segments (doc_id, page, x0, y0, x1, y1): pieces of the ruled lines of ruled pages.

    A segment leans less than ``LEAN`` from upright or level, others count nothing. Those at nearly one place are a line, numbered
    from 0 by page; touching pieces of a line are one. A page is ruled that has more than ``LINES`` segments of either kind.
    """
    upright, level = F.abs(F.col("x1") - F.col("x0")) < LEAN, F.abs(F.col("y1") - F.col("y0")) < LEAN
    long = F.abs(F.col("x1") - F.col("x0")) + F.abs(F.col("y1") - F.col("y0")) >= LEAN
    some = segments.filter((upright | level) & long).withColumn("upright", upright)
    enough = some.groupBy(*_PAGE).agg(F.count_if("upright").alias("u"), F.count_if(~F.col("upright")).alias("l")).filter((F.col("u") > LINES) & (F.col("l") > LINES)).select(*_PAGE)
    place = F.when(F.col("upright"), (F.col("x0") + F.col("x1")) / 2).otherwise((F.col("y0") + F.col("y1")) / 2)
    along = lambda f: F.when(F.col("upright"), f("y0", "y1")).otherwise(f("x0", "x1"))
    rows = some.join(enough, _PAGE).select(*_PAGE, "upright", place.alias("place"), along(F.least).alias("low"), along(F.greatest).alias("high"))
    lines = _islands(rows, [*_PAGE, "upright"], F.col("place"), F.col("place"), SNAP).withColumnRenamed("run", "line")
    pieces = _islands(lines, [*_PAGE, "upright", "line"], F.col("low"), F.col("high"), SNAP)
    whole = pieces.groupBy(*_PAGE, "upright", "line", "run").agg(F.avg("place").alias("place"), F.min("low").alias("low"), F.max("high").alias("high"))
    at = F.avg("place").over(Window.partitionBy(*_PAGE, "upright", "line"))
    return whole.select(*_PAGE, "upright", "line", at.alias("at"), "low", "high")


def _bands(lines: DataFrame, name: str) -> DataFrame:
    """(doc_id, page, name, a, b): the space between each line and the next."""
    order = Window.partitionBy(*_PAGE).orderBy("line")
    places = lines.groupBy(*_PAGE, "line").agg(F.first("at").alias("a"))
    return places.withColumn("b", F.lead("a").over(order)).filter("b is not null").select(*_PAGE, F.col("line").alias(name), F.col("a").alias(f"{name}_a"), F.col("b").alias(f"{name}_b"))


def _borders(bands: DataFrame, pieces: DataFrame, name: str, line: str) -> DataFrame:
    """(doc_id, page, name, line) of bands that a piece of a line crosses from one side to the other."""
    met = bands.join(pieces.select(*_PAGE, F.col("line").alias(line), "low", "high"), _PAGE)  # a page's lines
    return met.filter((F.col("low") <= F.col(f"{name}_a") + SNAP) & (F.col("high") >= F.col(f"{name}_b") - SNAP)).select(*_PAGE, name, line).distinct()


def lattice_cells(segments: DataFrame) -> DataFrame:
    """(doc_id, page, part, r, c, top, left, x_a, x_b, y_a, y_b): every field of the lattices and the cell (top, left) that it belongs to.

    Fields are between neighbouring lines of a page. Without a line between them, fields are one cell. Level bands that no
    upright line crosses part the tables of a page (``part``); fields outside a table's outer lines are none.
    """
    lines = written(ruled_lines(segments), "lattice-lines")  # met four times
    upright, level = lines.filter("upright"), lines.filter("not upright")
    rows, cols = _bands(level, "r"), _bands(upright, "c")
    beside = _borders(rows, upright, "r", "c").withColumn("beside", F.lit(True))
    above = _borders(cols, level, "c", "r").withColumn("above", F.lit(True))
    fields = rows.join(cols, _PAGE).join(beside, [*_PAGE, "r", "c"], "left").join(above, [*_PAGE, "r", "c"], "left")
    edge = beside.groupBy(*_PAGE, "r").agg(F.max("c").alias("edge"))  # the last upright line of a row ends it
    fields = fields.join(edge, [*_PAGE, "r"], "left")
    across = Window.partitionBy(*_PAGE, "r").orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
    fields = fields.withColumn("left", F.max(F.when(F.col("beside"), F.col("c"))).over(across)).filter((F.col("left").isNotNull()) & (F.col("c") < F.col("edge")))
    # a row of bands without upright lines is between tables
    held = fields.select(*_PAGE, "r").distinct()
    order = Window.partitionBy(*_PAGE).orderBy("r")
    fresh = F.coalesce(F.col("r") - F.lag("r").over(order) > 1, F.lit(True))
    parts = held.withColumn("fresh", fresh).withColumn("part", F.sum(F.col("fresh").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("fresh")
    fields = fields.join(parts, [*_PAGE, "r"])
    down = Window.partitionBy(*_PAGE, "part", "c").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    first = F.min("r").over(Window.partitionBy(*_PAGE, "part"))
    fields = fields.withColumn("opens", F.when(F.col("above") | (F.col("r") == first), F.col("r"))).withColumn("own_top", F.max("opens").over(down))
    lead = fields.filter("c = left").select(*_PAGE, "part", "r", F.col("left"), F.col("own_top").alias("top"))  # a cell's top is that of its first column
    return fields.join(lead, [*_PAGE, "part", "r", "left"]).select(*_PAGE, "part", "r", "c", "top", "left", F.col("c_a").alias("x_a"), F.col("c_b").alias("x_b"), F.col("r_a").alias("y_a"), F.col("r_b").alias("y_b"))


def _in_order() -> Column:
    """Texts of a cell from top to bottom, from left to right within a line."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct(F.round(F.col("y0") / SNAP), "x0", "text")))), lambda x: x["text"]), " ")


def tables_of(segments: DataFrame, boxes: DataFrame) -> DataFrame:
    """(doc_id, table, page, row, col, content) of text boxes (doc_id, page, x0, y0, x1, y1, text) in the tables of their pages.

    Tables of a document are numbered from 0 in the order of pages and from top to bottom. A box is in the field that holds its
    middle; a merged cell's texts stand in its first field, its other fields are empty. Rows and columns that no line
    opens are left out. A page that is not ruled is a table if its boxes form two columns with white space between, and two rows.
    Null texts, and boxes outside all tables, are left out; pages without any give none.
    """
    cells = written(lattice_cells(segments), "lattice-cells")  # met five times
    middle = boxes.filter("text is not null").withColumn("mx", (F.col("x0") + F.col("x1")) / 2).withColumn("my", (F.col("y0") + F.col("y1")) / 2)
    met = cells.join(middle, _PAGE).filter((F.col("mx") >= F.col("x_a")) & (F.col("mx") < F.col("x_b")) & (F.col("my") >= F.col("y_a")) & (F.col("my") < F.col("y_b")))
    filled = met.groupBy(*_PAGE, "part", F.col("top").alias("r"), F.col("left").alias("c")).agg(_in_order().alias("content"))
    number = lambda keys, by: F.dense_rank().over(Window.partitionBy(*keys).orderBy(by)) - 1
    used = cells.select(*_PAGE, "part", "left").distinct().withColumn("col", number([*_PAGE, "part"], "left")).withColumnRenamed("left", "c")
    rows = cells.select(*_PAGE, "part", "top").distinct().withColumn("row", number([*_PAGE, "part"], "top")).withColumnRenamed("top", "r")
    grid = cells.select(*_PAGE, "part", "r", "c").join(used, [*_PAGE, "part", "c"]).join(rows, [*_PAGE, "part", "r"])
    ruled = grid.join(filled, [*_PAGE, "part", "r", "c"], "left").select(*_PAGE, "part", "row", "col", F.coalesce("content", F.lit("")).alias("content"))

    loose = boxes.filter("text is not null").join(cells.select(*_PAGE).distinct(), _PAGE, "left_anti")
    loose = _islands(loose, _PAGE, F.col("x0"), F.col("x1"), SNAP).withColumnRenamed("run", "col")
    loose = _islands(loose, _PAGE, F.col("y0"), F.col("y1"), 0.0).withColumnRenamed("run", "row")
    shape = loose.groupBy(*_PAGE).agg(F.max("col").alias("cols"), F.max("row").alias("rows")).filter("cols > 0 and rows > 0")
    texts = loose.groupBy(*_PAGE, "row", "col").agg(_in_order().alias("content"))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c).cast("long")))
    spaced = shape.withColumn("row", upto("rows")).withColumn("col", upto("cols")).join(texts, [*_PAGE, "row", "col"], "left")
    spaced = spaced.select(*_PAGE, F.lit(0).cast("long").alias("part"), F.col("row"), F.col("col"), F.coalesce("content", F.lit("")).alias("content"))

    both = ruled.select(*_PAGE, F.col("part").cast("long").alias("part"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "content").unionByName(spaced)
    order = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("page", "part")) - 1
    return both.withColumn("table", order).select("doc_id", "table", "page", "row", "col", "content")
