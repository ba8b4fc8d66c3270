"""Bulk lists: which row of a sheet is its header, which column is which field, and rows by field."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from dossierlake.functions import similarity
from dossierlake.functions import text as T
from dossierlake.operators import extract

# Header aliases of fields, and the thresholds of headers.
ALIASES = {
    "subject_name": ["họ và tên", "họ tên", "ho ten", "tên cán bộ", "full name", "full_name", "name"],
    "subject_code": ["cccd", "cmnd", "số cccd", "so cccd", "mã cá nhân", "personal code", "personal_code", "số hiệu", "ma ca nhan"],
    "position": ["chức vụ", "chuc vu", "position", "cấp bậc", "cap bac"],
    "unit_name": ["đơn vị công tác", "don vi cong tac", "đơn vị", "don vi", "canonical_unit_name", "unit_name", "cơ quan"],
    "subject_group": ["nhóm đối tượng", "nhom doi tuong", "subject_group"],
    "employment_status": ["trạng thái công tác", "employment_status"],
    "birth_year": ["năm sinh", "nam sinh", "birth_year"],
    "as_of_date": ["ngày đánh giá", "assessment_date", "as_of_date"],
}
#: What a field's values look like.
CODE, YEAR, DAY = r"^(?:\d{9}|\d{12})$", r"^(?:19|20)\d{2}$", r"^(?:\d{1,2}[/-]\d{1,2}[/-]\d{4}|\d{4}-\d{2}-\d{2})$"
NAME_WORD, NAME_WORDS = r"^[A-Za-zÀ-ỹĐđ.'\-]+$", (2, 7)
LEAST_HEADER, LEAST_TEXT, HEADER_ROWS, SAMPLED_VALUES, ACCEPT = 0.75, 0.70, 20, 50, 0.60


@F.pandas_udf(DoubleType())
def alias_score(keys: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Similarity, 0 to 1, of a folded text to the most similar alias of any field."""
    known: dict[str, float] = {}
    for batch in keys:
        for k in set(batch.dropna()) - known.keys():
            known[k] = max((similarity.ratio(k, a) for names in _folded().values() for a in names), default=0.0) / 100 if k else 0.0
        yield batch.map(known).fillna(0.0).astype("float64")


def _folded() -> dict[str, list[str]]:
    return {f: [" ".join(extract._plain(n).replace("_", " ").split()) for n in names] for f, names in ALIASES.items()}


def header_rows(cells: DataFrame) -> DataFrame:
    """(sheet, header): the header row of every sheet of cells (sheet, row, col, value, is_text), rows counted from 0.

    Of the first ``HEADER_ROWS`` rows: the one whose cells are most like known headers; else the first with two filled
    cells or more that are mostly text; else the first that is not empty.
    """
    top = cells.filter((F.col("row") < HEADER_ROWS) & (F.coalesce("value", F.lit("")) != ""))
    scored = top.withColumn("score", alias_score(T.ascii_key(F.trim("value"))))
    text = F.avg(F.col("is_text").cast("int"))
    strong = F.count_if(F.col("score") >= LEAST_HEADER)
    rows = scored.groupBy("sheet", "row").agg(F.count(F.lit(1)).alias("n"), text.alias("text"), strong.alias("strong"), (2.0 * strong + F.sum("score") + text).alias("score"))
    best = F.max(F.when(F.col("strong") > 0, F.struct("score", (-F.col("row")).alias("early"))))
    fallback = F.min(F.when((F.col("n") >= 2) & (F.col("text") >= LEAST_TEXT), F.col("row")))
    return rows.groupBy("sheet").agg(F.coalesce(-best["early"], fallback, F.min("row")).alias("header"))


def value_scores(cells: DataFrame) -> DataFrame:
    """(sheet, col, scores map<field,double>): the share of the first ``SAMPLED_VALUES`` filled values that look like a field's.

    A person's name is two to seven words of letters, without digits, and not all capitals.
    """
    v = F.trim("value")
    nth = F.row_number().over(Window.partitionBy("sheet", "col").orderBy("row"))
    first = cells.filter(F.coalesce(v, F.lit("")) != "").withColumn("nth", nth).filter(F.col("nth") <= SAMPLED_VALUES).withColumn("v", v)
    c, words = F.col("v"), F.split("v", r"\s+")
    name = F.size(words).between(*NAME_WORDS) & ~c.rlike(r"\p{Nd}") & c.rlike(r"\p{Ll}") & F.forall(words, lambda w: w.rlike(NAME_WORD))
    looks = {
        "subject_code": c.rlike(CODE),
        "birth_year": c.rlike(YEAR),
        "as_of_date": c.rlike(DAY),
        "unit_name": c.rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}_]){extract._PREFIX}(?![\p{{L}}\p{{N}}_])"),
        "subject_name": name,
    }
    shares = [x for f, test in looks.items() for x in (F.lit(f), F.avg(test.cast("int")))]
    return first.groupBy("sheet", "col").agg(F.create_map(*shares).alias("scores"))


@F.pandas_udf(ArrayType(DoubleType()))
def _field_similarity(keys: pd.Series) -> pd.Series:
    """Similarity to each field's aliases, 0 to 1, in the order of ``ALIASES``."""
    names = list(_folded().values())
    known = {k: [max(similarity.ratio(k, a) for a in ns) / 100 for ns in names] for k in set(keys.dropna())}
    return keys.map(lambda k: known.get(k, [0.0] * len(names)))


def infer_mapping(headers: DataFrame, cells: DataFrame) -> DataFrame:
    """Field of every column of headers (sheet, col, header) by its name and its values, cells (sheet, row, col, value) below it.

    Returns sheet, col, header, field (null if undecided), confidence, header_score, value_score, exclusive. Columns are
    judged from left to right: a column does not take the field of an earlier one that is filled in a row where
    it is filled too; if they are never filled together, both may have it.
    """
    below = value_scores(cells)
    scored = headers.join(below, ["sheet", "col"], "left").withColumn("a", _field_similarity(T.ascii_key(F.col("header"))))
    options = []
    for k, f in enumerate(ALIASES):
        a, v = F.col("a")[k], F.coalesce(F.col("scores")[f], F.lit(0.0))
        options.append(F.struct(F.greatest(a, 0.75 * a + 0.25 * v, v * 0.92).alias("score"), F.lit(f).alias("field"), a.alias("alias"), v.alias("value")))
    best = scored.select("sheet", "col", "header", F.array_max(F.array(*options)).alias("b"))
    filled = cells.filter(F.coalesce("value", F.lit("")) != "").select("sheet", "row", "col")
    named = filled.join(best.select("sheet", "col", F.col("b.field").alias("f")), ["sheet", "col"])
    # columns of one field that are filled in one row: a sheet has tens of columns, so tens of pairs a row at most
    clash = named.alias("x").join(named.alias("y"), (F.col("x.sheet") == F.col("y.sheet")) & (F.col("x.row") == F.col("y.row")) & (F.col("x.f") == F.col("y.f")) & (F.col("x.col") > F.col("y.col")))
    clash = clash.groupBy(F.col("x.sheet").alias("sheet"), F.col("x.col").alias("col")).agg(F.collect_set("y.col").alias("clash"))
    none = F.array().cast(f"array<{headers.schema['col'].dataType.simpleString()}>")
    ordered = best.join(clash, ["sheet", "col"], "left").withColumn("clash", F.coalesce("clash", none))
    rows = ordered.groupBy("sheet", F.col("b.field").alias("f")).agg(F.array_sort(F.collect_list(F.struct("col", "header", "b", "clash"))).alias("cs"))

    def step(state: Column, c: Column) -> Column:
        met = F.arrays_overlap(c["clash"], state["taken"])
        takes = (c["b"]["score"] >= ACCEPT) & ~met
        out = F.struct(
            c["col"].alias("col"), c["header"].alias("header"), F.when(takes, c["b"]["field"]).alias("field"), F.bround(F.when(met, F.least(c["b"]["score"], F.lit(ACCEPT))).otherwise(c["b"]["score"]), 4).alias("confidence"),
            F.bround(c["b"]["alias"], 4).alias("header_score"), F.bround(c["b"]["value"], 4).alias("value_score"), ((F.size(state["taken"]) > 0) & ~met).alias("exclusive"),
        )
        return F.struct(F.when(takes, F.concat(state["taken"], F.array(c["col"]))).otherwise(state["taken"]).alias("taken"), F.concat(state["out"], F.array(out)).alias("out"))

    col_type = headers.schema["col"].dataType.simpleString()
    shape = f"array<struct<col:{col_type},header:string,field:string,confidence:double,header_score:double,value_score:double,exclusive:boolean>>"
    start = F.struct(none.alias("taken"), F.array().cast(shape).alias("out"))
    return rows.select("sheet", F.explode(F.aggregate("cs", start, step)["out"]).alias("o")).select("sheet", "o.*")


def records(cells: DataFrame, header: DataFrame, mapping: DataFrame) -> DataFrame:
    """(sheet, row, values map<field,string>) of the rows below each sheet's header; rows without any value give none.

    Rows keep their number in the sheet, blank rows counted.
    """
    below = cells.join(header, "sheet").filter((F.col("row") > F.col("header")) & (F.coalesce("value", F.lit("")) != "")).drop("header")
    fields = below.join(mapping.filter("field is not null").select("sheet", "col", "field"), ["sheet", "col"], "left")
    kept = F.filter(F.array_sort(F.collect_list(F.struct("col", "field", "value"))), lambda x: x["field"].isNotNull())
    grouped = fields.groupBy("sheet", "row").agg(kept.alias("kept"))
    # of columns that exclude each other the first filled one counts
    first = F.array_distinct(F.transform("kept", lambda x: x["field"]))
    value = lambda f: F.element_at(F.filter("kept", lambda x: x["field"] == f), 1)["value"]
    return grouped.select("sheet", "row", F.map_from_arrays(first, F.transform(first, value)).alias("values"))


def mapping_violations(headers: DataFrame, mapping: DataFrame) -> DataFrame:
    """(sheet, rule, item) of a mapping (sheet, header, field) that an operator gave for headers (sheet, col, header).

    NO_SUCH_COLUMN: the sheet has no such header; NO_SUCH_FIELD: nothing is known by that name; FIELD_TWICE: two columns of a
    sheet claim a field. Columns without a field claim none. A mapping without rows here is good.
    """
    asked = mapping.select("sheet", "header", T.first_present(F.col("field")).alias("field")).distinct()
    named = headers.select("sheet", "header").distinct()
    claims = asked.filter("field is not null")
    rule = lambda rows, name, item: rows.select("sheet", F.lit(name).alias("rule"), F.col(item).alias("item"))
    absent = rule(asked.join(named, ["sheet", "header"], "left_anti"), "NO_SUCH_COLUMN", "header")
    unknown = rule(claims.filter(~F.col("field").isin(*ALIASES)), "NO_SUCH_FIELD", "field")
    twice = rule(claims.groupBy("sheet", "field").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "FIELD_TWICE", "field")
    return absent.unionByName(unknown).unionByName(twice).distinct()


def given_mapping(headers: DataFrame, mapping: DataFrame) -> DataFrame:
    """The given field of every column (sheet, col, header, field), null where none was given; meant for a mapping without violations."""
    return headers.join(mapping.select("sheet", "header", T.first_present(F.col("field")).alias("field")), ["sheet", "header"], "left").select("sheet", "col", "header", "field")
