"""Header rows, mappings and records of bulk lists against worked cases."""

from dossierlake.operators import bulk


def sheet(spark, grids):
    rows = [(name, r, c, v, not isinstance(v, (int, float))) for name, grid in grids.items() for r, line in enumerate(grid) for c, v in enumerate(line)]
    return spark.createDataFrame([(s, r, c, None if v is None else str(v), t) for s, r, c, v, t in rows], "sheet string, row int, col int, value string, is_text boolean")


GRIDS = {
    "a": [["Danh sách", None], ["Thông tin cá nhân", "Công tác"], ["Họ và tên", "CCCD", "Đơn vị công tác", "source_kind"], ["Nguyễn Minh An", "123456789", "Cục A", "SYNTHETIC_DEMO"], [None, None, None, None], ["Trần Bình", "123456789012", "Công an B", "SYNTHETIC_DEMO"]],
    "b": [[None, None], [1, 2], ["alpha", "beta"], ["x", 3]],
    "c": [[None], [7], [8]],
    "d": [["Họ tên", "Full name", "birth"], ["An Bình", None, "1990"], [None, "Lê Ca", "1985"]],
    "e": [["Họ tên", "Full name"], ["An Bình", "An Bình"]],
}


def test_header_rows(spark):
    got = {r["sheet"]: r["header"] for r in bulk.header_rows(sheet(spark, GRIDS)).collect()}
    assert got == {"a": 2, "b": 2, "c": 1, "d": 0, "e": 0}


def test_mapping_and_records(spark):
    cells = sheet(spark, GRIDS)
    header = bulk.header_rows(cells)
    top = cells.join(header, "sheet").filter("row = header").selectExpr("sheet", "col", "value as header")
    below = cells.join(header, "sheet").filter("row > header").drop("header")
    mapping = bulk.infer_mapping(top, below)
    got = {(r["sheet"], r["header"]): r for r in mapping.collect()}
    assert {h: got["a", h]["field"] for h in ("Họ và tên", "CCCD", "Đơn vị công tác", "source_kind")} == {"Họ và tên": "subject_name", "CCCD": "subject_code", "Đơn vị công tác": "unit_name", "source_kind": None}
    assert got["d", "Họ tên"]["field"] == got["d", "Full name"]["field"] == "subject_name" and got["d", "Full name"]["exclusive"]
    assert got["e", "Họ tên"]["field"] == "subject_name" and got["e", "Full name"]["field"] is None and got["e", "Full name"]["confidence"] == 0.6
    rows = {(r["sheet"], r["row"]): r["values"] for r in bulk.records(cells, header, mapping).collect()}
    assert rows["a", 5] == {"subject_name": "Trần Bình", "subject_code": "123456789012", "unit_name": "Công an B"} and ("a", 4) not in rows
    assert rows["d", 2]["subject_name"] == "Lê Ca"


def test_given_mappings(spark):
    headers = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "x"), ("c", 0, "x")], "sheet string, col int, header string")
    given = spark.createDataFrame([("a", "x", "position"), ("a", "y", ""), ("b", "z", "nothing"), ("b", "x", "position"), ("b", "y", "position"), ("b", "y", "position")], "sheet string, header string, field string")
    found = sorted(map(tuple, bulk.mapping_violations(headers, given).collect()))
    assert found == [("b", "FIELD_TWICE", "position"), ("b", "NO_SUCH_COLUMN", "y"), ("b", "NO_SUCH_COLUMN", "z"), ("b", "NO_SUCH_FIELD", "nothing")]
    whole = {(r["sheet"], r["header"]): r["field"] for r in bulk.given_mapping(headers, given.filter("sheet = 'a'")).collect()}
    assert whole == {("a", "x"): "position", ("a", "y"): None, ("b", "x"): None, ("c", "x"): None}
    assert bulk.mapping_violations(headers, given.limit(0)).count() == 0
