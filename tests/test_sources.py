"""Sources and sinks: files written here and read back."""

import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from dossierlake.sources import tables as S


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,tên\n1,\"x, \"\"y\"\"\nz\"\n2,\n".encode())
    got = S.read_csv(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["id", "tên"] and rows(got) == [("1", 'x, "y"\nz'), ("2", "")]


@pytest.mark.parametrize("text,sep", [("a;b;c\n1,5;2;3\n2,5;1;1\n", ";"), ("a\tb\nx, y, z\tq\n", "\t"), ("one\ntwo\n", ","), ("", ","), ("a|b\n1|2", "|"), ("a,b;c\n1,2;3\n", ",")])
def test_sniffing(spark, tmp_path, text, sep):
    (tmp_path / "x.csv").write_text(text)
    assert S.sniff_separator(spark, str(tmp_path / "x.csv")) == sep


def test_sniffed_limit(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a;b\n" + "1;2\n" * 5)
    assert S.read_sniffed(spark, str(tmp_path / "x.csv"), 5).count() == 5
    with pytest.raises(ValueError):
        S.read_sniffed(spark, str(tmp_path / "x.csv"), 4)


def test_files_of_different_separators(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;n\n1;x,y\n")
    (tmp_path / "b.csv").write_text("id|m\n2|z\n" * 1)
    (tmp_path / "c.csv").write_text("id;n\n" + "3;" + "w" * 3 * S.SNIFFED + "\n")
    assert {r["path"][-5:]: r["sep"] for r in S.sniff_separators(spark, str(tmp_path)).collect()} == {"a.csv": ";", "b.csv": "|", "c.csv": ";"}
    got = S.read_sniffed(spark, str(tmp_path))
    assert rows(got.select("id", "n", "m").withColumn("n", F.substring("n", 1, 3))) == [("1", "x,y", ""), ("2", "", "z"), ("3", "www", "")]
    with pytest.raises(ValueError):
        S.sniff_separator(spark, str(tmp_path))


def test_texts_and_config(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfh\xc3\xa9\xff")
    assert [r["text"] for r in S.read_texts(spark, str(tmp_path / "a.txt")).collect()] == ["hé�"]
    (tmp_path / "c.json").write_text('{"a": [1]}')
    assert S.read_config(spark, str(tmp_path / "c.json")) == {"a": [1]}


def workbook(sheets):
    out = io.BytesIO()
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        # the files' names do not follow the sheets' order
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{9 - k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Họ tên</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>")
        for k, body in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{9 - k}.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    one = '<row><c r="A1" t="s"><v>0</v></c><c r="AB1"><v>7</v></c></row><row><c r="B3" t="s"><v>1</v></c><c r="C3" t="inlineStr"><is><t>in</t></is></c><c r="D3"/></row>'
    (tmp_path / "a.xlsx").write_bytes(workbook({"First": one, "Second": '<row><c r="A1"><v>1</v></c></row>'}))
    (tmp_path / "b.xlsx").write_bytes(workbook({"Only": '<row><c r="A1"><v>1</v></c></row>'}))
    (tmp_path / "c.xlsx").write_bytes(b"no workbook")
    cells = S.read_xlsx(spark, str(tmp_path))
    got = {(r["path"][-6:], r["sheet"], r["row"], r["col"]): (r["value"], r["is_text"]) for r in cells.collect()}
    assert got == {("a.xlsx", "First", 0, 0): ("Họ tên", True), ("a.xlsx", "First", 0, 27): ("7", False), ("a.xlsx", "First", 2, 1): ("ab", True), ("a.xlsx", "First", 2, 2): ("in", True), ("a.xlsx", "Second", 0, 0): ("1", False), ("b.xlsx", "Only", 0, 0): ("1", False)}
    kept = S.list_sheets(cells, F.col("value") == "Họ tên").select("sheet").distinct()
    assert rows(kept) == [("First",), ("Only",)]


def test_workbook_limits(spark, tmp_path, monkeypatch):
    row = "".join(f'<row><c r="A{k}"><v>{k}</v></c></row>' for k in range(1, 4))
    with zipfile.ZipFile(io.BytesIO(workbook({"a": row, "b": row}))) as z:
        assert [n for n, _ in S._sheets(z)] == ["a", "b"]
        monkeypatch.setattr(S, "MAX_SHEETS", 1)
        with pytest.raises(S.WorkbookLimit):
            S._sheets(z)
    monkeypatch.setattr(S, "MAX_SHEETS", 2)
    monkeypatch.setattr(S, "MAX_ROWS", 5)  # rows count over all sheets
    with pytest.raises(S.WorkbookLimit):
        list(S._workbook(workbook({"a": row, "b": row})))
    monkeypatch.setattr(S, "MAX_ROWS", 6)
    assert len(list(S._workbook(workbook({"a": row, "b": row})))) == 6


def test_docx(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p('one')}<w:tbl><w:tr><w:tc>{p('x')}{p('y')}</w:tc><w:tc>{p('z')}</w:tc></w:tr></w:tbl>{p('two')}</w:body></w:document>")
    paragraphs, cells = S.read_docx(spark, str(tmp_path))
    assert rows(paragraphs.select("nth", "text")) == [(0, "one"), (1, "two")] and rows(cells.select("table", "row", "col", "content")) == [(0, 0, 0, "x\ny"), (0, 0, 1, "z")]


def test_roster(spark, tmp_path):
    raw = "canonical_name,qa_status\n Cục A ,APPROVED\n ,\nCục B,\n".encode()
    (tmp_path / "r.csv").write_bytes(raw)
    got = S.read_roster(spark, str(tmp_path / "r.csv"))
    assert rows(got.select("canonical_name", "qa_status", "source_sha256")) == [(n, "PENDING_QA", hashlib.sha256(raw).hexdigest()) for n in ("Cục A", "Cục B")]
    with pytest.raises(ValueError):
        S.read_roster(spark, str(tmp_path / "r.csv"), "nothing")
    more = "canonical_name\nCục C\n".encode()
    (tmp_path / "s t+%.csv").write_bytes(more)
    both = S.read_roster(spark, str(tmp_path))
    assert rows(both.select("canonical_name", "source_sha256")) == [("Cục A", hashlib.sha256(raw).hexdigest()), ("Cục B", hashlib.sha256(raw).hexdigest()), ("Cục C", hashlib.sha256(more).hexdigest())]


def test_saved_pages_and_reports(spark, tmp_path):
    for k in (2, 10, 1):
        (tmp_path / f"page_{k}.json").write_text(json.dumps({"url": f"u{k}", "links": []}))
    assert [r["url"] for r in S.read_saved_pages(spark, str(tmp_path)).orderBy("nth").collect()] == ["u1", "u2", "u10"]
    S.write_report(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"), "coverage")
    assert spark.read.json(str(tmp_path / "out" / "coverage")).select("a").first()["a"] == 1


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string")
    new = spark.createDataFrame([("b", "9"), ("c", "3"), ("c", "4")], "k string, v string")
    S.publish_csv(old, new, ["k"], "v", str(tmp_path / "pub"))
    assert rows(S.read_csv(spark, str(tmp_path / "pub"))) == [("a", "1"), ("b", "2"), ("c", "3")]
    assert rows(S.latest_wins(old, new.filter("v <> '4'"), ["k"])) == [("a", "1"), ("b", "9"), ("c", "3")]
    table = str(tmp_path / "t")
    S.replace_partitions(old, table, "k")
    S.replace_partitions(new.filter("k = 'b'"), table, "k")
    assert rows(spark.read.parquet(table).select("k", "v")) == [("a", "1"), ("b", "9")]
    good = S.split_failures(spark.createDataFrame([(1, None), (2, "bad")], "id int, error string"), "error", str(tmp_path / "dlq"))
    S.append_only(spark.createDataFrame([(3, "worse")], "id int, error string"), str(tmp_path / "dlq"))
    assert rows(good) == [(1,)] and rows(spark.read.parquet(str(tmp_path / "dlq"))) == [(2, "bad"), (3, "worse")]
    S.write_records(old, old, new, str(tmp_path / "w"))
    assert rows(spark.read.json(str(tmp_path / "w/relations"))) == rows(new)
    S.write_texts(spark.createDataFrame([(1, "x"), (2, None)], "doc_id int, text string"), str(tmp_path / "d"))
    assert rows(spark.read.json(str(tmp_path / "d/manifest")).select("doc_id", "characters")) == [(1, 1), (2, 0)]


def test_written_texts(spark, tmp_path):
    """Many documents take few files, and come back to the character."""
    texts = ["x", None, "", " \ta\r\nb\n\n", '"q" \\ \u2028 ắ 😀', "\ufeffy"] + [f"t{k}\n" for k in range(300)]
    S.write_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2), str(tmp_path / "d"))
    assert {r["doc_id"]: r["text"] for r in S.read_written_texts(spark, str(tmp_path / "d")).collect()} == {k: x or "" for k, x in enumerate(texts)}
    assert len([p for p in (tmp_path / "d" / "documents").rglob("*") if p.suffix == ".json"]) <= 2 and not list((tmp_path / "d" / "documents").rglob("doc_id=*"))


def test_saved_pages(spark, tmp_path):
    """Many pages take few files; a page of several lines, null ones and files of one page are read too."""
    pages = [("u1", "<p>\n\r\n</p>"), ("u2", None), *((f"v{k}", "x") for k in range(200))]
    S.write_saved_pages(spark.createDataFrame(pages, "url string, html string").coalesce(2), str(tmp_path / "p"))
    assert rows(S.read_saved_pages(spark, str(tmp_path / "p"), lines=True).select("url", "html")) == sorted(pages, key=str)
    assert len(list((tmp_path / "p").glob("*.json"))) <= 2


def test_seed_counters(spark):
    people = spark.createDataFrame([("SYNTHETIC_DEMO", 1, "A"), ("SYNTHETIC_DEMO", 9, "B"), ("SYNTHETIC_DEMO", 1, " "), ("ROSTER", 1, "C"), (None, None, None)], "source_kind string, unit_id int, name string")
    assert rows(S.seed_counters(people, spark.createDataFrame([(1,)], "unit_id int"))) == [(1, 1, 2, 1)]


def test_safe_key(spark):
    frame = spark.createDataFrame([("../../a b/ç.txt",)], "s string")
    assert frame.select(S.safe_key(F.col("s"))).first()[0] == "././a_b/_.txt"


def test_sheets_go_on_in_further_workbooks(spark, monkeypatch):
    """A workbook is bounded however many rows a sheet has: its cells are those of one workbook."""
    from dossierlake.plans import files
    from dossierlake.plans.base import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    cells = lambda: sorted(map(tuple, files._nation_cells(t).collect()))
    whole = cells()
    assert len(whole) == 2 * t.customer.count()
    monkeypatch.setattr(files, "SHEET_ROWS", 2)
    made = files._workbooks(t).select("path").collect()
    assert len(made) > len({r["path"].split("/")[0] for r in made}) and cells() == whole


def test_grids_are_dealt(spark):
    """A table of one split is read by all cores."""
    from dossierlake.catalog import queries

    plan = queries()["f30_grid"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan.split("ArrowEvalPython")[1]
