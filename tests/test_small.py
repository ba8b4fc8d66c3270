"""Noise, annotations, metrics, uploads, redaction and the registry's life against worked cases."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from dossierlake.functions import records as R
from dossierlake.functions import text as T
from dossierlake.operators import metrics, registry, synthetic


def column(spark, values, kind, expr):
    frame = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r["x"] for r in frame.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def edit(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(cur[-1] + 1, prev[j] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_word_errors(spark):
    rnd = random.Random(2)
    words = ["cục", "công", "an", "xã", "b", "ő"]
    pairs = [(" ".join(rnd.choices(words, k=rnd.randrange(9))), "  ".join(rnd.choices(words, k=rnd.randrange(9)))) for _ in range(60)]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = [r["x"] for r in frame.select("i", metrics.word_error_rate(F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()]
    for (a, b), x in zip(pairs, got):
        t = a.split()
        assert x == pytest.approx(edit(t, b.split()) / len(t) if t else float(bool(b.split())))


def test_reading_scores(spark):
    rows = [("a", "Cục ăn", "Cuc ăn", 1.0), ("a", "xe", "xe", 3.0), ("b", "", "x", 1.0), ("b", None, "x", 9.0)]
    got = {r["engine"]: r for r in metrics.reading_scores(spark.createDataFrame(rows, "engine string, truth string, text string, seconds double")).collect()}
    assert got["a"]["samples"] == 2 and got["a"]["cer"] == pytest.approx(1 / 12) and got["a"]["wer"] == pytest.approx(0.25) and got["a"]["diacritic_accuracy"] == pytest.approx(0.75) and got["a"]["seconds"] == 2
    assert got["b"]["samples"] == 1 and got["b"]["cer"] == 1 and got["b"]["diacritic_accuracy"] == 1


def test_letters_are_ranges_and_read_once(spark):
    letters = metrics.MARKED + metrics.MARKED.upper()
    parts = metrics._ranges(letters)
    assert {c for c in map(chr, range(0x20, 0x3000)) if c in letters} == {c for c in map(chr, range(0x20, 0x3000)) if __import__("re").match(f"[{parts}]", c)}
    assert len(parts) < len(letters) / 2
    frame = spark.createDataFrame([("Cục ăn",)], "t string").select(metrics.diacritic_accuracy(F.col("t"), T.strip_marks(F.col("t"))).alias("a"))
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1 and frame.first()["a"] == 0.0


def test_empty_passages_have_an_error_rate(spark, tmp_path):
    from dossierlake.plans.base import QUERIES
    from dossierlake.plans import extraction  # noqa: F401

    spark.createDataFrame([(1, "ease"), (2, ""), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r["item_id"]: r["cer"] for r in QUERIES["f7_cer"](spark, str(tmp_path)).collect()} == {1: 0.5, 2: 0.0, 3: None}


def test_entities_end_with_a_semicolon(spark):
    from dossierlake.operators.documents import html_title

    titles = ["<title>a &amp; b &#39;c&#x41; &amp;&amp</title>", "<title>&amp;lt; &nosuch; &notit;</title>", "<title>x</title>"]
    assert column(spark, titles, "string", html_title) == ["a & b 'cA &&amp", "&lt; &nosuch; &notit;", "x"]


def test_micro_f1(spark):
    rows = [("PERSON", "An  Bình", "an bình", None), ("POSITION", None, "Phó", None), ("POSITION", "x", None, None), ("UNIT", "Cục A", "Cục A", 0.9), ("UNIT", "Cục B", "Cục B", 0.62), ("UNIT", "Cục C", "Cục D", 0.9)]
    r = metrics.micro_f1(spark.createDataFrame(rows, "field string, predicted string, gold string, confidence double")).first()
    p, q = 3 / 4, 3 / 5
    assert r["entity_f1"] == pytest.approx(2 * p * q / (p + q)) and r["relation_f1"] == pytest.approx(2 / 6)


def test_noise(spark):
    names = ["Công an tỉnh Hà Nam", "Bệnh viện 108", "12", "arnold clan"]
    assert column(spark, names, "string", synthetic.acronym) == ["CATHN", "BV1", "1", "AC"]
    assert column(spark, names, "string", synthetic.ocr_like) == ["Cong an tinh Ha Nam", "Benh vien 108", "12", "amold dan"]
    for s in "abcdefgh":
        for name, got in zip(names, column(spark, names, "string", lambda c: synthetic.typo(c, F.lit(s)))):
            assert got == name if name == "12" else edit(name, got) in (0, 1, 2) and abs(len(got) - len(name)) <= 1


def test_variants(spark):
    assert column(spark, ["Công an-xã A B", "X", "  ", None], "string", T.mention_variants) == [
        ["Công an-xã A B", "Cong an-xa A B", "công an-xã a b", "Công an xã A B", "A B", "B", "Công an-xã A", "Công an-xã", "Công anxã A B"], ["X", "x"], [], []
    ]


def test_annotations(spark):
    rows = [(1, "An là Phó tại Cục A", "An", "C1", "Phó", "Cục A", None), (2, "không", "An", None, None, "", "x")]
    got = {r["record_id"]: r for r in synthetic.annotate(spark.createDataFrame(rows, "record_id int, text string, person string, code string, position string, current string, former string")).collect()}
    assert [(e["role"], e["start"], e["end"]) for e in got[1]["entities"]] == [("person", 0, 2), ("position", 6, 9), ("current", 14, 19)]
    assert [tuple(r) for r in got[1]["relations"]] == [("CURRENT_WORK_UNIT", 0, 2), ("HAS_POSITION", 0, 1)] and not got[2]["entities"] and not got[2]["relations"]


def test_generation(spark):
    units = spark.createDataFrame([(i, f"Cục số {i}", "BCA" if i % 2 else "OTHER") for i in range(40)], "unit_id long, name string, org string")
    rows = synthetic.generate(units, 5, {"NONE": 1, "TYPO_UNIT": 1, "NO_ACCENT": 1}, 0.4, "2025-01-01", None)
    got, again = rows.toPandas(), synthetic.generate(units.repartition(7), 5, {"NONE": 1, "TYPO_UNIT": 1, "NO_ACCENT": 1}, 0.4, "2025-01-01", None).toPandas()
    assert len(got) == 200 and got.historic.sum() == 80 and set(got.noise_type) == {"NONE", "TYPO_UNIT", "NO_ACCENT"} and set(got.split) >= {"train", "test"}
    assert sorted(got.raw_text) == sorted(again.raw_text)
    assert {r["gate"]: r["violations"] for r in synthetic.gates(rows).collect()} == {"duplicate_record_id": 0, "split_leakage": 0, "not_found_is_not_other": 0}
    assert all(unicodedata.normalize("NFD", t).isascii() or n != "NO_ACCENT" for t, n in zip(got.raw_text, got.noise_type))


def test_uploads(spark):
    files = [b"%PDF-1.7", b"\x89PNG\r\n\x1a\nx", b"\xff\xd8\xff\xe0", b"PK\x03\x04..word/document.xml", b"PK\x03\x04xl/workbook.xml", b"PK\x03\x04", bytes.fromhex("D0CF11E0A1B11AE1"), "chữ".encode(), b"a\x00b", b"\xff\xfe", b""]
    kinds = column(spark, files, "binary", R.file_kind)
    assert kinds == ["pdf", "png", "jpeg", "docx", "xlsx", "zip", "xls", "text", "unknown", "unknown", "text"]
    frame = spark.createDataFrame([("a.PDF", b"%PDF-1"), ("a.exe", b"x"), ("a.csv", b"%PDF-1"), ("a.csv", b"x,y"), ("noext", b"x")], "n string, c binary")
    assert [r[0] for r in frame.select(R.upload_error(F.col("n"), F.col("c"))).collect()] == [None, "UNSUPPORTED_EXTENSION", "SIGNATURE_MISMATCH", None, "UNSUPPORTED_EXTENSION"]


def test_redaction(spark):
    kind = "struct<user:string,Password:string,deep:array<map<string,string>>,token:int>"
    frame = spark.createDataFrame([(("u", "p", [{"a": "1", "Secret": "2"}], 5),), (None,)], f"v {kind}")
    got = frame.select(R.redacted(F.col("v"), frame.schema["v"].dataType).alias("v")).collect()
    assert got[0]["v"].asDict() == {"user": "u", "Password": "***", "deep": [{"a": "1", "Secret": "***"}], "token": None} and got[1]["v"] is None


def test_registry_life(spark):
    versions = spark.createDataFrame([("v1", "PUBLISHED", 1), ("v2", "APPROVED", None), ("v3", "DRAFT", None), ("v4", "DRAFT", None), ("v5", "VALIDATED", None)], "version string, status string, published_at int")
    asked = spark.createDataFrame([("v2", "publish"), ("v3", "validate"), ("v4", "validate"), ("v5", "publish"), ("v1", "sing")], "version string, step string")
    errors = spark.createDataFrame([("v4", "x"), ("v4", "y")], "version string, error string")
    got = {r["version"]: tuple(r)[1:] for r in registry.advance(versions, asked, errors, F.lit(9)).collect()}
    assert got == {"v1": ("DEPRECATED", 1, "UNKNOWN_STEP"), "v2": ("PUBLISHED", 9, None), "v3": ("VALIDATED", None, None), "v4": ("DRAFT", None, "INVALID_SNAPSHOT"), "v5": ("VALIDATED", None, "WRONG_STATUS")}
    snap = spark.createDataFrame([("v1", 1, "a", "k", "s", None, None, "k"), ("v1", 2, "a", "k", "", "2025-01-02", "2025-01-01", "k"), ("v2", 3, "a", "z", "s", None, None, "z")], "version string, unit_id int, org string, key string, source_id string, valid_from string, valid_to string, ascii_key string")
    units = spark.createDataFrame([(1, "APPROVED"), (2, "APPROVED"), (3, "PENDING_QA")], "unit_id int, qa_status string")
    assert {tuple(r) for r in registry.snapshot_errors(snap, units).collect()} == {("v1", "duplicate_normalized_unit:a:k"), ("v1", "unit_missing_source:2"), ("v1", "invalid_validity:2"), ("v2", "unit_not_approved:3")}
    after, rows = registry.rollback(versions, snap, "v1", "v9", F.lit(10))
    assert {r["version"]: r["status"] for r in after.collect()} == {"v1": "DEPRECATED", "v2": "APPROVED", "v3": "DRAFT", "v4": "DRAFT", "v5": "VALIDATED", "v9": "PUBLISHED"}
    assert {(r["unit_id"], r["ascii_key"]) for r in rows.filter("version = 'v9'").collect()} == {(1, None), (2, None)}
    assert registry.latest_published(after).first()["version"] == "v9" and registry.rollback(versions, snap, "nope", "v9", F.lit(1))[0].count() == 5


def test_small_expressions(spark):
    assert column(spark, ["#HS-2025-AB12 ", "case_9", " x "], "string", R.search_fragment) == ["AB12", "case_9", "x"]
    assert column(spark, ["http://a.gov.vn/x", "https://gov.vn", "http://agov.vn", None, "::"], "string", lambda c: R.host_allowed(c, ["gov.vn"])) == [True, True, False, False, False]
    assert column(spark, ["1945-09-01", "1945-09-02", "2027-01-02", "2027-01-03", None], "string", lambda c: R.business_date(c.cast("date"), F.lit("2026-01-01").cast("date"))) == [False, True, True, False, True]
