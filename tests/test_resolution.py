"""Decision tables of resolution, registry and bulk rows."""

import unicodedata

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dossierlake.functions import similarity
from dossierlake.functions import text as T
from dossierlake.operators import decide, documents, registry, resolve


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_keys(spark):
    df = spark.createDataFrame([("  BỆNH-VIỆN   108  ",), ("Cục Kỹ thuật",), ("Straße–Ost",), (None,), ("",)], "s string")
    got = rows(df.select(T.normalize_text(F.col("s")), T.ascii_key(F.col("s"))))
    assert got == [("bệnh viện 108", "benh vien 108"), ("cục kỹ thuật", "cuc ky thuat"), ("strasse ost", "strasse ost"), (None, None), ("", "")]


def test_composed_intake(spark):
    apart = unicodedata.normalize("NFD", "Cục Kỹ thuật")
    df = spark.createDataFrame([(apart,), ("a",), (None,)], "s string")
    assert [r[0] for r in df.select(T.normalize_text(T.composed(F.col("s")))).collect()] == ["cục kỹ thuật", "a", None]


def test_tiers(spark):
    units = spark.createDataFrame([(1, "Bệnh viện Trung ương"), (2, "Cục Kỹ thuật"), (3, "Công an xã Phú Hữu"), (4, "Công an xã Phú Hựu")], "unit_id long, name string")
    aliases = spark.createDataFrame([(1, "Bệnh viện 108")], "unit_id long, name string")
    mentions = spark.createDataFrame([(1, "  BỆNH-VIỆN   108  "), (2, "Cuc Ky thuat"), (3, "Cong an xa Phu Huu"), (4, "Công an xã Phú Hữu"), (5, "nowhere"), (6, None)], "mention_id long, name string")
    got = {r[0]: r[1:] for r in rows(resolve.exact_tiers(mentions, resolve.surface_forms(units, aliases)).select("mention_id", "tier", "n_units", "unit_id"))}
    assert got == {1: (2, 1, 1), 2: (3, 1, 2), 3: (3, 2, None), 4: (1, 1, 3), 5: (None, None, None), 6: (None, None, None)}


def test_unit_decision(spark):
    schema = "name string, code_unit long, n_units long, tier int, unit_id long, top_unit long, fuzzy double, margin double, ranked_status string"
    df = spark.createDataFrame([("a", 1, 1, 1, 2, None, None, None, None), ("a", None, 2, 1, None, None, None, None, None), ("a", 5, 2, 1, None, None, None, None, None), ("b", 1, None, None, None, 2, 98.0, 11.0, None), (" ", None, None, None, None, None, None, None, "MATCHED"), ("c", None, None, None, None, 9, 80.0, 1.0, "AMBIGUOUS")], schema)
    assert [r[0] for r in rows(resolve.decide_unit(df).select("status"))] == ["CONFLICT", "AMBIGUOUS", "MATCHED", "CONFLICT", "NOT_FOUND", "AMBIGUOUS"]


@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert similarity.lcs(a, b) == table[-1][-1]


def test_folding_covers_marks():
    marked, plain = T._folding()
    assert len(marked) == len(plain) > 400 and all(unicodedata.category(c) != "Mn" for c in plain)


def test_policies(spark):
    cases = spark.createDataFrame([(1, "2025-06-01", "CAND", {"a": "x"}), (2, "2025-06-01", "CAND", {"a": ""}), (3, "2024-01-01", "CAND", {"a": "x"}), (4, "2025-06-01", None, {"a": "x"})], "case_id int, day string, subject_group string, facts map<string,string>").withColumn("day", F.col("day").cast("date"))
    rules = spark.createDataFrame([(1, ["CAND"], ["a"], "2025-01-01", None, True), (2, [], [], None, None, True)], "rule_id int, groups array<string>, required array<string>, f string, u string, active boolean")
    rules = rules.select("rule_id", "groups", "required", F.col("f").cast("date").alias("effective_from"), F.col("u").cast("date").alias("effective_to"), "active")
    got = {(r[0], r[1]): r[2] for r in rows(decide.evaluate_policies(cases, rules))}
    assert got[1, 1] == "ELIGIBLE" and got[2, 1] == "INSUFFICIENT_DATA" and (3, 1) not in got and got[4, 1] == "INSUFFICIENT_DATA" and got[1, 2] == "NOT_APPLICABLE"


def test_subject_groups(spark):
    cases = [
        ("BCA", "Sĩ quan công an", None, None, "CAND", 0.95), ("BCA", None, "không còn là sĩ quan công an", None, None, 0.0), ("BCA", None, "không phải một chiến sĩ công an; em là chiến sĩ công an", None, "CAND", 0.95),
        ("BQP", None, "đã từng là sĩ quan nhưng nay không còn công tác", None, None, 0.0), ("BQP", None, "từng là sĩ quan, nay là quân nhân", None, "QUAN_NHAN", 0.92), ("BQP", None, "cơ yếu", None, "CO_YEU_HUONG_LUONG_NHU_QUAN_NHAN", 0.9),
        ("OTHER", None, "quân nhân", None, None, 0.0), ("BCA", None, "x", "quan_nhan", "QUAN_NHAN", 1.0), ("BCA", None, "công an nhân dân", "??", None, 0.0), (None, None, None, None, None, 0.0),
    ]
    frame = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, org string, position string, text string, explicit string")
    got = frame.select("i", decide.subject_group(*[F.col(c) for c in ("org", "position", "text", "explicit")]).alias("g")).orderBy("i").collect()
    assert [(r["g"]["subject_group"], r["g"]["confidence"]) for r in got] == [c[4:] for c in cases]


def test_bulk_rows(spark):
    df = spark.createDataFrame([(1, 1, "A", "123456789", "2026-01-02"), (1, 2, "B", "123456789", None), (1, 3, "", "1", None), (1, 4, "C", "123-45", None), (1, 5, "D", "", "2026-99-01")], "job_id int, row_index int, name string, code string, day string")
    out = documents.validate_rows(df)
    assert [r[0] for r in rows(out.orderBy("row_index").select("error"))] == [None, "DUPLICATE", "MISSING_NAME", "BAD_FORMAT_CODE", "BAD_FORMAT_DATE"]
    assert rows(documents.finalise(out).select("total", "ok", "failed", "skipped", "job_status")) == [(5, 1, 3, 1, "COMPLETED_WITH_ERRORS")]


def test_version_diff(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "c", None)], "id int, n string, m string")
    new = spark.createDataFrame([(1, "a", None), (2, "B", None), (4, "d", None)], "id int, n string, m string")
    assert sorted(rows(registry.version_diff(old, new, "id", ["n", "m"]))) == [(2, "CHANGED", "n|m"), (3, "REMOVED", None), (4, "ADDED", None)]


def test_people_of_a_name_are_paired_last(spark):
    """No exchange follows the join of mentions and people; lists of one name are joined with units once; versions of a person count once."""
    import datetime

    from dossierlake.operators import persons

    day = datetime.date(2020, 5, 1)
    people = spark.createDataFrame([(k, "an binh", 1950 + k % 2, k % 3, "ROSTER", None if k else datetime.date(2020, 1, 1), None) for k in (*range(6), 0)], "person_id long, name string, birth_year int, unit_id long, source_kind string, valid_from date, valid_to date")
    mentions = spark.createDataFrame([(k, "AN Binh", None, 1950 if k % 2 else None, None, "unit 1" if k == 3 else None, day) for k in range(4)], "mention_id long, name string, code string, birth_year int, unit_id long, unit_name string, as_of date")
    none, units = people.select("person_id", "name").limit(0), spark.createDataFrame([("unit 0", 0), ("unit 1", 1)], "name string, unit_id long")
    pairs = persons.name_candidates(mentions, people, none)
    plan = pairs._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "Exchange" not in plan.split("Join")[0] and "Aggregate" not in plan.split("Join")[0]
    assert sorted((r["mention_id"], r["person_id"]) for r in pairs.collect()) == [(m, p) for m in range(4) for p in range(6)]
    got = persons.resolve_persons(mentions, people, none, people.select("person_id", persons.F.lit("x").alias("code")), units)
    assert {r["mention_id"]: (r["status"], r["candidates"], r["source_kind"]) for r in got.collect()} == {0: ("AMBIGUOUS", [0, 1, 2, 3, 4, 5], "ROSTER"), 1: ("AMBIGUOUS", [0, 2, 4], "ROSTER"), 2: ("AMBIGUOUS", [0, 1, 2, 3, 4, 5], "ROSTER"), 3: ("MATCHED", [], "ROSTER")}
    shown = {r["mention_id"]: [(c["person_id"], c["unit_name"]) for c in r["candidates"]] for r in persons.with_units(got, people.distinct().dropDuplicates(["person_id"]), units).collect()}
    assert shown[1] == [(0, "unit 0"), (2, None), (4, "unit 1")] and set(shown) == {0, 1, 2}
