"""Decisions of whole cases as a table."""

from pyspark.sql import functions as F

from dossierlake.operators import decide, metrics

BASE = {
    "subject_name": "An", "subject_code": None, "unit_name": "Cục A", "unit_code": None, "name_score": 0.9, "code_score": None, "extraction": 0.9, "relation": 0.9, "parse_confidence": None, "parse_method": None, "parse_gate": None,
    "person_status": "MATCHED", "person_unit": 1, "person_confidence": 0.95, "unit_status": "MATCHED", "unit_id": 1, "unit_confidence": 1.0, "organization": "BCA", "subject_group": "CAND", "warnings": None,
}
TYPES = (
    "subject_name string, subject_code string, unit_name string, unit_code string, name_score double, code_score double, extraction double, relation double, parse_confidence double, parse_method string, parse_gate string, "
    "person_status string, person_unit int, person_confidence double, unit_status string, unit_id int, unit_confidence double, organization string, subject_group string, warnings array<string>"
)
TABLE = [
    ({}, "MATCHED", 0.9, None),
    ({"person_unit": 2}, "CONFLICT", 0.0, "PERSON_UNIT_CONFLICT"),
    ({"person_unit": 2, "warnings": ["ODD", "X"]}, "CONFLICT", 0.0, "ODD"),
    ({"person_unit": None}, "MATCHED", 0.9, None),
    ({"person_status": "AMBIGUOUS", "person_confidence": None}, "UNVERIFIED", 0.0, "PERSON_AMBIGUOUS"),
    ({"unit_status": "CONFLICT", "unit_confidence": 0.0}, "UNVERIFIED", 0.0, "CONFLICT"),
    ({"unit_status": None, "unit_confidence": None}, "UNVERIFIED", 0.0, "NOT_FOUND"),
    ({"organization": "UNKNOWN"}, "MATCHED", 0.9, "ORGANIZATION_TYPE_UNKNOWN"),
    ({"parse_confidence": 0.65}, "MATCHED", 0.9, None),
    ({"parse_confidence": 0.65, "parse_method": "OCR"}, "MATCHED", 0.9, "DOCUMENT_PARSE_LOW_CONFIDENCE"),
    ({"parse_confidence": 0.55}, "MATCHED", 0.9, "DOCUMENT_PARSE_LOW_CONFIDENCE"),
    ({"parse_gate": "fail"}, "MATCHED", 0.9, "DOCUMENT_PARSE_LOW_CONFIDENCE"),
    ({"extraction": 0.74}, "MATCHED", 0.74, "DOCUMENT_EXTRACTION_LOW_CONFIDENCE"),
    ({"relation": 0.69}, "MATCHED", 0.69, "CURRENT_WORK_UNIT_UNCERTAIN"),
    ({"subject_group": None}, "MATCHED", 0.9, "SUBJECT_GROUP_INSUFFICIENT"),
    # a bare name: no unit asserted, no relation due, and what identifies it counts
    ({"unit_name": "", "relation": None, "extraction": 0.1}, "NOT_APPLICABLE", 0.9, None),
    ({"unit_name": None, "subject_code": "1", "code_score": 0.8}, "NOT_APPLICABLE", 0.8, None),
    # a unit's code alone: without a person nothing identifies
    ({"unit_name": None, "unit_code": "U", "subject_name": None, "name_score": None, "person_status": None, "person_confidence": None}, "NOT_APPLICABLE", 0.0, "DOCUMENT_EXTRACTION_LOW_CONFIDENCE"),
    ({"unit_name": None, "unit_code": "U"}, "MATCHED", 0.9, None),
    ({"subject_name": None, "person_status": None, "person_confidence": None}, "NOT_APPLICABLE", 0.9, None),
    ({"subject_group": "POOR"}, "MATCHED", 0.9, "POLICY_INSUFFICIENT_DATA"),
]


def test_decisions(spark):
    names = list(BASE)
    rows = [(i, *[(BASE | change)[n] for n in names]) for i, (change, *_) in enumerate(TABLE)]
    cases = spark.createDataFrame(rows, f"case_id int, {TYPES}").withColumn("day", F.lit("2026-01-01").cast("date")).withColumn("facts", F.create_map(F.lit("a"), F.lit("x")))
    rules = spark.createDataFrame([(1, ["CAND"], ["a"]), (2, ["POOR"], ["b"])], "rule_id int, groups array<string>, required array<string>")
    rules = rules.select("*", *[F.lit(None).cast("date").alias(c) for c in ("effective_from", "effective_to")], F.lit(True).alias("active"))
    got = {r["case_id"]: r for r in decide.decide_cases(cases, rules).collect()}
    assert len(got) == len(TABLE)
    for i, (change, consistency, confidence, reason) in enumerate(TABLE):
        r = got[i]
        assert (r["consistency"], r["decision_confidence"], r["reason"]) == (consistency, confidence, reason), change
        assert r["workflow"] == ("COMPLETED" if reason is None else "NEED_REVIEW")
        asked = reason in (None, "POLICY_INSUFFICIENT_DATA")
        assert [p["rule_id"] for p in r["policies"]] == ([1, 2] if asked else [])
    assert decide.decide_cases(cases.limit(0), rules).count() == 0


def test_auc_is_that_of_all_pairs(spark):
    import random

    rnd = random.Random(7)
    rows = [(rnd.choice([rnd.random(), 0.5, 0.25]), rnd.randrange(2)) for _ in range(300)] + [(None, 1), (0.1, None)]
    frame = spark.createDataFrame(rows, "score double, label int")
    ones, zeros = ([s for s, y in rows if y == v and s is not None] for v in (1, 0))
    want = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))
    assert abs(metrics.auc(frame.repartition(5)).first()[0] - want) < 1e-12
    assert metrics.auc(frame.filter("label = 1")).first()[0] is None and metrics.auc(frame.limit(0)).first()[0] is None
