"""Registry files, candidates, publication and bulk rows against worked cases."""

import pytest
from pyspark.sql import functions as F

from dossierlake.operators import documents, registry


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_names_end_at_stop_words(spark):
    raw = ["(Cục Kỹ thuật  đã họp", "Cục Kỹ thuật ĐANG họp", "Viện Sử học, tại Huế", "Công an xã Trong Sáng", "Cục theo", " – Học viện [A]", "a " * 30, "và", "Cục tạivì"]
    got = spark.createDataFrame([(r,) for r in raw], "raw string").select(registry.clean_candidate(F.col("raw"))).collect()
    assert [r[0] for r in got] == ["Cục Kỹ thuật", "Cục Kỹ thuật", "Viện Sử học", "Công an xã", "Cục", "Học viện [A", ("a " * 24).strip(), "và", "Cục tạivì"]


def test_publishing_keeps_what_waits(spark):
    make = lambda data: spark.createDataFrame(data, "id int, qa_status string, note string")
    fresh = make([(1, "APPROVED", "b"), (1, "APPROVED", "a"), (2, "PENDING_QA", "x"), (3, "PENDING_QA", "new"), (4, None, "y"), (4, None, "z"), (6, "APPROVED", "now")])
    published, pending = registry.publish(make([(2, "APPROVED", "old")]), fresh, ["id"], make([(3, "PENDING_QA", "waited"), (5, "PENDING_QA", "waited"), (6, "PENDING_QA", "waited")]))
    assert sorted(rows(published)) == [(1, "APPROVED", "a"), (2, "APPROVED", "old"), (6, "APPROVED", "now")]
    assert sorted(rows(pending), key=str) == [(3, "PENDING_QA", "waited"), (4, None, "y"), (5, "PENDING_QA", "waited")]
    assert registry.publish(make([]), make([]), ["id"])[1].count() == 0


@pytest.mark.parametrize("split", [None, 600])
def test_registries_in_input_order(spark, tmp_path, split):
    """Many files and splits: ordinals are those of the files one after another."""
    import csv

    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        lines, paths = [], []
        for f, n in enumerate((150, 1, 0, 80)):
            path = tmp_path / f"r{f}.csv"
            with path.open("w", newline="", encoding="utf-8") as out:
                w = csv.writer(out)
                w.writerow(["canonical_name", "organization_type", "qa_status", "evidence_count"])
                for i in range(n):
                    row = [f"Cục số {i % 60}" if i % 2 else f"CỤC  SỐ-{i % 60}", "BCA" if i % 3 else "BQP", "APPROVED" if (i + f) % 5 == 0 else "", str(i % 4) if i % 7 else "n/a"]
                    w.writerow(row)
                    lines.append(row)
            paths.append(f"file://{path}")
        read = registry.read_registries(spark, paths)
        got = {r["ordinal"]: [r[c] for c in ("canonical_name", "organization_type", "qa_status", "evidence_count")] for r in read.collect()}
        assert got == dict(enumerate(lines))
        assert not split or read.select("ordinal").rdd.getNumPartitions() > 0
        best = {}
        for o, (name, org, status, n) in enumerate(lines):
            key = org, name.lower().replace("-", " ").replace("  ", " ")
            rank = (status == "APPROVED", float(n) if n != "n/a" else 1.0, -o)
            if key not in best or rank > best[key]:
                best[key] = rank
        want = sorted(-r[2] for r in best.values())
        merged = registry.numbered(registry.merge_registries(read), "ordinal").select("place", "ordinal")
        assert sorted(rows(merged)) == list(enumerate(want))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_bulk_codes_days_and_warnings(spark):
    cases = [
        # name, code, day, unit, confidence -> error, warnings
        ("A", "AB-12", "2026-01-02", "x | y", "0.9", None, ["AMBIGUOUS_UNIT"]), ("B", "cd 12", None, "x ; ", None, "DUPLICATE", []), ("C", "12 3456", None, None, "0.1", "BAD_FORMAT_CODE", ["LOW_TABLE_CONFIDENCE"]),
        ("D", "123 456-789", "1900-01-01", "x;y", "1", "BAD_FORMAT_DATE", []), ("E", "123456789", None, None, None, "DUPLICATE", []), ("F", "mã cũ", "1945-09-02", None, "odd", None, ["LOW_TABLE_CONFIDENCE"]),
        ("G", "MA CU", None, None, None, "DUPLICATE", []), ("H", " ", "2027-06-01", "|", None, None, []), ("I", None, "2027-06-03", None, None, "BAD_FORMAT_DATE", []), (" ", "7", None, "a;b", "0", "MISSING_NAME", ["LOW_TABLE_CONFIDENCE"]), ("J", "...", None, None, None, "BAD_FORMAT_CODE", []),
    ]
    df = spark.createDataFrame([(1, i, *c[:5]) for i, c in enumerate(cases)], "job_id int, row_index int, name string, code string, day string, unit string, confidence string")
    out = documents.validate_rows(df, F.lit("2026-06-01").cast("date")).orderBy("row_index").collect()
    assert [(r["error"], r["warnings"]) for r in out] == [c[5:] for c in cases]
    bare = documents.validate_rows(df.select("job_id", "row_index", "name", "code", "day"), F.lit("2026-06-01").cast("date"))
    assert {tuple(r["warnings"]) for r in bare.collect()} == {()}
