"""Resolution of units and persons against decision tables and against a plain loop over all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from dossierlake.functions.similarity import weighted_ratio
from dossierlake.operators import persons, ranking, resolve

UNITS = [(1, "Bệnh viện Trung ương"), (2, "Cục Kỹ thuật"), (3, "Công an xã Phú Hữu"), (4, "Công an xã Phú Hựu"), (5, "Học viện Hậu cần"), (6, "Học viện Hậu cần"), (7, "Trung đoàn Thông tin Liên lạc 205")]
ALIASES = [(1, "Bệnh viện 108"), (7, "Trung đoàn 205")]


def day(frame, *columns):
    for c in columns:
        frame = frame.withColumn(c, F.col(c).cast("date"))
    return frame


def units_of(spark, mentions, **more):
    m = day(spark.createDataFrame([(i, *x, "2026-01-01") for i, x in enumerate(mentions)], "mention_id int, name string, code string, as_of string"), "as_of")
    codes = day(spark.createDataFrame([("A01", 1, None, None), ("B02", 2, None, "2020-01-01"), ("E05", 5, None, None)], "code string, unit_id int, valid_from string, valid_to string"), "valid_from", "valid_to")
    got = resolve.resolve_units(m, spark.createDataFrame(UNITS, "unit_id int, name string"), spark.createDataFrame(ALIASES, "unit_id int, name string"), codes, **more)
    return {r["mention_id"]: r for r in got.collect()}


def test_unit_decisions(spark):
    got = units_of(spark, [
        ("x", " a01 "), ("  BỆNH-VIỆN   108  ", None), ("Cục Kỹ thuật", "A01"), ("không có nơi này", None), ("Học viện Hậu cần", None), ("Học viện Hậu cần", "E05"), ("Cuc Ky thuat", None),
        ("Cong an xa Phu Huu", None), ("Công an xã Phú Hữu", None), ("Cục Kỹ thuật", "B02"), (None, None), ("  ", None), ("Trung đoàn Thông tin Liên lạc 20", None), ("Trung đoàn Thông tin Liên lạc 205x", "A01"),
    ])
    decided = {i: (r["status"], r["method"], r["unit_id"]) for i, r in got.items()}
    assert decided[0] == ("MATCHED", "TRUSTED_CODE", 1) and decided[1] == ("MATCHED", "APPROVED_ALIAS", 1) and decided[2] == ("CONFLICT", "CODE_NAME_CONFLICT", None)
    assert decided[3][0] in ("NOT_FOUND", "AMBIGUOUS") and decided[3][2] is None
    assert decided[4] == ("AMBIGUOUS", "EXACT_NAME_AMBIGUOUS", None) and [c["unit_id"] for c in got[4]["candidates"]] == [5, 6] and decided[5] == ("MATCHED", "TRUSTED_CODE", 5)
    assert decided[6] == ("MATCHED", "ASCII_FOLDED", 2) and got[6]["score"] == 97 and decided[7][:2] == ("AMBIGUOUS", "EXACT_NAME_AMBIGUOUS") and decided[8] == ("MATCHED", "CANONICAL_EXACT", 3)
    assert decided[9] == ("MATCHED", "CANONICAL_EXACT", 2) and decided[10] == decided[11] == ("NOT_FOUND", None, None)
    assert decided[12] == ("MATCHED", "HYBRID_FUZZY_BM25_SEMANTIC", 7) and got[12]["candidates"][0]["unit_id"] == 7 and len(got[12]["candidates"]) == len(UNITS)
    assert decided[13] == ("CONFLICT", "CODE_STRONG_NAME_CONFLICT", None)


def plain_rank(query, docs, semantic):
    """The best candidates of a query by a loop over all of docs {id: [names]}."""
    key = lambda s: " ".join(s.lower().split())
    words = {d: " ".join(sorted(ns)).lower().split() for d, ns in docs.items()}
    n, avg = len(docs), sum(map(len, words.values())) / len(docs)
    raw = {}
    for d, ws in words.items():
        for t in key(query).split():
            df = sum(t in x for x in words.values())
            if t in ws:
                raw[d] = raw.get(d, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * ws.count(t) * 2.5 / (ws.count(t) + 1.5 * (0.25 + 0.75 * len(ws) / avg))
    fuzzy = {d: max(weighted_ratio(key(query), key(x)) for x in ns) for d, ns in docs.items()}
    top = sorted(fuzzy.values(), reverse=True)[:2]
    if top[0] >= 94 and top[0] - top[1] >= 10:
        semantic = {}
    best = max(raw.values(), default=0)
    rows = [(0.65 * fuzzy[d] / 100 + 0.2 * (raw.get(d, 0) / best if best else 0) + 0.15 * semantic.get((query, d), 0), fuzzy[d], d) for d in docs]
    return sorted(rows, key=lambda r: (-round(r[0], 9), -round(r[1], 9), r[2]))[: resolve.TOP_K]


def test_ranking_is_that_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(ranking, "NAME_BLOCK", 7)
    monkeypatch.setattr(ranking, "HOT_TERM", 4)
    rnd = random.Random(4)
    words = ["cong", "an", "xa", "phu", "huu", "vien", "quan", "y", "tinh", "ha", "nam", "so"]
    docs = {d: [" ".join(rnd.choices(words, k=rnd.randrange(1, 5))) for _ in range(rnd.choice((1, 1, 2)))] for d in range(40)}
    queries = ["conganxa", "vienn", "tinhh ha nm", "quan y vien", "zzz", "so"] + [" ".join(rnd.choices(words, k=3)) for _ in range(6)]
    queries = list(dict.fromkeys(queries))
    semantic = {(q, rnd.randrange(40)): rnd.random() for q in queries}
    frame = spark.createDataFrame([(d, n) for d, ns in docs.items() for n in ns], "d_id int, name string")
    asked = spark.createDataFrame([(q, q) for q in queries], "q_id string, name string")
    told = spark.createDataFrame([(q, d, s) for (q, d), s in semantic.items()], "q_id string, d_id int, semantic double")
    got: dict = {}
    for r in resolve.hybrid_rank(asked, frame, told).orderBy("q_id", "rank").collect():
        got.setdefault(r["q_id"], []).append((r["combined"], r["fuzzy"], r["d_id"]))
    for q in queries:
        want = plain_rank(q, docs, semantic)
        assert [x[0] for x in got[q]] == pytest.approx([x[0] for x in want]) and len(got[q]) == 10


PEOPLE = [(1, "Nguyễn Văn An", 1985, 1, "SYNTHETIC_DEMO"), (2, "Nguyễn Văn An", 1990, 2, "SYNTHETIC_DEMO"), (3, "Trần Thị Bình", 1980, 1, "CURATED"), (4, "Lê Hoàng Long Giang", 1970, 2, "ROSTER"), (5, "Phạm Minh Châu", 1975, 3, "ROSTER"), (6, "Phạm Minh Châu", 1976, 3, "CURATED")]


def test_person_decisions(spark):
    cases = [
        # name, code, birth_year, unit_id, unit_name
        (None, "p001", None, None, None), ("Trần Thị Bình", "P001", None, None, None), ("Nguyễn Văn An", None, None, None, None), ("nguyen van an", None, 1990, None, None), ("Nguyễn Văn An", None, None, 1, None),
        ("Nguyễn Văn An", None, None, None, "Đơn vị hai"), ("Nguyễn Văn An", None, None, None, "nowhere"), ("Trần Thị Bình", None, 1999, None, None), ("Trần Thị B", None, None, None, None), ("Lê Hoàng Long Giangg", None, None, None, None),
        ("Lê Hoàng Long Giangg", None, 1999, None, None), ("xyz uvw", None, None, None, None), (None, None, None, None, None), ("", "P777", None, None, None), ("Phạm Minh Châu", None, None, None, None), ("Bình béo", None, None, None, None), ("x", "PP", None, None, None),
    ]
    m = day(spark.createDataFrame([(i, *c, "2026-01-01") for i, c in enumerate(cases)], "mention_id int, name string, code string, birth_year int, unit_id int, unit_name string, as_of string"), "as_of")
    people = day(spark.createDataFrame([(*p, None, None) for p in PEOPLE], "person_id int, name string, birth_year int, unit_id int, source_kind string, valid_from string, valid_to string"), "valid_from", "valid_to")
    aliases = spark.createDataFrame([(3, "Bình béo")], "person_id int, name string")
    codes = spark.createDataFrame([(1, "P001"), (4, "PP"), (5, "PP")], "person_id int, code string")
    units = spark.createDataFrame([("Đơn vị hai", 2)], "name string, unit_id int")
    resolved = persons.resolve_persons(m, people, aliases, codes, units)
    got = {r["mention_id"]: (r["status"], r["method"], r["person_id"]) for r in resolved.collect()}
    assert got == {
        0: ("MATCHED", "TRUSTED_PERSON_CODE", 1), 1: ("CONFLICT", "PERSON_CODE_NAME_CONFLICT", None), 2: ("AMBIGUOUS", "PERSON_EXACT_NAME_AMBIGUOUS", None), 3: ("MATCHED", "ASCII_FOLDED_NARROWED", 2), 4: ("MATCHED", "CANONICAL_EXACT_NARROWED", 1),
        5: ("MATCHED", "CANONICAL_EXACT_NARROWED", 2), 6: ("CONFLICT", "PERSON_NARROWING_CONFLICT", None), 7: ("CONFLICT", "PERSON_NARROWING_CONFLICT", None), 8: ("NOT_FOUND", "INCOMPLETE_NAME_QUERY", None), 9: ("MATCHED", "FUZZY_NAME", 4),
        10: ("CONFLICT", "PERSON_FUZZY_NARROWING_CONFLICT", None), 11: ("NOT_FOUND", "FUZZY_NAME", None), 12: ("NOT_FOUND", None, None), 13: ("NOT_FOUND", None, None), 14: ("AMBIGUOUS", "PERSON_EXACT_NAME_AMBIGUOUS", None), 15: ("MATCHED", "APPROVED_ALIAS", 3),
        16: ("AMBIGUOUS", "PERSON_CODE_AMBIGUOUS", None),
    }
    kinds = {r["mention_id"]: (r["source_kind"], list(r["candidates"])) for r in resolved.collect()}
    assert kinds[2] == ("SYNTHETIC_DEMO", [1, 2]) and kinds[14] == ("PROVIDED", [5, 6]) and kinds[1] == ("PROVIDED", [1, 3]) and kinds[11] == ("PROVIDED", []) and kinds[16] == ("ROSTER", [4, 5])
    rich = persons.with_units(resolved.filter("mention_id = 2"), people, units).first()["candidates"]
    assert [(c["person_id"], c["unit_name"]) for c in rich] == [(1, None), (2, "Đơn vị hai")]


def test_codes_are_counted_by_span(spark):
    """Spans of a unit that meet, days without a span, mentions with two codes, against a plain loop."""
    import datetime
    import random

    from pyspark.sql import functions as F

    from dossierlake.operators import resolve

    rnd, day = random.Random(8), lambda n: datetime.date(2020, 1, 1) + datetime.timedelta(n)
    ends = lambda: (None if rnd.random() < 0.2 else day(rnd.randrange(30)), None if rnd.random() < 0.2 else day(rnd.randrange(30)))
    codes = [(f"C{rnd.randrange(3)}", rnd.randrange(6), *ends()) for _ in range(60)]
    asked = [(k % 90, f" c{rnd.randrange(4)} ", day(rnd.randrange(32))) for k in range(110)]
    got = resolve.by_code(spark.createDataFrame(asked, "mention_id long, code string, as_of date"), spark.createDataFrame(codes, "code string, unit_id long, valid_from date, valid_to date"))
    want: dict = {}
    for m, code, d in asked:
        want.setdefault(m, set()).update(u for c, u, a, b in codes if c.lower() == code.strip() and (a is None or a <= d) and (b is None or d <= b))
    assert {r["mention_id"]: (r["code_unit"], r["n_code_units"]) for r in got.collect()} == {m: (min(us), len(us)) for m, us in want.items() if us}
    assert all(isinstance(r["n_code_units"], int) for r in got.filter(F.col("mention_id") < 5).collect())
