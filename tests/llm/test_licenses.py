"""Edited notices amid other words against all stretches of a text."""

import random

import duckdb
import pytest

from dossierlake.llm import licenses, queries

WORDS = "the river runs along a valley and under old bridges software for any person file can be found in this place with work terms public use".split()


def plain(text):
    import re

    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def dice_of_all(words, template):
    """The best coefficient of any stretch of two thirds to one and a half of the template's length."""
    own = licenses.bigrams_of(template)
    n, best = len(plain(template)), 0.0
    for size in range(max(2, 2 * n // 3), 3 * n // 2 + 2):
        for i in range(len(words) - size + 1):
            got = {f"{a} {b}" for a, b in zip(words[i : i + size], words[i + 1 : i + size])}
            best = max(best, 2 * len(got & own) / (len(got) + len(own)))
    return best


def edited(rnd, name, edits):
    words = plain(licenses.TEMPLATES[name])
    for _ in range(edits):
        at, kind = rnd.randrange(len(words)), rnd.randrange(3)
        words[at : at + 1] = [[], [words[at], rnd.choice(WORDS)], [rnd.choice(WORDS)]][kind]
    some = lambda: [rnd.choice(WORDS) for _ in range(rnd.randrange(5, 25))]
    return some() + words + some()


@pytest.fixture(scope="module")
def notices():
    rnd = random.Random(12)
    return [(name, edited(rnd, name, rnd.randrange(1, max(2, len(plain(t)) // 8 + 1)))) for name, t in licenses.TEMPLATES.items() for _ in range(18)]


def test_recall_of_edited_notices(spark, notices):
    """Of notices that some stretch makes 0.8 like a template, at least 95 of 100 are found with that template's coefficient or a better one."""
    docs = spark.createDataFrame([(i, " ".join(ws).capitalize() + ".") for i, (_, ws) in enumerate(notices)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs.repartition(8)).collect()}
    due = found = 0
    for i, (name, ws) in enumerate(notices):
        best = dice_of_all(ws, licenses.TEMPLATES[name])
        if best >= licenses.THRESHOLD:
            due += 1
            found += got[i]["dice"] >= round(best, 6) - 1e-6
    assert due > 150 and found >= 0.95 * due, (found, due)


def test_query_gives_the_rows_of_sql(spark, tmp_path, notices):
    texts = [" ".join(ws) for _, ws in notices[::5]] + [None, "", "Released under the well known MIT License.", "RELEASED\nunder the * MIT -- License!", "mit license " * 40, "license"]
    docs = spark.createDataFrame([(None if i == 3 else i, t, "MIT", 0.5) for i, t in enumerate(texts)] + [(1, texts[1], "x", 0.1)], "doc_id long, text string, license string, dice double")
    docs.repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(queries.oracle_sql()["op2_license_scan"])
    columns = [c[0] for c in want.description]
    got = [tuple(r) for r in queries.queries()["op2_license_scan"](spark, str(tmp_path)).select(*columns).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want.fetchall()))


def test_no_stretch_is_left_out(spark):
    """Where matches repeat, many stretches look better by places than the one that is best by distinct bigrams."""
    wording = "alpha beta gamma delta epsilon zeta"
    for text in ("alpha beta alpha beta alpha beta alpha beta gamma delta epsilon zeta", "alpha beta gamma alpha beta gamma delta epsilon x zeta epsilon zeta", "delta epsilon zeta delta epsilon alpha beta gamma delta epsilon zeta"):
        words, grams = licenses.words_of(text), licenses.bigrams_of(wording)
        stretches = [licenses.bigrams_of(" ".join(words[a:b])) for a in range(len(words)) for b in range(a + 2, len(words) + 1)]
        best = max(2 * len(s & grams) / (len(s) + len(grams)) for s in stretches)
        got = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), {"T": wording}, 0.6).first()
        assert got["dice"] == round(best, 6)
    assert not hasattr(licenses, "CANDIDATES")
