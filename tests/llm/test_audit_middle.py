"""Filter audit and fill-in-the-middle against plain loops."""

import hashlib
import random
import re
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from dossierlake.llm import audit, middle, queries

TEXTS = [
    None, "", " \t ", "word " * 250, "word " * 250, "one two three", "one two three", "Aa Bb", "a $ sign", "x & " * 300, "É ß 漢字 \U0001f600 ok", "A" * 40,
    "\n".join(f"line {i} of a text" for i in range(80)), " ".join(f"w{i}" for i in range(5000)), "<P> holds a mark", "ends <S", "a b a b",
]


def rows():
    made = [(i, t, ("en", "fr", None, "")[i % 4], "junk") for i, t in enumerate(TEXTS)]
    made += [(None, "one two three", "en", "junk"), (3, "word " * 250, "en", "junk"), (90, "Aa Bb", "fr", "junk"), (91, "Aa Bb", "de", "junk")]
    made += [(100 + i, "copy of one hot text", "en", "junk") for i in range(40)]
    return made


LABELS = [(0, 1, 0), (4, 0, 1), (4, 1, None), (90, 1, 1), (91, 1, 0), (None, 1, 1), (110, 1, 0), (111, None, 1)]


def plain_audit(docs, labels):
    least = {}
    for i, t, *_ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    seen = []
    for i, t, lang, *_ in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t],
        }
        seen.append((lang or "", fails, i in good, i in toxic))
    out, total = {}, {}
    for part in {s[0] for s in seen}:
        own = [s for s in seen if s[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [s for s in left if s[1][f]]
                left = [s for s in left if not s[1][f]]
                failing = [s for s in own if s[1][f]]
                total[part, f] = total.get((part, f), 0) + len(gone)
                out[part, "".join(order), k + 1] = [
                    len(left), len(gone), len(failing) - len(gone), sum(sum(s[1].values()) == 1 for s in failing), sum(s[2] for s in gone), sum(s[3] for s in gone),
                ]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def frames(spark, docs, labels):
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, mask string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_audit_is_the_loop(spark):
    docs, labels = frames(spark, rows(), LABELS)
    got = audit.audit(docs.repartition(3), labels).collect()
    want = plain_audit(rows(), LABELS)
    assert len(got) == len(want) == 120 * 5 * 4
    for r in got:
        assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) == want[r.part, r.filter_order, r.step]
    assert audit.audit(docs.limit(0), labels).count() == 0
    assert audit.audit(docs, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_zeta_sums_subsets(spark):
    counts = list(range(3, 19))
    got = spark.createDataFrame([(counts,)], "c array<long>").select(audit.zeta(F.col("c"), 4)).first()[0]
    assert got == [sum(counts[m] for m in range(16) if m & t == m) for t in range(16)]


def test_audit_of_other_filters(spark):
    docs, labels = frames(spark, [(i, "x" * i, "en", "") for i in range(10)], [])
    marked = audit.marked(docs, labels, lambda text: {"long": F.length(text) > 5, "odd": F.length(text) % 2 == 1})
    got = {(r.filter_order, r.step): r.removed for r in audit.audit_orders(marked, "LOC").collect()}
    assert len(got) == 18 and got["LOC", 1] == 4 and got["LOC", 2] == 3 and got["OLC", 2] == 2 and got["CLO", 1] == 0


@pytest.mark.parametrize("unit", middle.UNITS)
def test_pieces_and_restoring(spark, unit):
    rnd = random.Random(5)
    texts = TEXTS + ["".join(rnd.choice("ab <>PSM é漢\U0001f600\n") for _ in range(rnd.randrange(80))) for _ in range(300)]
    docs = spark.createDataFrame([(None if i == 8 else i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, n string, form int")
    made = middle.fill_in_middle(docs.coalesce(1), unit).withColumn("back", middle.restored(F.col("form"), F.col("output"))).collect()
    pattern = {"char": r"(?s).", "word": r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+", "line": r"[^\n]*\n|[^\n]+"}[unit]
    forms = set()
    for i, (r, t) in enumerate(zip(made, texts)):
        t = t or ""
        units = re.findall(pattern, t)
        name = hashlib.sha256(f"1:{'' if i == 8 else i}".encode()).hexdigest()
        h = [int(name[k : k + 8], 16) for k in (0, 8, 16, 24)]
        a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
        head, mid, tail = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 90:
            want = (len(units), "plain", None, None, t)
        elif h[3] % 100 < 20:
            want = (len(units), "spm", len(head), len(mid), f"<S>{tail}<P>{head}<M>{mid}")
        else:
            want = (len(units), "psm", len(head), len(mid), f"<P>{head}<S>{tail}<M>{mid}")
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == want and r.back == t
        forms.add(r.form)
    assert forms == {"plain", "psm", "spm"}
    assert middle.fill_in_middle(docs.limit(0), unit).count() == 0
    with pytest.raises(ValueError):
        middle.fill_in_middle(docs, "page")


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_fill_in_middle"])
def test_queries_give_the_rows_of_sql(spark, tmp_path, name):
    docs, labels = frames(spark, rows(), LABELS)
    docs.repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = [tuple(r) for r in queries.queries()[name](spark, str(tmp_path)).select(*columns).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want.fetchall()))
