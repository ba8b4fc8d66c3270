"""The FM-index and decontamination against plain search."""

import random
import re

import duckdb
import numpy as np
import pytest

from dossierlake.llm import decontaminate, queries
from dossierlake.llm.fmindex import Index, suffix_array

RND = random.Random(4)
SENTENCE = "the quick brown fox jumps over the lazy dog and runs far away from here"
LONG = " ".join(f"w{RND.randrange(300)}" for _ in range(40_000))
ITEMS = [
    (1, SENTENCE), (2, SENTENCE.upper() + " again"), (10, "two words"), (3, "É漢 ünï"), (4, None), (5, " ... "), (6, "a a a a a a a a a a a a"), (None, "secret item words"),
    (1, "an id that repeats"), (7, " ".join(LONG.split()[20_000:20_030])), (8, "x"),
]
TEXTS = [
    None, "", "!!!", "nothing to see", f"before {SENTENCE} after", SENTENCE.replace("jumps", "leaps"), f"The QUICK, brown-fox: jumps/over the lazy dog and... {SENTENCE}",
    "two\nwords and two words", "É漢\tünï", "É漢 Ünï", "a " * 30, "a " * 9, "secret item words", "an id that repeats x", LONG, LONG, "x-ray is x", SENTENCE, SENTENCE,
]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, items, width):
    held, hit, found = words(text), set(), set()
    for item, t in items:
        own = words(t)
        size = min(len(own), width)
        phrases = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(held) - size + 1 if phrases else 0):
            if tuple(held[i : i + size]) in phrases:
                hit |= set(range(i, i + size))
                found |= {str(item)} if item is not None else set()
    runs = [i for i in sorted(hit) if i - 1 not in hit]
    return len(held), [(a, next(e for e in range(a, len(held) + 1) if e not in hit)) for a in runs], sorted(found)


def frames(spark, texts, items):
    docs = spark.createDataFrame([(None if i == 12 else i, t, "x", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, items string, shard int, n_words int")
    return docs, spark.createDataFrame(items, "item_id long, text string")


def test_suffixes_search_and_locating():
    rnd = random.Random(1)
    for trial in range(120):
        docs = [[rnd.randrange(1, 4) for _ in range(rnd.randrange(0, 30))] for _ in range(rnd.randrange(1, 6))]
        docs += docs[:1] * 3 if trial % 3 == 0 else []
        ids = np.array([w for d in docs for w in [*d, 0]])
        ends = np.flatnonzero(ids == 0)
        unlike = ids + len(ends) - 1
        unlike[ends] = np.arange(len(ends))
        assert suffix_array(unlike).tolist() == sorted(range(len(ids)), key=lambda i: unlike[i:].tolist())
        index = Index.from_bytes(len(ids), **Index.build(ids).to_bytes())
        for size in (1, 2, 4):
            wanted = np.array([[-1, -1, *(rnd.randrange(1, len(index.sizes)) for _ in range(size))] for _ in range(8)]) if len(index.sizes) > 1 else np.zeros((0, 3), np.int64)
            low, high = index.search(wanted)
            for phrase, a, b in zip(wanted[:, 2:].tolist(), low, high):
                assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == [i for i in range(len(ids)) if ids[i : i + size].tolist() == phrase]


@pytest.mark.parametrize(("width", "block", "shard"), [(10, 200_000, 400_000), (10, 25, 50), (3, 40, 1)])
def test_whole_texts_against_plain_search(spark, width, block, shard):
    docs, items = frames(spark, TEXTS, ITEMS)
    got = decontaminate.decontaminate(docs.repartition(3), items, width, block, shard).collect()
    kept = {i: t for i, t in enumerate(TEXTS) if i != 12}
    assert len(got) == len(TEXTS) and sum(r.doc_id is None for r in got) == 1
    for r in got:
        n, spans, names = plain(kept.get(r.doc_id, TEXTS[12]), ITEMS, width)
        assert (r.n_words, [tuple(s) for s in r.spans], r["items"]) == (n, spans, names)


def test_random_texts(spark):
    rnd = random.Random(9)
    some = lambda k: " ".join(rnd.choice("abc") for _ in range(k))
    items = [(i, some(rnd.randrange(1, 9))) for i in range(30)]
    texts = [some(rnd.randrange(0, 60)) for _ in range(120)]
    docs, bench = frames(spark, texts, items)
    for r in decontaminate.decontaminate(docs, bench, 5, 20, 200).collect():
        if r.doc_id is not None:
            assert (r.n_words, [tuple(s) for s in r.spans], r["items"]) == plain(texts[r.doc_id], items, 5)


def test_removal(spark):
    assert decontaminate.cut_words("a, B c! d é-f", [(0, 1), (2, 4)]) == ", B é-f"
    assert decontaminate.cut_words("x y", [(0, 2)]) == "" and decontaminate.cut_words(None, [(0, 1)]) is None and decontaminate.cut_words("x", []) == "x"
    docs, items = frames(spark, TEXTS, ITEMS)
    got = decontaminate.remove(docs.repartition(3), items)
    assert got.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in got.collect()}
    for i, t in enumerate(TEXTS):
        n, spans, _ = plain(t, ITEMS, 10)
        left = kept[None if i == 12 else i]
        assert left == t if not spans else words(left) == [w for k, w in enumerate(words(t)) if not any(a <= k < e for a, e in spans)]
    assert decontaminate.remove(docs.limit(0), items).count() == 0


def test_empty_tables(spark):
    docs, items = frames(spark, TEXTS, ITEMS)
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0
    for none in (items.limit(0), items.filter("item_id = 5")):
        got = decontaminate.decontaminate(docs, none).collect()
        assert len(got) == len(TEXTS) and not any(r.spans or r["items"] for r in got)


def test_query_gives_the_rows_of_sql(spark, tmp_path):
    docs, items = frames(spark, TEXTS, ITEMS)
    docs.repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = con.execute(queries.oracle_sql()["op12_decontaminate"])
    columns = [c[0] for c in want.description]
    got = [tuple(r) for r in queries.queries()["op12_decontaminate"](spark, str(tmp_path)).select(*columns).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want.fetchall()))
