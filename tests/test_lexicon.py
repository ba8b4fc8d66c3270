"""Lexicons that are sent and that are not; letter statistics against plain counting."""

import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dossierlake.functions import letters
from dossierlake.operators import lexicon


@pytest.mark.parametrize("sent", [0, 10**6])
def test_known_words(spark, sent):
    rnd = random.Random(3)
    known = [f"w{i}" for i in range(100_000)]
    rows = [(i % 20, [f"w{rnd.randrange(200_000)}" for _ in range(rnd.randrange(0, 60))]) for i in range(60)]
    rows += [(50, None), (51, []), (52, [None, "w1", "w1", "W1"]), (52, [None, "w1", "w1", "W1"]), (None, ["w5"] * 3000)]
    frame = spark.createDataFrame([(i, ws, "x") for i, ws in rows], "id int, ws array<string>, known_words string")
    words = spark.createDataFrame([(w,) for w in known + ["w1", None]], "word string")
    got = lexicon.with_known_words(frame.repartition(3), F.col("ws"), words, "n", sent).collect()
    held = set(known)
    want = sorted((str(i), str(ws), sum(w in held for w in ws or [])) for i, ws in rows)
    assert sorted((str(r["id"]), str(r["ws"]), r["n"]) for r in got) == want and got[0].asDict().keys() == {"id", "ws", "known_words", "n"}
    assert {r["n"] for r in lexicon.with_known_words(frame, F.col("ws"), words.limit(0), "n", sent).collect()} == {0}
    assert lexicon.with_known_words(frame.limit(0), F.col("ws"), words, "n", sent).count() == 0


def entropy(text):
    n = len(text)
    return math.log2(n) - sum(k * math.log2(k) for k in Counter(text).values()) / n if n else None


@given(st.text("aAbéÉ 1\n.đ漢", max_size=40))
def test_profile(text):
    own = re.sub(r"[^a-zA-ZéÉđ漢]", "", text).lower()
    got = letters.profile(text)
    n = len(own)
    same = 26 * sum(k * (k - 1) for k in Counter(own).values()) / (n * (n - 1)) if n > 1 else None
    for value, want in zip(got[1:], (same, entropy(own), entropy(re.sub(r"\s", "", text)), entropy(text) or 0.0)):
        assert math.isnan(value) if want is None else abs(value - want) < 1e-9
    assert got[0] == n


def test_statistics_of_nulls(spark):
    rows = spark.createDataFrame([(None,), ("",), ("12",), ("aab",)], "t string").select(letters.char_stats(F.col("t")).alias("s")).collect()
    got = [r["s"] for r in rows]
    assert got[0]["letters"] is None and got[1]["letters"] == 0 and got[1]["entropy"] == 0 and got[2]["coincidence"] is None and got[2]["entropy"] == 1.0
    assert got[3]["letters"] == 3 and got[3]["coincidence"] == pytest.approx(26 * 2 / 6)


def test_shared_words(spark):
    rows = [(1, ["a", "b", "b"]), (2, ["a", "c"]), (3, ["a", "b"]), (3, ["c", "d"]), (3, ["c", "e"]), (None, ["d", "e"]), (4, ["d", None]), (4, ["b"]), (5, None), (None, ["c", "d"])]
    frame = spark.createDataFrame(rows, "doc int, ws array<string>").repartition(3)
    words = lambda most: sorted(r["word"] for r in lexicon.shared_words(frame, "doc", F.col("ws"), most).filter("word is not null").collect())
    assert words(2) == ["a", "b"] and words(1) == ["a", "b", "c", "d"] and words(0) == ["a", "b", "c", "d", "e"]
    # the words of documents of one row meet in no shuffle by document
    plan = lexicon.shared_words(frame, "doc", F.col("ws"), 2)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(word" in plan and "array" not in "".join(line for line in plan.splitlines() if "hashpartitioning" in line)


def test_blocks_hold_a_word_once(monkeypatch):
    """A word meets the lexicon once a block, not once a row; blocks are bounded and their rows are neighbours."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(lexicon, "BLOCK_WORDS", 6)
    rows, words = [4, 5, 6, 7, 20, 21], [[1, 2, 1], [2], [], [3] * 9, [1], [1, 2]]
    batch = pa.RecordBatch.from_arrays([pa.array(rows), pa.array(words, pa.list_(pa.int64()))], ["row", "hashes"])
    got = pa.Table.from_batches(list(lexicon._blocks(iter([batch, batch.slice(1, 2)])))).to_pylist()
    told = [(r["block"], r["h"], np.frombuffer(r["nth"], np.uint16).tolist()) for r in got]
    assert told == [(4, 1, [0, 0]), (4, 2, [0, 1]), (7, 3, [0] * 9), (20, 1, [0, 1]), (20, 2, [1]), (5, 2, [0])]
    counts = lexicon._known_of_block(pa.Table.from_pylist([r for r in got if r["block"] == 20]))
    assert counts.to_pylist() == [{"row": 20, "n": 1}, {"row": 21, "n": 2}]
