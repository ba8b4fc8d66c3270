"""Words of texts that a lexicon knows, whatever its size.

A lexicon whose hashes fit the bound is sent to every task as one sorted array; a larger one stays where it
is and meets the words of the texts in a shuffle, each word once for each block of neighbouring rows that has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake.functions import text as T
from dossierlake.sources.shared import written

SENT_WORDS = 2_000_000  # words of a lexicon that is sent, 8 bytes each
BLOCK_ROWS, BLOCK_WORDS = 65_536, 2_000_000  # rows that two bytes tell apart, and words of a block


def shared_words(rows: DataFrame, doc: str, words: Column, most: int) -> DataFrame:
    """(word) of the ``words`` (an array) that more than ``most`` documents have.

    Rows of one ``doc`` are one document, a row without is none. Words are counted where they are; only those of
    documents of several rows meet in a shuffle.
    """
    own = T.free_names(rows)
    some = rows.withColumn(own("doc"), F.col(doc)).filter(F.col(own("doc")).isNotNull())
    several = written(some.groupBy(own("doc")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(own("doc"), F.col(own("doc")).alias(own("again"))), "lexicon-docs")
    marked = some.join(several, own("doc"), "left").select(F.col(own("again")).alias("again"), F.explode(F.array_distinct(words)).alias("word"))
    held = marked.groupBy("word", "again").agg(F.count(F.lit(1)).alias("n"))
    n = F.sum(F.when(F.col("again").isNull(), F.col("n")).otherwise(1))
    return held.groupBy("word").agg(n.alias("n")).filter(F.col("n") > most).select("word")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, h, nth) of rows (row, hashes): each hash once for a block of neighbouring rows, with the places in the block that have it.

    A block is named by its first row; it has up to ``BLOCK_ROWS`` rows and, unless one row has more, ``BLOCK_WORDS`` words.
    """
    for b in batches:
        rows, size = b.column(0).to_numpy(), pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
        words, starts = b.column(1).flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(size)].astype(np.int64)
        k = 0
        while k < len(rows):
            end = max(k + 1, min(len(rows), k + BLOCK_ROWS, int(np.searchsorted(starts, starts[k] + BLOCK_WORDS, "right")) - 1))
            apart = np.flatnonzero(rows[k:end] - rows[k] != np.arange(end - k))
            end = k + int(apart[0]) if len(apart) else end
            own = words[starts[k] : starts[end]]
            order = np.argsort(own, kind="stable")
            own, nth = own[order], np.repeat(np.arange(end - k, dtype=np.uint16), size[k:end])[order]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
            ends = (np.r_[first, len(nth)] * 2).astype(np.int32)
            places = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(nth.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), rows[k], np.int64)), pa.array(own[first], pa.int64()), places], ["block", "h", "nth"])
            k = end


def _known_of_block(met: pa.Table) -> pa.Table:
    """(row, n) of a block's known hashes: the words of each row among them."""
    n = np.bincount(np.frombuffer(b"".join(met["nth"].to_pylist()), np.uint16))
    at = np.flatnonzero(n)
    return pa.table({"row": pa.array(at + met["block"][0].as_py(), pa.int64()), "n": pa.array(n[at], pa.int64())})


def with_known_words(rows: DataFrame, words: Column, lexicon: DataFrame, out: str = "known", sent_words: int = SENT_WORDS) -> DataFrame:
    """``rows`` with the number of their ``words`` (an array) that ``lexicon`` (word) has, repeated ones each.

    A word is known by its 64-bit hash in either way: of a million words and a billion asked ones, one in
    some ten thousand lexicons takes a stranger for its own. Null words and null arrays count nothing; rows
    that repeat are counted each; an empty lexicon knows none.
    """
    own = T.free_names(rows)
    hashes = F.transform(F.array_compact(F.coalesce(words, F.array().cast("array<string>"))), lambda w: F.xxhash64(w))
    known = written(lexicon.filter("word is not null").select(F.xxhash64("word").alias("h")).distinct(), "lexicon")
    if known.count() <= sent_words:
        table = np.sort(known.toPandas()["h"].to_numpy(np.int64))
        sent = rows.sparkSession.sparkContext.broadcast(table)

        @F.arrow_udf("long")
        def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            held = sent.value
            for b in batches:
                ends = np.cumsum(pc.list_value_length(b).to_numpy(zero_copy_only=False))
                asked = b.flatten().to_numpy(zero_copy_only=False)
                hit = held[np.minimum(np.searchsorted(held, asked), len(held) - 1)] == asked if len(held) else np.zeros(len(asked), bool)
                upto = np.r_[0, np.cumsum(hit)]
                yield pa.array(upto[ends] - upto[np.r_[0, ends][:-1]], pa.int64())

        return rows.withColumn(out, count(hashes))
    row = own("row")
    numbered = written(rows.withColumn(row, F.monotonically_increasing_id()).withColumn(own("hashes"), hashes), "lexicon-rows")
    asked = numbered.select(row, own("hashes")).mapInArrow(_blocks, "block long, h long, nth binary")
    hits = asked.join(known, "h").select("block", "nth").groupBy("block").applyInArrow(_known_of_block, "row long, n long")
    hits = hits.select(F.col("row").alias(row), F.col("n").alias(out))
    return numbered.drop(own("hashes")).join(hits, row, "left").withColumn(out, F.coalesce(out, F.lit(0).cast("long"))).select(*rows.columns, out)
