"""Benchmark decontamination: every shard of the training texts gets an FM-index, which test phrases search.

A shard is some hundred thousand words of one partition; texts that repeat in it are indexed once. The
indexes are a table in the shared folder, so lost executors and further blocks of phrases cost no second
build. Phrases are sent in blocks of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierlake.llm.bpe import batches_of
from dossierlake.llm.common import materialize
from dossierlake.llm.fmindex import Index

WIDTH = 10
SHARD_WORDS = 400_000
BLOCK = 200_000  # pairs of phrase and item sent at once
STEP = 100_000  # phrases searched at once
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_INDEX = "shard long, n long, words binary, sizes binary, levels binary, marks binary, places binary, starts binary, counts binary, text_of binary, doc_ids array<long>"
_HIT = "shard long, row int, spans array<struct<start:int,end:int>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as bytes, A-Z lower-cased."""
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def build_index(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """A row for each shard of ``docs`` (doc_id, text): its words, its FM-index and its documents.

    A shard holds whole documents of a partition until it has ``shard_words`` different words' places; a
    longer text is a shard by itself. Null texts have no words. Every row of ``docs`` stands in one shard.
    """
    schema = _arrow(_INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        shard = _Shard()
        for b in batches_of(batches, 2_000_000):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                shard.add(doc_id, text)
                if shard.places >= shard_words or len(shard.doc_ids) >= shard_words:
                    yield pa.RecordBatch.from_pylist([shard.row(part << 32 | number)], schema=schema)
                    shard, number = _Shard(), number + 1
        if shard.doc_ids:
            yield pa.RecordBatch.from_pylist([shard.row(part << 32 | number)], schema=schema)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, _INDEX)


class _Shard:
    def __init__(self):
        self.doc_ids: list[int | None] = []
        self.text_of: list[int] = []
        self.seen: dict[str, int] = {}
        self.known: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []
        self.places = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        k = self.seen.setdefault(text or "", len(self.parts))
        if k == len(self.parts):
            known = self.known
            self.parts.append(np.array([known.setdefault(w, len(known) + 1) for w in words_of(text)] + [0], np.int64))
            self.places += len(self.parts[-1])
        self.doc_ids.append(doc_id)
        self.text_of.append(k)

    def row(self, shard: int) -> dict:
        ids = np.concatenate(self.parts)
        counts = np.fromiter(map(len, self.parts), np.int32, len(self.parts))
        return {
            "shard": shard, "n": len(ids), "words": b" ".join(self.known), **Index.build(ids).to_bytes(), "counts": (counts - 1).tobytes(),
            "starts": (np.cumsum(counts, dtype=np.int32) - counts).tobytes(), "text_of": np.array(self.text_of, np.int32).tobytes(), "doc_ids": self.doc_ids,
        }


def phrases_of(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Distinct (phrase, item): every ``width`` words in a row of an item; fewer words are one phrase.

    A phrase is its words joined by spaces; items without words, or null, have none. An item is its id as text.
    """
    words = F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER, LOWER), F.lit(WORD), F.lit(0))
    begins = F.sequence(F.lit(1), F.greatest(F.size("words") - (width - 1), F.lit(1)))
    windows = F.transform(begins, lambda i: F.array_join(F.slice("words", i, F.lit(width)), " "))
    texts = benchmark.select(F.col("item_id").cast("string").alias("item"), words.alias("words")).filter(F.size("words") > 0)
    return texts.select(F.explode(windows).alias("phrase"), "item").distinct()


class Phrases:
    """A block of phrases: their words as rows of numbers, and the items that hold them.

    Phrases of the same items share a set, so an item list is looked up once for each set of a text.
    """

    def __init__(self, pairs: pd.DataFrame, width: int):
        held = pairs.groupby("phrase", sort=True)["item"].agg(lambda items: tuple(sorted(x for x in items if x is not None)))
        self.items = sorted({i for s in held for i in s})
        number = {x: k for k, x in enumerate(self.items)}
        sets: dict[tuple, int] = {}
        self.set_of = np.array([sets.setdefault(s, len(sets)) for s in held], np.int64)
        self.sets = np.array([number[i] for s in sets for i in s], np.int64)
        self.ends = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int64)
        known: dict[bytes, int] = {}
        self.rows = np.full((len(held), width), -1, np.int64)
        for k, phrase in enumerate(held.index):
            own = [known.setdefault(w, len(known)) for w in phrase.encode().split(b" ")]
            self.rows[k, width - len(own) :] = own
        self.words = list(known)
        self.size = (self.rows >= 0).sum(1)


def _hits(index: Index, known: dict[bytes, int], phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(place, phrase) of every occurrence in a shard."""
    own = np.array([known.get(w, 0) for w in phrases.words] + [-1], np.int64)
    rows = own[phrases.rows]  # -1, before a phrase's first word, stays -1
    live = np.flatnonzero((rows != 0).all(1))  # phrases with a word that the shard lacks cannot occur
    places, names = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, len(live), STEP):
        some = live[a : a + STEP]
        low, high = index.search(rows[some])
        times = high - low
        first = np.repeat(low - (np.cumsum(times) - times), times)
        places.append(index.locate(first + np.arange(times.sum())))
        names.append(np.repeat(some, times))
    return np.concatenate(places), np.concatenate(names)


def spans_of(places: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of places that [place, place + size) cover; touching ones are one."""
    depth = np.cumsum(np.bincount(places, minlength=n + 1) - np.bincount(places + sizes, minlength=n + 1))
    edge = np.diff(np.r_[0, depth > 0, 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def search(index: DataFrame, block: Phrases) -> DataFrame:
    """Documents of ``index`` that hold phrases: shard, row, spans of words (merged), items (sorted)."""
    sent = index.sparkSession.sparkContext.broadcast(block)
    schema = _arrow(_HIT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = sent.value
        names = pa.array(phrases.items, pa.string())
        for b in batches:
            for x in (r for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
                known = {w: k + 1 for k, w in enumerate(x["words"].split(b" "))} if x["words"] else {}
                places, found = _hits(Index.from_bytes(x["n"], x["sizes"], x["levels"], x["marks"], x["places"]), known, phrases)
                if not len(places):
                    continue
                starts = np.frombuffer(x["starts"], np.int32).astype(np.int64)
                text = np.searchsorted(starts, places, "right") - 1
                a, e = spans_of(places, phrases.size[found], x["n"])
                owner = np.searchsorted(starts, a, "right") - 1  # a document's end is never covered
                span_ends = np.searchsorted(owner, np.arange(len(starts)), "right")
                text, sets = np.unique(np.stack([text, phrases.set_of[found]]), axis=1)
                many = phrases.ends[sets + 1] - phrases.ends[sets]
                held = np.repeat(phrases.ends[sets] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                pairs = np.unique(np.repeat(text, many) * len(phrases.items) + phrases.sets[held]) if many.sum() else np.zeros(0, np.int64)
                item_text, items = np.divmod(pairs, max(len(phrases.items), 1))
                item_ends = np.searchsorted(item_text, np.arange(len(starts)), "right")
                text_of = np.frombuffer(x["text_of"], np.int32)
                hit = np.zeros(len(starts), bool)
                hit[owner] = True
                rows = np.flatnonzero(hit[text_of])
                for some in np.array_split(rows, -(-len(rows) // 2000)):
                    of = text_of[some]
                    s, s_off = _lists(np.r_[0, span_ends], of)
                    i, i_off = _lists(np.r_[0, item_ends], of)
                    pieces = pa.StructArray.from_arrays([pa.array((v[s] - starts[owner[s]]).astype(np.int32)) for v in (a, e)], ["start", "end"])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(some), x["shard"])), pa.array(some.astype(np.int32)), pa.ListArray.from_arrays(s_off, pieces), pa.ListArray.from_arrays(i_off, names.take(pa.array(items[i])))],
                        schema=schema,
                    )

    return index.mapInArrow(run, _HIT)


def _lists(ends: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Places of the lists ``of``, one after another, and their offsets."""
    many = ends[of + 1] - ends[of]
    off = np.r_[0, np.cumsum(many)]
    return np.repeat(ends[of] - off[:-1], many) + np.arange(off[-1]), pa.array(off.astype(np.int32))


def documents_of(index: DataFrame) -> DataFrame:
    """Every document of an index: shard, row, doc_id, n_words."""
    schema = _arrow("shard long, row int, doc_id long, n_words long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, counts, text_of, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                n = np.frombuffer(counts, np.int32)[np.frombuffer(text_of, np.int32)].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), shard)), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(ids.values), pa.array(n)], schema=schema)

    return index.select("shard", "counts", "text_of", "doc_ids").mapInArrow(run, "shard long, row int, doc_id long, n_words long")


def _merged(spans: list) -> list:
    """Spans of all blocks, merged."""
    first, last = np.array([x["start"] for x in spans]), np.array([x["end"] for x in spans])
    return [(int(a), int(b)) for a, b in zip(*spans_of(first, last - first, int(last.max())))]


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block: int = BLOCK, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, spans (word places to remove, merged) and items (sorted ids) of every whole text.

    A text is hit where ``width`` words in a row of a ``benchmark`` item stand, or all words of a shorter
    item. Null and empty texts have no words and no hits; texts of any length are searched whole. Repeated
    rows are reported each; a null doc_id stays null. An item of null id is searched for and not named;
    of items that repeat an id any counts. Further columns are ignored, whatever their names. No rows from
    no documents; without items nothing is hit.
    """
    pairs = materialize(phrases_of(benchmark, width), "phrases")
    index = materialize(build_index(docs, shard_words), "fm-index")
    blocks = max(1, -(-pairs.count() // block))
    found = None
    for k in range(blocks):  # all pairs of a phrase are in one block
        some = pairs.filter(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == k).toPandas()
        if len(some):
            hits = search(index, Phrases(some, width))
            found = hits if found is None else found.unionByName(hits)
    every = documents_of(index)
    none = (F.expr("cast(array() as array<struct<start:int,end:int>>)"), F.expr("cast(array() as array<string>)"))
    if found is None:
        return every.select("doc_id", "n_words", none[0].alias("spans"), none[1].alias("items"))
    if blocks > 1:
        gathered = found.groupBy("shard", "row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        merged = F.udf(_merged, "array<struct<start:int,end:int>>", useArrow=True)
        found = gathered.withColumn("spans", merged("spans"))
    return every.join(found, ["shard", "row"], "left").select(
        "doc_id", "n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items")
    )


def cut_words(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """A text without the words of ``spans`` (word places) and what stands between them; one blank marks each cut within the text."""
    if not text or not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _WORD.finditer(raw.lower())]
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    kept.append(raw[at:])
    return b" ".join(part.strip() for part in kept if part.strip()).decode("utf-8", "surrogatepass")


def remove(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block: int = BLOCK, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs``, all rows and columns, with the hit stretches of their texts cut out.

    Rows are told apart by themselves, so repeated and null ids are cut each by its own text. A text without hits stays as it
    is, null and empty ones too; one that was hit throughout is empty.
    """
    own = "row of the text"
    rows = materialize(docs.withColumn(own, F.monotonically_increasing_id()), "texts")
    found = decontaminate(rows.select(F.col(own).alias("doc_id"), "text"), benchmark, width, block, shard_words)
    hit = found.filter("size(spans) > 0").select(F.col("doc_id").alias(own), F.col("spans").alias("spans of the text"))
    cut = F.udf(lambda text, spans: cut_words(text, [(x["start"], x["end"]) for x in spans]), "string", useArrow=True)
    joined = rows.join(hit, own, "left")
    text = F.when(F.col("spans of the text").isNull(), F.col("text").cast("string")).otherwise(cut(F.col("text").cast("string"), F.coalesce("spans of the text", F.expr("cast(array() as array<struct<start:int,end:int>>)"))))
    return joined.withColumn("text", text).select(*docs.columns)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
