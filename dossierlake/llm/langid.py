"""Language identification by language-bitmask n-gram filters.

One bit-sliced Bloom filter holds all languages: a slot is a mask with one bit a language, an n-gram has
``HASHES`` slots, and the AND of their masks names every language that contains it. A text's score for a
language is the share of its n-grams whose mask has the language's bit, corrected for the filter's rate
of false positives for that language.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierlake.llm.bpe import batches_of
from dossierlake.llm.common import bounded_sample, materialize

ORDERS = (3, 4)
HASHES = 2
LEAST_BITS = 18  # a filter has 2**18 slots at least
LOAD = 8  # and this many for each n-gram of the language that has most
LEAST_SHARE = 1 / 20_000  # an n-gram is a language's if it is that share of the language's n-grams of its order
SAMPLE_PER_LANGUAGE = 3000  # documents of a language that its n-grams are learnt from, in hash order
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def _letters() -> np.ndarray:
    """Code point -> lower-case letter; 0 for all that is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if unicodedata.category(ch)[0] == "L":
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_table: list[np.ndarray] = []


def _codes(text: str) -> np.ndarray:
    """Lower-cased letters as numbers, with one 0 before and after every word."""
    if not _table:
        _table.append(_letters())
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.zeros(len(raw) + 2, np.uint32)
    np.take(_table[0], raw, out=codes[1:-1])
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    return codes[keep]


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Packed n-grams with a letter; the blank counts as a letter at the ends of a word only."""
    if len(codes) < n:
        return np.empty(0, np.uint64)
    c = codes.astype(np.uint64)
    m = len(c) - n + 1
    out = c[:m].copy()
    for j in range(1, n):
        out = out * np.uint64(0x110001) + c[j : j + m]
    inner = np.ones(m, bool)
    for j in range(1, n - 1):
        inner &= codes[j : j + m] != 0
    return (out[inner] * _MIX) ^ np.uint64(n)


def _slots(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    a = (grams ^ (grams >> np.uint64(29))) * _MIX2
    b = (a ^ (a >> np.uint64(32))) * _MIX
    return [(x >> np.uint64(64 - bits)).astype(np.int64) for x in (a, b)][:HASHES]


def _count(frames):
    """Partial n-gram counts of a partition's texts, by language and order."""
    for f in frames:
        for lang, texts in f.groupby("lang")["text"]:
            codes = [_codes(t) for t in texts]
            for n in ORDERS:
                found, k = np.unique(np.concatenate([_grams(c, n) for c in codes]), return_counts=True)
                if len(found):
                    yield pd.DataFrame({"lang": lang, "n": n, "gram": found.view(np.int64), "k": k})


class Filters:
    """The bit-sliced filter, its languages and each language's rate of false positives."""

    def __init__(self, languages: list[str], bits: int, masks: np.ndarray):
        self.languages, self.bits, self.masks = languages, bits, masks  # masks: 64 languages a row, 2**bits slots
        self._small: np.ndarray | None = None  # masks of one byte, for few languages
        full = [((masks[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(languages))]
        self.false_rate = np.array(full) ** HASHES

    def shares(self, text: str) -> np.ndarray | None:
        """Corrected share of the text's n-grams that each language contains; None without a letter."""
        codes = _codes(text)
        if not codes.any():
            return None
        small = len(self.languages) <= 8
        if small and self._small is None:
            self._small = self.masks.astype(np.uint8)
            self._bit = np.array([[m >> b & 1 for b in range(len(self.languages))] for m in range(256)], np.int64)
        hits, total = np.zeros(len(self.languages)), 0
        step = 1 << 20
        for at in range(0, len(codes), step):  # long texts in windows that overlap by an n-gram
            window = codes[at : at + step + max(ORDERS) - 1]
            for n in ORDERS:
                g = _grams(window[: step + n - 1], n)
                slots = _slots(g, self.bits)
                total += len(g)
                for k, row in enumerate(self._small if small else self.masks):
                    mask = row[slots[0]]
                    for s in slots[1:]:
                        mask = mask & row[s]
                    if small:
                        hits += np.bincount(mask, minlength=256) @ self._bit
                    else:
                        counts = np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
                        hits[64 * k : 64 * k + 64] += counts[: len(hits) - 64 * k]
        return (hits / max(total, 1) - self.false_rate) / (1 - self.false_rate)


def learn(examples: DataFrame, sample: int = SAMPLE_PER_LANGUAGE) -> Filters:
    """Filters from (doc_id, text, lang) rows; rows without text or lang do not count.

    About ``sample`` documents of each language are learnt from, by a hash of text and id. The filter holds every n-gram
    that is ``LEAST_SHARE`` of a language's n-grams of its order; what is rarer is noise, as texts quote other languages.
    Its size follows the number of n-grams of the language that has most, 2 / ``LEAST_SHARE`` at most. Slots are set
    where the n-grams are and met by a bitwise or: the driver receives slots with their masks alone. There
    may be any number of languages: a mask takes another 64 bits for each 64 of them.
    """
    rows = examples.filter("text is not null and lang is not null").select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    chosen = bounded_sample(rows, "lang", sample).select("lang", "text")
    counted = materialize(chosen.mapInPandas(_count, "lang string, n int, gram long, k long").groupBy("lang", "n", "gram").agg(F.sum("k").alias("k")), "grams")
    sums = F.broadcast(counted.groupBy("lang", "n").agg(F.sum("k").alias("all")))  # a row a language and order
    grams = counted.join(sums, ["lang", "n"]).filter(F.col("k") >= LEAST_SHARE * F.col("all")).select("lang", "gram")
    counts = {r["lang"]: r["n"] for r in grams.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    languages = sorted(counts)
    bits = max(LEAST_BITS, int(LOAD * max(counts.values(), default=1) - 1).bit_length())
    number = {lang: k for k, lang in enumerate(languages)}

    def place(frames):
        for f in frames:
            k = f["lang"].map(number).to_numpy(np.int64)
            mask = np.left_shift(np.uint64(1), (k % 64).astype(np.uint64)).view(np.int64)
            for slots in _slots(f["gram"].to_numpy(np.int64).view(np.uint64), bits):
                yield pd.DataFrame({"part": k // 64, "slot": slots, "mask": mask})

    masks = np.zeros((-(-len(languages) // 64), 1 << bits), np.uint64)
    if languages:
        found = grams.mapInPandas(place, "part long, slot long, mask long").groupBy("part", "slot").agg(F.bit_or("mask").alias("mask")).toPandas()
        masks[found["part"], found["slot"]] = found["mask"].to_numpy(np.int64).view(np.uint64)
    return Filters(languages, bits, masks)


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """Language of every whole text: doc_id, lang_pred, score (0 to 1).

    ``und`` with score 0 where the text is null, empty or has no letter, or no language was learnt. Ties
    go to the language first in name order. The score is the best language's share of the sum of all.
    Repeated rows stay; null doc_ids stay null; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(filters)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        f = sent.value
        for b in batches_of(batches):
            langs, scores = [], []
            for t in b.column(1).to_pylist():
                shares = f.shares(t) if t and f.languages else None
                if shares is None:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                k = int(np.argmax(shares))
                langs.append(f.languages[k])
                positive = np.maximum(shares, 0)
                scores.append(float(positive[k] / positive.sum()) if positive.sum() > 0 else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema=schema)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, lang_pred string, score double")
