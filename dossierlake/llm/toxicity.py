"""Toxicity with noisy-channel deobfuscation.

A stretch that may be disguised (letters swapped for signs and digits, letters set apart, letters
repeated) becomes a lattice of letters; a Viterbi search under a character language model restores the
likeliest word. The restored text is then scored: its toxic terms, learnt from labelled rows, by a
calibrated logistic curve.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierlake.llm.bpe import batches_of
from dossierlake.llm.common import bounded_sample
from dossierlake.llm.quality import logistic, score_with

SAMPLE = 6_000  # labelled rows of each class, by hash
STEMS = (4, 5, 6)  # lengths of word beginnings that may be terms
PRECISION = 0.8  # toxic share of a term's rows
COSTS, READINGS = 200_000, 50_000  # costs of letters, and readings of short stretches, that a worker remembers
WORDS = 50_000  # distinct words whose counts a task holds before it passes their trigrams on
SLOT_BITS, PAIR_BITS = 22, 20  # slots of the tables of character trigrams and pairs
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
# Letters that a sign may stand for.
SIGNS = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou",
}
ENDS = "0123456789@$+"  # signs that may stand for a word's last letters; the others end words as punctuation
RARE = {"@": 3.0, "$": 3.0}  # costs of signs that seldom stand for themselves after a letter
TERM_SHARE = 0.05  # chance that a disguised word is one of the terms
#: kinds of characters below 128: 1 letter, 2 what sets letters apart, 4 sign, 8 sign at a word's end; all above count as letters
_KINDS = np.array([1 if chr(c).isalpha() else (2 if chr(c) in " .-_*" else 0) | (4 if chr(c) in SIGNS else 0) | (8 if chr(c) in ENDS else 0) for c in range(128)], np.uint8)
#: a sign before a letter within a word or after a letter at its end; one letter at a time, four or more; a letter three times or more
_SWAPPED = regex.compile(r"(?<!\S)[^\s]*?(?:(?:(?<=[^\W\d_])[0-9@$!|+(*]++|(?<!\S)[0-9@$!|+(]++)(?=[^\W\d_])|(?<=[^\W\d_])[0-9@$+]++(?![^\W_]))\S*")
_APART = regex.compile(r"(?<![^\W_])[^\W_](?:[ .\-_*][\p{L}0-9@$!]){3,}(?![^\W_])")
_TRIPLE = regex.compile(r"([^\W\d_])\1\1+")
_WORD = regex.compile(r"[^\W\d_]+")
AROUND = 3  # tokens on both sides that tell a term's places apart


def _suspect(low: str) -> tuple[bool, bool, bool]:
    """Whether a text may have letters set apart, signs for letters, letters three times in a row."""
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _KINDS[np.minimum(codes, 127)]
    kinds[codes > 127] = 1
    letter, gap, sign = (kinds & 1).view(bool), (kinds & 2) != 0, (kinds & 4) != 0
    step = (letter | sign)[:-1] & gap[1:]
    apart = len(step) > 6 and bool((step[:-5] & step[2:-3] & step[4:-1] & (letter | sign)[6:]).any())
    swapped = bool((sign[:-1] & letter[1:]).any()) or bool((letter[:-1] & ((kinds & 8) != 0)[1:]).any())
    return apart, swapped, bool((letter[2:] & (codes[2:] == codes[1:-1]) & (codes[2:] == codes[:-2])).any())


def _stretched(low: str, read: Callable[[str], str]) -> str:
    """The text with every word that has a letter three times in a row read anew; each letter is looked at once or twice."""
    out, at = [], 0
    while m := _TRIPLE.search(low, at):
        a = m.start()
        while a > at and _WORD.match(low, a - 1, a):
            a -= 1
        b = _WORD.match(low, m.start()).end()
        out += low[at:a], read(low[a:b])
        at = b
    return "".join(out) + low[at:]


def _lattice(span: str, apart: bool) -> list[tuple[str, int, str]]:
    """Letter choices of each place, how often they stood there, and what stands there if it ends a word.

    A separator has no choices. A sign after a letter at a word's end is a letter or ends the word. ``apart``
    says that every other character is a separator.
    """
    lattice: list[tuple[str, int, str]] = []
    ends, kept = set(), True  # signs that may end a word
    for i in range(len(span) - 1, -1, -1):
        if span[i] not in SIGNS:
            kept = not span[i].isalpha()
        elif kept:
            ends.add(i)
    after = False  # a letter, or signs that follow one
    for i, ch in enumerate(span):
        sign = SIGNS.get(ch, "")
        choices = "" if apart and i % 2 or ch == "*" and not lattice else ch if ch.isalpha() else sign
        end = ch if not choices or after and i in ends else ""
        after = ch.isalpha() or after and bool(sign)
        if lattice and choices and lattice[-1][0] == choices:
            lattice[-1] = (choices, lattice[-1][1] + 1, lattice[-1][2] and lattice[-1][2] + end)
        elif choices or lattice:
            lattice.append((choices, 1, end))
    return lattice


def _slots(codes: np.ndarray, bits: int) -> np.ndarray:
    """Slots, below 2**bits, of n-grams packed in 64 bits."""
    x = codes.astype(np.uint64)
    for shift, factor in ((31, _MIX), (29, _MIX2)):
        x ^= x >> np.uint64(shift)
        x *= factor
    x >>= np.uint64(64 - bits)
    return x.view(np.int64)


class Trigrams:
    """Counts of character trigrams, and of the pairs that they begin with, in two tables of a fixed number of slots.

    An n-gram's slot is its hash, so the tables never outgrow ``SLOT_BITS`` and ``PAIR_BITS``, whatever alphabets a corpus
    has; n-grams that share a slot share its count, of a hundred thousand trigrams about one in eighty does. Slots that
    are empty take no room.
    """

    def __init__(self, threes: tuple[np.ndarray, np.ndarray], twos: tuple[np.ndarray, np.ndarray]):
        self._threes, self._twos = (tuple(np.asarray(x, np.int64)[np.argsort(slots)] for x in (slots, n)) for slots, n in (threes, twos))

    @classmethod
    def of(cls, counts: dict[str, int]) -> "Trigrams":
        """A table of trigrams with their counts."""
        grams, n = list(counts), np.array(list(counts.values()), np.int64)
        slots = lambda size, bits: _slots(np.array([cls._code(g[:size]) for g in grams], np.int64), bits)
        summed = lambda at: (np.unique(at), np.bincount(np.unique(at, return_inverse=True)[1], n).astype(np.int64)) if len(grams) else (at, n)
        return cls(summed(slots(3, SLOT_BITS)), summed(slots(2, PAIR_BITS)))

    @staticmethod
    def _code(g: str) -> int:
        code = 0
        for c in g:
            code = code << 21 | ord(c)
        return code

    def __len__(self) -> int:
        return len(self._threes[0])

    def total(self) -> int:
        return int(self._threes[1].sum())

    def count(self, g: str) -> int:
        """Occurrences of a trigram, or of all trigrams that begin with two letters."""
        (slots, values), bits = (self._threes, SLOT_BITS) if len(g) == 3 else (self._twos, PAIR_BITS)
        slot = int(_slots(np.array([self._code(g)], np.int64), bits)[0])
        i = int(np.searchsorted(slots, slot))
        return int(values[i]) if i < len(slots) and slots[i] == slot else 0


class Model:
    """Character language model, toxic terms and calibration."""

    def __init__(self, trigrams: Trigrams | dict[str, int], terms: dict[str, float], weights: np.ndarray | None = None):
        trigrams = Trigrams.of(trigrams) if isinstance(trigrams, dict) else trigrams
        self.trigrams, self.terms, self.weights = trigrams, terms, weights
        self._ready = False

    def __getstate__(self):
        return {"trigrams": self.trigrams, "terms": self.terms, "weights": self.weights, "_ready": False}

    def _prepare(self) -> None:
        self._three, self._two = Counter(), Counter()  # what the terms add
        self._costs: dict[str, float] = {}
        extra = max(1, self.trigrams.total() // 200 // max(1, len(self.terms)))
        for t in self.terms:  # disguised words are likelier to be terms
            w = "^^" + t[1:] + ("$" if t[0] == "=" else "")
            for i in range(len(w) - 2):
                self._three[w[i : i + 3]] += extra
        for g, n in self._three.items():
            self._two[g[:2]] += n
        self._seen: dict[tuple[str, bool], str] = {}
        self._tree: list[dict[str, int]] = [{}]  # letters that lead on within the terms
        self._ends: list[set[str]] = [set()]  # "=" where a word ends there, "^" where it may go on
        for t in self.terms:
            node = 0
            for c in t[1:]:
                if c not in self._tree[node]:
                    self._tree[node][c] = len(self._tree)
                    self._tree.append({})
                    self._ends.append(set())
                node = self._tree[node][c]
            self._ends[node].add(t[0])
        self._entry = -math.log(TERM_SHARE / max(1, len(self.terms)))
        self._machine = ahocorasick.Automaton()
        for t, x in self.terms.items():
            self._machine.add_word(t[1:], (len(t) - 1, t[0] == "=", x))
        if self.terms:
            self._machine.make_automaton()
        self._ready = True

    def _cost(self, context: str, letter: str) -> float:
        known = self._costs.get(context + letter)
        if known is None:
            three, two = (self.trigrams.count(g) + more.get(g, 0) for g, more in ((context + letter, self._three), (context, self._two)))
            known = -math.log((three + 0.05) / (two + 2.0))
            if len(self._costs) < COSTS:
                self._costs[context + letter] = known
        return known

    def restore(self, span: str, apart: bool = False) -> str:
        """The likeliest reading of a disguised stretch, by Viterbi over its lattice of letters."""
        known = self._seen.get((span, apart))
        if known is None:
            known = self._viterbi(span, apart)
            if len(self._seen) < READINGS and len(span) <= 64:
                self._seen[span, apart] = known
        return known

    def _after(self, context: str, node: int, letter: str) -> Iterator[tuple[str, int, float]]:
        """Contexts, places in the tree of terms (0 outside) and costs after one more letter."""
        if not node:
            yield context[1] + letter, 0, self._cost(context, letter)
        place = self._tree[node].get(letter) if node or context == "^^" else None
        if place:
            entry = 0.0 if node else self._entry
            yield context[1] + letter, place, entry
            if "^" in self._ends[place]:
                yield context[1] + letter, 0, entry

    def _ending(self, context: str, node: int) -> float:
        """Cost of a word's end; none where a word ended just before or a whole term ends."""
        if node:
            return 0.0 if "=" in self._ends[node] else math.inf
        return 0.0 if context == "^^" else self._cost(context, "$")

    def _viterbi(self, span: str, apart: bool) -> str:
        lattice = _lattice(span, apart)
        if not any(choices for choices, _, _ in lattice):
            return span
        paths: dict[tuple[str, int], tuple[float, tuple | None]] = {("^^", 0): (0.0, None)}  # with the pieces read, last first
        before = ""
        for choices, times, end in lattice:
            after: dict[tuple[str, int], tuple[float, tuple | None]] = {}

            def reach(state, cost, pieces):
                if cost < math.inf and (state not in after or cost < after[state][0]):
                    after[state] = (cost, pieces)

            for (context, node), (cost, pieces) in paths.items():
                if not choices:
                    reach((context, node), cost, pieces)
                if end:
                    own = sum(RARE.get(x, 0.0) for x in end) if choices else 0.0
                    reach(("^^", 0), cost + own + self._ending(context, node), (end, pieces))
                for c in choices:
                    if choices == before and context[1] == c:  # repeated with a separator between
                        reach((context, node), cost, pieces)
                    for ctx, place, more in self._after(context, node, c):
                        reach((ctx, place), cost + more, (c, pieces))
                        for ctx2, place2, again in self._after(ctx, place, c) if times > 1 else ():
                            reach((ctx2, place2), cost + more + again, (c + c, pieces))
            paths = after
            before = choices or before
        pieces = min(((cost + self._ending(*state), n, read) for n, (state, (cost, read)) in enumerate(paths.items())), key=lambda x: x[:2])[2]
        found = []
        while pieces:
            piece, pieces = pieces
            found.append(piece)
        return "".join(reversed(found))

    def restored(self, text: str) -> str:
        """Lower-cased text with every disguised stretch replaced by its reading."""
        if not self._ready:
            self._prepare()
        low = text.lower()

        def read(whole: str, apart: bool = False) -> str:
            span = whole.strip(".,;:?\"'()[]|#%&*!")
            return self.restore(span, apart) if len(span) >= 3 else whole

        apart, swapped, long = _suspect(low)
        if apart:
            low = _APART.sub(lambda m: read(m.group(), True), low)
        if swapped:
            low = _SWAPPED.sub(lambda m: read(m.group()), low)
        if long:
            low = _stretched(low, read)
        return low

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Strongest term, summed strength of the distinct terms, and whether there is any."""
        if not text:
            return 0.0, 0.0, 0.0
        low = self.restored(text)
        if not self.terms:
            return 0.0, 0.0, 0.0
        found: dict[str, float] = {}
        for end, (n, whole, strength) in self._machine.iter(low):
            start = end - n + 1
            if start and low[start - 1].isalpha():
                continue
            if whole and end + 1 < len(low) and low[end + 1].isalpha():
                continue
            found[low[start : end + 1]] = strength
        if not found:
            return 0.0, 0.0, 0.0
        return max(found.values()), math.log1p(sum(found.values())), 1.0

    def score(self, text: str | None) -> float:
        z = sum(f * w for f, w in zip(self.features(text), self.weights)) + self.weights[-1]
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))


def _parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows with each term, by label."""
    terms: tuple[Counter, Counter] = (Counter(), Counter())
    for f in frames:
        for text, y in zip(f["text"], f["y"]):
            words = set(_WORD.findall(text.lower()))
            rows = {"=" + w for w in words if 3 <= len(w) <= 24}
            for k in STEMS:
                rows |= {"^" + w[:k] for w in words if len(w) >= k}
            terms[y].update(rows)
    for y in (0, 1):
        if terms[y]:
            yield pd.DataFrame({"y": y, "what": list(terms[y]), "n": list(terms[y].values())})


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of the character trigrams in the distinct words of each text, and of the pairs they begin with, by slot."""
    words: Counter = Counter()

    def passed_on() -> Iterator[pa.RecordBatch]:
        n, sizes = np.fromiter(words.values(), np.int64), np.fromiter(map(len, words), np.int64) + 3
        codes = np.frombuffer("".join(f"^^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        words.clear()
        inside = np.ones(len(codes), bool)
        ends = np.cumsum(sizes)
        inside[ends - 1] = inside[ends - 2] = False  # a trigram does not go on into the next word
        at = np.flatnonzero(inside[:-2])
        grams, times = codes[at] << 21 | codes[at + 1], np.repeat(n, sizes - 2)
        for size, bits in ((2, PAIR_BITS), (3, SLOT_BITS)):
            if size == 3:
                grams = grams << 21 | codes[at + 2]
            found, place = np.unique(_slots(grams, bits), return_inverse=True)
            counts = np.bincount(place, times).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), size, np.int32)), pa.array(found), pa.array(counts)], ["size", "slot", "n"])

    for b in batches_of(batches, 1_000_000):
        for text in b.column(0).to_pylist():
            words.update(set(_WORD.findall(text.lower())))
            if len(words) > WORDS:
                yield from passed_on()
    if words:
        yield from passed_on()


def _around(names: set[str]):
    """Distinct places of each of ``names`` in a batch: a hash of the ``AROUND`` tokens on both sides."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = set()
            for text in f["text"]:
                tokens = text.lower().split()
                for i, token in enumerate(tokens):
                    for w in _WORD.findall(token):
                        held = names.intersection(["=" + w, *("^" + w[:k] for k in STEMS if len(w) >= k)])
                        if held:
                            near = " ".join(tokens[max(0, i - AROUND) : i] + ["|"] + tokens[i + 1 : i + 1 + AROUND])
                            found.update((t, xxhash.xxh3_64_intdigest(near.encode("utf-8", "surrogatepass")) >> 1) for t in held)
            yield pd.DataFrame(list(found), columns=["what", "place"])

    return run


def _sharpest(rows: dict[str, tuple[int, int]]) -> list[str]:
    """Terms but those whose toxic rows a longer term holds nearly whole with fewer clean rows; shortest first."""
    family: dict[str, list[str]] = {}
    for w in rows:
        family.setdefault(w[1 : 1 + min(STEMS)], []).append(w)
    blunt = lambda w: w[0] == "^" and any(
        len(v) > len(w) and v[1:].startswith(w[1:]) and rows[v][0] >= 0.9 * rows[w][0] and rows[v][1] < rows[w][1] for v in family[w[1 : 1 + min(STEMS)]]
    )
    return sorted((w for w in rows if not blunt(w)), key=lambda w: (len(w), w))


def learn(labelled: DataFrame, label: str = "toxic", sample: int = SAMPLE, texts: DataFrame | None = None) -> Model:
    """Model from (doc_id, text, label) rows; null or empty texts and null labels do not count.

    Terms (words and word beginnings) are counted over about ``sample`` rows of each class, character
    trigrams over every row of ``texts`` (all labelled rows by default), labelled or not.
    A term is kept if toxic rows make up ``PRECISION`` of its rows and so many toxic rows would not come
    about by chance among all terms, counting places that differ, as copies of one text repeat all its words;
    a beginning stands for its longer forms unless one of them is as frequent and cleaner. The driver receives the
    terms that toxic rows alone could pass with, the filled slots of the trigrams' tables, and one row of
    three numbers a sampled text for the calibration.
    """
    rows = labelled.filter(F.col(label).isin(0, 1) & (F.length("text") > 0)).select("doc_id", "text", F.col(label).cast("int").alias("y"))
    chosen = bounded_sample(rows, "y", sample)
    size = {r["y"]: r["n"] for r in chosen.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not size.get(1) or not size.get(0):
        return Model({}, {}, np.zeros(4))
    parts = chosen.select("text", "y").mapInPandas(_parts, "y int, what string, n long")
    summed = parts.groupBy("what").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("clean"))
    base = size[1] / (size[0] + size[1])
    found = summed.filter((F.col("toxic") >= 3) & (F.col("toxic") >= PRECISION * (F.col("toxic") + F.col("clean")))).toPandas()
    least = max(3.0, (math.log(max(len(found), 1) + 1) + 4) / -math.log(base))
    strong = found[found["toxic"] >= least]
    places = chosen.filter("y = 1").select("text").mapInPandas(_around(set(strong["what"])), "what string, place long").distinct()
    apart = places.groupBy("what").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).toPandas()
    strong = strong[strong["what"].isin(apart["what"])]
    strength = {w: math.log((t + 0.5) / (c + 0.5) * size[0] / size[1]) for w, t, c in zip(strong["what"], strong["toxic"], strong["clean"])}
    terms: dict[str, float] = {}
    for w in _sharpest({w: (t, c) for w, t, c in zip(strong["what"], strong["toxic"], strong["clean"])}):
        if not any("^" + w[1 : 1 + k] in terms for k in STEMS if len(w) > k):
            terms[w] = strength[w]
    whole = (rows if texts is None else texts).select(F.col("text").cast("string").alias("text")).filter(F.length("text") > 0)
    letters = whole.mapInArrow(_letters, "size int, slot long, n long").groupBy("size", "slot").agg(F.sum("n").alias("n")).toPandas()  # as many rows as slots at most
    tables = [letters[letters["size"] == k] for k in (3, 2)]
    model = Model(Trigrams(*((t["slot"].to_numpy(), t["n"].to_numpy()) for t in tables)), terms)
    sent = labelled.sparkSession.sparkContext.broadcast(model)

    def measured(frames):
        for f in frames:
            got = [sent.value.features(t) for t in f["text"]]
            yield pd.DataFrame(got, columns=["a", "b", "c"]).assign(y=f["y"].to_numpy())

    seen = chosen.select("text", "y").mapInPandas(measured, "a double, b double, c double, y int").toPandas()
    model.weights = logistic(seen[["a", "b", "c"]].to_numpy(), seen["y"].to_numpy(float), ridge=0.05)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Calibrated chance that each whole text is toxic: doc_id, score.

    Null and empty texts get the calibration's base score. Repeated rows stay, null doc_ids stay null,
    further columns are ignored; an empty table gives no rows.
    """
    return score_with(docs, model)
