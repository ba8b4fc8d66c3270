"""BPE encoding and decoding by tree concatenation, many words at a time.

A batch of texts is cut at blanks and into words; each distinct word is encoded once, all side by side.
A word is cut into leaves of ``LEAF`` symbols, which are encoded in parallel; neighbours are then joined
level by level: a window of tokens around each join is encoded anew and grows until its outermost tokens
equal those of the left and of the right side, from where on both sides are right as they stand. Leaves
and windows of a level are merged in one go, a round at a time: in each, all places of its best-ranked pair.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 12  # symbols of a leaf
WINDOW = 2  # tokens on both sides of a join that are encoded anew at first
CHUNK = 2_500_000  # bytes of text encoded at a time
_NONE = np.int64(1 << 40)


def _byte_chars() -> dict[int, str]:
    """Printable stand-ins of the 256 bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, in a row."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Encoder:
    """A vocabulary with word ends, from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.specials.items()}
        self.names = [self.tokens.get(i, "") for i in range(max(self.tokens) + 1)]
        end = model["end_of_word_suffix"]
        chars = _byte_chars()
        self.inner = np.array([vocab[chars[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[chars[b] + end] for b in range(256)], np.int64)
        pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        a = np.array([vocab[x] for x, _ in pairs], np.int64)
        b = np.array([vocab[y] for _, y in pairs], np.int64)
        made = np.array([vocab[x + y] for x, y in pairs], np.int64)
        self._bits = 18
        keys, packed = (a << 16) | b, (np.arange(len(pairs), dtype=np.int64) << 16) | made
        self._keys, self._values = np.full(1 << self._bits, -1, np.int64), np.full(1 << self._bits, _NONE << 16, np.int64)
        for k, v, s in zip(keys.tolist(), packed.tolist(), self._slot(keys).tolist()):
            while self._keys[s] not in (-1, k):
                s = (s + 1) & ((1 << self._bits) - 1)
            if self._keys[s] == -1:
                self._keys[s], self._values[s] = k, v
        self._split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+|\n")
        self._special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self._kinds = np.zeros(0x110000, np.uint8)  # 0 blank, 1 letter, 2 number, 3 other
        every = "".join(map(chr, range(0x110000)))
        for kind, what in enumerate((r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+"), 1):
            for m in regex.finditer(what, every):
                self._kinds[m.start() : m.end()] = kind

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 16 | merged id of each pair; huge where the pair does not merge."""
        keys = (left << 16) | right
        slot = self._slot(keys)
        found = self._keys[slot]
        out = np.where(found == keys, self._values[slot], _NONE << 16)
        todo = np.flatnonzero((found != keys) & (found != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self._bits) - 1)
            f = self._keys[slot[todo]]
            hit = f == keys[todo]
            out[todo[hit]] = self._values[slot[todo[hit]]]
            todo = todo[~hit & (f != -1)]
        return out

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merge words laid end to end (each of one symbol at least): token ids, tokens by word, symbols by token."""
        n = len(sizes)
        word = np.repeat(np.arange(n), sizes)
        ids, span = symbols.astype(np.int64), np.ones(len(symbols), np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rank = np.full(len(ids), _NONE << 16, np.int64)
        if len(ids) > 1:
            inside = np.flatnonzero(word[1:] == word[:-1])
            rank[inside] = self._ranks(ids[inside], ids[inside + 1])
        while len(ids):
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            counts = np.diff(np.r_[heads, len(ids)])
            best = np.minimum.reduceat(rank, heads)
            over = best >= _NONE << 16
            if over.any():
                gone = np.repeat(over, counts)
                done.append((word[gone], ids[gone], span[gone]))
                keep = ~gone
                ids, span, word, rank = ids[keep], span[keep], word[keep], rank[keep]
                counts, best = counts[~over], best[~over]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == np.repeat(best, counts))
            # of places that overlap, every second one merges, from the left
            run = np.r_[True, np.diff(at) != 1]
            if not run.all():
                place = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
                at = at[place % 2 == 0]
            ids[at] = rank[at] & 0xFFFF
            span[at] += span[at + 1]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))
            ids, span, word, rank = ids[keep], span[keep], word[keep], rank[keep]
            near = np.zeros(len(ids) + 1, bool)
            near[moved] = True
            near[moved[moved > 0] - 1] = True
            again = np.flatnonzero(near[:-1])
            rank[again] = _NONE << 16
            again = again[again < len(ids) - 1]
            again = again[word[again] == word[again + 1]]
            rank[again] = self._ranks(ids[again], ids[again + 1])
        if not done:
            return np.empty(0, np.int64), np.zeros(n, np.int64), np.empty(0, np.int64)
        w, i, s = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(w, kind="stable")
        return i[order], np.bincount(w, minlength=n), s[order]

    def tree(self, symbols: np.ndarray, sizes: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of words laid end to end, by tree concatenation of their leaves: ids, tokens by word."""
        leaves = -(-sizes // leaf)
        word = np.repeat(np.arange(len(sizes)), leaves)
        turn = np.arange(len(word)) - np.repeat(np.cumsum(leaves) - leaves, leaves)
        ids, tokens, spans = self.merge(symbols, np.minimum(leaf, sizes[word] - leaf * turn))
        while True:
            left = np.flatnonzero((word[1:] == word[:-1]) & (turn[:-1] % 2 == 0))
            if not len(left):
                return ids, tokens
            ids, spans, tokens = self._join(symbols, ids, spans, tokens, left)
            keep = np.ones(len(word), bool)
            keep[left + 1] = False
            word, turn, tokens = word[keep], turn[keep] // 2, tokens[keep]

    def _join(self, symbols, ids, spans, tokens, left) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Join the nodes ``left`` with their right neighbours; all windows of a round are encoded together."""
        at = np.cumsum(spans) - spans
        mid = np.cumsum(tokens)[left]
        n_left, n_right, tokens = tokens[left], tokens[left + 1], tokens.copy()
        tokens[left] += n_right
        gone, fresh = np.zeros(len(ids), bool), []
        todo, width = np.arange(len(left)), WINDOW
        while len(todo):
            m, a, b = mid[todo], np.minimum(width, n_left[todo]), np.minimum(width, n_right[todo])
            begin, last = at[m - a], m + b - 1
            size = at[last] + spans[last] - begin
            got, counts, gspans = self.merge(symbols[_ranges(begin, size)], size)
            ends = np.cumsum(counts)
            starts = ends - counts
            right = (got[starts] == ids[m - a]) & (gspans[starts] == spans[m - a]) | (a == n_left[todo])
            right &= (got[ends - 1] == ids[last]) & (gspans[ends - 1] == spans[last]) | (b == n_right[todo])
            gone[_ranges((m - a)[right], (a + b)[right])] = True
            place = np.cumsum(gspans) - gspans + np.repeat(begin - (np.cumsum(size) - size), counts)
            taken = np.repeat(right, counts)
            fresh.append((place[taken], got[taken], gspans[taken]))
            tokens[left[todo[right]]] += (counts - a - b)[right]
            todo, width = todo[~right], width * 2
        place, got, gspans = (np.concatenate(x) for x in zip(*fresh, (at[~gone], ids[~gone], spans[~gone])))
        order = np.argsort(place, kind="stable")
        return got[order], gspans[order], tokens

    def words(self, text: str) -> list[str]:
        """Normalised and split text without special tokens; a line feed stays as a word."""
        return self._split.findall(self._normal(text))

    @staticmethod
    def _normal(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # each letter is lower-cased by itself
        return text.lower()

    def _split_lines(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of normal text without apostrophes: their bytes end to end, sizes in bytes, and lines."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self._kinds[codes]
        width = np.ones(len(codes), np.int64)
        for least in (0x80, 0x800, 0x10000):
            width += codes >= least
        cut = np.flatnonzero(np.r_[True, (kinds[1:] != kinds[:-1]) | (kinds[1:] == 2)] if len(kinds) else np.empty(0, bool))
        sizes = np.add.reduceat(width, cut) if len(cut) else width
        word = kinds[cut] != 0
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        return raw[np.repeat(kinds != 0, width)], sizes[word], np.cumsum(codes == 10)[cut][word]

    def encode_words(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of words laid end to end as bytes (no word is empty): ids, tokens by word."""
        offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])
        words = words.dictionary_encode()
        which, starts, raw = words.indices.to_numpy(), *_laid_out(words.dictionary)
        symbols, ends = self.inner[raw], starts[1:] - 1
        symbols[ends] = self.final[raw[ends]]
        ids, counts = self.tree(symbols, np.diff(starts))
        begins, counts = (np.cumsum(counts) - counts)[which], counts[which]
        return ids[_ranges(begins, counts)].astype(np.uint32), counts

    def encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of pieces of text (binary) without blanks: ids, tokens by piece."""
        starts, raw = _laid_out(pieces)
        odd = np.zeros(len(pieces), bool)  # what may hold a contraction or a special token
        odd[np.searchsorted(starts, np.flatnonzero((raw == ord("'")) | np.r_[(raw[:-1] == ord("<")) & (raw[1:] == ord("|")), False]), "right") - 1] = True
        texts = np.array(pieces.to_pylist(), object)
        counts = np.zeros(len(pieces), np.int64)
        text = b"\n".join(texts[~odd]).decode("utf-8", "surrogatepass")
        flat, sizes, line = self._split_lines(self._normal(text))
        ids, tokens = self.encode_words(flat, sizes)
        counts[~odd] = np.bincount(line, tokens, np.count_nonzero(~odd))[: np.count_nonzero(~odd)].astype(np.int64)
        if not odd.any():
            return ids, counts
        parts = [list(self._with_specials(t.decode("utf-8", "surrogatepass"))) for t in texts[odd]]
        words = [w.encode("utf-8", "surrogatepass") for ws in parts for w in ws if isinstance(w, str)]
        own, tokens = self.encode_words(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int64))
        own, ends, at, rest = own.tolist(), np.cumsum(tokens).tolist(), 0, []
        for ws in parts:
            out: list[int] = []
            for w in ws:
                if isinstance(w, str):
                    out += own[ends[at - 1] if at else 0 : ends[at]]
                    at += 1
                else:
                    out.append(w)
            rest.append(out)
        counts[odd] = [len(x) for x in rest]
        # laid out in the order of the pieces
        order = np.empty(int(counts.sum()), np.uint32)
        begins = np.cumsum(counts) - counts
        order[_ranges(begins[~odd], counts[~odd])] = ids
        order[_ranges(begins[odd], counts[odd])] = np.array([i for x in rest for i in x], np.uint32)
        return order, counts

    def _with_specials(self, piece: str) -> Iterator[str | int]:
        for k, part in enumerate(self._special.split(piece) if self._special else [piece]):
            if k % 2:
                yield self.specials[part]
            else:
                yield from (w for w in self.words(part) if w != "\n")


def _laid_out(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Starts (with the end of the last) and bytes of a binary array."""
    starts = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
    data = pieces.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data is not None else np.empty(0, np.uint8)
    return starts - starts[0], raw


@functools.lru_cache(maxsize=4)
def load(path: str) -> Encoder:
    return Encoder(path)


_BLANK = np.isin(np.arange(256), [9, 10, 13, 32])


class Texts:
    """Texts of a batch, as runs of distinct pieces between blanks.

    ``ids`` and ``counts`` are the tokens of the distinct pieces, ``which`` the piece at each place, in order,
    and ``cuts`` the places where texts begin. No word spans a blank, so a text's ids are its pieces' ids in a row.
    """

    def __init__(self, enc: Encoder, texts: pa.Array):
        texts = texts.fill_null("")
        starts, raw = _laid_out(texts)
        blank = _BLANK[raw]
        first = ~blank
        first[1:] &= blank[:-1]
        begin = starts[:-1][np.diff(starts) > 0]
        first[begin] = ~blank[begin]
        self.cuts = np.searchsorted(np.flatnonzero(first), starts)
        flat = raw[~blank]
        offsets = np.r_[np.flatnonzero(first[~blank]), len(flat)].astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).dictionary_encode()
        self.which = pieces.indices.to_numpy()
        self.ids, self.counts = enc.encode_pieces(pieces.dictionary)
        self.starts = np.cumsum(self.counts) - self.counts

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """All token ids in order, and where each text's begin (with the end of the last)."""
        counts = self.counts[self.which]
        ends = np.r_[0, np.cumsum(counts)]
        return self.ids[_ranges(self.starts[self.which], counts)], ends[self.cuts]

    def spelled(self, form: list[str]) -> Iterator[str]:
        """Each text as the forms of its tokens, with blanks between."""
        ids, ends = list(map(form.__getitem__, self.ids.tolist())), np.r_[self.starts, len(self.ids)].tolist()
        pieces = [" ".join(ids[x:y]) for x, y in zip(ends, ends[1:])]
        for x, y in zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist()):
            which = self.which[x:y]
            yield " ".join(map(pieces.__getitem__, which[self.counts[which] > 0].tolist()))


def batches_of(batches: Iterator[pa.RecordBatch], chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches of about ``chars`` bytes (a very long text stands alone)."""
    for b in batches:
        step = max(1, int(b.num_rows * chars / max(b.nbytes, 1)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """Ids and decoded text of every whole text: doc_id, ids array<int>, decoded string.

    Null and empty texts have no ids and decode to the empty string. Repeated rows stay repeated, null
    doc_ids stay null, further columns are ignored, an empty table gives no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches):
        enc = load(path)
        for b in batches_of(batches, CHUNK):
            texts = Texts(enc, b.column(1))
            ids, ends = texts.tokens()
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(list(texts.spelled(enc.names)), pa.string())], schema=schema)

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_digest(docs: DataFrame, path: str) -> DataFrame:
    """As ``encode_decode``, but with counts and SHA-256 digests in place of the ids and the text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        enc = load(path)
        numbers = list(map(str, range(len(enc.names))))
        for b in batches_of(batches, CHUNK):
            texts = Texts(enc, b.column(1))
            sha = [pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts.spelled(form)], pa.string()) for form in (numbers, enc.names)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(texts.tokens()[1])), *sha], schema=schema)

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
