"""Fill-in-the-middle: cut texts at two unit boundaries and move the middle to the end.

A text becomes a UTF-32 array of code points. Neighbours of unlike class bound a unit, so the boundaries
are the non-zero places of one comparison; the cuts are ranks among them, and the pieces are slices.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake.llm.bpe import batches_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = ("char", "word", "line")
BATCH = 4_000_000


def classes(points: np.ndarray, unit: str) -> np.ndarray:
    """A class for every code point; a unit is a maximal run of one class."""
    if unit == "char":
        return np.arange(len(points), dtype=np.int32)  # no two neighbours alike: every code point is a unit
    if unit == "word":
        return ((points == 0x20) | ((points >= 0x09) & (points <= 0x0D))).astype(np.int32)
    if unit == "line":
        return np.cumsum(points == 0x0A, dtype=np.int32) - (points == 0x0A)  # a line holds its line feed
    raise ValueError(f"unit must be one of {UNITS}")


def boundaries(points: np.ndarray, unit: str) -> np.ndarray:
    """Places where a unit begins or the text ends: 0, .., len(points)."""
    of = classes(points, unit)
    inner = np.flatnonzero(of[1:] != of[:-1]) + 1
    return np.concatenate([[0], inner, [len(points)]]) if len(points) else np.zeros(1, np.int64)


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four numbers below 2**32 of a row, alike in every run."""
    name = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(name[i : i + 4], "big") for i in (0, 4, 8, 12))


def transform(text: str, doc_id: int | None, unit: str, seed: int, rate: int, spm_rate: int) -> tuple:
    """(n units, form, prefix and middle in code points, output) of one text."""
    raw = text.encode("utf-32-le", "surrogatepass")
    edges = boundaries(np.frombuffer(raw, np.uint32), unit)
    n = len(edges) - 1
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = (int(edges[r]) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
    head, mid, tail = (piece.decode("utf-32-le", "surrogatepass") for piece in (raw[: 4 * a], raw[4 * a : 4 * b], raw[4 * b :]))
    spm = h4 % 100 < spm_rate
    made = f"{SUFFIX}{tail}{PREFIX}{head}{MIDDLE}{mid}" if spm else f"{PREFIX}{head}{SUFFIX}{tail}{MIDDLE}{mid}"
    return n, "spm" if spm else "psm", a, b - a, made


def fill_in_middle(docs: DataFrame, unit: str = "char", seed: int = 1, rate: int = 90, spm_rate: int = 20) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of every whole text.

    ``unit`` is char, word (runs of white space are units too) or line. Of 100 rows about ``rate`` are
    cut, of those about ``spm_rate`` have the suffix first. Null and empty texts, and texts that hold a
    mark, stay plain, with null piece sizes. Texts of any length are cut whole. Repeated rows and equal
    ids draw alike; a null doc_id draws as an empty one and stays null. Further columns are ignored,
    whatever their names; an empty table gives no rows.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, BATCH):
            made = [transform(t or "", i, unit, seed, rate, spm_rate) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            cols = zip(*made) if made else [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), f.type) for c, f in zip(cols, list(schema)[1:]))], schema=schema)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column) -> Column:
    """The text that ``output`` was made of, from its form and marks alone.

    A text that holds a mark stays plain, so the marks of an output are the three that were put there: they
    cannot overlap a piece's end, as ``<`` opens and ``>`` closes each and stands nowhere within.
    """
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (
        F.when(form == "psm", F.concat(part[1], part[3], part[2]))
        .when(form == "spm", F.concat(part[2], part[3], part[1]))
        .otherwise(output)
    )
