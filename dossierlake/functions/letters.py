"""Letter and character statistics of texts, counted by numpy over code points, an Arrow batch at a time."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SHAPE = "letters long, coincidence double, letter_entropy double, dense_entropy double, entropy double"


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point its lower-case letter (0 if it is none), and whether it is white space."""
    lower, blank = np.zeros(0x110000, np.uint32), np.zeros(0x110000, bool)
    for c in range(0x110000):
        ch = chr(c)
        if unicodedata.category(ch)[0] == "L":
            low = ch.lower()
            lower[c] = ord(low) if len(low) == 1 else c
        elif ch.isspace() and not 0x1C <= c <= 0x1F:
            blank[c] = True
    return lower, blank


def _bits(counts: np.ndarray) -> float:
    n = counts.sum()
    return float(np.log2(n) - (counts * np.log2(counts)).sum() / n) if n else float("nan")


def profile(text: str) -> tuple[int, float, float, float, float]:
    """Letters; their index of coincidence times 26; entropies of letters, of characters that are not blank, and of all (0 of none)."""
    lower, blank = _tables()
    points, k = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
    k = k.astype(float)
    folded = lower[points]
    letters = np.bincount(np.unique(folded[folded > 0], return_inverse=True)[1], k[folded > 0]) if (folded > 0).any() else np.zeros(0)
    n = letters.sum()
    same = float(26 * (letters * (letters - 1)).sum() / (n * (n - 1))) if n > 1 else float("nan")
    return int(n), same, _bits(letters), _bits(k[~blank[points]]), _bits(k) if len(k) else 0.0


def char_stats(text: Column) -> Column:
    """A struct of ``profile``'s values; null where there is nothing to measure; null of a null text."""

    @F.pandas_udf(_SHAPE)
    def of(texts: pd.Series) -> pd.DataFrame:
        names = ["letters", "coincidence", "letter_entropy", "dense_entropy", "entropy"]
        known = {t: profile(t) for t in set(texts.dropna())}
        rows = [known.get(t, (None,) * 5) if t is not None else (None,) * 5 for t in texts]
        frame = pd.DataFrame(rows, columns=names).astype({"letters": "Int64"} | {c: "Float64" for c in names[1:]})
        return frame.where(frame.notna(), pd.NA)

    return of(text)
