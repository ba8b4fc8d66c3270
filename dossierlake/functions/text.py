"""Text keys and similarity as column expressions: everything here stays in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def free_names(rows: DataFrame) -> Callable[[str], str]:
    """Names for columns of a step's own that no column of ``rows`` has."""
    mark = "_"
    while any(c.startswith(mark) for c in rows.columns):
        mark += "_"
    return lambda name: mark + name


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` dealt to some tasks for every core, for costly steps on tables of few splits: evenly, or by columns, so that steps by
    these need no further shuffle."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *by)


@F.pandas_udf(StringType())
def composed(texts: pd.Series) -> pd.Series:
    """Text with its letters and marks composed (NFC), as keys expect it; for intake, where a source may hold them apart."""
    return texts.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def normalize_text(c: Column) -> Column:
    """Comparison key: dashes alike, case folded, blanks, hyphens and underscores one blank, other signs gone.

    Expects composed (NFC) text (see ``composed``); null stays null.
    """
    c = F.regexp_replace(c, "[–—]", "-")
    c = F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))
    c = F.regexp_replace(c, r"[\s\-_]+", " ")
    c = F.regexp_replace(c, r"[^\p{L}\p{N}_ ]", " ")
    return F.trim(F.regexp_replace(c, " +", " "))


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str]:
    """Letters with marks and their plain letters, from the Unicode decompositions."""
    marked, plain = ["đ", "Đ"], ["d", "D"]
    for code in range(0xC0, 0x1F00):
        parts = unicodedata.normalize("NFD", chr(code))
        base = "".join(p for p in parts if unicodedata.category(p) != "Mn")
        if len(base) == 1 and base != chr(code):
            marked.append(chr(code))
            plain.append(base)
    return "".join(marked), "".join(plain)


def strip_marks(c: Column) -> Column:
    """Letters without their marks; as long as the text before, but for loose marks."""
    marked, plain = _folding()
    return F.regexp_replace(F.translate(c, marked, plain), r"\p{Mn}", "")


def ascii_key(c: Column) -> Column:
    return normalize_text(strip_marks(c))


def tokens(c: Column) -> Column:
    return F.filter(F.split(normalize_text(c), " "), lambda t: t != "")


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, row by row of the dynamic programme."""
    start = F.array_repeat(F.lit(0), F.length(b) + 1)

    def row(prev: Column, ch: Column) -> Column:
        step = F.transform(
            F.sequence(F.lit(0), F.length(b)),
            lambda k: F.when(k == 0, F.lit(0)).otherwise(
                F.greatest(F.get(prev, k), F.when(F.substring(b, k, F.lit(1)) == ch, F.get(prev, k - 1) + 1).otherwise(F.lit(0)))
            ),
        )
        return F.transform(step, lambda _, k: F.array_max(F.slice(step, F.lit(1), k + 1)))

    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).otherwise(F.element_at(F.aggregate(F.split(a, ""), start, row), -1))


def ratio(a: Column, b: Column) -> Column:
    """Similarity 0..100: twice the common subsequence over both lengths."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(F.lit(200.0) * lcs_length(a, b) / total)


def token_sort(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(c, " ")), " ")


def cosine(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double, clipped to 0..1 as for vectors of length one."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot))


def logistic(z: Column) -> Column:
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def stable_id(*parts: Column, length: int = 12) -> Column:
    return F.upper(F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, length))


def error_rate(truth: Column, got: Column) -> Column:
    """Edit distance over the truth's length; an empty truth gives 0 for an empty guess, else 1."""
    return F.when(F.length(truth) == 0, F.when(F.length(got) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(truth, got) / F.length(truth))


def first_present(*cs: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])


def active_on(day: Column, start: Column, end: Column) -> Column:
    """Validity by both ends inclusive; a null bound is open, a null day is today."""
    d = F.coalesce(day, F.current_date())
    return (start.isNull() | (start <= d)) & (end.isNull() | (d <= end))


#: The first business day, and the days ahead that a day may lie.
FIRST_DAY, DAYS_AHEAD = "1945-09-02", 366


def plausible_day(day: Column, today: Column | None = None) -> Column:
    """Whether a day can be a business day: not before ``FIRST_DAY``, not more than ``DAYS_AHEAD`` days ahead; a null day can."""
    latest = F.date_add(F.current_date() if today is None else today, DAYS_AHEAD)
    return F.coalesce(day.between(F.lit(FIRST_DAY).cast("date"), latest), F.lit(True))


def iso_date(c: Column) -> Column:
    """dd/mm/yyyy or dd-mm-yyyy as ISO text; other text as it is."""
    found = F.coalesce(F.try_to_timestamp(c, F.lit("dd/MM/yyyy")), F.try_to_timestamp(c, F.lit("dd-MM-yyyy")))
    return F.coalesce(F.date_format(found, "yyyy-MM-dd"), c)


def case_code(identifier: Column, created: Column) -> Column:
    """Display code: HS, the year, the first eight characters of the id without its prefix."""
    short = F.upper(F.substring(F.regexp_replace(identifier, "(?i)^case_", ""), 1, 8))
    return F.concat(F.lit("HS-"), F.year(created).cast("string"), F.lit("-"), short)


def mention_variants(name: Column) -> Column:
    """Spellings of a name that mentions may use, in order, each once: as is, without marks, in lower case, without
    hyphens, parts of its words, without its last two letters, with short forms, and with its middle letter lost."""
    words = F.filter(F.split(name, r"\s+"), lambda w: w != "")
    part = lambda first, n: F.array_join(F.slice(words, F.lit(first), n), " ")
    last = lambda n: F.array_join(F.slice(words, F.greatest(F.size(words) - n + 1, F.lit(1)), F.lit(n)), " ")
    squeezed = F.regexp_replace(name, r"\s+", " ")
    middle = F.floor(F.length(squeezed) / 2).cast("int")
    options = F.array(
        name, strip_marks(name), F.lower(name), F.replace(name, F.lit("-"), F.lit(" ")), F.when(F.size(words) >= 2, last(2)).otherwise(name), last(1),
        F.when(F.size(words) > 1, part(1, F.size(words) - 1)).otherwise(name), part(1, F.lit(2)), part(1, F.lit(3)),
        F.when(F.length(name) > 5, F.substring(name, F.lit(1), F.length(name) - 2)).otherwise(name), F.replace(F.replace(name, F.lit("tỉnh"), F.lit("tinh")), F.lit("thành phố"), F.lit("tp")),
        F.when(F.length(squeezed) > 8, F.concat(F.substring(squeezed, F.lit(1), middle), F.substring(squeezed, middle + 2, F.length(squeezed)))),
    )
    return F.array_distinct(F.filter(F.transform(options, lambda v: F.trim(v)), lambda v: v != ""))


def username(name: Column) -> Column:
    """Given (last) name and the initials of the others, without marks, in lower case."""
    words = F.split(ascii_key(name), " ")
    return F.concat(F.element_at(words, -1), F.array_join(F.transform(F.slice(words, F.lit(1), F.size(words) - 1), lambda w: F.substring(w, 1, 1)), ""))


def route_key(path: Column) -> Column:
    """Path with id-like segments as :id."""
    return F.array_join(F.transform(F.split(path, "/"), lambda s: F.when(s.rlike("^([0-9]+|[0-9a-f]{8}-[0-9a-f-]+|[A-Za-z]+_[0-9a-zA-Z]{6,})$"), F.lit(":id")).otherwise(s)), "/")


def char_profile(c: Column) -> dict[str, Column]:
    """Ratios of signs outside letters, digits and usual marks, of alphabetic tokens, and of replacement characters."""
    n = F.nullif(F.length(c), F.lit(0))
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    return {
        "charset_violation": F.length(F.regexp_replace(c, r"[\p{L}\p{N}\s.,;:!?'\"()/%&+\-]", "")) / n,
        "alpha_tokens": F.size(F.filter(words, lambda w: w.rlike(r"^\p{L}+[.,;:!?]*$"))) / F.nullif(F.size(words), F.lit(0)),
        "replacement": F.length(F.regexp_replace(c, "[^�]", "")) / n,
    }
