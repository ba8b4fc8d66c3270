"""Secret scan over a trigram inverted index; DataFrame functions only.

Each rule's regex gives a Boolean trigram query: an OR of alternatives, each an AND of trigrams that a
match must contain. Postings (text, trigram) of the trigrams in use are intersected per alternative;
texts that satisfy one are candidates and verified by the regex itself. A rule without mandatory
trigrams scans every text.

Candidates are keys alone: where they are few enough to be sent to every task, texts stay where they were
read; otherwise texts and candidates meet by key.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake.llm.common import materialize

BROADCAST_ROWS = 1_000_000  # rows of candidates, some 40 bytes each, that may be sent to every task
MAX_STRINGS = 64  # alternatives that a stretch of a regex may spell


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its regex, the least length of the group that must reach it, whether it is of the base set."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives (sets of lower-case trigrams), one of which any match contains whole; None if there are none.

    Stretches that spell one of few strings give trigrams; whatever else (open repeats, wide classes)
    ends a stretch.
    """
    from re import _parser

    def strings(seq) -> list[list[str] | None]:
        """Stretches: each a list of possible strings, or None for a gap."""
        out: list[list[str] | None] = [[""]]

        def add(options: list[str] | None) -> None:
            if options is None:
                out.extend([None, [""]])
            elif out[-1] is None or len(out[-1]) * len(options) > MAX_STRINGS:
                out.append(options)
            else:
                out[-1] = [a + b for a in out[-1] for b in options]

        for op, arg in seq:
            name = str(op)
            if name == "LITERAL":
                add([chr(arg)])
            elif name == "IN":
                single = [chr(v) for o, v in arg if str(o) == "LITERAL"]
                add(single if len(single) == len(arg) and len(single) <= 8 else None)
            elif name == "SUBPATTERN":
                for part in strings(arg[-1]):
                    add(part)
            elif name == "BRANCH":
                whole = [strings(b) for b in arg[1]]
                add([s for w in whole for s in w[0]] if all(len(w) == 1 for w in whole) else None)
            elif name == "MAX_REPEAT" and arg[1] == 1:
                inner = strings(arg[2])
                add([""] * (arg[0] == 0) + inner[0] if len(inner) == 1 else None)
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] == arg[1] and arg[0] <= 16:
                inner = strings(arg[2])
                for _ in range(arg[0]):
                    add(inner[0] if len(inner) == 1 else None)
            else:
                add(None)
        return out

    grams = lambda s: frozenset(s[i : i + 3] for i in range(len(s) - 2))
    stretches = [[grams(s.lower()) for s in part] for part in strings(_parser.parse(pattern)) if part and all(len(s) >= 3 for s in part)]
    if not stretches:
        return None
    combined = list(stretches[0])
    for more in stretches[1:]:
        if len(combined) * len(more) <= MAX_STRINGS:
            combined = [a | b for a in combined for b in more]
    # an alternative that contains another adds nothing
    return [a for a in dict.fromkeys(combined) if not any(b < a for b in combined)]


def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """(text_key, trigram): which texts contain which of ``trigrams``, in lower case."""
    low = texts.select("text_key", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("text_key", F.explode(held).alias("trigram"))


def candidates(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, set[str]]:
    """(text_key, kinds): kinds of secret that a text may hold; and the kinds that scan every text."""
    spark = texts.sparkSession
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    scans = {k for k, q in queries.items() if q is None}
    asked = [(k, n, t, len(alt)) for k, q in queries.items() if q for n, alt in enumerate(q) for t in sorted(alt)]
    if not asked:
        return spark.createDataFrame([], "text_key long, kinds array<string>"), scans
    table = F.broadcast(spark.createDataFrame(asked, "kind string, alternative int, trigram string, needed int"))  # a row per rule's trigram
    hits = postings(texts, sorted({a[2] for a in asked})).distinct().join(table, "trigram")
    whole = hits.groupBy("text_key", "kind", "alternative", "needed").agg(F.count(F.lit(1)).alias("n")).filter("n = needed")
    return whole.groupBy("text_key").agg(F.collect_set("kind").alias("kinds")), scans


_NONE = "array<struct<start:int,order:int,kind:string,end:int,size:int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def _running(steps: Column, combine: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """Running sums (or maxima) of an array of int, by chunks of the root of its size: few steps a row even for many matches."""
    total = lambda xs: F.aggregate(xs, F.lit(0), combine)
    upto = lambda xs: F.transform(xs, lambda _, i: total(F.slice(xs, F.lit(1), i + 1)))

    def chunked(xs: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(xs))).cast("int"))
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / width).cast("int")), lambda c: F.slice(xs, c * width + 1, width))
        return _let(chunks, lambda cs: _let(_shifted(_let(F.transform(cs, total), upto)), lambda before: F.flatten(
            F.zip_with(cs, before, lambda c, b: F.transform(upto(c), lambda x: combine(x, b)))
        )))

    return F.when(F.size(steps) == 0, steps).otherwise(_let(steps, chunked))


def _shifted(xs: Column) -> Column:
    """Zero, then all values but the last."""
    return _let(xs, lambda v: F.concat(F.array(F.lit(0)), F.slice(v, F.lit(1), F.size(v) - 1)))


def _matched(rule: Rule) -> str:
    """The rule's regex; a run of one class is asked for with its least length, so shorter runs are not listed."""
    plain = re.fullmatch(r"\[[^\]]+\]\+", rule.pattern) and not rule.group
    return f"{rule.pattern[:-1]}{{{rule.least},}}" if plain else rule.pattern


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start,order,kind,end,size>> of the matches, left to right, that are long enough."""
    pattern = _matched(rule)
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    between = F.transform(F.split(text, pattern, -1), F.length)

    def spans(found: Column) -> Column:
        size = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)), F.length) if rule.group else found
        steps = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda a, b: a + b)
        rows = F.transform(
            F.arrays_zip(_let(steps, _running).alias("ends"), found.alias("found"), size.alias("size")),
            lambda x: F.struct((x["ends"] - x["found"]).alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), x["ends"].alias("end"), x["size"].alias("size")),
        )
        return F.filter(rows, lambda x: x["size"] >= rule.least)

    return _let(found, lambda f: F.when(F.size(f) > 0, spans(f)).otherwise(F.array().cast(_NONE)))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Secrets of every whole text: doc_id and ``spans``, array<struct<start,order,kind,end,size>>.

    Matches are leftmost and do not overlap within a kind; offsets are code points, ends exclusive; spans
    are sorted by start, then by the order of the rules. Null and empty texts have none. Repeated rows
    stay repeated, null doc_ids stay null, further columns are ignored, an empty table gives no rows.
    Texts meet their candidates by a hash: texts that share it by accident are verified needlessly, no
    more. Equal texts share one row of candidates, and the larger side of that join may be split.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return _scanned(rows, rules)


def _scanned(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``rows`` (doc_id of any type, text) with their ``spans``."""
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    kinds, scans = candidates(rows.select("text_key", "text"), rules)
    kinds = materialize(kinds, "candidates")
    if kinds.count() <= BROADCAST_ROWS:
        kinds = F.broadcast(kinds)
    joined = rows.join(kinds, "text_key", "left")
    each = []
    for k, rule in enumerate(rules):
        may = F.col("text").rlike(_matched(rule)) if rule.kind in scans else F.array_contains("kinds", rule.kind)
        each.append(F.when(may, _spans(F.col("text"), rule, k)).otherwise(F.array().cast(_NONE)))
    return joined.select("doc_id", "text", F.array_sort(F.concat(*each)).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every secret's span blanked out as [SECRET]; all columns stay, null texts stay null.

    Overlapping spans are blanked once. Column order stays; where there is a column n_chars, a text that
    changed has its new length there. Columns of any name may come along.
    """
    rest = [c for c in docs.columns if c != "text"]
    packed = F.struct(F.col("text").isNull().alias("null"), F.struct(*rest, F.lit(0).alias("last of all columns")).alias("rest"))
    found = _scanned(docs.select(packed.alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), rules)
    # a span that starts after all earlier ones ended is the text since then and the mark; others add nothing
    ended = _running(F.transform("spans", lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    walked = _let(ended, lambda ends: F.concat(
        F.array_join(F.zip_with("spans", _shifted(ends), lambda s, at: F.when(
            s["start"] >= at, F.concat(F.substring(F.col("text"), at + 1, s["start"] - at), F.lit("[SECRET]"))
        ).otherwise("")), ""),
        F.substring(F.col("text"), F.element_at(ends, -1) + 1, F.length("text")),
    ))
    text = F.when(F.col("doc_id.null"), None).when(F.size("spans") == 0, F.col("text")).otherwise(walked)
    found = found.select("doc_id", (F.size("spans") > 0).alias("changed"), text.alias("text"))
    columns = {c: F.col("doc_id.rest")[c] for c in rest} | {"text": F.col("text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("changed"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return found.select(*[columns[c].alias(c) for c in docs.columns])
