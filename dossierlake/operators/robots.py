"""Robots rules: files of hosts as rows of rules, and which addresses they let an agent read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def origin_of(url: Column) -> Column:
    """Scheme, host and port of an address, in lower case."""
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """Path and query of an address, / if there is none; the fragment does not count."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", ""), "#.*$", "")
    return F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))


def parse_rules(files: DataFrame) -> DataFrame:
    """(origin, nth, agent, allow, pattern) of robots files (origin, content); a null or empty file has none.

    Agents in a row share the rules after them; a rule before any agent is nobody's. Comments, blanks and other fields do
    not count, nor does an empty Disallow. Of an origin with several files all count, in the order of their content.
    """
    lines = files.select("origin", "content", F.posexplode(F.split("content", "\r\n|\r|\n")).alias("at", "line"))
    field = F.regexp_extract(F.regexp_replace("line", "#.*$", ""), r"^\s*([A-Za-z\-]+)\s*:\s*(.*?)\s*$", 1)
    value = F.regexp_extract(F.regexp_replace("line", "#.*$", ""), r"^\s*([A-Za-z\-]+)\s*:\s*(.*?)\s*$", 2)
    told = lines.select("origin", "content", "at", F.lower(field).alias("field"), value.alias("value")).filter(F.col("field").isin("user-agent", "allow", "disallow"))
    order = Window.partitionBy("origin").orderBy("content", "at")  # the lines of a robots file
    agent = F.col("field") == "user-agent"
    begins = agent & F.coalesce(F.lag("field").over(order) != "user-agent", F.lit(True))
    grouped = told.withColumn("begins", begins).withColumn("group", F.sum(F.col("begins").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(order))
    agents = grouped.filter(agent).select("origin", "group", F.lower("value").alias("agent")).distinct()
    rules = grouped.filter(~agent & (F.col("value") != "")).select("origin", "group", "nth", (F.col("field") == "allow").alias("allow"), F.col("value").alias("pattern"))
    return agents.join(rules, ["origin", "group"]).select("origin", "nth", "agent", "allow", "pattern")


def _matches(path: Column, pattern: Column) -> Column:
    """Whether a path begins with a pattern, in which * is anything and $ at the end is the path's end."""
    ended = pattern.endswith("$")
    bare = F.when(ended, F.substring(pattern, F.lit(1), F.length(pattern) - 1)).otherwise(pattern)
    quoted = F.regexp_replace(bare, r"[\\.\[\](){}+?^$|]", r"\\$0")
    regex = F.concat(F.lit("^"), F.regexp_replace(quoted, r"\*+", ".*"), F.when(ended, F.lit("$")).otherwise(F.lit("")))
    return F.when(bare.contains("*") | ended, F.rlike(path, regex)).otherwise(F.startswith(path, bare))


def may_read(urls: DataFrame, rules: DataFrame, agent: str, first: bool = False) -> DataFrame:
    """(url, allowed) of distinct addresses (url) under ``rules`` of their origins.

    The rules of groups that name the agent count, else those of all agents (*). The longest pattern that matches decides, of
    two as long the one that allows; with ``first`` the first that matches, as older readers have it. Without a
    match, without rules and without an origin an address is allowed. An origin's rules are few, its addresses may be very
    many: each meets the rules and is reduced to one row.
    """
    name = agent.lower()
    named = (F.col("agent") != "*") & F.lit(name).contains(F.col("agent"))
    own = rules.filter(named | (F.col("agent") == "*")).withColumn("named", named)
    special = own.groupBy("origin").agg(F.bool_or("named").alias("special"))
    own = own.join(special, "origin").filter(F.col("named") == F.col("special")).select("origin", "nth", "allow", "pattern").distinct()
    asked = urls.select("url").distinct().withColumn("origin", origin_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    met = asked.join(own, "origin", "left")
    hit = F.coalesce(_matches(F.col("path"), F.col("pattern")), F.lit(False))
    rank = F.struct(-F.col("nth")) if first else F.struct(F.length("pattern"), F.col("allow"))
    return met.groupBy("url").agg(F.coalesce(F.max_by("allow", F.when(hit, rank)), F.lit(True)).alias("allowed"))
