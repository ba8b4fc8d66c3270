"""Registry build, publication, comparison and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossierlake.functions import text as T
from dossierlake.sources.shared import written

MIN_CHARS, MAX_CHARS, CORROBORATION = 5, 180, 2
# Words at which a name ends, signs around a name, and its most words.
STOP_WORDS = ["đã", "đang", "sẽ", "và", "cùng", "tổ chức", "chủ trì", "tham dự", "phối hợp", "thực hiện", "triển khai", "cho biết", "tại", "theo", "trong"]
AROUND, AT_END, MOST_WORDS = " \t\r\n,;:.–-()[]{}", " ,;:.-", 24


def clean_candidate(raw: Column) -> Column:
    """A matched name without signs around it and without what follows a stop word, of ``MOST_WORDS`` words at most."""
    bare = F.btrim(F.regexp_replace(raw, r"\s+", " "), F.lit(AROUND))
    cut = F.btrim(F.regexp_replace(bare, rf"(?iuU)\s+(?:{'|'.join(STOP_WORDS)})\b.*$", ""))
    return F.btrim(F.array_join(F.slice(F.split(cut, " "), 1, MOST_WORDS), " "), F.lit(AT_END))


def page_candidates(pages: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """(page_id, org, name) of every match of each (org, pattern) in pages (page_id, text), cleaned and of usable length."""
    out = None
    for org, pattern in patterns:
        found = pages.select("page_id", F.lit(org).alias("org"), F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("raw"))
        out = found if out is None else out.unionByName(found)
    name = clean_candidate(F.col("raw"))
    return out.select("page_id", "org", name.alias("name")).filter(F.length("name").between(MIN_CHARS, MAX_CHARS))


def group_candidates(found: DataFrame) -> DataFrame:
    """One row per (org, key): the shortest then least spelling, evidence and approval.

    ``found`` has org, name, url, strong. Approved: any strong source, or ``CORROBORATION`` urls.
    """
    keyed = found.withColumn("key", T.normalize_text(F.col("name")))
    rows = keyed.groupBy("org", "key").agg(
        F.min(F.struct(F.length("name").alias("l"), F.col("name").alias("name")))["name"].alias("name"),
        F.bool_or("strong").alias("strong"), F.count_distinct("url").alias("evidence"), F.min("url").alias("url"),
    )
    return rows.withColumn("qa_status", F.when(F.col("strong") | (F.col("evidence") >= CORROBORATION), "APPROVED").otherwise("PENDING_QA"))


def dedupe(rows: DataFrame, keys: list[str], best: list[Column]) -> DataFrame:
    """First row of each key in the order ``best``, which must end in a unique column."""
    w = Window.partitionBy(*keys).orderBy(*best)
    nth = T.free_names(rows)("nth")
    return rows.withColumn(nth, F.row_number().over(w)).filter(F.col(nth) == 1).drop(nth)


def build(found: DataFrame, curated: DataFrame) -> DataFrame:
    """Grouped candidates and curated rows (org, key, name, qa_status, evidence) in one registry; approved and better evidenced rows win."""
    both = curated.select("org", "key", "name", "qa_status", "evidence", F.lit(0).alias("src")).unionByName(group_candidates(found).select("org", "key", "name", "qa_status", "evidence", F.lit(1).alias("src")))
    best = [F.desc(F.col("qa_status") == "APPROVED"), F.desc("evidence"), F.col("src"), F.col("name")]
    kept = dedupe(both, ["org", "key"], best)
    return kept.withColumn("unit_id", T.stable_id(F.col("org"), F.col("key"))).drop("src")


def publish(existing: DataFrame, fresh: DataFrame, keys: list[str], waiting: DataFrame | None = None, best: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(published, pending): existing rows stay, approved fresh ones join, others wait unless their key is published.

    Of fresh rows that share a key the first in the order ``best`` counts (of all columns, if none is given). Rows that were ``waiting``
    before stay as they are, ahead of fresh ones of their key, until their key is published.
    """
    order = best or [F.col(c) for c in fresh.columns]
    approved = dedupe(fresh.filter("qa_status = 'APPROVED'"), keys, order).join(existing, keys, "left_anti")
    published = existing.unionByName(approved, allowMissingColumns=True)
    pending = dedupe(fresh.filter("coalesce(qa_status, '') <> 'APPROVED'"), keys, order)
    if waiting is not None:
        pending = waiting.unionByName(pending.join(waiting, keys, "left_anti"), allowMissingColumns=True)
    return published, pending.join(published, keys, "left_anti")


def read_registries(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of CSV files with headers, all text, empty for absent, with ``ordinal``: their place if the files stood one after another.

    Every file is read in splits, side by side. A row's place within its split, the rows of the splits before it and of
    the files before those add up to its ordinal; only the counts of splits are ordered. A folder is a file of parts by name.
    """
    parts = []
    for k, path in enumerate(paths):
        rows = spark.read.csv(path, header=True, inferSchema=False)
        parts.append(rows.na.fill("").withColumns({"_file": F.lit(k), "_part": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_id": F.monotonically_increasing_id()}))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    rows = written(rows, "registries")  # the ids are kept as they were given
    where = ["_file", "_part", "_block"]
    splits = rows.groupBy(*where).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("_file").orderBy("_part", "_block").rowsBetween(Window.unboundedPreceding, -1))
    files = splits.groupBy("_file").agg(F.sum("_n").alias("_all"))
    ahead = files.alias("a").join(files.alias("b"), F.col("b._file") < F.col("a._file"), "left").groupBy(F.col("a._file").alias("_file")).agg(F.coalesce(F.sum("b._all"), F.lit(0)).alias("_ahead"))  # a row for each listed path
    placed = splits.withColumn("_before", F.coalesce(before, F.lit(0))).join(ahead, "_file").select(*where, "_first", (F.col("_before") + F.col("_ahead")).alias("_base"))
    kept = rows.na.fill("").join(placed, where)
    return kept.withColumn("ordinal", F.col("_base") + F.col("_id") - F.col("_first")).drop(*where, "_id", "_first", "_base")


def merge_registries(rows: DataFrame) -> DataFrame:
    """One row of each (organization_type, normalized_key) of registries (canonical_name, organization_type, qa_status, evidence_count, ordinal, ..).

    Keys are worked out anew from the name. Approved rows win, then better evidenced ones (no number counts as 1), then the
    first of the input; ``ordinal`` stays the input's. Each group is reduced before the shuffle, so
    very many rows of one key meet as a row for each task.
    """
    keyed = rows.withColumns({"normalized_key": T.normalize_text(F.col("canonical_name")), "ascii_key": T.ascii_key(F.col("canonical_name"))})
    evidence = F.coalesce(F.col("evidence_count").try_cast("double"), F.lit(1.0)) if "evidence_count" in rows.columns else F.lit(1.0)
    rank = F.struct((F.col("qa_status") == "APPROVED").cast("int").alias("approved"), evidence.alias("evidence"), (-F.col("ordinal")).alias("early"))
    keys = ["organization_type", "normalized_key"]
    best = keyed.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in keyed.columns if c not in keys]), rank).alias("row"))
    return best.select(*keys, "row.*")


def numbered(rows: DataFrame, by: str, name: str = "place") -> DataFrame:
    """``rows`` with their place, from 0, in the order of ``by``, whose values are unique: ranges are sorted side by side and their counts added up."""
    marked = written(rows.repartitionByRange(by).sortWithinPartitions(by).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_id", 33)
    counts = marked.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    base = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    offsets = counts.select("_part", base.alias("_base"))
    joined = marked.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return joined.withColumn(name, F.col("_base") + F.col("_id") - F.shiftleft("_part", 33)).drop("_part", "_base", "_id")


def version_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """ADDED, REMOVED or CHANGED keys with the changed fields, joined by |; nulls equal nulls."""
    a = old.select(F.col(key), F.lit(True).alias("_o"), *[F.col(f).alias(f"o_{f}") for f in fields])
    b = new.select(F.col(key), F.lit(True).alias("_n"), *[F.col(f).alias(f"n_{f}") for f in fields])
    j = a.join(b, key, "full_outer")
    changed = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"o_{f}").eqNullSafe(F.col(f"n_{f}")), F.lit(f)) for f in fields])), "|")
    change = F.when(F.col("_o").isNull(), "ADDED").when(F.col("_n").isNull(), "REMOVED").when(changed != "", "CHANGED")
    return j.select(key, change.alias("change"), F.when(change == "CHANGED", changed).alias("fields")).filter("change is not null")


def coverage(targets: DataFrame, counts: DataFrame, group: str) -> DataFrame:
    """Status of every target (group, expected, roster): rosters never count as complete."""
    j = targets.join(counts, group, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    status = F.when(F.col("n") == 0, "MISSING").when(F.col("roster"), "ROSTER_REQUIRED").when(F.col("n") >= F.col("expected"), "COMPLETE").otherwise("PARTIAL")
    return j.withColumn("status", status)


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def violations(checks: list[tuple[str, DataFrame]], limit: int = 200) -> DataFrame:
    """Sorted distinct violations (rule, item) of (rule, frame with item) checks; a report of ``limit`` rows."""
    out = None
    for rule, frame in checks:
        part = frame.select(F.lit(rule).alias("rule"), F.col("item").cast("string").alias("item"))
        out = part if out is None else out.unionByName(part)
    return out.distinct().orderBy("rule", "item").limit(limit)


def taxonomy(name: Column, rules: list[tuple[str, str]], default: str = "OTHER") -> Column:
    """Label of the first pattern that the name starts with."""
    out = None
    for pattern, label in rules:
        out = F.when(name.rlike(f"^(?:{pattern})"), label) if out is None else out.when(name.rlike(f"^(?:{pattern})"), label)
    return out.otherwise(default)


#: What a version may become, and by which step.
STEPS = {"validate": ("DRAFT", "VALIDATED"), "approve": ("VALIDATED", "APPROVED"), "publish": ("APPROVED", "PUBLISHED")}


def advance(versions: DataFrame, requests: DataFrame, snapshot_errors: DataFrame, at: Column) -> DataFrame:
    """Versions (version, status, published_at) after requests (version, step), with ``error`` where one was refused.

    A step needs the status before it; a version with errors (version, error) is not validated. Of the versions
    that one batch publishes the greatest name stays published, and every other published one is deprecated.
    """
    table = F.create_map(*[F.lit(x) for step, (a, b) in STEPS.items() for x in (step, F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")))])
    asked = versions.join(requests, "version", "left").join(snapshot_errors.select("version").distinct().withColumn("bad", F.lit(True)), "version", "left")
    move = table[F.col("step")]
    error = F.when(F.col("step").isNull(), None).when(move.isNull(), "UNKNOWN_STEP").when(move["a"] != F.col("status"), "WRONG_STATUS").when((F.col("step") == "validate") & F.col("bad"), "INVALID_SNAPSHOT")
    moved = asked.select("version", "published_at", "status", error.alias("error"), F.when(error.isNull() & F.col("step").isNotNull(), move["b"]).alias("to"))
    newest = moved.filter("to = 'PUBLISHED'").agg(F.max("version").alias("newest"))  # one row
    rows = moved.join(F.broadcast(newest))
    now = F.coalesce("to", "status")
    status = F.when((now == "PUBLISHED") & F.col("newest").isNotNull() & (F.col("version") != F.col("newest")), "DEPRECATED").otherwise(now)
    return rows.select("version", status.alias("status"), F.when((F.col("to") == "PUBLISHED") & (F.col("version") == F.col("newest")), at).otherwise(F.col("published_at")).alias("published_at"), "error")


def snapshot_errors(snapshot: DataFrame, units: DataFrame) -> DataFrame:
    """(version, error) of a snapshot's rows (version, unit_id, org, key, source_id, valid_from, valid_to) against units (unit_id, qa_status):
    equal keys of different units, units not approved, without a source, or with validity upside down."""
    twice = snapshot.groupBy("version", "org", "key").agg(F.count_distinct("unit_id").alias("n")).filter("n > 1").select("version", F.concat_ws(":", F.lit("duplicate_normalized_unit"), "org", "key").alias("error"))
    known = snapshot.join(units.select("unit_id", "qa_status"), "unit_id", "left")
    one = lambda what, test: known.filter(test).select("version", F.concat_ws(":", F.lit(what), F.col("unit_id").cast("string")).alias("error"))
    bad = one("unit_not_approved", "qa_status is null or qa_status <> 'APPROVED'").unionByName(one("unit_missing_source", "coalesce(source_id, '') = ''")).unionByName(one("invalid_validity", "valid_from > valid_to"))
    return twice.unionByName(bad).distinct()


def copy_snapshot(snapshot: DataFrame, base: str, version: str) -> DataFrame:
    """The rows of version ``base`` as a new version; folded keys are not copied and are worked out when read."""
    return snapshot.filter(F.col("version") == base).drop("ascii_key").withColumn("version", F.lit(version))


def rollback(versions: DataFrame, snapshot: DataFrame, target: str, version: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """(versions, snapshot) after a copy of ``target`` is published as ``version``; nothing changes if there is no such target."""
    fresh = versions.filter(F.col("version") == target).select(F.lit(version).alias("version"), F.lit("PUBLISHED").alias("status"), at.alias("published_at"))
    done = versions.join(F.broadcast(fresh.select(F.lit(True).alias("found"))), how="left")  # one row at most
    kept = done.select("version", F.when(F.col("found") & (F.col("status") == "PUBLISHED"), "DEPRECATED").otherwise(F.col("status")).alias("status"), "published_at")
    return kept.unionByName(fresh), snapshot.unionByName(copy_snapshot(snapshot, target, version), allowMissingColumns=True)


def latest_published(versions: DataFrame) -> DataFrame:
    """The version (version, status, published_at) published last, as one row; none if none is published."""
    return versions.filter("status = 'PUBLISHED'").orderBy(F.desc("published_at"), F.desc("version")).limit(1)
