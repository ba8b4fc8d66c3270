"""Synthetic dossiers: noise on names, spans of mentions, policy outcomes, generation by rule and its gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake.functions import text as T
from dossierlake.operators import registry

# Kinds of noise and the outcomes of the synthetic policy.
NOISES = ("NONE", "NO_ACCENT", "LOWERCASE", "TYPO_UNIT", "ABBREVIATION", "OCR_LIKE")
REQUIRED = ("organization_type", "subject_group", "employment_status", "assessment_date")
OUTCOMES = {
    "missing": ("SYN-POL-MISSING", "INSUFFICIENT_DATA", "INSUFFICIENT_DATA", "MISSING_REQUIRED_FIELDS"),
    "outside": ("SYN-POL-NO-EFFECTIVE-RULE", "NOT_APPLICABLE", "NOT_ELIGIBLE", "NO_EFFECTIVE_RULE"),
    "contract": ("SYN-POL-CONTRACT", "NOT_APPLICABLE", "NOT_APPLICABLE", "SYNTHETIC_CONTRACT_RULE"),
    "active": ("SYN-POL-ACTIVE", "APPLICABLE", "ELIGIBLE", "SYNTHETIC_ACTIVE_RULE"),
    "fallback": ("SYN-POL-FALLBACK", "NOT_APPLICABLE", "NOT_ELIGIBLE", "NO_SYNTHETIC_RULE_MATCH"),
}


def pick(seed: Column, n: int | Column) -> Column:
    """A number from 0 below ``n`` that a hash of ``seed`` decides."""
    return F.pmod(F.xxhash64(seed), (F.lit(n) if isinstance(n, int) else n).cast("long"))


def weighted(seed: Column, weights: dict[str, float]) -> Column:
    """One of the names, as often as its weight says, by a hash of ``seed``."""
    total, at, out = sum(weights.values()), 0.0, None
    share = (F.pmod(F.xxhash64(seed), F.lit(1_000_000)) / 1_000_000) * total
    for name, w in weights.items():
        at += w
        out = F.when(share < at, name) if out is None else out.when(share < at, name)
    return out.otherwise(list(weights)[-1])


def ocr_like(c: Column) -> Column:
    return F.replace(F.replace(T.strip_marks(c), F.lit("rn"), F.lit("m")), F.lit("cl"), F.lit("d"))


def acronym(c: Column) -> Column:
    """Capital first letters of the first eight words."""
    return F.array_join(F.transform(F.slice(F.regexp_extract_all(c, F.lit("[A-Za-zÀ-ỹ0-9]+"), F.lit(0)), 1, 8), lambda w: F.upper(F.substring(w, 1, 1))), "")


def typo(c: Column, seed: Column) -> Column:
    """One letter lost, swapped with the next or doubled; place and kind by a hash of ``seed``. Short texts lose none."""
    letters = F.filter(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(c, i, F.lit(1)).rlike(r"\p{L}"))
    at = F.element_at(letters, (pick(F.concat(seed, F.lit("place")), F.size(letters)) + 1).cast("int"))
    kind = pick(F.concat(seed, F.lit("kind")), 3)
    head, here, tail = F.substring(c, F.lit(1), at - 1), F.substring(c, at, F.lit(1)), F.substring(c, at + 1, F.length(c))
    lost = F.concat(head, tail)
    swapped = F.concat(head, F.substring(tail, 1, 1), here, F.substring(tail, F.lit(2), F.length(c)))
    doubled = F.concat(head, here, here, tail)
    return F.when(F.size(letters) == 0, c).when((kind == 0) & (F.length(c) > 5), lost).when((kind == 1) & (at < F.length(c)), swapped).otherwise(doubled)


def noisy_name(name: Column, noise: Column, seed: Column) -> Column:
    return (
        F.when(noise == "NO_ACCENT", T.strip_marks(name)).when(noise == "LOWERCASE", F.lower(name)).when(noise == "TYPO_UNIT", typo(name, seed))
        .when(noise == "ABBREVIATION", acronym(name)).when(noise == "OCR_LIKE", ocr_like(name)).otherwise(name)
    )


def noisy_text(text: Column, noise: Column) -> Column:
    return F.when(noise == "NO_ACCENT", T.strip_marks(text)).when(noise == "LOWERCASE", F.lower(text)).when(noise == "OCR_LIKE", ocr_like(text)).otherwise(text)


def span(text: Column, mention: Column) -> Column:
    """struct<start,end> of the first place of a mention, characters from 0; null for none or an empty mention."""
    at = F.position(mention, text)
    return F.when((mention != "") & (at > 0), F.struct((at - 1).alias("start"), (at - 1 + F.length(mention)).alias("end")))


def annotate(rows: DataFrame) -> DataFrame:
    """(record_id, entities, relations) of rows (record_id, text, person, code, position, current, former).

    Entities are the mentions found, array<struct<role,label,start,end>>; relations lead from the person to what was
    found beside it, array<struct<type,subject,object>> with places in entities, from 0.
    """
    labels = {"person": "PERSON", "code": "PERSONAL_CODE", "position": "POSITION", "current": "ORG", "former": "ORG"}
    found = F.array_compact(F.array(*[F.when(span(F.col("text"), F.col(r)).isNotNull(), F.struct(F.lit(r).alias("role"), F.lit(lab).alias("label"), span(F.col("text"), F.col(r))["start"].alias("start"), span(F.col("text"), F.col(r))["end"].alias("end"))) for r, lab in labels.items()]))
    rows = rows.select("record_id", found.alias("entities"))
    place = lambda role: F.array_position(F.transform("entities", lambda e: e["role"]), role) - 1
    kinds = (("CURRENT_WORK_UNIT", "current"), ("FORMER_WORK_UNIT", "former"), ("HAS_POSITION", "position"))
    links = F.array_compact(F.array(*[F.when((place("person") >= 0) & (place(r) >= 0), F.struct(F.lit(k).alias("type"), place("person").alias("subject"), place(r).alias("object"))) for k, r in kinds]))
    return rows.select("record_id", "entities", links.alias("relations"))


def policy(facts: dict[str, Column], start: Column, end: Column) -> Column:
    """struct<policy_id,salary_status,eligibility_status,reason> of the synthetic policy, in force from start to end (null: open)."""
    def told(name: str) -> Column:
        return F.struct(*[F.lit(v).alias(n) for n, v in zip(("policy_id", "salary_status", "eligibility_status", "reason"), OUTCOMES[name])])

    missing = F.lit(False)
    for name in REQUIRED:
        missing = missing | (F.coalesce(facts[name].cast("string"), F.lit("")) == "")
    day = facts["assessment_date"].cast("date")
    active = facts["organization_type"].isin("BCA", "BQP") & facts["employment_status"].isin("ACTIVE", "TEMPORARY")
    return (
        F.when(missing, told("missing")).when((day < start) | F.coalesce(day > end, F.lit(False)), told("outside"))
        .when(facts["subject_group"] == "CONTRACT_WORKER", told("contract")).when(active, told("active")).otherwise(told("fallback"))
    )


BUCKETS = 4096  # of a hash, by its first three digits


def ranked_split(rows: DataFrame, key: str, upto: dict[str, float]) -> DataFrame:
    """Rows with ``split``: the first name whose bound their rank reaches at most, 0 to 1, in the order of a hash of a unique ``key``.

    Ranks come from counts a bucket of the hash and ranks within buckets, so no task orders all rows.
    """
    text = F.col(key).cast("string")
    hashed = rows.withColumn("hash of key", F.sha2(text.cast("binary"), 256)).withColumn("bucket of hash", F.substring("hash of key", 1, 3))
    counts = hashed.groupBy("bucket of hash").agg(F.count(F.lit(1)).alias("n of bucket"))
    order = registry.Window.orderBy("bucket of hash")  # a row a bucket
    counts = counts.withColumn("before bucket", F.sum("n of bucket").over(order) - F.col("n of bucket")).withColumn("n of all", F.sum("n of bucket").over(registry.Window.partitionBy()))
    place = F.row_number().over(registry.Window.partitionBy("bucket of hash").orderBy("hash of key", key)) - 1
    ranked = hashed.join(F.broadcast(counts), "bucket of hash").withColumn("split", (F.col("before bucket") + place) / F.greatest(F.col("n of all") - 1, F.lit(1)))
    out = None
    for name, bound in upto.items():
        out = F.when(F.col("split") <= bound, name) if out is None else out.when(F.col("split") <= bound, name)
    return ranked.withColumn("split", out).select(*[c for c in rows.columns if c != "split"], "split")


def generate(units: DataFrame, per_unit: int, noises: dict[str, float], history: float, start: str, end: str | None) -> DataFrame:
    """``per_unit`` dossiers of every unit of units (unit_id, name, org): names, noise, history, facts, policy, text, split.

    Every choice is a hash of the record's id, so a record is alike wherever and whenever it is made. The first
    ``history`` share of a unit's records speaks of a former unit too. A unit is in one split: 70 of 100 units train.
    """
    n = F.row_number().over(registry.Window.partitionBy("unit_id").orderBy("local"))
    rows = units.select("unit_id", "name", "org", F.explode(F.sequence(F.lit(0), F.lit(per_unit - 1))).alias("local"))
    rows = rows.withColumn("n", n).withColumn("record_id", F.concat_ws("-", F.lit("REC"), F.col("unit_id").cast("string"), F.col("n").cast("string")))
    seed = lambda what: F.concat(F.col("record_id"), F.lit(what))
    names = lambda what, options: F.element_at(F.array(*map(F.lit, options)), (pick(seed(what), len(options)) + 1).cast("int"))
    rows = rows.select(
        "record_id", "unit_id", "name", "org", (F.col("local") < history * per_unit).alias("historic"), weighted(seed("noise"), noises).alias("noise_type"),
        F.concat_ws(" ", names("family", ("Nguyễn", "Trần", "Lê", "Phạm")), names("middle", ("Văn", "Minh", "Thu")), names("given", ("An", "Bình", "Chi", "Dũng"))).alias("full_name"),
        F.concat(F.lit("SYN-"), F.col("org"), F.lit("-"), F.col("record_id")).alias("personal_code"), names("position", ("Đội trưởng", "Cán bộ", "Trưởng phòng")).alias("position"),
        names("group", ("CAND", "CONTRACT_WORKER", "STAFF")).alias("subject_group"), names("employment", ("ACTIVE", "TEMPORARY", "RETIRED")).alias("employment_status"),
        F.date_add(F.lit("2024-01-01").cast("date"), pick(seed("day"), 900).cast("int")).alias("assessment_date"),
    )
    facts = {"organization_type": F.col("org")} | {c: F.col(c) for c in ("subject_group", "employment_status", "assessment_date")}
    rows = rows.withColumn("policy", policy(facts, F.lit(start).cast("date"), F.lit(end).cast("date")))
    mention = noisy_name(F.col("name"), F.col("noise_type"), F.col("record_id"))
    former = F.when(F.col("historic"), F.concat(F.lit("Cục số "), pick(seed("former"), 90).cast("string")))
    rows = rows.withColumn("unit_mention", mention).withColumn("former_mention", former)
    text = F.concat(F.lit("Đồng chí "), F.col("full_name"), F.coalesce(F.concat(F.lit(" trước đây công tác tại "), F.col("former_mention"), F.lit(",")), F.lit("")), F.lit(" hiện công tác tại "), F.col("unit_mention"), F.lit("; chức vụ: "), F.col("position"), F.lit("; mã: "), F.col("personal_code"))
    split = pick(F.col("unit_id").cast("string"), 100)
    split = F.when(split < 70, "train").when(split < 85, "validation").otherwise("test")
    return rows.withColumn("raw_text", noisy_text(text, F.col("noise_type"))).withColumn("split", split).withColumn("expected_status", F.lit("MATCHED"))


def gates(rows: DataFrame) -> DataFrame:
    """(gate, violations): ids that repeat, units in several splits, records not found that claim an organisation outside scope."""
    repeated = registry.duplicates(rows, ["record_id"]).agg(F.lit("duplicate_record_id").alias("gate"), F.count(F.lit(1)).alias("violations"))
    leaked = rows.groupBy("unit_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").agg(F.lit("split_leakage").alias("gate"), F.count(F.lit(1)).alias("violations"))
    outside = rows.filter("expected_status = 'NOT_FOUND' and org = 'OTHER'").agg(F.lit("not_found_is_not_other").alias("gate"), F.count(F.lit(1)).alias("violations"))
    return repeated.unionByName(leaked).unionByName(outside)
