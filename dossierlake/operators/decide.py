"""Policies over facts, subject groups, review reasons and quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake.functions import text as T


def evaluate_policies(cases: DataFrame, rules: DataFrame) -> DataFrame:
    """Status of every (case, active rule) whose window holds the case's day; others give no row.

    ``cases`` (case_id, day, subject_group, facts map<string,string>), ``rules`` (rule_id, groups, required,
    effective_from, effective_to, active). Rules are a short configured list and are joined to all cases.
    """
    col = F.col
    day_ok = (col("effective_from").isNull() | (col("day") >= col("effective_from"))) & (col("effective_to").isNull() | (col("day") <= col("effective_to")))
    j = cases.join(F.broadcast(rules.filter("active")), day_ok)  # a configured list of rules
    missing = F.filter("required", lambda f: F.nullif(F.try_element_at(col("facts"), f), F.lit("")).isNull())
    status = (
        F.when(F.size("groups") == 0, "NOT_APPLICABLE")
        .when(T.first_present(col("subject_group")).isNull(), "INSUFFICIENT_DATA")
        .when(~F.array_contains("groups", "*") & ~F.exists("groups", lambda g: g == col("subject_group")), "NOT_APPLICABLE")
        .when(F.size(missing) > 0, "INSUFFICIENT_DATA")
        .otherwise("ELIGIBLE")
    )
    return j.select("case_id", "rule_id", status.alias("status"), F.array_join(missing, "|").alias("missing"))


def fold_statuses(assessed: DataFrame) -> DataFrame:
    """One status per case: INSUFFICIENT_DATA beats ELIGIBLE beats what is negative throughout."""
    g = assessed.groupBy("case_id").agg(F.bool_or(F.col("status") == "INSUFFICIENT_DATA").alias("i"), F.bool_or(F.col("status") == "ELIGIBLE").alias("e"))
    return g.select("case_id", F.when(F.col("i"), "INSUFFICIENT_DATA").when(F.col("e"), "ELIGIBLE").otherwise("NOT_ELIGIBLE").alias("status"))


#: Review reasons, first that applies.
REASONS = (
    "BATCH_WARNING", "PERSON_UNIT_CONFLICT", "PERSON_STATUS", "UNIT_STATUS", "ORGANIZATION_TYPE_UNKNOWN", "DOCUMENT_PARSE_LOW_CONFIDENCE",
    "DOCUMENT_EXTRACTION_LOW_CONFIDENCE", "CURRENT_WORK_UNIT_UNCERTAIN", "SUBJECT_GROUP_INSUFFICIENT", "POLICY_INSUFFICIENT_DATA",
)


def review_reason(flags: list[Column]) -> Column:
    """First reason of ``REASONS`` whose flag holds; null flags do not hold."""
    return F.coalesce(*[F.when(f, F.lit(r)) for f, r in zip(flags, REASONS)])


def least_confidence(*cs: Column) -> Column:
    """Least of the confidences that are there."""
    return F.array_min(F.array_compact(F.array(*cs)))


def status_category(workflow: Column, resolution: Column, organization: Column) -> Column:
    """verified, out_of_scope, need_review or no_conclusion; the order of the tests decides."""
    return (
        F.when(workflow == "FAILED", "no_conclusion")
        .when((resolution == "MATCHED") & organization.isin("BCA", "BQP"), "verified")
        .when((resolution == "MATCHED") & (organization == "OTHER"), "out_of_scope")
        .when((workflow == "NEED_REVIEW") | resolution.isin("AMBIGUOUS", "CONFLICT"), "need_review")
        .otherwise("no_conclusion")
    )


# Groups of subjects, their keywords by organisation, and what says that a keyword does not hold.
KNOWN_GROUPS = ("CAND", "QUAN_NHAN", "CO_YEU_HUONG_LUONG_NHU_QUAN_NHAN")
GROUP_RULES = {
    "BCA": [("CAND", 0.95, ["si quan cong an", "ha si quan cong an", "chien si cong an", "cong an nhan dan", "cand"])],
    "BQP": [("CO_YEU_HUONG_LUONG_NHU_QUAN_NHAN", 0.90, ["co yeu"]), ("QUAN_NHAN", 0.92, ["quan nhan", "si quan", "ha si quan", "binh si", "quan doi nhan dan"])],
}
NEGATED = r"(?:khong phai|khong thuoc|khong la|chua phai|chua la|khong con|thoi khong con)(?: +(?:la|mot|dang|hien|thuoc|trong|bien che)){0,3} +$"
PAST_ROLE = r"(?:(?:da )?tung la +$|truoc day (?:la +)?$|nguyen la +$)"
HAS_LEFT = r"\b(?:nhung )?(?:nay|hien nay|hien tai) (?:da )?(?:khong con|khong) (?:cong tac|phuc vu|thuoc|trong bien che)\b|\b(?:da )?(?:thoi cong tac|xuat ngu|chuyen nganh)\b"
BEFORE, AFTER = 40, 140


def _affirmed(folded: Column, word: str) -> Column:
    """Whether a word stands somewhere in a folded text neither negated just before nor as a past role that was left just after."""
    parts = F.split(folded, word, -1)
    # before and after a place: what came up to it, and what follows it, occurrences included
    upto = lambda n: F.array_join(F.slice(parts, F.lit(1), n), word)
    rest = lambda n: F.array_join(F.slice(parts, n + 1, F.size(parts)), word)

    def holds(n: Column) -> Column:
        before = F.regexp_extract(upto(n), rf"(?s).{{0,{BEFORE}}}$", 0)
        after = F.substring(rest(n), 1, AFTER)
        return ~before.rlike(NEGATED) & ~(before.rlike(PAST_ROLE) & after.rlike(HAS_LEFT))

    return (F.size(parts) > 1) & F.exists(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), holds)


def subject_group(organization: Column, position: Column, text: Column, explicit: Column) -> Column:
    """struct<subject_group,confidence,method> of a subject: the group that was entered, if it is known; else the first whose
    keyword its organisation's rules find in position and text, affirmed."""
    def found(name: str | None, confidence: float, how: str) -> Column:
        return F.struct(F.lit(name).cast("string").alias("subject_group"), F.lit(confidence).alias("confidence"), F.lit(how).alias("method"))

    given = F.upper(F.trim(explicit))
    folded = T.ascii_key(F.concat_ws(" ", F.coalesce(position, F.lit("")), F.coalesce(text, F.lit(""))))
    out = F.when(given.isin(*KNOWN_GROUPS), F.struct(given.alias("subject_group"), F.lit(1.0).alias("confidence"), F.lit("EXPLICIT_FIELD").alias("method")))
    out = out.when(F.coalesce(explicit, F.lit("")) != "", found(None, 0.0, "INVALID_EXPLICIT_GROUP"))
    for org, rules in GROUP_RULES.items():
        for name, confidence, words in rules:
            hit = F.lit(False)
            for w in words:
                hit = hit | _affirmed(folded, w)
            out = out.when((organization == org) & hit, found(name, confidence, "RULE_TEXT"))
    return out.otherwise(found(None, 0.0, "INSUFFICIENT_EVIDENCE"))


# Thresholds of a case's decision, and ways of reading that are character recognition.
LEAST_EXTRACTION, LEAST_RELATION, LEAST_PARSE, LEAST_OCR = 0.75, 0.70, 0.60, 0.70
OCR_METHODS = ("OCR", "PADDLE_OCR", "PDF_HYBRID")


def parse_is_low(confidence: Column, method: Column, gate: Column) -> Column:
    """Whether a document was read badly: its gate failed, or its confidence, if there is one, is under the least of its method."""
    least = F.when(F.coalesce(method.isin(*OCR_METHODS), F.lit(False)), LEAST_OCR).otherwise(LEAST_PARSE)
    return F.coalesce(F.upper(gate) == "FAIL", F.lit(False)) | F.coalesce(confidence < least, F.lit(False))


def case_reason(c: dict[str, Column]) -> Column:
    """Why a case goes to review, the first reason that holds; null if none does and its policies have the facts they need.

    ``c`` has warning (code of the first warning of its batch), conflict (person and unit disagree), person and unit (statuses; a null
    person was not asked for), organization, parse (whether it is low), extraction and relation (confidences), lookup (a bare name or
    unit was asked for, so that no relation is due), group and insufficient (a policy lacks facts).
    """
    low = lambda x, least: F.coalesce(x, F.lit(0.0)) < least
    return (
        F.when(F.coalesce(c["warning"], F.lit("")) != "", c["warning"])
        .when(F.coalesce(c["conflict"], F.lit(False)), "PERSON_UNIT_CONFLICT")
        .when(c["person"].isNotNull() & (c["person"] != "MATCHED"), F.concat(F.lit("PERSON_"), c["person"]))
        .when(~c["unit"].eqNullSafe("MATCHED"), F.coalesce(c["unit"], F.lit("NOT_FOUND")))
        .when(F.coalesce(c["organization"], F.lit("UNKNOWN")) == "UNKNOWN", "ORGANIZATION_TYPE_UNKNOWN")
        .when(F.coalesce(c["parse"], F.lit(False)), "DOCUMENT_PARSE_LOW_CONFIDENCE")
        .when(low(c["extraction"], LEAST_EXTRACTION), "DOCUMENT_EXTRACTION_LOW_CONFIDENCE")
        .when(~F.coalesce(c["lookup"], F.lit(False)) & low(c["relation"], LEAST_RELATION), "CURRENT_WORK_UNIT_UNCERTAIN")
        .when(c["group"].isNull(), "SUBJECT_GROUP_INSUFFICIENT")
        .when(F.coalesce(c["insufficient"], F.lit(False)), "POLICY_INSUFFICIENT_DATA")
    )


def decide_cases(cases: DataFrame, rules: DataFrame) -> DataFrame:
    """The decision of every case: consistency, decision_confidence, workflow (COMPLETED or NEED_REVIEW), reason, policies.

    ``cases`` has a row each: case_id, day; what was read: subject_name, subject_code, unit_name, unit_code, name_score, code_score,
    extraction, relation, parse_confidence, parse_method, parse_gate; what was resolved: person_status, person_unit, person_confidence
    (null where no person was asked for), unit_status, unit_id, unit_confidence, organization; subject_group, facts
    (map<string,string>) and warnings (array<string>). ``rules`` are those of ``evaluate_policies``.

    A name or code without any unit, or a unit's code without its name, is a lookup: what identifies it is its extraction, and
    no relation is due. Person and unit conflict if both are matched and the person is of another unit. The confidence is the
    least of those that are due, 0 in a conflict. Policies are asked only where nothing else sends the case to
    review; one that lacks facts does. A null or empty value was not given; a null confidence that is due counts as 0.
    """
    given = lambda *cs: F.coalesce(*[T.first_present(F.col(c)) for c in cs]).isNotNull()
    named, coded, person = given("unit_name"), given("unit_code"), given("subject_name", "subject_code")
    lookup = (person & ~named & ~coded) | (coded & ~named)
    asserted = named | coded
    matched = lambda c: F.coalesce(F.col(c) == "MATCHED", F.lit(False))
    conflict = asserted & person & matched("person_status") & matched("unit_status") & F.coalesce(F.col("person_unit") != F.col("unit_id"), F.lit(False))
    consistency = F.when(conflict, "CONFLICT").when(asserted & person & matched("person_status") & matched("unit_status"), "MATCHED").when(person & asserted, "UNVERIFIED").otherwise("NOT_APPLICABLE")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    rows = cases.withColumns({
        "lookup": lookup, "asked": person, "conflict": conflict, "consistency": consistency,
        "parse_low": parse_is_low(F.col("parse_confidence"), F.col("parse_method"), F.col("parse_gate")),
        "identity": F.when(lookup, F.coalesce(least_confidence(F.col("name_score"), F.col("code_score")), F.lit(0.0))).otherwise(zero("extraction")),
    })
    due = least_confidence(
        F.col("identity"), zero("unit_confidence"), F.when(~F.col("lookup"), zero("relation")), F.when(F.col("asked"), F.coalesce("person_confidence", F.lit(0.0))), F.when(F.col("conflict"), 0.0)
    )
    reason = lambda insufficient: case_reason({
        "warning": F.get("warnings", F.lit(0)), "conflict": F.col("conflict"), "person": F.when(F.col("asked"), F.coalesce("person_status", F.lit("NOT_FOUND"))), "unit": F.col("unit_status"), "organization": F.col("organization"),
        "parse": F.col("parse_low"), "extraction": F.col("identity"), "relation": F.col("relation"), "lookup": F.col("lookup"), "group": F.col("subject_group"), "insufficient": insufficient,
    })
    rows = rows.withColumn("decision_confidence", due).withColumn("upstream", reason(F.lit(False)))
    policies = evaluate_policies(rows.filter("upstream is null").select("case_id", "day", "subject_group", "facts"), rules)
    told = policies.groupBy("case_id").agg(F.bool_or(F.col("status") == "INSUFFICIENT_DATA").alias("insufficient"), F.array_sort(F.collect_list(F.struct("rule_id", "status"))).alias("policies"))  # a row a rule
    rows = rows.join(told, "case_id", "left")
    why = F.coalesce("upstream", reason(F.coalesce("insufficient", F.lit(False))))
    return rows.select(
        "case_id", "consistency", "decision_confidence", F.when(why.isNull(), "COMPLETED").otherwise("NEED_REVIEW").alias("workflow"), why.alias("reason"),
        F.coalesce("policies", F.array().cast(told.schema["policies"].dataType)).alias("policies"),
    )


def request_reviews(requests: DataFrame, cases: DataFrame, reviews: DataFrame) -> DataFrame:
    """(case_id, outcome) of requests (case_id) for a review of cases (case_id, workflow, concluded), given reviews (case_id, status).

    Refused: a case that is not there, still in flight, or concluded. A case with an open review keeps that one; repeated
    requests make one.
    """
    open_ones = reviews.filter("status = 'OPEN'").select("case_id", F.lit(True).alias("open")).distinct()
    rows = requests.select("case_id").distinct().join(cases, "case_id", "left").join(open_ones, "case_id", "left")
    outcome = (
        F.when(F.col("workflow").isNull(), "NOT_FOUND").when(F.col("open"), "ALREADY_OPEN").when(~F.col("workflow").isin("COMPLETED", "NEED_REVIEW", "FAILED"), "IN_FLIGHT")
        .when(F.col("concluded"), "CONCLUDED").otherwise("CREATED")
    )
    return rows.select("case_id", outcome.alias("outcome"))


SCOPE_CANDIDATES = 5  # fixed value: candidates that a review's scope is taken from
#: What a decision makes of an open review.
DECISIONS = {"CONFIRM": "RESOLVED", "UNKNOWN": "RESOLVED", "INSUFFICIENT": "RESOLVED", "DISMISS": "DISMISSED"}


def in_scope(me: int | str, admin: bool, groups: list, view_all: bool) -> Column:
    """Rows (coverage_group, assigned_to) that a user may see: administrators and the group * all; without groups all or none;
    else those of the groups that are assigned to nobody else."""
    if admin or "*" in groups or (not groups and view_all):
        return F.lit(True)
    if not groups:
        return F.lit(False)
    return F.col("coverage_group").isin(*groups) & (F.col("assigned_to").isNull() | (F.col("assigned_to") == me))


def review_scope(groups: Column) -> Column:
    """The one group of an array, nulls aside, or UNASSIGNED."""
    found = F.array_distinct(F.array_compact(groups))
    return F.when(F.size(found) == 1, found[0]).otherwise("UNASSIGNED")


def siblings(asked: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, sibling, block): other cases of the group of each case asked for, of the same owner.

    Both (case_id, owner, key): key is the group and the place in it, with a colon between.
    """
    group = F.substring_index("key", ":", 1)
    a = asked.filter(F.contains("key", F.lit(":"))).select("case_id", "owner", group.alias("grp"))
    b = cases.filter(F.contains("key", F.lit(":"))).select(F.col("case_id").alias("sibling"), "owner", group.alias("grp"), F.substring_index("key", ":", -1).try_cast("int").alias("block"))
    return a.join(b, ["owner", "grp"]).filter("case_id <> sibling").select("case_id", "sibling", F.coalesce("block", F.lit(0)).alias("block"))


def apply_decisions(reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    """Reviews (review_id, version_no, status) after decisions (review_id, expected_version, decision), with ``error`` where one was
    refused: an unknown decision, a review that is not open, or one that has changed since. One decision a review."""
    table = F.create_map(*[F.lit(x) for p in DECISIONS.items() for x in p])
    rows = reviews.join(decisions, "review_id", "left")
    to = table[F.col("decision")]
    error = F.when(F.col("decision").isNull(), None).when(to.isNull(), "UNKNOWN_DECISION").when(F.col("status") != "OPEN", "NOT_OPEN").when(~F.col("version_no").eqNullSafe(F.col("expected_version")), "STALE_VERSION")
    done = F.col("decision").isNotNull() & error.isNull()
    return rows.select("review_id", error.alias("error"), F.when(done, to).otherwise(F.col("status")).alias("status"), (F.col("version_no") + done.cast("int")).alias("version_no"))
