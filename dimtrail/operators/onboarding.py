"""Messy feeds: mapping proposals, cleansing by a closed set of operations, record rules, exceptions and corrections."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimtrail.functions.text import ERROR_TYPE, cast_text, concat_fields, error_when, is_email, map_enum, mask_email, mask_name, mask_phone, norm_text, normalize_email, null_or_blank, parse_date, slug, token_similarity, trim_ws, type_compatible
from dimtrail.operators.profile import date_patterns, first_samples, profile_columns, top_values


@dataclass(frozen=True)
class CanonicalField:
    name: str
    type: str
    required: bool
    allowed: tuple[str, ...] = ()
    unique: bool = False


# The canonical customer record, version 1.
CUSTOMER_V1 = (
    CanonicalField("customer_id", "string", True, unique=True),
    CanonicalField("first_name", "string", True),
    CanonicalField("last_name", "string", True),
    CanonicalField("email", "string", True),
    CanonicalField("date_of_birth", "date", False),
    CanonicalField("status", "enum", True, ("ACTIVE", "INACTIVE")),
    CanonicalField("created_at", "datetime", True),
)
# Other names of the canonical fields.
ALIASES = {
    "customer_id": ("cust_id", "cust_no", "customer_no", "client_id", "client_no", "account_id", "account_no", "acct_code", "acct_no", "user_id", "user_identifier", "member_id", "id", "custid", "account_code"),
    "first_name": ("fname", "given_name", "forename", "first", "firstname"),
    "last_name": ("lname", "surname", "family_name", "last", "lastname"),
    "email": ("email_address", "contact_email", "billing_email", "reporter_email", "mail", "user_email", "customer_email", "e_mail"),
    "date_of_birth": ("birth_date", "birthdate", "dob", "bday", "birthday", "born_date"),
    "status": ("cust_status", "customer_status", "account_state", "state", "user_status", "account_status", "membership_status"),
    "created_at": ("created_timestamp", "create_date", "signup_date", "opened_date", "registration_date", "enrolled_at", "joined_date", "timestamp", "create_time"),
}
# Parts of a column's name that let it be a name of a person.
NAME_PARTS = {"first_name": "first|fname|given", "last_name": "last|lname|surname|family"}
PROPOSE, CANDIDATE, UNMAPPED_SCORE = 0.40, 0.35, 0.90


@dataclass(frozen=True)
class FieldMapping:
    """A canonical field's source columns and operations: (name, argument) pairs, applied in order."""

    target: str
    sources: tuple[str, ...]
    operations: tuple[tuple[str, object], ...] = field(default_factory=tuple)


def mapping_candidates(columns: DataFrame, canonical: Sequence[CanonicalField] = CUSTOMER_V1) -> DataFrame:
    """(source_field, target, score) of pairs that score at least CANDIDATE, score to 2 places.

    columns, as column_signals gives them: source_field (slug), type, uniqueness (share of different values), has_at,
    has_date, top_values (in upper case). The canonical side is fixed and small, so it is broadcast."""
    spark = columns.sparkSession
    rows = [(i, f.name, f.type, f.unique, list(f.allowed), [f.name, *ALIASES.get(f.name, ())], NAME_PARTS.get(f.name)) for i, f in enumerate(canonical)]
    fields = spark.createDataFrame(rows, "place int, target string, wanted string, is_key boolean, allowed array<string>, aliases array<string>, parts string")
    pairs = columns.crossJoin(F.broadcast(fields))
    alias = F.array_contains("aliases", F.col("source_field"))
    base = F.when(alias, 0.85).otherwise(0.7 * token_similarity("source_field", "target"))
    fits = F.when(type_compatible(F.col("type"), F.col("wanted")), 0.10).otherwise(-0.30)
    unique = F.when(F.col("is_key") & (F.col("uniqueness") == 1), 0.15).when(F.col("is_key") & (F.col("uniqueness") < 0.8), -0.50).otherwise(0.0)
    mail = F.when((F.col("target") == "email") & (F.col("has_at") | F.col("source_field").contains("email")), 0.20).otherwise(0.0)
    date = F.when(F.col("wanted").isin("date", "datetime") & (F.col("type").isin("date", "datetime") | F.col("has_date")), 0.15).otherwise(0.0)
    word = F.when(F.arrays_overlap("top_values", "allowed"), 0.20).otherwise(0.0)
    name = F.when(F.col("parts").isNotNull() & ~alias & ~F.regexp_like("source_field", F.col("parts")), -0.30).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + fits + unique + mail + date + word + name))
    kept = pairs.withColumn("score", score).where(F.col("score") >= CANDIDATE)
    return kept.select(*[c for c in ("source_id",) if c in columns.columns], "source_field", "target", F.bround("score", 2).alias("score"), "place")


def column_signals(feed: DataFrame, ordinal: str) -> DataFrame:
    """What mapping_candidates looks at, for every column of the feed but the ordinal: its profile, an @ in its samples, a date pattern, its most frequent values."""
    names = [c for c in feed.columns if c != ordinal]
    shaped = profile_columns(feed, names).select("column", "type", F.when(F.col("total") > F.col("nulls"), F.col("distinct") / (F.col("total") - F.col("nulls"))).otherwise(0.0).alias("uniqueness"))
    at = first_samples(feed, names, ordinal).groupBy("column").agg(F.max(F.col("sample").contains("@")).alias("has_at"))
    dated = date_patterns(feed, names, ordinal).select("column", F.lit(True).alias("has_date")).distinct()
    top = top_values(feed, names).groupBy("column").agg(F.collect_list(F.upper("value")).alias("top_values"))
    out = shaped.join(at, "column", "left").join(dated, "column", "left").join(top, "column", "left")
    return out.select(slug("column").alias("source_field"), "type", "uniqueness", F.coalesce("has_at", F.lit(False)).alias("has_at"), F.coalesce("has_date", F.lit(False)).alias("has_date"), F.coalesce("top_values", F.array().cast("array<string>")).alias("top_values"))


def propose_mapping(columns: DataFrame, candidates: DataFrame) -> DataFrame:
    """(source_field, target, score, ambiguous): the best candidate, the earlier field of equal ones; UNMAPPED below PROPOSE; ambiguous where several columns claim a target."""
    best = candidates.groupBy("source_field").agg(F.max_by(F.struct("target", "score"), F.struct("score", -F.col("place"))).alias("b"))
    fine = F.col("b.score") >= PROPOSE
    out = columns.select("source_field").join(best, "source_field", "left").select("source_field", F.when(fine, F.col("b.target")).otherwise("UNMAPPED").alias("target"), F.when(fine, F.col("b.score")).otherwise(UNMAPPED_SCORE).alias("score"))
    claims = out.where("target != 'UNMAPPED'").groupBy("target").agg(F.count("*").alias("claims"))
    return out.join(claims, "target", "left").select("source_field", "target", "score", F.coalesce(F.col("claims") > 1, F.lit(False)).alias("ambiguous"))


def mapping_findings(proposals: DataFrame, canonical: Sequence[CanonicalField] = CUSTOMER_V1) -> DataFrame:
    """(finding, target) that keep a mapping set from approval: unmapped required fields, ambiguous or unknown targets."""
    spark = proposals.sparkSession
    fields = spark.createDataFrame([(f.name, f.required) for f in canonical], "target string, required boolean")
    used = proposals.where("target != 'UNMAPPED'").select("target").distinct()
    missing = fields.where("required").join(used, "target", "left_anti").select(F.lit("unmapped_required").alias("finding"), "target")
    unknown = used.join(fields, "target", "left_anti").select(F.lit("unknown_target").alias("finding"), "target")
    shared = proposals.where("ambiguous").select(F.lit("ambiguous_target").alias("finding"), "target").distinct()
    return missing.unionByName(unknown).unionByName(shared)


def mapping_accuracy(proposals: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: labelled columns, those mapped as labelled, unmapped ones, ambiguous ones."""
    both = labels.join(proposals, "source_field", "left")
    return both.agg(F.count("*").alias("labelled"), F.count_if(F.col("target") == F.col("expected")).alias("correct"), F.count_if(F.coalesce("target", F.lit("UNMAPPED")) == "UNMAPPED").alias("unmapped"), F.count_if(F.coalesce("ambiguous", F.lit(False))).alias("ambiguous"))


def _operation(name: str, argument, value: Column, target: str) -> tuple[Column, Column | None]:
    """A column after one operation, and the error it may give."""
    if name == "TRIM":
        return trim_ws(value), None
    if name == "LOWERCASE":
        return F.lower(value), None
    if name == "UPPERCASE":
        return F.upper(value), None
    if name == "NORMALIZE_EMAIL":
        return normalize_email(value), None
    if name == "MAP_ENUM":
        return map_enum(value, argument), None
    if name == "CAST":
        out = cast_text(value, argument)
        return out, error_when(out.isNull() & ~null_or_blank(value), f"{target.upper()}_CAST_ERROR", target, f"not a valid {argument}")
    if name == "PARSE_DATE":
        out = parse_date(value, argument)
        return out, error_when(out.isNull() & ~null_or_blank(value), "INVALID_DATE", target, "not a valid date")
    raise ValueError(f"unknown operation {name}")


def apply_mapping(feed: DataFrame, mapping: Sequence[FieldMapping], ordinal: str) -> DataFrame:
    """(row_index, canonical columns, errors): one projection of composed expressions over the feed."""
    lacking = sorted({s for m in mapping for s in m.sources} - set(feed.columns))
    if lacking:
        raise ValueError(f"the feed lacks {lacking}")
    columns, errors = [], []
    for m in mapping:
        steps = list(m.operations)
        if steps and steps[0][0] == "CONCAT":
            value = concat_fields(m.sources, *steps.pop(0)[1])
        else:
            value = F.col(m.sources[0])
        for name, argument in steps:
            value, bad = _operation(name, argument, value, m.target)
            if bad is not None:
                errors.append(bad)
        columns.append(value.alias(m.target))
    found = F.array_compact(F.array(*errors)) if errors else F.array()
    return feed.select(F.col(ordinal).alias("row_index"), *columns, found.cast(f"array<{ERROR_TYPE.simpleString()}>").alias("errors"))


def validate_records(records: DataFrame, today, canonical: Sequence[CanonicalField] = CUSTOMER_V1, unique_email: bool = False, reference: tuple[str, DataFrame, str] | None = None) -> DataFrame:
    """The records with the errors of all record rules appended. reference: (column, table, its column) for referential integrity.

    Repeated ids and e-mails are counted by grouped aggregates joined back, so that a hot value combines before it is shuffled."""
    kinds = {f.name: f for f in canonical}
    day = F.lit(today).cast("date")
    kind = {f.name: f.dataType for f in records.schema.fields}
    typed = [(n, ~F.lit(isinstance(kind[n], T.StringType)) & F.col(n).isNotNull(), "must be text") for n in ("customer_id", "first_name", "last_name")]
    typed.append(("date_of_birth", ~F.lit(isinstance(kind["date_of_birth"], T.DateType)) & F.col("date_of_birth").isNotNull(), "must be a date"))
    moment = F.try_to_timestamp(F.col("created_at").cast("string")) if isinstance(kind["created_at"], (T.StringType, T.DateType, T.TimestampType)) else F.lit(None).cast("timestamp")
    typed.append(("created_at", moment.isNull() & F.col("created_at").isNotNull(), "must be a timestamp"))
    birth = F.col("date_of_birth") if isinstance(kind["date_of_birth"], T.DateType) else F.lit(None).cast("date")
    rules = [error_when(null_or_blank(f.name), f"{f.name.upper()}_REQUIRED", f.name, f"{f.name} is required") for f in canonical if f.required]
    rules += [error_when(bad, f"{n.upper()}_TYPE", n, f"{n} {what}") for n, bad, what in typed]
    rules.append(error_when(birth > day, "DOB_IN_FUTURE", "date_of_birth", "date of birth is in the future"))
    rules.append(error_when(moment.cast("date") > day, "CREATED_AT_IN_FUTURE", "created_at", "created_at is in the future"))
    rules.append(error_when(~null_or_blank("email") & ~is_email("email"), "EMAIL_FORMAT", "email", "not an e-mail address"))
    rules.append(error_when(~null_or_blank("status") & ~F.upper(trim_ws("status")).isin(*kinds["status"].allowed), "STATUS_ENUM", "status", "unknown status"))
    out = records
    repeated = [("customer_id", norm_text("customer_id"), "CUSTOMER_ID_DUPLICATE")] + ([("email", F.lower(norm_text("email")), "EMAIL_DUPLICATE")] if unique_email else [])
    for name, value, rule in repeated:
        many = out.groupBy(value.alias(f"__dt_{name}")).agg(F.count("*").alias(f"__dt_n_{name}")).where(f"__dt_n_{name} > 1 and __dt_{name} is not null")
        out = out.join(many, value == F.col(f"__dt_{name}"), "left")
        rules.append(error_when(F.col(f"__dt_n_{name}").isNotNull(), rule, name, f"{name} repeats in the batch"))
    if reference is not None:
        name, table, column = reference
        known = table.select(F.col(column).alias("__dt_ref")).where("__dt_ref is not null").distinct().withColumn("__dt_known", F.lit(True))
        out = out.join(known, F.col(name) == F.col("__dt_ref"), "left")
        rules.append(error_when(~null_or_blank(name) & F.col("__dt_known").isNull(), "REFERENTIAL_INTEGRITY", name, "not in the reference table"))
    return out.withColumn("errors", F.concat("errors", F.array_compact(F.array(*rules)))).select(records.columns)


def valid_records(validated: DataFrame) -> DataFrame:
    """Records without errors, trimmed, e-mail in lower and status in upper case."""
    rows = validated.where((F.size("errors") == 0) & ~null_or_blank("created_at"))
    return rows.select("row_index", norm_text("customer_id").alias("customer_id"), norm_text("first_name").alias("first_name"), norm_text("last_name").alias("last_name"), normalize_email("email").alias("email"), "date_of_birth", F.upper(trim_ws("status")).alias("status"), "created_at")


def violations_by_rule(validated: DataFrame) -> DataFrame:
    return validated.select(F.explode("errors").alias("e")).groupBy(F.col("e.rule_id").alias("rule_id")).agg(F.count("*").alias("n"))


# Category of the rules by what their name holds, and what is suggested; rules of PROTECTED can't be dismissed.
RULE_TEXTS = {
    "REQUIRED": ("VALIDATION_ERROR", "Give a value for the field."),
    "CAST_ERROR": ("TRANSFORMATION_ERROR", "Correct the value to the field's type."),
    "INVALID_DATE": ("TRANSFORMATION_ERROR", "Write the date as YYYY-MM-DD."),
    "CONCAT_NULL": ("TRANSFORMATION_ERROR", "Give a value for every joined field."),
    "UNSUPPORTED": ("TRANSFORMATION_ERROR", "Use one of the known operations."),
    "IN_FUTURE": ("BUSINESS_RULE_ERROR", "Give a date that is not in the future."),
    "EMAIL_FORMAT": ("VALIDATION_ERROR", "Give a valid e-mail address."),
    "STATUS_ENUM": ("VALIDATION_ERROR", "Use one of the allowed values."),
    "DUPLICATE": ("DUPLICATE_ERROR", "Keep one record or give another key."),
    "REFERENTIAL_INTEGRITY": ("REFERENTIAL_INTEGRITY_ERROR", "Add the referenced record first."),
}
PROTECTED = ("CUSTOMER_ID_REQUIRED", "CUSTOMER_ID_DUPLICATE")


def _rule_text(rule: Column, i: int) -> Column:
    out = None
    for name, texts in RULE_TEXTS.items():
        out = F.when(rule.contains(name), texts[i]) if out is None else out.when(rule.contains(name), texts[i])
    return out.otherwise("VALIDATION_ERROR" if i == 0 else "Review the record.")


def to_exceptions(validated: DataFrame, source: str, run: str) -> DataFrame:
    """One row for each error, with a stable id, category, suggestion and the observed value masked."""
    names = [f.name for f in CUSTOMER_V1]
    observed = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("string"))])
    rows = validated.select("row_index", F.col("customer_id").cast("string").alias("record_key"), observed.alias("o"), F.explode("errors").alias("e"))
    rule, of = F.col("e.rule_id"), F.col("e.field")
    value = F.element_at("o", of)
    shown = F.when(of.contains("email"), mask_email(value)).when(of.contains("phone"), mask_phone(value)).when(of.rlike("first.*name|last.*name|name.*(first|last)"), mask_name(value)).otherwise(trim_ws(value))
    raw_id = F.concat_ws("-", F.lit(source), F.col("row_index").cast("string"), F.coalesce("record_key", F.lit("none")), rule, of)
    out = rows.select(F.regexp_replace(raw_id, "[^A-Za-z0-9_-]", "_").alias("exception_id"), F.lit(run).alias("run_id"), "row_index", rule.alias("rule_id"), of.alias("field"), _rule_text(rule, 0).alias("category"), _rule_text(rule, 1).alias("suggestion"), shown.alias("observed"), rule.isin(*PROTECTED).alias("protected"))
    return out.dropDuplicates(["exception_id"])


# The allowed moves of an exception.
MOVES = (("OPEN", "CORRECTED"), ("OPEN", "DISMISSED"), ("CORRECTED", "REPROCESSED"), ("CORRECTED", "RESOLVED"), ("CORRECTED", "DISMISSED"), ("REPROCESSED", "CORRECTED"), ("REPROCESSED", "RESOLVED"), ("REPROCESSED", "DISMISSED"))


def exception_states(exceptions: DataFrame, events: DataFrame) -> DataFrame:
    """(exception_id, status, refused): events in time order folded through the allowed moves; others are refused and counted. An exception has few events, which fold in one expression."""
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, b in MOVES])
    told = events.groupBy("exception_id").agg(F.array_sort(F.collect_list(F.struct("at", "status"))).alias("v"))
    both = exceptions.select("exception_id", "protected").join(told, "exception_id", "left")
    start = F.struct(F.lit("OPEN").alias("status"), F.lit(0).cast("bigint").alias("refused"))

    def move(state, event):
        fine = F.array_contains(allowed, F.concat(state.status, F.lit(">"), event.status)) & ~(F.col("protected") & (event.status == "DISMISSED"))
        return F.struct(F.when(fine, event.status).otherwise(state.status).alias("status"), (state.refused + F.when(fine, 0).otherwise(1)).cast("bigint").alias("refused"))

    return both.select("exception_id", F.aggregate(F.coalesce("v", F.array().cast("array<struct<at:timestamp,status:string>>")), start, move).alias("s")).select("exception_id", "s.*")


def apply_corrections(feed: DataFrame, ordinal: str, corrections: DataFrame) -> DataFrame:
    """The feed's corrected rows: (row_index, field, value, at) overrides put in, the last for each field."""
    last = corrections.groupBy("row_index", "field").agg(F.max_by("value", "at").alias("value"))
    overrides = last.groupBy("row_index").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("__dt_new"))
    both = feed.join(overrides, feed[ordinal] == overrides["row_index"])
    return both.select(*[F.when(F.map_contains_key("__dt_new", c), F.try_element_at("__dt_new", F.lit(c)).cast(feed.schema[c].dataType)).otherwise(F.col(c)).alias(c) for c in feed.columns])


def moves_refused(events: DataFrame, allowed: Sequence[tuple[str, str]], id_column: str, at: str, start: str) -> DataFrame:
    """Events that no allowed move leads to from the one before."""
    order = Window.partitionBy(id_column).orderBy(at)
    steps = events.withColumn("before", F.coalesce(F.lag("status").over(order), F.lit(start)))
    return steps.where(~F.concat("before", F.lit(">"), "status").isin(*[f"{a}>{b}" for a, b in allowed]))


TRACKED_FIELDS = ("first_name", "last_name", "email", "date_of_birth", "status")


def canonical_to_source(records: DataFrame, key: Sequence[str] = ("customer_id",), tracked: Sequence[str] = TRACKED_FIELDS) -> DataFrame:
    """Valid canonical records as a source of history: the key and the tracked columns, the date of birth as a date, others as text."""
    return records.select(*[F.col(c).cast("date" if c == "date_of_birth" else "string").alias(c) for c in (*key, *tracked)])


def canonical_batch(records: DataFrame, processing_date=None) -> DataFrame:
    """Canonical records as rows that the guardrail looks at: the source columns and a time, which is updated_at if there is one, else noon of the processing date, else created_at."""
    noon = F.lit(processing_date).cast("timestamp") + F.expr("interval 12 hours") if processing_date is not None else F.lit(None).cast("timestamp")
    updated = F.try_to_timestamp(F.col("updated_at").cast("string")) if "updated_at" in records.columns else F.lit(None).cast("timestamp")
    created = F.try_to_timestamp(F.col("created_at").cast("string"))
    created = F.when(F.length(F.col("created_at").cast("string")) == 10, created + F.expr("interval 12 hours")).otherwise(created)  # a date counts as its noon
    at = F.coalesce(updated, noon, created).alias("created_at")
    named = records.withColumn("customer_id", F.coalesce(F.col("customer_id").cast("string"), F.lit(""))).withColumn("status", F.upper(F.coalesce("status", F.lit(""))))
    return named.select(*[F.col(c).cast("date" if c == "date_of_birth" else "string").alias(c) for c in ("customer_id", *TRACKED_FIELDS)], at)


def reprocess_exceptions(exceptions: DataFrame, events: DataFrame, validated: DataFrame) -> DataFrame:
    """(exception_id, status) of corrected exceptions after their records have been mapped and validated again, across the whole batch.

    An exception is RESOLVED when its record has no errors left, else REPROCESSED; only CORRECTED ones change. validated: row_index, errors."""
    states = exception_states(exceptions, events).where("status = 'CORRECTED'").select("exception_id")
    left = validated.groupBy("row_index").agg(F.max(F.size("errors")).alias("n"))
    rows = exceptions.join(states, "exception_id").join(left, "row_index", "left")
    return rows.select("exception_id", F.when(F.col("n") == 0, "RESOLVED").otherwise("REPROCESSED").alias("status"))
