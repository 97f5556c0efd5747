"""Corrections of records as data: chains of operations, a few for each record, folded over its values in one expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dimtrail.functions.text import DIRECTIVES, ERROR_TYPE, cast_text, error, norm_text, normalize_email, null_or_blank, parse_date, trim_ws

STEP = "struct<op:string,argument:string,mapping:map<string,string>,fields:array<string>>"
#: What a chain may consist of; SET puts in its argument, CONCAT joins other fields of the record by it, leaving blanks out.
OPS = ("SET", "TRIM", "LOWERCASE", "UPPERCASE", "NORMALIZE_EMAIL", "CAST", "PARSE_DATE", "MAP_ENUM", "CONCAT")
KINDS = ("string", "integer", "float", "boolean")
#: States in which a record takes no correction.
CLOSED = ("RESOLVED", "DISMISSED")


def step(op: str, argument: str | None = None, mapping: Column | None = None, fields: tuple = ()) -> Column:
    """One operation as data."""
    return F.struct(F.lit(op).alias("op"), F.lit(argument).cast("string").alias("argument"), (mapping if mapping is not None else F.lit(None).cast("map<string,string>")).alias("mapping"), (F.array(*[F.lit(f) for f in fields]) if fields else F.lit(None).cast("array<string>")).alias("fields"))


def _java_pattern(fmt: Column) -> Column:
    """A strptime format as a Java pattern, for formats that are data."""
    out = F.regexp_replace(fmt, "(?<!%)([A-Za-z])", "'$1'")
    for directive, pattern in DIRECTIVES.items():
        out = F.replace(out, F.lit(directive), F.lit(pattern))
    return out


def _after(value: Column, s: Column, record: Column) -> Column:
    """The text after one step; a step of another name leaves it."""
    text = trim_ws(value)
    folded = F.element_at(F.transform(F.filter(F.map_entries(s.mapping), lambda e: F.lower(e.key) == F.lower(text)), lambda e: e.value), -1)
    mapped = F.coalesce(F.try_element_at(s.mapping, text), F.when(F.exists(F.map_keys(s.mapping), lambda k: F.lower(k) == F.lower(text)), folded), text)
    joined = F.nullif(F.call_function("array_join", F.filter(F.transform(s.fields, lambda f: norm_text(F.try_element_at(record, f))), lambda v: v.isNotNull()), F.coalesce(s.argument, F.lit(" "))), F.lit(""))
    out = F.when(s.op == "SET", s.argument).when(s.op == "TRIM", text).when(s.op == "LOWERCASE", F.lower(value)).when(s.op == "UPPERCASE", F.upper(value)).when(s.op == "NORMALIZE_EMAIL", normalize_email(value))
    for kind in KINDS:
        out = out.when((s.op == "CAST") & (s.argument == kind), cast_text(value, kind).cast("string"))
    dated = F.coalesce(F.try_to_timestamp(norm_text(value), _java_pattern(s.argument)).cast("date"), parse_date(value))
    return out.when(s.op == "PARSE_DATE", dated.cast("string")).when(s.op == "MAP_ENUM", mapped).when(s.op == "CONCAT", joined).otherwise(value)


def _folded(value: Column, steps: Column, record: Column, field: str) -> Column:
    """(value, errors) after all steps; a step that fails leaves null and an error, and the others go on from there."""

    def take(state: Column, s: Column) -> Column:
        made = _after(state.value, s, record)
        unknown = ~s.op.isin(*OPS) | ((s.op == "CAST") & ~F.coalesce(s.argument.isin(*KINDS), F.lit(False)))
        bad = F.when(unknown, error("UNSUPPORTED_TRANSFORMATION_OPERATION", field, "no such operation"))
        bad = bad.when((s.op == "CAST") & made.isNull() & ~null_or_blank(state.value), error(f"{field.upper()}_CAST_ERROR", field, "not of that type"))
        bad = bad.when((s.op == "PARSE_DATE") & made.isNull() & ~null_or_blank(state.value), error("INVALID_DATE", field, "not a valid date"))
        return F.struct(made.alias("value"), F.when(bad.isNull(), state.errors).otherwise(F.concat(state.errors, F.array(bad))).alias("errors"))

    start = F.struct(value.cast("string").alias("value"), F.array().cast(f"array<{ERROR_TYPE.simpleString()}>").alias("errors"))
    return F.aggregate(steps, start, take)


def corrected(feed: DataFrame, ordinal: str, corrections: DataFrame) -> DataFrame:
    """The feed's corrected records, all columns as text but the ordinal, with `errors` of steps that failed.

    corrections: row_index, field, at, steps (array of STEP). Those of a field are applied in time order (then by what they say), one after another; fields that the feed
    hasn't are ignored (see refused_corrections). CONCAT sees the record as it came. A record has few corrections, which fold in one expression."""
    earlier = lambda a, b: F.when(a.at < b.at, -1).when(a.at > b.at, 1).when(a.tie < b.tie, -1).when(a.tie > b.tie, 1).otherwise(0)
    chains = corrections.groupBy("row_index", "field").agg(F.array_sort(F.collect_list(F.struct("at", F.to_json("steps").alias("tie"), "steps")), earlier).alias("v"))
    chains = chains.select("row_index", "field", F.flatten(F.transform("v", lambda x: x.steps)).alias("steps"))
    chains = chains.groupBy("row_index").agg(F.map_from_entries(F.collect_list(F.struct("field", "steps"))).alias("__dt_chains"))
    both = feed.join(chains, feed[ordinal] == chains["row_index"]).drop("row_index")
    names = [c for c in feed.columns if c != ordinal]
    record = F.create_map(*[x for c in names for x in (F.lit(c), F.col(c).cast("string"))])
    none = F.array().cast(f"array<{STEP}>")
    made = both.select(ordinal, *[_folded(F.col(c), F.coalesce(F.try_element_at("__dt_chains", F.lit(c)), none), record, c).alias(c) for c in names])
    return made.select(ordinal, *[F.col(f"{c}.value").alias(c) for c in names], F.flatten(F.array(*[F.col(f"{c}.errors") for c in names])).alias("errors"))


def refused_corrections(corrections: DataFrame, fields: list[str], states: DataFrame) -> DataFrame:
    """(row_index, field, reason) of corrections that can't be: a field that isn't there, no step, an unknown step, or a record whose exceptions are all closed. states: row_index, status."""
    open_rows = states.where(~F.col("status").isin(*CLOSED)).select("row_index").distinct().withColumn("__dt_open", F.lit(True))
    both = corrections.join(open_rows, "row_index", "left")
    unknown = F.exists("steps", lambda s: ~s.op.isin(*OPS))
    reason = F.when(~F.col("field").isin(*fields), "UNKNOWN_FIELD").when(F.coalesce(F.size("steps"), F.lit(0)) < 1, "NO_STEPS").when(unknown, "UNSUPPORTED_TRANSFORMATION_OPERATION").when(F.col("__dt_open").isNull(), "CLOSED")
    return both.select("row_index", "field", reason.alias("reason")).where("reason is not null")


def rule_evaluation(validated: DataFrame, labels: DataFrame, records: str = "row_index") -> DataFrame:
    """How rules did against labelled faults (row_index, rule_id), a row for each rule and one, rule_id null, for all: injected, detected, hits, misses, extras, coverage, false_positives (share of records without any label that the rule hit).

    One full outer join of what was found and what was put in; counts are combined before the shuffle."""
    found = validated.select(F.col(records).alias("row_index"), F.explode("errors.rule_id").alias("rule_id")).distinct().withColumn("__dt_found", F.lit(True))
    faulty = labels.select("row_index").distinct().withColumn("__dt_faulty", F.lit(True))
    both = found.join(labels.select("row_index", "rule_id").distinct().withColumn("__dt_put", F.lit(True)), ["row_index", "rule_id"], "full_outer").join(faulty, "row_index", "left")
    hit, put = F.col("__dt_found").isNotNull(), F.col("__dt_put").isNotNull()
    counts = [F.count_if(put).alias("injected"), F.count_if(hit).alias("detected"), F.count_if(hit & put).alias("hits"), F.count_if(put & ~hit).alias("misses"), F.count_if(hit & ~put).alias("extras"), F.count_distinct(F.when(hit & F.col("__dt_faulty").isNull(), F.col("row_index"))).alias("__dt_false")]
    by_rule = both.groupBy("rule_id").agg(*counts).unionByName(both.agg(*counts).withColumn("rule_id", F.lit(None).cast("string")))
    clean = validated.select(F.col(records).alias("row_index")).join(faulty, "row_index", "left_anti").agg(F.count("*").alias("__dt_clean"))
    rate = lambda a, b, none: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 4)).otherwise(none)
    return by_rule.join(F.broadcast(clean)).select("rule_id", "injected", "detected", "hits", "misses", "extras", rate("hits", "injected", 1.0).alias("coverage"), rate("__dt_false", "__dt_clean", 0.0).alias("false_positives"))
