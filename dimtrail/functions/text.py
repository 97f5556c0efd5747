"""Column expressions on text and values."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as an e-mail address, a phone number and a social security number.
EMAIL = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"
PHONE = r"^(\+?[0-9]{1,3}[-.\s]?)?(\(?[0-9]{3}\)?[-.\s]?)?[0-9]{3}[-.\s]?[0-9]{4}$"
SSN = r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_ws(c: Column | str) -> Column:
    """White space of any kind off both ends; Spark's trim takes blanks only."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def norm_text(c: Column | str) -> Column:
    """The value as trimmed text, blank as null."""
    return F.nullif(trim_ws(col(c).cast("string")), F.lit(""))


def null_or_blank(c: Column | str) -> Column:
    return norm_text(c).isNull()


def any_null(columns: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def no_null(columns: Iterable[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def compares_as_text(a: T.DataType, b: T.DataType) -> bool:
    return a != b or isinstance(a, T.StringType)


def slug(c: Column | str) -> Column:
    """Snake-case name: word characters, single underscores, lower case; empty becomes col."""
    words = F.regexp_replace(trim_ws(c), r"(?U)[^\w]+", "_")
    tight = F.regexp_replace(F.regexp_replace(words, "_+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.lower(tight), F.lit("")), F.lit("col"))


def to_flag(c: Column | str) -> Column:
    """true, 1 and yes are true, other text false, blank null."""
    return F.when(null_or_blank(c), None).otherwise(F.lower(norm_text(c)).isin("true", "1", "yes"))


# Accepted date formats, dates before times.
DATE_FORMATS = ("yyyy-M-d",)
TIME_FORMATS = ("yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s", "yyyy-M-d'T'H:m:sXXX", "yyyy-M-d H:m:sXXX", "yyyy-M-d'T'H:m:s.SSSSSS", "yyyy-M-d H:m:s.SSSSSS", "yyyy-M-d'T'H:m:s.SSS", "yyyy-M-d H:m:s.SSS", "yyyy-M-d'T'H:m:s.SSSXXX", "yyyy-M-d'T'H:m:s.SSSSSSXXX", "yyyy-M-d H:m:s.SSSXXX", "yyyy-M-d H:m:s.SSSSSSXXX", "yyyy-M-d'T'H:mXXX", "yyyy-M-d H:m", "yyyy-M-d'T'H:m")


def to_history_date(c: Column | str) -> Column:
    """The written calendar date of a date, or of a date and time in one of the accepted formats; null for anything else."""
    text = norm_text(c)
    day = F.regexp_extract(text, r"^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})($|[ T])", 1)
    whole = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in (*DATE_FORMATS, *TIME_FORMATS)])
    return F.when(whole.isNotNull(), F.coalesce(*[F.try_to_timestamp(F.nullif(day, F.lit("")), F.lit(f)) for f in DATE_FORMATS]).cast("date"))


def to_utc(c: Column | str) -> Column:
    """A date at midnight, or a timestamp, of the session's zone (which is UTC)."""
    return col(c).cast("timestamp")


def error(rule: str, field: str, message: str) -> Column:
    return F.struct(F.lit(rule).alias("rule_id"), F.lit(field).alias("field"), F.lit(message).alias("message"))


ERROR_TYPE = T.StructType([T.StructField(n, T.StringType()) for n in ("rule_id", "field", "message")])


def error_when(condition: Column, rule: str, field: str, message: str) -> Column:
    return F.when(condition, error(rule, field, message))


def normalize_email(c: Column | str) -> Column:
    return F.lower(trim_ws(c))


def cast_text(c: Column | str, kind: str) -> Column:
    """Text as string, integer, float or boolean; blank or impossible gives null."""
    text = norm_text(c)
    if kind == "string":
        return text
    number = F.when(text.rlike(NUMBER), text.try_cast("double"))
    if kind == "float":
        return number
    if kind == "integer":
        return number.try_cast("bigint")
    if kind == "boolean":
        word = F.lower(text)
        return F.when(word.isin("true", "1", "t", "yes", "y"), True).when(word.isin("false", "0", "f", "no", "n"), False)
    raise ValueError(f"unknown kind {kind}")


# Strptime directives as Java patterns.
DIRECTIVES = {"%Y": "yyyy", "%m": "M", "%d": "d", "%H": "H", "%M": "m", "%S": "s", "%f": "SSSSSS", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%p": "a", "%I": "h"}


def java_pattern(fmt: str) -> str:
    out, i = "", 0
    while i < len(fmt):
        if fmt[i] == "%":
            out += DIRECTIVES[fmt[i : i + 2]]
            i += 2
        else:
            out += f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i]
            i += 1
    return out


def parse_date(c: Column | str, fmt: str | None = None) -> Column:
    """The date in the given strptime format, else year-month-day with dashes or slashes or an ISO timestamp; null if none fits."""
    text = norm_text(c)
    patterns = [*([java_pattern(fmt)] if fmt else []), "yyyy-M-d", "yyyy/M/d", "yyyy-M-d'T'H:m:s", "yyyy-M-d H:m:s"]
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in patterns]).cast("date")


def map_enum(c: Column | str, mapping: Mapping[str, str]) -> Column:
    """The mapped value of the trimmed text, by exact then by lower case; unmapped text stays, trimmed."""
    text = trim_ws(c)
    exact = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    folded = F.create_map(*[F.lit(x) for kv in {k.lower(): v for k, v in mapping.items()}.items() for x in kv])
    return F.coalesce(F.try_element_at(exact, text), F.try_element_at(folded, F.lower(text)), text)


def concat_fields(columns: Iterable[str], sep: str = " ", nulls: str = "skip") -> Column:
    """Values joined; nulls: skip leaves blanks out, empty keeps their place, fail gives null if any is blank."""
    parts = [norm_text(c) for c in columns]
    if nulls == "skip":
        return F.nullif(F.concat_ws(sep, *parts), F.lit(""))
    if nulls == "empty":
        return F.concat_ws(sep, *[F.coalesce(p, F.lit("")) for p in parts])
    if nulls == "fail":
        return F.when(reduce(lambda a, b: a & b, [p.isNotNull() for p in parts]), F.concat_ws(sep, *parts))
    raise ValueError(f"unknown null handling {nulls}")


def is_email(c: Column | str) -> Column:
    return F.coalesce(trim_ws(c).rlike(EMAIL), F.lit(False))


def mask_email(c: Column | str) -> Column:
    """First letter and all from the first @; a name of one letter or none shows nothing."""
    text = trim_ws(c)
    at = F.instr(text, "@")
    user = F.when(at > 2, F.concat(F.substring(text, 1, 1), F.lit("***"))).otherwise("*")
    return F.when(at > 0, F.concat(user, F.substr(text, at))).when(text.isNotNull(), "<MASKED_EMAIL>")


def mask_phone(c: Column | str) -> Column:
    digits = F.regexp_replace(col(c), "[^0-9]", "")
    return F.when(F.length(digits) >= 4, F.concat(F.lit("***-"), F.right(digits, F.lit(4)))).when(col(c).isNotNull(), "***-****")


def mask_name(c: Column | str) -> Column:
    words = F.filter(F.split(trim_ws(c), r"(?U)\s+"), lambda w: w != "")
    shown = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lit("***"))), " ")
    return F.when(shown == "", "***").otherwise(shown)


def shape_token(c: Column | str) -> Column:
    """<EMAIL>, <PHONE> or <SSN> for such values, else letters and digits as A, a and #."""
    text = col(c)
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\p{Lu}", "A"), r"\p{Ll}", "a"), r"\p{Nd}", "#")
    return F.when(trim_ws(text).rlike(EMAIL), "<EMAIL>").when(trim_ws(text).rlike(SSN), "<SSN>").when(trim_ws(text).rlike(PHONE), "<PHONE>").otherwise(shape)


# Columns whose values are names of persons.
NAME_COLUMNS = ("name", "first_name", "last_name", "full_name", "client_name", "client_full_name", "contact_name")


def sample_value(c: Column | str, policy: str, name: str = "") -> Column:
    """A value as samples may show it: masked by what it looks like or by what its column is called, else cut at 50; its shape only; or raw."""
    text = trim_ws(col(c).cast("string"))
    if policy == "raw":
        return text
    if policy == "shape_only":
        return shape_token(text)
    if policy != "masked":
        raise ValueError(f"unknown policy {policy}")
    called = [F.lit(word in name.lower()) for word in ("email", "phone", "ssn")]
    of_person = F.lit(name.lower() in NAME_COLUMNS) & ~text.rlike("^[0-9]+$")
    cut = F.when(F.length(text) > 50, F.concat(F.substring(text, 1, 50), F.lit("..."))).otherwise(text)
    return F.when(text.rlike(EMAIL) | called[0], mask_email(text)).when(text.rlike(PHONE) | called[1], mask_phone(text)).when(text.rlike(SSN) | called[2], F.when(text.isNotNull(), "***-**-1234")).when(of_person, mask_name(text)).otherwise(cut)


def date_pattern(c: Column | str) -> Column:
    """The pattern that a value's date is written in, or null. Day and month are ambiguous if both could be months and they differ."""
    text = trim_ws(c)
    first, second = (F.regexp_extract(text, r"^([0-9]{1,2})/([0-9]{1,2})/[0-9]{4}$", i).try_cast("int") for i in (1, 2))
    slashed = F.when(first > 12, "DD/MM/YYYY").when((second <= 12) & (first != second), "AMBIGUOUS").otherwise("MM/DD/YYYY")
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "YYYY-MM-DD").when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T\s][0-9]{2}:[0-9]{2}:[0-9]{2}"), "ISO_DATETIME").when(text.rlike(r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$"), "YYYY/MM/DD").when(text.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), slashed)


def logical_type(c: Column | str) -> Column:
    """The logical type of a Spark type name."""
    name = F.lower(col(c))
    return F.when(name.isin("tinyint", "smallint", "int", "bigint"), "integer").when(name.isin("float", "double") | name.startswith("decimal"), "float").when(name == "boolean", "boolean").when(name == "date", "date").when(name.startswith("timestamp"), "datetime").otherwise("string")


def type_compatible(inferred: Column, canonical: Column) -> Column:
    """Whether a column of the inferred logical type can fill a canonical field."""
    return (inferred == canonical) | (canonical == "string") | (canonical.isin("date", "datetime") & inferred.isin("date", "datetime", "string")) | ((canonical == "enum") & inferred.isin("string", "integer"))


def relative_delta(old: Column, new: Column) -> Column:
    """Size of a change against the old value, 4 places; from 0 it is the change itself, from below 0 nothing."""
    return F.bround(F.when(old > 0, F.abs(new - old) / old).when((old == 0) & (new != 0), F.abs(new - old)).otherwise(0.0), 4)


@F.pandas_udf(T.DoubleType())
def token_similarity(a, b):
    """Ratcliff-Obershelp ratio of two names in lower case, underscores as blanks; Spark has no such function."""
    from difflib import SequenceMatcher

    import pandas as pd

    plain = lambda s: (s or "").lower().replace("_", " ")
    return pd.Series([SequenceMatcher(None, plain(x), plain(y)).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")
