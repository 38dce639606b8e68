"""The library of field transformation steps: names that a mapping may use, each a column to a column."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import columns as C
from . import constants as K

#: Conferral dates of seasons, (month, day); winter ends later here than in term features.
CONFERRAL = {"SPRING": (5, 31), "SUMMER": (8, 31), "FALL": (12, 31), "WINTER": (3, 31)}
#: Seasons of compact YYYYxx codes.
COMPACT = {"FA": "FALL", "SP": "SPRING", "SU": "SUMMER", "WI": "WINTER", "10": "FALL", "20": "SPRING", "30": "SUMMER"}
_TYPES = {"int": "bigint", "float": "double", "string": "string", "boolean": "boolean", "datetime": "timestamp"}


def cast_nullable(c: Column, dtype: str) -> Column:
    """What does not fit is null; a fraction cast to int raises."""
    x = c.cast("string").try_cast("double")
    if dtype == "int":
        return F.when(x.isNull(), None).when(x == F.floor(x), x.cast("bigint")).otherwise(F.raise_error(F.concat(F.lit("not whole: "), c.cast("string"))).cast("bigint"))
    if dtype == "boolean":
        return C.bool_from(F.lower(c.cast("string")), {"true": True, "1": True, "1.0": True, "yes": True, "y": True, "false": False, "0": False, "0.0": False, "no": False, "n": False})
    return c.try_cast(_TYPES[dtype])


def coerce_datetime(c: Column, fmt: str | None = None) -> Column:
    """With an optional strptime format."""
    if fmt is None:
        return c.cast("string").try_cast("timestamp")
    for a, b in (("%Y", "yyyy"), ("%m", "MM"), ("%d", "dd"), ("%H", "HH"), ("%M", "mm"), ("%S", "ss"), ("%y", "yy")):
        fmt = fmt.replace(a, b)
    return F.try_to_timestamp(c.cast("string"), F.lit(fmt))


def map_values(c: Column, mapping: Mapping, default: object = "passthrough") -> Column:
    """mapping[c]; unmapped values pass, or become null or a constant. An explicit null stays null unless the default is a constant."""
    text = c.cast("string")
    known = text.isin([str(k) for k in mapping]) if mapping else F.lit(False)
    mapped = C.lookup(text, {str(k): v for k, v in mapping.items() if v is not None})
    if default == "passthrough":
        return F.when(C.truthy(known), mapped.cast("string")).otherwise(text)
    if default is None:
        return mapped
    return F.when(text.isNull(), None).otherwise(F.coalesce(mapped, F.lit(default)))


def after_delimiter(c: Column, delimiter: str) -> Column:
    """What follows the first delimiter; null without one, or with nothing behind it."""
    at = F.instr(c, delimiter)
    return F.when(at > 0, F.nullif(F.trim(F.substr(c, at + len(delimiter))), F.lit("")))


def age_bucket(c: Column, reference_year: int) -> Column:
    return C.normal_age(F.lit(reference_year) - C.extract(c.cast("string"), r"^(\d{4})").cast("int"))


def conditional_credits(grade: Column, credits: Column, least: float = K.MIN_PASSING_GRADE) -> Column:
    """Credits of a passing grade, else 0."""
    return F.when(C.truthy(C.passed(grade, least)), credits.cast("double")).otherwise(F.lit(0.0))


def term_month(year: Column, season: Column) -> Column:
    """First day of the month in which a season of an academic year starts."""
    s, start = F.upper(season), C.extract(year.cast("string"), r"(\d{4})").cast("int")
    return F.make_date(F.when(s.isin("FALL", "WINTER"), start).otherwise(start + 1), C.season_month(season), F.lit(1))


def conferral_date(year: Column, season: Column) -> Column:
    """Last day of a season of an academic year."""
    start = C.extract(year.cast("string"), r"(\d{4})").cast("int")
    out = F.when(F.lit(False), F.make_date(start, F.lit(1), F.lit(1)))
    for name, (month, day) in CONFERRAL.items():
        out = out.when(F.upper(season) == name, F.make_date(start if name == "FALL" else start + 1, F.lit(month), F.lit(day)))
    return out


def compact_conferral_date(code: Column, seasons: Mapping[str, str] | None = None) -> Column:
    """Last day of the season of a YYYYxx code."""
    season = C.lookup(F.upper(F.substring(F.trim(code), 5, 10)), seasons or COMPACT)
    year = C.extract(F.trim(code), r"^(\d{4})").cast("int")
    out = F.when(F.lit(False), F.make_date(year, F.lit(1), F.lit(1)))
    for name, (month, day) in CONFERRAL.items():
        out = out.when(season == name, F.make_date(year, F.lit(month), F.lit(day)))
    return out


#: Name -> function of a column (or two, for those with extra columns) and options.
STEPS: dict[str, Callable[..., Column]] = {
    **{f"cast_nullable_{t}": (lambda c, t=t: cast_nullable(c, t)) for t in _TYPES},
    "cast_nullable_dtype": cast_nullable,
    "coerce_numeric": lambda c: c.cast("string").try_cast("double"),
    "coerce_datetime": coerce_datetime,
    "strip_whitespace": lambda c: F.trim(c),
    "lowercase": lambda c: F.lower(c),
    "uppercase": lambda c: F.upper(c),
    "replace_values_with_null": lambda c, values: C.null_if_in(c, values),
    "replace_null_tokens": lambda c, tokens=K.NULL_TOKENS: F.when(~F.upper(F.trim(c)).isin(list(tokens)), c),
    "fill_nulls": lambda c, value: F.coalesce(c, F.lit(value)),
    "fill_constant": lambda c, value: F.lit(value),
    "map_values": map_values,
    "normalize_grade": lambda c, mapping=None: C.normal_grade(c, mapping),
    "normalize_enrollment": lambda c: C.normal_enrollment(c),
    "normalize_pell": lambda c: C.normal_pell(c),
    "normalize_credential": lambda c: C.normal_credential(c),
    "normalize_student_age": lambda c: C.normal_age(c),
    "strip_trailing_decimal": lambda c: C.strip_trailing_decimal(c),
    "extract_year": lambda c: C.extract(c.cast("string"), r"(\d{4})").cast("int"),
    "substring_after_first_delimiter": after_delimiter,
    "birthyear_to_age_bucket": age_bucket,
    "conditional_credits": conditional_credits,
    "term_components_to_datetime": term_month,
    "academic_year_and_canonical_season_to_conferral_date": conferral_date,
    "compact_term_code_to_conferral_date": compact_conferral_date,
}


def apply_step(c: Column, step: Mapping, hooks: Mapping[str, Callable[..., Column]] | None = None) -> Column:
    """A step {'name': ..., 'extra_columns': [...], 'options': {...}} on a column; hooks are steps of the caller's own."""
    known = STEPS | dict(hooks or {})
    if step["name"] not in known:
        raise ValueError(f"no such step: {step['name']}")
    return known[step["name"]](c, *(F.col(x) for x in step.get("extra_columns", ())), **step.get("options", {}))
