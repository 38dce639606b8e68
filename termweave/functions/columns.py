"""Scalar expressions: columns in, a column out. All stay inside code generation; none fails on odd values unless it says so."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .names import java_regex


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(c: Column | str, mapping: Mapping, default: Column | None = None) -> Column:
    """mapping[c] as a chain of literals; default (null) where there is none."""
    out: Column | None = None
    for k, v in mapping.items():
        out = F.when(col(c) == F.lit(k), F.lit(v)) if out is None else out.when(col(c) == F.lit(k), F.lit(v))
    default = F.lit(None) if default is None else default
    return default if out is None else out.otherwise(default)


def extract(c: Column | str, pattern: str, group: int = 1) -> Column:
    """A group of a Python pattern, null where there is no match."""
    found = F.regexp_extract(col(c), java_regex(pattern), group)
    return F.when(col(c).rlike(java_regex(pattern)), found)


def truthy(c: Column) -> Column:
    """c with null as false."""
    return F.coalesce(c, F.lit(False))


# --- text and values -------------------------------------------------------------------------------------------------


def upper_trim(c: Column | str) -> Column:
    return F.upper(F.trim(col(c)))


def null_if_in(c: Column | str, values: Sequence) -> Column:
    return F.when(truthy(col(c).isin(list(values))), None).otherwise(col(c))


def bool_from(c: Column | str, mapping: Mapping[str, bool]) -> Column:
    return lookup(c, mapping).cast("boolean")


def bool_via_int(c: Column | str) -> Column:
    return F.try_to_number(col(c).cast("string"), F.lit("9999999999")).cast("int").cast("boolean")


def first_date(c: Column | str, formats: Sequence[str] = ("yyyy-MM-dd", "yyyyMMdd'.0'", "yyyyMMdd")) -> Column:
    return F.coalesce(*(F.try_to_timestamp(col(c), F.lit(f)) for f in formats)).cast("date")


def closed_vocabulary(c: Column | str, values: Sequence[str]) -> Column:
    """The stripped upper-case value if it is a known one, else null."""
    return F.when(upper_trim(c).isin(list(values)), upper_trim(c))


def strip_trailing_decimal(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"\.0$", "")


def numeric_scrub(c: Column | str) -> Column:
    return F.regexp_replace(col(c).cast("string"), r"[^\d.\-]", "").try_cast("double")


def yes_or_no(c: Column | str) -> Column:
    """N for null."""
    return F.coalesce(col(c), F.lit("N"))


def equals_any(c: Column | str, to) -> Column:
    """Whether c is one of the values, null as false."""
    return truthy(col(c).isin(list(to) if isinstance(to, (list, tuple, set)) else [to]))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


# --- courses ---------------------------------------------------------------------------------------------------------


def short_cip(c: Column | str) -> Column:
    """The two-digit subject area of a CIP code."""
    return F.trim(extract(c, r"^(\d[\d.])[\d.]+$"), F.lit("."))


def is_cip_like(c: Column | str) -> Column:
    return truthy(col(c).rlike(r"^\d[\d.]+$"))


def course_id(prefix: Column | str, number: Column | str) -> Column:
    return F.concat(col(prefix), col(number))


def catalog_id(c: Column | str) -> Column:
    """A course id without the -n that tells repeats apart."""
    return F.regexp_replace(F.coalesce(col(c), F.lit("None")), r"-\d+$", "")


def in_catalog(c: Column | str, keys: str | Sequence[str]) -> Column:
    """Whether c is one of the keys, or one with -n behind it."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return truthy(col(c).isin(keys) | col(c).rlike("^(?:" + "|".join(re.escape(k) for k in keys) + r")-\d+$"))


def distinct_catalog_ids(ids: Column | str) -> Column:
    """Distinct catalog ids of a list in order; an empty list for null."""
    return F.coalesce(F.array_distinct(F.transform(col(ids), lambda x: catalog_id(x))), F.array().cast("array<string>"))


def passed(grade: Column | str, least: float = K.MIN_PASSING_GRADE) -> Column:
    """Null for grades without pass or fail; other text that is no number is null as well."""
    g = col(grade)
    return F.when(g.isin(*K.NON_PASS_FAIL_GRADES), None).when(g.isin("P", "PASS"), True).when(g == "F", False).otherwise(g.try_cast("double") >= least)


def completed(grade: Column | str) -> Column:
    """False for incomplete and withdrawn; a null grade counts as completed."""
    return ~truthy(col(grade).isin(*K.INCOMPLETE_GRADES))


def course_level(number: Column | str, pattern: str = K.COURSE_LEVEL_PATTERN) -> Column:
    return extract(F.trim(col(number)), pattern).try_cast("int")


def four_digit_course_level(number: Column | str) -> Column:
    """First digit of four, 0 for three digits, a trailing letter aside; raises on other numbers."""
    n = F.regexp_replace(F.trim(col(number)), "[A-Z]$", "")
    return F.when(n.isNull(), None).when(F.length(n) == 4, F.substring(n, 1, 1).cast("int")).when(F.length(n) == 3, 0).otherwise(F.raise_error(F.concat(F.lit("unexpected course number "), n)).cast("int"))


def grade_numeric(grade: Column | str) -> Column:
    g = upper_trim(grade)
    return F.when(~truthy(g.isin(*K.NON_NUMERIC_GRADES)), g.try_cast("double"))


def grade_label(grade: Column | str, numeric: Column | str, a_is_audit: bool = True) -> Column:
    """The code of a non-numeric grade (AUDIT and OTHER spelt out), else the letter of the numeric one."""
    g, x = col(grade), col(numeric)
    code = F.when(g == "AU", "AUDIT").when(g == "O", "OTHER")
    code = code.when(g == "A", "AUDIT") if a_is_audit else code
    code = code.when(g.isin(*K.NON_NUMERIC_GRADES), g)
    letter = F.when(x < 0, None)
    for edge, name in K.GRADE_BINS:
        letter = letter.when(x <= edge, name)
    return F.coalesce(code, letter)


def failing_or_withdrawn(grade: Column | str, numeric: Column | str, least: float = K.MIN_PASSING_GRADE) -> Column:
    return equals_any(grade, ("F", "W")) | truthy((col(numeric) >= 0) & (col(numeric) < least))


def above_average(a: Column | str, b: Column | str) -> Column:
    return truthy(col(a) > col(b))


# --- students --------------------------------------------------------------------------------------------------------


def pell_flag(c: Column | str) -> Column:
    return bool_from(c, {"Y": True, "N": False})


def enrollment_year(term_start: Column | str, cohort_start: Column | str) -> Column:
    return F.ceil((F.datediff(col(term_start), col(cohort_start)) + 1) / F.lit(365.25)).cast("int")


def certificate_earned(first: Column | str | None, latest: Column | str | None, year: Column | str) -> Column:
    """Whether a certificate year lies before the year of enrolment; columns that are absent are false."""
    out = F.lit(False)
    for c in (first, latest):
        if c is not None:
            out = out | truthy(col(c) < col(year))
    return out


def courses_in_area(areas: Column | str, area: Column | str) -> Column:
    return F.size(F.filter(col(areas), lambda x: truthy(x == F.coalesce(col(area), F.lit("-1")))))


def intensity(credits: Column | str, full_time: float = K.FULL_TIME_CREDITS) -> Column:
    return F.when(col(credits) >= full_time, "FULL-TIME").otherwise("PART-TIME")


# --- terms -----------------------------------------------------------------------------------------------------------


def term_ordinal(term: Column | str, terms: Sequence[str] = K.TERMS) -> Column:
    return lookup(term, {t: i for i, t in enumerate(terms)}).cast("int")


def year_term(year: Column | str, term: Column | str) -> Column:
    """'YYYY-YY TERM', null if either part is."""
    return F.concat(col(year), F.lit(" "), col(term))


def term_date(year: Column | str, term: Column | str, bound: str = "start", first_term: str = K.FIRST_TERM) -> Column:
    """First or last day of an academic term; null for what is no year or term."""
    start = extract(year, r"^(\d{4})").cast("int")
    early = ("FALL", "SUMMER") if first_term == "SUMMER" else ("FALL",)
    out: Column | None = None
    for name, bounds in K.TERM_BOUNDS.items():
        month, day = bounds[0 if bound == "start" else 1]
        date = F.make_date(start if name in early else start + 1, F.lit(month), F.lit(day))
        out = F.when(col(term) == name, date) if out is None else out.when(col(term) == name, date)
    return out


def in_year_terms(year: Column | str, term: Column | str, pairs: Iterable[tuple[str, str]] = K.PEAK_COVID_TERMS) -> Column:
    out = F.lit(False)
    for y, t in pairs:
        out = out | truthy((col(year) == y) & (col(term) == t))
    return out


def label_season(label: Column | str, seasons: Mapping[str, int] = K.SEASON_RANK) -> Column:
    """Rank of the season that a free-form label starts with, else ends with; longer names first."""
    text = F.lower(F.regexp_replace(F.trim(col(label)), r"\s+", " "))
    names = sorted(seasons, key=lambda s: (-len(s), s))
    out = F.when(F.lit(False), 0)
    for n in names:
        out = out.when(F.startswith(text, F.lit(n)), seasons[n])
    for n in names:
        out = out.when(F.endswith(text, F.lit(n)), seasons[n])
    return out


def label_year(label: Column | str) -> Column:
    return extract(label, r"(\d{4})").cast("int")


def code_year(code: Column | str) -> Column:
    """Year of a YYYYTT code."""
    return extract(code, r"^(\d{4})").cast("int")


def code_season(code: Column | str, seasons: Mapping[str, str]) -> Column:
    return lookup(extract(code, r"^\d{4}(.+)$"), seasons)


def season_month(season: Column | str, months: Mapping[str, int] | None = None) -> Column:
    return lookup(F.upper(col(season)), months or {"SPRING": 1, "SUMMER": 5, "FALL": 8, "WINTER": 12}).cast("int")


def joined_label(a: Column | str, b: Column | str) -> Column:
    return F.lower(F.concat_ws(" ", F.trim(col(a)), F.trim(col(b))))


# --- normalisers -----------------------------------------------------------------------------------------------------


def _labelled(c: Column | str, labels: Sequence[tuple[str, Sequence[str], Sequence[str]]]) -> Column:
    """The first canonical value of which a part occurs in the label, or which the whole label means."""
    t = upper_trim(c)
    out = F.when(F.lit(False), "")
    for value, parts, wholes in labels:
        hit = t.isin(*wholes) if wholes else F.lit(False)
        for part in parts:
            hit = hit | t.contains(part)
        out = out.when(hit, value)
    return out


def normal_term(c: Column | str) -> Column:
    return _labelled(c, K.TERM_LABELS)


def normal_enrollment(c: Column | str) -> Column:
    return _labelled(c, K.ENROLLMENT_LABELS)


def normal_pell(c: Column | str) -> Column:
    return _labelled(c, K.PELL_LABELS)


def normal_credential(c: Column | str) -> Column:
    return _labelled(c, K.CREDENTIAL_LABELS)


def normal_age(c: Column | str) -> Column:
    """Age bucket of a number, a bucket's own label or a phrase."""
    text = F.upper(F.trim(F.regexp_replace(col(c).cast("string"), r"\s+", " ")))
    age = F.floor(text.try_cast("double"))
    (young, *_), (middle, *_), (old, *_) = K.AGE_BUCKETS
    parts, wholes = K.YOUNGER_LABELS
    has = lambda words: functools.reduce(lambda a, b: a | b, (text.contains(w) for w in words))
    out = F.when(text.isin(young, middle, old), text).when(has(parts) | text.isin(*wholes), young)
    out = out.when(text.contains("OLDER") & text.contains("24"), old).when(has(K.MIDDLE_PARTS), middle)
    for bucket, least, most in K.AGE_BUCKETS:
        out = out.when(age.between(least, most), bucket)
    return out


def grade_map(overrides: Mapping[str, str] | None = None) -> dict[str, str]:
    """Defaults, then an institution's own entries; keys and values stripped and upper-cased, entries without either left out."""
    own = {str(k).strip().upper(): str(v).strip().upper() for k, v in (overrides or {}).items() if k is not None and v is not None and str(k).strip()}
    return K.STATUS_GRADE_MAP | K.LETTER_GPA | own


def normal_grade(c: Column | str, mapping: Mapping[str, str] | None = None) -> Column:
    return lookup(upper_trim(c), grade_map(mapping), upper_trim(c))


# --- limits ----------------------------------------------------------------------------------------------------------


def convert_limits(unit: str, limits: Mapping[str, tuple[float, str]], terms_in_year: int) -> dict[str, float]:
    """Time limits per intensity, in years or terms."""
    if unit not in ("year", "term"):
        raise ValueError(f"no such unit: {unit}")
    factor = {("year", "term"): 1 / terms_in_year, ("term", "year"): float(terms_in_year)}
    return {k: n * factor.get((unit, of), 1.0) for k, (n, of) in limits.items()}
