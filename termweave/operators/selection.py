"""Rows and students to keep."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions import columns as C
from termweave.functions import constants as K


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """df, or an error if it has no row."""
    if df.isEmpty():
        raise ValueError(f"no rows left: {what}")
    return df


def students_with(df: DataFrame, attributes: Mapping[str, object], student: Sequence[str] = ("student_id",)) -> DataFrame:
    """Students with a row that meets all attributes (a value, or a list of them), with the attributes of their first such row."""
    keep = F.lit(True)
    for c, v in attributes.items():
        keep = keep & C.equals_any(c, v)
    return df.where(keep).groupBy(*student).agg(*(F.min(c).alias(c) for c in attributes))


def complete_identifiers(df: DataFrame, columns: Sequence[str] = ("course_prefix", "course_number")) -> DataFrame:
    return df.dropna(how="any", subset=list(columns))


def terms_lost(df: DataFrame, columns: Sequence[str] = ("course_prefix", "course_number"), terms: Sequence[str] = ("academic_year", "academic_term")) -> DataFrame:
    """Terms whose every row lacks an identifier."""
    return df.select(*terms).distinct().join(complete_identifiers(df, columns).select(*terms).distinct(), list(terms), "left_anti")


def since_cohort(df: DataFrame, year: str = "academic_year", cohort: str = "cohort") -> DataFrame:
    """Rows of the cohort year or later; rows without either go."""
    return df.where(F.col(year) >= F.col(cohort))


def pre_cohort_report(df: DataFrame, student: str = "student_id", year: str = "academic_year", cohort: str = "cohort") -> DataFrame:
    """One row: rows before the cohort, students with any, and students with no others."""
    early = C.truthy(F.col(year) < F.col(cohort))
    one = df.groupBy(student).agg(F.sum(early.cast("int")).alias("n"), F.bool_and(early).alias("only"), F.bool_or(early).alias("some"))
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return one.agg(count("n").alias("n_rows"), count(F.col("some").cast("int")).alias("n_students"), count(F.col("only").cast("int")).alias("n_only"))


def drop_dual_enrolled(df: DataFrame, c: str = "enrollment_type", codes: Sequence[str] = K.DUAL_ENROLLMENT) -> DataFrame:
    return df.where(~C.truthy(F.col(c).isin(list(codes))))


def labels_param(text: str | Sequence[str] | None) -> list[str]:
    """Labels of a JSON list (or a list), stripped and lower-cased."""
    values = json.loads(text) if isinstance(text, str) else text or []
    return [" ".join(str(v).lower().split()) for v in values]


def with_labels(df: DataFrame, a: str, b: str, labels: Sequence[str]) -> DataFrame:
    """Rows whose joined label is wanted; an empty list is an error."""
    if not labels:
        raise ValueError("no labels")
    return df.where(C.joined_label(a, b).isin(labels_param(list(labels))))


def without_cohorts(df: DataFrame, labels: Sequence[str], a: str = "cohort_term", b: str = "cohort") -> DataFrame:
    """Rows of other cohorts than those; unchanged if columns are missing."""
    if a not in df.columns or b not in df.columns or not labels:
        return df
    return df.where(~C.truthy(C.joined_label(a, b).isin(labels_param(list(labels)))))


def drop_readmits(df: DataFrame, student: str = "student_id", c: str = "enrollment_type", value: str = "RE-ADMIT") -> DataFrame:
    """Rows of students who were never readmitted."""
    return df.join(df.where(F.col(c) == value).select(student).distinct(), student, "left_anti")


def earliest_record(df: DataFrame, student: str = "student_id", year: str = "cohort", term: str = "cohort_term", ties: Sequence[str] = ()) -> DataFrame:
    """Each student's record of the earliest term; unknown terms last."""
    order = F.coalesce(C.extract(year, r"(\d{4})").cast("int") * 10 + C.term_ordinal(term), F.lit(2**31 - 1))
    over = Window.partitionBy(student).orderBy(order, *ties)
    return df.withColumn("_n", F.row_number().over(over)).where("_n = 1").drop("_n")


def filter_mask(c: str, operator: str, value) -> Column:
    """contains, equals, startswith or isin on the text of a column; null is false."""
    text = F.col(c).cast("string")
    made = {"contains": lambda: text.contains(value), "equals": lambda: text == F.lit(value), "startswith": lambda: text.startswith(value), "isin": lambda: text.isin([str(v) for v in value])}
    if operator not in made:
        raise ValueError(f"no such filter: {operator}")
    return C.truthy(made[operator]())


def without_prefixes(df: DataFrame, c: str, prefixes: Sequence[str]) -> DataFrame:
    """Rows whose text does not start with one of the prefixes, whatever the case."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | C.truthy(F.lower(F.trim(c)).startswith(p.lower()))
    return df.where(~hit)
