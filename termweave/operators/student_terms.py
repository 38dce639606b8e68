"""From course rows to one row for each student and term."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions import columns as C
from termweave.functions import constants as K

KEYS = ("student_id", "term_id")
PASS_THROUGH = ("institution_id", "academic_year", "academic_term", "term_start_dt", "term_ordinal", "term_rank", "term_rank_core", "term_rank_noncore", "term_is_core", "term_is_noncore", "term_in_peak_covid", "term_program_of_study", "term_degree")


def _total(c: str, kind: str) -> Column:
    return F.coalesce(F.sum(F.col(c).cast(kind)), F.lit(0).cast(kind))


def _distinct(c: str) -> Column:
    """Distinct known values as the size of a set: a student-term has few rows, and several countDistinct would expand them."""
    return F.size(F.collect_set(c)).cast("bigint")


def _listed(c: str) -> Column:
    """All values with nulls, sorted, so that the list does not depend on the order of rows."""
    return F.transform(F.sort_array(F.collect_list(F.struct(F.col(c).alias("x")))), lambda s: s["x"])


def summary_aggregates(columns: Sequence[str]) -> dict[str, Column]:
    """Output name -> aggregate, for those whose input is there."""
    made = {
        "num_courses": ("course_id", lambda c: F.count(c)),
        "course_ids": ("course_id", _listed),
        "course_id_nunique": ("course_id", _distinct),
        "num_courses_passed": ("course_passed", lambda c: _total(c, "int").cast("bigint")),
        "num_courses_completed": ("course_completed", lambda c: _total(c, "int").cast("bigint")),
        "num_credits_attempted": ("number_of_credits_attempted", lambda c: _total(c, "double")),
        "num_credits_earned": ("number_of_credits_earned", lambda c: _total(c, "double")),
        "course_subjects": ("course_cip", _listed),
        "course_subject_nunique": ("course_cip", _distinct),
        "course_subject_areas": ("course_subject_area", _listed),
        "course_subject_area_nunique": ("course_subject_area", _distinct),
        "course_level_mean": ("course_level", F.avg),
        "course_level_std": ("course_level", F.stddev_samp),
        "course_grade_numeric_mean": ("course_grade_numeric", F.avg),
        "course_grade_numeric_std": ("course_grade_numeric", F.stddev_samp),
        "section_num_students_enrolled_mean": ("sections_num_students_enrolled", F.avg),
        "section_num_students_enrolled_std": ("sections_num_students_enrolled", F.stddev_samp),
        "sections_num_students_enrolled": ("sections_num_students_enrolled", lambda c: _total(c, "bigint")),
        "sections_num_students_passed": ("sections_num_students_passed", lambda c: _total(c, "bigint")),
        "sections_num_students_completed": ("sections_num_students_completed", lambda c: _total(c, "bigint")),
    }
    return {out: make(c) for out, (c, make) in made.items() if c in columns}


def vocabulary(df: DataFrame, columns: Sequence[str], most: int = 1000) -> dict[str, list]:
    """Distinct values of category columns; raises for a column of more than about that many, before any are gathered."""
    sizes = df.agg(*(F.approx_count_distinct(c).alias(c) for c in columns)).first()
    if large := [c for c in columns if sizes[c] > 1.1 * most]:
        raise ValueError(f"more than {most} values: {large}")
    row = df.agg(*(F.sort_array(F.collect_set(c)).alias(c) for c in columns)).first()
    return {c: row[c] for c in columns}


def dummy_counts(values: Mapping[str, Sequence]) -> dict[str, Column]:
    """num_courses_{column}_{value}: how many rows of the group have the value."""
    return {f"num_courses_{c}_{v}": F.sum(F.when(F.col(c) == F.lit(v), 1).otherwise(0)).cast("bigint") for c, some in values.items() for v in some}


def value_counts(pairs: Sequence[tuple[str, object]]) -> dict[str, Column]:
    """num_courses_{column}_{value}: rows with that value, or one of several (joined by |); course ids match by catalog."""
    out = {}
    for c, v in pairs:
        name = "|".join(map(str, v)) if isinstance(v, (list, tuple)) else v
        hit = C.in_catalog(c, v) if c == "course_id" else C.equals_any(c, v)
        out[f"num_courses_{c}_{name}"] = F.sum(hit.cast("int")).cast("bigint")
    return out


def grade_counts(least: float = K.MIN_PASSING_GRADE) -> dict[str, Column]:
    return {
        "num_courses_grade_is_failing_or_withdrawal": F.sum(C.failing_or_withdrawn("grade", "course_grade_numeric", least).cast("int")).cast("bigint"),
        "num_courses_grade_above_section_avg": F.sum(C.above_average("course_grade_numeric", "section_course_grade_numeric_mean").cast("int")).cast("bigint"),
    }


def aggregate_courses(df: DataFrame, keys: Sequence[str] = KEYS, dummies: Mapping[str, Sequence] | None = None, equal: Sequence[tuple[str, object]] = (), least: float = K.MIN_PASSING_GRADE) -> DataFrame:
    """All student-term features of course rows by one grouped aggregate; rows with a null key go.

    dummies: values of each category column; equal: (column, value or values) to count. took_* flags follow the counts of
    course ids and subject areas in equal. Pass-through columns take the smallest value of the group, which has one.
    """
    made = {c: F.min(c) for c in PASS_THROUGH if c in df.columns and c not in keys}
    made |= summary_aggregates(df.columns) | dummy_counts(dummies or {}) | value_counts(equal)
    if {"grade", "course_grade_numeric", "section_course_grade_numeric_mean"} <= set(df.columns):
        made |= grade_counts(least)
    made |= {c: F.sum(c).cast("bigint") for c in df.columns if c.startswith(("_new_", "_all_"))}  # of cumulative.first_occurrences()
    out = df.dropna(subset=list(keys)).groupBy(*keys).agg(*(a.alias(n) for n, a in made.items()))
    took = [n for c, v in equal if c in ("course_id", "course_subject_area") for n in value_counts([(c, v)])]
    return out.withColumns({f"took_{n.removeprefix('num_courses_')}": F.col(f"`{n}`") >= 1 for n in took}) if took else out


def custom_roll_up(df: DataFrame, keys: Sequence[str], dummies: Mapping[str, Sequence], sums: Sequence[str] = (), means: Sequence[str] = (), distinct: Sequence[str] = ()) -> DataFrame:
    """Row count, dummies as sum and mean (null is a value of its own, nan), and named aggregates."""
    made: dict[str, Column] = {"term_n_courses": F.count("*")}
    for c, values in dummies.items():
        for v in [*values, None]:
            hit = (F.col(c).isNull() if v is None else C.truthy(F.col(c) == F.lit(v))).cast("int")
            made[f"term_n_courses_{c}_{'nan' if v is None else v}"] = F.sum(hit).cast("bigint")
            made[f"term_prop_courses_{c}_{'nan' if v is None else v}"] = F.avg(hit)
    made |= {f"term_sum_{c}": F.sum(c) for c in sums} | {f"term_mean_{c}": F.avg(c) for c in means} | {f"term_nunique_{c}": F.countDistinct(c) for c in distinct}
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(*(a.alias(n) for n, a in made.items()))


def changed_from_previous(c: str, student: str = "student_id", order: Sequence[str] = ("term_rank",)) -> Column:
    """Whether the value differs from the student's previous term; false for the first one and for nulls."""
    before = F.lag(c).over(Window.partitionBy(student).orderBy(*order))
    return C.truthy(before.isNotNull() & (F.col(c) != before))


def student_term_features(df: DataFrame, full_time: float = K.FULL_TIME_CREDITS, student: str = "student_id") -> DataFrame:
    """Features of student-terms joined to their students, each where its inputs are there."""
    have = set(df.columns)
    first: dict[str, Column] = {}
    if {"term_start_dt", "cohort_start_dt"} <= have:
        year = C.enrollment_year("term_start_dt", "cohort_start_dt")
        first["year_of_enrollment_at_cohort_inst"] = year
        first["term_is_pre_cohort"] = F.col("term_start_dt") < F.col("cohort_start_dt")
        for inst in ("cohort", "other"):
            sources = [c if c in have else None for c in (f"first_year_to_certificate_at_{inst}_inst", f"years_to_latest_certificate_at_{inst}_inst")]
            first[f"student_earned_certificate_at_{inst}_inst"] = C.certificate_earned(*sources, year)
    elsewhere = "num_courses_enrolled_at_other_institution_s_Y"
    first["term_is_while_student_enrolled_at_other_inst"] = C.truthy(F.col(elsewhere) > 0) if elsewhere in have else F.lit(False)
    if "term_program_of_study" in have:
        first["term_program_of_study_area"] = C.short_cip("term_program_of_study")
    if {"num_credits_attempted", "num_credits_earned"} <= have:
        first["frac_credits_earned"] = C.ratio("num_credits_earned", "num_credits_attempted")
        first["student_term_enrollment_intensity"] = C.intensity("num_credits_attempted", full_time)
    out = df.withColumns(first)
    second: dict[str, Column] = {}
    if {"course_subject_areas", "term_program_of_study_area"} <= set(out.columns):
        second["num_courses_in_term_program_of_study_area"] = C.courses_in_area("course_subject_areas", "term_program_of_study_area")
    out = out.withColumns(second) if second else out
    third = {c.replace("num_courses_", "frac_courses_", 1): C.ratio(f"`{c}`", "num_courses") for c in out.columns if c.startswith("num_courses_")}
    for what in ("passed", "completed"):
        if {f"sections_num_students_{what}", "sections_num_students_enrolled"} <= set(out.columns):
            third[f"frac_sections_students_{what}"] = C.ratio(f"sections_num_students_{what}", "sections_num_students_enrolled")
    out = out.withColumns(third)
    last: dict[str, Column] = {}
    for name, what in (("pass", "passed"), ("completion", "completed")):
        if {f"frac_courses_{what}", f"frac_sections_students_{what}"} <= set(out.columns):
            last[f"student_{name}_rate_above_sections_avg"] = C.above_average(f"frac_courses_{what}", f"frac_sections_students_{what}")
    order = ("academic_year", "term_ordinal") if {"academic_year", "term_ordinal"} <= have else ("term_rank",)  # the former is how histories sort
    for c in ("term_program_of_study", "term_program_of_study_area", "term_degree"):
        if c in out.columns:
            last[f"{c}_changed_prev_term"] = changed_from_previous(c, student, order)
    return out.withColumns(last) if last else out


def fractions_out_of_range(df: DataFrame, prefix: str = "frac_") -> DataFrame:
    """One row: for each fraction column, how many values lie outside of [0, 1]."""
    return df.agg(*(F.sum(F.when(F.col(c).between(0, 1) | F.col(c).isNull(), 0).otherwise(1)).cast("bigint").alias(c) for c in df.columns if c.startswith(prefix)))
